"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows, empty
tables and further columns, against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import bpe, chat_format, html_extract, jaccard_join, lattice_dedup, mixing, pretokens, quality_classifier, quality_rules, token_counts, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, words string"
rng = random.Random(3)
LONG = " ".join(rng.choice(["the", "of", "étion", "über", "don't", "a1b2", "...", "日本"]) + str(rng.randint(0, 99)) for _ in range(30_000))
TEXTS = [None, "", "   \n\t ", "one", "the the the the", "Hello, World! it's  <|endoftext|> x", LONG, LONG[:5000], LONG[:5000], "a b c d e f g h", "A B C D E F G H", "x" * 3000, "q\n\n\n w", "v" * 70_000 + " z" * 40_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", ["s1", None, "s2"][k % 3], None, "clash", "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "null id here", None, None, None, None, None), (3, "one", "en", "s1", None, "clash", "clash")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_is_the_librarys(docs, empty, ranks):
    assert len(bpe.chunks(LONG)) > 50 and len(bpe.chunks("漢字、" * 5000)) > 2
    for deal in (3000, bpe.DEAL):
        got = by_id(bpe.digests(bpe.encode(docs, chunk=2000, deal=deal)))
        for k, t in enumerate(TEXTS):
            ids = ranks.encode_ordinary(t or "")
            assert got[k]["n_tokens"] == len(ids)
            assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert None in got and bpe.digests(bpe.encode(docs)).count() == len(TEXTS) + 2
    assert bpe.digests(bpe.encode(empty)).count() == 0


@pytest.mark.parametrize("run", ["ACGT", "=", "7", "é", "= "])
def test_chunks_of_long_runs(run):
    """Chunks hold each character of a long run about once."""
    text = ("word " * 700 + run * (2_000_000 // len(run)) + " " + "some more, " * 700) * 2
    cut = bpe.chunks(text)
    assert sum(len(x) for x, _ in cut) < 1.2 * len(text)


@pytest.mark.parametrize("run", ["ACGT", "=", "7", "é1", " ", "\n", "'"])
def test_ids_of_long_runs(ranks, run):
    text, out = ("word 's " * 30 + run * 600 + " " + "some more, " * 20 + run * 50) * 2, []
    cut = bpe.chunks(text, 50, 7)
    assert len(cut) > 5
    for k, (x, z) in enumerate(cut):
        a, b = bpe.stitches(x, z, k == 0, public_tokenizers.PATTERN)
        out += bpe.encode_piece(ranks, public_tokenizers.PATTERN, x[a:b])
    assert out == ranks.encode_ordinary(text)


@pytest.mark.parametrize("chunk", [5, 17, 60])
def test_stitched_chunks(ranks, chunk):
    r = random.Random(chunk)
    parts = ["a", " the", "'s", "'", "'ll", " ", "  ", "\n", "é", "1", "!!", "日本", "\t", " ", "'v"]
    for _ in range(400):
        text, out = "".join(r.choice(parts) for _ in range(80)), []
        cut = bpe.chunks(text, chunk, 3)
        for k, (x, z) in enumerate(cut):
            a, b = bpe.stitches(x, z, k == 0, public_tokenizers.PATTERN) if len(cut) > 1 else (0, len(x))
            out += ranks.encode_ordinary(x[a:b])
        assert out == ranks.encode_ordinary(text)


def test_counts_and_every_prefix(docs, empty):
    lib = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    total = {k: len(lib.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(TEXTS)}
    got = by_id(token_counts.token_counts(docs))
    assert {k: got[k]["n_tokens"] for k in total} == total
    assert all(got[k]["n_bytes"] == len((t or "").encode()) and got[k]["over_limit"] == (total[k] > 1024) for k, t in enumerate(TEXTS))
    counts = token_counts.PrefixCounts(public_tokenizers.path(token_counts.TOKENIZER))
    library = counts.encoder.lib
    r = random.Random(11)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "'s", "'ve", "'", "²", "ª", "\x1c", "\x85", "\xa0", "日本語", "<|endoftext|>", "<|", "\r\n", "ß", "é", "!!", " x", "\t", "🎉", "e\u0301"]
    mixed = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(300)]
    for text in [TEXTS[5], LONG[:200], "a  b\n\n c 've 'v <|endoftext|>  x", "!<|endoftext|><|endoftext|>", *mixed]:
        t = counts.table(text)
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert t.tolist() == want, text
        for budget in (0, 1, 3, want[-1]):
            assert counts.cut(t, budget) == max(k for k in range(len(text) + 1) if max(want[: k + 1]) <= budget)
    assert all((got[k]["limit_chars"] == len(t or "")) == (not got[k]["over_limit"]) for k, t in enumerate(TEXTS))
    calls = []
    counts.encoder.lib = type("Lib", (), {"__getattr__": lambda self, name: calls.append(name) or getattr(library, name)})()
    assert counts.cut(t, 2) >= 0 and not calls  # questions encode nothing
    assert token_counts.token_counts(empty).count() == 0


def test_pretokens_agree_with_the_library():
    e, r = pretokens.Encoder(public_tokenizers.path(token_counts.TOKENIZER)), random.Random(1)
    parts = ["a", "the", " ", "\n", "'s", "'", "²", "½", "ª", "×", "\x1c", "\x85", "\xa0", "日本", "<|endoftext|>", "\r\n", "ß", "é"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert e.ids(text).tolist() == e.whole(text).tolist()
        assert "".join(e.scan(text)) == text


def test_token_files(docs, empty, tmp_path):
    lib = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    got = token_files.token_files(docs).collect()
    assert len(got) == len(TEXTS) + 2
    rows = {r["doc_id"]: r for r in got}
    for k, t in enumerate(TEXTS):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert rows[k]["n_tokens"] == len(ids) and rows[k]["ids_crc32"] == zlib.crc32(ids.tobytes())
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered] == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in ordered)
    assert token_files.token_files(empty).count() == 0
    for bits in (1, 7, 16, 17, 32):
        ids = np.random.default_rng(bits).integers(0, 2**bits, 1000).astype(np.uint32)
        assert (token_files.unpack(token_files.pack(ids, bits), 1000, bits) == ids).all()
    path = tmp_path / "x.bin"
    r, parts = random.Random(2), []
    with path.open("wb") as f:
        w = token_files.Writer(f, 17, 64)
        for k in range(50):
            parts.append(np.array([r.randrange(1 << 17) for _ in range(r.choice([0, 1, 30, 200]))], np.uint32))
            w.add(k, parts[-1])
        w.close()
    with path.open("rb") as f:
        reader = token_files.Reader(f, path.stat().st_size)
        assert all((reader.document(k)[2] == parts[k]).all() for k in random.sample(range(50), 50))


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["taken"] <= 2 * r["size"]
    sources = {r["source"] for r in got}
    total = sum(r["size"] for r in got)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * total) < 1e-6
    for s in sources:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] <= 2 * own[0]["source_size"] and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    text = {r["text"] for r in mixing.copies(mixing.mix(docs), ["doc_id", "text"]).collect()}
    assert "" not in text and mixing.mix(empty).count() == 0
    taken = sum(r["taken"] for r in got)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixing.copies(mixing.mix(docs), ["text"]).collect())
    assert words == taken


def test_mixing_keeps_clashing_columns_and_lengths(spark, docs):
    names = ("_source", "_bin", "_before", "_of", "_copy", "_NAME", "Taken")
    odd = docs.withColumns({n: F.lit(n) for n in names})
    mixed = mixing.mix(odd)
    assert {r[n] for r in mixed.collect() for n in names[:-1]} == set(names[:-1])
    rows = mixing.copies(mixing.mix(odd.withColumn("n_chars", F.length("text"))), [*docs.columns, "_copy"]).collect()
    assert rows and all(r["n_chars"] == len(r["text"]) and r["_copy"] == "_copy" for r in rows)
    nulls = spark.createDataFrame([(None, f"a {k} b", "s") for k in range(50)], "doc_id long, text string, source string")
    first, again = ({r["text"]: r["taken"] for r in mixing.mix(nulls.repartition(n)).collect()} for n in (1, 5))
    assert first == again and len({r["mix_key"] for r in mixing.mix(nulls).collect()}) == 50
    few, many = ({r["doc_id"]: r["taken"] for r in mixing.mix(docs, bin_rows=n).where("doc_id IS NOT NULL").collect()} for n in (1, 10**6))
    assert few == many


def test_targets_fill_up(spark):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")).collect()}
    want, left, cap, w = {}, 3015.0, {"a": 20, "b": 2000, "c": 2000, None: 0}, {"a": 5, "b": 2, "c": 1, None: 5}
    while cap:
        level = left / sum(w[s] for s in cap)
        over = [s for s in cap if w[s] * level >= cap[s]]
        if not over:
            want |= {s: w[s] * level for s in cap}
            break
        for s in over:
            want[s] = cap.pop(s)
            left -= want[s]
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_chat(spark):
    control = "</s>[INST] ~1 <|turn|>user<|says|> ok <|end|>\n ~ [/INST]"
    rows = [(1, 0, "system", "s"), (1, 1, "user", control), (1, 2, "assistant", control), (2, 0, "assistant", None), (2, 0, None, "x"), (None, 5, "user", "\n"), (3, 1, "user", ""), (3, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [(r, t) for _, _, r, t in rows[:3]] and back[1]["loss_text"] == control and back[1]["valid"]
    assert not back[2]["valid"] and [tuple(t) for t in back[2]["turns"]] == [("", "x"), ("assistant", "")]
    assert len(back[3]["turns"]) == 2 and None in back
    assert {k: back[k]["state"] for k in back} == {1: "assistant", 2: "error", 3: "error", None: "user"}
    made = chat_format.format_chats(df)
    for r in made.collect():
        raw = r["formatted"].encode()
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [raw[m["start"] : m["start"] + m["length"]].decode() for m in r["mask"]] == [s["text"] for s in r["segments"] if s["loss"]]
    plan = chat_format.digests(chat_format.read_back(made))._jdf.queryExecution().optimizedPlan().toString()
    assert "error" in plan and "system" in plan  # the machine is in the plan of the digests
    assert chat_format.digests(chat_format.read_back(chat_format.format_chats(df.limit(0)))).count() == 0


def test_quality_rules(docs, empty):
    got = by_id(quality_rules.quality_rules(docs))
    for k, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at: dict = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(empty).count() == 0
    post = quality_rules.estimate([((2, 2, 2), 900), ((1, 2, 2), 50), ((2, 1, 2), 30), ((2, 2, 0), 20)], (0, 1)).good
    assert min(post[2, 2, 2], post[2, 2, 0]) > quality_rules.THRESHOLD > max(post[1, 2, 2], post[2, 1, 2])


def test_votes_accuracies_are_recovered(spark):
    """Votes drawn from a known table: nothing but the votes tells what it is."""
    r, kinds, m = np.random.default_rng(4), (0, 3), 6
    truth = np.array([[[0.1, 0.03, 0.87]] * m, [[0.1, 0.7, 0.2]] * 3 + [[0.2, 0.1, 0.7]] * 3, [[0.2, 0.05, 0.75]] * 3 + [[0.05, 0.8, 0.15]] * 3])
    of = r.choice(3, 60_000, p=[0.8, 0.15, 0.05])
    draws = (r.random((len(of), m))[:, :, None] > truth[of].cumsum(2)[:, :, :2]).sum(2)
    patterns, n = np.unique(draws, axis=0, return_counts=True)
    found = quality_rules.estimate([(tuple(map(int, p)), int(k)) for p, k in zip(patterns, n, strict=True)], kinds)
    assert np.abs(np.array(found.table) - truth).max() < 0.05 and np.abs(np.array(found.shares) - [0.8, 0.15, 0.05]).max() < 0.02
    rows = spark.createDataFrame([tuple(map(int, p)) for p in patterns], ", ".join(f"v{j} int" for j in range(m)))
    got = {tuple(x)[:-1]: x["p"] for x in rows.withColumn("p", found.posterior([F.col(f"v{j}") for j in range(m)])).collect()}
    assert got.keys() == found.good.keys() and max(abs(got[p] - found.good[p]) for p in got) < 1e-3


def test_quality_rules_reject_kinds_and_keep_the_rest(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.choice([2, 3, 5, 7, 8])))
    prose = lambda n: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n))
    made = [("good", prose(r.randint(40, 400))) for _ in range(600)]
    for _ in range(30):
        made.append(("symbols", " ".join(word() + r.choice(["%%%", "***", "$$$"]) for _ in range(80))))
        made.append(("pipes", " | ".join(word() for _ in range(60))))
        made.append(("stutter", " ".join(w for w in (word() for _ in range(40)) for _ in range(4))))
        made.append(("capitals", " ".join(word().upper() + "!!" for _ in range(60))))
    made += [("good", prose(200) + " a|b # 5% | (1) $3")] * 2 + [("good", prose(150) + " NATO USA EU!")] * 2
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(made)], "doc_id long, text string")
    got = by_id(quality_rules.quality_rules(docs))
    assert all(got[k]["kept"] == (kind == "good") for k, (kind, _) in enumerate(made))


def test_quality_classifier(spark, docs, empty):
    rows = [(k, " ".join(["word", "of", "text", str(k), "and"] * 8) if k % 3 else "%%% ### $$$ " * 20, "en", "s", 1, "", "") for k in range(300)]
    made, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(made, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got)
    assert quality_classifier.classify(docs, labels).count() == len(TEXTS) + 2
    assert {r["score"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(empty, labels).count() == 0


def test_lattice(spark):
    g = np.random.default_rng(4)
    base = g.normal(size=(60, 64))
    near = [b + g.normal(size=64) * 0.02 * np.linalg.norm(b) / 8 * k for b in base[:30] for k in (1, 4, 6)]
    vectors = [*base.tolist(), *[v.tolist() for v in near], *[base[0].tolist()] * 5, [0.0] * 64, None, [float("nan")] * 64, base[1].tolist()]
    rows = [(k, v, None if k == len(vectors) - 1 else 1, "x") for k, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (None, base[2].tolist(), 1, "x")], "vec_id long, embedding array<double>, label int, kept string")
    got = {r["vec_id"]: r for r in lattice_dedup.near_duplicates(df, side=8).collect()}
    ok = [k for k, v in enumerate(vectors[:-1]) if v and np.isfinite(v).all() and any(v)]
    x = np.array([vectors[k] for k in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1 + (x @ (base[2] / np.linalg.norm(base[2])) >= 0.98)
    assert sum(got[k]["n_links"] for k in ok) >= 0.95 * links.sum() and all(got[k]["n_links"] <= n for k, n in zip(ok, links, strict=True))
    for k in set(range(len(vectors))) - set(ok):
        assert got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"]
    assert got[len(base) + 90]["component_id"] == 0 and not got[None]["kept"]
    assert lattice_dedup.near_duplicates(df.limit(0)).count() == 0
    p = g.normal(size=(200, 8)) * 3
    e = lattice_dedup.decode_e8(p)
    near = ((p[:, None, :] - e[:, None, :] - lattice_dedup.neighbours()[None]) ** 2).sum(2).min(1)
    assert (((p - e) ** 2).sum(1) <= near + 1e-9).all() and len(np.unique(lattice_dedup.neighbours(), axis=0)) == 240


def jaccard_brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                n = len(sets[a] & sets[b])
                if sets[a] and 100 * n >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return [len(s) for s in sets], root


def test_jaccard(spark, docs, empty):
    r = random.Random(8)
    words = [str(k) for k in range(400)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([6, 40, 120]))]
        for _ in range(r.randint(1, 8)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t[: len(t) - r.choice([0, 0, 3])]))
    n, root = jaccard_brute(texts)
    got = by_id(jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[k]["n_shingles"] for k in range(len(texts))] == n and [got[k]["component_id"] for k in range(len(texts))] == root
    rows = by_id(jaccard_join.jaccard_components(docs))
    assert rows[9]["component_id"] == rows[10]["component_id"] == 9 and rows[7]["component_id"] == rows[8]["component_id"] == 7
    assert rows[0]["n_shingles"] == 0 and rows[0]["component_id"] == 0 and rows[None]["component_id"] is None
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert len(jaccard_join.sets([LONG])[0]) == jaccard_brute([LONG])[0][0]


def test_jaccard_with_a_shingle_of_thousands(spark, monkeypatch):
    """A passage that opens thousands of unlike documents, near copies among them, and frequent
    shingles whose entries are dealt into parts."""
    monkeypatch.setattr(jaccard_join, "IN_PART", 3)
    r = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [passage + " " + " ".join(str(r.randrange(10**6)) for _ in range(12)) for _ in range(2000)]
    texts += [passage] * 40 + [f"{passage} x{k % 30}" for k in range(60)]
    texts += [t + " more" for t in texts[:50]]
    got = by_id(jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    sets, at = [], {}
    for k, t in enumerate(texts):
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
        for x in sets[-1]:
            at.setdefault(x, []).append(k)
    root = list(range(len(texts)))
    sharing = [k for k in range(len(texts)) if k < 50 or k >= 2000]  # others share the passage alone: 16 of 40 shingles
    for a in sharing:
        for b in sharing:
            if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    assert [got[k]["component_id"] for k in range(len(texts))] == root
    assert [got[k]["n_shingles"] for k in range(len(texts))] == list(map(len, sets))


# Pages written by hand, which share no layout and no words with those that the trees are trained on.
ONE = "The river rose again on Tuesday, and by noon the lower fields were under a foot of water."
TWO = "Farmers moved their cattle to the ridge, where the old barn still stands, and waited for the rain to stop."
THREE = "By the weekend the bridge was open, though the council has asked lorries to take the longer road through the hills."
SAID = "I live near there and it was much worse in the spring of last year, nobody came."
# text straight in the body, with line breaks alone
LOOSE = f"<html><head><title>Flood</title></head><body>{ONE}<br><br>{TWO}<hr>{THREE}</body></html>"
# class names that say nothing, and reader comments below
NEUTRAL = (
    f'<html><body><div class="k1"><a href="/">Start</a> <a href="/n">News</a> <a href="/w">Weather</a> <a href="/s">Sport</a></div><div class="k2"><h1>Flood in the valley</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div>'
    + '<div class="k3"><h3>3 voices</h3>' + "".join(f'<div class="k4"><b>{n}</b><p>{SAID}</p></div>' for n in ("Ann", "Bob", "Cy")) + "</div><footer>&copy; The Valley Times</footer></body></html>"
)
# a table for a layout, as pages were once made
TABLE = f'<html><body><table><tr><td><ul><li><a href="a">Home</a><li><a href="b">Archive</a><li><a href="c">Links</a></ul></td><td class="content"><h2>Flood in the valley</h2><p>{ONE}<p>{TWO}<p>{THREE}</td></tr></table></body></html>'
# a journal's theme
THEME = (
    f'<body class="single"><header id="masthead"><a href="/">The Valley Times</a><nav id="site-navigation"><ul><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul></nav></header><div id="primary"><main><article class="post-12"><h1 class="entry-title">Flood in the valley</h1><div class="entry-content"><p>{ONE}</p><h2>After the rain</h2><p>{TWO}</p><ul><li>Boots, coats and ropes</li><li>Two boats</li></ul><p>{THREE}</p></div></article>'
    f'<div id="comments"><h2>One thought</h2><ol><li><p>{SAID}</p></li></ol><form><p>Your e-mail address will not be published.</p></form></div></main></div><aside id="secondary"><section class="widget"><h2>Latest</h2><ul><li><a href="x">Storm</a></li></ul></section></aside><footer>Proudly made by hand</footer></body>'
)
PAGES_BY_HAND = [
    (LOOSE, f"{ONE} {TWO}\n\n{THREE}"),
    (NEUTRAL, f"Flood in the valley\n\n{ONE}\n\n{TWO}\n\n{THREE}"),
    (TABLE, f"Flood in the valley\n\n{ONE}\n\n{TWO}\n\n{THREE}"),
    (THEME, f"Flood in the valley\n\n{ONE}\n\nAfter the rain\n\n{TWO}\n\nBoots, coats and ropes\n\nTwo boats\n\n{THREE}"),
]


def test_html(spark):
    trees, r = html_extract.model(), random.Random(77)
    right = sum(html_extract.extract(p, trees) == "\n\n".join(b) for p, b in (html_extract.made_page(r) for _ in range(200)))
    assert right >= 190
    page = '<html><body><nav><ul><li><a href="/a">Home</a></ul></nav><article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<p>Four.</article><footer>&copy; x</footer></body>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (4, "u", "<![x" + "<div>" * 5000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["page_id"]: x for x in html_extract.main_text(df).collect()}
    assert got[1]["text"] == "A & B\n\nOne two three.\n\nFour." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and len(got) == 5
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_html_of_pages_by_hand():
    trees = html_extract.model()
    for page, text in PAGES_BY_HAND:
        assert html_extract.extract(page, trees) == text


def test_scan_is_the_pattern():
    text = LONG[:3000].replace("日本", "x")
    assert pretokens.SCAN.findall(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_parity_sketches_bound_the_difference():
    from kinfold.llm.jaccard_join import SKETCH, parities

    rng = np.random.default_rng(3)
    pool = rng.integers(-(2**63), 2**63, 6000, np.int64)
    for n, o, both in ((0, 3, 0), (1, 1, 1), (300, 280, 250), (3000, 2900, 100)):
        x, y = pool[:n], pool[n - both : n - both + o]
        bits = np.bitwise_count((parities(x) ^ parities(y)).view(np.uint64)).sum()
        assert bits <= min(n + o - 2 * both, SKETCH) and bits % 2 == (n + o) % 2


@pytest.mark.parametrize(("lengths", "at_once"), [([1, 3, 0, 700, 20, 1, 1, 64, 64, 0], 2), ([5000], 3), ([0, 0], 1), ([], 4), ([1] * 900, 1)])
def test_documents_in_order_read_blocks_once(lengths, at_once):
    import io

    class Counted(io.BytesIO):
        took = 0

        def read(self, n=-1):
            out = super().read(n)
            self.took += len(out)
            return out

    r, f = np.random.default_rng(3), io.BytesIO()
    made = [r.integers(0, 50_257, n).astype(np.uint32) for n in lengths]
    writer = token_files.Writer(f, 17, 64)
    for k, ids in enumerate(made):
        writer.add(k if k % 7 else None, ids)
    writer.close()
    size, counted = len(f.getvalue()), Counted(f.getvalue())
    reader = token_files.Reader(counted, size)
    got = list(reader.documents(at_once))
    assert len(got) == len(made) and all(np.array_equal(a, b) for (_, _, a), b in zip(got, made, strict=True))
    assert counted.took <= size
    again = [reader.document(k) for k in range(len(made))]
    assert all(a[:2] == b[:2] and np.array_equal(a[2], b[2]) for a, b in zip(got, again, strict=True))
