"""Reading compressed VCF at any split, headers, the writer and its places, the command line."""

import gzip
import io
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from kinfold import __main__ as command
from kinfold.sources import lines, tables, vcf

HEAD = '##fileformat=VCFv4.2\n##FORMAT=<ID=GT,Number=1,Type=String,Description="">\n##FORMAT=<ID=PL,Number=G,Type=Integer,Description="">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n'


def blocked(text: bytes, size) -> bytes:
    """Text as gzip members that tell their length, and the empty last one."""
    out, at = b"", 0
    while at <= len(text):
        some = text[at : at + (n := size())] if at < len(text) else b""
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = packer.compress(some) + packer.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(some), len(some))
        at += n if some else 1
        if not some:
            break
    return out


def body(n: int) -> str:
    r = random.Random(1)
    call = lambda: f"{r.choice('01.')}/{r.choice('01')}:{r.randint(0, 9)},{r.randint(0, 9)},{r.randint(0, 9)}"
    return "".join(f"1\t{k * 3}\t.\t{r.choice(['A', 'AT', 'c'])}\t{r.choice('GT')}\t.\t.\t.\tGT:PL\t" + "\t".join(call() for _ in range(3)) + "\n" for k in range(n))


@pytest.mark.parametrize("split", [1, 97, 1000, 5000, 10**7])
def test_any_split_gives_each_line_once(split):
    r = random.Random(split)
    made = ("\n".join("x" * r.choice([0, 1, 5, 80, 3000]) + str(k) for k in range(400)) + r.choice(["", "\n"])).encode()
    data = blocked(made, lambda: r.choice([1, 50, 700, 9000]))
    got = []
    for low in range(0, len(data), split):
        for some in lines.lines(lines.split_text(io.BytesIO(data), low, min(low + split, len(data)))):
            got += some
    assert got == made.removesuffix(b"\n").split(b"\n")


def test_long_lines_and_magic_in_the_data():
    made = b"a\n" + lines.MAGIC * 40_000 + b"\n" + bytes(range(11, 200)) * 2000 + b"\nz"
    data = blocked(made, lambda: 60_000)
    got = [x for low in range(0, len(data), 211) for some in lines.lines(lines.split_text(io.BytesIO(data), low, low + 211)) for x in some]
    assert got == made.split(b"\n")


def test_block_gzip_is_read_in_parallel(spark, tmp_path):
    text, r = HEAD + body(3000), random.Random(2)
    (tmp_path / "x.vcf").write_text(text)
    (tmp_path / "x.vcf.gz").write_bytes(blocked(text.encode(), lambda: r.randint(500, 4000)))
    (tmp_path / "plain.vcf.gz").write_bytes(gzip.compress(text[:5000].encode()) + gzip.compress(text[5000:].encode()))
    want = None
    for name, split in (("x.vcf", 0), ("x.vcf.gz", 3000), ("x.vcf.gz", 40_000), ("plain.vcf.gz", 100)):
        got = vcf.read_gt(spark, str(tmp_path / name), split=split)
        rows = sorted(got.sites.collect())
        want = want or (rows, got.counts())
        assert rows and (rows, got.counts()) == want and vcf.samples(spark, str(tmp_path / name)) == ["a", "b", "c"]
        by = {(x["status"], x["n_alleles"]): x["n_sites"] for x in got.counters.collect()}
        assert by == {("not_snp", None): want[1]["not_snp"], ("missing", 2): want[1]["missing"], ("kept", 2): want[1]["alleles_2"]}
    parts = vcf.read_gt(spark, str(tmp_path / "x.vcf.gz"), split=3000).sites.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 5
    one = lines.read_lines(spark, str(tmp_path / "x.vcf.gz"), "PL").where(~F.startswith("value", F.lit("#"))).first()["value"].split("\t")
    assert one[8] == "PL" and all(len(x.split(",")) == 3 and ":" not in x for x in one[9:])


def test_folders_and_their_headers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "_hidden.gz").write_bytes(b"?")
    (folder / "a.vcf.gz").write_bytes(blocked((HEAD + body(5)).encode(), lambda: 90))
    (folder / "b.vcf.gz").write_bytes(gzip.compress(body(400).encode()))
    assert vcf.samples(spark, str(folder)) == ["a", "b", "c"] and vcf.records(spark, f"file://{folder}", "GT").count() == 405
    with pytest.raises(FileNotFoundError):
        lines.files(str(tmp_path / "none"))


def test_header_is_all_that_is_read(tmp_path, monkeypatch):
    (tmp_path / "x.vcf.gz").write_bytes(blocked((HEAD + body(40_000)).encode(), lambda: 30_000))
    read = []
    own = lines._Pieces.read
    monkeypatch.setattr(lines._Pieces, "read", lambda self, n: read.append(1) or own(self, n))
    assert lines.first_lines(str(tmp_path / "x.vcf.gz"), b"#CHROM") == HEAD.splitlines() and len(read) == 1


def sites(spark, n: int):
    rows = [(f"{1 + k % 2}", 7 * (k * 37 % n) + 1, "A", ["C", "G"][: 1 + k % 2], [0, k % 2, None], [1, 0, 0], [0.5, 0.25, 0.25][: 2 + k % 2]) for k in range(n)]
    return spark.createDataFrame(rows, "chrom string, pos long, ref string, alts array<string>, lo array<int>, hi array<int>, af array<double>").repartition(5)


def test_written_and_read_back(spark, tmp_path):
    made, out = sites(spark, 900), str(tmp_path / "out")
    vcf.write_gt(made, ["a", "b", "c"], out, parts=6)
    parts = lines.files(out)
    whole = b"".join(open(p.removeprefix("file:"), "rb").read() for p, _ in parts)
    text = gzip.decompress(whole).decode().splitlines()  # the parts joined are one file
    assert text[0].startswith("##fileformat") and sum(x.startswith("#CHROM") for x in text) == 1 and text[3].startswith("#CHROM")
    keys = [(x.split("\t")[0], int(x.split("\t")[1])) for x in text[4:]]
    assert len(parts) > 1 and keys == sorted(keys) and len(keys) == 900
    assert vcf.samples(spark, out) == ["a", "b", "c"]
    back = vcf.records(spark, out).select("chrom", "pos", "ref", "alts", "info", "calls")
    want = {(r["chrom"], r["pos"], r["ref"], tuple(r["alts"]), "AF=0.25,0.25" if len(r["alts"]) == 2 else "AF=0.25", ("0/1", f"{r['lo'][1]}/0", "./.")) for r in made.collect()}
    assert {(*r[:3], tuple(r["alts"]), r["info"], tuple(r["calls"])) for r in back.collect()} == want
    got = vcf.read_region(spark, out, "2", 1000, 2000)
    assert {r["pos"] for r in got.collect()} == {p for c, p in keys if c == "2" and 1000 <= p <= 2000}
    assert len(got.inputFiles()) < len(parts) and vcf.read_region(spark, out, "9", 0, 10).count() == 0
    phased = spark.createDataFrame([([0, -1], [1, 0])], "a array<int>, b array<int>").select(vcf.call_text(F.col("a"), F.col("b"), True).alias("c"))
    assert phased.first()["c"] == ["0|1", ".|."]


def test_command_line(spark, tmp_path, capsys):
    r = random.Random(3)
    (tmp_path / "x.vcf.gz").write_bytes(blocked((HEAD + body(600)).encode(), lambda: r.randint(500, 4000)))
    for tag in ("GT", "PL"):
        command.main([str(tmp_path / "x.vcf.gz"), str(tmp_path / tag), "-t", tag, "-s", "2", "-i", "1"])
        said = capsys.readouterr().err
        assert "600 sites" in said and "186 are no substitutions" in said and "3 pairs" in said and ("3 pairs have not converged in 1 iterations" in said) == (tag == "GT")
        rows = tables.read_estimates(spark, str(tmp_path / tag)).collect()
        assert [(x["sample1"], x["sample2"]) for x in rows] == [("a", "a"), ("a", "b"), ("b", "b")]
    with pytest.raises(ValueError, match="more samples"):
        command.main([str(tmp_path / "x.vcf.gz"), str(tmp_path / "o"), "-t", "GT", "-s", "4"])
