"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded as a hierarchy.

Every element that holds text gets features (its tag, hashes of its attributes' words and what
known words hint at, the same of its ancestors, depth, place among its siblings, how many of them
are like it and how its size compares with theirs, density of text, links and marks in its
subtree) and a score, the log-odds of being part of the article. Decoding picks the best
consistent set: if an element is dropped, so is all below it. A dynamic programme over the
tree compares, from the leaves up, what a subtree gives if dropped and if kept.

The trees are trained on pages made here, by a grammar of page layouts whose regions are known
(``made_page``); page text comes from no table. Training takes a few seconds on the driver
and the model, some kilobytes, goes out with the tasks.

Cases: null and empty pages have empty text; text that is in no block but the page's body is a
block of its own up to the next block's beginning or end, and is scored like others; broken markup is read as a browser's parser
mostly would (implied ends of paragraphs and items, unclosed elements end with their parent);
pages of any depth and length are read without recursion; a null id is kept; equal rows each
give a row; an empty table gives an empty one; other columns drop.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.boosting import Trees, train
from kinfold.llm.shared import small_batches

# Fixed values of HTML: elements without content, without shown text, and set as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title noscript template iframe object svg canvas audio video math select option datalist textarea button input".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr td th ul".split()
)
#: What an open element is ended by.
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "p": BLOCK - {"html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend", "li"} | {"li"},
}
#: Where the search for an element to end stops.
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
#: Words of attributes, by what they hint at.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip",
    "advert": "ad ads advert adverts advertisement banner sponsor sponsored promo promotion promoted dfp adsense",
    "foot": "footer foot copyright colophon legal credits bottom",
    "head": "header head masthead topbar logo branding site-title tagline hero",
    "side": "sidebar side aside widget related recommended popular trending more rail secondary complementary",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay toast privacy paywall message",
    "comment": "comment comments reply replies respond disqus discussion reader feedback",
    "share": "share sharing social follow twitter facebook likes tags tag meta byline author date",
    "form": "form login signin signup subscribe newsletter search contact register",
    "article": "article content post entry story main body text markdown prose page",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
NAMES = list(HINTS)
TAGS = ["nav", "footer", "header", "aside", "form", "article", "main", "section", "div", "p", "h1", "h2", "li", "ul", "table", "blockquote", "pre", "figure", "#text"]
OF_TAG = {"nav": "menu", "footer": "foot", "header": "head", "aside": "side", "form": "form", "article": "article", "main": "article", "dialog": "notice", "menu": "menu"}
OF_ROLE = {"navigation": "menu", "contentinfo": "foot", "banner": "head", "complementary": "side", "search": "form", "form": "form", "main": "article", "article": "article", "alert": "notice", "dialog": "notice", "alertdialog": "notice"}
#: Buckets that attribute words are hashed to.
BUCKETS = 32
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
WORDS_OF = re.compile(r"[a-z]+(?:-title)?|[A-Z][a-z]+")


class Page(HTMLParser):
    """Elements in page order, as lists: tag, parent, hints, hashed words (a bit for each bucket),
    and blocks of text. A block straight in the body gets an element "#text" of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.hints, self.depth, self.nth = ["#page"], [-1], [frozenset()], [0], [0]
        self.children, self.hashed = [0], [0]
        self.inside = 0  # the element in which the block's first word stands
        self.open = [0]
        self.hidden = 0
        self.links = 0
        self.words: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links

    def end_block(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                at = next(k for k in reversed(self.open) if k == 0 or self.tag[k] in BLOCK)
                if at == 0 or self.tag[at] in ("html", "body"):
                    at = self.add("#text", self.inside, frozenset(), 0)
                self.blocks.append((at, text, min(self.linked, len(text))))
            self.words, self.linked = [], 0

    def add(self, tag: str, up: int, hints: frozenset, hashed: int) -> int:
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.nth.append(self.children[up])
        self.children[up] += 1
        self.children.append(0)
        self.hints.append(hints)
        self.hashed.append(hashed)
        return len(self.tag) - 1

    def close(self) -> None:
        super().close()
        self.end_block()

    def shut(self, depth: int) -> None:
        """End the open elements from that place in the stack on."""
        for k in self.open[depth:]:
            if self.tag[k] in BLOCK:
                self.end_block()
        for k in reversed(self.open[depth:]):
            self.hidden -= self.tag[k] in HIDDEN
            self.links -= self.tag[k] == "a"
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and len(self.open) > 1 and any(self.tag[k] == tag for k in self.open):
            return
        if tag == "body":
            for d, k in enumerate(self.open):
                if self.tag[k] == "head":
                    self.shut(d)
                    break
        for d in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[d]]
            if tag in ENDED_BY.get(t, ()):
                self.end_block()
                self.shut(d)
                if t != "td" and t != "th":
                    break
            elif t in BLOCK or tag in SCOPE and t in SCOPE[tag]:
                break
        if tag in BLOCK:
            self.end_block()
        if tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        hashed = 0
        found = {OF_TAG[tag]} if tag in OF_TAG else set()
        for name, value in attrs:
            if value and name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                if name == "role":
                    found.update([OF_ROLE[value]] if value in OF_ROLE else [])
                for w in map(str.lower, WORDS_OF.findall(value)):
                    hashed |= 1 << zlib.crc32(w.encode()) % BUCKETS
                    if w in HINT_OF:
                        found.add(HINT_OF[w])
            if name == "hidden" or name == "style" and value and "display:none" in value.replace(" ", ""):
                found.add("notice")
        self.open.append(self.add(tag, self.open[-1], frozenset(found), hashed))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for d in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[d]]
            if t == tag:
                self.shut(d)
                return
            if t in BLOCK and tag not in BLOCK:  # an inline end does not reach through a block
                return
        if tag in ("br", "p"):
            self.words.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            if not self.words or not data.isspace() and all(map(str.isspace, self.words)):
                self.inside = self.open[-1]
            self.words.append(data)
            if self.links:
                self.linked += len(data.strip())


def parse(html: str) -> Page:
    for text in (html, html.replace("<![", "&lt;![")):
        page = Page()
        try:
            page.feed(text)
            page.close()
            return page
        except AssertionError:  # a marked section that the parser does not know
            continue
    return page


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Elements that are blocks and hold text below them, and their features."""
    n = len(page.tag)
    size, linked, blocks, marks, headings, first, largest = (np.zeros(n) for _ in range(7))
    first[:] = len(page.blocks)
    for k, (at, text, links) in enumerate(page.blocks):
        size[at] += len(text)
        linked[at] += links
        blocks[at] += 1
        marks[at] += text.count(".") + text.count(",")
        first[at] = min(first[at], k)
    below = np.ones(n)
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        headings[k] += page.tag[k] in HEADINGS
        largest[up] = max(largest[up], size[k])
        for a in (size, linked, blocks, marks, headings, below):
            a[up] += a[k]
        first[up] = min(first[up], first[k])
    inherited: list[frozenset] = [frozenset()] * n
    hashed_above = [0] * n
    for k in range(1, n):
        up = page.parent[k]
        inherited[k] = inherited[up] | page.hints[up] if page.hints[up] else inherited[up]
        hashed_above[k] = hashed_above[up] | page.hashed[up]
    chosen = np.array([k for k in range(1, n) if size[k] and (page.tag[k] in BLOCK or page.tag[k] == "#text") and page.tag[k] not in ("html", "body")], np.int64)
    alike = Counter((page.parent[k], page.tag[k], page.hashed[k]) for k in range(1, n))
    total, count = max(1.0, size[0]), max(1, len(page.blocks))
    rows = []
    for k in chosen.tolist():
        up, tag, own, above = page.parent[k], page.tag[k], page.hints[k], inherited[k]
        rows.append((
            *[tag == t for t in TAGS], *[h in own for h in NAMES], *[h in above for h in NAMES],
            page.depth[k], page.nth[k], page.children[up], page.nth[k] / max(1, page.children[up]), np.log1p(size[k]), size[k] / total, size[k] / max(1.0, size[up]),
            linked[k] / size[k], np.log1p(blocks[k]), size[k] / blocks[k], np.log1p(below[k]), size[k] / below[k], marks[k] / size[k], first[k] / count, (first[k] + blocks[k]) / count,
            alike[up, tag, page.hashed[k]], size[k] / largest[up], headings[k] / blocks[k],
        ))
    if not rows:
        return chosen, np.zeros((0, 0))
    bits = np.stack([np.array(page.hashed, np.int64)[chosen], np.array(hashed_above, np.int64)[chosen]], 1)
    bits = bits[:, :, None] >> np.arange(BUCKETS) & 1
    return chosen, np.concatenate([np.array(rows, float), bits.reshape(len(rows), -1)], 1)


def decode(page: Page, chosen: np.ndarray, score: np.ndarray) -> str:
    """The text of the best consistent choice. Dropping an element drops all below it, so each
    path from the top is kept down to some element and dropped from there on; text stands or
    falls with the element it is in."""
    n = len(page.tag)
    own = np.zeros(n)
    own[chosen] = score
    kept, dropped = own.copy(), -own
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        kept[up] += max(kept[k], dropped[k])
        dropped[up] += dropped[k]
    keep = np.ones(n, bool)
    for k in range(1, n):
        keep[k] = keep[page.parent[k]] and (own[k] == 0 and page.tag[k] not in BLOCK or kept[k] > dropped[k] or page.tag[k] in ("html", "body"))
    has = np.zeros(n, bool)
    has[chosen] = True
    return "\n\n".join(t for at, t, _ in page.blocks if keep[at] and has[at])


# Pages to learn from ---------------------------------------------------------------------


def made_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the blocks of its article."""
    letters, plain = "etaoinshrdlu", rng.random() < 0.12

    def words(a: int, b: int) -> str:
        out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b))]
        if rng.random() < 0.2:
            out = [w + rng.choice(["%%%", "***", "$$$", "###", "!!"]) for w in out]
        if rng.random() < 0.1:
            out = [w.upper() for w in out]
        return " ".join(w + (rng.choice([",", ".", ""]) if rng.random() < 0.3 else "") for w in out)

    def pick(*names: str) -> str:
        if plain and rng.random() < 0.7:  # a page whose names say nothing
            return rng.choice(["", f' class="{"".join(rng.choice(letters) for _ in range(4))}"'])
        return named(*names)

    def named(*names: str) -> str:
        name = rng.choice(names)
        return f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", "-1", " x", "-wrap"])}"'

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{j}">{words(1, 3)}</a>{rng.choice(["</li>", ""])}' for j in range(k))

    def menu() -> str:
        body = f"<ul>{links(rng.randint(3, 9))}</ul>"
        return rng.choice([f"<nav>{body}</nav>", f"<div{pick('nav', 'menu', 'navbar', 'breadcrumbs')}>{body}</div>", f"<ul{pick('menu', 'navigation')}>{links(5)}</ul>", f'<div role="navigation">{body}</div>'])

    def head() -> str:
        body = rng.choice([f"<h1>{words(1, 4)}</h1><p>{words(3, 8)}</p>", f"<a href='/'>{words(1, 3)}</a>", f"<div{pick('logo', 'tagline')}>{words(2, 6)}</div>"])
        return rng.choice([f"<header>{body}{rng.choice(['', menu()])}</header>", f"<div{pick('header', 'masthead', 'topbar')}>{body}</div>"])

    def advert() -> str:
        body = rng.choice([words(3, 60), f"<p>{words(3, 60)}</p>", f"<a href='x'>{words(3, 9)}</a>"])
        return rng.choice([f"<div{named('ad', 'ads', 'advert', 'banner', 'promo', 'sponsored')}>{body}</div>", f"<aside{named('ad', 'promo')}>{body}</aside>", f"<section{named('sponsor', 'advertisement')}>{body}</section>"])

    def notice() -> str:
        return f"<div{named('cookie', 'cookie-notice', 'consent', 'gdpr', 'alert', 'popup', 'notice')}><p>{words(5, 30)}</p><button>ok</button></div>"

    def side() -> str:
        body = rng.choice([f"<h3>{words(1, 4)}</h3><ul>{links(rng.randint(2, 8))}</ul>", f"<h2>{words(1, 4)}</h2><p>{words(5, 60)}</p>", f"<p>{words(5, 60)}</p>"])
        return rng.choice([f"<aside>{body}</aside>", f"<div{pick('sidebar', 'widget', 'related', 'popular', 'trending')}>{body}</div>", f"<section{pick('related', 'recommended')}>{body}</section>"])

    def comments() -> str:
        own, by = pick("comment", "reply"), pick("author", "user")
        name = lambda: rng.choice([f"<b>{words(1, 2)}</b>", f"<div{by}>{words(1, 2)}</div>"])
        one = rng.choice([lambda: f"<p>{words(3, 60)}</p>", lambda: f"<div{own}>{name()}<p>{words(3, 60)}</p></div>", lambda: f"<li><p>{words(3, 60)}</p></li>", lambda: f"<div{own}>{name()}{words(3, 60)}</div>"]) if not plain else lambda: f"<div{own}>{name()}<p>{words(3, 60)}</p></div>"
        body = rng.choice([f"<h3>{words(1, 3)}</h3>", f"<h2>{words(1, 3)}</h2>", ""]) + "".join(one() for _ in range(rng.randint(2 if plain else 1, 6)))
        return rng.choice([f"<section{pick('comments', 'replies', 'discussion')}>{body}</section>", f"<div{pick('comments', 'reader-comments', 'respond')}>{body}</div>"])

    def form() -> str:
        body = f"<label>{words(1, 3)}</label><input name='q'><p>{words(2, 20)}</p><button>go</button>"
        return rng.choice([f"<form>{body}</form>", f"<div{named('newsletter', 'subscribe', 'login')}><form>{body}</form></div>", f"<div{named('newsletter', 'signup')}><p>{words(4, 20)}</p></div>"])

    def share() -> str:
        return f"<div{named('share', 'social', 'follow')}>{''.join(f'<a href=x>{words(1, 2)}</a> ' for _ in range(4))}</div>"

    def foot() -> str:
        body = rng.choice([f"&copy; {words(1, 3)} &middot; {words(2, 40)}", f"<p>{words(2, 40)}</p><ul>{links(4)}</ul>", f"<p>&copy; {words(2, 8)}</p>"])
        return rng.choice([f"<footer>{body}</footer>", f"<div{pick('footer', 'copyright', 'legal')}>{body}</div>"])

    blocks: list[str] = []

    def block(tag: str, a: int, b: int) -> str:
        text = words(a, b)
        blocks.append(text)
        shown = rng.choice([text, text, text, f"<b>{text}<br>", f"<em>{text}</em>"])
        return f"<{tag}>{shown}" + ("" if tag == "p" and rng.random() < 0.15 else f"</{tag}>")

    parts = [block(rng.choice(["h1", "h1", "h2"]), 2, 10)] if rng.random() < 0.85 else []
    long = rng.choice([3, 12, 60, 160])
    for _ in range(rng.choice([1, 1, 2, 4, 8, 16])):
        kind = rng.random()
        if kind < 0.75:
            parts.append(block("p", 1, long))
        elif kind < 0.82:
            parts.append(block(rng.choice(["h2", "h3"]), 1, 8))
        elif kind < 0.9:
            parts.append(f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(block("li", 1, 20) for _ in range(rng.randint(1, 5))) + f"</{t}>")
        elif kind < 0.94:
            parts.append(rng.choice(["<blockquote>", "<blockquote class=quote>"]) + block("p", 3, long) + "</blockquote>")
        elif kind < 0.97:
            parts.append("<table><tr>" + "".join(block("td", 1, 4) for _ in range(3)) + "</tr></table>")
        else:
            parts.append(block("pre", 3, 20))
        if rng.random() < 0.06:
            parts.append(rng.choice([advert, share, form, side])())
    inner = "".join(parts)
    if rng.random() < 0.3:
        inner = f"<div{pick('entry', 'text', 'x', 'body')}>{inner}</div>"
    if rng.random() < 0.2:
        inner += rng.choice([comments, share, form])()
    if rng.random() < 0.08:  # set straight in the body, or in an element that is no block
        blocks.clear()
        runs = [[words(12, max(12, long)) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        blocks += [" ".join(r) for r in runs]
        inner = "<hr>".join(rng.choice(["<br>", "<br><br>\n"]).join(r) for r in runs)
        bare = rng.choice([inner, f"<span>{inner}</span>", f"<font size=2>{inner}</font>"])
        return f"<html><body>{rng.choice([menu, head, lambda: ''])()}{bare}{rng.choice([foot, lambda: '<hr>' + links(3), lambda: ''])()}</body></html>", [" ".join(b.split()) for b in blocks]
    article = rng.choice([f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<div{pick('article', 'content', 'post', 'entry', 'story')}>{inner}</div>", f"<main><article>{inner}</article></main>", f"<section{pick('content', 'article')}>{inner}</section>", f"<div>{inner}</div>"])
    some = lambda f, p: f() if rng.random() < p else ""
    before = [some(notice, 0.2), some(head, 0.4), some(menu, 0.8), some(advert, 0.5), some(side, 0.15)]
    after = [some(comments, 0.3), some(side, 0.3), some(form, 0.2), some(advert, 0.2), some(notice, 0.15), some(foot, 0.85)]
    if rng.random() < 0.3:
        article = f"<div{rng.choice([' class=wrapper', ' id=page', ' class=container', ''])}>{some(side, 0.3)}{article}{some(side, 0.3)}</div>"
    page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"
    return page, [" ".join(b.split()) for b in blocks]


def examples(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (whether the larger part of an element's text is the article's)."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        html, blocks = made_page(rng)
        page, wanted = parse(html), set(blocks)
        chosen, x = features(page)
        if not len(chosen):
            continue
        good, all_ = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        for at, text, _ in page.blocks:
            all_[at] += len(text)
            good[at] += len(text) * (text in wanted)
        for k in range(len(page.tag) - 1, 0, -1):
            good[page.parent[k]] += good[k]
            all_[page.parent[k]] += all_[k]
        xs.append(x)
        ys.append(good[chosen] > 0.5 * all_[chosen])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


@functools.lru_cache(maxsize=2)
def model(pages: int = 2000, seed: int = 5) -> Trees:
    return train(*examples(pages, seed), rounds=90, depth=5, rate=0.2, least=5, share=0.5)


def extract(html: str, trees: Trees) -> str:
    page = parse(html)
    chosen, x = features(page)
    return decode(page, chosen, trees.raw(x)) if len(chosen) else ""


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page (page_id, url, html)."""
    small_batches(pages.sparkSession)
    trees = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read, rows = [], []
            for html in b.html:
                page = parse(html)
                chosen, x = features(page)
                read.append((page, chosen))
                rows.append(x.reshape(len(chosen), -1) if len(chosen) else np.zeros((0, 1)))
            some = [x for x in rows if len(x)]
            score = trees.raw(np.concatenate(some)) if some else np.zeros(0)
            texts, at = [], 0
            for page, chosen in read:
                texts.append(decode(page, chosen, score[at : at + len(chosen)]) if len(chosen) else "")
                at += len(chosen)
            yield pd.DataFrame({"page_id": b.page_id.astype("Int64"), "url": b.url, "text": texts, "n_chars": np.array(list(map(len, texts)), np.int64)})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
