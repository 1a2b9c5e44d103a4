"""Main-text extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score by the element and the class
names they stand in (positive unless these are known or learned to be
boilerplate), tags score negative.  One linear scan finds the contiguous run of
the largest sum; the text is that run's blocks, without the boilerplate elements
inside it.

Some elements are boilerplate by their name.  Others may be by a piece of a class,
id or role: one whose names say nothing else ("sidebar", "comment-list") is left
out unless nearly the whole page stands in it and no article beside it; one whose names say more ("social-news")
only if it holds less than half of the page's words and no article.

Weights are smoothed log odds, of elements and of pieces of names.  They are learned from
labelled pages (those with exactly one article element: words inside it that stand in no
boilerplate element are content), a bounded sample of SAMPLE pages, the smallest hashes of
page_id; fixed values stand behind them for what the sample lacks.  So a name that the fixed
values do not know is boilerplate where the sample shows it so.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

#: Pages that weights are learned from, at most.
SAMPLE = 2000
#: Weight of the fixed values, in words.
PRIOR = 20.0
#: Pieces of names that are learned, the most frequent, at most.
PIECES = 5000
#: Parts of the page's words from which on an element with a suspicious name is no boilerplate: its names say nothing else; they say more.
NEARLY, HALF = 0.9, 0.5

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PIECE = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

# Elements and names.
RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
BOILERPLATE = frozenset("nav header footer aside form button select option menu dialog head fieldset".split()) | RAW
CONTENT = frozenset("article main".split())
#: Elements that say nothing: what labelled pages have in them beside the article tells nothing of pages without one.
GENERIC = frozenset("page body html div section".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disqus "
    "dialog footer footnav form gdpr header login masthead menu menubar menus modal nav navbar navigation navs newsletter notice notices overlay pagination pager popup popups promo promos promoted "
    "promotion rail recommended related replies reply respond search share sharebar sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription "
    "teaser toolbar widget widgets alert alerts complementary contentinfo".split()
)


# Words before a name that make it say what the element has or lacks, and words that say nothing.
HAVING = frozenset("with has have no not without is show hide hides enable disable js".split())
PLAIN = frozenset("area bar block body bottom box center col container content desktop first group global holder inner item items label large last left list main mobile module outer panel "
                  "primary right row secondary section site small top wrap wrapper zone page the a my".split())  # fmt: skip


class Token:
    """Words (text set) or a tag; key is that of the element they stand in, or the tag;
    pieces: of the names of the nearest element that has any.

    brk: a block ends here; drop: inside a boilerplate element; held: that element
    stands in an element that holds content, so it is no reason to end there."""

    __slots__ = ("key", "pieces", "text", "brk", "drop", "held")

    def __init__(self, key: str, pieces: tuple[str, ...], text: str | None, brk: bool, drop: bool, held: bool = False):
        self.key, self.pieces, self.text, self.brk, self.drop, self.held = key, pieces, text, brk, drop, held


def names_of(attrs: str) -> list[list[str]]:
    """The names in class, id and role, in pieces."""
    found = (n for m in MARK.finditer(attrs) for n in (m[2] or m[3] or m[4] or "").split())
    return [p for n in found if (p := PIECE.findall(HUMP.sub(" ", n).lower()))]


def noisy(piece: str, weight: dict[str, float]) -> bool:
    return weight.get(f".{piece}", -1.0 if piece in NOISE else 1.0) <= -0.5


def suspicion(names: list[list[str]], weight: dict[str, float]) -> tuple[int, str]:
    """2 if some name says nothing but boilerplate, 1 if some says that and more, else 0; and the piece that does."""
    most, by = 0, ""
    for name in names:
        if name[0] in HAVING:
            continue
        bad = [p for p in name if noisy(p, weight)]
        if bad and (level := 2 if all(p in PLAIN or noisy(p, weight) for p in name) else 1) > most:
            most, by = level, bad[0]
    return most, by


class Element:
    """A suspicious element (level over 0) or an article: its first token and the one after its last; whether an article stands in it."""

    __slots__ = ("level", "begin", "end", "article")

    def __init__(self, level: int, begin: int):
        self.level, self.begin, self.end, self.article = level, begin, -1, False


def tokens(page: str, weight: dict[str, float]) -> list[Token]:
    """Words and tags in page order."""
    out, suspects, articles = _parse(page, weight)
    if suspects:
        words = [0, *accumulate(0 if t.drop else _n_words(t.text) for t in out)]
        for e in suspects:
            share = (words[e.end] - words[e.begin]) / max(1, words[-1])
            beside = any(words[c.end] > words[c.begin] and not e.begin <= c.begin < e.end for c in articles)
            if not e.article and (share < (NEARLY if e.level == 2 else HALF) or e.level == 2 and beside):
                for t in out[e.begin : e.end]:
                    t.drop = True
    content = False
    depth = 0
    for t in out:  # what is left out inside content
        if t.text is None and t.key in ("<article", "<main") and not t.drop:
            depth += 1
        content = depth > 0
        t.held = t.drop and content
        if t.text is None and t.key in ("</article", "</main") and not t.drop:
            depth = max(0, depth - 1)
    return out


def _parse(page: str, weight: dict[str, float]) -> tuple[list[Token], list[Element], list[Element]]:
    """Tokens; suspicious elements; articles and main parts that are not."""
    stack: list[tuple[str, str, tuple[str, ...], bool, Element | None]] = []  # name, key, pieces, boilerplate, suspect
    key, pieces, drop, at, raw = "page", (), False, 0, ""
    out: list[Token] = []
    suspects: list[Element] = []
    articles: list[Element] = []
    end = len(page)

    def leave(x: tuple) -> None:
        if x[4] is not None:
            x[4].end = len(out)

    while at < end:
        if raw:  # nothing but its own end tag ends it
            m = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            raw = ""
            if not m:
                break
            at = m.end()
            continue
        m = TOKEN.match(page, at)
        at = m.end()
        text = m[0]
        name = m[2] or m[5]
        if name is None:
            if text.startswith("<![CDATA["):
                text = text[9:].removesuffix("]]>")
            elif text[0] == "<" and len(text) > 1:
                continue
            # white space decides where words end; pieces of a word may come from several tokens
            out.append(Token(key, pieces, html.unescape(text), False, drop))
            continue
        name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        block = name not in INLINE and name != "br"
        if closing:
            inner = drop
            if any(x[0] == name for x in stack):
                while True:
                    x = stack.pop()
                    leave(x)
                    if x[0] == name:
                        break
                key, pieces, drop = (stack[-1][1], stack[-1][2], any(x[3] for x in stack)) if stack else ("page", (), False)
            out.append(Token(f"</{name}", pieces, None, block, drop or (inner and name in CONTENT)))
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                raw = name
            out.append(Token(f"<{name}", pieces, None, name == "title", True))
            continue
        out.append(Token(f"<{name}", pieces, " " if name == "br" else None, block, drop))
        if name in VOID or attrs.endswith("/"):
            continue
        in_content = any(x[0] in CONTENT for x in stack)
        bad = name in BOILERPLATE and not (name == "header" and in_content) or bool(attrs) and HIDDEN.search(attrs) is not None
        names = names_of(attrs) if attrs and not bad and name not in ("body", "html") else []
        level, by = suspicion(names, weight) if names else (0, "")
        if name in CONTENT:
            level = level if level == 2 else 0
        if not (block or bad or level or any(x[0] == name for x in stack)):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # their end tags may be left out
            kin = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            if stack and stack[-1][0] in kin:
                leave(stack.pop())
        elif block and stack and stack[-1][0] == "p":
            leave(stack.pop())
        drop = any(x[3] for x in stack)
        inherited = stack[-1][1] if stack else "page"
        suspect = None
        if level and not drop:
            suspect = Element(level, len(out) - 1)
            suspects.append(suspect)
        elif name in CONTENT and not drop:
            for x in stack:
                if x[4] is not None:
                    x[4].article = True
            suspect = Element(0, len(out) - 1)
            articles.append(suspect)
        own = name if bad else "hidden"
        key = own if bad else name if name in CONTENT else inherited if drop or inherited in CONTENT else name if name in GENERIC else inherited
        if own in RAW or bad and name not in BOILERPLATE:
            key = "hidden"
        pieces = tuple({p for n in names if n[0] not in HAVING for p in n}) or (stack[-1][2] if stack else ())
        stack.append((name, key, pieces, bad, suspect))
        drop = drop or bad
    for x in stack:
        leave(x)
    return out, suspects, articles


def _n_words(text: str | None) -> int:
    return len(text.split()) if text else 0


def count(page: str) -> Counter | None:
    """(key or .piece, content?): words of a labelled page; None for others."""
    if len(re.findall(r"<article\b", page, re.I)) != 1:
        return None
    out: Counter = Counter()
    for t in tokens(page, {}):
        if t.text is not None and t.text != " " and (n := _n_words(t.text)):
            content = t.key == "article" and not t.drop
            out[t.key, content] += n
            for p in t.pieces:
                out[f".{p}", content] += n
    return out


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Score of a word by key: smoothed log odds, at most 1 either way for one word."""
    out = {}
    for key in {k for k, _ in counts} | BOILERPLATE | CONTENT | GENERIC | {"hidden"}:
        piece = key.startswith(".")
        bad = key in BOILERPLATE or key == "hidden" or piece and key[1:] in NOISE
        inside, outside = (0, 0) if key in GENERIC else (counts.get((key, True), 0), counts.get((key, False), 0))
        # the fixed value is the odds of PRIOR words
        share = 0.02 if bad else 0.95 if key in CONTENT else 0.85
        p = (inside + PRIOR * share) / (inside + outside + PRIOR)
        odds = math.log(p / (1 - p))
        if bad and not piece:
            odds = min(odds, -0.5)
        out[key] = max(-1.0, min(1.0, odds))
    return out


#: Score of a tag; those that open or close a part of the page cost more.
TAG, PART = -0.2, -1.0
PARTS = frozenset("nav header footer aside form article main body head".split())


def scores(seq: list[Token], weight: dict[str, float]) -> list[float]:
    """What each token adds to the sum of a run.  An element left out inside content costs no more than its tags."""
    out = []
    for t in seq:
        n = 0 if t.text is None else _n_words(t.text)
        if n:
            s = weight.get(t.key, weight["div"])
            for p in t.pieces:
                s = min(s, weight.get(f".{p}", 1.0))
            out.append(0.0 if t.held else n * (min(s, -0.5) if t.drop else s))
        else:
            out.append(0.0 if t.text is not None else TAG if t.held or t.key.lstrip("</") not in PARTS else PART)
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """First and one past the last of the run of the largest sum, the first of equal ones; (0, 0) without a positive one."""
    best, best_a, best_b, run, a = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(values):
        run += s
        if run <= 0:
            run, a = 0.0, i + 1
        elif run > best:
            best, best_a, best_b = run, a, i + 1
    return best_a, best_b


def extract(page: str | None, weight: dict[str, float]) -> str:
    seq = tokens(page, weight) if page else []
    a, b = best_run(scores(seq, weight))
    blocks, part = [], []

    def close() -> None:
        if line := " ".join("".join(part).split()):
            blocks.append(line)
        part.clear()

    for t in seq[a:b]:
        if t.text is not None and not t.drop:
            part.append(t.text)
        if t.brk:
            close()
    close()
    return "\n".join(blocks)


def fit(pages: DataFrame) -> dict[str, float]:
    """Weights from a bounded sample of labelled pages; the counts have a row per kind of element."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for rows in batches:
            for page in rows.html:
                total.update(count(page) or {})
        if total:  # an empty frame has no string column
            yield pd.DataFrame({"key": [k for k, _ in total], "inside": [i for _, i in total], "n": list(total.values())})

    ids = pages.filter("page_id is not null and html is not null").select(F.col("page_id").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = pages.select("page_id", "html").join(F.broadcast(ids), F.col("page_id") == F.col("id"), "left_semi").select("html")
    counts = sample.mapInPandas(run, "key string, inside boolean, n long").groupBy("key", "inside").agg(F.sum("n").alias("n"))
    # kinds of elements are few; of pieces of names the most frequent are taken
    counts = counts.orderBy(F.col("key").startswith("."), F.desc("n"), "key", "inside").limit(PIECES).collect()
    return weights({(r["key"], r["inside"]): r["n"] for r in counts})


def extract_text(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    Blocks are joined by a newline; white space inside a block is one space;
    character references are decoded.  Null or empty html, and pages without
    content, give an empty text.  Null page_id and url stay null, repeated rows
    are extracted each time, other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            text = [extract(h if isinstance(h, str) else None, weight) for h in rows.html]
            yield pd.DataFrame({"page_id": rows.page_id.astype("Int64"), "url": rows.url, "text": text, "n_chars": [len(t) for t in text]})

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract_text(pages, fit(pages))


QUERIES = {"op7_html_extract": op7_html_extract}
