"""HTML extraction: the best-scoring run of page tokens, words positive and tags negative.

A page is cut into tags and words. Labelled pages, those that mark their own main part with an article or main
element, give weights: the log odds of standing inside that part, for words by the block they stand in, for tags by
their name and for the words of class, id and role. Menus, footers, forms and elements whose class words weigh against
them are ruled out and score below zero: those of words that labelled pages have outside, and of a fixed list, as
articles hold adverts and comments too, which their marks can't teach. Inside an article the list rules out plain names only.
A linear scan finds the contiguous run of greatest sum, in each part that a page marks or, where far more scores
outside of those (a teaser is marked, the text is not), in the page; what is ruled out is cut from it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import small_batches

#: Pages that weights are learned from, at most.
SAMPLE = 2000
#: How many times the score of the marked parts what stands outside must reach for the page to be read as unmarked.
MARKED = 2.0
#: What a word weighs more in a part that the page marks.
IN_PART = 1.5

#: Elements whose content is never text, and elements that are never the article's own.
_RAW = frozenset("script style template noscript iframe svg canvas textarea select head title".split())
_ASIDE = frozenset("nav header footer aside form button dialog menu".split())
#: Words of class, id and role that mark menus, notices, adverts and reader comments, wherever they stand.
_SEED = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|popup|modal|sidebar|side|menu|navs?|navbar\w*|breadcrumbs?|footer|header|masthead|comments?|reply|replies|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|toolbar|widget|complementary|navigation|contentinfo")
#: Those that also name an article's own pieces: header, and compounds such as side-by-side or market-share.
_OWN = frozenset("header share side widget".split())
#: Words of a name that only say that it is a container, so that the other words tell what of.
_CONTAINER = frozenset("area articles bar block body bottom box button buttons col container content form group holder icon icons inner item items left link links list main outer panel posts primary right row secondary section slot stories top unit wrap wrapper".split())
#: Elements inside and outside that a class word starts with, and the log odds below which it rules its element out.
PRIOR, AGAINST = 5.0, -1.5
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr nobr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the start of another of the same kind closes.
_CLOSES = {"p": "p", "li": "li", "td": "td th", "th": "td th", "tr": "tr td th", "dt": "dt dd", "dd": "dt dd", "option": "option"}
_BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


_WORDS = re.compile("[a-z0-9]+")


def class_words(marks: str, inside: bool) -> list[str]:
    """The words of an element's class, id and role; inside an article without those that name pieces of its own.

    There the fixed list rules out only names that are made of its words and of containers, as comment-list is. In
    a name that says more, as social-security does, a word of the list stands with - behind it, and what was learned decides.
    """
    out = []
    for name in marks.split():
        words = list(_WORDS.finditer(name))
        plain = all(_SEED.fullmatch(m[0]) or m[0] in _CONTAINER or m[0].isdigit() for m in words)
        for m in words:
            joined = name[max(m.start() - 1, 0) : m.start()] + name[m.end() : m.end() + 1]
            if inside and m[0] in _OWN and (m[0] == "header" or "-" in joined or "_" in joined):
                continue
            out.append(m[0] if not inside or plain or not _SEED.fullmatch(m[0]) else f"{m[0]}-")
    return out


def against(word: str, weights: dict[str, float]) -> float:
    """The weight of a class word: far below zero for the fixed ones, else what was learned of it."""
    return -9.0 if _SEED.fullmatch(word) else weights.get(f"class:{word}", 0.0)


def class_odds(inside: int, outside: int) -> float:
    return log((inside + PRIOR) / (outside + PRIOR))


class Piece:
    """A tag or a stretch of text, the element it stands in and whether something around it rules it out."""

    __slots__ = ("kind", "block", "cut", "part", "text", "words", "classes")

    def __init__(self, kind: str, text: str | None, cut: bool, part: int, block: bool, classes: list[str] = ()):
        self.kind, self.text, self.cut, self.part, self.block, self.classes = kind, text, cut, part, block, classes
        self.words = len(text.split()) if text else 0


def pieces(page: str, weights: dict[str, float]) -> list[Piece]:
    """The tags and texts of a page in order, with raw elements left out; linear in the page."""
    out: list[Piece] = []
    stack: list[tuple[str, bool, str]] = []  # name, ruled out, kind of the words in it
    opened: dict[str, list[int]] = {}  # where in the stack elements of each name are
    blocks: list[int] = []  # where elements that aren't inline are
    inside = 0  # depth of article and main elements

    def close(depth: int) -> None:
        nonlocal inside
        for name, _, _ in stack[depth:]:
            inside -= name in ("article", "main")
            opened[name].pop()
        del stack[depth:]
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text[:2] in ("<!", "<?"):
                continue
            name, cut, kind = stack[-1] if stack else ("", False, "word:")
            out.append(Piece(kind, text, cut, inside, False))
            continue
        name = name.lower()
        block = name not in _INLINE and name not in _RAW
        if m[1]:
            if opened.get(name):
                k = opened[name][-1]
                cut, part = stack[k][1], inside
                close(k)
                out.append(Piece(f"/{name}", None, cut, min(part, inside), block))
            else:
                out.append(Piece(f"/{name}", None, bool(stack and stack[-1][1]), inside, block))
            continue
        if name in _RAW and name not in ("head", "title") and not m[0].endswith("/>"):  # on to its end tag
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
        closes = _CLOSES.get(name, "").split() or (["p"] if name in _BLOCK_ENDS_P else [])
        if closes and blocks and stack[blocks[-1]][0] in closes:
            close(blocks[-1])
        marks = " ".join(x.strip("\"'") for x in _NAMED.findall(m[3] or "")).lower()
        classes = class_words(marks, inside > 0) if marks and name not in ("body", "html", "article", "main") else []
        marked = any(against(w, weights) < AGAINST for w in classes)
        heading = name == "header" and inside  # an article's own header holds its heading
        cut = bool(stack and stack[-1][1]) or name in _RAW or (name in _ASIDE and not heading) or marked
        out.append(Piece(name, None, cut, inside, block, classes))
        if name not in _VOID and not (m[0].endswith("/>") and name in _RAW):
            inside += name in ("article", "main")
            where = stack[-1][2] if name in _INLINE and stack else f"word:{name}"
            opened.setdefault(name, []).append(len(stack))
            if name not in _INLINE:
                blocks.append(len(stack))
            stack.append((name, cut, where))
    return out


def counted(page: str | None) -> Counter:
    """How many tokens of each kind stand inside (True) and outside the part that a page marks as its main one.

    Class words count once for each element that has them. Other tokens count where nothing fixed rules them out, so
    that a list item is not held for a menu's because menus are lists.
    """
    out: Counter = Counter()
    for x in pieces(page or "", {}):
        for word in set(x.classes):
            out[(f"class:{word}", bool(x.part))] += 1
        if not x.cut and x.kind not in ("article", "main", "/article", "/main"):
            out[(x.kind, bool(x.part))] += max(x.words, 1)
    return out


def log_odds(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights of token kinds from how often each stands inside and outside: smoothed log odds."""
    all_in, all_out = (sum(x[k] for kind, x in counts.items() if not kind.startswith("class:")) + 1 for k in (0, 1))
    plain = {k: log((i + 0.5) / all_in) - log((o + 0.5) / all_out) for k, (i, o) in counts.items() if not k.startswith("class:")}
    return plain | {k: class_odds(i, o) for k, (i, o) in counts.items() if k.startswith("class:")}


def weight(x: Piece, weights: dict[str, float]) -> float:
    """Words score above zero and tags below, by what was learned of their kind, and more so in a part that the page marks.

    Words of kinds that stand outside on labelled pages, and words that are ruled out, score below zero. Kinds that no
    labelled page has weigh as a word of 1 and a tag of -0.5.
    """
    own = weights.get(x.kind, 0.0)
    if x.text is None:
        return -min(4.0, max(0.1, 0.5 - own * 0.5)) * (0.01 if x.part or x.cut else 1.0)
    return x.words * (-0.02 if x.cut else 1.0 + min(max(own, -3.0), 2.0) + IN_PART * bool(x.part))


def _best_run(found: list[Piece], weights: dict[str, float]) -> tuple[float, list[Piece]]:
    """The contiguous run of greatest sum, and that sum; 0 and none where nothing scores above zero."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(found):
        total += weight(x, weights)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, best_at = total, (start, k + 1)
    return best, found[slice(*best_at)]


def _runs(found: list[Piece], weights: dict[str, float]) -> list[list[Piece]]:
    """The best run of each marked part that scores above zero, or of the page where what stands outside scores MARKED times as much."""
    parts = [list(g) for inside, g in groupby(found, lambda x: bool(x.part)) if inside]
    best = [x for x in (_best_run(p, weights) for p in parts) if x[0] > 0 and any(y.words and not y.cut for y in x[1])]
    outside = _best_run([x for x in found if not x.part], weights)[0]
    if not best or outside > MARKED * sum(score for score, _ in best):
        return [_best_run(found, weights)[1]]
    return [run for _, run in best]


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: of the best runs, blocks in order with one space between; empty if there is none."""
    blocks = []
    for run in _runs(pieces(page or "", weights), weights):
        line: list[str] = []
        for x in run:
            if x.text is None and x.block:
                blocks.append("".join(line))
                line = []
            elif x.text is not None and not x.cut:
                line.append(html.unescape(x.text))
        blocks.append("".join(line))
    return " ".join(y for y in (" ".join(b.split()) for b in blocks) if y)


def extracted(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    Weights come from a bounded sample of pages that hold an article or main element, by a hash of page_id.
    A null or empty page, and one without words, has the empty text. Repeated rows give the same text each, an
    empty table gives no rows and other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    ids = marked.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found = counted(page)
                yield pa.record_batch({"kind": pa.array([k for k, _ in found], pa.string()), "inside": pa.array([i for _, i in found], pa.bool_()), "n": pa.array(found.values(), pa.int64())})

    kinds = marked.join(F.broadcast(ids.distinct()), "page_id").select("html").mapInArrow(count, "kind string, inside boolean, n long")
    # kinds are element names and class words, no more than the sampled pages hold
    rows = kinds.groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum("n").alias("n")).collect()
    weights = log_odds({r.kind: (r.i, r.n - r.i) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
