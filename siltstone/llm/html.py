"""HTML extraction by the maximum-scoring subsequence.

A page is read as one sequence of words and tags. Every word and tag has a weight, learned from
labelled pages as the log-odds of standing in the main text: a word by the kind of element it stands in
and by the names (classes and ids) of the elements around it, a tag by its own name. Words of prose come
out positive, tags, links and words of menus, notices and the like negative. One linear scan finds the
contiguous run of the greatest sum, the content region. Words inside elements that are never main text
(adverts, forms, comments, scripts, ...) or whose names outweigh their kind are left out of the text; where
such an element stands in main text or behind a paragraph of a plain element, or a page has no element of
main text at all, they don't weigh in the scan either, so that a long advert doesn't cut off what stands before or after it.

Text: character references are decoded, a block's white space becomes one space, blocks are
trimmed, empty ones dropped, and the rest joined by one line feed in page order.

Defined cases: null, empty and text-free pages give an empty text; unclosed elements and comments end
with the page, an unclosed quote with its tag; repeated rows give equal rows; other columns aren't carried along.
"""

from __future__ import annotations

import html as references
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.labelled_pages import Page, labelled_pages

#: A quote begins a value only behind an equals sign; elsewhere it is a character like any other.
_INSIDE = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|canvas|select)\b" + _INSIDE + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>" + _INSIDE + r")>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE_KINDS = frozenset("a".split())
#: Elements that are never main text, and the words in a class, id or role that mark such elements.
_KIND_OF_TAG = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "button": "form", "label": "form", "dialog": "notice", "head": "head", "title": "head", "a": "link", "article": "main", "main": "main"}
_KIND_WORDS = (
    ("comment", r"comments?|disqus|respond|replies|reply"),
    ("ad", r"ads?|advert(?:s|isement|ising)?|banner|sponsor(?:ed|s)?|promo(?:tion)?|adsense|adbox|adslot"),
    ("notice", r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|toast"),
    ("menu", r"nav(?:bar|igation)?|menu|breadcrumbs?|pagination|pager|tabs|toolbar|toc"),
    ("side", r"sidebar|side|aside|widgets?|related|recommend(?:ed|ations)?|share|sharing|social|tags|trending|popular"),
    ("footer", r"footer|copyright|colophon|legal"),
    ("header", r"(?:site|page|top|global)-?header|masthead|topbar|branding|header"),
    ("form", r"form|login|search"),
    ("main", r"article|content|main|post|entry|story|article-?body|post-?body|text"),
)
_KIND = [(kind, re.compile(rf"(?:^|[\s_-])(?:{words})(?=$|[\s_-])", re.I)) for kind, words in _KIND_WORDS]
#: Inside main text, and for ids of headings and sections, which are made from their titles, a word alone
#: says little: there only these tags are looked at, and a name must consist of known words throughout.
_CONTAINERS = frozenset("p li span div section aside ul ol dl table form footer header center fieldset dialog nav menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_NAME_KINDS = [(kind, re.compile(rf"(?:{words})", re.I)) for kind, words in _KIND_WORDS if kind not in ("main", "header")] + [("header", re.compile(r"(?:site|top|global)-?header|masthead|topbar|branding", re.I))]
_NAME_PARTS = frozenset("area bar block box button buttons container inner item items link links list outer section slot thread top bottom left right unit wrap wrapper".split())
#: Names that no title of a section is likely to have: they count as ids too.
_SURE_IDS = re.compile(r"comments|disqus|respond|sidebar|navbar|navigation|breadcrumbs?|pagination|toc|masthead|topbar|footer|ads|adsense|adbox|adslot", re.I)
#: Names that no title is likely to have either, where the element isn't a section.
_DIV_IDS = re.compile(r"advert(?:s|isement)?|banner|sponsor(?:ed)?|promo|newsletter|subscribe|paywall|popup|consent|sidebar|widget", re.I)
_OWN_HEADER = re.compile(r"(?<![\w-])(?:post|entry|article|story|content|section|main)[_-]+header(?![\w-])", re.I)
_ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_OUT = frozenset(("menu", "header", "footer", "side", "form", "notice", "ad", "comment", "head"))
_ROLES = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "alertdialog": "notice", "main": "main"}


def _named(name: str) -> str:
    """The kind that a whole class name says, all of whose words are known."""
    for kind, words in _NAME_KINDS:
        if words.fullmatch(name):
            return kind
    parts = [x for x in re.split(r"[_-]+", name.lower()) if x]
    found = [next((kind for kind, words in _NAME_KINDS if words.fullmatch(x)), "") for x in parts]
    if any(found) and all(k or x in _NAME_PARTS for k, x in zip(found, parts, strict=True)):
        return next(k for k in found if k)
    return ""


def _kind_inside(tag: str, classes: str, ids: str) -> str:
    """The kind by whole names, where a word alone doesn't decide."""
    if tag not in _CONTAINERS:
        return ""
    names = classes.split()
    if tag != "section":
        names += [x for x in ids.split() if _SURE_IDS.fullmatch(x) or _DIV_IDS.fullmatch(x) or re.search("[_-]", x)]
    return next((k for x in names if (k := _named(x))), "")


def _kind(tag: str, attrs: str, inside: bool = False) -> str:
    """The kind of element that a tag opens, or nothing in particular; ``inside``: in main text."""
    if attrs and tag not in ("body", "html"):
        marks = ids = ""
        for name, a, b, c in _ATTR.findall(attrs):
            value = a or b or c
            name = name.lower()
            if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)) or (name == "role" and _ROLES.get(value.lower()) in _OUT):
                return _ROLES.get(value.lower(), "notice") if name == "role" else "notice"
            if name == "class":
                marks += f" {value}"
            elif name == "id":
                ids += f" {value}"
        if inside or tag in _HEADINGS:
            return _kind_inside(tag, marks, ids) or _KIND_OF_TAG.get(tag, "")
        if tag == "section":
            ids = "".join(f" {x}" for x in ids.split() if _SURE_IDS.fullmatch(x) or re.search("[_-]", x) and _named(x))
        marks = _OWN_HEADER.sub(" ", marks + ids)
        if marks.strip():
            for kind, words in _KIND:
                if words.search(marks):
                    return "" if kind == "main" and tag in _KIND_OF_TAG and _KIND_OF_TAG[tag] != "main" else kind
    return _KIND_OF_TAG.get(tag, "")



def _words(value: str) -> list[str]:
    return [x for x in re.split(r"[^0-9a-z]+", value.lower()) if x]


def names_of(tag: str, attrs: str) -> list[str]:
    """Words of the class and id of a container."""
    return [x for name, a, b, c in _ATTR.findall(attrs) if name.lower() in ("class", "id") for x in _words(a or b or c)] if tag in _CONTAINERS else []


def tokens(page: str, names: dict[str, float] | None = None) -> Iterator[tuple[str, str, str, bool, int, float]]:
    """(what, kind it stands in, text, whether a block ends before it, level, names) of every tag and piece of text.

    ``what`` is "word", or the name of a tag. Kinds nest: inside an element that is never main text nothing
    else counts; inside main text a plain element stays main text. The level is 2 in main text, 1 behind a
    paragraph of a plain element, else 0. The last is the sum of the weights that ``names`` gives to the words of the
    names of the elements around it.
    """
    stack: list[tuple[str, str, int, float]] = []
    kind, fresh, level, named = "", True, 0, 0.0
    for m in _SCAN.finditer(page):
        text = m["text"]
        if text is not None:
            yield "word", kind, text, fresh, level, named
            fresh = False
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in _BLOCKS:
                fresh = True
            if m["close"]:
                if any(x[0] == tag for x in stack):
                    while stack.pop()[0] != tag:
                        pass
                    _, kind, level, named = stack[-1] if stack else ("", "", 0, 0.0)
                yield tag, kind, " " if tag == "br" else "", fresh, level, named
            else:
                if tag in _BLOCKS and any(x[0] == "p" for x in stack):  # a block ends an open paragraph
                    at = max(k for k, x in enumerate(stack) if x[0] == "p")
                    if not any(x[0] in _BLOCKS for x in stack[at + 1 :]):
                        del stack[at:]
                        _, kind, level, named = stack[-1] if stack else ("", "", 0, 0.0)
                yield tag, kind, " " if tag in ("br", "hr") else "", fresh, level, named
                attrs = m["attrs"]
                if tag not in _VOID and not attrs.endswith("/"):
                    own = _kind(tag, attrs, level == 2)
                    if kind in _OUT or not own or (own == "header" and kind == "main" and tag == "header"):
                        own = kind
                    elif own == "link" and kind == "main":
                        own = "main"
                    if tag == "p" and own == kind:
                        if not level and not kind and stack and stack[-1][0] not in ("body", "html"):
                            level = 1
                            stack[-1] = (stack[-1][0], kind, level, named)
                    elif tag in _BLOCKS or own != kind or tag in _INLINE_KINDS:
                        level = 2 if own == "main" else level
                        if names:
                            named += sum(names.get(x, 0.0) for x in names_of(tag, attrs))
                        stack.append((tag, own, level, named))
                        kind = own


class Weights:
    """Weights of words by kind, of tags, and of words in names."""

    def __init__(self, words: dict[str, float], tags: dict[str, float], names: dict[str, float]):
        self.words, self.tags, self.names = words, tags, names
        self.other = sum(tags.values()) / max(1, len(tags))  # of a tag that no labelled page has

    def score(self, what: str, kind: str, text: str, named: float) -> float:
        if what == "word":
            return (self.words.get(kind, 0.0) + named) * len(text.split())
        return self.tags.get(what, self.other)


def fit(pages: list[Page]) -> Weights:
    """Weights from labelled pages: smoothed log-odds of a token among all tokens of the main text and of the rest.

    Tags weigh at most -0.1, so that markup alone is never a gain. A name's weight says by how much it moves the
    odds of words of its kind; names that only stand on one page say nothing.
    """
    words, tags, names, on, total = Counter(), Counter(), Counter(), Counter(), [0, 0]
    for page in pages:
        whole, ends = "".join(markup for markup, _ in page), list(accumulate(len(markup) for markup, _ in page))
        found = [m for m in _SCAN.finditer(whole) if m["text"] is not None or m["tag"]]
        open_: list[tuple[str, list[str]]] = []
        of_page = set()
        for m, (what, kind, text, *_) in zip(found, tokens(whole), strict=True):
            main = int(page[bisect_right(ends, m.start())][1])
            n = len(text.split()) if what == "word" else 1
            total[main] += n
            if what == "word":
                words[kind, main] += n
                names.update(dict.fromkeys(((x, main) for _, xs in open_ for x in xs), n))
                continue
            tags[what, main] += n
            if m["close"]:
                while any(t == what for t, _ in open_) and open_.pop()[0] != what:
                    pass
            elif what not in _VOID:
                open_.append((what, names_of(what, m["attrs"])))
                of_page.update(open_[-1][1])
        on.update(of_page)
    odds = lambda count, key: math.log((count[key, 1] + 1.0) / (total[1] + 2.0)) - math.log((count[key, 0] + 1.0) / (total[0] + 2.0))
    by_kind = {kind: odds(words, kind) for kind, _ in words}
    by_tag = {tag: min(-0.1, odds(tags, tag)) for tag, _ in tags}
    by_name = {x: max(-2.0, min(2.0, 0.5 * odds(names, x))) for x, _ in names if on[x] > 1}
    return Weights(by_kind, by_tag, by_name)


@cache
def weights() -> Weights:
    return fit(labelled_pages())


def region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the greatest sum, the longest among equals; empty if none is positive."""
    best, at, run, begin = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        run += s
        if run <= 0:
            run, begin = 0.0, k + 1
        elif run >= best:
            best, at = run, (begin, k + 1)
    return at


def main_text(page: str) -> str:
    """The main text of a whole page."""
    if not page:
        return ""
    learned = weights()
    seen = list(tokens(page, learned.names))
    bare = all(x[4] < 2 for x in seen)
    scores = [0.0 if kind in _OUT and (bare or level) else learned.score(what, kind, text, named) for what, kind, text, _, level, named in seen]
    begin, end = region(scores)
    blocks: list[list[str]] = []
    for _, kind, text, fresh, _, named in seen[begin:end]:
        if fresh or not blocks:
            blocks.append([])
        if text and kind not in _OUT and learned.words.get("" if kind == "link" else kind, 0.0) + named >= 0:
            blocks[-1].append(text)
    lines = (" ".join(references.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
