"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path. Per page, text length and punctuation are summed over the nodes of each
path and divided by their number; both ratios are smoothed along the page, fused, and held against a threshold taken
from their spread. The element around the nodes that pass is the article: its text is returned whole, with short
lines. Navigation, adverts, forms, comments and the like are told by tag, role and class, and left out beforehand.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnstile.llm.common import in_batches, slices, strings

#: Share of the standard deviation of the fused ratios that a node must reach.
SPREAD = 0.8

_TOKEN = re.compile(
    r"<!--(?:.*?(?:-->|\Z))"
    r"|<(script|style|noscript|template|textarea|svg|iframe|select)\b(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/><]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>"
    r"|<[/!?][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that an opening tag closes if they are open.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div main body html aside nav header footer form td th blockquote li dd".split())
_LEFT_OUT = frozenset("head title nav footer button dialog menu label fieldset object audio video canvas".split())
#: Left out unless next to nothing of a page's text is outside, as a form around the whole page.
_ASIDE = frozenset("aside form".split())
#: Least share of the text outside an element that is only marked, in its own, for it to be left out.
REST = 0.1
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup paywall "
    "sidebar side rail widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus replies respond share sharing social related "
    "recommended recommendations login search toolbar skip".split()
)
_HEADS = frozenset("header masthead topbar".split())
_OWN = frozenset("content main article post entry story text wrapper container layout page body with has no".split())
#: A class name with one of these says what a layout has around it.
_AROUND = frozenset("has with without no layout".split())
_PUNCTUATION = re.compile(r"[^\w\s]")
_SPACE = re.compile(r"\s+")


def _marked(name: str, inside: bool) -> bool:
    """Whether a class name or id marks what is beside an article: by its first or last word, or any if it has no word
    of the article's own."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    if not words or _AROUND & set(words):
        return False
    marks = _MARKS if inside else _MARKS | _HEADS
    if _OWN & set(words):
        return words[0] in _MARKS or (words[-1] in _MARKS and len(words) > 1)
    return bool(marks & set(words))


_NO, _SOFT, _HARD = range(3)


def _left_out(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element is no part of an article: for certain, by its marks, or not; `inside` is one already open."""
    if tag in _LEFT_OUT:
        return _HARD
    soft = tag in _ASIDE or (tag == "header" and not inside)
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower().strip()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _HARD
        if name == "role" and value in _ROLES:
            soft = True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            soft = soft or any(_marked(x, inside) for x in value.split())
    return _SOFT if soft else _NO


class _Page:
    """Text nodes of a page in order: path, ancestors (element numbers, root first), block, text."""

    def __init__(self, source: str):
        self.nodes: list[tuple[tuple[str, ...], tuple[int, ...], int, str]] = []
        self.tags: list[str] = []
        #: Elements that are only marked; what they hold decides.
        self.marked: set[int] = set()
        stack: list[tuple[str, int, bool]] = []
        block = at = 0
        for m in _TOKEN.finditer(source):
            self._text(source[at : m.start()], stack, block)
            at = m.end()
            tag = (m[3] or "").lower()
            if m[1]:
                continue
            if not tag:
                continue
            if tag in _BLOCK:
                block += 1
            if m[2]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if stack[i][0] in _SCOPE and tag not in _SCOPE:
                        break
                continue
            if tag in _VOID:
                continue
            if tag in _BLOCK:
                self._close(stack, ("p",) if tag not in _CLOSES else (*_CLOSES[tag], "p"))
            verdict = _left_out(tag, m[4], any(s[0] in ("article", "main") for s in stack))
            if verdict == _SOFT:
                self.marked.add(len(self.tags))
            stack.append((tag, len(self.tags), bool(stack and stack[-1][2]) or verdict == _HARD))
            self.tags.append(tag)
            if m[4].endswith("/") and tag not in _BLOCK:
                stack.pop()
        self._text(source[at:], stack, block)
        if self.marked:
            self._drop_marked()

    def _drop_marked(self) -> None:
        """Leaves out the text of marked elements, but for those outside of which there is next to nothing."""
        held: dict[int, int] = defaultdict(int)
        whole = 0
        for _, ancestors, _, text in self.nodes:
            size = len(_SPACE.sub(" ", text).strip())
            whole += size
            for e in ancestors:
                if e in self.marked:
                    held[e] += size
        gone = {e for e, size in held.items() if whole - size >= REST * size}
        self.nodes = [n for n in self.nodes if gone.isdisjoint(n[1])]

    @staticmethod
    def _close(stack: list[tuple[str, int, bool]], names: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
            elif stack[i][0] in _SCOPE:
                return

    def _text(self, raw: str, stack: list[tuple[str, int, bool]], block: int) -> None:
        if raw and not (stack and stack[-1][2]):
            text = html.unescape(raw)
            self.nodes.append((tuple(s[0] for s in stack), tuple(s[1] for s in stack), block, text))


def fused_ratios(nodes: list[tuple[tuple[str, ...], str]]) -> list[float]:
    """For each text node (path, text), the smoothed and fused ratios of its path."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in nodes:
        length[path] += len(text)
        marks[path] += len(_PUNCTUATION.findall(text))
        count[path] += 1
    smooth = lambda x: [(x[max(0, i - 1)] + 2 * x[i] + x[min(len(x) - 1, i + 1)]) / 4 for i in range(len(x))]
    by_text = smooth([length[p] / count[p] for p, _ in nodes])
    by_mark = smooth([marks[p] / count[p] for p, _ in nodes])
    return [math.sqrt(t * (1 + m)) for t, m in zip(by_text, by_mark, strict=True)]


def main_text(source: str) -> str:
    """Blocks of the article joined by line feeds; empty if a page has none."""
    page = _Page(source)
    full = [n for n in page.nodes if n[3].strip()]
    if not full:
        return ""
    fused = fused_ratios([(path, _SPACE.sub(" ", text).strip()) for path, _, _, text in full])
    mean = sum(fused) / len(fused)
    limit = SPREAD * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    chosen = [n[1] for n, f in zip(full, fused, strict=True) if f >= limit]
    common = chosen[0]
    for ancestors in chosen[1:]:
        same = next((i for i, (a, b) in enumerate(zip(common, ancestors)) if a != b), min(len(common), len(ancestors)))
        common = common[:same]
    articles = [i for i, e in enumerate(common) if page.tags[e] in ("article", "main")]
    if articles:
        common = common[: articles[-1] + 1]
    while common and page.tags[common[-1]] not in _SCOPE:
        common = common[:-1]
    blocks: dict[int, list[str]] = {}
    for _, ancestors, block, text in page.nodes:
        if ancestors[: len(common)] == common:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(h) for h in strings(batch.column(2)).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars.

    A null, empty or textless page has an empty text. Pages of any length are read whole; repeated rows give repeated
    results; ids and urls may be null; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return in_batches(rows, _extracted, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
