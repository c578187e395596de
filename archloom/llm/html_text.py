"""Main text of HTML pages from flat blocks, kept or dropped by a decision tree.

A page is cut into flat text blocks at block-level tags. Each block is described by its words and
link density, those of the blocks before and after it, and the kind of container it lies in; a
decision tree learnt from the small labelled table below says which blocks are main text.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of

# Tags that never show text, that end a block, and that hold no main text.
SILENT = frozenset("script style noscript template head iframe object svg math canvas audio video map select textarea option button datalist title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Of the silent ones, those that run to their closing tag whatever lies between, and those that no block can lie in.
RAW, INLINE = frozenset("script style noscript template textarea title".split()), frozenset("select option button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu header dialog search".split())
INSIDE = frozenset("article main".split())
#: Of those outside, the ones that may stand around a whole page or be left open before its text.
AROUND = frozenset("nav aside form".split())
#: Words in class, id or role that mark a container outside the main text.
_OUTSIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|dialog|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|recommend\w*|related|replies|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widgets?|contentinfo|complementary)(?=$|[\s_-])",
    re.I,
)
#: A class of this kind says that a page has something, not that an element is it.
_ABOUT = re.compile(r"(?:^|\s)(?:has|no|not|with|without|is|hide|show)[-_]\S*", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))*+)(?:>|$)", re.S)
#: A whole attribute; as values are read along, nothing within them passes for a name.
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: The white space of HTML; other spaces, such as the no-break one, are text.
_SPACE = re.compile(r"[ \t\n\f\r]+")
# A closing tag ends these without tags of their own.
_CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

FEATURES = ("place", "words", "links", "words_before", "links_before", "words_after", "links_after", "heading")

#: Labelled blocks: place (-1 in a container outside the main text, 1 in an article or main, 0 in
#: neither), words, link density, the same two of the blocks before and after, whether it is a
#: heading; then 1 for main text.
LABELLED = (
    (-1, 1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (-1, 1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (-1, 3, 1.0, 2, 1.0, 8, 0.0, 0, 0),
    (-1, 8, 0.0, 1, 1.0, 9, 0.0, 0, 0), (-1, 25, 0.0, 1, 1.0, 9, 0.0, 0, 0), (-1, 60, 0.0, 80, 0.0, 40, 0.0, 0, 0),
    (-1, 40, 0.1, 60, 0.0, 30, 0.0, 0, 0), (-1, 12, 0.0, 90, 0.0, 0, 0.0, 0, 0), (-1, 4, 0.0, 30, 0.0, 50, 0.0, 1, 0),
    (-1, 150, 0.0, 200, 0.0, 90, 0.0, 0, 0), (-1, 20, 0.5, 100, 0.0, 5, 1.0, 0, 0), (-1, 2, 0.0, 0, 0.0, 3, 0.0, 0, 0),
    (-1, 60, 0.0, 60, 0.0, 0, 0.0, 0, 0), (-1, 100, 0.0, 10, 0.0, 4, 0.0, 0, 0), (-1, 45, 0.0, 0, 0.0, 6, 0.0, 0, 0),
    (-1, 3, 0.0, 0, 0.0, 90, 0.0, 0, 0), (-1, 10, 0.0, 3, 0.0, 120, 0.0, 1, 0), (-1, 35, 0.0, 3, 0.0, 60, 0.0, 0, 0),
    (-1, 300, 0.0, 200, 0.0, 250, 0.0, 0, 0), (-1, 180, 0.0, 5, 0.0, 0, 0.0, 0, 0), (-1, 130, 0.0, 130, 0.0, 3, 1.0, 0, 0),
    (-1, 75, 0.0, 90, 0.0, 15, 0.0, 0, 0), (-1, 22, 0.0, 60, 0.0, 2, 0.0, 0, 0), (-1, 90, 0.05, 2, 0.0, 1, 0.0, 0, 0),
    (-1, 55, 0.0, 6, 0.0, 100, 0.0, 0, 0), (-1, 15, 0.0, 150, 0.0, 75, 0.0, 0, 0), (-1, 250, 0.1, 40, 0.0, 8, 0.0, 0, 0),
    (1, 9, 0.0, 8, 0.0, 70, 0.0, 1, 1), (1, 120, 0.0, 9, 0.0, 80, 0.0, 0, 1), (1, 1, 0.0, 90, 0.0, 1, 0.0, 0, 1),
    (1, 1, 0.0, 1, 0.0, 30, 0.0, 0, 1), (1, 60, 0.1, 100, 0.0, 12, 0.0, 0, 1), (1, 12, 0.3, 60, 0.0, 40, 0.0, 0, 1),
    (1, 2, 0.0, 0, 0.0, 3, 0.0, 1, 1), (1, 200, 0.02, 150, 0.0, 90, 0.0, 0, 1), (1, 30, 0.0, 2, 1.0, 12, 0.0, 0, 1),
    (1, 4, 1.0, 40, 0.0, 40, 0.0, 0, 1), (1, 3, 0.0, 50, 0.0, 10, 0.0, 0, 1), (1, 7, 0.6, 30, 0.0, 60, 0.0, 0, 1),
    (1, 2, 0.0, 3, 0.0, 4, 0.0, 0, 1), (1, 10, 0.0, 12, 0.0, 5, 0.0, 0, 1), (1, 20, 0.0, 10, 0.0, 0, 0.0, 0, 1),
    (1, 5, 0.0, 20, 0.0, 8, 0.0, 0, 1), (1, 15, 0.0, 5, 0.0, 11, 0.0, 0, 1), (1, 3, 0.0, 30, 0.0, 1, 0.0, 0, 1),
    (1, 1, 0.0, 4, 0.0, 2, 0.0, 0, 1), (1, 8, 0.0, 2, 0.0, 9, 0.0, 0, 1), (1, 22, 0.0, 33, 0.0, 0, 0.0, 0, 1),
    (1, 9, 0.0, 2, 1.0, 30, 0.0, 1, 1), (1, 4, 0.0, 1, 1.0, 12, 0.0, 1, 1), (1, 12, 0.0, 3, 1.0, 5, 0.0, 0, 1),
    (1, 6, 0.0, 1, 1.0, 20, 0.0, 0, 1), (1, 8, 0.0, 20, 0.0, 2, 1.0, 0, 1), (1, 30, 0.0, 40, 0.0, 3, 1.0, 0, 1),
    (1, 3, 0.0, 9, 0.0, 1, 1.0, 0, 1), (1, 2, 0.0, 4, 1.0, 1, 0.0, 1, 1), (1, 15, 0.1, 2, 1.0, 1, 1.0, 0, 1),
    (1, 1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (1, 2, 1.0, 3, 1.0, 2, 1.0, 0, 0), (1, 3, 1.0, 2, 1.0, 4, 0.9, 0, 0),
    (1, 2, 1.0, 1, 1.0, 0, 0.0, 0, 0), (1, 1, 1.0, 2, 1.0, 3, 1.0, 0, 0), (1, 5, 1.0, 4, 1.0, 5, 1.0, 0, 0),
    (0, 1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (0, 3, 1.0, 0, 0.0, 2, 1.0, 0, 0), (0, 5, 0.9, 4, 0.8, 60, 0.0, 0, 0),
    (0, 12, 0.8, 20, 0.7, 10, 0.9, 0, 0), (0, 30, 0.7, 12, 0.9, 15, 0.8, 0, 0), (0, 6, 0.0, 2, 1.0, 3, 1.0, 0, 0),
    (0, 3, 0.0, 3, 0.0, 4, 0.0, 0, 0), (0, 8, 0.0, 3, 1.0, 2, 0.0, 0, 0), (0, 5, 0.5, 100, 0.0, 3, 1.0, 0, 0),
    (0, 4, 0.0, 2, 1.0, 6, 1.0, 1, 0), (0, 2, 0.0, 8, 1.0, 4, 1.0, 1, 0), (0, 7, 0.0, 1, 1.0, 0, 0.0, 0, 0),
    (0, 60, 0.0, 4, 0.0, 80, 0.0, 0, 1), (0, 90, 0.05, 60, 0.0, 100, 0.0, 0, 1), (0, 25, 0.0, 90, 0.0, 70, 0.0, 0, 1),
    (0, 40, 0.1, 3, 1.0, 30, 0.0, 0, 1), (0, 18, 0.0, 40, 0.0, 60, 0.0, 0, 1), (0, 6, 0.0, 50, 0.0, 70, 0.0, 0, 1),
    (0, 5, 0.0, 2, 1.0, 80, 0.0, 1, 1), (0, 8, 0.0, 0, 0.0, 60, 0.0, 1, 1), (0, 120, 0.2, 80, 0.1, 5, 1.0, 0, 1),
    (0, 35, 0.0, 5, 1.0, 4, 1.0, 0, 1), (0, 9, 0.0, 60, 0.0, 45, 0.0, 0, 1), (0, 3, 0.0, 70, 0.0, 55, 0.0, 1, 1),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, at most, above), or the share of main text."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            cost = sum(s.size * s.mean() * (1 - s.mean()) for s in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), low)
    if best is None:
        return share
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def trained() -> tuple | float:
    rows = np.array(LABELLED, dtype=float)
    return grow(rows[:, :-1], rows[:, -1])


def is_main(tree: tuple | float, features: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if features[f] <= t else high
    return tree >= 0.5


def _outside(name: str, attrs: str, within: bool, lenient: bool = False) -> bool | None:
    """Whether a container lies outside the main text; None for one to be left out altogether.

    Leniently, containers that are often left open or put around whole pages don't count, and a word of
    a class counts only as the head of its compound: `cookie-notice`, but not `newsletter-issue`.
    """
    outside = name in (OUTSIDE - AROUND if lenient else OUTSIDE) and not (within and name == "header")
    if attrs:
        seen = set()
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in seen:
                continue  # the first of a name counts
            seen.add(key)
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                return None
            if key in ("class", "id", "role") and name not in ("body", "html", "article", "main"):
                # The header of an article is part of it, by whatever name.
                value = _ABOUT.sub(" ", value)
                if any(not (within and m[1].lower() == "header") and not (lenient and value[m.end() : m.end() + 1].strip()) for m in _OUTSIDE_WORDS.finditer(value)):
                    outside = True
    return outside


_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})\b", re.I)


def _silent_end(page: str, name: str, m: re.Match, at: int) -> int:
    """Where the page goes on after a silent element; one left open ends at the next block."""
    if m[0].endswith("/>"):
        return at
    close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    if close and name not in INLINE:
        return close.end()
    if not close and name in RAW:
        return len(page)
    if not close and name in ("head", "svg", "math"):
        return at
    block = _BLOCK_TAG.search(page, at)
    ends = [x for x in (close and close.end(), block and block.start()) if x]
    return min(ends, default=len(page))


def blocks(page: str, lenient: bool = False) -> list[tuple[str, int, float, int, int]]:
    """Flat blocks in page order: text, words, link density, place, heading."""
    found, parts, linked = [], [], []
    stack: list[tuple[str, int, bool]] = []  # open elements that matter: name, place before, silent before
    place, silent, anchor, heading, at = 0, False, 0, 0, 0

    def end() -> None:
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip(" ")
            if text:
                n = len(text.split())
                n_linked = len(_SPACE.sub(" ", html_lib.unescape(" ".join(linked))).split()) if linked else 0
                found.append((text, n, min(1.0, n_linked / max(n, 1)), place, heading))
            parts.clear()
            linked.clear()

    def leave(k: int) -> None:
        nonlocal place, silent
        place, silent = stack[k][1:]
        del stack[k:]

    while True:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not silent:
            parts.append(piece)
            if anchor:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK and not silent:
                end()
                heading = 0
            if name == "a":
                anchor = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name in SILENT:
            at = _silent_end(page, name, m, at)
            if name in BLOCK:
                end()
            continue
        if name in BLOCK:
            if not silent:
                end()
            heading = int(name in ("h1", "h2", "h3", "h4", "h5", "h6"))
            while stack and name in _CLOSES.get(stack[-1][0], ()):
                leave(len(stack) - 1)
            anchor = 0 if name not in ("div", "p") else anchor
        elif name == "a":
            anchor = 1
        if name in BLOCK or m[3]:
            outside = _outside(name, m[3], place == 1, lenient)
            if outside is not False or name in INSIDE or name in _CLOSES or name in BLOCK:
                stack.append((name, place, silent))
                if outside is None:
                    end()
                    silent = True
                elif outside:
                    end()
                    place = -1
                elif name in INSIDE and (place >= 0 or name == "main"):
                    place = 1
    end()
    return found


def main_text(page: str | None, tree: tuple | float) -> str:
    """The main text of one page; empty for none.

    A page that has none is looked at again leniently: its text may lie in a form around all of it, after
    a menu left open, or in a container whose class only sounds like one outside.
    """
    page = page or ""
    return _kept(blocks(page), tree) or _kept(blocks(page, lenient=True), tree)


def _kept(found: list[tuple[str, int, float, int, int]], tree: tuple | float) -> str:
    """The blocks that the tree keeps, joined."""
    marked, plain = (sum(b[1] for b in found if b[3] == k and b[2] < 0.5) for k in (1, 0))
    # An article with less text than what lies beside it is a teaser.
    if marked and marked >= plain:
        found = [b if b[3] != 0 else (*b[:3], -1, b[4]) for b in found]  # a page that marks its article says what is not
    kept = []
    for k, (text, n, links, place, heading) in enumerate(found):
        before = found[k - 1] if k else ("", 0, 0.0)
        after = found[k + 1] if k + 1 < len(found) else ("", 0, 0.0)
        if is_main(tree, (place, n, links, before[1], before[2], after[1], after[2], heading)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns keep, text and n_chars (code points), one row per page.

    A null, empty or tagless blank page gives an empty text. Pages are read whole, whatever their
    length. Repeated rows are rows of their own; an empty table gives no rows; other columns of
    pages are not read.
    """
    tree = trained()
    rows = pages.select(*keep, text_of(html_col).alias("__html"))
    schema = pages.select(*keep).withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = [main_text(x, tree) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
