"""Main text of web pages by page differencing.

A page becomes text lines, one per block, each with the structural place it has. The pages
of a host, whatever their number, are ordered by URL path; pages whose lines are all equal
count as one, since a copy says nothing about what is template text. A page and its
neighbours in that order are aligned by the longest common subsequence of their lines, and
shared lines are deleted: a line outside any article if the neighbour with the longer
common start of the path has it, a line inside an article only if the neighbours on both
sides have it. Pages whose shared lines hold most of their text are copies of each other
with changes, and keep it. Menus, headers, footers, sidebars, adverts, forms,
comments and markup go by their elements and class names, shared or not, since on many
hosts such text changes from page to page; but no element goes for its class if it holds
the article.

Defined cases: a null html is an empty page with an empty text; cut-off or unbalanced
markup is read to the end; pages without a URL, or alone on their host, are not
compared; rows that repeat a page have its text each; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm import textbytes as tb
from tillroll.operators.positions import positions
from tillroll.operators.scratch import materialize

# Elements whose text is never main text.
_DROPPED = frozenset(
    "script style noscript template nav footer aside form button select textarea iframe svg title head".split()
)
# Elements that do not break a block.
_INLINE = frozenset(
    "a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup "
    "time tt u var wbr ins del img".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words of class, id or role that mark text around the article.
_AROUND = re.compile(
    r"(?i)(?:^|[\s_-])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|header|masthead|menu|nav\w*|"
    r"newsletter|notice|popup|promo\w*|related|share|sidebar|social|sponsor\w*|subscribe|widget)(?=$|[\s_-])"
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)")
# Elements that an opening tag of the key's kind closes.
_CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)

# The marks among these that say an article is not the page's own.
_COMMENT = frozenset("comment comments related".split())
#: Lines inside an article element go only if both neighbours share them.
ARTICLE, PLAIN = 1, 0
#: Pages without an article element are copies if the lines they share hold more than this
#: share of the text; articles are if theirs do.
COPY_PERCENT, ARTICLE_PERCENT = 80, 50


def _elements(page: str):
    """The page as a list of steps: text, (True, element) where one opens, (False, element)
    where it closes; and the elements, each with name, parent, marks and whether it holds
    an article."""
    steps: list = []
    elements: list[dict] = []
    stack: list[int] = []

    def close(down_to: int):
        while len(stack) > down_to:
            steps.append((False, stack.pop()))

    at = 0
    for m in _TAG.finditer(page):
        steps.append(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if elements[stack[k]]["name"] == name:
                    close(k)
                    break
            continue
        if name in _CLOSES_P and stack and elements[stack[-1]]["name"] in ("p", "b", "i", "em", "strong", "span"):
            for k in range(len(stack) - 1, -1, -1):
                if elements[stack[k]]["name"] == "p":
                    close(k)
                    break
                if elements[stack[k]]["name"] not in _INLINE:
                    break
        marks = [" ".join(filter(None, a)) for a in _ATTRIBUTE.findall(m.group(3))] if m.group(3) else []
        around = {w.lower() for x in marks for w in _AROUND.findall(x)}
        held = name in ("article", "main") and not around & _COMMENT
        elements.append({"name": name, "around": around, "article": held, "holds": held})
        if held:
            for k in stack:
                elements[k]["holds"] = True
        steps.append((True, len(elements) - 1))
        if name in _VOID or m.group(3).rstrip().endswith("/"):
            steps.append((False, len(elements) - 1))
        else:
            stack.append(len(elements) - 1)
    steps.append(page[at:])
    close(0)
    return steps, elements


def _drops(element: dict, inside: bool) -> bool:
    """Whether an element's text is not main text, whatever is in it."""
    name, around = element["name"], element["around"]
    if name in _DROPPED:
        return True
    if name == "header" and not inside:
        return not element["holds"]
    if inside:  # an article's own heading
        around = around - {"header", "masthead"}
    if name in ("article", "main"):
        return not element["article"]
    return bool(around) and name not in ("body", "html") and not element["holds"]


def lines_of(page: str) -> list[tuple[str, int]]:
    """The text lines of a page that structure does not rule out, each with its place."""
    steps, elements = _elements(_RAW.sub(" ", page))
    out: list[tuple[str, int]] = []
    text: list[str] = []
    drop = article = 0
    dropped: set[int] = set()

    def flush():
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((line, ARTICLE if article else PLAIN))

    for step in steps:
        if isinstance(step, str):
            if not drop:
                text.append(step)
            continue
        opens, k = step
        element = elements[k]
        if element["name"] not in _INLINE:
            flush()
        if opens:
            if _drops(element, article > 0):
                dropped.add(k)
                drop += 1
            article += element["article"]
        else:
            drop -= k in dropped
            article -= element["article"]
    flush()
    return out


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every start of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a.tolist():
        row[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return row


def common_places(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of a longest common subsequence, in memory linear in the lengths:
    the middle of ``a`` is split at the place of ``b`` that loses nothing, and so on."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, x, y = todo.pop()
        if hi == lo or x == y:
            continue
        if hi - lo == 1:
            if (b[x:y] == a[lo]).any():
                found.append(lo)
            continue
        middle = (lo + hi) // 2
        ahead = _last_row(a[lo:middle], b[x:y])
        behind = _last_row(a[middle:hi][::-1], b[x:y][::-1])[::-1]
        cut = x + int((ahead + behind).argmax())
        todo += [(lo, middle, x, cut), (middle, hi, cut, y)]
    return sorted(found)


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``."""
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    a, b = own[head : len(own) - tail], other[head : len(other) - tail]
    found = list(range(head)) + list(range(len(own) - tail, len(own)))
    common = set(a) & set(b)
    at = [k for k, x in enumerate(a) if x in common]
    a, b = np.array([a[k] for k in at], np.int64), np.array([x for x in b if x in common], np.int64)
    found += [head + at[k] for k in common_places(a, b)]
    return sorted(found)


def template_lines(
    own: list[int], kinds: list[int], near: list[int], far: list[int], copied: bool
) -> list[int]:
    """Places in ``own`` of the lines that its neighbours show to be template text.

    ``kinds`` has the length of each line, doubled, plus its structural place; ``near`` and
    ``far`` are the lines of the neighbours, the one with the nearer URL first, empty if
    there is none; ``copied`` tells whether other pages of the host have these very lines.
    """
    article = {k for k, kind in enumerate(kinds) if kind & 1 == ARTICLE}
    plain = set(range(len(own))) - article
    length = lambda of: sum(kinds[k] >> 1 for k in of)
    if article and copied:
        gone = set(plain)  # what copies share outside their article
    else:
        gone = plain & set(shared_lines(own, near))
        if not article and 100 * length(gone) > COPY_PERCENT * length(plain):
            gone = set()
    if article and near and far:
        sides = [article & set(shared_lines(own, other)) for other in (near, far)]
        if all(100 * length(side) <= ARTICLE_PERCENT * length(article) for side in sides):
            gone |= sides[0] & sides[1]
    return sorted(gone)


def _hashes(lines: list[str]) -> list[int]:
    if not lines:
        return []
    texts = tb.Texts(*tb.buffers(pa.array(lines)))
    return tb.Spans(texts, np.ones(256, bool)).hashes().view(np.int64).tolist()


def _outlines(batches):
    """Per page, the hashes of its lines and their lengths and places; pages without lines
    have no row."""
    for batch in batches:
        hashes, kinds = [], []
        for value in tb.column(batch, "html"):
            lines = lines_of(value.as_py() or "")
            hashes.append(_hashes([line for line, _ in lines]))
            kinds.append([2 * len(line) + place for line, place in lines])
        some = pa.array([bool(h) for h in hashes], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [
                tb.column(batch, "key"),
                tb.column(batch, "url"),
                pa.array(hashes, pa.list_(pa.int64())),
                pa.array(kinds, pa.list_(pa.int32())),
            ],
            ["key", "url", "outline", "kinds"],
        ).filter(some)


def _shared(batches):
    """Per outline, the places of its template lines; outlines with none have no row."""
    for batch in batches:
        column = lambda c: tb.column(batch, c).to_pylist()
        each = zip(*map(column, ("outline", "kinds", "near", "far", "copied")))
        found = [template_lines(own, kinds, near or [], far or [], copied) for own, kinds, near, far, copied in each]
        some = pa.array([bool(f) for f in found], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [tb.column(batch, "host"), tb.column(batch, "print"), pa.array(found, pa.list_(pa.int64()))],
            ["host", "print", "shared"],
        ).filter(some)


def _texts(batches):
    for batch in batches:
        texts = []
        for page, shared in zip(tb.column(batch, "html"), tb.column(batch, "shared").to_pylist()):
            gone = set(shared or ())
            lines = lines_of(page.as_py() or "")
            texts.append("\n".join(line for k, (line, _) in enumerate(lines) if k not in gone))
        yield pa.RecordBatch.from_arrays(
            [
                tb.column(batch, "page_id"),
                tb.column(batch, "url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


def _common_start(a: str, b: str) -> Column:
    """Length of the common start of two strings, however long, by halving."""
    step = lambda bit: F.pow(F.lit(2), bit).cast("int")
    return F.aggregate(
        F.sequence(F.lit(30), F.lit(0), F.lit(-1)),
        F.lit(0),
        lambda found, bit: F.when(
            F.substring(F.col(a), F.lit(1), found + step(bit)) == F.substring(F.col(b), F.lit(1), found + step(bit)),
            found + step(bit),
        ).otherwise(found),
    )


def _neighbours(outlines: DataFrame) -> DataFrame:
    """Each outline of a host with those before and after it in the order of paths, the one
    with the longer common start of the path as ``near``.

    Places come from range partitioning, so a host of any size is spread over tasks and every
    page meets its true neighbours; they meet by a join on the place.
    """
    placed = materialize(
        positions(outlines, ["host"], [F.col("path"), F.col("url"), F.col("print")], "outlines-ordered"), "placed"
    )
    beside = placed.select("host", "pos", "path", "outline")
    for side, step in (("before", 1), ("after", -1)):
        other = beside.select(
            "host",
            (F.col("pos") + step).alias("pos"),
            F.col("path").alias(f"{side}_path"),
            F.col("outline").alias(f"{side}_outline"),
        )
        placed = placed.join(other, ["host", "pos"], "left")
    later = F.col("before_path").isNull() | (
        F.col("after_path").isNotNull() & (_common_start("path", "after_path") > _common_start("path", "before_path"))
    )
    side = lambda one, two: F.when(later, F.col(f"{one}_outline")).otherwise(F.col(f"{two}_outline"))
    return placed.select(
        "host",
        "print",
        "outline",
        "kinds",
        "copied",
        side("after", "before").alias("near"),
        side("before", "after").alias("far"),
    )


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    keyed = pages.select("page_id", "url", "html").withColumn("key", F.xxhash64("page_id", "url", "html"))
    found = keyed.where("url is not null").mapInArrow(
        _outlines, "key long, url string, outline array<long>, kinds array<int>"
    )
    as_text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    found = materialize(
        found.select(
            "key",
            "url",
            F.lower(F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1)).alias("host"),
            F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1).alias("path"),
            F.sha2(F.concat_ws(";", as_text("outline"), as_text("kinds")), 256).alias("print"),
            "outline",
            "kinds",
        ),
        "outlines",
    )
    # Pages of equal lines are one, that of the first URL; combined before the shuffle.
    distinct = found.groupBy("host", "print").agg(
        F.min(F.struct("path", "url")).alias("first"),
        F.any_value("outline").alias("outline"),
        F.any_value("kinds").alias("kinds"),
        (F.count("*") > 1).alias("copied"),
    )
    shared = _neighbours(distinct.select("host", "print", "first.*", "outline", "kinds", "copied"))
    shared = materialize(shared.mapInArrow(_shared, "host string, print string, shared array<long>"), "shared")
    # Rows of equal pages have one key.
    some = found.select("key", "url", "host", "print").distinct().join(shared, ["host", "print"])
    return (
        keyed.join(some.select("key", "url", "shared"), ["key", "url"], "left")
        .select("page_id", "url", "html", "shared")
        .mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
    )
