"""Main text of web pages: nearest-URL page differencing.

1. A page is cut into lines, one for each block. Character references are decoded,
   white space in a line becomes one space. Scripts, styles and the like are no text.
2. Pages of a host are sorted by URL path; a page's pair is the neighbour whose
   path agrees with its own for longer (the one before, if both do).
3. The page's lines are aligned with the pair's by longest common subsequence. A
   line is known by its text; but in a page that marks an article, a line outside of
   it in a named place (an element with a class, id or role, or one that is not just
   a container) is known by that place, as the words of menus, adverts and footers
   change from page to page while their place in the template does not. A page that
   marks none is aligned twice: first by text, which tells the lines that vary; from the
   root on, the section with more than half of what varies is entered, and the last such
   section stands for the article with the title before it (a varying ``h1`` is no frame). If no
   section has so much, all from the first to the last line that varies does.
4. Shared lines are deleted, and with a shared place all lines in it. Within an
   article a shared line is deleted if most pages of the host share it with theirs, and
   a heading only with the line that it heads.
5. What is left in menus, footers, forms, adverts and so on by the element's or
   class's name goes too. These names decide for lines that are not shared (a page
   alone on its host, a comment block that the pair lacks).

Guards, all from the alignment: lines of an article that only the pair has, or fewer
than half of the host's pages, are copies and quotations and stay; so do all lines of
an article half of which is shared; and if deleting leaves nothing, the lines stay.

Defined results: null html is an empty page with the empty text; null URLs are
of the empty host; pages alone on their host have no pair, and of such a page
that marks an article only the article stays; equal URLs are ordered by page id
and hash of the html; repeated rows are each returned; an empty table gives an empty
result; other columns are not read. Lines are aligned by their 128-bit hashes. The
alignment is exact at any length: over few equal lines by the longest increasing run
of their places, over many by rows of bits, halved until they fit ``ROW_BYTES``.
"""

from __future__ import annotations

import html
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import cut

#: Elements by what they mean for main text.
TEXTLESS = {"script", "style", "template", "iframe", "head", "textarea", "select", "button"}
FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks that may stand for an article: they hold others and are none themselves.
SECTION = {"article", "body", "center", "div", "html", "main", "section"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Blocks that only hold or lay out text and name no place of a template.
CONTAINER = {
    "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class, id or role that mark a frame, and those that may
#: stand beside them. A name marks a frame only if it has no other word.
FRAME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related",
    "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
BESIDE = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "foot", "form", "global", "head", "header", "inner",
    "item", "items", "left", "link", "links", "list", "main", "mobile", "outer", "page", "pane", "panel", "post", "posts", "primary", "right", "row", "secondary",
    "section", "site", "slot", "sticky", "stories", "text", "title", "top", "unit", "wrap", "wrapper", "zone",
}
#: Bytes of bit rows that an alignment holds at once.
ROW_BYTES = 32 << 20
TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(?P<text>[^<]+|<)",
    regex.DOTALL,
)
NAMED = regex.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", regex.IGNORECASE)
WORDS = regex.compile(r"[a-z]+")


def is_frame(name: str, given: list[str]) -> bool:
    """Whether an element is a frame by its own name or a whole name of its class, id or role."""
    if name in FRAME:
        return True
    for x in given:
        words = set(WORDS.findall(x))
        if words & FRAME_WORDS and words <= FRAME_WORDS | BESIDE:
            return True
    return False


class Line(NamedTuple):
    """A block with text: ``place`` is its named place or "", ``block`` its element,
    ``depth`` the sections around it, the first ``common`` of them also around the line before."""

    text: str
    main: bool
    frame: bool
    place: str
    block: str
    common: int
    depth: int


def lines(source: str) -> list[Line]:
    """Each block with text, in order."""
    out: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, str, bool]] = []  # open blocks: name, is main, is frame, place, is named
    at, n = 0, len(source)
    main = frame = depth = common = 0

    def flush() -> None:
        nonlocal common
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                name, _, _, place, named = stack[-1] if stack else ("", False, False, "", False)
                out.append(Line(text, main > 0, frame > 0, place if named else "", name, common, depth))
                common = depth

    def close(upto: int) -> None:
        nonlocal main, frame, depth, common
        while len(stack) > upto:
            name, m, f, _, _ = stack.pop()
            main -= m
            frame -= f
            depth -= name in SECTION
        common = min(common, depth)

    while at < n:
        found = TOKEN.match(source, at)
        at = found.end()
        if found["text"] is not None:
            held.append(found["text"])
            continue
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    close(k)
                    break
            continue
        if name in TEXTLESS and not found["rest"].rstrip().endswith("/"):
            # no block ends here: a script or button amid a paragraph leaves it whole
            end = regex.compile(rf"</{name}\b[^>]*>", regex.IGNORECASE).search(source, at)
            # an unclosed head ends where the body begins
            end = end or (regex.compile(r"(?=<body\b)", regex.IGNORECASE).search(source, at) if name == "head" else None)
            if end is None and name == "button":
                continue
            at = end.end() if end else n
            continue
        if name in BLOCK:
            flush()
            if name == "p" or name in BLOCK and stack and stack[-1][0] == "p":
                while stack and stack[-1][0] == "p":  # a block ends an open paragraph
                    close(len(stack) - 1)
        elif name == "br":
            held.append(" ")
        if name in VOID or found["rest"].endswith("/"):
            continue
        given = [x for a, b, c in NAMED.findall(found["rest"]) for x in (a or b or c).lower().split()] if "=" in found["rest"] else []
        f = is_frame(name, given) and not (name == "header" and main)
        if name in BLOCK or f:
            if f and name not in BLOCK:
                flush()
            up = stack[-1] if stack else ("", False, False, "", False)
            stack.append((name, name in MAIN, f, f"{up[3]}/{'.'.join([name, *given])}", up[4] or bool(given) or name not in CONTAINER))
            main += name in MAIN
            frame += f
            depth += name in SECTION
    flush()
    return out


def rising(a: Sequence, where: dict) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence: the longest increasing run over the places of equal lines."""
    ends: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            node = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            else:
                ends[k], links[k] = j, node
    out, node = [], links[-1] if links else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def bit_rows(a: Sequence, b: Sequence) -> Iterator[int]:
    """After each line of ``a``, a row of bits over ``b``: a 0 where the longest common
    subsequence with the lines of ``b`` up to there is longer than without the last."""
    every = (1 << len(b)) - 1
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    masks: dict = {}
    row = every
    for x in a:
        at = where.get(x)
        if at:
            mask = masks.get(x)
            if mask is None:
                bits = bytearray(len(b) // 8 + 1)
                for j in at:
                    bits[j >> 3] |= 1 << (j & 7)
                mask = int.from_bytes(bits, "little")
                if len(at) > 8:
                    masks[x] = mask
            taken = row & mask
            row = ((row + taken) | (row - taken)) & every
        yield row


def aligned(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs (place in ``a``, place in ``b``) of a longest common subsequence."""
    n = min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - head) if a[-1 - k] != b[-1 - k]), n - head)
    ends = [(k, k) for k in range(head)], [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    # only lines that both have can be shared
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    ia = [k for k in range(head, len(a) - tail) if a[k] in both]
    ib = [k for k in range(head, len(b) - tail) if b[k] in both]
    a, b = [a[k] for k in ia], [b[k] for k in ib]
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    if sum(len(where[x]) for x in a) <= 16 * (len(a) + len(b)):
        inner = rising(a, where)
    else:
        inner = []
        waiting = [(0, len(a), 0, len(b))]
        while waiting:
            a0, a1, b0, b1 = waiting.pop()
            x, y = a[a0:a1], b[b0:b1]
            if len(x) > 1 and len(x) * (len(y) // 8 + 32) > ROW_BYTES:
                # cut a in two, and b where the lengths of both sides add up to most
                mid = len(x) // 2
                first, second = (np.append(0, np.cumsum(1 - bits_of(r, len(y)))) for r in (last_row(x[:mid], y), last_row(x[:mid - 1:-1], y[::-1])))
                at = int((first + second[::-1]).argmax())
                waiting += [(a0, a0 + mid, b0, b0 + at), (a0 + mid, a1, b0 + at, b1)]
                continue
            rows = [(1 << len(y)) - 1, *bit_rows(x, y)]
            i, j = len(x), len(y)
            while i and j:
                if rows[i] >> (j - 1) & 1:
                    # down to the next 0 of this row
                    free = ~rows[i] & (1 << j) - 1
                    j = free.bit_length()
                elif not rows[i - 1] >> (j - 1) & 1:
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    inner.append((a0 + i, b0 + j))
        inner.sort()
    return [*ends[0], *((ia[i], ib[j]) for i, j in inner), *ends[1]]


def last_row(a: Sequence, b: Sequence) -> int:
    row = (1 << len(b)) - 1
    for row in bit_rows(a, b):  # noqa: B007
        pass
    return row


def bits_of(row: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64)


def shared(a: Sequence, b: Sequence) -> set[int]:
    """The places in ``a`` of a longest common subsequence with ``b``."""
    return {i for i, _ in aligned(a, b)}


def common_length(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


#: A line's mark: 16 bytes of hash, and what it is known by.
MARK, TEXT, PLACE, INSIDE, HEADING = 17, b"\0", b"\1", b"\2", b"\3"
#: A line of a page that marks no article, whose marks wait for the pair: the hashes of
#: text and place (zero: none), its code points, ``common``, ``depth``, and 1 for a heading, 2 for an ``h1``.
OPEN = np.dtype([("text", "V16"), ("place", "V16"), ("chars", "<i4"), ("common", "<i4"), ("depth", "<i4"), ("heading", "u1")])
MARKED, UNMARKED = b"m", b"u"


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def marks(source: str) -> bytes:
    """Whether a page marks an article, and the marks of its lines, end to end."""
    found = lines(source)
    if any(x.main for x in found):
        inside = lambda x: digest(x.text) + (HEADING if x.block in HEADINGS else INSIDE)
        return MARKED + b"".join(inside(x) if x.main else digest(x.place) + PLACE if x.place else digest(x.text) + TEXT for x in found)
    rows = [
        (digest(x.text), digest(x.place) if x.place else bytes(16), len(x.text), x.common, x.depth, (x.block in HEADINGS) + (x.block == "h1"))
        for x in found
    ]
    return UNMARKED + np.array(rows, OPEN).tobytes()


def varying_block(weights: np.ndarray, common: np.ndarray, depth: np.ndarray) -> tuple[int, int]:
    """The lines (from, to) of the last section that has more than half of the weight of the
    one around it, from the whole page on."""
    first, end, level = 0, len(weights), 0
    while first < end:
        # sections around all of the lines are entered at once
        level = max(level, min(int(depth[first:end].min()), int(common[first + 1 : end].min(initial=1 << 30))))
        inner = depth[first:end] > level
        starts = np.flatnonzero(inner & (np.append(True, (common[first + 1 : end] <= level) | ~inner[:-1])))
        if not len(starts):
            break
        own = np.where(inner, weights[first:end], 0)
        sums = np.add.reduceat(own, starts)
        k = int(sums.argmax())
        if 2 * sums[k] <= weights[first:end].sum():
            break
        upto = starts[k + 1] if k + 1 < len(starts) else end - first
        stop = np.flatnonzero(~inner[starts[k] : upto])
        first, end = first + int(starts[k]), first + int(starts[k] + stop[0] if len(stop) else upto)
        level += 1
    return first, end


def known(own: bytes, other: bytes) -> list[bytes]:
    """The marks of a page's lines; those of a page that marks no article by what varies from the pair."""
    if own[:1] == MARKED:
        return [own[k : k + MARK] for k in range(1, len(own), MARK)]
    a = np.frombuffer(own, OPEN, offset=1)
    text, place = ([x.tobytes() for x in a[c]] for c in ("text", "place"))
    if other[:1] == MARKED:
        marked = [other[k : k + MARK] for k in range(1, len(other), MARK)]
        theirs, places = [x[:16] for x in marked], {x[:16] for x in marked if x.endswith(PLACE)}
    else:
        theirs, places = [x.tobytes() for x in np.frombuffer(other, OPEN, offset=1)["text"]], set()
    same = np.zeros(len(a), bool)
    same[list(shared(text, theirs))] = True
    same |= np.array([x in places for x in place], bool)
    weights = np.where(same & ~same.all(), 0, a["chars"]).astype(np.int64)
    first, end = varying_block(weights, a["common"], a["depth"])
    if end - first == len(a) and not same.all():
        # no section stands out: what is shared before and after all that varies is none of it
        varied = np.flatnonzero(~same)
        first, end = int(varied[0]), int(varied[-1]) + 1
    none, heading = bytes(16), a["heading"].tolist()
    # back to the title, over headings and lines of no named place
    for k in range(first - 1, -1, -1):
        if heading[k] == 2 and not same[k]:
            first = k
        if not heading[k] and place[k] != none or first == k:
            break
    return [
        t + (HEADING if h else INSIDE) if first <= k < end else p + PLACE if p != none and (h < 2 or same[k]) else t + TEXT
        for k, (t, p, h) in enumerate(zip(text, place, heading, strict=True))
    ]


def deleted(own: bytes, path: str, before: bytes | None, before_path: str | None, after: bytes | None, after_path: str | None) -> tuple[list[int], list[tuple[int, bytes]]] | None:
    """The places of a page's lines to delete as shared with its pair, and of the
    article's shared lines (place, mark), for the host to decide; None without a pair."""
    if after is not None and (before is None or common_length(path, after_path) > common_length(path, before_path)):
        before = after
    if before is None:
        return None
    a, b = known(own, before), known(before, own)
    places = shared(a, b)
    template = {a[k] for k in places if a[k].endswith(PLACE)}
    within = [k for k, x in enumerate(a) if x.endswith((INSIDE, HEADING))]
    gone = {k for k in places if not a[k].endswith((INSIDE, HEADING))} | {k for k, x in enumerate(a) if x in template}
    asks: list[tuple[int, bytes]] = []
    if 2 * sum(k in places for k in within) < len(within):  # else a copy of the pair's article, in whole or for the most part
        headed = None  # the line under the headings, from the last on
        for k in reversed(within):
            if a[k].endswith(INSIDE):
                headed = k
            if k in places and (headed is None or headed in places):
                asks.append((k, a[k if headed is None else headed]))
    return sorted(gone), asks[::-1]


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partitions: int | None = None,
    names: bool = True, least_pages: int = 4,
) -> DataFrame:
    """Per row of ``pages``: the id, url, text and n_chars.

    The marks of all lines are sorted and paired; the pages themselves are read
    again at the end, beside the places of their deleted lines. ``names=False``
    leaves out step 5; a host of fewer than ``least_pages`` pages decides nothing
    about lines of articles.
    """
    spark = pages.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_text"))
    p = p.withColumn("_h", F.xxhash64("_text", "_url"))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("_url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", ""), r"[?#].*$", "")
    host, path = F.lower(F.regexp_extract(bare, r"^//([^/]*)", 1)), F.regexp_replace(bare, r"^//[^/]*|(\.html?|/)$", "")
    field = T.StructField
    key = [p.schema["_id"], field("_h", T.LongType()), field("_host", T.StringType())]
    whole = T.StructType([*key, field("_path", T.StringType()), field("_lines", T.BinaryType())])
    whole_names = whole.names

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([marks(x.as_py()) for x in b.column(4)], pa.binary())], whole_names)

    order = ("_host", "_path", F.col("_id").asc_nulls_first(), "_h")
    own = cut(p.select("_id", "_h", host.alias("_host"), path.alias("_path"), "_text").mapInArrow(cut_up, whole))
    dealt = own.repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    asks = T.ArrayType(T.StructType([field("place", T.IntegerType()), field("mark", T.BinaryType())]))
    result = [field("_paired", T.BooleanType()), field("_gone", T.ArrayType(T.IntegerType())), field("_asks", asks)]
    result_kinds = [pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.struct([("place", pa.int32()), ("mark", pa.binary())]))]
    sides = [field("_before", T.BinaryType()), field("_before_path", T.StringType()), field("_after", T.BinaryType()), field("_after_path", T.StringType())]
    pairing = T.StructType([*whole.fields, field("_part", T.IntegerType()), field("_edge", T.IntegerType()), *sides, *result])
    pairing_names = pairing.names

    def outcome(*x) -> list:
        found = deleted(*x)
        return [False, [], []] if found is None else [True, found[0], [{"place": k, "mark": m} for k, m in found[1]]]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each page's shared places, found with its neighbours within the task;
        ``_edge`` counts what a row lacks: 1 the one before, 2 the one after. Only
        such rows keep their lines and neighbours."""
        part, last, last_lines = TaskContext.get().partitionId(), None, None
        rows: list[list] = []
        kinds: list[pa.DataType] = []

        def done(row: list) -> None:
            if not row[6]:
                row[11:] = outcome(row[4], row[3], *row[7:11])
                row[4] = row[7] = row[8] = row[9] = row[10] = None
            rows.append(row)

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], pairing_names)
            rows.clear()
            return out

        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.string(), *result_kinds]
            for name, h, host, path, own_lines in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = [name, h, host, path, own_lines, part, 0, None, None, None, None, None, None, None]
                if last is None:
                    row[6] = 1
                else:
                    if last[2] == host:
                        row[7], row[8] = last_lines, last[3]
                        last[9], last[10] = own_lines, path
                    done(last)
                    if len(rows) >= 500:
                        yield batch()
                last, last_lines = row, own_lines
        if last is not None:
            last[6] += 2
            done(last)
            yield batch()

    found = cut(dealt.mapInArrow(neighbours, pairing))

    # a task's first and last page lack a neighbour, which is the last of the task before and the
    # first of the one after: which tasks those are is told by two numbers and a host of each task
    ends = found.filter("_edge > 0")
    hosts = {(r["_part"], side): r["_host"] for r in ends.select("_part", "_edge", "_host").collect() for side in (1, 2) if r["_edge"] & side}
    parts = sorted({k for k, _ in hosts})
    near = [x for a, b in zip(parts, parts[1:], strict=False) if hosts[a, 2] == hosts[b, 1] for x in ((b, 1, a, 2), (a, 2, b, 1))]
    near_table = spark.createDataFrame(near, "_to int, _side int, _from int, _from_side int")
    given = ends.select(F.col("_part").alias("_from"), F.col("_edge").alias("_has"), "_path", "_lines").join(near_table, "_from").filter("_has & _from_side > 0")
    for side, lines_col, path_col in ((1, "_before", "_before_path"), (2, "_after", "_after_path")):
        other = given.filter(F.col("_side") == side).select(F.col("_to").alias("_part"), F.lit(side).alias("_side"), F.col("_lines").alias("_x"), F.col("_path").alias("_y"))
        ends = ends.withColumn("_side", F.col("_edge").bitwiseAND(F.lit(side))).join(other, ["_part", "_side"], "left")
        ends = ends.withColumns({lines_col: F.coalesce(lines_col, "_x"), path_col: F.coalesce(path_col, "_y")}).drop("_x", "_y", "_side")

    gone_schema = T.StructType([*key, *result])
    gone_names = gone_schema.names

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [outcome(*x) for x in zip(*(c.to_pylist() for c in b.columns[3:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(result_kinds))], gone_names)

    ends = ends.select("_id", "_h", "_host", "_lines", "_path", *(f.name for f in sides)).mapInArrow(difference, gone_schema)
    gone = cut(found.filter("_edge = 0").select(*gone_names).unionByName(ends).withColumn("_row", F.monotonically_increasing_id()))

    # lines of articles that most pages of a host share with their pairs
    per_host = gone.groupBy("_host").agg(F.count("*").alias("_pages")).filter(F.col("_pages") >= least_pages)
    on = gone.select("_host", F.explode(F.array_distinct("_asks.mark")).alias("_mark")).groupBy("_host", "_mark").agg(F.count("*").alias("_on"))
    most = on.join(per_host, "_host").filter("2 * _on > _pages").select("_host", "_mark")
    asked = gone.filter("size(_asks) > 0").select("_row", "_host", F.explode("_asks").alias("_a")).select("_row", "_host", F.col("_a.mark").alias("_mark"), F.col("_a.place").alias("_place"))
    more = asked.join(most, ["_host", "_mark"]).groupBy("_row").agg(F.collect_list("_place").alias("_more"))
    gone = gone.filter("_paired").join(more, "_row", "left").withColumn("_gone", F.concat("_gone", F.coalesce("_more", F.array().cast("array<int>"))))

    # repeated rows have one pairing: that which deletes from the first place on
    gone = gone.groupBy("_id", "_h").agg(F.coalesce(F.min(F.when(F.size("_gone") > 0, F.col("_gone"))), F.min("_gone")).alias("_gone"))
    gone = gone.withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    joined = p.join(gone, p["_id"].eqNullSafe(gone["_id2"]) & (p["_h"] == gone["_h2"]), "left").select("_id", "_url", "_text", "_gone")
    schema = T.StructType([T.StructField(id_col, p.schema["_id"].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out_names = schema.names

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, gone in zip(b.column(2), b.column(3), strict=True):
                whole = [(x.text, x.main, x.frame and names) for x in lines(source.as_py())]
                places = gone.as_py()
                if places is None:  # no pair: nothing is shared, and a marked article is all there is to go by
                    kept = [t for t, m, f in whole if m and not f]
                else:
                    lost = set(places)
                    kept = [t for k, (t, _, f) in enumerate(whole) if not f and k not in lost]
                kept = kept or [t for t, _, f in whole if not f]
                texts.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], out_names)

    return joined.mapInArrow(keep, schema)
