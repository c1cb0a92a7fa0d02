"""Main text of web pages by differencing each with the nearest page of its host.

Pages are dealt out in ranges of host, URL path and id, so neighbours meet in one task and a
host of any size spreads over many.  A first pass finds the runs of equal pages at both edges of
each range; a range also gets the pages beyond its edges that its first and last run are
differenced with, so texts do not depend on the ranges.  Each page becomes text lines, and is
aligned by longest common subsequence with the different pages before and after it, of which the
nearest has the longer common path prefix.

* A line that the nearest page shares is the host's furniture and goes.
* The lines of an article or main element are judged together, because a paragraph that two
  articles share is still the text of each: they go if most of their characters are shared with
  both neighbours and the page has another such element that stays, as beside a subscription box in
  such an element.  So a page's only article stays, whatever its neighbours share with it.
* Lines in menus, headers, footers, sidebars, adverts, forms, notices or comments, by element,
  role or name, go in any case: such furniture often differs from page to page.  An article within
  a form, or within an element that only a name marks as furniture, stays if the page has no more
  article text elsewhere.

Elements end where HTML implies it: a paragraph at the next block, an item at the next item, the
head at the first element of the body.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, ensure_columns, read_table

#: HELD: an article within a form or an element that is furniture by its name.
OPEN, ARTICLE, CHROME, NAMED, HELD = range(5)
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table"
    " tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea object canvas video audio title".split())
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: What a start tag ends, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup"}, {"select"}),
} | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})) | dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"}))
ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot"}, {"table"}))
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
PARAGRAPH_SCOPE = frozenset("button caption table td th".split())
DROPPED = frozenset("nav footer aside menu dialog button select head search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar note".split())
#: A class or id names furniture if all its parts are words of the two lists, one of the first.
FURNITURE = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos banner banners sidebar"
    " sidebars comment comments replies respond disqus cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription"
    " signup login share sharing social related recommended breadcrumb breadcrumbs menu menus nav navbar navigation footer masthead popup"
    " modal overlay widget widgets pagination pager toolbar skiplink".split()
)
NEUTRAL = frozenset(
    "area articles bar block bottom box buttons container form global icons items left link links list main message page panel posts primary"
    " right secondary section sign site skip slot stories thread top unit up wrap wrapper".split()
)
COMMENT = frozenset("comment comments commentlist disqus respond".split())
#: A name with one of these tells whether comments are there, and holds none.
STATE = frozenset("allow allowed closed disabled enabled has no off on open with without".split())
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Bits that a direct alignment may hold; larger ones are halved first.
MOST_BITS = 1 << 27


def names_furniture(names: str, inside: int) -> bool:
    """Whether a class or id attribute has a name of furniture; 'header' is one outside articles only."""
    for name in names.split():
        parts = {x.lower() for x in PARTS.split(name) if x}
        own = parts & FURNITURE or (inside not in (ARTICLE, HELD) and "header" in parts)
        if own and parts <= FURNITURE | NEUTRAL | {"header"}:
            return True
    return False


def names_comments(names: str) -> bool:
    """Whether a class or id attribute names readers' comments."""
    for name in names.split():
        parts = {x.lower() for x in PARTS.split(name) if x}
        if parts & COMMENT and not parts & STATE:
            return True
    return False


def kind_of(tag: str, attributes: str, inside: int) -> int:
    """Kind of the lines of an element, from its own markup and the kind around it."""
    if inside == CHROME:
        return CHROME
    article = tag in ("article", "main")
    if tag in DROPPED or (tag == "header" and inside not in (ARTICLE, HELD)):
        return CHROME
    named = tag == "form"
    for name, value in ATTRIBUTE.findall(attributes) if attributes and tag not in ("html", "body") else ():
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return CHROME
        if name == "role" and value.lower() in ROLES and not article:
            return CHROME
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return CHROME
        if name == "itemtype" and value.rstrip("/").endswith("/Comment"):
            return CHROME
        if name in ("class", "id"):
            if names_comments(value):
                return CHROME
            named = named or (not article and names_furniture(value, inside))
    if article:
        return HELD if inside == HELD or (inside == NAMED and tag == "article") else ARTICLE
    return NAMED if named else inside


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """Text of each block in page order, with white space as single spaces, its kind, and the number
    of the outermost article or main element around it, 0 if there is none."""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    kind, at, region, regions = OPEN, 0, 0, 0

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                if stack and stack[-1][0] == "head":
                    close(len(stack) - 1)
                out.append((line, kind, region))
            text.clear()

    def close(i: int) -> None:
        """Ends the i-th open element and those within it."""
        nonlocal kind, region
        before = stack[i][1]
        left = region and not any(x in ("article", "main") for x, _ in stack[:i])
        if before != kind or left:
            if stack[i][0] != "head":
                flush()
            kind, region = before, 0 if left else region
        del stack[i:]

    def end_implied(tag: str) -> None:
        for ended, scope in ([({"p"}, PARAGRAPH_SCOPE)] if tag in PARAGRAPH_ENDS else []) + ([ENDS[tag]] if tag in ENDS else []):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    close(i)
                    break
                if stack[i][0] in scope:
                    break
        if tag not in HEAD and stack and stack[-1][0] == "head":
            close(len(stack) - 1)

    while True:
        m = MARKUP.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCKS:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        end_implied(tag)
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        stack.append((tag, kind))
        new = kind_of(tag, m[3], kind)
        if new != kind:
            flush()
            kind = new
        if tag in ("article", "main") and not region:
            flush()
            regions += 1
            region = regions
    flush()
    size = [sum(len(x) for x, k, _ in out if k == wanted) for wanted in (ARTICLE, HELD)]
    held = ARTICLE if size[1] > size[0] else NAMED
    return [(x, held if k == HELD else k, r) for x, k, r in out]


def row_after(a: list, masks: dict, width: int, keep: list[int] | None = None) -> int:
    """Bit vector of the last row of the alignment table; a 0 marks where the length grows."""
    full = (1 << width) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep is not None:
            keep.append(v)
    return v


def masks_of(b: list) -> dict:
    out: dict = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | (1 << j)
    return out


def growth(v: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(v.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little")[:width]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def aligned(a: list, b: list) -> set[int]:
    """Places in ``a`` that a longest common subsequence with ``b`` takes.

    Rows are bit vectors; what is too large for memory is cut in two at the middle of ``a``,
    where the lengths from both ends say how to cut ``b``.
    """
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            out.add(i)
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            out.add(j - 1)
            j, n = j - 1, n - 1
        if i >= j or k >= n:
            continue
        width = n - k
        if j - i > 1 and (j - i) * width > MOST_BITS:
            mid = (i + j) // 2
            head = growth(row_after(a[i:mid], masks_of(b[k:n]), width), width)
            tail = growth(row_after(a[mid:j][::-1], masks_of(b[k:n][::-1]), width), width)[::-1]
            cut = k + int(np.argmax(head + tail))
            todo += [(i, mid, k, cut), (mid, j, cut, n)]
            continue
        rows: list[int] = []
        row_after(a[i:j], masks_of(b[k:n]), width, rows)
        x, y = j - i - 1, width - 1
        while x >= 0 and y >= 0:
            if rows[x] >> y & 1:
                y -= 1
            elif x and not rows[x - 1] >> y & 1:
                x -= 1
            else:
                out.add(i + x)
                x, y = x - 1, y - 1
    return out


def shared_lines(own: list[str], other: list[str]) -> set[int]:
    """Places of the lines of ``own`` that the alignment with ``other`` shares."""
    there, here = set(other), set(own)
    mine = [i for i, x in enumerate(own) if x in there]
    found = aligned([own[i] for i in mine], [x for x in other if x in here])
    return {mine[i] for i in found}


def furniture_regions(lines: list[tuple[str, int, int]], shared: list[set[int]]) -> set[int]:
    """Article elements of whose characters both neighbours share more than half, if others stay."""
    size: dict[int, int] = {}
    common: list[dict[int, int]] = [{}, {}]
    for i, (x, k, region) in enumerate(lines):
        if k == ARTICLE:
            size[region] = size.get(region, 0) + len(x)
            for own, places in zip(common, shared, strict=False):
                own[region] = own.get(region, 0) + len(x) * (i in places)
    gone = {r for r, n in size.items() if len(shared) == 2 and all(2 * own[r] > n for own in common)}
    return gone if len(gone) < len(size) else set()


def main_text(lines: list[tuple[str, int, int]], near: list[list[tuple[str, int, int]]]) -> str:
    """The text that is left of a page by differencing with its neighbours, the nearest first."""
    own = [x for x, _, _ in lines]
    shared = [shared_lines(own, [x for x, _, _ in other]) for other in near]
    furniture = furniture_regions(lines, shared)
    gone = shared[0] if shared else set()
    keep = [x for i, (x, k, r) in enumerate(lines) if (k == ARTICLE and r not in furniture) or (k == OPEN and i not in gone)]
    return " ".join(keep)


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def run_texts(run: dict, before: dict | None, after: dict | None) -> Iterator[tuple]:
    """Rows of a run of pages with equal lines, each differenced with the runs around it, the nearer first."""
    near = [x for x in (before, after) if x and x["host"] == run["host"]]
    texts: dict[int, str] = {}
    for page_id, url, path in run["rows"]:
        best = max(range(len(near)), key=lambda i: common_prefix(near[i]["rows"][-1 if near[i] is before else 0][2], path), default=-1)
        if best not in texts:
            texts[best] = main_text(run["lines"], [x["lines"] for x in (near[best:] + near[:best] if near else [])])
        yield page_id, url, texts[best]


def line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each page's lines instead of the page."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            own = batch.slice(a, 256)
            pages = own.column(4).to_pylist()
            found = [xxhash.xxh3_128_hexdigest(repr(lines_of(page or "")).encode("utf-8", "surrogatepass")) for page in pages]
            yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(found, pa.string())], names=["host", "path", "k", "x", "lines"])


def edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first pages of the first two runs of a range, and the last pages of its last two."""
    first: list[dict] = []
    last: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if last and (last[-1]["host"], last[-1]["lines"]) == (row["host"], row["lines"]):
                last[-1] = row
                continue
            last = [*last[-1:], row]
            if len(first) < 2:
                first.append(row)
    if first:
        part = TaskContext.get().partitionId()
        rows = [{"part": part, "at": i, **row} for i, row in [*enumerate(first), *enumerate(last[::-1], 2)]]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64() if c in ("part", "at", "k", "x") else pa.string()) for c in rows[0]]))


def beyond(edges: list[tuple[list, list]], at: int, step: int) -> tuple | None:
    """The page next to range ``at`` that differs from the range's own run there, if of its host.

    ``edges`` has for each range the outermost two runs at its start and at its end.
    """
    own = edges[at][step > 0][0]
    at += step
    while 0 <= at < len(edges):
        runs = edges[at][step < 0]
        for run in runs:
            if run["host"] != own["host"]:
                return None
            if run["lines"] != own["lines"]:
                return run["host"], run["path"], run["k"], run["x"]
        at += step
    return None


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the pages of a range; pages from beyond its edges are only differenced with."""

    def runs():
        run = None
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for host, path, page_id, url, page, guest in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True):
                    lines = lines_of(page or "")
                    if run and run["host"] == host and run["lines"] == lines and run["guest"] == guest:
                        run["rows"].append((page_id, url, path))
                        continue
                    if run:
                        yield run
                    run = {"host": host, "lines": lines, "rows": [(page_id, url, path)], "guest": guest}
        if run:
            yield run
        yield None

    def done(rows_done: list) -> pa.RecordBatch:
        ids, urls, texts = zip(*rows_done, strict=True)
        return pa.RecordBatch.from_pydict(
            {"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        )

    before = run = None
    out: list[tuple] = []
    size = 0
    for after in runs():
        if run and not run["guest"]:
            for row in run_texts(run, before, after):
                out.append(row)
                size += len(row[2])
                if len(out) >= 2000 or size > 4 << 20:
                    yield done(out)
                    out, size = [], 0
        before, run = run, after
    if out:
        yield done(out)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null html is empty and gives an empty text; a null url belongs to the host ''; repeated
    rows give a row each, and copies side by side are differenced with the pages around them; further
    columns are ignored; an empty table gives no rows.
    """
    pages = ensure_columns(pages, page_id="long", url="string", html="string")
    url = F.coalesce("url", F.lit(""))
    place = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    keyed = pages.select(
        F.lower(F.regexp_extract(url, place, 1)).alias("host"), F.regexp_extract(url, place, 2).alias("path"),
        F.coalesce("page_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("html").alias("x"), "page_id", "url", "html",
    )
    spark = pages.sparkSession
    order = ["host", "path", "k", "x"]
    lines = keyed.select(*order, "html").mapInArrow(line_batches, "host string, path string, k long, x long, lines string")
    lines = Scratch(spark, "html").put(lines, "lines")
    ranges = lines.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    found = ranges.sortWithinPartitions(*order).mapInArrow(edge_batches, "part long, at long, host string, path string, k long, x long, lines string")
    parts: dict[int, dict[int, dict]] = {}
    for r in found.collect():  # at most four rows a range
        parts.setdefault(r["part"], {})[r["at"]] = r.asDict()
    edges = [tuple([runs[i] for i in both if i in runs] for both in ((0, 1), (2, 3))) for _, runs in sorted(parts.items())]
    guests = [(*page, part) for part in range(len(edges)) for step in (-1, 1) if (page := beyond(edges, part, step))]
    borders = spark.createDataFrame([([tuple(start[0][c] for c in order) for start, _ in edges[1:]],)], "borders array<struct<host:string,path:string,k:long,x:long>>")
    asked = spark.createDataFrame(guests, "host string, path string, k long, x long, part int").groupBy(*order).agg(F.collect_list("part").alias("asked"))
    own = F.size(F.filter("borders", lambda b: b <= F.struct(*order)))
    seats = F.concat(F.array(F.struct(own.alias("part"), F.lit(False).alias("guest"))), F.transform(F.coalesce("asked", F.array().cast("array<int>")), lambda p: F.struct(p.alias("part"), F.lit(True).alias("guest"))))
    seated = keyed.crossJoin(F.broadcast(borders)).join(F.broadcast(asked), order, "left").select("*", F.inline(seats))
    dealt = seated.repartitionById(max(1, len(edges)), "part").sortWithinPartitions(*order)
    return dealt.select("host", "path", "page_id", "url", "html", "guest").mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``, from the whole html; a null or empty page has the text
    '', repeated rows are rows each, and an empty table gives no rows."""
    return extract_text(read_table(spark, sf_dir, "pages"))
