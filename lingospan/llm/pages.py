"""Main text of web pages by markup and by differencing against the page with the nearest URL.

Pages of one host that lie next to each other by URL path share their template. A page's text lines are aligned with
those of its nearest neighbour by longest common subsequence; a shared line is template and goes. Inside an ``article``
or ``main`` element one neighbour's word is not enough, as two articles may quote the same passage: there a line is
template where differencing finds it shared on at least half of the host's pages, and then goes from all of them.
Markup is the guard: where nearly all of such an element is template, the pages are copies and the element stays
whole; menus, forms, adverts, comments and the like are never main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Set
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingospan.llm.common import cut, fresh, split_by_keys

# Element names of HTML and words that sites use in class, id and role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset(
    "head script style noscript template nav menu aside footer form button select textarea option input label iframe "
    "object embed svg canvas dialog title".split()
)
MARKS = frozenset(
    "nav navbar navigation menu menus sidebar aside footer ad ads adv advert adverts advertisement advertising banner "
    "banners promo promoted sponsor sponsored cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager "
    "comment comments disqus respond reply replies popup modal overlay toolbar widget skip complementary "
    "contentinfo search".split()
)
OUTSIDE_MARKS = frozenset("header masthead topbar".split())
#: What a class such as ``site-nav`` may begin and end with; other words after the first say nothing.
PLACES = frozenset("site main primary secondary page post entry global top bottom left right mobile user".split())
PARTS = frozenset("nav navbar navigation menu footer sidebar breadcrumb breadcrumbs comments pagination".split())
#: Readers' comments, whose articles are not the page's, and what may follow these words (``comments-open`` is a state).
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
COMMENT_PARTS = frozenset("list area section thread threads wrapper body form box container respond item".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPLIT = re.compile(r"[-_]+")

#: What markup says of a line.
MAIN, OPEN, BOILERPLATE = 0, 1, 2
#: Where this part of the main lines, and of their letters, is template, the page is one of many copies.
COPY = 0.8
#: A line inside main text is template where this part of the host's pages, and this many, share it with a neighbour.
HOST_SHARE, HOST_PAGES = 0.5, 3
#: Hashes of template lines up to which they are broadcast (8 bytes each).
BROADCAST_HASHES = 1_000_000


class _State(NamedTuple):
    """Where a line stands: the element in which settled boilerplate began, marked elements around it, main text."""

    root: str = ""
    marked: tuple[int, ...] = ()
    main: bool = False


def _marks(token: str) -> tuple[bool, bool, bool]:
    """(boilerplate, boilerplate outside main text, readers' comments) of one word of a class or id."""
    first, *more = SPLIT.split(token)
    mark = first in MARKS or len(more) == 1 and first in PLACES and more[0] in PARTS
    comments = first in COMMENTS and (not more or more[0] in COMMENT_PARTS or more[0].isdigit()) or more == ["comments"] and mark
    return mark, first in OUTSIDE_MARKS, comments


def _says(name: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """(opens main text, is boilerplate, is marked) for an element; ``inside``: it stands in main text.

    Element names, roles, hiding and readers' comments settle that it is boilerplate. A mark is only a word of its
    class or id: it says nothing of an element that is, or holds, the page's article.
    """
    marked = outside = settled = role_main = False
    if attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                for token in value.split():
                    mark, out, comments = _marks(token)
                    marked, outside, settled = marked or mark, outside or out, settled or comments
            elif key == "role":
                role_main |= value in ("main", "article")
                settled |= not MARKS.isdisjoint(value.split())
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                settled = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                settled = True
    if name in ("html", "body"):
        return False, False, False
    main = name in ("article", "main") or role_main
    if settled or name in NEVER and not main or name == "header" and not inside and not main:
        return False, True, False
    return main, False, marked or outside and not inside and not main


def lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks of text in order, each with what markup says of it.

    The page's articles are those inside the fewest marked elements; these hold them, so their marks do not count.
    Without an article, the mark of an element with most of the text does not count.
    """
    out: list[tuple[str, _State]] = []
    buffer: list[str] = []
    stack: list[tuple[str, _State]] = []  # element, state inside it
    state, at, size = _State(), 0, len(page)
    n_marked = 0
    articles: set[tuple[int, ...]] = set()  # the marked elements around each

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, state))

    search = TOKEN.search
    while at < size:
        match = search(page, at)
        if match is None:
            rest = page[at:]
            # An element cut off by the end of the page is no text.
            stop = re.search(r"<[A-Za-z/][^>]*\Z", rest)
            buffer.append(rest[: stop.start()] if stop else rest)
            break
        buffer.append(page[at : match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            if match[0].startswith("<![CDATA["):
                buffer.append(html.escape(match[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name == "br":
            buffer.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if match[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    after = stack[-1][1] if stack else _State()
                    if after != state:
                        flush()
                    state = after
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name in VOID or match[3].endswith("/") and name not in BLOCKS:
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            stack.pop()
            state = stack[-1][1] if stack else _State()
        opens, boiler, marked = _says(name, match[3], state.main)
        inner = state
        # A reader's comment may be an article; a menu or header that holds one was not closed.
        if boiler:
            inner = state if state.root else state._replace(root=name)
        elif not state.root or opens and state.root in ("nav", "header"):
            if marked:
                n_marked += 1
                inner = inner._replace(marked=(*inner.marked, n_marked))
            if opens:
                inner = inner._replace(root="", main=True)
                articles.add(inner.marked)
        if inner != state:
            flush()
        stack.append((name, inner))
        state = inner
    flush()
    least = min(map(len, articles), default=0)
    holders = {m for around in articles if len(around) == least for m in around}
    if not articles and n_marked:
        letters: Counter[int] = Counter()
        for text, where in out:
            if not where.root:
                letters.update(dict.fromkeys((0, *where.marked), len(text)))
        holders = {m for m, n in letters.items() if 2 * n > letters[0]}

    def kind(where: _State) -> int:
        if where.root or not holders.issuperset(where.marked):
            return BOILERPLATE
        return MAIN if where.main else OPEN

    return [(text, kind(where)) for text, where in out]


def _last_row(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and every prefix of ``b``, with one bit per line of b."""
    where: dict[int, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    row, n = [0], 0
    for bit in bin(v | 1 << len(b))[:2:-1]:
        n += bit == "0"
        row.append(n)
    return row


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory of the lines alone (divide and conquer)."""
    both = set(a) & set(b)
    left = [i for i, x in enumerate(a) if x in both]
    right = [x for x in b if x in both]
    found: list[int] = []
    todo = [(left, right)]
    while todo:
        left, right = todo.pop()
        while left and right and a[left[0]] == right[0]:
            found.append(left[0])
            left, right = left[1:], right[1:]
        while left and right and a[left[-1]] == right[-1]:
            found.append(left[-1])
            left, right = left[:-1], right[:-1]
        if not left or not right:
            continue
        if len(left) == 1:
            if a[left[0]] in right:
                found.append(left[0])
            continue
        half = len(left) // 2
        head = _last_row([a[i] for i in left[:half]], right)
        tail = _last_row([a[i] for i in reversed(left[half:])], right[::-1])[::-1]
        split = max(range(len(right) + 1), key=lambda j: head[j] + tail[j])
        todo += [(left[:half], right[:split]), (left[half:], right[split:])]
    return sorted(found)


def main_text(page: str, shared: Set[int] | None = None, template: Set[int] = frozenset()) -> str:
    """Main text of a page, given the places of lines that its nearest neighbour shares, and the hashes of the lines
    that are template inside main text on its host."""
    blocks = lines(page)
    gone = {i for i, (_, kind) in enumerate(blocks) if kind == OPEN and i in (shared or ())}
    if template:
        main = [(i, len(text)) for i, (text, kind) in enumerate(blocks) if kind == MAIN]
        hashes = line_hashes(blocks)
        inside = {i for i, _ in main if hashes[i] in template}
        letters = sum(n for i, n in main if i in inside)
        if len(inside) < COPY * len(main) or letters < COPY * sum(n for _, n in main):
            gone |= inside
    return "\n".join(text for i, (text, kind) in enumerate(blocks) if kind != BOILERPLATE and i not in gone)


def line_hashes(blocks: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63 for text, _ in blocks]


def with_neighbour(pages: DataFrame, key: str, url: str) -> DataFrame:
    """(key, host, mate): the key of the page next to each by host and URL path that has the longer path in common with it.

    All pages are put in one order of host and path by ranges, however many a host has; a page's rank in it then finds
    its two neighbours by an ordinary join. A null or unreadable URL has an empty host and path. Pages that share a
    URL stand in the order of their keys, ties of nearness go to the earlier page.
    """
    bare = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    narrow = pages.select(
        F.col(key).alias("key"),
        F.lower(F.regexp_extract(bare, r"^([^/]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(/.*)?$", 1), r"/+$", "").alias("path"),
    )
    place = ["host", "path", "key"]
    ordered = cut(
        narrow.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "host", F.split("path", "/").alias("steps"), "key", (F.col("start") + F.col("at").bitwiseAND(2**33 - 1)).alias("rank")
    )

    def beside(step: int) -> DataFrame:
        return ranked.select(
            F.col("host").alias("host_"), F.col("steps").alias("steps_"), F.col("key").alias("mate"),
            (F.col("rank") - step).alias("rank"), F.lit(step).alias("step"),
        )

    # Path steps in common: the first place at which the two differ.
    common = F.coalesce(
        F.array_min(
            F.filter(
                F.sequence(F.lit(0), F.least(F.size("steps"), F.size("steps_"))),
                lambda i: ~F.get("steps", i).eqNullSafe(F.get("steps_", i)),
            )
        ),
        F.size("steps"),
    )
    pairs = ranked.join(beside(-1).unionByName(beside(1)), "rank").filter("host = host_")
    nearest = F.max_by("mate", F.struct(common, -F.col("step"))).alias("mate")
    return pairs.groupBy("rank", "key", "host").agg(nearest).select("key", "host", "mate")


def _templates(compared: DataFrame) -> DataFrame:
    """(host, template array<bigint>): hashes of the lines that are template inside main text.

    Each of them stands on at least half of the host's pages, so a host has at most twice as many as a page has lines.
    """
    sizes = compared.groupBy("host").agg(F.count("*").alias("pages"))
    counted = compared.select("host", F.explode("main").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    often = counted.filter(F.col("n") >= HOST_PAGES).join(sizes, "host").filter(F.col("n") >= HOST_SHARE * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("h").alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, for every row; other columns stay, a column named ``text`` is replaced.

    A null or empty page has an empty text. Rows equal in id, URL and html are one page; rows that share only some of
    these are pages of their own. A host's only page has no neighbour: what markup leaves open then counts as main
    text. A copy without an ``article`` or ``main`` element has nothing of its own and loses what it shares.
    """
    row, url, shared, template = fresh(pages, "_key", "_url", "_shared", "_template")
    parts = [F.col(c) for c in (id_col, url_col, html_col)]
    key = F.xxhash64(*parts, *[c.isNull() for c in parts])  # the hash itself passes nulls over
    source = pages.drop("text") if "text" in pages.columns else pages
    keyed = source.withColumn(row, key)
    mates = with_neighbour(keyed.select(row, F.col(url_col).alias(url)).dropDuplicates([row]), row, url)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [lines(page or "") for page in batch.column(1).to_pylist()]
            kinds = [bytes(kind for _, kind in page) for page in blocks]
            hashes = pa.array([line_hashes(page) for page in blocks], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes, pa.array(kinds, pa.binary())], ["key", "hashes", "kinds"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Null where there is nothing, as on most pages.
        for batch in batches:
            places, main = [], []
            for own, kinds, theirs in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                both = aligned(own, theirs)
                places.append([i for i in both if kinds[i] == OPEN] or None)
                main.append(sorted({own[i] for i in both if kinds[i] == MAIN}) or None)
            found = [batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32())), pa.array(main, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(found, ["key", "host", "shared", "main"])

    of_lines = keyed.select(row, html_col).mapInArrow(hashed, "key bigint, hashes array<bigint>, kinds binary")
    of_lines = cut(of_lines.dropDuplicates(["key"]))
    theirs = of_lines.select(F.col("key").alias("mate"), F.col("hashes").alias("theirs"))
    compared = cut(
        mates.join(theirs, "mate").join(of_lines, "key").select("key", "host", "hashes", "kinds", "theirs")
        .mapInArrow(compare, "key bigint, host string, shared array<int>, main array<bigint>")
    )
    templates = cut(_templates(compared))
    if (templates.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_HASHES:
        templates = F.broadcast(templates)
    # Pages of which nothing can go need not meet their html again: it is not shuffled.
    known = compared.join(templates, "host", "left").filter("shared IS NOT NULL OR template IS NOT NULL").select(
        F.col("key").alias(row), F.col("shared").alias(shared), F.col("template").alias(template)
    )

    @F.pandas_udf("string")
    def texts(page, places, inside):
        sets = ([set() if x is None else {int(i) for i in x} for x in column] for column in (places, inside))
        found = [main_text(p or "", *known) for p, *known in zip(page, *sets, strict=True)]
        return pd.Series(found, index=page.index, dtype=object)

    touched, whole = split_by_keys(keyed, known, [row])
    nothing = {shared: F.lit(None).cast("array<int>"), template: F.lit(None).cast("array<bigint>")}
    return (
        touched.join(known, row, "left").unionByName(whole.withColumns(nothing))
        .withColumn("text", texts(F.col(html_col), F.col(shared), F.col(template)))
        .drop(row, shared, template)
    )


def op3_nearest_url_difference(pages: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

