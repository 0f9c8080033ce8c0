"""Main text of web pages by minimum cuts.

A page is read once into blocks, runs of text between block-level tags. Marks of the page's
structure (sectioning tags, roles, names of classes and ids) call a block content or
boilerplate; what they leave open is judged by a naive Bayes classifier over the kind of tag,
length, share of linked characters and closing punctuation, learned from the blocks
that the marks have settled, over all pages. Both become costs: a block is tied to the
source by what it costs to drop it and to the sink by what it costs to keep it. Neighbours in
page order are tied by edges that weaken with their distance in the tree, and a block is tied
to the block before it in the same element. The minimum cut splits content from boilerplate; of
several least cuts the one that keeps most is taken.

Before flows are sought, blocks whose own cost outweighs all their edges are settled and their
edges folded into their neighbours' costs, which changes no least cut; a page marked by
its structure is settled in one pass, and the rest falls apart into short runs. Reading and
reducing are linear in the page, whatever its tags.

Pages are independent rows: the only shuffle is of feature counts (under two thousand rows a
task), and read pages are written once, so a lost executor costs its own tasks.

Defined results: null and empty html, and pages without content, give an empty text; null urls and
ids stay; repeated rows are pages of their own; white space is what Unicode calls so; line breaks
by `br` are white space inside a block; other columns are not carried over; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from itertools import count, pairwise
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import map_arrow, slices
from cellpulse.plans.bounded import scratch_path

SLICE_BYTES = 2_000_000
# What HTML says of its tags.
UNSHOWN = frozenset(
    "title style script noscript template svg math iframe object select datalist button textarea audio"
    " video canvas".split()
)
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search"
    " section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | {"p", "pre"}
KINDS = dict.fromkeys(HEADINGS, 1) | dict.fromkeys(("p", "pre"), 2) | dict.fromkeys(("li", "dd", "dt"), 3)
KINDS |= dict.fromkeys(("td", "th"), 4)
# Marks of boilerplate and of content.
NEVER_TAGS = frozenset("nav aside footer menu dialog search".split())
NEVER_ROLES = frozenset(
    "navigation complementary contentinfo search dialog alertdialog alert menu menubar toolbar banner".split()
)
NEVER_NAMES = frozenset("comment comments commentlist disqus respond replies discussion".split())
DOUBT_TAGS = frozenset("form fieldset".split())
DOUBT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie"
    " cookies disclaimer gdpr login menu modal nav navbar navigation newsletter notice notices notification"
    " overlay pager pagination popup promo promoted recommended related search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
FRAME_NAMES = frozenset("copyright footer header masthead topbar".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_NAMES = frozenset(
    "article-body article-content articlebody content-body entry-content main-content maincontent page-content"
    " post-body post-content postcontent story-body storybody".split()
)
# What the marks say of a block.
OPEN, CONTENT, DOUBTED, NEVER = 0, 1, 2, 3
# Costs in tenths of a natural log; marks outweigh the classifier and all edges of a block together.
MARKED, OUTSIDE, MOST_LEARNED = 60, -25, 30
NEXT_TO, SAME_ELEMENT = 8, 5
_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?/])")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"[a-z0-9]+")
_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW}
_ENDS = frozenset(".!?:;…。！？\"”»)")


def _behind_tag(html: str, at: int, dead: set[str]) -> int:
    """Place behind the `>` of a tag; quotes count after `=` only, and only where they are closed."""
    while found := _STOP.search(html, at):
        quote, at = found[0], found.end()
        if quote == ">":
            return at
        if quote not in dead and html[max(0, at - 9) : at - 1].rstrip()[-1:] == "=":
            close = html.find(quote, at)
            if close < 0:
                dead.add(quote)
            else:
                at = close + 1
    return len(html)


def tags_and_texts(html: str) -> Iterator[tuple[str, str, str]]:
    """`(kind, name, rest)`: ("text", "", text), ("open", tag, attributes) or ("close", tag, "")."""
    at, begin, dead = 0, 0, set()
    while found := _TAG.search(html, at):
        if found.start() > begin:
            yield "text", "", html[begin : found.start()]
        if found[1]:
            # `<!-->` and `<!--->` are whole comments.
            end = html.find("-->", found.end() - 2)
            at = begin = len(html) if end < 0 else end + 3
            continue
        at = begin = _behind_tag(html, found.end(), dead)
        if not found[3]:
            continue
        name = found[3].lower()
        yield ("close", name, "") if found[2] else ("open", name, html[found.end() : at])
        if name in RAW and not found[2]:
            end = _RAW_END[name].search(html, at)
            at = begin = end.start() if end else len(html)
    if begin < len(html):
        yield "text", "", html[begin:]


def mark_of(tag: str, attributes: str, above: int) -> int:
    """What the marks say inside an element, given what they say around it."""
    if above == NEVER or tag in NEVER_TAGS:
        return NEVER
    named = {}
    if attributes.strip("/> \t\r\n"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            named[name.lower()] = "".join(values).lower()
    role = named.get("role", "")
    if role in NEVER_ROLES:
        return NEVER
    label = f"{named.get('class', '')} {named.get('id', '')}"
    names = frozenset(_NAMES.findall(label))
    if names & NEVER_NAMES:
        return NEVER
    if tag in CONTENT_TAGS or role in ("main", "article") or named.get("itemprop") == "articlebody":
        return CONTENT
    hidden = "hidden" in named or named.get("aria-hidden") == "true"
    hidden = hidden or "display:none" in named.get("style", "").replace(" ", "")
    if tag in DOUBT_TAGS or hidden or names & DOUBT_NAMES:
        return DOUBTED
    if above != CONTENT and (tag == "header" or names & FRAME_NAMES):
        return DOUBTED
    if above == OPEN and not CONTENT_NAMES.isdisjoint(label.split()):
        return CONTENT
    return above


class Block:
    """A run of text with its mark, kind of tag, linked characters and place in the tree."""

    __slots__ = ("text", "mark", "kind", "linked", "element", "apart")

    def __init__(self, text, mark, kind, linked, element, apart):
        self.text, self.mark, self.kind, self.linked = text, mark, kind, linked
        self.element, self.apart = element, apart


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order. `apart` is the way in the tree from the block before."""
    numbers = count(1)
    # Elements open now: tag, mark, number of the element. Leaves are on top.
    stack: list[tuple[str, int, int]] = [("", OPEN, 0)]
    depth_of_tag: dict[str, int] = {}
    out: list[Block] = []
    pieces: list[str] = []
    linked = in_link = 0
    # Elements open that show no text, and blocks opened inside them.
    unshown: list[str] = []
    inside = 0
    lowest = last_depth = 1

    def flush() -> None:
        nonlocal linked, lowest, last_depth
        words = "".join(pieces).split()
        pieces.clear()
        if words:
            tag, mark, number = stack[-1]
            # A paragraph or heading stands for the element around it.
            leaf = tag in LEAVES and len(stack) > 1
            depth = len(stack) - leaf
            low = min(lowest, depth)
            element = stack[-2][2] if leaf else number
            out.append(Block(" ".join(words), mark, KINDS.get(tag, 0), linked, element, depth + last_depth - 2 * low))
            lowest = last_depth = depth
        linked = 0

    def close(depth: int) -> None:
        nonlocal lowest
        while len(stack) > depth:
            depth_of_tag[stack.pop()[0]] -= 1
        lowest = min(lowest, len(stack))

    for kind, tag, rest in tags_and_texts(html):
        if kind == "text":
            if not unshown:
                text = unescape(rest)
                pieces.append(text)
                if in_link:
                    linked += len(text)
        elif tag in UNSHOWN:
            if kind == "open":
                inside = inside if unshown else 0
                unshown.append(tag)
            elif tag in unshown:
                del unshown[unshown.index(tag) :]
        elif tag in ("html", "body"):
            unshown.clear()
            flush()
        elif unshown and not (kind == "close" and tag in BLOCKS and inside == 0 and depth_of_tag.get(tag)):
            if tag in BLOCKS and tag not in VOID:
                inside = inside + 1 if kind == "open" else max(0, inside - 1)
        elif tag == "a":
            in_link = int(kind == "open")
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCKS:
            # A block's end also ends what was left open inside it.
            unshown.clear()
            flush()
            # Block-level tags end a paragraph; list items end the item before.
            if stack[-1][0] in LEAVES and (kind == "open" or tag != stack[-1][0]):
                close(len(stack) - 1)
            if kind == "open":
                if tag in ("li", "td", "th", "tr", "dd", "dt") and stack[-1][0] == tag:
                    close(len(stack) - 1)
                if tag not in VOID:
                    stack.append((tag, mark_of(tag, rest, stack[-1][1]), next(numbers)))
                    depth_of_tag[tag] = depth_of_tag.get(tag, 0) + 1
            elif depth_of_tag.get(tag):
                depth = len(stack)
                while stack[depth - 1][0] != tag:
                    depth -= 1
                close(depth - 1)
    flush()
    return out


def feature_of(block: Block) -> tuple[int, int, int, int]:
    """Kind of tag, length, share of linked characters, closing punctuation; each a small number."""
    words = min(7, (block.text.count(" ") + 1).bit_length())
    share = min(1.0, block.linked / len(block.text))
    linked = 0 if share == 0 else 1 if share < 0.4 else 2 if share < 0.8 else 3
    return block.kind, words, linked, int(block.text[-1] in _ENDS)


def learned_costs(counts: dict[tuple[int, int], tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Cost of dropping less cost of keeping, per (feature, value), from counts in (content, boilerplate)."""
    out = {}
    for feature in {f for f, _ in counts}:
        rows = {v: n for (f, v), n in counts.items() if f == feature}
        good, bad = (sum(n[side] for n in rows.values()) + len(rows) for side in (0, 1))
        for value, (n_good, n_bad) in rows.items():
            out[feature, value] = round(10 * log((n_good + 1) / good * bad / (n_bad + 1)))
    return out


def minimum_cut(own: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost, most of them true; `own` is what a false label costs more than a true one.

    `edges` are (node, node, cost of different labels).
    """
    own = list(own)
    near: list[dict[int, int]] = [{} for _ in own]
    for i, j, cost in edges:
        if i != j and cost > 0:
            near[i][j] = near[i].get(j, 0) + cost
            near[j][i] = near[i][j]
    label: list[bool | None] = [None] * len(own)
    pull = [sum(n.values()) for n in near]
    waiting = deque(range(len(own)))
    while waiting:
        i = waiting.popleft()
        if label[i] is not None or -pull[i] <= own[i] < pull[i]:
            continue
        label[i] = own[i] >= pull[i]
        for j, cost in near[i].items():
            if label[j] is None:
                own[j] += cost if label[i] else -cost
                pull[j] -= cost
                waiting.append(j)
    for i in range(len(own)):
        if label[i] is None:
            part, seen = [i], {i}
            for k in part:
                fresh = [j for j in near[k] if label[j] is None and j not in seen]
                seen.update(fresh)
                part.extend(fresh)
            for k, keep in _flow(part, own, near).items():
                label[k] = keep
    return [bool(x) for x in label]


def _flow(part: list[int], own: list[int], near: list[dict[int, int]]) -> dict[int, bool]:
    """Labels of one connected part by maximum flow, shortest ways first."""
    source, sink, inside = -1, -2, set(part)
    left: dict[int, dict[int, int]] = {k: {j: c for j, c in near[k].items() if j in inside} for k in part}
    left[source], left[sink] = {}, {}
    for k in part:
        if own[k] > 0:
            left[source][k], left[k][source] = own[k], 0
        elif own[k] < 0:
            left[k][sink], left[sink][k] = -own[k], 0
    while True:
        level, waiting = {source: 0}, deque([source])
        while waiting:
            k = waiting.popleft()
            for j, room in left[k].items():
                if room > 0 and j not in level:
                    level[j] = level[k] + 1
                    waiting.append(j)
        if sink not in level:
            break
        # Each node's neighbours, and the first that may still lead on.
        ways = {k: list(left[k]) for k in level}
        first = dict.fromkeys(level, 0)
        way = [source]
        while way:
            k = way[-1]
            if k == sink:
                room = min(left[a][b] for a, b in pairwise(way))
                full = len(way)
                for n, (a, b) in enumerate(pairwise(way)):
                    left[a][b] -= room
                    left[b][a] += room
                    if not left[a][b]:
                        full = min(full, n)
                del way[full + 1 :]
                continue
            while first[k] < len(ways[k]):
                j = ways[k][first[k]]
                if left[k][j] > 0 and level.get(j) == level[k] + 1:
                    way.append(j)
                    break
                first[k] += 1
            else:
                way.pop()
                if way:
                    first[way[-1]] += 1
    # Boilerplate is what still reaches the sink.
    reach, waiting = {sink}, deque([sink])
    while waiting:
        k = waiting.popleft()
        for j in left[k]:
            if j not in reach and left[j].get(k, 0) > 0:
                reach.add(j)
                waiting.append(j)
    return {k: k not in reach for k in part}


def kept_blocks(marks: list[int], learned: list[int], elements: list[int], apart: list[int]) -> list[bool]:
    """Which blocks of a page are content."""
    outside = OUTSIDE if CONTENT in marks else 0
    own = [MARKED if m == CONTENT else outside if m == OPEN else -MARKED for m in marks]
    own = [a + max(-MOST_LEARNED, min(MOST_LEARNED, b)) for a, b in zip(own, learned, strict=True)]
    edges, last = [], {}
    for i, element in enumerate(elements):
        if i:
            edges.append((i - 1, i, max(1, NEXT_TO - apart[i])))
        if last.get(element, i - 1) != i - 1:
            edges.append((last[element], i, SAME_ELEMENT))
        last[element] = i
    return minimum_cut(own, edges)


_READ = "texts array<string>, marks array<int>, features array<int>, elements array<int>, apart array<int>"
# A feature's four numbers in one: kind, words, linked share, ending.
_RADIX = (8, 8, 4, 2)


def _packed(feature: tuple[int, int, int, int]) -> int:
    number = 0
    for value, radix in zip(feature, _RADIX, strict=True):
        number = number * radix + value
    return number


def _unpacked(number: int) -> list[tuple[int, int]]:
    out = []
    for place in (3, 2, 1, 0):
        number, value = divmod(number, _RADIX[place])
        out.append((place, value))
    return out


def read_pages(pages: DataFrame) -> DataFrame:
    """`page_id, url` and the blocks of each row of `pages` (`page_id, url, html`)."""
    plain = ["page_id", "url"]
    fields = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in plain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", SLICE_BYTES):
            read = [blocks_of(html.as_py() or "") for html in batch.column(batch.schema.get_field_index("html"))]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in plain),
                    pa.array([[b.text for b in page] for page in read], pa.list_(pa.string())),
                    pa.array([[b.mark for b in page] for page in read], ints),
                    pa.array([[_packed(feature_of(b)) for b in page] for page in read], ints),
                    pa.array([[b.element for b in page] for page in read], ints),
                    pa.array([[b.apart for b in page] for page in read], ints),
                ],
                [*plain, "texts", "marks", "features", "elements", "apart"],
            )

    return map_arrow(pages.select(*plain, "html"), work, f"{fields}, {_READ}")


def learned(read: DataFrame) -> dict[tuple[int, int], int]:
    """Costs of the classifier from all blocks that the marks have settled."""
    pairs = read.select(F.explode(F.arrays_zip("marks", "features")).alias("b")).where(f"b.marks <> {OPEN}")
    counted = pairs.groupBy((F.col("b.marks") == CONTENT).alias("good"), "b.features").count()
    counts: dict[tuple[int, int], list[int]] = {}
    # At most one row per feature and side.
    for r in counted.collect():
        for key in _unpacked(r["features"]):
            counts.setdefault(key, [0, 0])[0 if r["good"] else 1] += r["count"]
    return learned_costs({k: tuple(n) for k, n in counts.items()})


def extracted(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` of each row of `pages` (`page_id, url, html`)."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "page-blocks")
    read = read_pages(pages)
    read.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(read.schema).parquet(path)
    costs = learned(read)
    plain = ["page_id", "url"]
    fields = ", ".join(f"{c} {read.schema[c].dataType.simpleString()}" for c in plain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            texts = []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("texts", "marks", "features", "elements", "apart")]
            for row in zip(*columns, strict=True):
                blocks, marks, features, elements, apart = (x.as_py() for x in row)
                for f in features:
                    if f not in known:
                        known[f] = sum(costs.get(key, 0) for key in _unpacked(f))
                kept = kept_blocks(marks, [known[f] for f in features], elements, apart)
                texts.append("\n\n".join(b for b, keep in zip(blocks, kept, strict=True) if keep))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in plain), pa.array(texts, pa.string())],
                [*plain, "text"],
            )

    found = map_arrow(read, work, f"{fields}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
