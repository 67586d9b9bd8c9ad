"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in the order of their paths, and each is paired with the nearest page before and after it whose lines
differ (lines of declared frames aside). The text lines (blocks) of a page and of each partner are aligned by a longest common subsequence; two
lines are the same if their texts and their places in the markup are: the path of element names, classes and ids above them. So a sentence that
a neighbour shows as an advert or in its footer is no evidence against a paragraph.

What the pair shares tells which paths are the site's frame. A path whose lines mostly recur is template, and its aligned lines are deleted, at
their places only. The path with most text of the page's own is its article's and no template: there only aligned lines before or behind all own ones go, and only
if most of the path is its own. Paragraphs of a declared article stay whatever the neighbours have, unless an element with a class, an id
or a role stands between them and the article; lines that markup declares to be frame (menus, footers, forms, notices ...) go in any case.

The order comes from a range partitioning by (host, path, identifier), so a host of any size is spread over
partitions; only keys, line hashes and deleted places are exchanged.
"""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.session import materialize

# A line is a declared article's own, beside any article, in a declared frame, or set apart within an article.
IN_ARTICLE, OPEN, FRAME, INSET = range(4)
_SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|head|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[/!?][^>]*>|<[a-zA-Z][^>]*>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Names of elements and words of class, id and role attributes that stand for a page's frame; fixed values.
_FRAME_TAGS = frozenset("nav footer aside form button select textarea menu dialog label input fieldset".split())
_FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay"
    " sidebar side aside widget menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottom comment comments reply replies disqus discussion"
    " related recommended share sharing social newsletter subscribe subscription login signup search pagination pager toolbar contentinfo complementary hidden".split()
)
_WHOLE = frozenset(("html", "body", "main"))
_BESIDE = frozenset("has with no without is js".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_NUMBER = re.compile(r"[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LOOSE = frozenset("p li dt dd tr td th option b i em strong span a".split()) - frozenset("a span".split())


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """Name of an element with its classes, id and role, numbers in them aside, and whether it has any of them."""
    if not attributes.strip():
        return name, False
    marks = [f"{key.lower()}={value.strip(chr(34) + chr(39)).lower()}" for key, value in _ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id", "role")]
    return f"{name}[{_NUMBER.sub('0', ' '.join(marks))}]" if marks else name, bool(marks)


def _is_frame(name: str, attributes: str, in_article: bool) -> bool:
    if name in _FRAME_TAGS or name == "header" and not in_article:
        return True
    if not attributes.strip():
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role") and name not in _WHOLE:
            for token in value.split():
                parts = re.split(r"[^a-z0-9]+", token)
                # "with-sidebar" says what stands beside it
                if parts[0] not in _BESIDE and not _FRAME_WORDS.isdisjoint(parts):
                    return True
    return False


def blocks(page: str) -> list[tuple[str, int, str]]:
    """Text blocks in page order: text, what markup declares it to be, and its path."""
    page = _SILENT.sub(" ", page)
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, bool, bool, bool, str]] = []  # name, frame, article, set apart: with what stands above; path
    words: list[str] = []
    kind, path, loose = OPEN, "", ""

    def close() -> None:
        nonlocal words
        if words:
            text = "".join(words)
            text = " ".join((references.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, kind, f"{path}/{loose}"))
            words = []

    at = 0
    for tag in _TAG.finditer(page):
        if tag.start() > at:
            words.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            words.append(" ")
            continue
        if name in _INLINE and not (name in ("a", "span") and tag[3].strip() and not tag[1]):
            if not stack or name not in ("a", "span") or not any(s[0] == name for s in stack):
                continue
        if name == "br":
            words.append(" ")
            continue
        if name in _VOID:
            if name not in ("img", "wbr", "input"):
                close()
            continue
        own = False
        if tag[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if name not in _INLINE:
                close()
                loose = ""
            if place >= 0:
                if name in _INLINE and stack[place][1] != (place > 0 and stack[place - 1][1]):
                    close()
                del stack[place:]
        else:
            frame, article, apart, above = stack[-1][1:] if stack else (False, False, False, "")
            mine = _is_frame(name, tag[3], article)
            if name in _INLINE and not mine:
                continue
            close()
            label, marked = _label(name, tag[3])
            begins = name in _ARTICLE_TAGS and not frame and not mine
            if name not in _LOOSE or mine:
                stack.append((name, frame or mine, article or begins, article and (apart or marked), f"{above}/{label}"))
                loose = ""
            else:
                loose, own = label, marked
        frame, article, apart, path = stack[-1][1:] if stack else (False, False, False, "")
        kind = FRAME if frame else OPEN if not article else INSET if apart or own else IN_ARTICLE
    if at < len(page):
        tail = page[at:]
        cut = re.search(r"<[/!?a-zA-Z][^>]*\Z", tail)  # a tag that the end of the page cuts off
        words.append(tail[: cut.start()] if cut else tail)
    close()
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit vectors of the longest-common-subsequence table: zero bits of the first j say L(i, j)."""
    masks: dict[int, int] = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(row: int, n: int) -> np.ndarray:
    bits = np.frombuffer(row.to_bytes(-(-n // 8) or 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[:n].astype(np.int64))])


def common(a: list[int], b: list[int], cells: int = 1 << 28) -> list[int]:
    """Places of ``a`` that a longest common subsequence with ``b`` takes; halves the table where it would exceed ``cells`` bits."""
    shared = set(a) & set(b)
    keep = [i for i, line in enumerate(a) if line in shared]
    b = [line for line in b if line in shared]
    if not keep:
        return []
    a = [a[i] for i in keep]
    if len(a) * len(b) > cells and len(a) > 1:
        half = len(a) // 2
        *_, upper = _rows(a[:half], b)
        *_, lower = _rows(a[half:][::-1], b[::-1])
        cut = int((_lengths(upper, len(b)) + _lengths(lower, len(b))[::-1]).argmax())
        found = common(a[:half], b[:cut], cells) + [half + i for i in common(a[half:], b[cut:], cells)]
        return [keep[i] for i in found]
    table = [(1 << len(b)) - 1, *_rows(a, b)]
    found, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.append(keep[i])
        elif (table[i - 1] & ((1 << j) - 1)).bit_count() <= (table[i] & ((1 << (j - 1)) - 1)).bit_count() + 1:
            i -= 1  # as many zero bits, that is common lines, without the last line of a
        else:
            j -= 1
    return found[::-1]


def _placed(pages: DataFrame) -> DataFrame:
    """``pages`` with the host and the path of ``url``, without rows that lack an identifier or URL."""
    bare = F.regexp_replace(F.lower("url"), r"^[a-z][a-z0-9+.-]*://", "")
    return pages.where("id is not null and url is not null").withColumns(
        {
            "host": F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^www\.|:\d+$", ""),
            "path": F.regexp_extract(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^[^/?#]*([^?#]*)", 1),
        }
    )


def _partners(pages: DataFrame) -> DataFrame:
    """Rows (id, rank, other) of at most two pages of the same host with another digest.

    They are the nearest before and after in the order of the paths; rank 0 is the one whose path has the longer common beginning.
    """
    keys = _placed(pages).groupBy("id").agg(F.min(F.struct("host", "path", "digest")).alias("k"))
    keys = materialize(keys.select("id", "k.host", "k.path", "k.digest"), "urls")
    order = ["host", "path", "id"]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "urls")
    page = F.struct("host", "path", "id", "digest")

    def reached(table: DataFrame, by: str, name: str) -> DataFrame:
        """The last page before the own run of pages with one digest; null for the first run of a partition."""
        up = F.asc("place") if by == "prev" else F.desc("place")
        within = Window.partitionBy("part").orderBy(up)
        last = F.lag(page).over(within)
        turned = table.withColumn("_last", F.when((last["host"] != F.col("host")) | (last["digest"] != F.col("digest")), last))
        return turned.withColumn(name, F.last("_last", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("_last")

    near = materialize(reached(reached(dealt, "prev", "prev"), "next", "next"), "urls")
    # the ends of the partitions: one row for each partition comes to the driver
    first, last = F.min_by(page, "place").alias("first"), F.max_by(page, "place").alias("last")
    ends = near.groupBy("part").agg(first, last, F.max_by("prev", "place").alias("last_prev"), F.min_by("next", "place").alias("first_next"))
    schema = ends.select("part", F.col("first").alias("before"), F.col("last").alias("after")).schema
    ends = sorted(ends.collect(), key=lambda row: row["part"])

    def across(rows: list, mine: str, facing: str, beyond: str) -> dict:
        """For each partition the nearest page outside that differs from the page at its end."""
        out, known = {}, None
        for k, row in enumerate(rows):
            if k:
                one, two = row[mine], rows[k - 1][facing]
                differs = (one["host"], one["digest"]) != (two["host"], two["digest"])
                known = two if differs else rows[k - 1][beyond] or known
            out[row["part"]] = known
        return out

    before, after = across(ends, "first", "last", "last_prev"), across(ends[::-1], "last", "first", "first_next")
    outside = pages.sparkSession.createDataFrame([(row["part"], before[row["part"]], after[row["part"]]) for row in ends], schema)
    near = near.join(F.broadcast(outside), "part").select("host", "path", "id", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))

    def alike(other: str):
        """Length of the common beginning of the paths; -1 for another host."""
        steps = F.sequence(F.lit(1), F.least(F.length("path"), F.length(f"{other}.path")))
        same = F.filter(steps, lambda n: F.col("path").substr(F.lit(1), n) == F.col(f"{other}.path").substr(F.lit(1), n))
        length = F.when((F.length("path") == 0) | (F.length(f"{other}.path") == 0), F.lit(0)).otherwise(F.size(same))
        return F.when(F.col(f"{other}.host") == F.col("host"), length).otherwise(F.lit(-1))

    scored = near.select("id", "prev", "next", F.coalesce(alike("prev"), F.lit(-1)).alias("p"), F.coalesce(alike("next"), F.lit(-1)).alias("n"))
    sides = [F.when(F.col("p") >= 0, F.col("prev.id")), F.when(F.col("n") >= 0, F.col("next.id"))]
    swapped = F.col("n") > F.col("p")
    both = F.filter(F.when(swapped, F.array(*sides[::-1])).otherwise(F.array(*sides)), lambda other: other.isNotNull())
    return scored.select("id", F.posexplode(both).alias("rank", "other"))


def _neighbours(pages: DataFrame) -> DataFrame:
    """Rows (id, other) of the nearest page by path in the same host; pages alone in their host have none."""
    if "digest" not in pages.columns:
        pages = pages.withColumn("digest", F.xxhash64("id"))
    return _partners(pages).where("rank = 0").select("id", "other")


def _hashed(found: list[tuple[str, int, str]]) -> list[int]:
    """A hash of each line's text and path."""
    return [xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63) for text, _, path in found]


def _digest(found: list[tuple[str, int, str]]) -> int:
    """A hash of the lines that are in no declared frame."""
    return xxhash.xxh64_intdigest("\n".join(text for text, kind, _ in found if kind != FRAME).encode("utf-8", "surrogatepass")) - (1 << 63)


def template(lines: list[tuple[int, str, int, str]], aligned: list[list[int]]) -> set[int]:
    """Places that the neighbours show to be the site's frame.

    ``lines`` are (place, text, kind, path) of those outside declared frames, ``aligned`` the places that each neighbour has as well.
    """
    count: dict[int, int] = {}
    for places in aligned:
        for place in places:
            count[place] = count.get(place, 0) + 1
    met = lambda place: count.get(place, 0)
    shared, whole, own = {}, {}, {}
    for place, text, _, path in lines:
        shared[path] = shared.get(path, 0) + met(place)
        whole[path] = whole.get(path, 0) + len(aligned)
        own[path] = own.get(path, 0) + (len(text) if not met(place) else 0)
    # the path with most text that no neighbour has; without any such text the page is a copy, and tells nothing
    main = max(own, key=lambda path: (own[path], path), default="")
    if not own.get(main):
        return set()
    gone = set()
    for place, _, kind, path in lines:
        if kind != IN_ARTICLE and path != main and met(place) and 2 * shared[path] > whole[path]:
            gone.add(place)
    inside = [(place, kind, len(text)) for place, text, kind, path in lines if path == main]
    if 2 * own[main] > sum(size for *_, size in inside):
        for ordered in (inside, inside[::-1]):
            for place, kind, _ in ordered:
                if kind == IN_ARTICLE or met(place) < len(aligned):
                    break
                gone.add(place)
    return gone


def _text(lines: list[tuple[int, str, int, str]], aligned: list[list[int]] | None) -> str:
    """Text of a page's lines (place, text, kind, path) outside declared frames; None: there is no neighbour, and markup decides alone."""
    if aligned is None:
        sizes = [sum(len(text) for _, text, kind, _ in lines if (kind == OPEN) == beside) for beside in (False, True)]
        # an article with less text than stands beside it is a teaser
        return " ".join(text for _, text, kind, _ in lines if kind != OPEN or sizes[0] < sizes[1] or not sizes[0])
    gone = template(lines, aligned)
    return " ".join(text for place, text, *_ in lines if place not in gone)


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (page_id, url, text) for every page.

    A null or empty page has an empty text. Pages with a null identifier or URL are in no pair; rows that share an identifier
    are paired once, by the least of their URLs, for those that have its lines, and each keeps its own text. Character references are decoded, white space in a block
    becomes one space, and blocks are joined by one space.
    """
    source = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = source.schema["id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page.as_py()) for page in batch.column(2)]
            digests = pa.array([_digest(own) for own in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array([_hashed(own) for own in found], pa.list_(pa.int64()))], names=["id", "url", "digest", "lines"])

    named = source.where("id is not null and url is not null").select("id", "url", "html")
    lines = materialize(named.mapInArrow(hashed, f"id {kind}, url string, digest bigint, lines array<bigint>"), "lines")
    one = _placed(lines).groupBy("id").agg(F.min(F.struct("host", "path", "digest", "lines")).alias("k")).select("id", "k.digest", "k.lines")
    pairs = materialize(_partners(lines.select("id", "url", "digest")), "pairs")
    met = materialize(pairs.join(one, "id").select("id", "digest", "other", F.col("lines").alias("own")), "pairs")
    sides = met.join(one.select(F.col("id").alias("other"), "lines"), "other").select("id", "digest", "own", "lines")

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [common(own, other) for own, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "digest", "places"])

    tried = sides.mapInArrow(differenced, f"id {kind}, digest bigint, places array<int>")
    # two neighbours at most
    aligned = tried.groupBy("id", "digest").agg(F.collect_list("places").alias("aligned"))
    aligned = materialize(aligned, "aligned")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            found = [blocks(page.as_py()) for page in batch.column(2)]
            digests = pa.array([_digest(own) for own in found], pa.int64())
            left = [[(place, *line) for place, line in enumerate(own) if line[1] != FRAME] for own in found]
            small = [pack.compress(json.dumps(own).encode()) for own in left]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(small, pa.binary())], names=["id", "url", "digest", "packed"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [_text(json.loads(unpack.decompress(small.as_py())), places) for small, places in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    # a row that shares its identifier, but not its lines, with the one that was paired has no neighbour
    # the blocks are packed before they travel, and travel at every size: a page's text is most of the input
    carried = source.mapInArrow(packed, f"id {kind}, url string, digest bigint, packed binary")
    met = carried.join(aligned.hint("merge"), ["id", "digest"], "left").select("id", "url", "packed", "aligned")
    out = met.mapInArrow(written, f"id {kind}, url string, text string")
    return out.withColumnsRenamed({"id": page_id, "url": url})
