"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

A document is the sorted array of its distinct shingle hashes. Linked documents lie in the same
band of sizes or in neighbouring ones, and differ in at most d shingles, d following from band
and threshold. Each band cuts the hash space into more than d parts, so two linked documents
agree wholly on some part. A tile is the group of documents of a band that agree on one part;
documents with hardly anything in common meet in none.

Inside a tile, links are looked for from leaders: in the first round each document meets the
smallest leader of its tiles, later rounds take more leaders of each tile whose members
aren't one component yet, until every pair of a tile is settled, either by a test or by
being in one component. So a group of n copies costs about n tests, not n squared, and no link
that would join two components is lost. A test first bounds the overlap from above by the bits
that only one bitmap has. Blocks of leaders and members are compared so in numpy, and only the
pairs that may link become rows; these pass a second bitmap, as wide as their sets ask for, and
have their arrays intersected.

Equal sets are one node from the start. Node ids are 64-bit hashes of the set.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.session import materialise

from .bitmaps import bitmap_bits, hash_bitmap, in_bitmap
from .components import connected_components
from .words import SPACED, Tokenizer, U, binary_slices, bounds_of, gathered, mix, slices

BUCKET_BYTES = 24 << 20
HOLD = 1 << 20
BAND_STEPS = 2  # a band spans this many factors of 1 / threshold
BITS = 1024
LEADERS = 32  # of a tile in the second round; each later round takes four times as many
LEADER_BLOCK, MEMBER_BLOCK, PAIRS = 256, 1024, 100_000  # rows compared at a time


class Bands:
    """Size bands and the number of parts of each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = 100 / percent
        self.width = self.ratio**BAND_STEPS if percent < 100 else 2.0
        self.known: dict[int, tuple[int, int]] = {}
        self.salted: dict[int, np.ndarray] = {}

    def of(self, size: int) -> list[int]:
        band = int(math.log(size) / math.log(self.width))
        return [band, band + 1] if size * self.ratio + 1e-6 >= self.width ** (band + 1) - 1e-6 else [band]

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, spare) of a band; (0, 0) if only equal sets can link in it."""
        if band not in self.known:
            most = self.width ** (band + 1) + 1
            differ = math.floor(2 * most * (100 - self.percent) / (100 + self.percent) + 1e-6)
            if not differ:
                self.known[band] = (0, 0)
            else:
                # with spare + 1 agreeing parts, a document with up to `spare` empty parts need not list those
                least, spare = self.width**band / self.ratio, 2
                for _ in range(3):
                    empty = (differ + 1 + spare) * math.exp(-least / (differ + 1 + spare))
                    spare = math.ceil(empty + 4 * math.sqrt(empty) + 1)
                self.known[band] = (differ + 1 + spare, spare)
        return self.known[band]

    def salts(self, band: int) -> np.ndarray:
        """A hash for each part of the band."""
        if band not in self.salted:
            self.salted[band] = mix(np.arange(self.parts(band)[0], dtype=np.uint64) + U((band << 32) + 1))
        return self.salted[band]


def _sets(tokens: Tokenizer, shingle: int, data, offsets):
    """The sorted distinct shingle hashes of each text of a slice; a text of fewer words is one shingle."""
    words = tokens.split(data, offsets)
    rolled = tokens.rolling(words.hashes, shingle)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= shingle:
            values = np.sort(rolled[a : b - shingle + 1])
            fresh = np.ones(len(values), bool)
            np.not_equal(values[1:], values[:-1], out=fresh[1:])
            yield values[fresh]
        elif b > a:
            yield tokens.rolling(words.hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _marks(values: np.ndarray) -> np.ndarray:
    """A second hash of each shingle; sums of these stand for sets."""
    return mix(values ^ U(0x3C6EF372))


def _node(marks: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    x = (int(marks.sum(dtype=np.uint64)) + len(marks)) & 0xFFFFFFFFFFFFFFFF
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * factor) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 33
    return x - (1 << 64) if x >> 63 else x


def _headers(shingle: int):
    def run(batches):
        tokens = Tokenizer(SPACED, lower=True)
        for batch in batches:
            size, node = [], []
            for _, _, data, offsets in slices(batch.column("text")):
                for values in _sets(tokens, shingle, data, offsets):
                    size.append(len(values))
                    node.append(_node(_marks(values)) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), pa.array(size, pa.int64()), pa.array(node, pa.int64())], ["id", "copy", "n", "node"])

    return run


def _tiles(shingle: int, percent: int, buckets: int):
    def run(batches):
        tokens, bands = Tokenizer(SPACED, lower=True), Bands(percent)
        for batch in batches:
            for part in gathered(batch.column("text")):
                tiles, nodes = [], []
                for values in (x for _, _, data, offsets in part for x in _sets(tokens, shingle, data, offsets)):
                    if not len(values):
                        continue
                    marks = _marks(values)
                    node = _node(marks)
                    sums = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(marks, out=sums[1:])
                    for band in bands.of(len(values)):
                        parts, spare = bands.parts(band)
                        if not parts:
                            continue
                        edges = np.searchsorted((values >> U(32)) * U(parts) >> U(32), np.arange(parts + 1, dtype=np.uint64))
                        full = np.flatnonzero(edges[1:] > edges[:-1])
                        at = full if parts - len(full) <= spare else np.arange(parts)
                        tiles.append((sums[edges[at + 1]] - sums[edges[at]]) ^ bands.salts(band)[at])
                        nodes.append(np.full(len(at), node, np.int64))
                if not tiles:
                    continue
                tile, node = mix(np.concatenate(tiles)), np.concatenate(nodes)
                bucket = ((tile >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
                order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                edges = bounds_of(bucket[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order[edges[:-1]]]), binary_slices(tile[order], edges), binary_slices(node[order], edges)],
                    ["bucket", "tile", "node"],
                )

    return run


def _meet(batches):
    """Streams buckets, one after the other; yields (tile, node) of the tiles with two nodes or more. Of each
    tile one node is held, the others leave as they come."""
    held, waiting, bucket, size = None, [], None, 0

    def merge():
        nonlocal held, waiting, size
        parts = ([held] if held is not None else []) + waiting
        tile, node, state = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((node, -state, tile))
        tile, node, state = tile[order], node[order], state[order]
        edges = bounds_of(tile)
        head, counts = edges[:-1], np.diff(edges)
        lead = np.repeat(node[head], counts)
        fresh = node != lead
        fresh[1:] &= ~((tile[1:] == tile[:-1]) & (node[1:] == node[:-1]))
        many = np.add.reduceat(fresh, head) > 0
        held, waiting, size = (tile[head], node[head], np.where(many, 2, np.maximum(state[head], 1)).astype(np.int8)), [], 0
        return tile[fresh], node[fresh]

    def rows(tile, node):
        return pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int64)), pa.array(node)], ["tile", "node"])

    def close():
        yield rows(*merge())
        yield rows(held[0][held[2] == 2], held[1][held[2] == 2])

    for batch in batches:
        for now, tile, node in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tile", "node"))):
            if now != bucket:
                if bucket is not None:
                    yield from close()
                bucket, held, waiting, size = now, None, [], 0
            tile, node = np.frombuffer(tile, np.uint64), np.frombuffer(node, np.int64)
            waiting.append((tile, node, np.zeros(len(tile), np.int8)))
            size += len(tile)
            if size >= HOLD + (len(held[0]) if held is not None else 0):
                yield rows(*merge())
    if bucket is not None:
        yield from close()


def _bits(values: np.ndarray, width: int) -> bytes:
    """Bitmap of the low bits of each hash."""
    bitmap = np.zeros(width, np.uint8)
    bitmap[(values & U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bitmap).tobytes()


def _arrays(shared, bits: int, shingle: int):
    """(node, n, bitmap, wide, items) once per task for each node that may be in a tile. The wide
    bitmap has four bits per item or more."""

    def run(batches):
        tokens, seen = Tokenizer(SPACED, lower=True), set()
        for batch in batches:
            out = []
            for _, _, data, offsets in slices(batch.column("text")):
                for values in _sets(tokens, shingle, data, offsets):
                    node = _node(_marks(values)) if len(values) else None
                    if node is None or node in seen or not in_bitmap(shared.value, bits, np.array([node]).astype(np.uint64))[0]:
                        continue
                    seen.add(node)
                    wide = max(BITS, 1 << (4 * len(values) - 1).bit_length())
                    out.append((node, len(values), _bits(values, BITS), _bits(values, wide), values.tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["node", "n", "bitmap", "wide", "items"])

    return run


def _wanted(shared, bits: int):
    """The rows whose node may be wanted."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shared.value, bits, batch.column("node").to_numpy().astype(np.uint64))))

    return run


def _may_link(a, b, n, m, percent: int) -> np.ndarray:
    """May the sets link? Bits that only one bitmap has are elements that only one set has."""
    alone = np.bitwise_count(a & ~b).sum(1, dtype=np.int64), np.bitwise_count(b & ~a).sum(1, dtype=np.int64)
    most = np.minimum(n - alone[0], m - alone[1])
    return 100 * most >= percent * (n + m - most)


def _bitmaps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _bounded(percent: int):
    """The same by wide bitmaps; the longer one of a pair is folded to the shorter."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("wide_u", "wide_v", "n_u", "n_v"))):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                width = min(len(a), len(b))
                a, b = (np.bitwise_or.reduce(x.reshape(-1, width), 0)[None] for x in (a, b))
                keep.append(bool(_may_link(a, b, np.array([n]), np.array([m]), percent)[0]))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _in_blocks(percent: int):
    """Compares the leaders with the members of each (tile, block, chunk); rows come sorted by
    these, leaders first. Yields the pairs of different components that may link."""

    def compare(rows):
        key, lead, node, rank, part, n, bitmap = rows
        edges = bounds_of(key)
        leaders = np.add.reduceat(lead, edges[:-1])
        members = np.diff(edges) - leaders
        at, out = 0, []
        while at < len(members):
            # as many groups as make about PAIRS pairs
            todo = np.cumsum(leaders[at:] * members[at:])
            end = at + max(1, int(np.searchsorted(todo, PAIRS, "right")))
            count = leaders[at:end] * members[at:end]
            group = np.repeat(np.arange(at, end), count)
            inner = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
            width = np.maximum(members[group], 1)
            a = edges[group] + inner // width
            b = edges[group] + leaders[group] + inner % width
            keep = np.flatnonzero((rank[b] > rank[a]) & (part[b] != part[a]))
            a, b = a[keep], b[keep]
            keep = np.flatnonzero(_may_link(bitmap[a], bitmap[b], n[a], n[b], percent)) if len(a) else keep
            out.append((node[a[keep]], node[b[keep]]))
            at = end
        u, v = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches):
        kept, last, number = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tile", "block", "chunk")], 1)
            fresh = np.ones(len(parts), bool)
            fresh[1:] = (parts[1:] != parts[:-1]).any(1)
            fresh[0] = last is None or (parts[0] != last).any()
            key = number + np.cumsum(fresh)
            number, last = int(key[-1]), parts[-1]
            rows = (key, *(batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "node", "rank", "part", "n")), _bitmaps(batch.column("bitmap")))
            if kept is not None:
                rows = tuple(np.concatenate(x) for x in zip(kept, rows))
            cut = int(np.searchsorted(rows[0], number))  # the last group may go on
            if cut:
                yield compare(tuple(x[:cut] for x in rows))
            kept = tuple(x[cut:] for x in rows)
        if kept is not None and len(kept[0]):
            yield compare(kept)

    return run


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("items_u").to_pylist(), batch.column("items_v").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _beside(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Columns of both sets beside each pair (u, v)."""
    for end in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def _links(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of (u, v), those that link. Arrays are shuffled only for the pairs that pass the bitmaps."""
    spark = pairs.sparkSession
    light = materialise(_beside(pairs, sketches, "n", "wide").mapInArrow(_bounded(percent), "u long, v long"), "ngram-light")
    nodes = materialise(light.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ngram-nodes")
    bits = bitmap_bits(nodes.count())
    shared = spark.sparkContext.broadcast(hash_bitmap(nodes, "node", bits))
    items = sets.select("node", "items").mapInArrow(_wanted(shared, bits), "node long, items binary").dropDuplicates(["node"])
    return _beside(light, items, "items").mapInArrow(_linked(percent), "u long, v long")


def _near_leaders(open_tiles: DataFrame, sketches: DataFrame, begin: int, leaders: int, percent: int) -> DataFrame:
    """Pairs (leader, member) of open tiles (tile, node, rank, part, size) that may link, for the
    leaders of ranks begin + 1 to begin + leaders. No group has more rows than the two blocks."""
    known = open_tiles.join(sketches.select("node", "n", "bitmap"), "node")
    place = F.col("rank") - 1
    last = F.floor((F.least(F.lit(leaders), F.col("size") - begin - 1) - 1) / LEADER_BLOCK).cast("int")
    members = (
        known.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
        .filter(F.col("rank") > begin + F.col("block") * LEADER_BLOCK)
        .withColumns({"chunk": F.floor(place / MEMBER_BLOCK).cast("int"), "lead": F.lit(0)})
    )
    chunks = F.sequence(F.floor(place / MEMBER_BLOCK).cast("int"), F.floor((F.col("size") - 1) / MEMBER_BLOCK).cast("int"))
    heads = (
        known.filter((place >= begin) & (place < begin + leaders))
        .withColumn("block", F.floor((place - begin) / LEADER_BLOCK).cast("int"))
        .withColumns({"chunk": F.explode(chunks), "lead": F.lit(1)})
    )
    columns = ["tile", "block", "chunk", "lead", "node", "rank", "part", "n", "bitmap"]
    return (
        members.select(*columns)
        .unionAll(heads.select(*columns))
        .repartition("tile", "block", "chunk")
        .sortWithinPartitions("tile", "block", "chunk", F.desc("lead"))
        .mapInArrow(_in_blocks(percent), "u long, v long")
        .distinct()
    )


def ngram_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """Per row: ``id_col``, text_hash, n_shingles (distinct), n_links (links to other sets that
    were needed to join the component; copies not counted), component_id, the smallest id reachable
    by links, itself included, and group_id, a number of the component, null where the row is
    alone in it.

    Words are lower-cased runs of bytes other than space and \\t to \\r. Two rows link when
    100 * intersection >= percent * union of their shingle sets. A text of fewer words than a
    shingle is one shingle; null text and text without words link with nothing, so that their
    component is their own id. Rows that share an id stay rows; null ids have a null component
    unless they are linked with other ids, and count for nothing in it. Other columns are not
    looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    texts = rows.select("text")
    kind = rows.schema["id"].dataType.simpleString()
    headers = materialise(rows.mapInArrow(_headers(shingle), f"id {kind}, copy long, n long, node long"), "ngram-headers")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    tiles = materialise(
        texts.mapInArrow(_tiles(shingle, percent, buckets), "bucket int, tile binary, node binary")
        .repartitionById(buckets, "bucket")  # one bucket to a task
        .mapInArrow(_meet, "tile long, node long")
        .distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("tile").orderBy("node"))),
        "ngram-tiles",
    )
    nodes = materialise(tiles.select("node").distinct(), "ngram-nodes")
    bits = bitmap_bits(nodes.count())
    shared = spark.sparkContext.broadcast(hash_bitmap(nodes, "node", bits))
    # equal sets of different tasks are all there: dropped among the few that are used
    sets = materialise(texts.mapInArrow(_arrays(shared, bits, shingle), "node long, n long, bitmap binary, wide binary, items binary"), "ngram-sets")
    sketches = materialise(sets.select("node", "n", "bitmap", "wide").dropDuplicates(["node"]), "ngram-sketches")
    leaders = tiles.filter("rank = 1").select("tile", F.col("node").alias("u"))
    first = tiles.filter("rank > 1").join(leaders, "tile").groupBy(F.col("node").alias("v")).agg(F.min("u").alias("u"))
    tested = materialise(first.select("u", "v"), "ngram-tested")
    edges = materialise(_links(tested, sets, sketches, percent), "ngram-links")
    parts = connected_components(edges)
    begin, leaders = 0, LEADERS
    while True:
        placed = tiles.join(parts, "node", "left").select("tile", "node", "rank", F.coalesce("component", "node").alias("part"))
        mixed = placed.groupBy("tile").agg(F.max("rank").alias("size"), F.min("part").alias("a"), F.max("part").alias("b")).filter(f"a <> b AND size > {begin + 1}")
        open_tiles = materialise(placed.join(mixed.select("tile", "size"), "tile"), "ngram-open")
        if open_tiles.isEmpty():
            break
        pairs = _near_leaders(open_tiles, sketches, begin, leaders, percent).join(tested, ["u", "v"], "left_anti")
        pairs = materialise(pairs, "ngram-tested")
        if not pairs.isEmpty():
            more = materialise(_links(pairs, sets, sketches, percent), "ngram-links")
            tested, edges = tested.unionAll(pairs), edges.unionAll(more)
            if not more.isEmpty():
                parts = connected_components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more))
        begin, leaders = begin + leaders, leaders * 4
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = headers.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    placed = known.join(parts, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    verdict = (
        placed.join(least, "component")
        .filter("copies > 1 OR component_id <> least OR n_links > 0")
        .select("node", F.col("component").alias("group_id"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return headers.join(verdict, "node", "left").select(
        F.col("id").alias(id_col),
        F.col("copy").alias("text_hash"),
        F.col("n").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        "group_id",
    )
