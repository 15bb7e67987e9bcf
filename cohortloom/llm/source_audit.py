"""How far the sources of a language diverge, from in-mapper stripes.

Tasks fold whole documents into stripes, per language and term the document frequency and a map of
source to count, and send them on when they hold many cells and at their end. Sorted by key, the
stripes of all tasks are merged in streams. The merged stripes of frequent terms are dealt to tasks
by term; there each gives the difference of its shares between any two sources and to the whole
language. Sums over terms are exact integers, so the result does not depend on how rows are dealt.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise

from .words import LOWER, byte_table, gathered, numbers

CELLS = 1 << 20  # (term, source) cells that a task holds before it sends its stripes on
BLOCK = 512  # sources on a side of a tile of source pairs
DENSE = 1 << 21  # cells of a dense part of stripes
LETTERS = byte_table((0x61, 0x7A), (0x80, 0xFF))  # of lower-cased text
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"


class Cells(NamedTuple):
    key: np.ndarray  # term number * groups + group number
    docs: np.ndarray
    count: np.ndarray


def summed(parts: list[Cells]) -> Cells:
    key = np.concatenate([p.key for p in parts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(np.concatenate(x)[order], at) if len(at) else np.zeros(0, np.int64)
    return Cells(key[at], add([p.docs for p in parts]), add([p.count for p in parts]))


def term_column(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts ``data[offsets[i]:offsets[i + 1]]``, and the text of each."""
    data = LOWER[data]
    inside = LETTERS[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    starts[begins] = inside[begins]
    at = np.flatnonzero(starts)
    kept = np.cumsum(inside)
    bounds = np.append(kept[at] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    raw = np.ascontiguousarray(data[inside])
    column = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    return column, np.searchsorted(offsets, at, "right") - 1


class Stripes:
    """The stripes that a task holds."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self):
        self.terms: dict[str, int] = {}
        self.parts: list[Cells] = []
        self.held = 0

    def fold(self, lang: pa.Array, source: pa.Array, first: int, end: int, data: np.ndarray, offsets: np.ndarray):
        pairs = list(zip(lang[first:end].to_pylist(), source[first:end].to_pylist(), strict=True))
        group = np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], np.int64)
        column, text = term_column(data, offsets)
        coded = column.dictionary_encode()
        known = self.terms
        number = np.array([known.setdefault(t, len(known)) for t in coded.dictionary.to_pylist()], np.int64)
        term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, np.int64)
        # one cell for each document and term, then for each group and term
        key, count = np.unique(term * len(pairs) + text, return_counts=True)
        cells = Cells(key // max(1, len(pairs)) << 32 | group[key % max(1, len(pairs))], np.ones(len(key), np.int64), count)
        self.parts.append(summed([cells]))
        self.held += len(self.parts[-1].key)

    def full(self) -> bool:
        """Whether the cells fill half of what may be held after equal ones are added up."""
        if self.held > CELLS:
            self.parts = [summed(self.parts)]
            self.held = len(self.parts[0].key)
        return self.held > CELLS // 2 and len(self.parts) == 1

    def rows(self):
        """The stripes as batches, and none held any more."""
        cells = summed(self.parts) if self.parts else Cells(*[np.zeros(0, np.int64)] * 3)
        names = list(self.groups)
        langs = sorted({lang for lang, _ in names})
        lang_of = np.array([langs.index(lang) for lang, _ in names], np.int64)
        sources = pa.array([s for _, s in names], pa.string())
        terms = pa.array(list(self.terms), pa.string())
        group, term = cells.key & 0xFFFFFFFF, cells.key >> 32
        order = np.lexsort((group, lang_of[group], term)) if len(group) else np.zeros(0, np.int64)
        group, term, docs, count = group[order], term[order], cells.docs[order], cells.count[order]
        lang = lang_of[group] if len(group) else np.zeros(0, np.int64)
        stripe = term * max(1, len(langs)) + lang
        at = np.flatnonzero(np.concatenate(([True], stripe[1:] != stripe[:-1]))) if len(stripe) else np.zeros(0, np.int64)
        ends = np.append(at, len(stripe))
        df = np.add.reduceat(docs, at) if len(at) else at
        for low in range(0, len(at), 1 << 14):
            some = slice(low, low + (1 << 14))
            bounds = ends[low : low + (1 << 14) + 1]
            cut = slice(bounds[0], bounds[-1])
            lists = pa.array((bounds - bounds[0]).astype(np.int32))
            yield stripe_batch(
                pa.array(langs, pa.string()).take(pa.array(lang[at[some]])),
                terms.take(pa.array(term[at[some]])),
                df[some],
                pa.ListArray.from_arrays(lists, sources.take(pa.array(group[cut]))),
                pa.ListArray.from_arrays(lists, pa.array(count[cut])),
            )
        # groups that were seen, with or without terms: the stripe of the empty term
        own = [[s for g, s in names if g == lang] for lang in langs]
        yield stripe_batch(pa.array(langs, pa.string()), pa.array([""] * len(langs), pa.string()), np.zeros(len(langs), np.int64), pa.array(own, pa.list_(pa.string())), pa.array([[0] * len(x) for x in own], pa.list_(pa.int64())))
        self.clear()
        self.groups = {}


def stripe_batch(lang, term, df, sources, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, term, pa.array(df, pa.int64()), sources, counts], ["lang", "term", "df", "sources", "counts"])


def fold_documents(batches):
    held = Stripes()
    for batch in batches:
        for group in gathered(batch.column("text")):
            for first, end, data, offsets in group:
                held.fold(batch.column("lang"), batch.column("source"), first, end, data, offsets)
                if held.full():
                    yield from held.rows()
    if held.groups:
        yield from held.rows()


def merge_sorted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One stripe for each run of rows with equal keys."""
    lang, term = batch.column("lang"), batch.column("term")
    n = batch.num_rows
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    lists = batch.column("sources")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    wide = max(1, len(names))
    key, where = np.unique(np.repeat(run, sizes) * wide + code, return_inverse=True)
    counts = np.zeros(len(key), np.int64)
    np.add.at(counts, where, pc.list_flatten(batch.column("counts")).to_numpy(zero_copy_only=False))
    bounds = pa.array(np.searchsorted(key, np.arange(len(at) + 1) * wide).astype(np.int32))
    first = pa.array(at)
    return stripe_batch(
        lang.take(first),
        term.take(first),
        np.add.reduceat(numbers(batch.column("df")), at),
        pa.ListArray.from_arrays(bounds, names.take(pa.array(key % wide))),
        pa.ListArray.from_arrays(bounds, pa.array(counts)),
    )


def merger(min_df: int):
    def merge(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            merged = merge_sorted(batch)
            done, rest = merged.slice(0, merged.num_rows - 1), merged.slice(merged.num_rows - 1)
            yield kept(done)
        if rest is not None:
            yield kept(rest)

    def kept(rows):
        return rows.filter(pc.or_(pc.greater_equal(rows.column("df"), min_df), pc.equal(rows.column("term"), "")))

    return merge


def shares(count: np.ndarray, total, scale: int = 10**9, add: int = 5):
    """1 + floor(scale * (count + add) / total) without overflow; a scale of 10**9 is taken in
    three steps of long division where one product might not fit."""
    left = count + add
    if not left.size or int(left.max()) < (1 << 63) // scale:
        return 1 + left * scale // total
    out = np.zeros(np.broadcast(left, total).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return 1 + out


def divergences(top: int):
    """Partial results of one task. Rows come by language, first the language's sources."""

    def emit(batches):
        now = None
        for batch in batches:
            lang = batch.column("lang")
            code = lang.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            tile = numbers(batch.column("tile"))
            cuts = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (tile[1:] != tile[:-1])))) if len(code) else []
            for low, high in zip(cuts, [*cuts[1:], len(code)], strict=True):
                part = batch.slice(low, high - low)
                if tile[low] < 0:  # the language itself; one row, or more alike
                    if now is not None:
                        yield from now.pairs()
                    now = Language(part, top)
                else:
                    yield from now.take(int(tile[low]), part)
        if now is not None:
            yield from now.pairs()

    return emit


class Language:
    """The sources of one language, their totals, and the sums over the terms of one tile of
    source pairs."""

    def __init__(self, row: pa.RecordBatch, top: int):
        self.top, self.lang = top, row.column("lang")[0].as_py()
        self.names = row.column("sources").slice(0, 1).flatten()
        total = row.column("counts").slice(0, 1).flatten().to_numpy(zero_copy_only=False)
        terms = row.column("v")[0].as_py()
        self.total = total + 5 * terms
        self.whole = int(total.sum()) + 5 * terms
        blocks = -(-len(self.names) // BLOCK)
        self.tiles = [(i, j) for i in range(blocks) for j in range(i, blocks)]
        self.tile, self.sums = -1, None

    def take(self, tile: int, part: pa.RecordBatch):
        if tile != self.tile:
            yield from self.pairs()
            self.tile = tile
        if tile >= len(self.tiles):
            return
        lists = part.column("sources")
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        source = pc.index_in(lists.flatten(), self.names).to_numpy(zero_copy_only=False).astype(np.int64)
        count = part.column("counts").flatten().to_numpy(zero_copy_only=False)
        if tile == 0:
            yield from self.terms(part.column("term"), row, source, count)
        left, right = (np.arange(k * BLOCK, min((k + 1) * BLOCK, len(self.names))) for k in self.tiles[tile])
        if self.sums is None:
            self.sums = np.zeros((len(left), len(right)), np.int64)
        step = max(1, DENSE // max(len(left), len(right)))
        for low in range(0, len(lists), step):
            own = slice(*np.searchsorted(row, [low, low + step]))
            rows = min(step, len(lists) - low)
            a, b = (self.dense(side, rows, row[own] - low, source[own], count[own]) for side in (left, right))
            for i in range(len(left)):
                self.sums[i] += np.abs(b - a[:, i : i + 1]).sum(0)

    def dense(self, side, rows, row, source, count):
        out = np.zeros((rows, len(side)), np.int64)
        inner = (source >= side[0]) & (source <= side[-1])
        out[row[inner], source[inner] - side[0]] = count[inner]
        return shares(out, self.total[side])

    def terms(self, term, row, source, count):
        """The terms furthest above the language's share, of each source the first ``top``."""
        n = len(term)
        whole = np.add.reduceat(count, np.searchsorted(row, np.arange(n)))  # every stripe has a source
        share = shares(whole, np.int64(self.whole))
        value = shares(count, self.total[source]) - share[row]
        above = np.flatnonzero((value > 0) & (count > 0))
        place = np.empty(n, np.int64)
        place[pc.array_sort_indices(term).to_numpy()] = np.arange(n)
        above = above[np.lexsort((place[row[above]], -value[above], source[above]))]
        own = source[above]
        above = above[np.arange(len(own)) - np.searchsorted(own, own) < self.top]
        yield self.batch("term", source[above], term.take(pa.array(row[above])), value[above])

    def pairs(self):
        if self.sums is not None:
            left, right = (k * BLOCK for k in self.tiles[self.tile])
            a, b = np.nonzero(np.ones_like(self.sums, bool) if left != right else np.triu(np.ones_like(self.sums, bool), 1))
            for low in range(0, len(a), 1 << 16):
                i, j = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
                yield self.batch("pair", i + left, self.names.take(pa.array(j + right)), self.sums[i, j])
        self.sums = None

    def batch(self, part, source, item, value):
        n = len(value)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * n, pa.string()), self.names.take(pa.array(source)), pa.array([part] * n, pa.string()), item.cast(pa.string()), pa.array(value)],
            ["lang", "source", "part", "item", "value"],
        )


def source_divergence(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_df: int = 30,
    top: int = 50,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how each (lang, source) group differs.

    Terms are runs of letters (A-Z lower-cased, and all characters beyond ASCII) that occur in
    ``min_df`` documents of the language at least. A group's share of a term, in billionths, is
    1 + floor(10**9 * (count + 5) / (N + 5 * V)), N its occurrences of the V terms of the
    language. Part ``pair`` has the sum over terms of the absolute difference to each other source
    of the language; part ``term`` the ``top`` terms that occur in the group and whose share is
    furthest above that of the whole language. Ranks go by value, then by the item's bytes.

    Null language, source and text are empty; groups without text or terms have pairs as well,
    of value 0 where the language has no terms. Repeated rows are documents of their own. An empty
    table gives an empty result. Other columns are not looked at. Pairs of sources are as many as
    the result has; a task holds the sums of ``BLOCK`` x ``BLOCK`` of them.
    """
    spark = docs.sparkSession
    text = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    rows = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    key = ["lang", "term"]
    partial = rows.mapInArrow(fold_documents, STRIPE)
    # a key has one row of each task that spills once, few against the rows of a merging task
    merged = materialise(partial.repartition(*key).sortWithinPartitions(*key).mapInArrow(merger(min_df), STRIPE), "audit-stripes")

    terms = merged.filter("term <> ''")
    cells = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", "c.sources", "c.counts")
    seen = merged.filter("term = ''").select("lang", F.explode("sources").alias("sources"), F.lit(0).cast("long").alias("counts"))
    totals = seen.unionAll(cells).groupBy("lang", "sources").agg(F.sum("counts").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("sources", "n")))
    langs = materialise(
        totals.groupBy("lang").agg(ordered.alias("g")).join(sizes, "lang", "left").select("lang", F.col("g.sources").alias("sources"), F.col("g.n").alias("counts"), F.coalesce("v", F.lit(0)).alias("v")),
        "audit-groups",
    )
    most = langs.agg(F.max(F.size("sources"))).first()[0] or 0
    blocks = -(-most // BLOCK)
    tiles = blocks * (blocks + 1) // 2
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["task", "lang", "tile", "term", "sources", "counts", "v"]
    heads = langs.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "lang", F.lit(-1).alias("tile"), F.lit("").alias("term"), "sources", "counts", "v")
    dealt = terms.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(max(tiles - 1, 0)))))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("lang", "term", "tile"), F.lit(tasks)).cast("int")).withColumn("v", F.lit(0).cast("long"))
    spread = heads.select(columns).unionAll(dealt.select(columns)).repartitionById(tasks, "task").sortWithinPartitions("lang", "tile").drop("task")
    found = materialise(spread.mapInArrow(divergences(top), "lang string, source string, part string, item string, value long"), "audit-parts")

    # each pair once, its smaller source first, also where no term tells them apart
    first = langs.select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode(F.filter("sources", lambda x: x > F.col("source"))).alias("item"))
    pairs = found.filter("part = 'pair'").select("lang", "source", "item", "value").unionAll(first.withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p")
    pairs = pairs.select("lang", both, "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    ranked = found.filter("part = 'term'").select("lang", "source", "part", "item", "value", place).filter(F.col("rank") <= top)
    return pairs.select("*", place).unionAll(ranked)
