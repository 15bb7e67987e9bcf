"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item (a shorter item is one window); its tokens
are its shingles of ``shingle`` words. Containment asks for every token, so the prefix that
must occur in a document is one token: the one that is rarest over all documents. The rarest
tokens are found in the documents, each occurrence with the words around it is joined with
the windows of that token, positions outside the document are cut off by offset and length,
and the words are compared one by one.

Documents are read twice and never shuffled: what leaves a scan are counts of benchmark tokens,
then occurrences of prefix tokens and one row of counts per document. Scans look tokens up in a
bitmap of at most 16 MB; the join behind it makes the result exact for a benchmark of any size.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

from .bitmaps import bitmap_bits, hash_bitmap, in_bitmap
from .words import ALNUM, Tokenizer, inside_text, numbers, slices

WINDOWS = "w1 long, w2 long, n int, item string, words string, tokens array<long>"
FOUND = "id {id}, copy long, n_words long, token long, pos long, from long, around string"


def _item_windows(window: int, shingle: int):
    def run(batches):
        tokens = Tokenizer(ALNUM, lower=True)
        for batch in batches:
            items = batch.column("item").to_pylist()
            rows = []
            for low, high, data, offsets in slices(batch.column("text")):
                words = tokens.split(data, offsets)
                text = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
                for i in range(high - low):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    n = min(window, b - a)
                    k = min(shingle, n)
                    if not n:
                        continue
                    hashes = words.hashes[a:b]
                    one, two = tokens.rolling(hashes, n), tokens.rolling(hashes ^ np.uint64(0x5BD1E995), n)
                    parts = tokens.rolling(hashes, k).astype(np.int64)
                    for s in range(b - a - n + 1):
                        rows.append((int(one[s].astype(np.int64)), int(two[s].astype(np.int64)), n, items[low + i], " ".join(text[a + s : a + s + n]), parts[s : s + n - k + 1].tolist()))
            if rows:
                w1, w2, n, item, text, parts = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(n, pa.int32()), pa.array(item, pa.string()), pa.array(text, pa.string()), pa.array(parts, pa.list_(pa.int64()))],
                    ["w1", "w2", "n", "item", "words", "tokens"],
                )

    return run


def _tokens_of(tokens: Tokenizer, words, lengths):
    """(length, numbers of first words, texts, hashes) of all shingles inside texts."""
    for k in lengths:
        at, text = inside_text(words.first, k)
        if len(at):
            yield k, at, text, tokens.rolling(words.hashes, k)[at]


def _count(shared, bits: int, lengths):
    def run(batches):
        tokens = Tokenizer(ALNUM, lower=True)
        for batch in batches:
            seen = [np.zeros(0, np.uint64)]
            for _, _, data, offsets in slices(batch.column("text")):
                for _, _, _, hashes in _tokens_of(tokens, tokens.split(data, offsets), lengths):
                    seen.append(hashes[in_bitmap(shared.value, bits, hashes)])
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["token", "n"])

    return run


def _find(shared, bits: int, lengths, window: int):
    def run(batches):
        tokens = Tokenizer(ALNUM, lower=True)
        for batch in batches:
            ids, copies = batch.column("id"), numbers(batch.column("copy"))
            for low, high, data, offsets in slices(batch.column("text")):
                words = tokens.split(data, offsets)
                counts = np.diff(words.first)
                rows, token, pos, begin, around = [np.arange(low, high)], [], [], [], []
                for _, at, text, hashes in _tokens_of(tokens, words, lengths):
                    hit = np.flatnonzero(in_bitmap(shared.value, bits, hashes))
                    at, text = at[hit], text[hit]
                    left = np.maximum(at - window + 1, words.first[text])
                    right = np.minimum(at + window, words.first[text + 1])
                    raw = words.data.tobytes() if len(hit) else b""
                    for a, b in zip(left, right):
                        around.append(b" ".join([raw[s:e] for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())]))
                    rows.append(text + low)
                    token.append(hashes[hit].astype(np.int64))
                    pos.append(at - words.first[text])
                    begin.append(left - words.first[text])
                row = np.concatenate(rows)
                plain, found = high - low, len(row) - (high - low)
                none = np.arange(len(row)) < plain
                fill = lambda parts: pa.array(np.concatenate([np.zeros(plain, np.int64), *parts]).astype(np.int64), mask=none)
                assert found == len(around)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row)),
                        pa.array(copies[row]),
                        pa.array(counts[row - low].astype(np.int64)),
                        fill(token),
                        fill(pos),
                        fill(begin),
                        pa.array([None] * plain + around, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "copy", "n_words", "token", "pos", "from", "around"],
                )

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, text_hash, n_words, n_hit (words inside an occurring window), hits
    (start and end of each occurring window, in words, sorted) and items (ids of the items with
    an occurring window, as strings, sorted).

    Words are lower-cased runs of a-z, 0-9 and non-ASCII characters. Null or empty text has no
    words. Items with a null id or no words have no windows; an item id on several rows counts
    once. Rows of ``docs`` that share an id are judged each by its own text; null ids stay null.
    Empty tables on either side give no hits. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    texts = rows.select("text")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    windows = materialise(
        items.mapInArrow(_item_windows(window, shingle), WINDOWS)
        .groupBy("w1", "w2", "n")
        .agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("words").alias("words"), F.first("tokens").alias("tokens")),
        "bench-windows",
    )
    lengths = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect())  # 1..shingle
    vocabulary = materialise(windows.select(F.explode("tokens").alias("token")).distinct(), "bench-tokens")
    bits = bitmap_bits(vocabulary.count())
    shared = spark.sparkContext.broadcast(hash_bitmap(vocabulary, "token", bits))
    frequency = texts.mapInArrow(_count(shared, bits, lengths), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # a window with a token that no document has cannot occur
    rarest = (
        windows.select("w1", "w2", "n", F.posexplode("tokens").alias("off", "token"))
        .join(frequency.withColumnRenamed("n", "seen"), "token", "left")
        .groupBy("w1", "w2", "n")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "off")).alias("rare"))
        .filter("rare.seen > 0")
    )
    prefix = materialise(
        rarest.join(windows, ["w1", "w2", "n"])
        .groupBy(F.col("rare.token").alias("token"))
        .agg(F.collect_list(F.struct(F.col("rare.off").alias("off"), "n", "words", "items")).alias("entries")),
        "bench-prefix",
    )
    bits = bitmap_bits(prefix.count())
    shared = spark.sparkContext.broadcast(hash_bitmap(prefix, "token", bits))
    found = materialise(rows.mapInArrow(_find(shared, bits, lengths, window), FOUND.format(id=rows.schema["id"].dataType.simpleString())), "bench-found")
    matches = (
        found.filter("token IS NOT NULL")
        .withColumn("around", F.split("around", " "))
        .join(prefix, "token")
        .select(
            "id",
            "copy",
            F.expr(
                "filter(transform(entries, e -> struct(pos - e.off AS start, pos - e.off + e.n AS end, e.words AS words, e.items AS items)),"
                " m -> m.start >= 0 AND m.end <= n_words"
                " AND array_join(slice(around, CAST(m.start - `from` + 1 AS INT), CAST(m.end - m.start AS INT)), ' ') = m.words)"
            ).alias("m"),
        )
        .filter("size(m) > 0")
        .groupBy("id", "copy")
        .agg(F.flatten(F.collect_list("m")).alias("m"))
        .select(
            "id",
            "copy",
            F.expr("array_sort(array_distinct(transform(m, x -> struct(x.start, x.end))))").alias("hits"),
            F.expr("array_sort(array_distinct(flatten(transform(m, x -> x.items))))").alias("items"),
        )
    )
    a, b = found.filter("token IS NULL").alias("a"), matches.alias("b")
    covered = F.expr(
        "aggregate(hits, struct(0L AS n, 0L AS last), (s, x) -> struct("
        "s.n + greatest(0L, x.end - greatest(x.start, s.last)) AS n, greatest(s.last, x.end) AS last), s -> s.n)"
    )
    return (
        a.join(b, F.expr("a.id <=> b.id AND a.copy = b.copy"), "left")
        .select(
            F.col("a.id").alias(id_col),
            F.col("a.copy").alias("text_hash"),
            "n_words",
            F.coalesce("hits", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")).alias("hits"),
            F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
        )
        .withColumn("n_hit", covered)
    )
