"""Removal of passages that repeat across documents.

Every window of ``window`` words gets a Rabin-Karp hash. A window is removed from a document
if its word sequence also starts in a document with a smaller id. What is shuffled are packed
blocks: windows are dealt to buckets by the least hash of the half-length windows inside them,
a value that equal windows share and neighbouring windows mostly do too, so that document and
position cost little beside the 8 bytes of the hash.

A bucket is worked off as a stream: of each hash only the occurrences in the smallest document
seen so far are held, all others are losers at once. So a passage that a third of the
documents share costs a bucket no memory, and each task sends its own winners only. The number
of buckets follows the bytes of the corpus.

Two windows count as equal if bucket and 64-bit hash are equal; the bucket adds log2(buckets)
bits, which keeps the chance of one false match per million windows at about 3e-8.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACED, Tokenizer, U, binary_slices, bounds_of, gathered, inside_text, mix, numbers, string_buffers

BUCKET_BYTES = 12 << 20  # text bytes per bucket: about 2 million windows
HOLD = 1 << 20  # windows held before a merge
BLOCKS = "bucket int, lost boolean, doc binary, copy binary, pos binary, hash binary"
LOST = "doc long, copy long, runs binary"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _losers(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and for that order: does a smaller document hold the hash?"""
    order = np.argsort(hashes, kind="stable")
    bounds = bounds_of(hashes[order])
    held = docs[order]
    if not len(held):
        return order, np.zeros(0, bool)
    least = np.minimum.reduceat(held, bounds[:-1])
    return order, held != np.repeat(least, np.diff(bounds))


def _blocks(window: int, buckets: int):
    half = window // 2

    def run(batches):
        tokens = Tokenizer(SPACED, lower=False)
        spread = 0
        for batch in batches:
            ids, copies = numbers(batch.column("id")), numbers(batch.column("copy"))
            for part in gathered(batch.column("text")):
                found = []
                for low, high, data, offsets in part:
                    words = tokens.split(data, offsets)
                    at, text = inside_text(words.first, window)
                    if not len(at):
                        continue
                    inner = tokens.rolling(words.hashes, max(half, 1))
                    anchors = _least(inner, window - max(half, 1) + 1)[at]
                    bucket = (((mix(anchors) >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)
                    pos = (at - words.first[text]).astype(np.int32)
                    found.append((tokens.rolling(words.hashes, window)[at], bucket, ids[low:high][text], copies[low:high][text], pos))
                if not found:
                    continue
                hashes, bucket, doc, copy, pos = (np.concatenate(x) for x in zip(*found))
                del found
                order, lost = _losers(hashes, doc)
                losers = np.sort(order[lost])
                if len(losers):
                    # settled here: passed on as they are, to any bucket
                    spread += 1
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array([(spread * 7919 + int(doc[0])) % buckets], pa.int32()),
                            "lost": [True],
                            "doc": [doc[losers].tobytes()],
                            "copy": [copy[losers].tobytes()],
                            "pos": [pos[losers].tobytes()],
                            "hash": [b""],
                        }
                    )
                winners = np.sort(order[~lost])
                winners = winners[np.argsort(bucket[winners].astype(np.uint16 if buckets < 1 << 16 else np.int32), kind="stable")]
                edges = bounds_of(bucket[winners])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[winners[edges[:-1]]], pa.int32()),
                        pa.array(np.zeros(len(edges) - 1, bool)),
                        binary_slices(doc[winners], edges),
                        binary_slices(copy[winners], edges),
                        binary_slices(pos[winners], edges),
                        binary_slices(hashes[winners], edges),
                    ],
                    ["bucket", "lost", "doc", "copy", "pos", "hash"],
                )

    return run


def _runs(doc, copy, pos):
    """Rows (doc, copy, runs of consecutive window starts) of unordered positions."""
    order = np.lexsort((pos, copy, doc))
    doc, copy, pos = doc[order], copy[order], pos[order]
    fresh = np.ones(len(doc), bool)
    same = (doc[1:] == doc[:-1]) & (copy[1:] == copy[:-1])
    fresh[1:] = ~(same & (pos[1:] <= pos[:-1] + 1))
    start = np.flatnonzero(fresh)
    stop = np.concatenate((start[1:], [len(doc)])) - 1
    pairs = np.empty((len(start), 2), np.int32)
    pairs[:, 0], pairs[:, 1] = pos[start], pos[stop] + 1
    row = np.ones(len(start), bool)
    row[1:] = (doc[start[1:]] != doc[start[:-1]]) | (copy[start[1:]] != copy[start[:-1]])
    rows = np.flatnonzero(row)
    edges = np.concatenate((rows, [len(start)])) * 2
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[start[rows]]), pa.array(copy[start[rows]]), binary_slices(pairs.reshape(-1), edges)],
        ["doc", "copy", "runs"],
    )


def _settle(batches):
    """Streams buckets, one after the other; yields the windows that a smaller document also holds."""
    held = waiting = None
    bucket, size = None, 0

    def merge():
        nonlocal held, waiting, size
        parts = ([held] if held is not None else []) + waiting
        doc, copy, pos, hashes = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order, lost = _losers(hashes, doc)
        kept = order[~lost]
        held, waiting, size = (doc[kept], copy[kept], pos[kept], hashes[kept]), [], 0
        gone = order[lost]
        return _runs(doc[gone], copy[gone], pos[gone]) if len(gone) else None

    for batch in batches:
        for i in range(batch.num_rows):
            doc = np.frombuffer(batch.column("doc")[i].as_py(), np.int64)
            copy = np.frombuffer(batch.column("copy")[i].as_py(), np.int64)
            pos = np.frombuffer(batch.column("pos")[i].as_py(), np.int32)
            if batch.column("lost")[i].as_py():
                yield _runs(doc, copy, pos)
                continue
            now = batch.column("bucket")[i].as_py()
            if now != bucket:
                if size and (out := merge()) is not None:
                    yield out
                bucket, held, waiting, size = now, None, [], 0
            waiting.append((doc, copy, pos, np.frombuffer(batch.column("hash")[i].as_py(), np.uint64)))
            size += len(doc)
            if size >= HOLD + (len(held[0]) if held is not None else 0) and (out := merge()) is not None:
                yield out
    if size and (out := merge()) is not None:
        yield out


def _cut(window: int):
    def run(batches):
        from itertools import compress

        for batch in batches:
            found = batch.column("runs").to_pylist()
            data, offsets = string_buffers(batch.column("text"))
            counts, spans, kept = [], [], []
            for i, lists in enumerate(found):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                counts.append(len(words))
                if not lists:
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                pairs = np.concatenate([np.frombuffer(x, np.int32) for x in lists]).reshape(-1, 2)
                turns = np.zeros(len(words) + 1, np.int32)
                np.add.at(turns, pairs[:, 0], 1)
                np.add.at(turns, pairs[:, 1] + window - 1, -1)
                keep = np.cumsum(turns[:-1]) == 0
                change = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in change.reshape(-1, 2)])
                kept.append(b" ".join(compress(words, keep)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["id", "n_words", "removed", "kept"],
            )

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Per row: ``id_col``, n_words, removed (maximal intervals of word numbers, end exclusive)
    and kept (the other words, joined by one space).

    Words are runs of bytes other than space and \\t to \\r. Null text has no words, texts
    shorter than a window keep all. Rows with a null id keep all and compare with none. Rows
    that share an id never remove from each other, whether their texts are equal or not. Other
    columns are not looked at. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    lost = (
        rows.filter("id IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(_blocks(window, buckets), BLOCKS)
        .repartitionById(buckets, "bucket")  # one bucket to a task
        .mapInArrow(_settle, LOST)
    )
    runs = lost.groupBy("doc", "copy").agg(F.collect_list("runs").alias("runs"))
    return (
        rows.join(runs, (F.col("id") == F.col("doc")) & (rows["copy"] == runs["copy"]), "left")
        .select("id", "text", "runs")
        .mapInArrow(_cut(window), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, removed array<struct<start:int,end:int>>, kept string")
        .withColumnRenamed("id", id_col)
    )
