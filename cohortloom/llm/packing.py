"""Packing token sequences: shortest pack first over the histogram of lengths.

Documents are tokenised once, and cut into pieces of ``size`` tokens and a shorter last one. The
plan is made from the histogram of piece lengths alone, at most ``size`` counts: lengths are
placed longest first, each into the packs with the most room, and equal packs are one pattern
with a count. A pattern that would be padded by more than ``slack`` tokens keeps the largest power
of two of its tokens, which needs no padding; what lies beyond goes back into the histogram, and
the placing is repeated. What is left at least halves each time. Pieces then meet their pattern by
length and rank within the length; ranks come from counts per task, so no length is ever in one
task.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import materialise

from .words import SPACED, gathered, numbers

WORDS_KEPT = 1 << 19  # words whose ids a Python worker remembers; it starts anew beyond
PIECES = 1 << 12  # pieces that leave a task together


class Plan(NamedTuple):
    """Rules, in order of (turn, length, first): the ``n`` pieces of ``length`` tokens from rank
    ``first`` on are dealt to packs, ``each`` to a pack. A piece leaves its first ``keep`` tokens
    in sequence ``sequence`` + pack at ``offset`` + place in the pack * length; the others are a
    piece of the next turn, whose ranks begin with ``onward``."""

    turn: np.ndarray
    length: np.ndarray
    first: np.ndarray
    n: np.ndarray
    each: np.ndarray
    keep: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    onward: np.ndarray
    sequences: int


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (packs alike, [(length, pieces of that length in a pack), ...]) that hold
    ``counts[length]`` pieces of each length, at most ``size`` tokens to a pack."""
    room: list[list] = [[] for _ in range(size + 1)]  # patterns by the tokens they still take
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in range(size - 1, length - 1, -1):  # the shortest packs first
            waiting, room[free] = room[free], []
            while waiting and left:
                packs, runs = waiting.pop()
                each = free // length
                full = min(packs, left // each)
                rest = min(left - full * each, each - 1) if full < packs else 0
                left -= full * each + rest
                for some, many in ((full, each), (1 if rest else 0, rest), (packs - full - (1 if rest else 0), 0)):
                    if some:
                        room[free - many * length].append((some, runs + [(length, many)] if many else runs))
            room[free] += waiting
            if not left:
                break
        each = size // length
        for some, many in ((left // each, each), (1, left % each)):
            if some and many:
                room[size - many * length].append((some, [(length, many)]))
    return [pattern for patterns in room for pattern in patterns]


def make_plan(counts: dict[int, int], size: int, slack: int) -> Plan:
    """The plan for pieces of 1 to ``size`` tokens."""
    rules, turn, sequence = [], 0, 0
    counts = {int(length): int(n) for length, n in counts.items()}
    while counts := {length: n for length, n in counts.items() if n}:
        given: dict[int, int] = {}  # ranks of each length given to patterns so far
        onward: dict[int, int] = {}

        def rule(length, packs, each, keep, at, rest):
            first = given.get(length, 0)
            given[length] = first + packs * each
            rank = onward.get(rest, 0)
            if rest:
                onward[rest] = rank + packs * each
            rules.append((turn, length, first, packs * each, each, keep, sequence, at, rank))

        for packs, runs in shortest_pack_first(counts, size):
            total = sum(length * each for length, each in runs)
            end = total if size - total <= slack else 1 << (total.bit_length() - 1)
            at = 0
            for length, each in runs:
                whole = min(each, max(0, end - at) // length)
                if whole:
                    rule(length, packs, whole, length, at, 0)
                    at += whole * length
                if whole < each and at < end:
                    rule(length, packs, 1, end - at, at, at + length - end)
                    at, whole = at + length, whole + 1
                if whole < each:
                    rule(length, packs, each - whole, 0, at, length)
                    at += (each - whole) * length
            sequence += packs
        counts, turn = onward, turn + 1
    columns = np.array(rules, np.int64).reshape(-1, 9).T
    order = np.lexsort((columns[2], columns[1], columns[0]))
    return Plan(*columns[:, order], sequence)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray):
    """(number of the piece, start in it, length, sequence, offset) of what pieces leave in
    sequences, for pieces with the given lengths and ranks."""
    piece, start = np.arange(len(length)), np.zeros(len(length), np.int64)
    found = []
    bounds = np.searchsorted(plan.turn, np.arange(plan.turn[-1] + 2)) if len(plan.turn) else [0]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        # rules of one turn, in order of (length, first): the last one at or before the piece
        lengths, firsts = plan.length[low:high], plan.first[low:high]
        wide = int(firsts.max()) + 1
        if len(rank):
            wide = max(wide, int(rank.max()) + 1)
        at = low + np.searchsorted(lengths * wide + firsts, length * wide + rank, "right") - 1
        inner = rank - plan.first[at]
        pack, place_in = inner // plan.each[at], inner % plan.each[at]
        keep = plan.keep[at]
        stays = keep > 0
        found.append((piece[stays], start[stays], keep[stays], (plan.sequence[at] + pack)[stays], (plan.offset[at] + place_in * length)[stays]))
        goes = keep < length
        piece, start, length = piece[goes], (start + keep)[goes], (length - keep)[goes]
        rank = (plan.onward[at] + inner)[goes]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5


LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
MARK = np.zeros(256, bool)  # printable ASCII but letters
MARK[0x21:0x7F] = True
MARK &= ~LETTER
BAR, QUOTE = ord("|"), ord("'")


def cut_words(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets of words, number of the first word of each text) of the texts
    ``data[offsets[i]:offsets[i + 1]]``: runs without white space, lower-cased for A-Z and cut
    between letters and ASCII marks, but not after a quote. Runs with a bar may hold the name of
    a special token and stay as they are."""
    inside = SPACED[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts &= inside
    runs = np.flatnonzero(starts)
    barred = np.zeros(len(data), bool)
    if len(runs) and (data == BAR).any():
        has = np.maximum.reduceat((data == BAR) & inside, runs)
        barred = np.repeat(has, np.diff(np.append(runs, len(data))))
        barred = np.concatenate((np.zeros(runs[0], bool), barred))
    data = np.where(LETTER[data] & ~barred, data | 0x20, data)
    letter, mark = LETTER[data], MARK[data]
    accented = np.zeros(len(data), bool)  # letters from U+00C0 to U+00FF
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data), bool)
    cut[1:] = ((letter | accented)[:-1] & mark[1:]) | (mark[:-1] & (data[:-1] != QUOTE) & letter[1:])
    starts |= cut & inside & ~barred
    kept = np.cumsum(inside)
    at = np.flatnonzero(starts)
    words = np.append(kept[at] - 1, kept[-1] if len(kept) else 0)
    return data[inside], words, np.searchsorted(at, offsets)


class WordIds:
    """Ids of words, each tokenised once as long as it is remembered."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.clear()

    def clear(self):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def add(self, words: list[bytes]) -> None:
        """Words of ASCII letters are single words for the model; all others take the whole way,
        joined by spaces, and their tokens are told apart by where they start."""
        plain = [w.isalpha() and w.isascii() for w in words]
        others = [w.decode() for w, p in zip(words, plain, strict=True) if not p]
        coded = self.tokenizer.encode(" ".join(others), add_special_tokens=False)
        begins = np.cumsum([0] + [len(w) + 1 for w in others])
        owner = np.searchsorted(begins, np.array([o[0] for o in coded.offsets], np.int64), "right") - 1
        ids, bounds, k = coded.ids, np.searchsorted(owner, np.arange(len(others) + 1)).tolist(), 0
        flat, lengths = [], []
        for word, is_plain in zip(words, plain, strict=True):
            if is_plain:
                own = [t.id for t in self.model.tokenize(word.decode())]
            else:
                own, k = ids[bounds[k] : bounds[k + 1]], k + 1
            self.numbers[word] = len(self.numbers)
            flat += own
            lengths.append(len(own))
        n = len(self.numbers)
        if n + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros(max(n, len(self.starts)), np.int64)))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(flat), len(self.ids)), np.uint32)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[n - len(words) + 1 : n + 1] = self.used + np.cumsum(lengths)
        self.used += len(flat)

    def texts(self, data: np.ndarray, offsets: np.ndarray, end: int):
        """(ids of all texts one after the other, bounds of the texts); each text ends with ``end``."""
        raw, bounds, first = cut_words(data, offsets)
        n = len(bounds) - 1
        column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.numbers) + len(words) > WORDS_KEPT:
            self.clear()
        known = self.numbers
        if new := [w for w in words if w not in known]:
            self.add(new)
        word = np.fromiter((known[w] for w in words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.starts[word + 1] - self.starts[word]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        texts = ends[first] + np.arange(len(first))  # with one more id at the end of each
        ids = np.full(ends[-1] + len(first) - 1, end, np.uint32)
        inner = np.ones(len(ids), bool)
        inner[texts[1:] - 1] = False
        ids[inner] = self.ids[np.repeat(self.starts[word] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, texts


class WholeTexts:
    """Ids of whole texts, for tokenizers that look at more than one word."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def texts(self, data: np.ndarray, offsets: np.ndarray, end: int):
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ids = [np.array(x.ids + [end], np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)


def pack_documents(
    docs: DataFrame,
    *,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end: int = 1,
    slack: int | None = None,
    by_word: bool = False,
) -> DataFrame:
    """Per piece: ``id_col``, start (ids of its document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id (from 0, without gaps) and offset in the sequence.

    ``tokenizer`` is the file of a tokenizer; each document's ids are those of its whole text, no
    special tokens added, and ``end``. Each id is in one piece, pieces fill a sequence from 0 on
    without gaps, and no sequence holds more than ``size`` ids. A sequence lacks at most
    ``slack`` ids (by default a hundredth of ``size``) or its length is a power of two.

    ``by_word`` may be set where the tokenizer drops white space and case and joins nothing across
    it, nor letters with other signs: each word is then tokenised once.

    Null and empty texts have the id ``end`` alone. Null ids, repeated ids and repeated rows are
    documents like others. An empty table gives an empty result. Other columns are not looked at.
    """
    if size & (size - 1):
        raise ValueError("the size of a sequence has to be a power of two")
    slack = size // 100 if slack is None else slack
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType
    long = T.LongType()
    fields = [("part", T.IntegerType()), ("id", kind), ("start", long), ("length", long), ("doc_tokens", long), ("rank", long), ("ids", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def tokenise(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        part = TaskContext.get().partitionId()
        # the worker's later tasks know the words of its earlier ones
        kept = tokenizers.__dict__.setdefault("_words_of_tokenizers", {})
        key = (hash(model.value), by_word)
        coder = kept[key][0] if key in kept and kept[key][1] == model.value else None
        if coder is None:
            coder = (WordIds if by_word else WholeTexts)(tokenizers.Tokenizer.from_str(model.value))
            kept.clear()
            kept[key] = (coder, model.value)
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            column = batch.column("id")
            for group in gathered(batch.column("text")):
                for row, end_row, data, offsets in group:
                    ids, bounds = coder.texts(data, offsets, end)
                    total = np.diff(bounds)
                    pieces = -(-total // size)
                    owner = np.repeat(np.arange(end_row - row), pieces)
                    start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                    length = np.minimum(total[owner] - start, size)
                    order = np.argsort(length, kind="stable")
                    sorted_length = length[order]
                    rank = np.zeros(len(owner), np.int64)
                    rank[order] = seen[sorted_length] + np.arange(len(order)) - np.searchsorted(sorted_length, sorted_length)
                    seen += np.bincount(length, minlength=size + 1)
                    for low in range(0, len(owner), PIECES):
                        cut = slice(low, low + PIECES)
                        at = np.append(bounds[owner[cut]] + start[cut], (bounds[owner[cut]] + start[cut] + length[cut])[-1:])
                        raw = np.ascontiguousarray(ids[at[0] : at[-1]])  # pieces follow each other
                        binary = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(((at - at[0]) * 4).astype(np.int32)), pa.py_buffer(raw)])
                        n = len(at) - 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, part, np.int32)), column.take(pa.array(row + owner[cut])), *(pa.array(x[cut]) for x in (start, length, total[owner], rank)), binary],
                            [f[0] for f in fields],
                        )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(narrow.mapInArrow(tokenise, schema), "pack-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # one row for each length that occurs, `size` at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(make_plan(histogram, size, slack)._asdict())
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")

    out_fields = [(id_col, kind), ("start", long), ("length", long), ("ids", T.BinaryType()), ("doc_tokens", long), ("sequence_id", long), ("offset", long)]
    out_schema = T.StructType([T.StructField(*f) for f in out_fields])

    def lay(batches):
        rules = Plan(**plan.value)
        for batch in batches:
            lengths = numbers(batch.column("length"))
            raw = batch.column("ids")
            piece, start, length, sequence, offset = place(rules, lengths, numbers(batch.column("rank")))
            order = np.lexsort((start, piece))
            piece, start, length, sequence, offset = (x[order] for x in (piece, start, length, sequence, offset))
            for low in range(0, len(piece), PIECES):
                cut = slice(low, low + PIECES)
                # what a piece leaves in sequences follows each other in its bytes
                _, ends, data = raw.buffers()
                base = np.frombuffer(ends, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
                begin = base[piece[cut]] + 4 * start[cut]
                at = np.append(begin, (begin + 4 * length[cut])[-1:])
                binary = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((at - at[0]).astype(np.int32)), data.slice(int(at[0]), int(at[-1] - at[0]))])
                own = pa.array(piece[cut])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(own),
                        pa.array(numbers(batch.column("start"))[piece[cut]] + start[cut]),
                        pa.array(length[cut]),
                        binary,
                        batch.column("doc_tokens").take(own),
                        pa.array(sequence[cut]),
                        pa.array(offset[cut]),
                    ],
                    [f[0] for f in out_fields],
                )

    return ranked.mapInArrow(lay, out_schema)
