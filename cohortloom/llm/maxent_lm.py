"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

log P(text) = sum over tokens of log P(class | history) + log P(word | class, history).

* Classes are hashes of word endings. Each class has its most frequent words as heads, and one
  outcome for all its other words. These are the leaves of a binary tree over the bits of their
  hash: every decision on the way down is a logistic model of its own, whose bias is the
  log odds of the corpus counts below and whose features are the words before. So the history
  moves the probability of every word, however large the vocabulary; words that share a class
  and ``DEPTH`` bits share a leaf and differ in it by their smoothed counts. All words that
  training has not seen are one more outcome of their class.
* History features are hashed: the word before and the word two before (a skip), as heads or as
  ending classes; the word before by its own hash; the pair by the hashes of both.
* Weights are trained by gradient steps on the executors. Documents are dealt to trainers by a
  hash of id and text, so trainers are the same however the table is split. Each makes AdaGrad
  steps from the weights of the round before, and the changes are averaged, weighted by tokens:
  sums of integers, added in a task, then over groups of tasks, then per block of weights, so
  that no order of adding changes a bit. Training is one pass: the rounds share out the tokens
  of every trainer at random, and every training token is in one step.

Texts are tokenised once into shards (a shard is a trainer), integer-coded in the shared folder.
Word counts are exact and cover all training documents: each shard sends its distinct words to
hash buckets, and the buckets send the corpus counts back to the shards. What reaches the driver
is bounded: the heads, class totals, leaf totals (``CLASSES << DEPTH``) and weight blocks.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise

from .words import SPACED, Tokenizer, U, binary_slices, bounds_of, mix, numbers, sent, slices

BUCKET_BYTES = 12 << 20
SHARD_BYTES = 8 << 20  # text of a trainer
CLASSES, HEADS = 32, 31  # class 0 is the end of text alone
DEPTH = 12  # decisions from a class down to the leaves of its other words
LEAVES = 1 << DEPTH
END = np.uint64(0x1234567)
CONTEXTS = CLASSES * HEADS + CLASSES + 1  # heads, classes for other words, before the text
START = CONTEXTS - 1
NOBODY = U(0x7654321)  # hash of the word before the text
CLASS_ROWS = 2 * CONTEXTS + 2 * 8192 + 1
WORD_ROWS = 1 << 14
TREE_ROWS = 1 << 18
ROUNDS, BATCH = 3, 8192
BLOCKS = 8
TREE_MEMORY = 4.0  # squares that a decision's weights start from: rare histories move slowly
UNIT, PORTION = 1 << 14, 4096  # changes are sums of 1 / UNIT, weighted by portions of tokens


def _classes(words) -> np.ndarray:
    """Class of each word: a hash of its last two bytes and of whether punctuation ends it."""
    data, starts, ends = words.data, words.starts, words.ends
    last = data[ends - 1]
    mark = (last < 0x30) | ((last > 0x39) & (last < 0x61)) & (last < 0x80)
    mark &= ends - starts > 1
    at = ends - 1 - mark
    before = np.where(at > starts, data[np.maximum(at - 1, 0)], 0)
    key = data[at].astype(np.uint64) | before.astype(np.uint64) << U(8) | mark.astype(np.uint64) << U(16)
    return (mix(key + U(77)) % U(CLASSES - 1)).astype(np.uint8) + np.uint8(1)


def _shards(batches):
    """One row per shard: ids, held_out and length of each text, the distinct words (sorted hashes,
    classes) and the tokens as numbers of distinct words. Each text ends with END.

    Texts come by number of shard. A number whose texts exceed SHARD_BYTES is more than one shard,
    cut by the bytes before a text, wherever the batches end."""
    tokens = Tokenizer(SPACED, lower=True)

    def close(number, pieces):
        ids, held, length, hashes, classes = zip(*pieces)
        ids = pa.concat_arrays(ids)
        vocab, first, codes = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([np.packbits(np.concatenate(held)).tobytes()], pa.binary()),
                pa.array([np.concatenate(length).tobytes()], pa.binary()),
                pa.array([vocab.tobytes()], pa.binary()),
                pa.array([np.concatenate(classes)[first].tobytes()], pa.binary()),
                pa.array([codes.astype(np.uint32).tobytes()], pa.binary()),
            ],
            ["shard", "ids", "held", "length", "vocab", "class", "codes"],
        )

    deal, before, now, pieces = None, 0, None, []
    for batch in batches:
        dealt = batch.column("shard").to_numpy()
        size = numbers(batch.column("size")) + 1
        edges = bounds_of(dealt)
        for start, stop in zip(edges[:-1], edges[1:]):
            if dealt[start] != deal:
                deal, before = dealt[start], 0
            ends = before + np.cumsum(size[start:stop])
            part = (ends - size[start:stop]) // (SHARD_BYTES * 3 // 2)
            before = ends[-1]
            cuts = start + bounds_of(part)
            for low, high in zip(cuts[:-1], cuts[1:]):
                number = (int(deal) << 24) + int(part[low - start])
                if number != now and pieces:
                    yield from close(now, pieces)
                    pieces = []
                now = number
                ids, held = batch.column("id").slice(low, high - low), batch.column("held").slice(low, high - low).to_numpy(zero_copy_only=False)
                for a, b, data, offsets in slices(batch.column("text").slice(low, high - low)):
                    words = tokens.split(data, offsets)
                    counts = np.diff(words.first)
                    length = (counts + 1).astype(np.int32)
                    total = int(length.sum())
                    hashes, classes = np.full(total, END), np.zeros(total, np.uint8)
                    place = np.arange(len(words.starts)) + np.repeat(np.arange(b - a), counts)
                    hashes[place] = words.hashes
                    if len(words.starts):
                        classes[place] = _classes(words)
                    pieces.append((ids.slice(a, b - a), held[a:b], length, hashes, classes))
    if pieces:
        yield from close(now, pieces)


def _unpack(batch, i):
    get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    length = get("length", np.int32)
    held = np.unpackbits(get("held", np.uint8), count=len(length)).astype(bool)
    return length, held, get("codes", np.uint32)


def _word_blocks(buckets: int):
    """Each shard's distinct words with their training counts, cut at bucket edges."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                length, held, codes = _unpack(batch, i)
                vocab = np.frombuffer(batch.column("vocab")[i].as_py(), np.uint64)
                classes = np.frombuffer(batch.column("class")[i].as_py(), np.uint8)
                n = np.bincount(codes[np.repeat(~held, length)], minlength=len(vocab)).astype(np.int32)
                bucket = ((vocab >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
                edges = bounds_of(bucket)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[edges[:-1]]),
                        pa.array(np.full(len(edges) - 1, batch.column("shard")[i].as_py())),
                        binary_slices(vocab, edges),
                        binary_slices(classes, edges),
                        binary_slices(n, edges),
                    ],
                    ["bucket", "shard", "vocab", "class", "n"],
                )

    return run


def _leaf(vocab: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes.astype(np.int64) * LEAVES + (vocab >> U(64 - DEPTH)).astype(np.int64)


def _count_words(batches):
    """Per bucket: for each shard the corpus counts of its words; the candidates for heads; per
    class the number of training tokens and of distinct training words; and the same per leaf."""

    def close(bucket, rows):
        vocab = np.concatenate([r[1] for r in rows])
        values, first, inverse = np.unique(vocab, return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([r[3] for r in rows]), len(values)).astype(np.int64)
        classes = np.concatenate([r[2] for r in rows])[first]
        back = n[inverse]
        edges = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows])))
        none = lambda k: pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.full(len(rows), bucket, np.int32)), binary_slices(back, edges), none(len(rows)), none(len(rows)), none(len(rows)), none(len(rows)), pa.nulls(len(rows), pa.binary())],
            NAMES,
        )
        leaf, where = np.unique(_leaf(values, classes)[n > 0], return_inverse=True)
        sums = np.stack((leaf, np.bincount(where, n[n > 0], len(leaf)).astype(np.int64), np.bincount(where, minlength=len(leaf))))
        order = np.lexsort((values, -n, classes))
        order = order[n[order] > 0]
        starts = bounds_of(classes[order])
        place = np.arange(len(order)) - np.repeat(starts[:-1], np.diff(starts))
        head = order[place < HEADS]
        total = np.bincount(classes, n, CLASSES).astype(np.int64)
        distinct = np.bincount(classes[n > 0], minlength=CLASSES).astype(np.int64)
        k = len(head) + CLASSES
        yield pa.RecordBatch.from_arrays(
            [
                none(k),
                pa.array(np.full(k, bucket, np.int32)),
                pa.nulls(k, pa.binary()),
                pa.array(np.concatenate((classes[head].astype(np.int64), np.arange(CLASSES)))),
                pa.array(np.concatenate((values[head].astype(np.int64), np.zeros(CLASSES, np.int64))), mask=np.arange(k) >= len(head)),
                pa.array(np.concatenate((n[head], total))),
                pa.array(np.concatenate((np.ones(len(head), np.int64), distinct))),
                pa.array([None] * (k - 1) + [sums.astype(np.int64).tobytes()], pa.binary()),
            ],
            NAMES,
        )

    now, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            bucket = batch.column("bucket")[i].as_py()
            if bucket != now and rows:
                yield from close(now, rows)
                rows = []
            now = bucket
            get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: B023, E731
            rows.append((batch.column("shard")[i].as_py(), get("vocab", np.uint64), get("class", np.uint8), get("n", np.int32)))
    if rows:
        yield from close(now, rows)


NAMES = ["shard", "bucket", "counts", "class", "word", "n", "distinct", "leaves"]
COUNTED = "shard long, bucket int, counts binary, class long, word long, n long, distinct long, leaves binary"


class Model:
    """Heads, class and leaf totals, and weights."""

    def __init__(self, heads: list[tuple[int, int, int]], totals: dict[int, tuple[int, int]], leaves: np.ndarray):
        """heads: (class, word hash, count); totals: class -> (tokens, distinct words); leaves: rows
        of leaf number, tokens and distinct words, heads included."""
        per: dict[int, list] = {}
        for c, word, n in heads:
            per.setdefault(c, []).append((-n, word))
        flat = [(word & 0xFFFFFFFFFFFFFFFF, c, k, -n) for c, g in per.items() for k, (n, word) in enumerate(sorted(g)[:HEADS])]
        flat.sort()
        self.head_hash = np.array([f[0] for f in flat], np.uint64)
        self.head_place = np.array([f[2] for f in flat], np.int64)
        self.tokens = sum(n for n, _ in totals.values())
        self.distinct = sum(v for _, v in totals.values())
        rest_n, rest_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for c, (n, v) in totals.items():
            rest_n[c], rest_v[c] = n, v
        self.outcome = np.full((CLASSES, HEADS + 1), -12.0, np.float32)
        self.mass = np.zeros(CLASSES * LEAVES)  # smoothed tokens of a leaf's words that are no heads
        np.add.at(self.mass, leaves[0], leaves[1] + 0.5 * leaves[2])
        for word, c, k, n in flat:
            rest_n[c] -= n
            rest_v[c] -= 1
            self.mass[c * LEAVES + (word >> (64 - DEPTH))] -= n + 0.5
            self.outcome[c, k] = math.log(n + 0.5)
        self.outcome[:, HEADS] = np.log(np.maximum(rest_n, 0) + 0.5)
        self.rest_scale = rest_n + 0.5 * (rest_v + 1)
        self.by_class = np.zeros((CLASS_ROWS, CLASSES), np.float32)
        self.by_class[-1] = np.log(np.array([totals.get(c, (0, 0))[0] for c in range(CLASSES)]) + 0.5)
        self.by_word = np.zeros((WORD_ROWS + CLASSES, HEADS + 1), np.float32)
        self.by_word[WORD_ROWS:] = self.outcome
        # outcomes that no head stands for stay impossible
        self.shut = np.zeros((CLASSES, HEADS + 1), np.float32)
        self.shut[self.outcome <= -12] = -1e4
        # log odds of the right side below each node of the trees, node 1 the root; infinite where a side is empty
        below = np.zeros((CLASSES, 2 * LEAVES))
        below[:, LEAVES:] = self.mass.reshape(CLASSES, LEAVES)
        for d in reversed(range(DEPTH)):
            below[:, 1 << d : 2 << d] = below[:, 2 << d : 4 << d].reshape(CLASSES, -1, 2).sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.odds = np.nan_to_num(np.log(below[:, 1::2]) - np.log(below[:, ::2]), nan=0.0, posinf=np.inf, neginf=-np.inf).astype(np.float32).ravel()
        self.by_node = np.zeros(TREE_ROWS, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.by_class, self.by_word, self.by_node]

    def copy(self) -> "Model":
        """With weights of its own."""
        out = sent(Model, vars(self))
        out.by_class, out.by_word, out.by_node = (w.copy() for w in self.weights())
        return out

    def places(self, vocab: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in its class, context) of distinct words; place HEADS is "other"."""
        at = np.minimum(np.searchsorted(self.head_hash, vocab), max(len(self.head_hash) - 1, 0))
        is_head = self.head_hash[at] == vocab if len(self.head_hash) else np.zeros(len(vocab), bool)
        place = np.where(is_head, self.head_place[at] if len(self.head_hash) else 0, HEADS)
        classes = classes.astype(np.int64)
        return place, np.where(is_head, classes * HEADS + place, CLASSES * HEADS + classes)

    @staticmethod
    def histories(codes: np.ndarray, length: np.ndarray, outside: int) -> list[np.ndarray]:
        """Numbers of the words one and two tokens before each token, ``outside`` before the text."""
        inside = np.arange(len(codes), dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length)
        out = []
        for back in (1, 2):
            h = np.full(len(codes), outside, codes.dtype)
            h[back:] = codes[:-back]
            h[inside < back] = outside
            out.append(h)
        return out

    @staticmethod
    def rows(history, words, classes) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Feature rows of the two softmaxes, from contexts and hashes of the words before. The last
        row of ``by_class`` belongs to every token."""
        one, two = history
        named = (mix(words[0] + U(3)) >> U(51)).astype(np.int64)  # 8192
        pair = (mix(words[0] * U(3) + words[1]) >> U(51)).astype(np.int64)  # 8192
        by_class = [one, CONTEXTS + two, 2 * CONTEXTS + named, 2 * CONTEXTS + 8192 + pair]
        key = lambda h, salt: (mix((h * CLASSES + classes).astype(np.uint64) + U(salt << 40)) >> U(50)).astype(np.int64)  # noqa: E731  2**14
        by_word = [WORD_ROWS + classes, key(one, 1), key(two, 2), key(pair, 3)]
        return by_class, by_word

    def scores(self, by_class, by_word, classes):
        z = self.by_class.take(by_class[0], 0)
        z += self.by_class[-1]
        for f in by_class[1:]:
            z += self.by_class.take(f, 0)
        y = (self.by_word[WORD_ROWS:] + self.shut).take(classes, 0)
        for f in by_word[1:]:
            y += self.by_word.take(f, 0)
        return z, y

    def decisions(self, hashes, classes, words):
        """For words that are no heads, one column per node from the root to the leaf: the score
        of going right, whether the word does, and the rows of the features."""
        top = (hashes >> U(64 - DEPTH)).astype(np.uint32)[:, None]
        d = np.arange(DEPTH, dtype=np.uint32)[None, :]
        one = np.uint32(1)
        cell = classes.astype(np.uint32)[:, None] * np.uint32(LEAVES) + ((one << d) | (top >> (np.uint32(DEPTH) - d)))
        right = (top >> (np.uint32(DEPTH - 1) - d)) & one == one
        spread = cell * np.uint32(0x9E3779B1)
        rows = []
        for salt, w in enumerate(words):
            mixed = ((w >> U(32)).astype(np.uint32) + np.uint32(salt))[:, None] ^ spread
            mixed ^= mixed >> np.uint32(15)
            rows.append((mixed * np.uint32(0x85EBCA6B) >> np.uint32(14)).astype(np.intp))  # 2**18
        score = self.odds.take(cell)
        for r in rows:
            score += self.by_node.take(r)
        return score, right, rows

    def log10(self, vocab, classes_of, counts, codes, length) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token by the model, and by the unigram base."""
        place_of, context_of = self.places(vocab, classes_of)
        known = (place_of == HEADS) & (counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            in_leaf = (counts + 0.5) / self.mass[_leaf(vocab, classes_of)] * (1 - 0.5 / self.rest_scale[classes_of])
        rest = np.log(np.where(known, in_leaf, np.where(place_of == HEADS, 0.5 / self.rest_scale[classes_of], 1.0)))
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))
        before = self.histories(codes, length, len(vocab))
        context_of, named = np.append(context_of, START), np.append(vocab, NOBODY)
        out = np.empty(len(codes))
        for a in range(0, len(codes), 16384):
            code = codes[a : a + 16384]
            c, k = classes_of[code].astype(np.int64), place_of[code]
            back = [h[a : a + 16384] for h in before]
            words = [named[h] for h in back]
            z, y = self.scores(*self.rows([context_of[h] for h in back], words, c), c)
            row = np.arange(len(code))
            found = z[row, c] - _lse(z) + y[row, k] - _lse(y) + rest[code]
            at = np.flatnonzero(known[code])
            score, right, _ = self.decisions(vocab[code[at]], c[at], [w[at] for w in words])
            score *= np.float32(1) - np.float32(2) * right
            found[at] -= np.log(np.prod(1 + np.exp(np.minimum(score, 50, out=score), out=score), 1, np.float64))
            out[a : a + 16384] = found
        return out / math.log(10), base[codes]

    def learn(self, by_class, by_word, classes, places, memory, step: float) -> None:
        """One AdaGrad step of the softmaxes on a batch of tokens."""
        z, y = self.scores(by_class, by_word, classes)
        row = np.arange(len(classes))
        for weights, store, features, s, target in ((self.by_class, memory[0], by_class, z, classes), (self.by_word, memory[1], by_word, y, places)):
            s -= _top(s)
            pull = np.exp(s, out=s)
            pull /= -pull.sum(1, keepdims=True)
            pull[row, target] += 1
            if weights is self.by_class:  # its last row
                g = pull.sum(0)
                store[-1] += g * g
                weights[-1] += step * g / np.sqrt(store[-1])
            for f in features:
                order = np.argsort(f.astype(np.uint16), kind="stable")  # radix sort; both tables have fewer than 2**16 rows
                edges = bounds_of(f[order])
                slot = f[order[edges[:-1]]]
                g = _row_sums(pull, order, edges)
                squares = store[slot]
                squares += g * g
                store[slot] = squares
                g /= np.sqrt(squares, out=squares)
                g *= step
                weights[slot] += g

    def learn_tree(self, hashes, classes, words, memory, step: float) -> None:
        """One AdaGrad step of the decisions on words that are no heads."""
        score, right, rows = self.decisions(hashes, classes, words)
        pull = right - 1 / (1 + np.exp(-score))  # 0 where a side is empty
        pull = pull.ravel().astype(np.float64)
        g = sum(np.bincount(r.ravel(), pull, TREE_ROWS) for r in rows).astype(np.float32)
        memory += g * g
        g *= np.float32(step)
        g /= np.sqrt(memory)
        self.by_node += g


def _top(x: np.ndarray) -> np.ndarray:
    """Largest value of each row, as a column; the columns are a power of two."""
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        x = np.maximum(x[:, :half], x[:, half:])
    return x


def _row_sums(values: np.ndarray, order: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the rows ``order`` between ``edges``. Most have few rows: up to four are added side
    by side over all sums, in the order of ``reduceat`` (the first row to the sum of the others)."""
    starts, n = edges[:-1], np.diff(edges)
    out = values.take(order[starts], 0)
    for few in (2, 3, 4):
        at = np.flatnonzero(n == few)
        others = values.take(order[starts[at] + 1], 0)
        for k in range(2, few):
            others += values.take(order[starts[at] + k], 0)
        out[at] += others
    at = np.flatnonzero(n > 4)
    if len(at):
        rows = order[np.repeat(n > 4, n)]
        out[at] = np.add.reduceat(values.take(rows, 0), np.cumsum(n[at]) - n[at], axis=0)
    return out


def _lse(x: np.ndarray) -> np.ndarray:
    top = _top(x)
    return top[:, 0] + np.log(np.exp(x - top).sum(1))


def _packed(values: np.ndarray) -> bytes:
    """Integers by planes of bytes, signs last: small ones leave planes of zeros to the codec."""
    sign_last = (values << 1) ^ (values >> 63)
    return np.ascontiguousarray(sign_last.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    z = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return (z >> 1) ^ -(z & 1)


CHANGES = "team int, block int, weight long, change binary"


def _change(team, block, weight, values):
    return pa.RecordBatch.from_arrays(
        [pa.array([team], pa.int32()), pa.array([block], pa.int32()), pa.array([weight], pa.int64()), pa.array([_packed(values)], pa.binary())],
        ["team", "block", "weight", "change"],
    )


def _train(shared, turn: int, rounds: int, step: float, teams: int):
    """From the shared weights, the sum of the changes of this task's shards in the round, by block."""

    def run(batches):
        before = sent(Model, shared.value)
        total, weight = 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                length, held, codes = _unpack(batch, i)
                vocab = np.frombuffer(batch.column("vocab")[i].as_py(), np.uint64)
                classes_of = np.frombuffer(batch.column("class")[i].as_py(), np.uint8)
                place_of, context_of = before.places(vocab, classes_of)
                history = before.histories(codes, length, len(vocab))
                context_of, word_of = np.append(context_of, START), np.append(vocab, NOBODY)
                # the same order in all rounds; each takes its own share, together all tokens
                at = np.random.default_rng(rounds).permutation(np.flatnonzero(np.repeat(~held, length)))[turn::rounds]
                if not len(at):
                    continue
                model = before.copy()
                memory = [np.full_like(w, 1.0) for w in model.weights()[:2]] + [np.full(TREE_ROWS, TREE_MEMORY, np.float32)]
                for a in range(0, len(at), BATCH):
                    part = at[a : a + BATCH]
                    code = codes[part]
                    c, k = classes_of[code].astype(np.int64), place_of[code]
                    back = [h[part] for h in history]
                    named = [word_of[h] for h in back]
                    model.learn(*model.rows([context_of[h] for h in back], named, c), c, k, memory, step)
                    other = np.flatnonzero(k == HEADS)
                    model.learn_tree(vocab[code[other]], c[other], [h[other] for h in named], memory[2], step)
                portions = -(-len(at) // PORTION)
                change = np.concatenate([np.rint((new - old).ravel() * np.float32(UNIT)) for new, old in zip(model.weights(), before.weights())])
                total = total + change.astype(np.int64) * portions
                weight += portions
        if weight:
            for b, part in enumerate(np.array_split(total, BLOCKS)):
                yield _change(TaskContext.get().partitionId() % teams, b, weight, part)

    return run


def _add(batches):
    """Sums of changes per (team, block); these come one after the other."""
    now, total, weight = None, 0, 0
    for batch in batches:
        for team, block, w, change in zip(*(batch.column(c).to_pylist() for c in ("team", "block", "weight", "change"))):
            if (team, block) != now:
                if now is not None:
                    yield _change(*now, weight, total)
                now, total, weight = (team, block), 0, 0
            total = total + _unpacked(change)
            weight += w
    if now is not None:
        yield _change(*now, weight, total)


def _score(shared):
    def run(batches):
        model = sent(Model, shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                length, held, codes = _unpack(batch, i)
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: B023, E731
                counts = np.frombuffer(b"".join(batch.column("counts")[i].as_py()), np.int64)
                full, base = model.log10(get("vocab", np.uint64), get("class", np.uint8), counts, codes, length)
                first = np.cumsum(length) - length
                n = len(length)
                sums = [np.add.reduceat(v, first) for v in (full, base, (counts > 0)[codes].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(held), pa.array(length.astype(np.int64)), pa.array(sums[2]), pa.array(np.full(n, model.tokens)), pa.array(sums[1]), pa.array(sums[0])],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out, rounds: int = ROUNDS, step: float = 0.2
) -> DataFrame:
    """Per row: ``id_col``, held_out, n_tokens (words and one end), n_known (tokens that occur in
    training), train_tokens, base_score (log10 by smoothed word counts) and score (log10 by the
    model). The model and the counts learn from all tokens of the rows where the column
    ``held_out`` is false, shared out over ``rounds`` rounds.

    Words are lower-cased runs of bytes other than space and \\t to \\r. Null and empty texts
    have the end alone. A null ``held_out`` counts as false. Ids may be null or repeat; other
    columns are not looked at. With no training rows all words are unknown and the model knows
    no heads. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), text.alias("text"), F.octet_length(text).cast("long").alias("size"))
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    deals = max(1, math.ceil(size / SHARD_BYTES))
    shards = materialise(
        rows.withColumn("deal", F.xxhash64("id", "text"))
        .withColumn("shard", F.pmod("deal", F.lit(deals)))
        .repartition("shard")
        .sortWithinPartitions("shard", "deal", "held")
        .select("shard", "id", "held", "text", "size")
        .mapInArrow(_shards, f"shard long, ids array<{kind}>, held binary, length binary, vocab binary, class binary, codes binary"),
        "lm-shards",
    )
    counted = materialise(
        shards.select("shard", "held", "length", "vocab", "class", "codes")
        .mapInArrow(_word_blocks(buckets), "bucket int, shard long, vocab binary, class binary, n binary")
        .repartitionById(buckets, "bucket")  # one bucket to a task
        .mapInArrow(_count_words, COUNTED),
        "lm-counts",
    )
    # per class: one row of totals, HEADS rows of heads; per leaf its totals from one bucket or two
    totals = counted.filter("shard IS NULL AND word IS NULL").groupBy("class").agg(F.sum("n").alias("n"), F.sum("distinct").alias("v")).collect()
    best = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "word"))
    heads = counted.filter("word IS NOT NULL").withColumn("r", best).filter(F.col("r") <= HEADS).select("class", "word", "n").collect()
    leaves = [np.frombuffer(r[0], np.int64).reshape(3, -1) for r in counted.filter("leaves IS NOT NULL").select("leaves").toLocalIterator()]
    model = Model(
        [(r["class"], r["word"], r["n"]) for r in heads],
        {r["class"]: (r["n"], r["v"]) for r in totals},
        np.concatenate([np.zeros((3, 0), np.int64), *leaves], axis=1),
    )
    teams = max(1, math.isqrt(deals))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(dict(vars(model)))
        changes = (
            shards.select("held", "length", "vocab", "class", "codes")
            .mapInArrow(_train(shared, turn, rounds, step, teams), CHANGES)
            .repartition("team", "block")
            .sortWithinPartitions("team", "block")
            .mapInArrow(_add, CHANGES)
            .withColumn("team", F.lit(0))
            .repartitionById(BLOCKS, "block")
            .mapInArrow(_add, CHANGES)
            .collect()  # BLOCKS rows, the weights
        )
        if changes:
            flat = np.concatenate([_unpacked(r["change"]) / (r["weight"] * UNIT) for r in sorted(changes, key=lambda r: r["block"])]).astype(np.float32)
            cuts = np.cumsum([w.size for w in model.weights()])
            for w, part in zip(model.weights(), np.split(flat, cuts[:-1])):
                w += part.reshape(w.shape)
    shared = spark.sparkContext.broadcast(dict(vars(model)))
    back = counted.filter("shard IS NOT NULL").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("c"))
    joined = shards.join(back.select("shard", F.col("c.counts").alias("counts")), "shard")
    out = joined.select("ids", "held", "length", "vocab", "class", "codes", "counts").mapInArrow(
        _score(shared), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumnRenamed("id", id_col)
