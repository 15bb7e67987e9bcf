"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field learns from a small labelled table (by default
``personal_labels``, of which it takes ``fit_rows`` at most) and finds what misses a pattern, such as
a telephone number without its plus sign or one that runs into the next number. What it adds
has to pass its kind's check, and nothing is added where a card or an address failed its own. It
reads segments: runs of words at most ``REACH`` words from a word with a digit or an at sign; no
other word can be personal data of the four kinds. Training and Viterbi decoding work on numpy
batches of segments.
"""

import ipaddress
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .personal_labels import labelled_texts
from .words import SPACED, Tokenizer, byte_table, sent, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
REACH = 2
SLOTS = 4096  # hashed features
FIT_ROWS = 3000  # labelled texts that the field is fitted on, at most
REMEMBERED = 64  # longest word whose features a worker keeps; longer ones are made anew
CELLS = 1 << 16  # words of a batch of segments, padding counted, unless one segment has more
TRIGGER = byte_table((0x30, 0x39), (0x40, 0x40))

# The definition's patterns. Greedy parts that cannot give back are possessive, and a match
# cannot start inside a run that an earlier start would have matched alike; both only save time.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL_NEXT = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL.pattern)
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str):
    at = 0
    while (match := EMAIL.match(text, at) or EMAIL_NEXT.search(text, at)) is not None:
        yield match.start(), match.end()
        at = match.end()


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the pattern matches that pass their checks."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    for match in IP.finditer(text):
        if all(map(_small, match[0].split("."))):
            found.append((1, *match.span()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 16 and 16 <= len(digits := NO_DIGIT.sub("", match[0])) <= 19 and luhn(digits):
            found.append((2, *match.span()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 8 <= len(NO_DIGIT.sub("", match[0])) <= 15:
                found.append((3, *match.span()))
    return found


def _refused(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind that may be added nevertheless, or -1) of pattern matches that fail
    their checks: addresses with a part above 255, which may be a card written with points, and
    16 to 19 digits with a wrong check digit."""
    out = [(*m.span(), 2) for m in IP.finditer(text) if not all(map(_small, m[0].split(".")))]
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 16 and 16 <= len(digits := NO_DIGIT.sub("", match[0])) <= 19 and not luhn(digits):
            out.append((*match.span(), -1))
    return out


AROUND = "\"'([{<,;:)]}>.!?#*$%&|"


def _shape(word: str) -> str:
    """One letter per class of character, runs of letters shortened to one, digits counted."""
    out = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "x", word)
    return re.sub(r"[0-9]", "9", out)


def _slot(*parts: str) -> int:
    return zlib.crc32("\x00".join(parts).encode()) % SLOTS


class Features:
    """Feature slots of the words of a segment; own slots of short words are remembered."""

    def __init__(self):
        self.known: dict[str, tuple[str, str, list[int]]] = {}

    def own(self, word: str) -> tuple[str, str, list[int]]:
        """(shape, or w for a word without digits, plus and at sign; the word as a cue; slots)."""
        if (found := self.known.get(word)) is not None:
            return found
        core = word.strip(AROUND)
        shape = _shape(core)
        digits = NO_DIGIT.sub("", core)
        marked = bool(digits) or "@" in word or "+" in word
        found = (
            shape if marked else "w",
            "" if digits else core.lower(),
            [
                _slot("shape", shape),
                _slot("short", re.sub(r"9+", "9", shape)),
                _slot("digits", str(min(len(digits), 20)), str(len(digits) >= 15 and luhn(digits))),
                _slot("ends", _shape(word[:1]), _shape(word[-1:])),
                _slot("at", str("@" in word), str(word.count(".")), str(word.count(":")), str(bool(digits))),
            ],
        )
        if len(word) <= REMEMBERED:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = found
        return found

    def rows(self, words: list[str]) -> list[list[int]]:
        own = [self.own(w) for w in words]
        shapes = ["<", *[s for s, _, _ in own], ">"]
        cues = ["<", "<", *[c for _, c, _ in own]]
        return [
            [
                *slots,
                _slot("before", shapes[i], shapes[i + 1]),
                _slot("after", shapes[i + 1], shapes[i + 2]),
                _slot("cue", cues[i + 1], "9" if cues[i + 2] == "" else "x"),
                _slot("cue2", cues[i], "9" if cues[i + 2] == "" else "x"),
            ]
            for i, (_, _, slots) in enumerate(own)
        ]


WIDE = 9  # features per word


def _segments(text_column):
    """(row, words, starts, ends) of each segment, positions in code points."""
    tokens = Tokenizer(SPACED, lower=False)
    for low, high, data, offsets in slices(text_column):
        trigger = np.zeros(len(data) + 1, np.int64)
        np.cumsum(TRIGGER[data], out=trigger[1:])
        if not trigger[-1]:
            continue
        words = tokens.split(data, offsets)
        char = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=char[1:])
        has = np.flatnonzero(trigger[words.ends] > trigger[words.starts])
        text = np.searchsorted(words.first, has, "right") - 1
        near = np.zeros(len(words.starts) + 1, np.int32)
        np.add.at(near, np.maximum(has - REACH, words.first[text]), 1)
        np.add.at(near, np.minimum(has + REACH + 1, words.first[text + 1]), -1)
        near = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        text = np.searchsorted(words.first, near, "right") - 1
        cut = np.flatnonzero((np.diff(near) > 1) | (np.diff(text) > 0)) + 1
        base = char[offsets[:-1]]
        raw = data.tobytes()
        for part in np.split(near, cut):
            row = int(np.searchsorted(words.first, part[0], "right")) - 1
            a, b = words.starts[part], words.ends[part]
            yield low + row, [raw[s:e].decode("utf-8", "replace") for s, e in zip(a.tolist(), b.tolist())], char[a] - base[row], char[b] - base[row]


def _labels(starts, ends, spans) -> np.ndarray:
    out = np.zeros(len(starts), np.int8)
    for kind, a, b in spans:
        inside = np.flatnonzero((starts < b) & (ends > a))
        if len(inside) and starts[0] <= a:
            out[inside] = 2 + 2 * kind
            out[inside[0]] = 1 + 2 * kind
    return out


def _examples(batches):
    features = Features()
    for batch in batches:
        texts, given = batch.column("text"), batch.column("spans")
        slots, labels = [], []
        for row, words, starts, ends in _segments(texts):
            spans = sorted((x["start"], KINDS.index(x["kind"]), x["end"]) for x in given[row].as_py() or [] if x["kind"] in KINDS)
            slots.append(np.array(features.rows(words), np.int16).tobytes())
            labels.append(_labels(starts, ends, [(kind, a, b) for a, kind, b in spans]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.binary()), pa.array(labels, pa.binary())], ["slots", "labels"])


def _batches(lengths: list[int], order: list[int], size: int):
    """``order``, from short to long, in batches of ``size`` segments and ``CELLS`` words at most."""
    part: list[int] = []
    for i in order:
        if part and (len(part) == size or (len(part) + 1) * lengths[i] > CELLS):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of the chain: emissions by feature slot, transitions between labels."""

    def __init__(self):
        self.emit = np.zeros((SLOTS, LABELS), np.float32)
        self.emit[:, 0] = 1e-3
        self.move = np.zeros((LABELS, LABELS), np.float32)

    def fit(self, segments: list[tuple[np.ndarray, np.ndarray]], passes: int = 12, step: float = 0.3, size: int = 64) -> "Field":
        """Conditional likelihood by AdaGrad over batches of segments of like length."""
        order = sorted(range(len(segments)), key=lambda i: (len(segments[i][1]), segments[i][0].tobytes()))
        batches = list(_batches([len(y) for _, y in segments], order, size))
        turn = np.random.default_rng(5)
        memory = [np.full_like(self.emit, 1e-4), np.full_like(self.move, 1e-4)]
        for _ in range(passes):
            for b in turn.permutation(len(batches)):
                grads = self._gradient([segments[i] for i in batches[b]])
                for w, g, m in zip((self.emit, self.move), grads, memory):
                    m += g * g
                    w += step * g / np.sqrt(m)
        return self

    def _gradient(self, part):
        n, t = len(part), max(len(y) for _, y in part)
        slots, labels, there = np.zeros((n, t, WIDE), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (x, y) in enumerate(part):
            slots[i, : len(y)], labels[i, : len(y)], there[i, : len(y)] = x, y, True
        score = self.emit[slots].sum(2)
        move = self.move
        ahead = np.empty_like(score)
        ahead[:, 0] = score[:, 0]
        for k in range(1, t):
            ahead[:, k] = np.where(there[:, k, None], _lse(ahead[:, k - 1, :, None] + move, 1) + score[:, k], ahead[:, k - 1])
        back = np.zeros_like(score)
        for k in range(t - 2, -1, -1):
            back[:, k] = np.where(there[:, k + 1, None], _lse(move + (score[:, k + 1] + back[:, k + 1])[:, None, :], 2), back[:, k + 1])
        total = _lse(ahead[:, -1], 1)
        chance = np.exp(ahead + back - total[:, None, None]) * there[..., None]
        pull = -chance
        pull[np.nonzero(there) + (labels[there],)] += 1
        emit = np.zeros_like(self.emit)
        np.add.at(emit, slots[there].reshape(-1), np.repeat(pull[there], WIDE, axis=0))
        moves = np.zeros_like(move)
        for k in range(1, t):
            on = there[:, k]
            pair = ahead[on, k - 1, :, None] + move + (score[on, k] + back[on, k])[:, None, :] - total[on, None, None]
            moves -= np.exp(pair).sum(0)
            np.add.at(moves, (labels[on, k - 1], labels[on, k]), 1)
        return emit / n, moves / n

    def decode(self, parts: list[np.ndarray], size: int = 256) -> list[np.ndarray]:
        """Viterbi paths, in batches of segments of like length."""
        out: list = [None] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        for at in _batches([len(x) for x in parts], order, size):
            lengths = np.array([len(parts[i]) for i in at])
            t = int(lengths.max())
            score = np.zeros((len(at), t, LABELS), np.float32)
            for j, i in enumerate(at):
                score[j, : len(parts[i])] = self.emit[parts[i]].sum(1)
            best, came = score[:, 0], np.zeros((len(at), t, LABELS), np.int8)
            for k in range(1, t):
                way = best[:, :, None] + self.move
                came[:, k] = way.argmax(1)
                best = np.where((k < lengths)[:, None], way.max(1) + score[:, k], best)
            label = best.argmax(1)
            path = np.zeros((len(at), t), np.int8)
            rows = np.arange(len(at))
            for k in range(t - 1, -1, -1):
                path[:, k] = label
                label = np.where((k < lengths) & (k > 0), came[rows, k, label], label)
            for j, i in enumerate(at):
                out[i] = path[j, : lengths[j]]
        return out


ADDRESS = re.compile(r"[^\s@<>()\[\],;:\"]+ ?@ ?[^\s@<>()\[\],;:\"]+\.[^\W\d_]{2,}")
NUMBERS = re.compile(r"[0-9][0-9 \u00A0./-]*[0-9]")
DIALLED = re.compile(r"[+(]?[0-9][0-9 \u00A0()./\u2013-]*[0-9]")


def _plausible(kind: int, text: str) -> bool:
    """Whether an added span passes its kind's check."""
    digits = NO_DIGIT.sub("", text)
    if kind == 0:
        return ADDRESS.fullmatch(text) is not None
    if kind == 1:
        plain = text.replace("[.]", ".").replace("(.)", ".")
        if ":" not in plain:
            return IP.fullmatch(plain) is not None and all(map(_small, plain.split(".")))
        try:
            return bool(digits) and ipaddress.ip_address(plain).version == 6
        except ValueError:
            return False
    if kind == 2:
        return 15 <= len(digits) <= 19 and NUMBERS.fullmatch(text) is not None and luhn(digits)
    return 7 <= len(digits) <= 15 and DIALLED.fullmatch(text) is not None


def _added(starts, ends, path, text: str):
    """Spans of a decoded path that pass their checks, without the punctuation around them."""
    i = 0
    while i < len(path):
        if not path[i]:
            i += 1
            continue
        kind, j = (int(path[i]) - 1) // 2, i + 1
        while j < len(path) and path[j] == 2 + 2 * kind:
            j += 1
        a, b = int(starts[i]), int(ends[j - 1])
        while a < b and text[a] in AROUND and not (text[a] == "(" and text.count("(", a, b) <= text.count(")", a, b)):
            a += 1
        while b > a and text[b - 1] in AROUND and not (text[b - 1] == ")" and text.count(")", a, b) <= text.count("(", a, b)):
            b -= 1
        if _plausible(kind, text[a:b]):
            yield kind, a, b
        i = j


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def _find(shared):
    def run(batches):
        features = Features()
        field = sent(Field, shared.value)
        for batch in batches:
            texts = batch.column("text")
            rows, segments = {}, []
            for row, words, starts, ends in _segments(texts):
                if row not in rows:
                    text = texts[row].as_py()
                    base = base_spans(text)
                    rows[row] = (text, base, [], [(a, b, -1) for _, a, b in base] + _refused(text))
                segments.append((row, words, starts, ends))
            paths = field.decode([np.array(features.rows(words), np.int64) for _, words, _, _ in segments])
            for (row, _, starts, ends), path in zip(segments, paths):
                if path.any():
                    text, _, more, taken = rows[row]
                    for kind, a, b in _added(starts, ends, path, text):
                        if all(b <= x or a >= y or kind == free for x, y, free in taken):
                            more.append((kind, a, b))
            out = []
            for i in range(batch.num_rows):
                _, base, more, _ = rows.get(i, ("", [], [], []))
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(SPAN))], ["id", "spans"])

    return run


def default_labels(spark: SparkSession) -> DataFrame:
    """``personal_labels`` as a table (text, spans)."""
    return spark.createDataFrame(labelled_texts(), "text string, spans array<struct<kind:string,start:long,end:long>>")


def fit_field(labelled: DataFrame, *, fit_rows: int = FIT_ROWS) -> Field:
    """The field fitted on all segments of ``fit_rows`` rows of (text, spans) at most, taken by
    hash; null texts have none, null spans mean a text without personal data."""
    rows = labelled.select("text", "spans").filter(F.col("text").isNotNull()).orderBy(F.xxhash64("text"), "text").limit(fit_rows)
    table = rows.mapInArrow(_examples, "slots binary, labels binary").toArrow()
    segments = [
        (np.frombuffer(x, np.int16).reshape(-1, WIDE).astype(np.int64), np.frombuffer(y, np.int8).astype(np.int64))
        for x, y in zip(table.column("slots").to_pylist(), table.column("labels").to_pylist())
    ]
    return Field().fit(segments)


def find_personal_data(docs: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: ``id_col`` and spans, an array of (kind, start, end, base) in code points, end
    exclusive, by kind (email, ip, card, phone), then start. Base spans are the patterns'; the
    field, fitted on ``labelled`` (text, spans of (kind, start, end)), adds spans that overlap
    none of them and pass their kind's check.

    Null and empty texts have no spans. Ids may be null or repeated; other columns are not
    looked at. An empty table gives an empty result, and an empty labelled table a field that
    adds nothing.
    """
    spark = docs.sparkSession
    labelled = default_labels(spark) if labelled is None else labelled
    field = spark.sparkContext.broadcast(vars(fit_field(labelled, fit_rows=fit_rows)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_find(field), f"id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>").withColumnRenamed("id", id_col)
