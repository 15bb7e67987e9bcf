"""Toxicity: misspelled lexicon terms by automaton, weighed by their context.

The lexicon is learned from a bounded sample of labelled rows: terms whose odds in toxic texts
stand out, even at the lower end of their error, and that occur after several different words, so
that copies of one toxic text don't make terms of all its words. All such terms are taken, of
letters of any script; their number follows from the sample alone. Levenshtein automata of the
terms are intersected with the trie of the lexicon and made deterministic: one transition table
that all words of a slice run through together, byte by byte, and that most leave early.

Each match is scored in its context: inside quotation marks, next to words that go with abuse
(addressing) or with clean uses (reporting), among other matches. Those cue words are learned from
the same sample, by the odds of words near the matches. The counts of a document feed a logistic regression fitted on the
same sample. Labels, language, source and id are no inputs of a score.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

from .words import Tokenizer, byte_table, sent, slices

FIT_ROWS = 8000  # labelled rows that lexicon and weights are fitted on, at most
SUPPORT = 5  # toxic rows, and different words before it, that a term needs
ODDS = 2.0  # log of the odds of a term in toxic rows, at the lower end of its error
SHORT = 5  # terms of fewer letters: words one edit away are counted apart
WORD = byte_table((0x30, 0x39), (0x40, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
for _mark in b"$*":
    WORD[_mark] = True
# letters by which digits and signs are read
READ_AS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
LONG = 12  # terms of as many letters may have two edits
CUE_ODDS = 0.5  # of a cue near the matches of toxic against clean rows, at the nearer end of its error
NEAR, AMONG = 5, 20  # words


class Lexicon:
    """Terms, and the deterministic intersection of their automata with their trie."""

    def __init__(self, terms: list[str], long: int = LONG):
        self.terms = sorted(terms)
        self.long = long
        extra = sorted({c for t in self.terms for c in t if not "a" <= c <= "z"})
        number = {chr(0x61 + i): i for i in range(26)} | {c: 26 + i for i, c in enumerate(extra)}
        self.other = len(number)  # any other character
        self.letters = np.full(256, self.other, np.int32)
        self.letters[0x80:0xC0] = -1  # continuation bytes belong to the character before
        # code points beyond ASCII that the terms have, in both cases
        codes = sorted((ord(form), number[c]) for c in extra for form in {c, c.upper()} if len(form) == 1 and ord(form) > 0x7F)
        self.codes = np.array([c for c, _ in codes], np.int64)
        self.code_letter = np.array([k for _, k in codes], np.int32)
        self.short = np.array([len(t) < SHORT for t in self.terms], bool)
        for i in range(26):
            self.letters[0x61 + i] = self.letters[0x41 + i] = i
        for sign, letter in READ_AS.items():
            self.letters[ord(sign)] = ord(letter) - 0x61
        self._build(number)

    def edits(self, term: str) -> int:
        return 0 if len(term) < 3 else 1 if len(term) < self.long else 2

    def _build(self, letter_of: dict[str, int]) -> None:
        children, ends, reach = [{}], [None], [0]
        for number, term in enumerate(self.terms):
            node = 0
            reach[0] = max(reach[0], self.edits(term))
            for c in term:
                k = letter_of[c]
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    ends.append(None)
                    reach.append(0)
                node = children[node][k]
                reach[node] = max(reach[node], self.edits(term))
            ends[node] = number

        def closed(items: dict[int, int]) -> frozenset:
            """With the letters that the text may lack; of a node only the fewest edits count."""
            todo = list(items.items())
            while todo:
                node, e = todo.pop()
                if items.get(node, 9) < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= reach[child] and e + 1 < items.get(child, 9):
                        items[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(items.items())

        def after(state: frozenset, k: int) -> frozenset:
            items: dict[int, int] = {}

            def put(node, e):
                if e <= reach[node] and e < items.get(node, 9):
                    items[node] = e

            for node, e in state:
                put(node, e + 1)
                for letter, child in children[node].items():
                    put(child, e if letter == k else e + 1)
            return closed(items)

        start = closed({0: 0})
        number, states = {frozenset(): 0, start: 1}, [frozenset(), start]
        table = []
        at = 0
        while at < len(states):
            # letters that none of the nodes goes on with all lead where any other character does
            labels = sorted({k for node, _ in states[at] for k in children[node]})
            row = [0] * (self.other + 1)
            for k in [self.other, *labels]:
                to = after(states[at], k)
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                if k == self.other:
                    row = [number[to]] * (self.other + 1)
                row[k] = number[to]
            table.append(row)
            at += 1
        self.table = np.array(table, np.int32)
        self.term = np.full(len(states), -1, np.int32)
        self.cost = np.zeros(len(states), np.int32)
        for i, state in enumerate(states):
            hits = sorted((e, ends[node]) for node, e in state if ends[node] is not None and e <= self.edits(self.terms[ends[node]]))
            if hits:
                self.cost[i], self.term[i] = hits[0]

    def _letters_in(self, data: np.ndarray) -> np.ndarray:
        """Letter at the first byte of each character, -1 at its other bytes."""
        out = self.letters[data]
        lead = np.flatnonzero(data >= 0xC0) if len(self.codes) else np.zeros(0, np.int64)
        if len(lead):
            b = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) & (0xFF if i == 0 else 0x3F) for i in range(4)]
            two = (b[0] & 0x1F) << 6 | b[1]
            three = (b[0] & 0x0F) << 12 | b[1] << 6 | b[2]
            four = (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]
            code = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[at] == code
            out[lead[known]] = self.code_letter[at[known]]
        return out

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of the words within reach of a term."""
        if not self.terms:
            return (np.zeros(0, np.int64),) * 3
        word, at, state = np.arange(len(starts)), starts.copy(), np.ones(len(starts), np.int32)
        stop = ends
        letters = self._letters_in(data)
        found = []
        while len(word):
            over = at == stop
            done = np.flatnonzero(over)
            hit = done[self.term[state[done]] >= 0]
            found.append((word[hit], self.term[state[hit]], self.cost[state[hit]]))
            going = ~over
            word, at, stop, state = word[going], at[going], stop[going], state[going]
            letter = letters[at]
            state = np.where(letter < 0, state, self.table[state, np.maximum(letter, 0)])
            live = state > 0
            word, at, stop, state = word[live], at[live] + 1, stop[live], state[live]
        word, term, cost = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(word)
        return word[order], term[order], cost[order]


FEATURES = 12


def _inside_quotes(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Does a quotation stand open at these bytes? Straight marks toggle, curly ones open and close."""
    straight = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x22, out=straight[1:])
    turn = np.zeros(len(data) + 1, np.int64)
    if len(data) > 2:
        curly = (data[:-2] == 0xE2) & (data[1:-1] == 0x80)
        turn[3:] = np.cumsum((curly & (data[2:] == 0x9C)).astype(np.int64) - (curly & (data[2:] == 0x9D)))
    begin, end = offsets[text], offsets[text + 1]
    odd = (straight[at] - straight[begin]) % 2 == 1
    closes = straight[end] > straight[at]
    return odd & closes | (turn[at] > turn[begin])


def _near(words, w: int, t: int) -> set[bytes]:
    """The words within reach of word ``w`` of text ``t``, but for itself."""
    a, b = max(w - NEAR, words.first[t]), min(w + NEAR + 1, words.first[t + 1])
    return {words.data[words.starts[i] : words.ends[i]].tobytes().lower() for i in range(a, b) if i != w}


def _measure(lexicon: Lexicon, weights: np.ndarray, tokens: Tokenizer, data, offsets, cues=((), ())):
    """(features, matches) of the texts of a slice; matches are (text, word, term, edits, quoted)."""
    words = tokens.split(data, offsets)
    n = len(offsets) - 1
    counts = np.diff(words.first)
    word, term, cost = lexicon.match(words.data, words.starts, words.ends)
    text = np.searchsorted(words.first, word, "right") - 1
    quoted = _inside_quotes(data, offsets, words.starts[word], text)
    reporting, addressing = np.zeros(len(word), bool), np.zeros(len(word), bool)
    for i, (w, t) in enumerate(zip(word.tolist(), text.tolist())):
        near = _near(words, w, t)
        addressing[i], reporting[i] = not near.isdisjoint(cues[0]), not near.isdisjoint(cues[1])
    among = np.searchsorted(word, word + AMONG, "right") - np.searchsorted(word, word - AMONG, "left")
    # a word one edit from a short term is often another word: it has one feature of its own
    loose = (cost > 0) & lexicon.short[term] if len(term) else np.zeros(0, bool)
    plain = ~quoted & ~loose

    def per(mask):
        return np.bincount(text[mask], minlength=n).astype(np.float64)

    x = np.zeros((n, FEATURES))
    x[:, 0] = 1
    x[:, 1] = np.log1p(per(plain & (cost == 0)))
    x[:, 2] = np.log1p(per(plain & (cost > 0)))
    x[:, 3] = np.log1p(per(quoted & ~loose))
    x[:, 4] = np.log1p(per(plain & addressing))
    x[:, 5] = np.log1p(per(plain & reporting))
    most = np.zeros(n)
    np.maximum.at(most, text[plain], among[plain])
    x[:, 6] = np.log1p(most)
    x[:, 7] = per(plain) > 0
    x[:, 8] = per(plain & (cost == 0)) > 0
    strong = np.zeros(n)
    np.maximum.at(strong, text[plain], (weights[term] / (1 + cost))[plain] if len(weights) else np.zeros(0))
    x[:, 9] = strong
    x[:, 10] = per(plain) / np.log(counts + 3.0)
    x[:, 11] = np.log1p(per(~quoted & loose))
    return x, (text, word - words.first[text], term, cost, quoted)


def _neighbours(lexicon: Lexicon):
    """(toxic, word, share) of the words near the matches of a row: the share of its matches that
    have the word near. A row with a match has the empty word with share 1."""

    def run(batches):
        tokens = Tokenizer(WORD, lower=False)
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            label, out, shares = [], [], []
            for low, _, data, offsets in slices(batch.column("text")):
                words = tokens.split(data, offsets)
                word, _, _ = lexicon.match(words.data, words.starts, words.ends)
                text = np.searchsorted(words.first, word, "right") - 1
                found: dict[int, Counter] = {}
                for w, t in zip(word.tolist(), text.tolist()):
                    found.setdefault(t, Counter()).update({b""} | _near(words, w, t))
                for t, near in found.items():
                    label += [toxic[low + t]] * len(near)
                    out += list(near)
                    shares += [n / near[b""] for n in near.values()]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(out, pa.binary()), pa.array(shares, pa.float64())], ["toxic", "word", "share"])

    return run


def learn_cues(sample: DataFrame, lexicon: Lexicon, support: int = SUPPORT, odds: float = CUE_ODDS) -> tuple[list[bytes], list[bytes]]:
    """(addressing, reporting): words near the matches of ``support`` rows at least whose log odds
    in toxic against clean rows with a match exceed ``odds``, or fall below its negative, also at the
    nearer end of their error. A row counts by the share of its matches that have the word near, so
    that rows of many matches don't make cues of common words; terms are no cues. They reach the driver: words that ``support`` rows of the sample share."""
    near = sample.mapInArrow(_neighbours(lexicon), "toxic long, word binary, share double")
    shares = [F.sum(F.when(F.col("toxic") == k, F.col("share")).otherwise(0.0)).alias(name) for k, name in ((1, "bad"), (0, "clean"))]
    counted = near.groupBy("word").agg(*shares, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    rows = [(bytes(w), round(bad, 6), round(clean, 6)) for w, bad, clean, _ in counted.collect()]
    total = [(bad, clean) for w, bad, clean in rows if not w]
    out: tuple[list[bytes], list[bytes]] = ([], [])
    for w, bad, clean in sorted(rows):
        if w and total and w.decode("utf-8", "replace") not in lexicon.terms:
            a, b = bad + 0.5, clean + 0.5
            ratio = np.log(a / (total[0][0] + 1)) - np.log(b / (total[0][1] + 1))
            if abs(ratio) - 1.64 * np.sqrt(1 / a + 1 / b) > odds:
                out[int(ratio < 0)].append(w)
    return out


def _learn(lexicon: Lexicon, weights: np.ndarray, cues):
    def run(batches):
        tokens = Tokenizer(WORD, lower=False)
        for batch in batches:
            parts = [_measure(lexicon, weights, tokens, data, offsets, cues)[0] for _, _, data, offsets in slices(batch.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(np.concatenate(parts)), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _score(shared):
    def run(batches):
        fields, weights, model, cues = shared.value
        cues = tuple(map(frozenset, cues))
        lexicon = sent(Lexicon, fields)
        tokens = Tokenizer(WORD, lower=False)
        for batch in batches:
            scores, hits = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for low, high, data, offsets in slices(batch.column("text")):
                x, found = _measure(lexicon, weights, tokens, data, offsets, cues)
                scores[low:high] = 1 / (1 + np.exp(-np.clip(x @ model, -30, 30)))
                for t, w, k, e, q in zip(*(f.tolist() for f in found)):
                    hits[low + t].append({"word": w, "term": lexicon.terms[k], "edits": e, "quoted": q})
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), pa.array(scores), pa.array(hits, pa.list_(HIT))], ["id", "copy", "score", "hits"])

    return run


HIT = pa.struct([("word", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps; the first column, the constant, is hardly penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(labelled: DataFrame, support: int = SUPPORT, odds: float = ODDS) -> tuple[list[str], np.ndarray]:
    """All terms within the bounds, and their weights, from (text, toxic). They reach the driver:
    at most the words that ``support`` rows of the sample share."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]{2,}"), F.lit(0))
    split = labelled.select("toxic", words.alias("w"))
    n_toxic, n_rows = split.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_toxic, n_rows = n_toxic or 0, n_rows or 0
    if not 0 < n_toxic < n_rows:
        return [], np.zeros(0)

    def floor_of_odds(bad, clean):
        a, b = bad + F.lit(0.5), clean + F.lit(0.5)
        return F.log(a / (n_toxic + 1.0)) - F.log(b / (n_rows - n_toxic + 1.0)) - 1.64 * F.sqrt(1 / a + 1 / b)

    frequent = (
        split.select("toxic", F.explode(F.array_distinct("w")).alias("word"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("bad"), (F.count(F.lit(1)) - F.sum("toxic")).alias("clean"))
        .filter((F.col("bad") >= support) & (floor_of_odds(F.col("bad"), F.col("clean")) > odds))
    )
    pairs = F.zip_with(F.concat(F.array(F.lit("")), "w"), "w", lambda a, b: F.struct(b.alias("word"), a.alias("left")))
    varied = (
        split.filter("toxic = 1")
        .select(F.explode(F.array_distinct(pairs)).alias("p"))
        .select("p.word", "p.left")
        .join(frequent, "word")
        .distinct()
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("lefts"), F.first("bad").alias("bad"), F.first("clean").alias("clean"))
    )
    shown = F.least("lefts", "bad")
    rows = (
        varied.withColumn("floor", floor_of_odds(shown, F.col("clean")))
        .filter((shown >= support) & (F.col("floor") > odds))
        .select("word", "floor")
        .collect()
    )
    rows = sorted((r["word"], r["floor"]) for r in rows)
    return [w for w, _ in rows], np.array([f for _, f in rows])


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
    support: int = SUPPORT,
    odds: float = ODDS,
    long: int = LONG,
    cue_odds: float = CUE_ODDS,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, text_hash, score (0 to 1), predicted (1 if score >= 0.5)
    and hits, the matches (word number, term, edits, quoted).

    A term is in ``support`` toxic rows and after as many different words at least, and its log
    odds exceed ``odds`` at the lower end of their error. A match is one edit from a term, two from
    a term of ``long`` letters. ``cue_odds`` bounds the cue words around matches. Learns from ``fit_rows`` rows of ``labels`` at most, taken by hash; labels that are null or
    neither 0 nor 1 and rows of null ids are left out, of several labels of an id the highest
    counts. Null and empty texts have no matches and get the score of a text without any. With
    no labels, or labels of one class only, there are no terms and scores are the share of
    toxic labels, or 0. Ids of ``docs`` may repeat or be null; other columns are not looked at.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    known = (
        labels.filter(F.col(label_id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(label_id_col).alias("id"))
        .agg(F.max(label_col).cast("long").alias("toxic"))
    )
    # some more than wanted by a bound on the hash, then the lowest hashes: the same rows on any layout
    share = min(1.0, 1.25 * fit_rows / max(1, known.count()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    drawn = known.filter(place < int(share * (1 << 20)) + 1).orderBy(place, "id").limit(fit_rows)
    sample = rows.filter("text IS NOT NULL").join(F.broadcast(drawn), "id").select("text", "toxic")  # fit_rows rows at most
    sample = materialise(sample, "toxic-fit")
    terms, weights = learn_lexicon(sample, support, odds)
    lexicon = Lexicon(terms, long)
    cues = learn_cues(sample, lexicon, support, cue_odds) if terms else ([], [])
    fitted = sample.mapInArrow(_learn(lexicon, weights, tuple(map(frozenset, cues))), "toxic long, x array<double>").toArrow()
    if fitted.num_rows:
        x = np.stack(fitted.column("x").to_numpy())
        y = fitted.column("toxic").to_numpy().astype(np.float64)
        order = np.lexsort((*x.T, y))
        model = fit_logistic(x[order], y[order])
    else:
        model = np.zeros(FEATURES)
        model[0] = -30
    shared = spark.sparkContext.broadcast((vars(lexicon), weights, model, cues))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(_score(shared), f"id {kind}, copy long, score double, hits array<struct<word:long,term:string,edits:int,quoted:boolean>>")
    return scored.select(F.col("id").alias(id_col), F.col("copy").alias("text_hash"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")
