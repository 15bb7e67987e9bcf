"""Source audit, packing and the prefix trie against their plain definitions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import llm_cases as cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import cohortloom.llm.source_audit as audit
from cohortloom.llm.packing import WordIds, make_plan, pack_documents, place, shortest_pack_first
from cohortloom.llm.prefix_trie import prefix_trie
from cohortloom.llm.queries import QUERIES
from cohortloom.llm.source_audit import shares, source_divergence

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", cases.lower(text))


def brute_audit(rows, min_df, top):
    """rows: (lang, source, text)."""
    by = defaultdict(list)
    for lang, source, text in rows:
        by[lang or ""].append((source or "", Counter(terms(text))))
    out = set()
    for lang, docs in by.items():
        df, whole, own = Counter(), Counter(), defaultdict(Counter)
        for source, count in docs:
            df.update(count.keys())
            whole.update(count)
            own[source].update(count)
        kept = [t for t in df if df[t] >= min_df]

        def shares_of(count):
            n = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // n for t in kept}

        p, q = {s: shares_of(c) for s, c in own.items()}, shares_of(whole)
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            far = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", far)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top}
    return out


def audit_rows(seed):
    r = random.Random(seed)
    rows = cases.hard_rows(seed, 80)
    return [(r.choice(["en", "de", None, ""]), s, t) for _, t, s in rows] + [("xx", "alone", None), ("yy", "a", ""), ("yy", "b", None)]


def audit_frame(spark, rows):
    return spark.createDataFrame([(a, b, c, 1, 2, "t") for a, b, c in rows], "lang string, source string, text string, df long, task long, term string")


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_audit(spark, monkeypatch, seed, small):
    if small:  # many spills, several tiles of source pairs and dense parts
        monkeypatch.setattr(audit, "CELLS", 40)
        monkeypatch.setattr(audit, "BLOCK", 2)
        monkeypatch.setattr(audit, "DENSE", 8)
    rows = audit_rows(seed)
    got = source_divergence(audit_frame(spark, rows).repartition(5), min_df=4, top=7).collect()
    want = brute_audit(rows, 4, 7)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert {x for x in want if x[0] == "yy"} == {("yy", "a", "pair", "b", 0, 1), ("yy", "b", "pair", "a", 0, 1)}


def test_audit_of_nothing(spark):
    assert source_divergence(audit_frame(spark, audit_rows(1)).limit(0)).collect() == []


def test_shares_of_huge_counts():
    count, total = np.array([0, 7, 10**13, 4 * 10**15]), 4 * 10**15 + 5
    assert shares(count, np.int64(total)).tolist() == [1 + 10**9 * (c + 5) // total for c in count.tolist()]


def totals_of(plan, lengths, ranks, size):
    piece, start, length, sequence, offset = place(plan, lengths, ranks)
    order = np.lexsort((offset, sequence))
    end, same = (offset + length)[order], sequence[order][1:] == sequence[order][:-1]
    assert (offset[order][1:] == np.where(same, end[:-1], 0)).all()
    order = np.lexsort((start, piece))
    same = piece[order][1:] == piece[order][:-1]
    assert (start[order][1:] == np.where(same, (start + length)[order][:-1], 0)).all()
    assert np.bincount(piece, weights=length, minlength=len(lengths)).tolist() == lengths.tolist()
    return np.bincount(sequence, weights=length, minlength=plan.sequences).astype(int)


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    r = np.random.default_rng(seed)
    n, size = int(r.integers(1, 3000)), 2 ** int(r.integers(1, 12))
    lengths = r.integers(1, size + 1, n) if seed % 2 else np.minimum(size, r.geometric(0.01, n))
    if seed % 5 == 4:
        lengths[: n // 3] = 1
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    packed = Counter()
    for packs, runs in shortest_pack_first(counts, size):
        assert sum(a * b for a, b in runs) <= size
        for length, each in runs:
            packed[length] += packs * each
    assert packed == counts
    order = np.argsort(lengths, kind="stable")
    ranks = np.empty(n, np.int64)
    ranks[order] = np.arange(n) - np.searchsorted(lengths[order], lengths[order])
    slack = size // 100
    totals = totals_of(make_plan(counts, size, slack), lengths, ranks, size)
    assert (totals <= size).all() and (totals > 0).all()
    assert ((size - totals <= slack) | (totals & (totals - 1) == 0)).all()


def test_plan_follows_lengths_not_rows():
    few = make_plan({1: 3, 700: 5, 2048: 2}, 2048, 20)
    many = make_plan({1: 3 * 10**9, 700: 5 * 10**9, 2048: 2 * 10**9}, 2048, 20)
    assert len(few.turn) < 100 and len(many.turn) < 1000


ODD = ["", "a <|startoftext|> b<|endoftext|>", "<|STARTOFTEXT|> it's ''s don't 'self x.'s 1's rock'n'roll É, é. —, ÉÀ;x ×,a", "é,x  Å;b c \x1c d　e \x85 İ ſ K", "日本,語 a1b22c ñ!ñ ﬁ ǅ", "don’t ’s 'S 'LL ||a|b| ", "\r\n\t", "x" * 5000]


def whole_ids(texts):
    coder = Tokenizer.from_file(VOCABULARY)
    return [x.ids + [1] for x in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_give_the_ids_of_whole_texts():
    r = random.Random(3)
    signs = "aAbz'sS’ .,;|<>1é É́ſß日 \n-"
    texts = ODD + ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(3000)]
    coder = WordIds(Tokenizer.from_file(VOCABULARY))
    for _ in range(2):  # the second time from memory
        raw = [t.encode() for t in texts]
        ids, bounds = coder.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]), 1)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == whole_ids(texts)


@pytest.mark.parametrize("by_word", [True, False])
def test_packing(spark, by_word):
    rows = cases.hard_rows(4) + [(300 + i, t, "a") for i, t in enumerate(ODD)]
    size = 64
    out = pack_documents(cases.frame(spark, rows).repartition(3), tokenizer=VOCABULARY, size=size, by_word=by_word).collect()
    by_id = defaultdict(list)
    for x in out:
        assert len(x.ids) == 4 * x.length
        by_id[x.doc_id].append((x.doc_tokens, x.start, np.frombuffer(x.ids, "<u4").tolist()))
    want = defaultdict(list)
    for (i, _, _), ids in zip(rows, whole_ids([t for _, t, _ in rows]), strict=True):
        want[i].append(ids)
    for i, documents in want.items():
        pieces = sorted(by_id[i], key=lambda x: (x[0], x[1]))
        assert sum(len(p[2]) for p in pieces) == sum(map(len, documents))
        for tokens, start, ids in pieces:
            assert any(len(d) == tokens and d[start : start + len(ids)] == ids for d in documents)
        if len(documents) == 1:
            assert [p[1] for p in pieces] == np.cumsum([0] + [len(p[2]) for p in pieces])[:-1].tolist()
    fill = defaultdict(list)
    for x in out:
        fill[x.sequence_id].append((x.offset, x.length))
    assert sorted(fill) == list(range(len(fill)))
    for parts in fill.values():
        parts.sort()
        ends = np.cumsum([0] + [n for _, n in parts]).tolist()
        assert [o for o, _ in parts] == ends[:-1] and (ends[-1] == size or ends[-1] & (ends[-1] - 1) == 0)


def test_packing_of_nothing(spark):
    empty = cases.frame(spark, cases.hard_rows(4)).limit(0)
    assert pack_documents(empty, tokenizer=VOCABULARY, by_word=True).collect() == []


def test_packing_query_pads_little(spark, sf_dir):
    out = QUERIES["op12_packing"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = dict(zip(texts, whole_ids(texts.values()), strict=True))
    assert sum(x.length for x in out) == sum(map(len, ids.values()))
    for x in out:
        assert x.doc_tokens == len(ids[x.doc_id])
        assert x.ids_crc32 == zlib.crc32(np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4").tobytes())
    totals = Counter()
    for x in out:
        totals[x.sequence_id] += x.length
    assert sum(2048 - n for n in totals.values() if n & (n - 1)) < 0.01 * sum(totals.values())


def brute_trie(rows, rebuild=True):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(own[c], key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c in own}
    built = own
    if rebuild:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, found in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(found) - 1) * len(k[-1][1].encode()) if k else 0
    return {
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha256(",".join(map(str, ends[k])).encode()).hexdigest())
        for k, m in members.items()
    }


def conversation_rows(seed, n=60):
    r = random.Random(seed)
    openings = [[("user", f"hello {i}"), ("assistant", "é" * i), ("user", "")][: r.randrange(1, 4)] for i in range(4)]
    rows = []
    for c in r.sample(range(200), n):
        turns = list(r.choice(openings)) + [(r.choice(["user", "assistant", None]), r.choice(["a", "b", None, "1:x"])) for _ in range(r.choice([0, 1, 2, 5, 12]))]
        rows += [(c, None if r.random() < 0.05 else i // 2 if r.random() < 0.1 else i, *t) for i, t in enumerate(turns)]
    rows += [(None, 0, "user", "lost"), rows[0], rows[0], (501, 0, "user", "short"), (1000, 0, "user", "x")]
    rows += [(700 + i, d, "user", f"same {d}") for i in range(3) for d in range(41)]
    r.shuffle(rows)
    return rows


def turn_frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2, 3, "s") for x in rows], "conv_id long, turn long, role string, text string, conv long, pos long, lo long, sym string")


@pytest.mark.parametrize(("seed", "rebuild"), [(1, True), (2, False)])
def test_trie(spark, seed, rebuild):
    rows = conversation_rows(seed)
    got = prefix_trie(turn_frame(spark, rows).repartition(4), rebuild=rebuild).collect()
    want = brute_trie(rows, rebuild)
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_trie_of_nothing_and_of_one_turn(spark):
    assert prefix_trie(turn_frame(spark, [(1, 0, "user", "a")]).limit(0)).collect() == []
    for rows in ([(3, 0, "user", "hé")], [(3, None, None, None), (8, 0, None, "")]):
        got = prefix_trie(turn_frame(spark, rows), rebuild=False).collect()
        assert {tuple(x) for x in got} == brute_trie(rows, False)
    # all turns are replaced by those of a conversation that is absent: members of the root alone
    rows = [(c, 0, "user", "a") for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9]
    assert {tuple(x) for x in prefix_trie(turn_frame(spark, rows)).collect()} == brute_trie(rows)
