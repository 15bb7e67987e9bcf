"""Operators on passages, lines and sets of words against plain definitions."""

import random
from collections import Counter

import llm_cases as cases
import numpy as np
import pyarrow as pa
import pytest

from cohortloom.llm import words as W
from cohortloom.llm.components import connected_components
from cohortloom.llm.decontaminate import contamination
from cohortloom.llm.line_dedup import line_dedup
from cohortloom.llm.mixing import mix_sources
from cohortloom.llm.ngram_join import Bands, ngram_components
from cohortloom.llm.substring_dedup import substring_dedup


def bag(rows):
    return Counter(tuple(tuple(map(tuple, v)) if isinstance(v, list) and v and not isinstance(v[0], (str, int)) else tuple(v) if isinstance(v, list) else v for v in r) for r in rows)


@pytest.mark.parametrize("keep,lower,define", [(W.SPACED, False, cases.spaced), (W.ALNUM, True, cases.plain)])
def test_words_are_those_of_the_pattern(keep, lower, define):
    r = random.Random(3)
    texts = ["".join(r.choice("aZ9 .\t\n\x0b\x85 é日😀_\x00") for _ in range(r.randrange(30))) for _ in range(400)] + [None, ""]
    column = pa.array(texts, pa.string())
    tokens = W.Tokenizer(keep, lower)
    found, hashes = [], {}
    for low, high, data, offsets in W.slices(column, 300):
        words = tokens.split(data, offsets)
        for i in range(high - low):
            part = range(words.first[i], words.first[i + 1])
            found.append([words.data[words.starts[k] : words.ends[k]].tobytes().decode() for k in part])
            for k in part:
                hashes.setdefault(int(words.hashes[k]), set()).add(found[-1][k - words.first[i]])
    assert found == [define(t) for t in texts]
    assert all(len(v) == 1 for v in hashes.values())


def test_rolling_hashes_follow_content():
    tokens = W.Tokenizer(W.SPACED, False)
    h = np.array([5, 6, 7, 5, 6, 7, 9], np.uint64)
    rolled = tokens.rolling(h, 3)
    assert rolled[0] == rolled[3] and len(set(rolled.tolist())) == 4 and not len(tokens.rolling(h, 8))


def brute_substring(rows, window):
    least = {}
    for i, t, _ in rows:
        w = cases.spaced(t)
        for a in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[a : a + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, t, _ in rows:
        w = cases.spaced(t)
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and least[tuple(w[a : a + window])] < i:
                gone |= set(range(a, a + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window", [2, 5, 7])
def test_substring_dedup(spark, window):
    rows = cases.hard_rows(window)
    got = substring_dedup(cases.frame(spark, rows), window=window).collect()
    assert Counter((r.doc_id, r.n_words, sum(x.end - x.start for x in r.removed), r.kept) for r in got) == brute_substring(rows, window)
    assert substring_dedup(cases.frame(spark, []), window=window).collect() == []


def test_substring_blocks_merge_in_any_order(monkeypatch):
    """Many merges, documents out of order, one window in all of them."""
    from cohortloom.llm import substring_dedup as S

    monkeypatch.setattr(S, "HOLD", 8)
    r = random.Random(0)
    rows = [(i, 0, p, h) for i in range(50) for p, h in enumerate([1, 10 + i % 7, 2])]
    r.shuffle(rows)
    batches = []
    for at in range(0, len(rows), 5):
        d, c, p, h = (np.array(x) for x in zip(*rows[at : at + 5]))
        batches.append(
            pa.RecordBatch.from_pydict(
                {"bucket": [0], "lost": [False], "doc": [d.astype(np.int64).tobytes()], "copy": [c.astype(np.int64).tobytes()], "pos": [p.astype(np.int32).tobytes()], "hash": [h.astype(np.uint64).tobytes()]}
            )
        )
    got = set()
    for out in S._settle(iter(batches)):
        for doc, runs in zip(out.column("doc").to_pylist(), out.column("runs").to_pylist()):
            for a, b in np.frombuffer(runs, np.int32).reshape(-1, 2):
                got |= {(doc, p) for p in range(a, b)}
    assert got == {(i, p) for i, _, p, h in rows if i != (h - 10 if h >= 10 else 0)}


def brute_contamination(rows, items, window):
    wins = {}
    for item, t in items:
        w = cases.plain(t)
        if item is not None and w:
            n = min(window, len(w))
            for a in range(len(w) - n + 1):
                wins.setdefault(tuple(w[a : a + n]), set()).add(str(item))
    out = []
    for i, t, _ in rows:
        w = cases.plain(t)
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    found |= wins[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def test_contamination(spark):
    rows = cases.hard_rows(11)
    texts = [t for _, t, _ in rows if t]
    items = [(1, " ".join(cases.plain(texts[0])[2:9])), (2, "w1 w2"), (3, "w3"), (4, None), (5, ""), (None, texts[2]), (7, texts[3]), (7, texts[4]), (10, texts[3]), (11, "never seen words")]
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, token long")
    for window in (3, 5):
        got = contamination(cases.frame(spark, rows), bench, window=window).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute_contamination(rows, items, window)
    assert contamination(cases.frame(spark, []), bench).collect() == []
    none = contamination(cases.frame(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)


def shingle_set(text, k):
    w = cases.spaced(cases.lower(text))
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [shingle_set(t, k) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(sets[a]), least.get(find(a))) for a, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("k,percent", [(3, 90), (2, 60), (5, 80), (1, 50), (3, 100)])
def test_ngram_components(spark, k, percent):
    rows = cases.hard_rows(k)
    got = ngram_components(cases.frame(spark, rows), shingle=k, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k, percent)
    assert ngram_components(cases.frame(spark, []), shingle=k, percent=percent).collect() == []


@pytest.mark.parametrize("percent", [70, 90])
def test_chains_of_links_are_not_cut(spark, percent):
    """Each text links with its neighbours only, so no leader sees all of them."""
    base = [f"x{i}" for i in range(60)]
    rows = [(900 - i, " ".join(base[: 60 - i] + [f"y{j}" for j in range(i)]), "a") for i in range(40)]
    rows += [(1000 + i, " ".join(f"z{i}_{j}" for j in range(30)), "a") for i in range(20)]
    got = ngram_components(cases.frame(spark, rows), shingle=1, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 1, percent)


def test_parts_outnumber_the_differences():
    for percent in (50, 80, 90, 99):
        bands = Bands(percent)
        for a in range(1, 400):
            for b in range(a, a * 100 // percent + 1):
                common = set(bands.of(a)) & set(bands.of(b))
                assert common
                most = (a + b) * (100 - percent) // (100 + percent)
                for band in common:
                    parts, spare = bands.parts(band)
                    assert parts > most + spare if parts else most == 0 or a == b


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(50, 50)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 100) for i in range(100, 141)} | {(i, 0) for i in range(30)}


def test_line_dedup(spark):
    rows = [(i, f"Menu \nown line {i}\n\n  Menu\nrare {i % 3}", f"s{i % 6}") for i in range(1, 30)]
    rows += [(0, "rare 1\nlast", "s9"), (40, None, "s1"), (41, "", "s1"), (None, "Menu\nx", "s7"), (42, "Menu", None), (43, "Menu\nMenu", "s2"), (3, "Menu\nother text of 3", "s1")]
    rows += [rows[4], rows[4]]
    for threshold in (2, 4, 6, 7):
        sites, first = {}, {}
        for i, t, s in rows:
            for x in (t or "").split("\n") if i is not None else []:
                if x.strip(" "):
                    sites.setdefault(x.strip(" "), set()).update([s] if s else [])
                    first[x.strip(" ")] = min(first.get(x.strip(" "), i), i)
        want = Counter()
        for i, t, s in rows:
            lines = t.split("\n") if t is not None else []
            bad = [i is not None and x.strip(" ") != "" and len(sites[x.strip(" ")]) >= threshold and i > first[x.strip(" ")] for x in lines]
            kept = None if t is None else "\n".join(x for x, b in zip(lines, bad) if not b)
            want[(i, sum(x.strip(" ") != "" for x in lines), sum(bad), kept)] += 1
        got = line_dedup(cases.frame(spark, rows), min_sites=threshold).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in got) == want
    assert line_dedup(cases.frame(spark, [])).collect() == []


def water_filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in open_})
            break
        target.update({s: most * sizes[s] for s in over})
        open_ -= over
    return target


def test_mixing_meets_its_targets(spark, monkeypatch):
    from cohortloom.llm import mixing

    r = random.Random(4)
    rows = [(i, "w " * min(int(r.expovariate(1 / 40)), 200), r.choice("aaaaabcdé") if i % 11 else None) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", "void"), (None, "x y", "b"), (7, "x", "b"), (7, "x", "b")]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(cases.spaced(t))
    want = water_filled(sizes)
    runs = []
    for digits in (3, 0):  # the chunks that rows are counted in do not show
        monkeypatch.setattr(mixing, "DIGITS", digits)
        got = mix_sources(cases.frame(spark, rows)).collect()
        source = {(i, len(cases.spaced(t))): s for i, t, s in rows}
        taken = Counter()
        for x in got:
            assert 0 <= x.copies <= 2 and x.source_size == sizes[source[x.doc_id, x.size]]
            assert x.target == pytest.approx(want[source[x.doc_id, x.size]])
            taken[source[x.doc_id, x.size]] += x.copies * x.size
        assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 200 for s in sizes)
        again = mix_sources(cases.frame(spark, r.sample(rows, len(rows)))).collect()
        assert bag(map(tuple, got)) == bag(map(tuple, again))
        runs.append(bag(map(tuple, got)))
    assert runs[0] == runs[1] and len(got) == len(rows)
    assert mix_sources(cases.frame(spark, [])).collect() == []
