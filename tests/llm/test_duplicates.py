import random
from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import duplicates as d


def by_hand(rows, width, similarity, least):
    sets = {}
    for i, t in rows:
        w = d.words_of(t)
        if len(w) >= max(least, width):
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12}


def edits(n, seed=0, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.randint(words // 2, words * 3))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 12)):
                at = rng.randrange(len(own))
                rng.choice([lambda: own.__setitem__(at, rng.choice(vocab)), lambda: own.insert(at, "new"), lambda: own.pop(at)])()
            rows.append((len(rows) + 1, " ".join(own)))
    return rows


@pytest.mark.parametrize("hot", [4096, 20])
def test_pairs_are_those_by_hand(spark, chunks, monkeypatch, hot):
    monkeypatch.setattr(d, "HOT", hot)
    monkeypatch.setattr(d, "PART", 6)
    rows = edits(250, 1) + [(1000 + i, ("same words again and again " * 20) + f"tail {i % 3}") for i in range(60)]
    want = by_hand(rows, 3, 0.6, 40)
    pairs, members = d.similar(chunks(rows), width=3, similarity=0.6, least_words=40)
    got = {(r["a"], r["b"]) for r in d.pairs_of_rows(pairs, members).collect()}
    assert got == want


def test_large_blocks_go_by_tiles():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > p], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) for p in rng.uniform(0, 0.5, 300)]
    sets.sort(key=len)
    raw = [d.sketch(s) for s in sets]
    ends = np.cumsum([0] + [len(r) for r in raw])
    rows = {"id": np.arange(300), "size": np.array([len(s) for s in sets]), "band": np.zeros(300, int), "part": np.zeros(300, int), "split": np.zeros(300, bool), "raw": np.frombuffer(b"".join(raw), np.uint8), "from": ends[:-1]}
    found = {(int(i), int(j)) for a, b in d._Block(rows, 0.6).near() for i, j in zip(a, b)}
    for i, j in combinations(range(300), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both >= 0.6 * (len(sets[i]) + len(sets[j]) - both):
            assert (i, j) in found or (j, i) in found


def test_copies_and_edges(spark, chunks):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text.upper()), (3, text.replace(" ", ", ")), (4, None), (5, ""), (6, "too short"), (None, text), (7, " ".join(f"other{i % 9000}" for i in range(30_000)))]
    pairs, members = d.similar(chunks(rows), width=3, similarity=0.6, least_words=40)
    assert {(r["id"], r["representative"], r["copies"]) for r in members.collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (7, 7, 1)}
    assert {(r["a"], r["b"]) for r in d.pairs_of_rows(pairs, members).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r["a"], r["b"]) for r in d.pairs_of_rows(pairs, members, expand=2).collect()} == {(1, 2), (1, 3)}
    assert {(r["id"], r["group"]) for r in d.grouped(pairs, members).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7)}
    none = d.similar(chunks([]), width=3, similarity=0.6)
    assert d.pairs_of_rows(*none).count() == 0 and d.grouped(*none).count() == 0


def test_groups_are_components(spark, chunks):
    rows = edits(120, 5)
    pairs, members = d.similar(chunks(rows), width=3, similarity=0.6)
    links = {(r["a"], r["b"]) for r in d.pairs_of_rows(pairs, members).collect()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {(r["id"], r["group"]) for r in d.grouped(pairs, members).collect()} == {(i, root(i)) for i, _ in rows}


@pytest.mark.parametrize("others", [0, 80])
def test_blocks_keep_pairs_of_exactly_the_similarity(others):
    rng = np.random.default_rng(4)
    kept = 0
    for _ in range(20):
        base = np.sort(rng.integers(0, 1 << 63, 10, dtype=np.uint64))
        sets = [base[:8], base, *[np.sort(rng.integers(0, 1 << 63, 10, dtype=np.uint64)) for _ in range(others)]]
        raw = [d.sketch(x) for x in sets]
        ends, n = np.cumsum([0] + [len(r) for r in raw]), len(sets)
        rows = {"id": np.arange(n), "size": np.array([len(x) for x in sets]), "band": np.zeros(n, int), "part": np.zeros(n, int), "split": np.zeros(n, bool), "raw": np.frombuffer(b"".join(raw), np.uint8), "from": ends[:-1]}
        kept += (0, 1) in {(int(i), int(j)) for a, b in d._Block(rows, 0.8).near() for i, j in zip(a, b)}
    assert kept == 20


def test_exactly_the_default_similarity(spark, chunks):
    rows = []
    for k in range(15):
        words = [f"t{k}w{i}" for i in range(10)]
        rows += [(2 * k + 1, " ".join(words)), (2 * k + 2, " ".join(words[:8]))]
    pairs, _ = d.similar(chunks(rows), width=1, similarity=0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == by_hand(rows, 1, 0.8, 0)
