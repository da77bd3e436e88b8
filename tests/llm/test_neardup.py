import random

import numpy as np
import pytest
from tidepack.llm import components as graph
from tidepack.llm.components import components
from tidepack.llm.neardup import CORPUS, Near, bands, estimate, near_duplicates, registers, shingles


def plain(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, percent=85, width=3):
    sets = [plain(t, width) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return sorted((r[0], len(s), rows[root(i)][0], rows[root(i)][0] == r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


@pytest.mark.parametrize("block", [512, 7])
def test_components_against_brute_force(spark, block):
    rng = random.Random(8)
    texts = [None, "", " \n", "a", "A", "a b", "b a", "É b", "é b"]
    shared = [f"s{i}" for i in range(60)]
    for _ in range(60):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(2, 200))]
        if rng.random() < 0.4:
            words += shared
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = edited(rng, words, rng.randint(0, max(1, len(words) // 25)))
            texts.append(" ".join(words).upper() if rng.random() < 0.3 else "  ".join(words))
    base = [f"w{i}" for i in range(150)]
    texts += [" ".join(edited(rng, base, 3)) for _ in range(80)] + [" ".join(base)] * 5
    texts.append(" ".join(str(rng.random()) for _ in range(20_000)))
    rows = [(i * 3 % 1009, t, 5) for i, t in enumerate(texts)]
    rows += rows[20:24]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int"), Near(block=block)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_near_duplicates_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(4, None), (5, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_estimates_and_bands():
    rng = random.Random(9)
    errors, hits = [], 0
    for n in [40, 200, 1000] * 30:
        words = [str(rng.random()) for _ in range(n)]
        a, b = (shingles(" ".join(w).encode()) for w in (words, edited(rng, words, n // 40)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = registers(a)[None], registers(b)[None]
        got, error = estimate(ra, rb, np.array([len(a)]), np.array([len(b)]))
        errors.append((got[0] - true) / max(error[0], 1e-9))
        hits += bool((bands(ra) == bands(rb)).any())
    assert max(map(abs, errors)) < 6 and hits == 90


@pytest.mark.parametrize("piece", [3, 1 << 20])
def test_connected_components(spark, monkeypatch, piece):
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        if u != v:
            parent[max(a, b)] = min(a, b)
    monkeypatch.setattr(graph, "PIECE", piece)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for u, v in edges if u != v for x in (u, v)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_null_ids_are_linked_with_nothing(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = near_duplicates(spark.createDataFrame([(5, text), (None, text), (None, text), (3, text)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(5, 3, False), (3, 3, True), (None, None, True), (None, None, True)], key=str)


def test_recall_for_corpora(spark):
    """Pairs at and above 80 % of five-word shingles, as the pipeline takes them."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 300))]
        rows += [(2 * i, " ".join(words), 0), (2 * i + 1, " ".join(edited(rng, words, max(1, len(words) // 48))), 0)]
    want = brute(rows, CORPUS.percent, CORPUS.width)
    assert 40 < sum(not w[3] for w in want) < 145
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, cid int"), CORPUS).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
