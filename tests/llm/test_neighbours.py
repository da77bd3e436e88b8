import numpy as np
from pyspark.sql import functions as F
from tidepack.llm.neighbours import Search, Shard, learn, neighbours


def exact(ids, v, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        others = np.flatnonzero(ids != ids[i])
        score = (v[others] * v[i]).sum(axis=1)
        best = np.lexsort((ids[others], -score))[:k]
        out[int(ids[i])] = [(int(a), float(s)) for a, s in zip(ids[others[best]], score[best])]
    return out


def test_recall_and_scores_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in neighbours(df, F.col("vec_id") % 20 == 0, settings=Search(shard=700, block=40)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = df.select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    want, scores = exact(ids, v), dict(zip(ids.tolist(), v, strict=True))
    assert got.keys() == want.keys()
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - scores[q] @ scores[i]) < 1e-12 for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hit >= 0.93 * 20 * len(want)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(17)
    v = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, (900, 1))
    codes = learn(v, float(np.linalg.norm(v, axis=1).max()))
    shard = Shard(codes, np.arange(900), v)
    for radius in (0, 3, 7, 11, 16):
        for code in codes.of(v[:40], True):
            apart = np.bitwise_count(shard.packed ^ code).sum(axis=1)
            assert list(shard.within(code, radius)) == list(np.flatnonzero(apart <= radius))


def test_odd_vectors_ties_and_few_rows(spark):
    rows = [(20, [1.0, 0.0], 1), (40, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (60, None, 1), (80, [0.0, 0.0], 1), (100, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (7, [float("inf"), 1.0], 1), (9, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = neighbours(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 3, 1.0), (20, 2, 40, 1.0), (20, 3, 1, 0.5), (40, 1, 3, 1.0), (40, 2, 20, 1.0), (40, 3, 1, 0.5)]
    assert neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours(df.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_rows_and_ids_give_distinct_neighbours(spark):
    rng = np.random.default_rng(20)
    v = np.round(rng.normal(size=(60, 4)), 2)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [rows[20]] * 30 + [rows[7]] * 30 + [(40, [9.0, 0.0, 0.0, 0.0]), (9, [0.0, 9.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours(df, F.col("vec_id") % 20 == 0, settings=Search(shard=16, block=2)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {0, 20, 40}
    for q, found in got.items():
        top = {}
        for a, x in rows:
            for b, y in rows:
                if a == q and b != q:
                    top[b] = max(top.get(b, -np.inf), float((np.array(x) * np.array(y)).sum()))
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21)) and len({i for _, i, _ in found}) == 20
        assert all(abs(s - top[i]) < 1e-9 for _, i, s in found)
        want = sorted(top, key=lambda b: (-top[b], b))[:20]
        assert len({i for _, i, _ in found} & set(want)) >= 18
