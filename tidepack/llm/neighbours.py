"""Approximate nearest neighbours by inner product, with multi-index hashing of learned binary codes.

Codes: vectors get one more coordinate that makes all norms equal, so that the largest inner product is the
smallest angle; two rotations, learned on a bounded sample by iterative quantisation, give `2 * (dimension + 1)` bits.
The search radius is the Hamming distance that nearly all true neighbours of some probes keep, which are found among
all rows, in one pass.

Index: every row. Rows are dealt to shards of bounded size by a hash of their id; in a shard each 8-bit substring of
the codes has a table of buckets. With r = m * q + a, a code within radius r agrees with the query's up to q bits in one
of the first a + 1 of m substrings, or up to q - 1 bits in one of the others (pigeonhole), so probing all buckets that
near in each table finds every code within the radius. Those that pass the full distance are ranked by their inner
products in double precision. Blocks of queries meet shards of rows; each meeting gives `k` rows for a query at most, and
a window merges them. Queries that have found fewer than there are to find are asked again, with a larger radius.

Vectors that are null or zero, that hold null or non-finite components, or whose dimension is not the most frequent
one, take no part. Rows with the query's id are its own. Queries and neighbours are ids: repeated rows count once, and
where an id is repeated with other vectors, the score of two ids is the largest of their vectors'. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sample_rows, ship

_BITS = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None]).astype(np.uint8)
RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Search:
    """sample: vectors that the codes are learned on, at most. probes: those of them whose neighbours among all rows
    the radius is learned from. reach: share of these inside the radius. shard, block: rows and queries that meet in one task."""

    k: int = 20
    sample: int = 4096
    probes: int = 256
    rounds: int = 12
    reach: float = 0.97
    shard: int = 8192
    block: int = 4096
    seed: int = 6


@dataclass
class Codes:
    top: float  # largest norm
    mean: np.ndarray
    turn: np.ndarray  # dimension + 1 by bits
    radius: int

    def lifted(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (v * v).sum(axis=1), 0))
        return np.concatenate([v, rest[:, None]], axis=1)

    def of(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Packed codes, one row of bytes a vector. Queries are scaled to the common norm, without the last
        coordinate."""
        if query:
            v = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True) * self.top, np.zeros((len(v), 1))], axis=1)
        else:
            v = self.lifted(v)
        return np.packbits((v - self.mean) @ self.turn > 0, axis=1)


def _rotation(x: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Iterative quantisation: the rotation under which x is nearest to its signs."""
    turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(x @ turn).T @ x)
        turn = (left @ right).T
    return turn


def learn(v: np.ndarray, top: float, settings: Search = Search()) -> Codes:
    rng = np.random.default_rng(settings.seed)
    codes = Codes(top, np.zeros(v.shape[1] + 1), np.zeros((v.shape[1] + 1, 0)), 0)
    lifted = codes.lifted(v)
    codes.mean = lifted.mean(axis=0)
    codes.turn = np.concatenate([_rotation(lifted - codes.mean, rng, settings.rounds) for _ in range(2)], axis=1)
    return codes


def learn_radius(codes: Codes, rows: DataFrame, probes: np.ndarray, settings: Search) -> None:
    """Sets the radius. rows: id, v. A task sends on `k` rows a probe at most."""
    wanted = codes.of(probes, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, apart = np.zeros((len(probes), 0)), np.zeros((len(probes), 0), np.int64)
        for batch in batches:
            v = _arrays(pa.Table.from_batches([batch]))[1]
            if not len(v):
                continue
            inner = probes @ v.T
            inner[(probes[:, None, 0] == v[None, :, 0]) & np.isclose(inner, (probes * probes).sum(axis=1)[:, None])] = -np.inf  # itself
            bits = np.bitwise_count(wanted[:, None] ^ codes.of(v)[None]).sum(axis=2, dtype=np.int64)
            score, apart = np.concatenate([score, inner], axis=1), np.concatenate([apart, bits], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, : settings.k]
            score, apart = (np.take_along_axis(x, best, axis=1) for x in (score, apart))
        of = np.repeat(np.arange(len(probes)), score.shape[1])
        ok = np.isfinite(score.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()[ok]) for x in (of, score, apart)], names=["probe", "score", "apart"])

    near = rows.select("id", "v").mapInArrow(run, "probe long, score double, apart long")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.col("score").desc(), "apart"))
    found = near.withColumn("rank", rank).filter(F.col("rank") <= settings.k).select("apart").collect()  # probes * k at most
    codes.radius = int(np.quantile([r.apart for r in found], settings.reach)) if found else 8 * wanted.shape[1]


class Shard:
    """Rows with, for each substring of their codes, a table of buckets."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray):
        self.codes, self.ids, self.vectors, self.packed = codes, ids, vectors, codes.of(vectors)
        self.tables = [(np.argsort(c, kind="stable"), np.bincount(c, minlength=256)) for c in self.packed.T]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Which rows are in the buckets that are near enough."""
        found = np.zeros(len(self.ids), bool)
        near, more = divmod(radius, len(self.tables))
        for i, (byte, (order, sizes)) in enumerate(zip(code, self.tables, strict=True)):
            found[order[np.repeat(_BITS[byte] <= near - (i > more), sizes)]] = True
        return found

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within the radius."""
        rows = np.flatnonzero(self.probed(code, radius))
        return rows[np.bitwise_count(self.packed[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, code: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != query_id]
        return best(self.ids[rows], (self.vectors[rows] * vector).sum(axis=1), k)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k distinct ids with the largest scores, best first."""
    order = np.lexsort((ids, -score))
    if len(set(ids[order[:k]].tolist())) < len(order[:k]):
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    order = order[:k]
    return ids[order], score[order]


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def neighbours(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", settings: Search = Search()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row of `vectors` where is_query holds."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.count(F.when(F.col("query"), 1)).alias("queries"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top"))
    most = sizes.orderBy(F.col("n").desc(), "size").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == most.size)
    drawn = sample_rows(rows.select(F.xxhash64(F.lit(settings.seed), "id").alias("draw"), "v"), F.col("draw"), settings.sample, most.n)
    sample = np.array([r.v for r in sorted(drawn.collect())])
    codes = learn(sample, float(np.sqrt(most.top)), settings)
    learn_radius(codes, rows, sample[np.random.default_rng(settings.seed).permutation(len(sample))[: settings.probes]], settings)
    bits, ids = 8 * codes.of(sample[:1]).shape[1], rows.agg(F.count_distinct("id")).first()[0]
    shards, blocks = (max(1, -(-n // size)) for n, size in ((most.n, settings.shard), (most.queries, settings.block)))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select("id", "v", deal(1, shards).alias("shard"), each(blocks).alias("block"))
    queries = rows.filter("query").select("id", "v").distinct()
    k = settings.k

    def meet(radius: int, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vecs = (_arrays(t) for t in (left, right))
        out: list[tuple] = []
        if len(ids[0]) and len(vecs[0]):
            shard = Shard(codes, *ids)
            by: dict[int, list] = {}
            for q, v, code in zip(*vecs, codes.of(vecs[1], True), strict=True):
                by.setdefault(int(q), []).append(shard.nearest(q, v, code, k, radius))
            for q, each_vector in by.items():
                found, score = each_vector[0] if len(each_vector) == 1 else best(*(np.concatenate(c) for c in zip(*each_vector, strict=True)), k)
                out.append((np.full(len(found), q), found, score))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    near, radius = None, codes.radius
    while True:
        dealt = queries.select("id", "v", deal(2, blocks).alias("block"), each(shards).alias("shard"))
        found = index.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(partial(meet, radius), RESULT)
        found = materialize(found, "neighbours")
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, ids - 1)).select("query_id")
        queries = queries.join(enough, F.col("id") == F.col("query_id"), "left_anti")
        last = radius >= bits or queries.isEmpty()
        found = found if last else found.join(enough, "query_id", "left_semi")
        near = found if near is None else near.union(found)
        if last:
            break
        radius = min(bits, radius + max(1, radius // 4))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("id").to_numpy()
    flat = t.column("v").combine_chunks()
    flat = flat.flatten().to_numpy() if t.num_rows else np.zeros(0)
    return ids.astype(np.int64), flat.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))
