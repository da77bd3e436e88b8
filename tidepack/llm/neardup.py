"""Near-duplicate documents by HyperMinHash signatures, banding, estimates and exact confirmation.

Signature: a document's distinct shingles (of three words, unless told otherwise) are hashed to 64 bits. The top 8 bits
choose one of 256 buckets;
of the smallest hash in a bucket only the number of leading zeros and the next 10 bits stay, 16 bits a register.
Empty registers borrow from others at fixed random distances (for the bands only), so short documents collide
no more easily than long ones.

Candidates: bands, by default 36 of 7 registers. Documents with equal sets (a 128-bit digest) are one class from the
start and only its representative goes on. In each band bucket members are first compared with two centres, its smallest and
its largest representative, not with each other; the confirmed links give components. Buckets whose members are
then still in different components are compared in full, in pairs of blocks of bounded size, each by one product of
incidence matrices, and only the links that join components come back. Members whose sizes and estimates rule out
every partner are left out before. So no pair that shares a band is lost, groups of copies cost as many comparisons as
they have members, and no pairs are listed. At 85 % similarity a pair shares none with probability
(1 - 0.85 ** 7) ** 36 < 1e-6.

Before confirmation a candidate's size ratio and its estimate are checked: registers that agree, less the number
that would agree by chance (the collision correction), over registers in use. Those further below the threshold
than six standard errors, of an estimate at the threshold, are dropped. The rest are confirmed on the full sets, built
again from the whole texts.

Null or empty texts, and those without words, have no shingles and are linked with nothing. A document with fewer
words than a shingle has one shingle, the whole sequence. Repeated rows are linked like copies. A row with a null id is
linked with nothing and kept, whatever its text. Very long texts are read whole. Empty tables give no rows. Other columns
of docs are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, pick, slices, texts_of
from .components import components

BUCKETS, MANTISSA = 256, 10
#: Shingles of a block, and pairs of it, that are looked at together.
COLUMNS, PAIRS = 4096, 20_000
#: Words whose hashes a task remembers.
REMEMBER = 200_000
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass(frozen=True)
class Near:
    """Documents are linked if 100 * shared shingles >= percent * shingles of either. width: words in a shingle.
    bands of rows registers each: bands * rows <= 256. block: members of a bucket that a task compares with as many."""

    percent: int = 85
    width: int = 3
    bands: int = 36
    rows: int = 7
    block: int = 512


#: For corpora at large: five words, and at 80 % a pair shares no band with probability (1 - 0.8 ** 6) ** 42 < 1e-5.
CORPUS = Near(80, 5, 42, 6)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = 3, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. known: hashes of words, to be added to."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    if len(known) > REMEMBER:
        known.clear()
    for w in {w for w in words if w not in known}:  # a difference with the keys would walk through all of them
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * _K[0] + h[k : k + len(out)] * _K[1] + _K[2])
    return np.unique(out)


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    """256 registers: 0 if empty, else 1 + leading zeros * 1024 + mantissa of the smallest hash in the bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (sorted_hashes >> np.uint64(56)).astype(np.int64)
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, bool)
    low = ((sorted_hashes[first] & np.uint64((1 << 56) - 1)) >> np.uint64(4)).astype(np.float64)  # 52 bits, exact
    m, e = np.frexp(low)
    zeros = np.where(low > 0, 52 - e, 52)
    mantissa = np.where(low > 0, (m * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out[bucket[first]] = 1 + (zeros << MANTISSA) + mantissa
    return out


_SHIFTS = np.random.Generator(np.random.PCG64(7)).permutation(np.arange(1, BUCKETS))


def bands(regs: np.ndarray, near: Near = Near()) -> np.ndarray:
    """Band keys (documents x bands) of registers (documents x 256); rows need one register in use at least."""
    full = regs.copy()
    rows = np.flatnonzero((full == 0).any(axis=1))
    for shift in _SHIFTS:
        if not len(rows):
            break
        part = full[rows]
        full[rows] = np.where(part == 0, np.roll(regs[rows], -shift, axis=1), part)
        rows = rows[(full[rows] == 0).any(axis=1)]
    cells = full[:, : near.bands * near.rows].reshape(-1, near.bands, near.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, near.bands + 1, dtype=np.uint64), cells.shape[:2])
        for k in range(near.rows):
            key = _mix(key * _K[0] + cells[:, :, k] + _K[2])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, share: float = 0.85) -> tuple[np.ndarray, np.ndarray]:
    """Corrected similarity of register rows, and its standard error at a similarity of `share`."""
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    agree = ((a == b) & (a > 0)).sum(axis=1)
    x, y = n_a[:, None] / BUCKETS, n_b[:, None] / BUCKETS
    high = 2.0 ** -np.arange(0, 40)[None, :]
    low, width = high / 2, high / 2 / (1 << MANTISSA)
    # two independent minima fall into the same cell: density x * y * exp(-(x + y) t), cells of a width in [low, high)
    chance = (x * y / (x + y) * (np.exp(-(x + y) * low) - np.exp(-(x + y) * high)) * width).sum(axis=1) * a.shape[1]
    return np.clip((agree - chance) / np.maximum(used - chance, 1e-9), 0, 1), np.sqrt(share * (1 - share) / used)


def text_key(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def signatures(docs: DataFrame, near: Near = Near()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches):
            sets = [shingles(t, near.width, known) for t in texts_of(batch)]
            regs = np.stack([registers(s) for s in sets])
            some = np.array([len(s) > 0 for s in sets])
            keys = np.zeros((len(sets), near.bands), np.int64)
            keys[some] = bands(regs[some], near)
            counts = np.where(some, near.bands, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() if k else None for r, k in zip(regs, some, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(keys[some].ravel())),
                ],
                names=["doc_id", "text_key", "n_shingles", "digest", "regs", "bands"],
            )

    keyed = pick(docs, "doc_id", "text").withColumn("text_key", text_key(F.col("text")))
    return map_arrow(keyed, run, "doc_id long, text_key long, n_shingles long, digest binary, regs binary, bands array<long>")


def _plausible(pairs: DataFrame, near: Near) -> DataFrame:
    """Pairs (u, v, u_n, v_n, u_regs, v_regs) that the estimate does not rule out, as (u, v)."""
    share = near.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            regs = [np.frombuffer(b"".join(at[c].to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("u_regs", "v_regs")]
            got, error = estimate(*regs, *(at[c].to_numpy(zero_copy_only=False).astype(float) for c in ("u_n", "v_n")), share)
            yield pa.RecordBatch.from_arrays([at["u"], at["v"]], names=["u", "v"]).filter(pa.array(got >= share - 6 * error))

    return map_arrow(pairs, run, "u long, v long")


def _sets(docs: DataFrame, near: Near) -> DataFrame:
    """digest, set: the full sets of documents, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches):
            sets = [shingles(t, near.width, known).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "set"])

    return map_arrow(pick(docs, "doc_id", "text"), run, "digest binary, set binary")


def _confirmed(pairs: DataFrame, near: Near) -> DataFrame:
    """Pairs (u, v, u_set, v_set) whose full sets are similar enough, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "v_set"):
                keep = []
                for s, t in zip(texts_of(batch, "u_set"), texts_of(batch, "v_set"), strict=True):
                    both = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True))
                    keep.append(100 * both >= near.percent * ((len(s) + len(t)) // 8 - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs, run, "u long, v long")


def _linked(sets: list[np.ndarray], comp: np.ndarray, apart: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs whose sets are similar enough and whose components and sides (apart, unless 0) differ. All
    intersections at once: products of the incidence matrix of shingles that occur twice, some columns at a time."""
    n = np.array([len(s) for s in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    of, column = of[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (k, k + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - k)), np.float32)
        part[of[a:b], column[a:b] - k] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    ok = 100 * both >= near.percent * (n[:, None] + n[None] - both)
    ok &= (comp[:, None] != comp[None]) & ((apart[:, None] != apart[None]) | (apart[:, None] == 0))
    return np.nonzero(np.triu(ok, 1))


def _promising(regs: np.ndarray, n: np.ndarray, comp: np.ndarray, apart: np.ndarray, near: Near) -> np.ndarray:
    """Which members have a partner in another component that sizes and estimates do not rule out."""
    u, v = np.triu_indices(len(n), 1)
    ok = (comp[u] != comp[v]) & ((apart[u] != apart[v]) | (apart[u] == 0))
    ok &= 100 * np.minimum(n[u], n[v]) >= near.percent * np.maximum(n[u], n[v])
    u, v = u[ok], v[ok]
    found = np.zeros(len(n), bool)
    for k in range(0, len(u), PAIRS):
        a, b = u[k : k + PAIRS], v[k : k + PAIRS]
        x, y = regs[a], regs[b]
        share, used = near.percent / 100, np.maximum(((x | y) > 0).sum(axis=1), 1)
        # chance agreements only raise the share of registers that agree, so few need the correction
        high = ((x == y) & (x > 0)).sum(axis=1) / used >= share - 6 * np.sqrt(share * (1 - share) / used)
        a, b = a[high], b[high]
        got, error = estimate(regs[a], regs[b], n[a].astype(float), n[b].astype(float), share)
        good = got >= share - 6 * error
        found[a[good]] = found[b[good]] = True
    return found


def _in_groups(members: DataFrame, value: str, work, schema: str) -> DataFrame:
    """work over the rows of each bucket, or pair of blocks of a large one. members: key, i, j, side, cid, comp, n and a
    value. work gets lists of the last five."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            out = []
            for *at, side, cid, comp, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != group:
                    if len(rows) > 1:
                        out.append(work(group, rows))
                    group, rows = at, []
                rows.append((side, cid, comp, n, x))
            yield from out
        if len(rows) > 1:
            yield work(group, rows)

    sorted_ = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_arrow(sorted_.select("key", "i", "j", "side", "cid", "comp", "n", value), run, schema)


def _narrowed(members: DataFrame, near: Near) -> DataFrame:
    """Those members that a partner may be linked with."""

    def work(group: list, rows: list[tuple]) -> pa.RecordBatch:
        side, cid, comp, n = (np.array([r[k] for r in rows]) for k in range(4))
        regs = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), -1)
        keep = _promising(regs, n, comp, side, near)
        fixed = [pa.array(np.full(int(keep.sum()), x), t) for x, t in zip(group, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([*fixed, *(pa.array(x[keep], t) for x, t in zip((side, cid, comp, n), kinds, strict=True))], names=["key", "i", "j", "side", "cid", "comp", "n"])

    return _in_groups(members, "regs", work, "key long, i int, j int, side int, cid long, comp long, n long")


def _joining(members: DataFrame, near: Near) -> DataFrame:
    """Links (u, v) between components by full sets, no more than join up what a group holds."""

    def work(group: list, rows: list[tuple]) -> pa.RecordBatch:
        side, cid, comp = (np.array([r[k] for r in rows]) for k in range(3))
        u, v = _linked([np.frombuffer(r[4], np.uint64) for r in rows], comp, side, near)
        if len(u):
            # one link between two components is enough
            ends = np.stack([np.minimum(comp[u], comp[v]), np.maximum(comp[u], comp[v])])
            first = np.unique(ends, axis=1, return_index=True)[1]
            u, v = u[first], v[first]
        return pa.RecordBatch.from_arrays([pa.array(cid[u], pa.int64()), pa.array(cid[v], pa.int64())], names=["u", "v"])

    return _in_groups(members, "set", work, "u long, v long")


def links(docs: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """node, component: confirmed links between classes (cid, digest, rep, n, regs, bands; one row per distinct set)
    joined up. Classes without links need not appear."""
    share = near.percent / 100
    keys = classes.select("cid", "n", F.explode("bands").alias("key"))
    crowd = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("cid").alias("low"), F.max("cid").alias("high")).filter("c > 1")
    member = materialize(keys.join(crowd.drop("c"), "key"), "buckets")  # only buckets with company

    def sets_of(cids: DataFrame) -> DataFrame:
        """cid, set. Ids may be repeated with other texts, so a set counts for its class, not for its id."""
        named = cids.distinct().join(classes.select("cid", "digest", "rep"), "cid")
        sets = _sets(docs.join(named.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), near)
        return materialize(sets.join(named.select("cid", "digest"), "digest").groupBy("cid").agg(F.first("set").alias("set")), "sets")

    # members with the centres
    pairs = member.select(F.col("cid").alias("u"), F.explode(F.array("low", "high")).alias("v"))
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    for side in ("u", "v"):
        pairs = pairs.join(classes.select(F.col("cid").alias(side), F.col("n").alias(f"{side}_n"), F.col("regs").alias(f"{side}_regs")), side)
    pairs = pairs.filter(F.least("u_n", "v_n") >= share * F.greatest("u_n", "v_n"))
    pairs = materialize(_plausible(pairs.select("u", "v", "u_n", "v_n", "u_regs", "v_regs"), near), "plausible")
    sets = sets_of(pairs.select(F.col("u").alias("cid")).union(pairs.select("v")))
    for side in ("v", "u"):
        pairs = pairs.join(sets.select(F.col("cid").alias(side), F.col("set").alias(f"{side}_set")), side)
    found = materialize(_confirmed(pairs.select("u", "v", "u_set", "v_set"), near), "links")
    label = components(found)

    # members of different components, in blocks
    at = member.join(label, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"), "low", "n")
    mixed = at.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("n").alias("least"), F.max("n").alias("most")).filter("a <> b")
    # two members with no size in reach have no link
    mixed = mixed.filter((F.col("m") > 2) | (F.col("least") >= share * F.col("most"))).select("key", F.ceil(F.col("m") / near.block).cast("int").alias("blocks"))
    at = at.join(mixed, "key").withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # block b meets itself and every other: (b, b), (b, j) and (i, b)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    at = at.withColumn("o", other).select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"), "cid", "comp", "n")
    at = materialize(_narrowed(at.join(classes.select("cid", "regs"), "cid"), near), "members")
    more = materialize(_joining(at.join(sets_of(at.select("cid")), "cid"), near), "links")
    return label if more.isEmpty() else components(found.union(more))


def _placed(docs: DataFrame, near: Near) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, cid (the class of its set, null without shingles),
    component_id, first (the class that stays of its component: the smallest of those that hold the component's id)."""
    sigs = materialize(signatures(docs, near), "signatures").withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest")))
    classes = sigs.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    # numbered once, when the table is written
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    label = links(docs, classes, near)
    least = label.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("component").agg(F.min(F.struct("rep", "node")).alias("least"))
    linked = label.join(least, "component").select("node", "least")
    place = classes.select("digest", F.col("cid").alias("class"), "rep").join(linked, F.col("class") == F.col("node"), "left")
    place = materialize(place.select(F.col("digest").alias("_digest"), "class", F.coalesce("least.rep", "rep").alias("component_id"), F.coalesce("least.node", "class").alias("first")), "places")
    df = sigs.join(place, F.col("digest") == F.col("_digest"), "left")
    return df.select("doc_id", "text_key", "n_shingles", F.col("class").alias("cid"), F.coalesce("component_id", "doc_id").alias("component_id"), "first")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked with, over any
    number of links), kept (it has that id itself)."""
    return _placed(docs, near).select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def kept_texts(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, text_key: one text of each component, of those with its smallest id, and each text without shingles.
    Ids may be repeated with other texts, which are judged each by itself. Rows with null ids are left out."""
    rows = _placed(docs, near).filter("doc_id is not null")
    one = rows.filter("cid = first and doc_id = component_id").groupBy("doc_id", "cid").agg(F.min("text_key").alias("text_key"))
    return one.select("doc_id", "text_key").union(rows.filter("cid is null").select("doc_id", "text_key").distinct())
