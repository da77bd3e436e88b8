"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, in DataFrame operations.

Targets: sources in code-point order (null last) get the weights in turn and share `share` times all sizes; none
goes above `most` times its own size, and what is cut off goes to the others by weight. That is water filling: with
sources sorted by most * size / weight, each target is min(most * size, level * weight), and one window over the
sources finds the level.

Blocks: the total is dealt in blocks of `block` words to the highest quotients target / (2k + 1). Divisors a little
above and below the average bound how many blocks each party surely gets and can get at most, so only about two
quotients per party are ranked. A source's blocks are dealt to its shards by size in the same way. Shards hold
about `shard_words` words, so a hot source is many shards and a small one is one. Within a shard the documents lie
end to end in a seeded order, a circle of words; the quota takes whole passes and then an arc of blocks from a
seeded start. A document's words are its overlap with these; no document is taken more than `most` times.

Null texts have size 0. Null sources are one source. Documents with null ids are dealt to shards by their texts. Rows that
repeat are documents of their own; the order among equal rows does not matter. Documents without words, and empty tables,
take nothing. A text longer than a shard is a shard's most part, whole. Other columns of docs are not looked at, but for
those to carry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]++"


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block: int = 64
    shard_words: int = 1 << 21
    seed: str = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(text: Column) -> Column:
    """32 seeded bits."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, group: list[str], key: str, share: str, total: str) -> DataFrame:
    """parties with `quota`: total (one number for each group) dealt to the highest quotients share / (2k + 1),
    ties to the smaller key."""
    within = Window.partitionBy(*group)
    s, n, t = (f.over(within) for f in (F.sum(share), F.count(F.lit(1)), F.max(total)))
    seats = lambda divisor: F.floor(F.col(share) / divisor + 0.5)
    bounds = parties.withColumns({"_s": s.cast("double"), "_n": n, "_t": t.cast("double")}).withColumns(
        {
            "_least": F.when((F.col("_s") > 0) & (F.col("_t") > F.col("_n") / 2), seats(F.col("_s") / (F.col("_t") - F.col("_n") / 2))).otherwise(F.lit(0)).cast("long"),
            "_most": F.when((F.col("_s") > 0) & (F.col(share) > 0) & (F.col("_t") > 0), seats(F.col("_s") / (F.col("_t") + F.col("_n") / 2)) + 1).otherwise(F.lit(0)).cast("long"),
        }
    )
    bounds = bounds.withColumn("_open", F.col("_t").cast("long") - F.sum("_least").over(within))
    rows = bounds.withColumn("_k", F.explode_outer(F.when(F.col("_most") > F.col("_least"), F.sequence("_least", F.col("_most") - 1))))
    rows = rows.withColumn("_q", F.when(F.col("_k").isNotNull(), F.col(share) / (2 * F.col("_k") + 1)))
    place = F.row_number().over(within.orderBy(F.col("_q").desc_nulls_last(), F.col(key).asc_nulls_last(), "_k"))
    rows = rows.withColumn("_won", (F.col("_q").isNotNull() & (place <= F.col("_open"))).cast("long"))
    return rows.groupBy(*parties.columns).agg((F.max("_least") + F.sum("_won")).alias("quota"))


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """sources (source, source_size) with the columns place, target and blocks, the total's number of blocks."""
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), ((F.col("place") - 1) % len(mix.weights) + 1).cast("int"))
    cap = mix.most * F.col("source_size")
    df = sources.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight)
    df = df.withColumns({"total": mix.share * F.sum("source_size").over(one), "ratio": cap / F.col("weight")})
    upto = one.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = one.orderBy("ratio", "place").rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(upto), F.lit(0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(one)["level"]
    df = df.withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("weight") * level, F.lit(0.0))))
    return df.select("source", "source_size", "place", "target", F.round(F.col("total") / mix.block).cast("long").alias("blocks"))


def mix_documents(docs: DataFrame, settings: Mix = Mix(), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and how it is taken: `passes` whole copies
    and the words [from1, to1) and [from2, to2). carry: further columns of docs to keep."""
    # what a document is drawn by: its id, or without one its text
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_key")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key, *(F.col(c).alias(f"kept_{c}") for c in carry))
    if carry:
        sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key)
    else:
        sizes = sized = materialize(sized, "sizes")
    b, m = settings.block, settings.most
    drawn = F.md5(F.concat_ws(":", F.lit(settings.seed), "_key").cast("binary"))

    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), settings)
    sources = apportion(sources.withColumn("one", F.lit(0)), ["one"], "place", "target", "blocks").drop("one", "blocks")
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / settings.shard_words)))
    sources = materialize(sources.withColumnRenamed("source", "_source"), "targets")

    def placed(df: DataFrame) -> DataFrame:
        at = df.withColumn("_draw", drawn).join(sources, F.col("source").eqNullSafe(F.col("_source")))
        return at.withColumn("shard", F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") % F.col("shards"))

    shards = placed(sizes).groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.max("quota").alias("total"))
    shards = apportion(shards, ["place"], "shard", "shard_size", "total").withColumnsRenamed({"place": "_place", "shard": "_shard"}).drop("total")
    start = _draw(F.concat_ws(":", F.lit(settings.seed), "_place", "_shard")) % F.greatest(F.lit(1), F.ceil(F.col("shard_size") / b)) * b
    words = F.least(F.col("quota") * b, m * F.col("shard_size"))
    passes = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    shards = shards.withColumns({"passes": passes, "arc_from": start}).withColumn("arc_to", F.col("arc_from") + words - F.col("passes") * F.col("shard_size"))
    shards = materialize(shards.drop("quota"), "shards")

    order = Window.partitionBy("place", "shard").orderBy("_draw", "doc_id", "size", *([F.xxhash64(*(f"kept_{c}" for c in carry))] if carry else [])).rowsBetween(Window.unboundedPreceding, -1)
    # the shard's documents lie on a circle, so the arc may go on at 0; the sort is within the shard that the join uses too
    df = placed(sized).drop("_source").withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    df = df.join(shards.drop("quota"), (F.col("place") == F.col("_place")) & (F.col("shard") == F.col("_shard")))
    bound = lambda x: F.greatest(F.lit(0), F.least(F.col("size"), x)).cast("long")
    df = df.withColumns({"from1": bound(F.col("arc_from") - F.col("at")), "to1": bound(F.col("arc_to") - F.col("at")), "from2": F.lit(0).cast("long"), "to2": bound(F.col("arc_to") - F.col("shard_size") - F.col("at"))})
    taken = F.col("passes") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    return df.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "passes", "from1", "to1", "from2", "to2", *(F.col(f"kept_{c}").alias(c) for c in carry))
