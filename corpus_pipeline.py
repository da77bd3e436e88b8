"""The corpus pipeline: each stage reads what the one before it kept, as Parquet.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. Null and empty
texts are rejected by the first stage, and stages that meet them keep them. Extra columns of documents are left out.
Empty tables give empty tables. Very long texts go through whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepack.llm.common import materialize, pick, table
from tidepack.llm.mixing import mix_documents
from tidepack.llm.neardup import CORPUS, kept_texts, text_key
from tidepack.llm.packing import pack
from tidepack.llm.pii import redact
from tidepack.llm.quality import keep_good

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, as they are."""
    return keep_good(pick(docs, *COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, 80 % or more): that with the smallest id, once if its row is repeated.
    Rows that share an id but not the text are documents of their own. Rows with null ids stay. The join deals texts
    by id and text, and the aggregation keeps them there."""
    docs = pick(docs, *COLUMNS)
    keyed = docs.withColumn("text_key", text_key(F.col("text")))
    kept = keyed.join(kept_texts(docs, CORPUS), ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min(F.struct(*COLUMNS[1:])).alias("d"))
    return kept.select("doc_id", "d.*").unionByName(docs.filter("doc_id is null"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return redact(pick(docs, *COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and where a block's edge lies in a document, the
    words on the taken side of it with the white space between them."""
    mixed = mix_documents(pick(docs, *COLUMNS), carry=("text", "lang", "source", "n_chars"))
    copies = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("passes").cast("int"))
    parts = F.array(*(F.struct(F.col(f"from{i}").alias("a"), F.col(f"to{i}").alias("b")) for i in (1, 2)))
    takes = F.filter(F.concat(copies, parts), lambda p: p["a"] < p["b"])
    df = mixed.withColumn("take", F.explode(takes))
    # each element is a word with the white space behind it
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.concat_ws("", F.slice(words, F.col("take.a").cast("int") + 1, (F.col("take.b") - F.col("take.a")).cast("int")))
    whole = (F.col("take.a") == 0) & (F.col("take.b") == F.col("size"))
    text = F.when(whole, F.col("text")).otherwise(cut)
    return df.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset there: null and empty texts are one piece, the end id
    alone; very long texts are cut; rows that repeat, as mixing makes them, are packed each."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Register signatures, tokenizers and learned patterns have no SQL form; tests/llm compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents in sf_dir. What each stage keeps is written to the shared folder and read
    again, so a lost executor costs one stage's tasks at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
