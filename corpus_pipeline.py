"""A corpus pipeline of five of the corpus operators, each stage over all that the one before it kept.

Each stage takes (spark, docs, sf_dir), with docs the columns of `documents`, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of `documents`, with the caller's values: while an operator runs, all columns but
the id and the text stand aside under other names, so none is taken for, or replaced by, a result of its own.

Every row is a document of its own, whether its id is null, shared or neither. Defined results, for each
stage: an empty table gives an empty one; extra columns of any name pass through; a null or empty text is
`und` and goes in the language stage, and is clean, unique, of size 0 (so never taken) and without tokens
in the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, langid, minhash, mixing, toxicity
from plumbline.llm.common import scratch, settled

#: A document goes if no language holds this share of it.
LEAST_SHARE = 0.5


def _aside(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text under names that no operator uses."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col(c if c in ("doc_id", "text") else f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that are `und`, or a mixture without a main language, go. Equal texts, equal verdicts."""
    found = langid.identify(_aside(docs), langid.fit(docs), keep_text=True)
    return _back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Equal texts, equal verdicts."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(toxicity.score(_aside(docs), model, keep_text=True).where("predicted = 0"), docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id (null last), and of those the one read first.

    Rows are told apart by a key, not by their ids: rows of one id with different texts stay, and copies
    without an id go. Documents without a text or words are near duplicates of nothing.
    """
    folder = scratch(spark)
    keyed = settled(_aside(docs).withColumn("_key", F.monotonically_increasing_id()), folder, "keyed")
    groups = settled(
        minhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text", F.col("doc_id").alias("_id")), folder, keep=["_id"]), folder, "groups",
    )
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", F.col("doc_id").alias("_key"))).alias("_first")).select("_first._key")
    return _back(keyed.join(first, "_key", "left_semi"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it is taken, which is told by a key, as ids may be null or shared."""
    folder = scratch(spark)
    keyed = settled(_aside(docs).withColumn("source", F.col(f"_own_{docs.columns.index('source')}")).withColumn("_key", F.monotonically_increasing_id()), folder, "keyed")
    taken = mixing.mix(keyed, key="_key", folder=f"{folder}/mix").where("taken > 0").select("_key", F.expr("cast(taken div size as int)").alias("_times"))
    return _back(keyed.join(taken, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 of each row; repeated rows give equal rows."""
    return bpe.token_digests(docs.select("doc_id", "source", "text"), bpe.public_path())


STAGES = [
    ("language", language),
    ("toxicity", clean),
    ("near_duplicates", unique),
    ("mix", mixed),
    ("tokens", tokens),
]

#: No SQL: language, toxicity and tokens can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
