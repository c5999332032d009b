"""Corpus preparation: language, exact copies, near copies, mix of sources, packed sequences.

Every stage takes documents with any further columns, whatever their names, and keeps them. A null text counts as empty; texts are
read whole; ids may be null or repeated; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.frames import free_prefix
from maskwright.llm import exact_dedup, jaccard_join, langid, mixing, packing
from maskwright.llm.common import discard, documents, hinted, small_batches, stored
from maskwright.llm.entry import tokenizer_path


def _key() -> Column:
    """A text's key, the same that the operators give."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those whose id and text key (``id``, ``key``) are in ``dropped``; texts move only if that is large."""
    dropped = stored(dropped.select("id", "key").distinct(), "dropped")
    side = hinted(dropped, dropped.count(), 24)
    at = free_prefix(docs)
    side = side.select(F.col("id").alias(f"{at}id"), F.col("key").alias(f"{at}side"))
    keyed = docs.withColumn(f"{at}key", _key())
    same = (F.col(f"{at}key") == F.col(f"{at}side")) & F.col("doc_id").eqNullSafe(F.col(f"{at}id"))
    return keyed.join(side, same, "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without a letter go."""
    small_batches(spark)
    profiles = langid.learned_profiles(docs)
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), _key().alias("key")).alias("row"), "text")
    unknown = langid.predict(keyed, profiles, id_col="row").filter(F.col("lang_pred") == langid.UNKNOWN)
    return _without(docs, unknown.select("row.*")) if profiles else docs


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of rows that repeat id and text one."""
    small_batches(spark)
    groups = stored(exact_dedup.exact_duplicates(docs), "exact")
    kept = _without(docs, groups.filter("NOT kept").select(F.col("doc_id").alias("id"), "key"))
    repeats = stored(groups.filter("kept AND id_rows > 1").select(F.col("doc_id").alias("id"), "key").distinct(), "repeats")
    if not repeats.limit(1).count():
        return kept
    once = _without(kept, repeats)
    at = free_prefix(docs)
    side = repeats.select(F.col("id").alias(f"{at}id"), F.col("key").alias(f"{at}side"))
    same = (F.col(f"{at}key") == F.col(f"{at}side")) & F.col("doc_id").eqNullSafe(F.col(f"{at}id"))
    several = kept.withColumn(f"{at}key", _key()).join(side, same, "left_semi").select(docs.columns)
    return once.unionByName(several.dropDuplicates(["doc_id", "text"]))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-copy links join, the one with the smallest id; of those that share it, the one with the smallest text key."""
    small_batches(spark)
    joined = jaccard_join.jaccard_components(docs)
    return _without(docs, joined.filter("NOT kept").select(F.col("doc_id").alias("id"), "key"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for; a document that is taken twice gives two rows.

    Rows that share id, source and size are taken as often as the one of them that is taken most.
    """
    small_batches(spark)
    same, at = ["doc_id", "source", "size"], free_prefix(docs)
    taken = stored(mixing.mix(docs).groupBy(*same).agg(F.max("repeats").cast("int").alias("repeats")).filter("repeats > 0"), "taken")
    side = hinted(taken, taken.count(), 64).select(*[F.col(c).alias(f"{at}{c}") for c in same], F.col("repeats").alias(f"{at}repeats"))
    sized = docs.withColumn(f"{at}n", mixing.size_of("text"))
    both = F.col("doc_id").eqNullSafe(F.col(f"{at}doc_id")) & F.col("source").eqNullSafe(F.col(f"{at}source")) & (F.col(f"{at}n") == F.col(f"{at}size"))
    return sized.join(side, both).withColumn(f"{at}repeat", F.explode(F.sequence(F.lit(1), F.col(f"{at}repeats")))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language identification", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: Tokens and n-gram distances have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again; what the one before wrote goes then."""
    docs, last = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
        discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
