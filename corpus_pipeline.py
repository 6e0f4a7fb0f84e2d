"""A corpus pipeline of five stages; each works on what the one before has kept.

Quality rules and toxicity drop the documents that they reject, SimHash keeps the first document of each group of near
copies (five-word shingles, similarity 0.8), substring dedup takes repeated passages out of later documents (and drops
those that have no word left), and packing lays the rest out in sequences.

Ids are integers. Null and empty texts have no words, so the quality rules drop them; texts of any length are read whole; of ties
among near copies the row with the least (id, hash of the text) stays, a null id being the last, and of exact repeats one row; an
empty table passes through empty. Extra columns are carried through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import packing, quality, simhash, suffix_trees, toxicity
from marketloom.llm.common import bucket_of, read, small_batches, table
from marketloom.llm.queries import tokenizer

#: A text goes at the score from which op1 calls it toxic.
TOXIC = 0.3


def whole_rows(docs: DataFrame) -> DataFrame:
    """The text, and all columns as a struct, so that no column's name can clash with an operator's."""
    return docs.select(F.struct(*docs.columns).alias("__row"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    limits = quality.learn_limits(docs, read(spark, sf_dir, "labels"))
    return quality.judge(quality.measures(whole_rows(docs), ["__row"]), limits).where("kept").select("__row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~bucket_of("doc_id", 2, 4))
    return toxicity.score(whole_rows(docs), model, ["__row"]).where(F.col("score") < TOXIC).select("__row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    later = simhash.similar_texts(docs).where("NOT first").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    rows = docs.withColumn("__text", F.xxhash64("text"))
    first = rows.join(later, rows.doc_id.eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__t")), "left_anti")
    return first.dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rest = [c for c in docs.columns if c != "text"]
    found = suffix_trees.repeated_words(docs, carry=rest).where("n_words = 0 OR n_removed < n_words")
    columns = {c: F.col(f"row.{c}") for c in rest} | {"text": F.col("kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("toxicity", drop_toxic), ("simhash", near_copies), ("substring_dedup", repeated_passages), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
