"""The corpus pipeline: five stages over `documents`, each on all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, language_id, mixing, near_dup, sharding
from marlstone.llm.common import drop_stored, stored, table

#: A text is rejected if its main language has less than this share of its letters.
LEAST_SCORE = 0.5
SHARDS = 24


def _packed(docs: DataFrame, *beside: str) -> DataFrame:
    """The columns in beside, and all others in one struct `_row`: no name of theirs can clash with an operator's."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"]
    return docs.select(*[c for c in beside if c in docs.columns], F.struct(*rest).alias("_row"), "text")


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a main language; those without a letter and those with no language in the majority go.

    A null text has no letter. Rows are judged one by one, so repeated rows stay or go together and ids and ties play
    no part. If no row has both a label and a text, nothing can be learned, and every text with a letter stays. No
    rows: no rows.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = language_id.identify(_packed(docs), model)
    return _unpacked(found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the least doc_id.

    Rows without an id come last and stay if nothing else has their text; two texts of one id are two documents; a
    row that repeats stays once. Null texts and texts without words are duplicates of nothing and stay. No rows: no
    rows.
    """
    return near_dup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; n_chars follows. Clean documents stay as they are.

    Every row stays, whatever its id, and repeated rows stay equal; a null text stays null. An empty benchmark
    changes nothing. No rows: no rows.
    """
    found = decontaminate.find_leaks(_packed(docs), table(spark, sf_dir, "benchmark"), cut=True)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))
        found = found.withColumn("_row", F.col("_row").withField("n_chars", n_chars))
    return _unpacked(found, docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix of sources takes it, or leaves it out.

    A null source is a source. Rows of one id go together, rows without an id if they have one text. Null and empty
    texts have no words; they are taken with the keys around them. No rows: no rows.
    """
    mixed = mixing.mix(_packed(docs, "doc_id", "source"), keep=["_row", "text"])
    return _unpacked(mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document, copies included.

    Equal rows get a slot each; a null id goes where id 0 goes; a null text counts as empty. No rows: no rows.
    """
    return sharding.shard(docs, SHARDS)


STAGES = [("language ID", language_stage), ("near duplicates", near_dup_stage), ("decontamination", decontaminate_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]
#: Language ID and near duplicates are beyond SQL; tests/llm/test_pipeline.py holds each stage, and run(), against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
