"""From raw documents to tokens: five stages, each over all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder and reads it
again, so a lost executor never repeats more than one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import decontaminate, near_dedup, quality, secret_scan, sentencepiece
from episodica.llm.groups import kept
from episodica.session import scratch_dir, ship_package

#: No stage but the benchmark's is in reach of SQL over whole texts; the tests compare with brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside all other columns as one struct, so that no column's name can clash with a stage's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row"), "text")


def _unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them new."""
    new = {"text": F.col("text"), **new}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them. No rows give no rows."""
    ship_package(spark)
    return _unpacked(quality.quality_rules(_packed(docs), output="found").filter("found.kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Rows that share a doc_id are one document, of which the row with the smallest text hash stays (rows equal in text are
    not told apart); rows without doc_id stay. Null and empty texts are no duplicates of each other.
    """
    ship_package(spark)
    found = near_dedup.near_duplicates(docs.select("doc_id", "text")).filter("kept AND doc_id IS NOT NULL")
    chosen = kept(found.groupBy("doc_id").count(), "chosen")
    rows = _packed(docs).withColumn("doc_id", F.col("row.doc_id"))
    alone = rows.join(chosen.filter("count = 1").hint("merge"), "doc_id", "left_semi").select("row", "text")  # one plan at every size
    shared = chosen.filter("count > 1")
    if not shared.isEmpty():  # one row of each is kept before the shuffle
        least = F.min_by(F.struct("row", "text"), F.struct(F.xxhash64("text"), "text")).alias("least")
        alone = alone.unionByName(rows.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("least.*"))
    return _unpacked(alone.unionByName(rows.filter("doc_id IS NULL").select("row", "text")), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go; null and empty texts, and all under an empty benchmark, stay."""
    ship_package(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(_packed(docs), benchmark, output="found")
    return _unpacked(found.filter("NOT found.contaminated"), docs)


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars``, where there is one, follows the new text; all documents stay."""
    ship_package(spark)
    found = secret_scan.scan_secrets(_packed(docs), output="found")
    hit = F.size("found.spans") > 0
    redacted = F.when(hit, secret_scan.redacted(F.col("text"), F.col("found.spans"))).otherwise(F.col("text"))
    out, new = found.select("row", hit.alias("hit"), redacted.alias("text")), {}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return _unpacked(out, docs, **new)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids in ``piece_ids``, which replaces such a column; null and empty texts have none."""
    ship_package(spark)
    return sentencepiece.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("secrets_redacted", secrets_redacted),
    ("encoded", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
