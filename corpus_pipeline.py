"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Each stage reads the documents that the one before it wrote to the shared
folder, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.llm import line_quality, mixing, packing, simhash, substring_dedup
from posigauge.llm.queries import PACKING, SIMHASH
from posigauge.session import scratch_path


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their source share."""
    return _measured(line_quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; documents without an id come after all others.

    Near copies are texts whose fingerprints of three-word shingles differ in
    two bits or fewer, and all that such pairs connect; null and empty texts
    have fingerprint zero. A row is named by 62 bits of a hash of its id and
    text, so texts under one id are judged apart, and of rows equal in both a
    single one stays. Two documents share a name with a chance of n^2 / 2^63
    and count as linked then. An empty table stays empty.
    """
    name = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.select(F.struct(*docs.columns).alias("row"), name.alias("name"))
    texts = rows.select("name", F.col("row.text").alias("text"))
    found = simhash.near_duplicates(texts, **SIMHASH, key="name").select("name", "component_id")
    ids = rows.select("name", F.col("row.doc_id").alias("id"))
    smallest = F.min(F.struct(F.col("id").isNull(), "id", "name")).alias("first")
    stays = found.distinct().join(ids, "name").groupBy("component_id").agg(smallest)
    one = Window.partitionBy("name").orderBy(F.xxhash64("row"))
    kept = rows.join(stays.select(F.col("first.name").alias("name")), "name", "left_semi")
    kept = kept.withColumn("n", F.row_number().over(one)).where("n = 1")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that stand in an earlier one; emptied documents go."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    cut = substring_dedup.remove_repeats(rows, size=50).where("n_words > n_removed")
    row = F.col("row")
    return _measured(
        cut.select(*[F.col("cut_text").alias(c) if c == "text" else row.getField(c).alias(c) for c in docs.columns])
    )


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    copies = mixing.repeat_rows(mixing.mix(rows), ["row"])
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.pack(docs, **PACKING, ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_repeats),
    ("mixing", source_mix),
    ("packing", packed_sequences),
]

# Fingerprints, components, rounding by hashes and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the pieces of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
