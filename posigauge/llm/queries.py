"""One query per operator, on its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posigauge.llm import (
    hmm,
    langid,
    line_quality,
    mixing,
    packing,
    periodic_runs,
    secret_scan,
    simhash,
    sql,
    substring_dedup,
    token_counts,
    token_links,
    toxicity,
    vafile,
)
from posigauge.llm.common import fold

# The 50k byte-level vocabulary's end mark, and the id that ends a packed document.
PACKING = {
    "ranks_path": str(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "pattern": public_tokenizers.PATTERN,
    "special": {"<|endoftext|>": 50256},
    "end": 1,
    "window": 2048,
}

# Words of a shingle and bits that near copies may differ in.
SIMHASH = {"size": 3, "distance": 2}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op1_substring_dedup": sql.SUBSTRING_DEDUP,
    "op3_vafile": sql.TOP_K,
    "op6_line_quality": sql.LINE_QUALITY,
}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity score of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(documents.where(fold("doc_id", 5) != 0).join(labels, "doc_id"))
    return toxicity.score(documents, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "sentence",
        "sentence_score",
    )


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a vocabulary with word ends."""
    vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary, limit=2048)


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents.where(fold("doc_id", 3) != 1))
    return langid.identify(documents, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), **SIMHASH)


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after repeated windows of 13 words are removed."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(documents, size=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query
def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_quality.verdicts(documents).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_removed",
    )


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(documents).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), **PACKING, ids=False)


@query
def op3_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    return vafile.top_k(read(spark, sf_dir, "embeddings"), k=10, query_step=100, scale=1024)


@query
def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the hidden Markov model."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm.language_scores(documents, fold("doc_id", 7) != 2).select(
        "doc_id",
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document's words repeat from some word on.

    With h = crc32 of the id as text (null: empty) and h % 10 = 0, each word
    from place a on is the one at a + (i - a) % p, a and p from h div 10.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    g, n = F.floor(h / 10).cast("long"), F.size("words").cast("long")
    rows = documents.select("doc_id", "text", words.alias("words"), g.alias("g"))
    rows = rows.select("doc_id", "text", "words", "g", F.expr("g % size(words)").alias("a"), n.alias("n"))
    period = F.expr("1 + (n - a) div (3 + g % 8)").alias("p")
    planted = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')")
    rows = rows.select("doc_id", "text", "words", "a", F.when(F.col("n") > 0, period).alias("p"))
    return rows.select("doc_id", F.when(F.size("words") > 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words."""
    found = periodic_runs.periodic_runs(with_planted_periods(read(spark, sf_dir, "documents")))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start, -r.period)))")
    rows = found.select("doc_id", "runs", "n_words", longest.alias("best"), lines.alias("lines"), "collapsed")
    length, start, period = F.col("best.length"), -F.col("best.col2"), -F.col("best.col3")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    kinds = [
        F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k.name}')) as long)").alias(f"n_{k.name}")
        for k in secret_scan.BASE
    ]
    base = secret_scan.spans_text(secret_scan.base_only(F.col("secrets")))
    return found.select(
        "doc_id", *kinds, F.sha2(base, 256).alias("base_sha256"), secret_scan.spans_text(F.col("secrets")).alias("spans")
    )


@query
def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of every document under a byte-level and a piece vocabulary."""
    return token_links.token_links(
        read(spark, sf_dir, "documents"),
        str(public_tokenizers.path("byte_bpe_50k.json")),
        PACKING["ranks_path"],
        PACKING["pattern"],
        str(public_tokenizers.path("piece_bpe_32k.model")),
    )
