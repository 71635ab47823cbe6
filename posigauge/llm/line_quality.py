"""Quality rules on single documents and on lines that many documents of a host share.

DataFrame functions only. Normalised lines are hashed, distinct texts are
counted per host and line, lines above the limit are removed, and documents
that lose most of their words are rejected. Exact copies of a text count once:
finding copies is the work of deduplication, and a text that was copied often
would otherwise lose all its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posigauge.operators.cleaning import compute_once
from posigauge.session import scratch_path

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def _word_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def with_text_measures(documents: DataFrame, window: int = 3) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of column ``text``.

    n_repeat_words counts the words inside windows that are found twice or
    more in the text. Windows are hashed from their words' hashes. Only where
    two are equal they are sorted with their places, so that equal ones are
    neighbours: n log n for the longest text. Null texts have no words. What a later expression uses more than once
    is computed by a generator, which no filter or projection is merged into.
    """
    text = F.coalesce("text", F.lit(""))
    lines, hashes, windows = F.col("_lines"), F.col("_hashes"), F.col("_windows")
    frame = compute_once(
        documents, {"_lines": _word_lines(text), "_hashes": F.transform(_words(text), lambda word: F.xxhash64(word))}
    )
    places = F.sequence(F.lit(0), F.size(hashes) - window)
    window_hash = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])
    frame = compute_once(
        frame,
        {
            "n_words": F.size(hashes).cast("long"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "_windows": F.when(F.size(hashes) >= window, F.transform(places, window_hash)).otherwise(
                F.array().cast("array<long>")
            ),
        },
    ).drop("_lines", "_hashes")
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    frame = compute_once(frame, {"_runs": F.when(repeats, F.sort_array(placed))}).drop("_windows")
    runs = F.col("_runs")
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    repeated = F.filter(runs, lambda x, j: same(x, F.get(runs, j - 1)) | same(x, F.get(runs, j + 1)))
    covered = F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["i"])),
        F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda state, i: F.struct(
            i.alias("last"), (state["n"] + F.least(F.lit(window), i - state["last"])).cast("long").alias("n")
        ),
        lambda state: state["n"],
    )
    return compute_once(frame, {"n_repeat_words": F.coalesce(covered, F.lit(0).cast("long"))}).drop("_runs")


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """Too short, or too much of the text inside repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _plain_lines(text: Column) -> Column:
    """Every line in lower case with single blanks; a line without words is empty.

    The whole text is normalised first: a line's blanks are never next to a
    word of another line, so this gives the same lines as one by one.
    """
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), BLANKS.replace("\n", "").replace(" ", ""), "    ")
    plain = F.btrim(F.regexp_replace(F.regexp_replace(plain, "  +", " "), " ?\n ?", "\n"), F.lit(" "))
    return F.split(plain, "\n")


def line_table(documents: DataFrame, key: str = "doc_id", host: str = "source") -> DataFrame:
    """(_id, _text, _host, _lines, _sizes): hashes and word counts of every row's lines, written down once.

    ``_id`` and ``_text`` name a row by its content, so equal rows have equal
    names. A line without words has a null hash. Lines take 12 bytes each;
    later steps read no text.
    """
    path = scratch_path(documents.sparkSession, "lines")
    named = documents.select(
        F.xxhash64(key, host).alias("_id"),
        F.xxhash64("text").alias("_text"),
        F.coalesce(host, F.lit("")).alias("_host"),
        F.col("text"),
    )
    plain = F.col("_plain")
    compute_once(named, {"_plain": _plain_lines(F.col("text"))}).select(
        "_id",
        "_text",
        "_host",
        F.transform(plain, lambda line: F.when(line != "", F.xxhash64(line))).alias("_lines"),
        F.transform(plain, lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1).alias("_sizes"),
    ).write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def frequent_lines(
    table: DataFrame, *, max_share: float = 0.1, min_docs: int = 10, max_docs: int = 30
) -> DataFrame:
    """(_host, _line) of lines in more than ``max_docs`` distinct texts of a host, or in more than
    ``max_share`` of them if these are more than ``min_docs``.

    ``max_docs`` suffices alone, so the limit does not rise with the host.
    Equal texts of a host are folded first and a text names a line once; then
    counts are combined before they are shuffled, so a line that a third of all
    documents hold is no hot key. The host's own number of texts is counted
    along as the line null. The result is written, so its size is known to
    the joins that follow.
    """
    named = F.array_distinct(F.filter("_lines", lambda line: line.isNotNull()))
    named = F.array_append(named, F.lit(None).cast("long"))
    counted = (
        table.select("_host", "_text", "_lines")
        .distinct()
        .select("_host", F.explode(named).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_docs"))
        .where((F.col("_docs") > min_docs) | F.col("_line").isNull())
    )
    spark = table.sparkSession
    path = scratch_path(spark, "line-counts")
    counted.write.parquet(path)
    counted = spark.read.parquet(path)
    hosts = counted.where(F.col("_line").isNull()).select("_host", F.col("_docs").alias("_all"))
    docs = F.col("_docs")
    return (
        counted.where(F.col("_line").isNotNull())
        .join(hosts, "_host")
        .where((docs > max_docs) | (docs > max_share * F.col("_all")))
        .select("_host", "_line")
    )


def removed_lines(documents: DataFrame, key: str = "doc_id", host: str = "source", **limits) -> DataFrame:
    """(_id, _text, _removed, _places): words and places of the frequent lines of each document that has some."""
    table = line_table(documents, key, host)
    zipped = F.posexplode(F.arrays_zip("_lines", "_sizes")).alias("_place", "_entry")
    lines = table.select("_id", "_text", "_host", zipped).where("_entry._lines is not null")
    lines = lines.select("_id", "_text", "_host", "_place", F.expr("_entry._lines as _line"), F.expr("_entry._sizes as _words"))
    found = lines.join(frequent_lines(table, **limits), ["_host", "_line"])
    by_doc = found.groupBy("_id", "_text").agg(F.collect_set(F.struct("_place", "_words")).alias("_hit"))
    return by_doc.select(
        "_id",
        "_text",
        F.aggregate("_hit", F.lit(0).cast("long"), lambda n, x: n + x["_words"]).alias("_removed"),
        F.transform("_hit", lambda x: x["_place"]).alias("_places"),
    )


def verdicts(
    documents: DataFrame,
    *,
    max_removed_percent: int = 25,
    key: str = "doc_id",
    host: str = "source",
    carry: list[str] | None = None,
    **limits,
) -> DataFrame:
    """Measures and verdict of every row: key, carry, the measures, base_failed, n_removed, kept.

    A document is kept unless it fails the base rules or more than
    ``max_removed_percent`` of its words stand in frequent lines. Null and
    empty texts fail for their length; a null host is the host ''. Repeated
    rows get the same result each. An empty table gives an empty result.
    """
    carry = carry or []
    measured = with_text_measures(
        documents.select(
            key, *carry, *([] if "text" in carry else ["text"]), F.xxhash64(key, host).alias("_id"),
            F.xxhash64("text").alias("_text"),
        )
    )
    if "text" not in carry:
        measured = measured.drop("text")
    judged = measured.join(removed_lines(documents, key, host, **limits), ["_id", "_text"], "left")
    return (
        judged.withColumn("base_failed", base_failed())
        .withColumn("n_removed", F.coalesce("_removed", F.lit(0).cast("long")))
        .withColumn(
            "kept", ~F.col("base_failed") & (100 * F.col("n_removed") <= max_removed_percent * F.col("n_words"))
        )
        .drop("_id", "_text", "_removed")
    )


def clean(documents: DataFrame, key: str = "doc_id", host: str = "source", **rules) -> DataFrame:
    """The rows that are kept, with all their columns, without the frequent lines in column ``text``."""
    columns = documents.columns
    renamed = documents.select(key, "text", F.struct(*columns).alias("_row"), F.col(host).alias("_source"))
    judged = verdicts(renamed, key=key, host="_source", carry=["_row", "text"], **rules)
    lines = F.filter(
        F.split("text", "\n"), lambda _, i: ~F.coalesce(F.array_contains("_places", i), F.lit(False))
    )
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return judged.where("kept").select(
        *[text.alias("text") if c == "text" else F.col(f"_row.{c}").alias(c) for c in columns]
    )
