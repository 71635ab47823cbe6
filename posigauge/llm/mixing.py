"""Mixing sources to target token shares by entropy balancing.

Document rates minimise the token-weighted relative entropy to the corpus
under one token constraint per source. Newton's method solves the convex dual;
rates are exponentially tilted, exp(dual), and are then rounded into copies.
With one constraint per source the dual splits by source and its solution is
log(target / total): Newton's steps run on the sources' totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posigauge.functions.shipping import ship_by_value
from posigauge.operators.ordering import dense_index
from posigauge.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_RATE = 3
RESERVE = 1000  # documents of a source that are rounded one by one, first the longest and last by hash
TOLERANCE = 1e-12


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Adds _weight and _target to (_source, _docs, _total).

    Sources by code point, null last, take the weights in turn and share all
    words by weight. A target stops at ``max_rate`` times the source's size;
    the excess is shared again by weight until no target is above. Each round
    is one small aggregate, and at least one source stops in it.
    """
    named = dense_index(sources, "_source", "_rank")
    last = named.count()  # null comes after all names
    rank = F.coalesce(F.col("_rank") - 1, F.lit(last))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = materialize(sources.join(named, "_source", "left").withColumn("_weight", weight).drop("_rank"))
    most = max_rate * F.col("_total")
    everything = ranked.agg(F.sum("_total")).first()[0] or 0
    level = 0.0
    while True:
        stopped = F.col("_weight") * level >= most
        state = ranked.agg(
            F.sum(F.when(stopped, most).otherwise(0)).alias("full"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("_weight"))).alias("open"),
        ).first()
        if not state["open"]:
            break
        higher = (everything - state["full"]) / state["open"]
        if higher <= level:
            break
        level = higher
    return ranked.withColumn("_target", F.least(F.col("_weight") * level, most.cast("double")))


def solve_dual(sources: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds _dual to (_total, _target): Newton's method on total * exp(x) - target * x.

    The problem splits by source, so a step is one expression on the sources'
    totals, and all sources step together until the largest remaining
    constraint error is below ``tolerance`` of its target. Raises if 200 steps
    do not get there. Sources without words or target have the dual -inf.
    """
    step = F.col("_dual") - 1 + F.col("_target") / (F.col("_total") * F.exp("_dual"))
    state = sources.withColumn(
        "_dual", F.when((F.col("_total") > 0) & (F.col("_target") > 0), F.lit(0.0)).otherwise(F.lit(float("-inf")))
    )
    state = materialize(state)
    error = F.abs(F.col("_total") * F.exp("_dual") - F.col("_target")) / F.col("_target")
    for _ in range(25):
        worst = state.where(F.col("_dual") > float("-inf")).agg(F.max(error)).first()[0]
        if worst is None or worst < tolerance:
            return state
        for _ in range(8):
            # a step is cut at 2, which keeps the first ones from overshooting
            move = F.when(F.col("_dual") > float("-inf"), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step - F.col("_dual"))))
            state = state.withColumn("_dual", F.coalesce(F.col("_dual") + move, F.col("_dual")))
        state = materialize(state)
    raise ArithmeticError("the dual of the token constraints did not converge")


def _even_out(max_rate: int):
    """Copies of some documents of a source, from large to small, so that their words end near what is left."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_mass", "_unit", "_id"], ascending=[False, True, True], kind="stable")
        left, capacity = float(pdf["_left"].iloc[0]), float(pdf["_mass"].sum())
        copies = []
        for mass in pdf["_mass"]:
            rate = left / capacity if capacity > 0 else 0.0
            n = int(min(max_rate, max(0, round(rate))))
            copies.append(n)
            left, capacity = left - n * mass, capacity - mass
        return pd.DataFrame({"_source": pdf["_source"], "_id": pdf["_id"], "_mass": pdf["_mass"], "_copies": copies})

    return assign


def _by_source(frame: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    """Joins on _source, where null is a source."""
    other = other.withColumnRenamed("_source", "_by")
    return frame.join(other, frame["_source"].eqNullSafe(other["_by"]), how).drop("_by")


def mix(
    documents: DataFrame,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    max_rate: int = MAX_RATE,
    reserve: int = RESERVE,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """All rows and columns with _size, _source_size, _target and _copies.

    Rates are equal within a source, so rounding decides. The ``reserve``
    longest documents of a source are rounded first, one after another, and
    the rate of the others takes up what that leaves. Of these, each gets the
    whole part of the rate and one copy more with the probability of the rest,
    by a hash of its key; about ``reserve`` of them, by another range of the
    hash, are rounded last against what the others left. No document outside
    the longest holds more than 1/``reserve`` of its source, which bounds the
    error, and both groups are bounded, as each is one task. Runs agree, since
    nothing but hashes of content decides. Rows equal in key, source and size
    get equal copies. A null text has size 0, a null source is one of its own.
    Empty sources and texts get no copy beyond their rate; an empty table gives
    an empty result. The new columns replace columns of the same name; no
    other name clashes.
    """
    added = ["_size", "_source_size", "_target", "_copies"]
    columns = [c for c in documents.columns if c not in added]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select(
        F.struct(*columns).alias("_row"), F.col(source).alias("_source"), F.col(key).alias("_key"), size.alias("_size")
    ).withColumn("_id", F.xxhash64("_key", "_size"))
    # one row per document without its text
    narrow = materialize(rows.groupBy("_source", "_id").agg(F.sum("_size").alias("_mass"), F.count(F.lit(1)).alias("_docs")))
    totals = narrow.groupBy("_source").agg(F.count(F.lit(1)).alias("_docs"), F.sum("_mass").alias("_total"))
    solved = solve_dual(targets(totals, weights, max_rate)).select(
        "_source", "_docs", "_total", "_target", F.exp("_dual").alias("_rate")
    )
    solved = materialize(solved)
    unit = F.pmod(F.xxhash64(F.lit("mix"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    units = narrow.drop("_docs").withColumn("_unit", unit)
    kind = rows.schema["_source"].dataType.simpleString()
    evened = f"_source {kind}, _id long, _mass long, _copies int"

    longest = Window.partitionBy("_source").orderBy(F.desc("_mass"), "_unit", "_id")
    longest = units.withColumn("_n", F.row_number().over(longest)).where(F.col("_n") <= reserve).drop("_n")
    share = longest.groupBy("_source").agg(F.sum("_mass").alias("_long"))
    share = _by_source(share, solved.select("_source", "_rate")).select("_source", (F.col("_rate") * F.col("_long")).alias("_left"))
    first = materialize(_by_source(longest, share).groupBy("_source").applyInPandas(_even_out(max_rate), evened))
    spent = first.groupBy("_source").agg(
        F.sum("_mass").alias("_gone"), F.sum(F.col("_mass") * F.col("_copies")).alias("_spent")
    )
    rest_words = F.col("_total") - F.coalesce("_gone", F.lit(0))
    rest_target = F.col("_target") - F.coalesce("_spent", F.lit(0))
    rate = F.when(rest_words > 0, F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), rest_target / rest_words)))
    later = _by_source(solved, spent).select(
        "_source",
        F.coalesce(rate, F.lit(0.0)).alias("_rate"),
        rest_target.alias("_open"),
        # The reserve is the lowest part of the hash; the rest is spread over [0, 1) again.
        F.least(F.lit(1.0), F.lit(float(reserve)) / F.greatest(F.col("_docs") - reserve, F.lit(1))).alias("_share"),
    )
    others = units.join(first.select(F.col("_id").alias("_done"), F.col("_source").alias("_by")),
        (F.col("_id") == F.col("_done")) & F.col("_source").eqNullSafe(F.col("_by")), "left_anti")
    others = materialize(_by_source(others, later))
    spread = (F.col("_unit") - F.col("_share")) / (1 - F.col("_share"))
    hashed = F.least(F.lit(max_rate), F.floor(F.col("_rate") + spread)).cast("int").alias("_copies")
    by_hash = others.where(F.col("_unit") >= F.col("_share")).select("_source", "_id", "_mass", hashed)
    last = others.where(F.col("_unit") < F.col("_share"))
    taken = by_hash.groupBy("_source").agg(F.sum(F.col("_mass") * F.col("_copies")).alias("_taken"))
    left = _by_source(last, taken).withColumn("_left", F.col("_open") - F.coalesce("_taken", F.lit(0)))
    left = left.select("_source", "_id", "_mass", "_unit", "_left")
    done = first.unionByName(by_hash).unionByName(left.groupBy("_source").applyInPandas(_even_out(max_rate), evened))

    copies = done.select(F.col("_source").alias("_by"), F.col("_id").alias("_done"), "_copies")
    out = rows.join(copies, (rows["_id"] == copies["_done"]) & rows["_source"].eqNullSafe(copies["_by"]), "left")
    out = _by_source(out.drop("_by", "_done"), solved.select("_source", "_total", "_target"))
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in columns],
        "_size",
        F.col("_total").alias("_source_size"),
        "_target",
        "_copies",
    )


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row as often as it has copies."""
    return mixed.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).drop("_copy")


ship_by_value(__name__)
