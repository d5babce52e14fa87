"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a share of the budget by weight, at most ``max_repeats`` times
its own size.  A source whose target is r times its size is taken floor(r) times
whole, and once more up to a threshold of the document hash that meets the rest.
The thresholds of all sources are found together: sizes are summed by (source,
hash bucket), the bucket in which the budget ends is found from the sums, and
only the rows of that bucket are summed again on the next digits of the hash.
The decision is then a comparison of each row with its source's threshold; no
rows are sorted and no source is gathered.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source, last in order; rows with the same id share a hash and so a
decision, and each counts; equal distances to the budget take fewer words; with
no words at all every target is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm.shared import materialize
from runsift.operators.scale import null_safe_join, running_totals

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MAX_REPEATS = 2
#: Hexadecimal digits of the hash that one histogram level looks at, and the levels.
DIGITS = 3
LEVELS = 5


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources that reach their limit are those with the smallest limit per weight,
    so the common level is found from running sums in that order.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running_totals(totals.withColumn("last", F.col("source").isNull()), [], ["last", "source"], {"at": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    limited = placed.select("source", "source_size", "at", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("most"))
    limited = limited.withColumn("level", F.col("most") / F.col("weight"))
    summed = materialize(running_totals(limited, [], ["level", "at"], {"most_to": "most", "weight_to": "weight"}), "source-limits")
    total = summed.agg(F.sum("source_size")).scalar()
    weight_sum = summed.agg(F.sum("weight")).scalar()
    budget = total * (budget_percent / 100)
    # Water level if exactly the sources before this one are at their limit.
    level = (budget - (F.col("most_to") - F.col("most"))) / (weight_sum - (F.col("weight_to") - F.col("weight")))
    tried = summed.withColumn("try", level)
    common = tried.where("try <= level").agg(F.min_by("try", F.struct("level", "at"))).scalar()
    return tried.select("source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(common, F.col("level")) * F.col("weight")).alias("target"))


def _digits(level: int) -> Column:
    return F.substring("hash", level * DIGITS + 1, DIGITS)


def _thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut): rows with ``hash < cut`` come as near to ``rest`` words as whole hash values can."""
    state = wanted.where("rest > 0").select("source", "rest", F.lit("").alias("prefix"))
    live = rows.where("size > 0").select("source", "hash", "size")
    by_source = lambda: Window.partitionBy("source").orderBy("digits")
    for level in range(LEVELS):
        joined = null_safe_join(live, state, ["source"]).where(F.col("hash").startswith(F.col("prefix")))
        summed = joined.groupBy("source", "rest", "prefix", _digits(level).alias("digits")).agg(F.sum("size").alias("words"))
        upto = summed.withColumn("upto", F.sum("words").over(by_source().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        inside = upto.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        state = materialize(inside.select(
            "source", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"),
            F.concat("prefix", "digits").alias("prefix"), "words"), "boundary-buckets")
        if level < LEVELS - 1:
            state = state.drop("words")
    # The bucket that is left holds one hash value: take it if that comes nearer.
    take = F.col("words") - F.col("rest") < F.col("rest")
    return state.select("source", F.when(take, F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix")).alias("cut"))


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str,
             weights: Sequence[int], budget_percent: int, max_repeats: int) -> DataFrame:
    """The rows of ``docs`` with __source, __size, __source_size, __target and __taken; the rows do not shuffle for it."""
    digest = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), 1, DIGITS * LEVELS)
    keyed = docs.withColumns({"__source": F.col(source_col), "__size": word_count(F.col(text_col)), "__hash": digest})
    rows = materialize(keyed.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__hash").alias("hash")), "sizes")
    plan = materialize(targets(rows, weights, budget_percent, max_repeats), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.select("source", "source_size", "target", whole.alias("whole"),
                       (F.col("target") - whole * F.col("source_size")).alias("rest"))
    plan = null_safe_join(plan, _thresholds(rows, plan), ["source"], "left")
    plan = materialize(plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns]), "thresholds")
    times = F.col("__whole") + F.when(F.col("__hash") < F.col("__cut"), 1).otherwise(0)
    return null_safe_join(keyed, plan, ["__source"]).withColumn("__taken", F.col("__size") * times)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken."""
    decided = _decided(docs, id_col, text_col, source_col, weights, budget_percent, max_repeats)
    return decided.select(id_col, *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of the mix, all columns: a document taken twice is there twice."""
    taken = _decided(docs, id_col, text_col, source_col, weights, budget_percent, max_repeats).where("__taken > 0")
    times = F.sequence(F.lit(1), (F.col("__taken") / F.col("__size")).cast("int"))
    return taken.withColumn("__copy", F.explode(times)).select(*docs.columns)
