"""Scoring predictions against references: four match modes, precision, recall, F1.

Stages of one plan: join on the document, normalise once, lay out (mode, field) rows, decide matches per
alternative, and aggregate. Only the last step shuffles, with map-side sums of a few groups.

A field without a reference is not in the support; a field without a prediction stays in recall's
denominator and leaves precision's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import normalize as n
from folioscope.functions import similarity as s

MODES = ("strict", "soft", "levenshtein", "longest")


def matches(pred: Column, gold: Column, modes: tuple[str, ...] = MODES, fold: bool = False) -> dict[str, Column]:
    """mode -> whether one prediction matches one reference."""
    a, b = n.soft_norm(pred, fold), n.soft_norm(gold, fold)
    made = {
        "strict": lambda: n.strict_norm(pred) == n.strict_norm(gold),
        "soft": lambda: a == b,
        "levenshtein": lambda: s.levenshtein_match(a, b),
        "longest": lambda: s.longest_match(a, b),
    }
    return {m: made[m]() for m in modes}


def long_matches(rows: DataFrame, modes: tuple[str, ...] = MODES, fold: bool = False) -> DataFrame:
    """rows (id, field, pred, golds array) -> (id, field, mode, predicted, matched), one per mode with support.

    Several references are alternatives: any of them may match.
    """
    known = rows.withColumn("golds", F.filter("golds", lambda g: F.trim(g) != "")).filter(F.size("golds") > 0)
    known = known.withColumn("pred", F.coalesce("pred", F.lit("")))
    one = known.withColumn("gold", F.explode("golds"))
    has = F.trim("pred") != ""
    decided = one.select("id", "field", has.alias("predicted"), *[(has & c).alias(m) for m, c in matches(F.col("pred"), F.col("gold"), modes, fold).items()])
    best = decided.groupBy("id", "field").agg(F.bool_or("predicted").alias("predicted"), *[F.bool_or(m).alias(m) for m in modes])
    return best.unpivot(["id", "field", "predicted"], list(modes), "mode", "matched")


def prf(long: DataFrame) -> DataFrame:
    """(mode, field) -> support, predicted, matched, precision, recall, f1."""
    sums = long.groupBy("mode", "field").agg(F.count(F.lit(1)).alias("support"), F.count_if("predicted").alias("predicted"), F.count_if("matched").alias("matched"))
    p = F.coalesce(F.try_divide(F.col("matched"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("matched"), F.col("support")), F.lit(0.0))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", s.f1(F.col("precision"), F.col("recall")))


def run_difference(scores: DataFrame, key: str, base: str, other: str, value: str = "f1") -> DataFrame:
    """The value of two runs side by side, and what the other gained."""
    wide = scores.groupBy("mode", "field").pivot(key, [base, other]).agg(F.first(value))
    return wide.select("mode", "field", F.col(base).alias("base"), F.col(other).alias("other"), (F.col(other) - F.col(base)).alias("gain"))


def breakdown(rows: DataFrame, keys: list[str], solved: Column, score: Column) -> DataFrame:
    """Count, solved, share and mean score for each value of each key by itself, and in total: one pass."""
    sets = [[k] for k in keys] + [[]]
    cols = rows.select(*keys, solved.alias("_solved"), score.alias("_score"))
    out = cols.groupingSets([[F.col(k) for k in st] for st in sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if("_solved").alias("solved"), F.avg("_score").alias("mean_score")
    )
    kind = F.lit("total")
    value = F.lit("").cast("string")
    for i, k in enumerate(keys):
        here = F.col("_g") == F.lit((1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)))
        kind = F.when(here, k).otherwise(kind)
        value = F.when(here, F.coalesce(F.col(k).cast("string"), F.lit("?"))).otherwise(value)
    return out.select(kind.alias("kind"), value.alias("value"), "n", "solved", (F.col("solved") / F.col("n")).alias("share"), "mean_score")
