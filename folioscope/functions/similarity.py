"""Similarity measures and decisions on them.

Edit distances and set measures are Column expressions. Longest-match similarity has no Spark equivalent: its blocks
are found by ``matching`` in Arrow batches. The result depends on the order of the arguments and on the popularity
rule, which differ between call sites.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import normalize as n
from folioscope.functions.matching import common_bound, ratio

LEVENSHTEIN_MATCH = 0.80
LONGEST_MATCH = 0.95
TITLE_SIMILARITY, TITLE_COVERAGE, TITLE_EXCESS = 0.70, 0.90, 1.30


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 if both are empty, 0 if one is."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def levenshtein_match(a: Column, b: Column) -> Column:
    """Ratio of at least 0.80. The distance is bounded, so unlike texts are given up early, and texts of too
    different lengths are never compared."""
    longest = F.greatest(F.length(a), F.length(b))
    shortest = F.least(F.length(a), F.length(b))
    most = F.floor(longest / 5).cast("int")
    near = F.call_function("levenshtein", a, b, most) >= 0
    return F.when(longest == 0, True).when(shortest == 0, False).when(shortest * 5 < longest * 4, False).otherwise(near)


@F.pandas_udf(T.DoubleType())
def longest_match_ratio(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio without the popularity rule; the prediction is the first argument."""
    return pd.Series([None if a is None or b is None else ratio(a, b, False) for a, b in zip(pred, gold, strict=True)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def longest_match(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Ratio of at least 0.95; what the lengths rule out is not compared."""

    def decide(a, b):
        if a is None or b is None:
            return None
        if a == b:
            return True
        if not a or not b or 2 * min(len(a), len(b)) < LONGEST_MATCH * (len(a) + len(b)):
            return False
        return common_bound(a, b) >= LONGEST_MATCH and ratio(a, b, False) >= LONGEST_MATCH

    return pd.Series([decide(a, b) for a, b in zip(pred, gold, strict=True)], dtype="object")


@F.pandas_udf(T.DoubleType())
def score_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-match ratio with the popularity rule on score-normalised strings, three places; 0 if one is empty."""
    return pd.Series([round(ratio(x, y, True), 3) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def best_similarity(pred: pd.Series, golds: pd.Series) -> pd.Series:
    """The best score_similarity of a score-normalised text over alternatives that are filled; null without one, 0
    without a text. Alternatives that are empty once normalised count 0."""

    def one(p, gs):
        some = [g for g in (gs if gs is not None else []) if g is not None and g.strip()]
        return None if not some else max(round(ratio(p, g, True), 3) for g in some) if p else 0.0

    return pd.Series([one(p, gs) for p, gs in zip(pred, golds, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def reference_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-match ratio of the first 300 characters of two normalised references."""
    return pd.Series([ratio((x or "")[:300], (y or "")[:300], True) for x, y in zip(a, b, strict=True)])


def words(c: Column, least: int = 1) -> Column:
    return F.filter(F.split(c, " "), lambda w: F.length(w) >= least)


def token_set(c: Column) -> Column:
    """The set of words of two letters or more."""
    return F.array_distinct(words(n.token_norm(F.coalesce(c, F.lit(""))), 2))


def token_recall_precision(pred: Column, gold: Column) -> Column:
    """struct(recall, precision) x 100 on sets of words of two letters or more; null without gold, 0 without prediction.

    Over long texts take token_set into columns first, then token_sets: a set is used several times."""
    return token_sets(token_set(pred), token_set(gold))


def token_sets(p: Column, g: Column) -> Column:
    both = F.size(F.array_intersect(p, g))
    recall = F.when(F.size(g) == 0, F.lit(None)).when(F.size(p) == 0, 0.0).otherwise(both / F.size(g) * 100)
    precision = F.when(F.size(g) == 0, F.lit(None)).when(F.size(p) == 0, 0.0).otherwise(both / F.size(p) * 100)
    return F.struct(recall.cast("double").alias("recall"), precision.cast("double").alias("precision"))


def jaccard(a: Column, b: Column) -> Column:
    """Words in common of all words, x 100; null if b has none, 0 if a has none."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when(F.size(y) == 0, F.lit(None)).when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) * 100).cast("double")


def exact_score(pred: Column, gold: Column) -> Column:
    """100 if equal, 0 if not or missing, null without gold."""
    return F.when(gold == "", F.lit(None)).when(pred == gold, 100.0).otherwise(0.0).cast("double")


def better_by_recall(a: Column, b: Column) -> Column:
    """The struct(recall, precision) of higher recall, the first at ties; null if both are."""
    return F.when(a["recall"].isNull(), b).when(b["recall"].isNull(), a).when(b["recall"] > a["recall"], b).otherwise(a)


def name_tokens(c: Column) -> Column:
    return F.array_distinct(words(c, 3))


def longest_token(tokens: Column) -> Column:
    """The longest token; the least in order at ties."""
    ranked = F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))
    return F.array_min(ranked)["t"]


def author_scores(pred: Column, gold: Column) -> Column:
    """Recall and precision of names (arrays of normalised names), loose (a token of three letters in common)
    and strict (equal longest token). Null without gold."""
    p, g = F.transform(pred, name_tokens), F.transform(gold, name_tokens)

    def hits(xs: Column, ys: Column, same) -> Column:
        return F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: same(x, y))))

    def loose(x, y):
        return F.arrays_overlap(x, y)

    def strict(x, y):
        return (F.size(x) > 0) & (F.size(y) > 0) & (longest_token(x) == longest_token(y))

    def share(a, b):
        return F.when(F.size(gold) == 0, F.lit(None)).when(b == 0, 0.0).otherwise(a / b).cast("double")

    out = []
    for name, same in (("", loose), ("strict_", strict)):
        out += [share(hits(g, p, same), F.size(g)).alias(f"{name}recall"), share(hits(p, g, same), F.size(p)).alias(f"{name}precision")]
    return F.struct(*out)


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def compare_runs(before: Column, after: Column) -> Column:
    """Both solved, fixed, broken, or neither."""
    return F.when(before & after, "both_solved").when(~before & after, "fixed").when(before & ~after, "broken").otherwise("neither")


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def title_decision(pred: Column, golds: Column, similarity: Column) -> Column:
    """struct(coverage, excess, ok, merged) of a normalised title against normalised alternatives.

    similarity: the best score_similarity. The alternative of highest coverage counts, the longer at ties.
    ok: similar enough, or covered with little excess. merged: not similar, but two alternatives are covered.
    """
    p = words(pred)

    def scored(g):
        gt = words(g)
        share = F.when(F.size(gt) == 0, 0.0).otherwise(F.size(F.array_intersect(F.array_distinct(gt), p)) / F.size(F.array_distinct(gt)))
        return F.struct(share.cast("double").alias("share"), F.size(gt).alias("n"))

    ranked = F.sort_array(F.transform(golds, scored), asc=False)
    best = F.get(ranked, 0)
    excess = F.round(F.greatest(F.lit(0), F.size(p) - best["n"]) / F.greatest(F.lit(1), best["n"]), 3)
    loose = (best["share"] >= TITLE_COVERAGE) & (excess <= TITLE_EXCESS)
    covered = F.size(F.filter(ranked, lambda x: x["share"] >= TITLE_COVERAGE))
    return F.struct(best["share"].alias("coverage"), excess.alias("excess"), ((similarity >= TITLE_SIMILARITY) | loose).alias("ok"), (loose & (similarity < TITLE_SIMILARITY) & (covered >= 2)).alias("merged"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def subsequence_at(text: pd.Series, phrase: pd.Series) -> pd.Series:
    """Where the words of a phrase best agree, position by position, with a stretch of the text's words:
    [first, last] if three quarters agree, else null. The first best stretch counts."""

    def find(t, p):
        if not t or not p:
            return None
        a, b = t.split(), p.split()
        best, at = 0, None
        where: dict[str, list[int]] = {}
        for j, w in enumerate(b):
            where.setdefault(w, []).append(j)
        hits: dict[int, int] = {}
        for i, w in enumerate(a):
            for j in where.get(w, ()):
                if 0 <= i - j <= len(a) - len(b):
                    hits[i - j] = hits.get(i - j, 0) + 1
        for s in sorted(hits):
            if hits[s] > best:
                best, at = hits[s], s
        return [at, at + len(b)] if at is not None and best / len(b) >= 0.75 else None

    return pd.Series([find(t, p) for t, p in zip(text, phrase, strict=True)], dtype="object")
