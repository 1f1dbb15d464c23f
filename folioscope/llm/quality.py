"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows.

One pass over the texts makes the statistics of every document. The forest is grown from every document that
passes the base rules, labelled or not, as those are what it will judge. Each is dealt to one of TREES trees by
a hash of its values (to more where a tree would get fewer than TREE_ROWS). All trees grow together, level by
level: the rows give the number and the bounds of each node in one pass, and the driver cuts every node at a
random value of a random statistic, DEPTH levels deep. A document's anomaly score is 2 ** (-mean path length /
expected path length). The threshold is the score that best separates the labels, among those that keep at least
KEEP_GOOD of the good documents. It counts every labelled document that passes the base rules, scored by the
trees it was not dealt to. A document is kept if it passes the base rules and its score is below.

Defined results: a null or empty text has no words and fails the base rules; null doc_ids are passed
through and take part in the forest; repeated rows each get a result, and a repeated doc_id counts once for the
threshold, by its least statistics; without labelled rows of both kinds no document is anomalous; an empty table
gives an empty result. Very long texts are handled whole; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import in_order, load, materialize

TREES = 100
TREE_ROWS = 64
DEPTH = 6
KEEP_GOOD = 0.99
SEED = 7
MIN_WORDS = 50

#: The characters that count as symbols, and those that separate words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"

STATS = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")]
)
#: Statistics that the forest splits. Repeated lines and windows have base rules of their own; as splits they
#: only lengthen the paths of documents that are odd in one statistic.
FEATURES = ("symbols_per_word", "chars_per_word", "distinct_share")


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words covered by 3-word windows that occur twice or more, and the number of distinct words."""
    n = len(words)
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if n < 4:
        return 0, len(ids)
    m = len(ids)
    if m < 2_000_000:
        keys = (seq[:-2] * m + seq[1:-1]) * m + seq[2:]
    else:
        _, pairs = np.unique(seq[:-2] * m + seq[1:-1], return_inverse=True)
        keys = pairs * m + seq[2:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum()), len(ids)


def text_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats, distinct = repeated_words(words)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeats, distinct


def document_stats(docs: DataFrame) -> DataFrame:
    """The statistics of every document, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            rows = list(map(text_stats, batch.column(1).to_pylist()))
            columns = list(zip(*rows, strict=True)) or [()] * (len(STATS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], STATS.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, STATS)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    x = {k: np.asarray(v, float) for k, v in stats.items()}
    words = np.maximum(x["n_words"], 1)
    return np.stack([x["n_symbols"] / words, x["word_chars"] / words, x["n_distinct"] / words], axis=1)


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows, which may be a fraction."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n < 2, np.maximum(n - 1, 0.0), np.maximum(1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))


class Forest:
    """Trees as arrays: node i has feature[i] (-1 in a leaf), cut[i], children 2i+1 and 2i+2, path length value[i].

    A row of bag b grows the trees b, b + 1, ... up to ``dealt`` of them, modulo the number of trees. A leaf's rows
    count by their share of the tree's, as if of TREE_ROWS, so scores mean the same however many rows there are.
    """

    def __init__(self, x: np.ndarray | None = None, n: int | None = None, trees: int = TREES, seed: int = SEED):
        """A forest for n rows, to be grown by summary() and grow(); from the rows x it is grown at once."""
        n = n if x is None else len(x)
        size = 2 ** (DEPTH + 1) - 1
        self.dealt = min(max(1, math.ceil(trees * TREE_ROWS / max(n, 1))), trees // 2)
        self.level, self.norm = 0, 1.0
        self.feature = np.full((trees, size), -1)
        self.cut = np.zeros((trees, size))
        self.value = np.zeros((trees, size))
        self.seed = seed
        if x is not None:
            bags = np.random.default_rng(seed).integers(0, trees, len(x))
            while self.level <= DEPTH:
                self.grow(*self.summary(x, bags))

    def summary(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, least and greatest statistics of the rows in each node of the level to be grown, all trees in turn."""
        trees, width = len(self.feature), 2**self.level
        count = np.zeros(trees * width, np.int64)
        low = np.full((trees * width, x.shape[1]), np.inf)
        high = np.full((trees * width, x.shape[1]), -np.inf)
        for j in range(self.dealt):
            tree, rows, node = (bags + j) % trees, x, np.zeros(len(x), int)
            for _ in range(self.level):
                f = self.feature[tree, node]
                on = f >= 0  # the others are in leaves of earlier levels
                tree, rows, node, f = tree[on], rows[on], node[on], f[on]
                node = 2 * node + 1 + (rows[np.arange(len(rows)), f] >= self.cut[tree, node])
            at = tree * width + node - (width - 1)
            count += np.bincount(at, minlength=trees * width)
            np.minimum.at(low, at, rows)
            np.maximum.at(high, at, rows)
        return count, low, high

    def grow(self, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """One level more from the summary of all rows."""
        trees, width = len(self.feature), 2**self.level
        nodes = slice(width - 1, 2 * width - 1)
        if self.level == 0:
            self.rows = count
            self.norm = float(expected_path(np.minimum(count, TREE_ROWS)).mean()) or 1.0
        share = count * np.repeat(np.minimum(self.rows, TREE_ROWS) / np.maximum(self.rows, 1), width)
        usable = high > low
        inner = usable.any(axis=1) & (self.level < DEPTH)
        which, place = np.random.default_rng([self.seed, self.level]).random((2, len(count)))
        nth = np.floor(which * usable.sum(axis=1)).astype(int) + 1
        f = np.argmax(np.cumsum(usable, axis=1) == nth[:, None], axis=1)
        at = np.flatnonzero(inner)
        cut = np.zeros(len(count))
        cut[at] = low[at, f[at]] + place[at] * (high[at, f[at]] - low[at, f[at]])
        self.feature[:, nodes] = np.where(inner, f, -1).reshape(trees, width)
        self.cut[:, nodes] = cut.reshape(trees, width)
        self.value[:, nodes] = np.where(inner, 0.0, self.level + expected_path(share)).reshape(trees, width)
        self.level += 1

    def score(self, x: np.ndarray, bags: np.ndarray | None = None) -> np.ndarray:
        """Anomaly score in (0, 1]; higher is more anomalous. With bags, by the trees that a row did not grow."""
        if not len(x):
            return np.zeros(0)
        trees = len(self.feature)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= self.cut[t, node]), node)
            total += self.value[t, node] if bags is None else np.where((t - bags) % trees < self.dealt, 0.0, self.value[t, node])
        return 2.0 ** (-total / (trees if bags is None else trees - self.dealt) / self.norm)


def calibrate(scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """Threshold at or above which a document is anomalous: the best balanced accuracy among the thresholds
    that keep keep_good of the good rows; infinity where one label is missing."""
    if not good.any() or good.all():
        return math.inf
    best, at = 0.0, math.inf
    cuts = np.unique(scores)
    kept_good = np.searchsorted(np.sort(scores[good]), cuts, "left") / good.sum()
    caught = 1 - np.searchsorted(np.sort(scores[~good]), cuts, "left") / (~good).sum()
    for c, k, b in zip(cuts, kept_good, caught, strict=True):
        if k >= keep_good and k + b - 1 > best:
            best, at = k + b - 1, float(c)
    return at


def calibrate_rows(scored: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """The threshold of calibrate() from a table of score and good, by counts of all its rows below each score."""
    good = F.col("good").cast("long")
    cuts = materialize(scored.groupBy("score").agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad")))
    goods, bads = cuts.agg(F.sum("good"), F.sum("bad")).first()
    if not goods or not bads:
        return math.inf
    kept, caught = F.col("before_good") / goods, F.lit(1.0) - F.col("before_bad") / bads
    gain = in_order(cuts, ["score"], ("good", "bad")).select("score", kept.alias("kept"), (kept + caught - 1).alias("gain"))
    best = gain.filter((F.col("kept") >= keep_good) & (F.col("gain") > 0)).orderBy(F.desc("gain"), "score").first()
    return best.score if best else math.inf


def base_failed(n_words, n_repeat):
    return (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)


def bag() -> Column:
    """Tree that a document is dealt to first, by its id and statistics."""
    return F.pmod(F.xxhash64(*STATS.fieldNames()), F.lit(TREES)).cast("int")


def grow_forest(rows: DataFrame) -> Forest | None:
    """Forest of all rows (statistics and bag), however few, in one pass for each level; none without a row."""
    n = rows.count()
    if n == 0:
        return None
    forest = Forest(n=n)
    bounds = [f"{side}_{c}" for side in ("low", "high") for c in FEATURES]
    schema = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in bounds])

    def run(batches):
        count, low, high = forest.summary(np.zeros((0, len(FEATURES))), np.zeros(0, int))
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in STATS.fieldNames()[1:]}
            c, least, most = forest.summary(features(columns), batch.column("bag").to_numpy())
            count, low, high = count + c, np.minimum(low, least), np.maximum(high, most)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), *map(pa.array, [*low[at].T, *high[at].T])], schema.fieldNames())

    while forest.level <= DEPTH:
        folded = [F.min(c).alias(c) if c.startswith("low") else F.max(c).alias(c) for c in bounds]
        pdf = rows.mapInArrow(run, schema).groupBy("node").agg(F.sum("n").alias("n"), *folded).toPandas()  # one row for each node of the level
        count, low, high = forest.summary(np.zeros((0, len(FEATURES))), np.zeros(0, int))
        count[pdf.node] = pdf.n
        low[pdf.node], high[pdf.node] = pdf[bounds[: len(FEATURES)]].to_numpy(), pdf[bounds[len(FEATURES) :]].to_numpy()
        forest.grow(count, low, high)
    return forest


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """Forest from all documents and threshold from all labelled documents that pass the base rules."""
    passed = ~base_failed(F.col("n_words"), F.col("n_repeat_words"))
    forest = grow_forest(stats.filter(passed).withColumn("bag", bag()))
    if forest is None:
        return None, math.inf
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = stats.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*STATS.fieldNames()[1:])).alias("s"))
    judged = one.join(known, "doc_id").select("doc_id", "s.*", (F.col("quality") > 0).alias("good")).filter(passed).withColumn("bag", bag())
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("good", T.BooleanType())])

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in STATS.fieldNames()[1:]}
            score = forest.score(features(columns), batch.column("bag").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(score, pa.float64()), batch.column("good")], schema.fieldNames())

    return forest, calibrate_rows(judged.mapInArrow(run, schema))


def judge(stats: DataFrame, forest: Forest | None, threshold: float) -> DataFrame:
    """stats with base_failed, anomaly and kept."""
    schema = T.StructType([*STATS.fields, T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in STATS.fieldNames()[1:]}
            score = forest.score(features(columns)) if forest else np.zeros(batch.num_rows)
            failed = base_failed(columns["n_words"], columns["n_repeat_words"])
            arrays = [*batch.columns, pa.array(failed, pa.bool_()), pa.array(score, pa.float64()), pa.array(~failed & (score < threshold), pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return stats.select(*STATS.fieldNames()).mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base rules, anomaly score and verdict of every document."""
    stats = materialize(document_stats(docs))
    return judge(stats, *fit(stats, labels))


def op1_quality_forest(spark, sf_dir):
    """Contract query: doc_id, the counts, base_failed and kept; the anomaly score is added."""
    out = score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
