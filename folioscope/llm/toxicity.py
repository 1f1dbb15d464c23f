"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's score is a logistic function of its words; a document's
score is 1 - prod(1 - sentence score), so one offending sentence is enough. Training sees document labels
only: the gradient of a document's loss is dealt out to its sentences by the noisy-or, which lets the model
find out which sentences carry the label. Weights are never negative and are pulled to zero (L1), so that most words have none.

The model is fitted on at most SAMPLE labelled documents, chosen by hash, never on a row whose
crc32(doc_id as text) mod 4 is 2. Executors read their texts, count features, and give each document as the
features of its sentences; the driver sees neither texts nor features that may have no weight. Scoring is one
pass over whole texts without a shuffle. Sentences whose score reaches SENTENCE_THRESHOLD are returned with
their place in the text.

Defined results: a null or empty text has no sentence and score 0; words of any length count; very long texts
are scored whole; without labelled rows of both kinds every score is 0; a repeated doc_id is one training
document, of its least text; null doc_ids are passed through and count as not held out; repeated rows each get
a result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import load, materialize

SAMPLE = 8000
MIN_DOCS = 6
MIN_LIFT = 4.0
EPOCHS = 120
L1 = 1e-4
RATE = 0.25
#: The logit of a sentence without evidence is fixed: thousands of them leave a document under 0.02.
BIAS = -12.0
THRESHOLD = 0.3
SENTENCE_THRESHOLD = 0.3
FOLDS, HELD = 4, 2

#: Marks that end a sentence, and other ASCII characters that are no part of a word.
ENDS = ".!?\n"
_other = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in ENDS)
_flat = bytes.maketrans((ENDS + _other).encode(), b"\n" * len(ENDS) + b" " * len(_other))
_sentence = re.compile(r"[^\n]*[^\s][^\n]*")
#: Lengths of the word beginnings that are features beside the whole word: inflected forms share them.
BEGINNINGS = (5, 6, 7)


def flat(text: str | None) -> str:
    """Lower case, sentence ends as newlines, other ASCII marks as spaces; as many code points as the text."""
    low = (text or "").lower()
    if len(low) != len(text or ""):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.encode("utf-8", "replace").translate(_flat).decode()


def sentence_spans(flat_text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence with anything in it, in code points."""
    return [m.span() for m in _sentence.finditer(flat_text)]


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence."""
    return [s.split() for s in _sentence.findall(flat(text))]


def word_features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(flat(text).split()) for f in word_features(w)}


def telling(toxic_docs: dict[str, int], clean_docs: dict[str, int], n_toxic: int, n_clean: int) -> list[str]:
    """Weights can only be positive, so features are those in MIN_DOCS toxic documents or more, and relatively
    more often there than in clean ones."""
    odds = n_toxic / max(n_clean, 1)
    return sorted(f for f, t in toxic_docs.items() if t >= MIN_DOCS and t > MIN_LIFT * odds * clean_docs.get(f, 0))


def bag_of(text: str | None, ids: dict[str, int]) -> tuple[int, list[list[int]]]:
    """The number of sentences without any known feature, and the feature ids of each of the others."""
    found = [[ids[f] for w in set(s) for f in word_features(w) if f in ids] for s in sentences(text)]
    some = [x for x in found if x]
    return len(found) - len(some), some


class NoisyOr:
    """A linear model of sentences: weights of word features, and a bias.

    A sentence's logit is the bias plus the weights of its distinct words; a word's weight is the sum of the
    weights of its features. A document's score is the noisy-or of its sentences' scores. Few features keep
    a weight, so a text is searched for these by one Aho-Corasick pass.
    """

    def __init__(self, weights: dict[str, float] | None = None, bias: float = -30.0):
        self.weights, self.bias, self._search = weights or {}, bias, None

    def __reduce__(self):
        return NoisyOr, (self.weights, self.bias)

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def fit(self, texts: list[str | None], labels: np.ndarray) -> NoisyOr:
        """Fits on texts that are at hand; train() does the same with texts that stay on the executors."""
        count = [Counter(), Counter()]
        for text, label in zip(texts, labels, strict=True):
            count[int(label <= 0)].update(text_features(text))
        features = telling(*count, int((labels > 0).sum()), int((labels <= 0).sum()))
        ids = {f: i for i, f in enumerate(features)}
        return self.fit_bags(features, [bag_of(t, ids) for t in texts], labels)

    def fit_bags(self, features: list[str], bags: list[tuple[int, list[list[int]]]], labels: np.ndarray, epochs: int = EPOCHS, l1: float = L1, rate: float = RATE) -> NoisyOr:
        """Gradient descent on the noisy-or of the bags. Sentences without features all have the logit of the bias."""
        col = np.array([f for _, some in bags for s in some for f in s], np.int64)
        sent = np.repeat(np.arange(sum(len(some) for _, some in bags)), [len(s) for _, some in bags for s in some])
        bag = np.repeat(np.arange(len(bags)), [len(some) for _, some in bags])
        plain = np.array([n for n, _ in bags], np.int64)
        y = labels > 0
        share = np.where(y, 0.25 / max(y.sum(), 1), 0.75 / max((~y).sum(), 1))
        x, bias = np.zeros(len(features)), BIAS
        rest = plain * np.log1p(-1 / (1 + np.exp(-bias)))
        m, v = np.zeros_like(x), np.zeros_like(x)
        for t in range(1, epochs + 1):
            z = bias + np.bincount(sent, x[col], len(bag))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = rest + np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))
            some = np.maximum(-np.expm1(none), 1e-9)
            # d loss / d logit of a sentence: p in a clean bag, -p * (1 - some) / some in a toxic one
            dz = share[bag] * p * np.where(y[bag], -(1 - some[bag]) / some[bag], 1.0)
            g = np.bincount(col, dz[sent], len(x))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
            x -= step * m / (1 - 0.9**t)
            x = np.maximum(x - step * l1, 0)
        self.weights, self.bias = {f: float(x[i]) for i, f in enumerate(features) if x[i]}, float(bias)
        return self

    def logits(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The logit of each sentence, and the sentences' spans."""
        if self._search is None:
            self._search = ahocorasick.Automaton()
            for key in {f.rstrip("-") for f in self.weights}:
                self._search.add_word(key, len(key))
            self._search.make_automaton()
        low = flat(text)
        spans = sentence_spans(low)
        z = np.full(len(spans), self.bias)
        if not len(self._search) or not spans:
            return z, spans
        starts, seen = [s[0] for s in spans], set()
        for end, n in self._search.iter(low):
            start = end - n + 1
            if start and not low[start - 1].isspace():
                continue
            while end + 1 < len(low) and not low[end + 1].isspace():
                end += 1
            at = bisect.bisect_right(starts, start) - 1
            word = low[start : end + 1]
            if (at, word) not in seen:
                seen.add((at, word))
                z[at] += self.word_weight(word)
        return z, spans


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> NoisyOr:
    """Fits on at most ``sample`` labelled documents outside the held-out fold (the bound is this parameter)."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS).cast("long"))
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold != HELD)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))  # at most ``sample`` documents
    size = {r["t"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return NoisyOr()

    def count(batches):
        for batch in batches:
            seen = [Counter(), Counter()]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[0 if toxic else 1].update(text_features(text))
            every = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([c[f] for f in every], pa.int64()) for c in seen]], ["f", "t", "c"])

    texts = rows.select("text", (F.col("toxic") > 0).alias("toxic"), "doc_id")
    counted = texts.mapInArrow(count, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = size[True] / size[False]
    counted = counted.filter((F.col("t") >= MIN_DOCS) & (F.col("t") > MIN_LIFT * odds * F.col("c"))).collect()  # features of the sample's toxic documents
    features = telling({r["f"]: r["t"] for r in counted}, {r["f"]: r["c"] for r in counted}, size[True], size[False])
    ids = {f: i for i, f in enumerate(features)}

    def bags(batches):
        for batch in batches:
            done = [bag_of(t, ids) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int64()), batch.column(1), pa.array([n for n, _ in done], pa.int64()), pa.array([x for _, x in done], pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "n", "x"])

    found = texts.mapInArrow(bags, "doc_id long, toxic boolean, n long, x array<array<int>>").toArrow().sort_by("doc_id")
    of = list(zip(found.column("n").to_pylist(), found.column("x").to_pylist(), strict=True))
    return NoisyOr().fit_bags(features, of, np.array(found.column("toxic").to_pylist(), bool))


SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
    ]
)


def bag_result(model: NoisyOr, text: str | None) -> tuple[float, list[dict]]:
    """Score of a text and the spans of its offending sentences."""
    z, spans = model.logits(text)
    if not spans:
        return 0.0, []
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    score = round(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), 12)
    found = np.flatnonzero(p >= SENTENCE_THRESHOLD)
    return score, [{"start": spans[i][0], "end": spans[i][1], "score": round(float(p[i]), 9)} for i in found]


def score_toxicity(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of offending sentences for every document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            done = [bag_result(model, t) for t in batch.column(1).to_pylist()]
            score = [x[0] for x in done]
            kinds = [pa.bool_(), pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))]
            columns = [list(map(held_out, ids)), score, [int(s >= THRESHOLD) for s in score], [x[1] for x in done]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, columns, kinds)], SCORED.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def drop_toxic(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """docs without those predicted toxic; all columns are kept as they are, one pass, no join."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [bag_result(model, t)[0] < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op7_toxicity_mil(spark, sf_dir):
    """Contract query: doc_id, held_out, score, predicted; spans of offending sentences are added as start-end, joined by commas."""
    docs = load(spark, sf_dir, "documents")
    out = score_toxicity(docs, train(docs, load(spark, sf_dir, "labels")))
    places = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_offending"), places.alias("offending"))
