"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its
words; the document's is the noisy-or of its sentences: toxic unless every sentence
is clean. Only documents carry labels; the gradient of the noisy-or hands each label
to the sentences that explain it, so that the trained model locates them.

A word's features are itself and its first letters (4 to 8), which lets word forms
share weight. The features are chosen by how far their document frequencies differ
between the classes; at most MOST_FEATURES of them, so that the model that is
shipped has a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, texts_to_python

#: Labelled documents that training takes at most, of each label: the first by a hash of the id.
TOXIC_DOCS, CLEAN_DOCS = 2500, 6000
MOST_FEATURES, STEPS, RATE, L2 = 6000, 300, 0.3, 3e-4
#: Features are numbered by this many bits of their hash.
MASK = (1 << 22) - 1
#: Words whose summed weight a worker remembers.
CACHE_WORDS = 300_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def word_features(w: str) -> list[int]:
    """Numbers of a lower-cased word's features: hashes, so that no table of words is kept."""
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & MASK for f in (w + "$", *(w[:k] for k in range(4, min(len(w), 8) + 1)))]


class Model:
    """Weights of features, and the bias of a sentence."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self.cache.get(w)
        if got is None:
            get = self.weights.get
            got = sum(get(f, 0.0) for f in word_features(w.lower()))
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            if len(w) <= 64:
                self.cache[w] = got
        return got

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, log-odds) of each sentence with a word."""
        out, word = [], self.word
        for m in _SENTENCE.finditer(text):
            words = _WORD.findall(m[0])
            if words:
                out.append((m.start(), m.end(), self.bias + sum(map(word, set(words)))))
        return out

    def score(self, odds: list[float]) -> float:
        """Noisy-or; 0 without sentences."""
        return float(-np.expm1(-np.logaddexp(0.0, np.array(odds)).sum())) if odds else 0.0


def _bags(text: str) -> Iterator[np.ndarray]:
    """The features of each sentence with a word."""
    of_word: dict[str, list[int]] = {}
    for m in _SENTENCE.finditer(text):
        if words := set(_WORD.findall(m[0])):
            found = []
            for w in words:
                w = w.lower()
                if w not in of_word:
                    of_word[w] = word_features(w)
                found += of_word[w]
            yield np.unique(np.array(found, np.int64))


def train(bags: list[list[np.ndarray]], toxic: list[int], chosen: list[int]) -> Model:
    """Fit on documents as bags of sentences, each with the places in `chosen` of its features.

    With one class only, or without a word, the model scores every text near 0.
    """
    y = np.array(toxic, float)
    if not 0 < y.sum() < len(y) or not any(bags):
        return Model({}, -20.0)
    n1, n0 = y.sum(), len(y) - y.sum()
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag])
    each = [s for bag in bags for s in bag]
    row, col = np.repeat(np.arange(len(each)), [len(s) for s in each]), np.concatenate(each).astype(int)
    w, bias = np.zeros(len(chosen)), -5.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)
    for k in range(1, STEPS + 1):
        z = np.clip(bias + np.bincount(row, w[col], len(doc)), -30, 30)
        s = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(y)))  # chance that no sentence is toxic
        pull = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) * weight / len(y)
        g = pull[doc] * s
        gw, gb = np.bincount(col, g[row], len(w)) + L2 * w, g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**k, 1 - 0.999**k
        w -= RATE * (mw / c1) / (np.sqrt(vw / c2) + 1e-6)
        bias -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return Model({i: float(x) for i, x in zip(chosen, w) if abs(x) > 1e-3}, float(bias))


def in_training(doc_id: Column) -> Column:
    """False for the held-out fifth of the ids: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model:
    """Train on a bounded sample of labelled documents outside the held-out fifth.

    Rows without an id, a label or a document are left out; nothing but texts and labels
    is used; of rows with one id, one text counts. The sample's ids (bounded) are
    broadcast. Its texts stay on the executors: they count the features and choose them,
    and hand the driver the chosen ones of each sentence, as numbers.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & in_training(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, toxic_docs), (0, clean_docs))]
    sample = parts[0].unionAll(parts[1]).withColumnRenamed("doc_id", "labelled")
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("id") == F.col("labelled")).groupBy("id", "toxic").agg(F.min("text").alias("text"))
    rows = stored(rows.select("id", "toxic", "text"), shared_dir(spark))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if bag := list(_bags(t)):
                    f = np.unique(np.concatenate(bag))
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.full(len(f), y, np.int32))], ["feature", "toxic"])

    texts_to_python(spark)
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model({}, -20.0)
    df = rows.mapInArrow(counted, "feature bigint, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a + b >= 4")
    p, q, both = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1), (F.col("a") + F.col("b")) / (n1 + n0)
    far = (p - q) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    best = df.select("feature", F.abs(far).alias("far")).where("far > 2").orderBy(F.desc("far"), "feature").limit(MOST_FEATURES)
    chosen = sorted(r["feature"] for r in best.collect())
    at = np.array(chosen, np.int64)

    def places(features: np.ndarray) -> list[int]:
        k = np.minimum(np.searchsorted(at, features), len(at) - 1)
        return k[at[k] == features].tolist() if len(at) else []

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [list(map(places, _bags(t))) for t in b.column(2).to_pylist()]
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, kind)], ["id", "toxic", "bags"])

    kind = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(picked, f"id {kind}, toxic int, bags array<array<int>>").orderBy("id", "toxic").toArrow()
    bags = [[np.array(s, np.int32) for s in x] for x in found.column("bags").to_pylist()]
    return train(bags, found.column("toxic").to_pylist(), chosen)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """(id, score, sentences): the noisy-or, and the places of sentences that score at_least.

    Null and empty texts score 0 and have no sentences. Each row stands for itself. No
    shuffle; the model is at most MOST_FEATURES weights.
    """
    texts_to_python(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    line = float(np.log(at_least / (1 - at_least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            scores, places = [], []
            for t in b.column(1):
                s = m.sentences(t.as_py() or "")
                scores.append(m.score([x for _, _, x in s]))
                places.append([{"start": a, "end": z, "score": float(1 / (1 + np.exp(-x)))} for a, z, x in s if x >= line])
            where = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(places, where)], ["id", "score", "sentences"])

    out = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).mapInArrow(run, f"id {kind}, score double, sentences array<struct<start:int,end:int,score:double>>")
    return out.withColumnRenamed("id", id_col)
