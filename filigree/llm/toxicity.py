"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score, and the document's
score is their noisy-or, 1 - prod(1 - p). Only documents have labels: the loss of the
noisy-or is carried back to the sentences, so the model learns which sentences offend.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import held_out, table
from filigree.llm.sampling import labelled_sample

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
#: Features are hashed to so many weights, whatever the vocabulary.
DIM = 1 << 18
#: Labelled documents of either class that are learnt from, at most, and their longest text.
PER_CLASS, MAX_CHARS = 3000, 50_000
#: Letters of a word's beginning, which is a feature beside the word.
STEMS = (4, 5)


def stem_features(stem: str) -> list[int]:
    return [xxhash.xxh32_intdigest(stem[:n], seed=n) % DIM for n in STEMS if len(stem) >= n]


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    return [xxhash.xxh32_intdigest(word) % DIM, *stem_features(word[: max(STEMS)])]


class WordWeights(dict):
    """Weights of words, worked out when first asked for; never more than a bounded number at a time."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.stems = weights.tolist(), {}

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        stem = word[: max(STEMS)]
        if (v := self.stems.get(stem)) is None:
            if len(self.stems) > 400_000:
                self.stems.clear()
            v = self.stems[stem] = sum(self.weights[i] for i in stem_features(stem))
        v += self.weights[xxhash.xxh32_intdigest(word) % DIM]
        self[word] = v
        return v


@dataclass
class NoisyOr:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, texts: list[str], words: WordWeights) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """For each text the noisy-or, and (start, end, score) of the sentences whose score is 0.5 or more."""
        bias, base, found, weight = self.bias, softplus(self.bias), WORD.findall, words.__getitem__
        for text in texts:
            total, bad, lowered = 0.0, [], text.lower()
            if len(lowered) != len(text):  # some letters grow when lower-cased; spans are of the text
                lowered = "".join(low if len(low := c.lower()) == 1 else c for c in text)
            for m in SENTENCE.finditer(lowered):
                z = bias + sum(map(weight, set(found(m[0]))))
                total += softplus(z)
                if z >= 0:
                    bad.append((m.start(), m.end(), 1 / (1 + math.exp(-min(z, 30)))))
            yield -math.expm1(-(total or base)), bad


def softplus(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def bags(sample: DataFrame) -> pd.DataFrame:
    """Hashed features of the sample's sentences: y, features of all sentences, count for each."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for y, text in zip(pdf["y"], pdf["text"], strict=True):
                parts = [sorted({f for word in set(WORD.findall(s)) for f in word_features(word)}) for s in SENTENCE.findall((text or "").lower())]
                parts = [p for p in parts if p]
                if parts:
                    rows.append((y, np.concatenate(parts).astype("int32").tobytes(), np.array([len(p) for p in parts], "int32").tobytes()))
            yield pd.DataFrame(rows, columns=["y", "features", "sizes"])

    return sample.mapInPandas(features, "y int, features binary, sizes binary").toPandas()


def fit_bags(data: pd.DataFrame, *, rounds: int = 150, rate: float = 6.0, momentum: float = 0.9, decay: float = 3e-4, least: int = 4, share: float = 0.25) -> NoisyOr:
    """Gradient descent on the documents' log loss, of which toxic ones make up `share`.

    Weights stay at 0 or above, so a word adds to its sentence's score or leaves it. Plain steps of the
    mean loss move words that many documents share; a word seen a few times hardly moves.
    With no labelled documents, or of one class only, every score is low.
    """
    model = NoisyOr(np.zeros(DIM, "float32"), -4.0)
    if len(data) == 0 or data["y"].nunique() < 2:
        return model
    data = data.sort_values(["y", "features"]).reset_index(drop=True)  # the same sums at each run
    y = data["y"].to_numpy()
    sizes = [np.frombuffer(b, "int32") for b in data["sizes"]]
    features = np.concatenate([np.frombuffer(b, "int32") for b in data["features"]])
    doc_at = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])[:-1]
    per_doc = np.array([len(s) for s in sizes])
    sizes = np.concatenate(sizes)
    often = np.bincount(features, minlength=DIM)[features] >= least  # rarer features keep weight 0
    sizes = np.add.reduceat(often.astype("int64"), np.cumsum(sizes) - sizes)
    features = features[often]
    filled = np.flatnonzero(sizes)
    sent_at = (np.cumsum(sizes) - sizes)[filled]
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    used, features = np.unique(features, return_inverse=True)
    w, b, vw, vb = np.zeros(len(used)), model.bias, np.zeros(len(used)), 0.0
    for _ in range(rounds):
        z = np.full(len(sizes), b)
        z[filled] += np.add.reduceat(w[features], sent_at)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        s = np.maximum(np.add.reduceat(np.logaddexp(0, z), doc_at), 1e-9)
        slope = weight * np.where(y == 1, -1 / np.expm1(np.minimum(s, 50)), 1.0)
        grad = np.repeat(slope, per_doc) * p
        gw = np.bincount(features, weights=np.repeat(grad, sizes), minlength=len(used)) + decay
        vw = momentum * vw - rate * np.clip(gw, -1, 1)
        vb = momentum * vb - 0.1 * rate * float(np.clip(grad.sum(), -1, 1))
        w, b = np.maximum(w + vw, 0), b + vb  # words add to a sentence's score or leave it
        vw[w == 0] = 0
    model.weights[used] = w
    model.bias = float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> NoisyOr:
    return fit_bags(bags(labelled_sample(docs, labels, "toxic", per_class=per_class, max_chars=max_chars)))


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, score, and the offending sentences as spans with their scores.

    A null or empty text, or one without sentences, counts as one sentence without words.
    Rows that repeat are scored alike; other columns are neither read nor returned.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordWeights(model.weights)
        for pdf in batches:
            found = list(model.sentence_scores([t or "" for t in pdf["text"]], words))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [f[0] for f in found], "offending": [[{"start": a, "end": b, "score": p} for a, b, p in f[1]] for f in found]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {key}, score double, offending array<struct<start:int,end:int,score:double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
