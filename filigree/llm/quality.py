"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. The chain's node scores use the line's own features and those of
its neighbours, its edge scores use the pair of labels; forward-backward gives each line's
marginal. Marginals weighted by line length are averaged to the document's share of good
text, which one logistic step turns into a probability. Only documents have labels, so a
line is trained on its document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import held_out, table
from filigree.llm.sampling import labelled_sample

#: Labelled documents of either class that are learnt from, at most, and their longest text.
PER_CLASS, MAX_CHARS = 1500, 20_000
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>{}[]\\/^~=+_@"
MARKS = b".,;:!?"
OWN = 14
#: Own features that the neighbouring lines lend, before and after.
LENT = (3, 4, 5, 6, 8, 9, 10)
N_FEATURES = OWN + 2 * len(LENT)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths in bytes of the lines that aren't blank; a text without any has one empty line."""
    lines = [x for x in text.encode("utf-8", "replace").split(b"\n") if not x.isspace() and x] or [b""]
    own, seen = np.zeros((len(lines), OWN), "float32"), set()
    for row, line in zip(own, lines, strict=True):
        n, words = max(1, len(line)), line.split()
        count = max(1, len(words))
        letters = n - len(line.translate(None, LOWER))
        symbols = n - len(line.translate(None, SYMBOLS))
        row[0] = 1
        row[1] = np.log1p(n) / 5
        row[2] = min(n / count, 30) / 10
        row[3] = (n - len(line.translate(None, UPPER))) / n
        row[4] = min(1, 5 * symbols / n)
        row[5] = line.count(b"|") * 3 / count
        row[6] = line.count(b"!") / count
        row[7] = (n - len(line.translate(None, DIGITS))) / n
        row[8] = 1 - len(set(words)) / count
        row[9] = sum(map(bytes.__eq__, words, words[1:])) / count
        row[10] = letters / n
        row[11] = (n - len(line.translate(None, MARKS))) / count
        row[12] = line in seen
        row[13] = line[-1:] in (b".", b"!", b"?")
        seen.add(line)
    out = np.zeros((len(lines), N_FEATURES), "float32")
    out[:, :OWN] = own
    k = len(LENT)
    out[1:, OWN : OWN + k] = own[:-1, LENT]
    out[:-1, OWN + k :] = own[1:, LENT]
    return out, np.array([max(1, len(x)) for x in lines], "float64")


class Chains:
    """Chains of several documents, longest first, so that step t works on a prefix of them."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        self.counts = counts[self.order]
        self.starts = (np.cumsum(counts) - counts)[self.order]
        self.active = [int(np.searchsorted(-self.counts, -t, side="left")) for t in range(int(counts.max()) if len(counts) else 0)]

    def marginals(self, emit: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, expected label pairs summed, and log partition of each document.

        emit is the score of good against bad; edge[a, b] the score of label b after a.
        """
        e = np.exp(edge - edge.max())
        node = np.stack([1 / (1 + np.exp(np.clip(emit, -30, 30))), 1 / (1 + np.exp(-np.clip(emit, -30, 30)))], 1)
        forward, backward, scale = np.empty_like(node), np.ones_like(node), np.empty(len(node))
        for t, k in enumerate(self.active):
            at = self.starts[:k] + t
            a = node[at] if t == 0 else (forward[at - 1] @ e) * node[at]
            scale[at] = a.sum(1)
            forward[at] = a / scale[at][:, None]
        pairs = np.zeros((2, 2))
        for t in range(len(self.active) - 1, 0, -1):
            at = self.starts[: self.active[t]] + t
            later = node[at] * backward[at] / scale[at][:, None]
            backward[at - 1] = later @ e.T
            pairs += e * (forward[at - 1].T @ later)
        both = forward * backward
        return both[:, 1] / both.sum(1), pairs, scale


@dataclass
class LineField:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    edge: np.ndarray
    slope: float = 4.0
    shift: float = -2.0

    def lines(self, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return Chains(counts).marginals(((feats - self.mean) / self.spread) @ self.weights, self.edge)[0]

    def share(self, feats: list[np.ndarray], lengths: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each document the length-weighted mean of its lines' marginals, and these."""
        counts = np.array([len(x) for x in lengths])
        good, size = self.lines(np.concatenate(feats), counts), np.concatenate(lengths)
        at = np.cumsum(counts) - counts
        return np.add.reduceat(good * size, at) / np.add.reduceat(size, at), np.split(good, at[1:])

    def probability(self, share: np.ndarray) -> np.ndarray:
        x = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30)))


def fit_lines(feats: list[np.ndarray], lengths: list[np.ndarray], y: np.ndarray, prior: float, *, rounds: int = 200, rate: float = 0.05, decay: float = 2e-3) -> LineField:
    """Conditional likelihood by Adam; then one logistic step under the labels' own shares.

    With no labelled documents, or of one class only, every document has that class's share.
    """
    if len(y) == 0 or len(set(y)) < 2:
        field = LineField(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, 0.0)
        field.shift = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
        return field
    x, counts = np.concatenate(feats).astype("float64"), np.array([len(f) for f in feats])
    mean, spread = x.mean(0), x.std(0) + 1e-6
    mean[0], spread[0] = 0, 1
    x = (x - mean) / spread
    chains, truth = Chains(counts), np.repeat(y, counts)
    # a document counts alike, however many lines it has
    weight = np.repeat(1 / counts, counts) / len(counts)
    same = np.zeros((2, 2))
    for label in (0, 1):
        same[label, label] = ((counts - 1) * (y == label)).sum()
    params, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for step in range(1, rounds + 1):
        good, pairs, _ = chains.marginals(x @ params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2))
        grad = np.concatenate([x.T @ ((good - truth) * weight), ((pairs - same) / counts.sum()).ravel()])
        grad += decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field = LineField(mean, spread, params[:N_FEATURES].copy(), params[N_FEATURES:].reshape(2, 2).copy())
    share, _ = field.share(feats, lengths)
    z = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    each = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * each * z).sum() + 1e-3 * (a - 1), ((p - y) * each).sum() + 1e-4 * b])
        h = p * (1 - p) * each
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-4]])
        d = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
    field.slope, field.shift = float(max(a, 0.05)), float(b)
    return field


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> LineField:
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [line_features(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [f.tobytes() for f, _ in both], "n": [n.tobytes() for _, n in both]})

    sample = labelled_sample(docs, labels, "quality", per_class=per_class, max_chars=max_chars)
    key = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInPandas(features, f"doc_id {key}, y int, x binary, n binary").toPandas().sort_values("doc_id")
    shares = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("quality")).first()[0]
    feats = [np.frombuffer(b, "float32").reshape(-1, N_FEATURES) for b in got["x"]]
    lengths = [np.frombuffer(b, "float64") for b in got["n"]]
    return fit_lines(feats, lengths, got["y"].to_numpy("int64"), 0.5 if shares is None else float(shares))


def score(docs: DataFrame, model: LineField, *, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `keep`), score, and P(good) of each line that isn't blank.

    A null, empty or blank text counts as one empty line. Rows that repeat are scored alike;
    other columns are neither read nor returned.
    """
    keep = keep or ["doc_id"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keep].copy()
            scores, lines = np.empty(len(pdf)), []
            for at in range(0, len(pdf), 500):
                both = [line_features(t or "") for t in pdf["text"].iloc[at : at + 500]]
                share, good = model.share([f for f, _ in both], [n for _, n in both])
                scores[at : at + 500] = model.probability(share)
                lines += [g.astype("float32") for g in good]
            out["score"], out["lines_good"] = scores, lines
            yield out

    columns = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInPandas(run, f"{fields}, score double, lines_good array<float>")


#: From this score on a document counts as good.
THRESHOLD = 0.3


def keep_good(docs: DataFrame, model: LineField, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score is `threshold` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                both = [line_features(t or "") for t in part.column("text").to_pylist()]
                share, _ = model.share([f for f, _ in both], [n for _, n in both])
                yield part.filter(pa.array(model.probability(share) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("lines_good").alias("n_lines"), F.size(F.filter("lines_good", lambda p: p < 0.5)).alias("n_bad_lines"),
    )


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
