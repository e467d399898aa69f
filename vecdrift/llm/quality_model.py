r"""Quality classifier by Bradley-Terry pairwise ranking (operator 3).

Each document's text gives ``FEATURES`` measurements, binned at training quantiles into indicator features. From
preference pairs (a document labelled 1 beats one labelled 0) a linear score is learnt by logistic loss on feature
differences (Newton steps, L2). The cut is a quantile of the training documents' scores - of the candidates, the one
of least balanced error - and scores map to (0, 1) by a logistic curve that is 0.3 at the cut.

Bounds: at most ``SAMPLE`` labelled documents train the model, chosen by hash order of their id (a top-k in Spark);
their features, not their texts, reach the driver. Scoring is one narrow pass over all whole texts with the weights
(a few kB) in the closure; memory is that of ``chunks``.

Defined results: null and empty texts have measurements of zero and are scored; null or absent labels don't train;
a null doc_id counts as held out (crc32 of the empty text is 0); with no pairs to learn from every score is 0.5.
Repeated rows score alike. An empty table gives no rows. Extra columns, labels, lang, source and ids never enter a
score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32

SAMPLE = 20_000
PAIRS = 60_000
BINS = 10
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
FEATURES = (
    "log_words", "word_length", "upper", "exclaim", "symbols", "distinct", "dup_lines", "repeat_windows", "digits",
    "stops", "commas", "same_as_last", "short_words", "top_word", "entropy", "non_ascii", "words_a_line", "capital_words", "long_words",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def measure(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n_bytes = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    place = {w: i for i, w in enumerate(counts)}
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    repeated = 0.0
    if len(at) > 3:
        k = np.uint64(max(2, len(place)))
        a = at.astype(np.uint64)
        with np.errstate(over="ignore"):
            codes = np.sort((a[:-2] * k + a[1:-1]) * k + a[2:])
        same = codes[1:] == codes[:-1]
        repeated = float(same.mean())
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    p = hist[hist > 0] / n_bytes
    return [
        float(np.log1p(len(words))), float(lengths.mean()) if len(words) else 0.0, float(hist[65:91].sum() / letters), float(hist[33] / n),
        float(hist[_SYMBOLS].sum() / n), float(np.log1p(len(counts)) / np.log1p(n)), 1 - len(set(lines)) / max(1, len(lines)), repeated,
        float(hist[48:58].sum() / n), float(hist[46] / n), float(hist[44] / n), float((at[1:] == at[:-1]).mean()) if len(at) > 1 else 0.0,
        float((lengths <= 2).sum() / n), max(counts.values(), default=0) / n, float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        float(hist[128:].sum() / n_bytes), float(np.log1p(n / max(1, len(lines)))), sum(map(bytes.isupper, counts)) / n, float((lengths > 25).sum() / n),
    ]


class Model:
    """Bins, weights and cut; small, pickled into the scoring closure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
        # the extremes matter more than the middle, so the tails are cut finer
        self.edges = [np.unique(np.concatenate((e, np.quantile(x[:, j], [0.01, 0.03, 0.97, 0.99])))) if len(x) else e for j, e in enumerate(self.edges)]
        self.offsets = np.concatenate(([0], np.cumsum([len(e) + 1 for e in self.edges])))
        self.weights = np.zeros(self.offsets[-1])
        self.cut, self.slope = 0.0, 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        f = self.indicators(x)
        d = f[rng.choice(good, PAIRS)] - f[rng.choice(bad, PAIRS)]
        for _ in range(12):
            p = 1 / (1 + np.exp(np.clip(d @ self.weights, -30, 30)))  # of the pair being the other way round
            ridge = 1e-3 * len(d)
            gradient = d.T @ p - ridge * self.weights
            curvature = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(self.weights))
            self.weights += np.linalg.solve(curvature, gradient)
        s = f @ self.weights
        best = None
        for q in np.arange(0.01, 0.6, 0.005):
            cut = float(np.quantile(s, q))
            error = (s[good] < cut).mean() + (s[bad] >= cut).mean()
            if best is None or error < best[0]:
                best = (error, cut)
        low, high = s[s < best[1]], s[s >= best[1]]
        self.cut = (float(low.max()) + float(high.min())) / 2 if len(low) and len(high) else best[1]
        self.slope = 3.0 / max(1e-6, float(s[good].mean() - s[bad].mean()))

    def indicators(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.offsets[-1]), np.float64)
        for j, edges in enumerate(self.edges):
            out[np.arange(len(x)), self.offsets[j] + np.searchsorted(edges, x[:, j])] = 1
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        s = np.zeros(len(x))
        for j, edges in enumerate(self.edges):
            s += self.weights[self.offsets[j] + np.searchsorted(edges, x[:, j])]
        at_cut = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((s - self.cut) * self.slope + at_cut, -40, 40)))


def _measured(docs: DataFrame, keep: tuple[str, ...], text_column: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = np.array([measure(t) for t in batch.column(len(keep)).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))], names=[*keep, "x"])

    df = docs.select(*keep, F.col(text_column).cast("string").alias("__t"))
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{schema}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows outside the held-out fold."""
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (id_crc32("id") % FOLDS != HELD_OUT))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    found = _measured(joined, ("doc_id", "y"), "text").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return Model(x, found["y"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    def run(batches):
        for batch in batches:
            x = np.array([measure(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    df = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("t"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, train(docs, labels))
    return s.select("doc_id", (id_crc32() % FOLDS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
