"""Document quality by Bradley-Terry ranking.

Every text becomes a fixed list of surface features (shares of each kind of byte,
lengths of words and lines, repeats of words, lines and word runs). Labelled
documents give preference pairs, one of either label; the logistic loss on their
feature differences, with an L2 penalty, gives the weights (Newton's method on the
driver). A document's strength is its weighted sum of features. The threshold is
the quantile of the training strengths at the share of label 0; the score is a
logistic curve that has `cut_score` there.

The fit uses at most `max_rows` labelled rows (the least by a hash of doc_id) and
`pairs` pairs drawn with a fixed seed; scores are given to every row. Labels,
lang, source and doc_id are no features.

Nulls: a null text is empty; empty texts have features of their own and a score.
Labels that are null or of an unknown document are ignored; repeated rows are
scored alike. Of the rows and labels of one doc_id the one of least text hash, then of least
label, is learned from. Without labels of both kinds all scores are 0.5. A row with a null
doc_id is scored, never learned from. Extra columns are ignored. A very long text is read
whole, in stretches of bounded size; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textkit

MAX_ROWS = 20_000
PAIRS = 60_000
CUT_SCORE = 0.3
L2 = 1e-3
_KINDS = [range(9, 10), range(10, 11), range(13, 14), range(32, 33), range(48, 58), range(65, 91), range(97, 123), range(128, 256), *(range(b, b + 1) for b in range(33, 127) if not chr(b).isalnum())]
_KIND = np.full(256, len(_KINDS))
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k
WIDTH = len(_KINDS) + 1 + 14


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features per text."""
    starts, ends, at = textkit.spans(data, offsets, "space")
    word = textkit.hashes(data, starts, ends, "space")
    gram = textkit.ngrams(word, 5)
    size = ends - starts
    upper = np.append(0, np.cumsum((data >= 65) & (data < 91)))
    kinds = _KIND[data]
    breaks = np.flatnonzero(data == 10)
    out = np.zeros((len(offsets) - 1, WIDTH))
    for r in range(len(out)):
        a, b, lo, hi = int(at[r]), int(at[r + 1]), int(offsets[r]), int(offsets[r + 1])
        n = b - a
        share = np.bincount(kinds[lo:hi], minlength=len(_KINDS) + 1) / max(1, hi - lo)
        out[r, : len(share)] = np.sqrt(share)
        if not n:
            out[r, -1] = 1
            continue
        own, lengths = word[a:b], size[a:b]
        _, times = np.unique(own, return_counts=True)
        line = np.diff(np.concatenate([[lo - 1], breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)], [hi]]))
        raw = bytes(data[lo:hi]).split(b"\n")
        inked = [x for x in raw if x.strip()]
        repeated = 0.0
        if n >= 5:
            _, back, many = np.unique(gram[a : b - 4], return_inverse=True, return_counts=True)
            repeated = float((many[back] > 1).mean())
        capital = upper[ends[a:b]] - upper[starts[a:b]]
        out[r, len(share) :] = [
            np.log1p(n) / 5,
            1 / (1 + n),
            lengths.mean() / 10,
            lengths.std() / 10,
            np.log1p(lengths.max()) / 5,
            len(times) / n,
            np.sqrt(times.max() / n),
            np.sqrt(repeated),
            np.sqrt(1 - len(set(inked)) / max(1, len(inked))),
            np.log1p(line.mean()) / 5,
            np.sqrt(len(raw) / n),
            float((capital == lengths).mean()),
            float((capital > 0).mean()),
            0.0,
        ]
    return out


def _feature_rows(column: pa.Array) -> np.ndarray:
    data, offsets = textkit.buffers(column)
    found = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in textkit.slices(offsets)]
    return np.concatenate(found) if found else np.zeros((0, WIDTH))


def _featured(batches):
    for batch in batches:
        rows = _feature_rows(batch.column("text"))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, WIDTH, dtype=np.int32)), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("l_id"), batch.column("tag"), batch.column("quality"), listed], names=["l_id", "tag", "quality", "features"])


class Model:
    """Standardised weights, and the strength at which the score is cut_score."""

    def __init__(self, mean, spread, weights, threshold, cut_score):
        self.mean, self.spread, self.weights, self.threshold, self.cut_score = mean, spread, weights, threshold, cut_score

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        z = self.strength(x) - self.threshold + np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = L2, cut_score: float = CUT_SCORE, seed: int = 5) -> Model:
    """Bradley-Terry weights from rows of features and labels 0 and 1."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, cut_score)
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1
    z = ((x - mean) / spread).clip(-8, 8)
    rnd = np.random.Generator(np.random.PCG64(seed))
    d = z[rnd.choice(good, pairs)] - z[rnd.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-(d @ w).clip(-30, 30)))
        gradient = d.T @ (1 - p) / pairs - l2 * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return Model(mean, spread, w, float(np.quantile(z @ w, len(bad) / len(y))), cut_score)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, cut_score: float = CUT_SCORE) -> Model:
    """labels: doc_id, quality; rows to learn from only."""
    spark = docs.sparkSession
    asked = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality"))
    held = asked.orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows).collect()  # max_rows at most
    some = F.broadcast(spark.createDataFrame([tuple(r) for r in held], "l_id long, quality int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, F.col("doc_id") == F.col("l_id")).select("l_id", F.xxhash64("text").alias("tag"), "quality", "text")
    each = rows.mapInArrow(_featured, "l_id long, tag long, quality int, features array<double>").groupBy("l_id").agg(F.min_by(F.struct("quality", "features"), F.struct("tag", "quality")).alias("one"))
    found = each.select("one.*").toPandas()  # max_rows at most
    x = np.array(found["features"].tolist(), float).reshape(-1, WIDTH)
    y = found["quality"].to_numpy()
    order = np.lexsort((*x.T[:20], y)) if len(x) else []
    return fit(x[order], y[order], cut_score=cut_score)


def _score(batches, model: Model):
    for batch in batches:
        score = model.score(_feature_rows(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= model.cut_score).astype(np.int32))], names=["doc_id", "score", "predicted"])


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _score(batches, model), "doc_id long, score double, predicted int")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return rate(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
