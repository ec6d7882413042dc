"""Quality classifier by co-training two views of a document.

* The content view reads the text alone: shares of hashed byte pairs and the share of distinct
  words.
* The metadata view reads what a crawler stores beside the text or can count without reading
  it: language, source, size, compressed size, and the layout (lines, their lengths, shares of
  character classes).

Each view is a logistic regression. In every round both views are trained on their own labelled
rows and score an unlabelled pool; each hands the rows it is sure of to the other view as
pseudo-labels. Both views are then calibrated (Platt scaling) on labelled rows held back from
training, and a last logistic step on the two calibrated log-odds gives the score of a document.

The models are fitted on bounded samples, the documented parameters ``MAX_LABELLED`` and
``MAX_POOL``: the rows with the smallest hash of their id, gathered to the driver as small
feature vectors. Scoring covers every document, whole texts, in one pass without a shuffle.

Defined cases: a null text counts as empty; null language, source or size have a feature of
their own; labels that are null or belong to no document are ignored; of repeated labels of an
id the smallest counts; of rows that repeat a drawn id the one that is least by text, language and source
teaches, and every row has a score of its own; with no labelled rows of both kinds nothing can be learned and every
score is 0.5, which keeps the document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrules.llm.common import fresh, slices, text_bytes

MAX_LABELLED = 6000
MAX_POOL = 6000
TEXT_BYTES = 1 << 20  # of text whose features a task counts at once
ROUNDS = 4
PER_ROUND = 400
SURE = 0.97
THRESHOLD = 0.5

PAIRS = 512
HASHED = 16
ID_SALT = 61


# ------------------------------------------------------------------ features


def content_features(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, and vocabulary features."""
    raw, at = text_bytes(texts)
    n, sizes = len(at) - 1, np.diff(at)
    doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
    code = raw.astype(np.uint32)
    pair = code.copy()
    if len(raw):
        pair[:-1] = code[:-1] * 256 + code[1:]
        last = at[1:][sizes > 0] - 1       # no pair reaches into the text that happens to follow
        pair[last] = code[last]
    bucket = ((pair * np.uint32(2654435761)) >> np.uint32(32 - 9)).astype(np.int64)
    hist = np.bincount(doc * PAIRS + bucket, minlength=n * PAIRS).reshape(n, PAIRS)
    shares = np.sqrt(hist / np.maximum(sizes, 1)[:, None])
    rest = np.empty((n, 3))
    for i, text in enumerate(texts.to_pylist()):
        words = (text or "").split()
        rest[i] = (len(set(words)) / max(1, len(words)), np.log1p(len(words)), len(words) == 0)
    return np.hstack([shares, rest]).astype(np.float32)


def _hashed(values: list, salt: int) -> np.ndarray:
    import zlib

    out = np.zeros((len(values), HASHED + 1))
    for i, v in enumerate(values):
        out[i, HASHED if v is None else zlib.crc32(f"{salt}:{v}".encode()) % HASHED] = 1
    return out


def metadata_features(texts: pa.Array, lang: list, source: list) -> np.ndarray:
    """Size, compressed size, layout shares, and hashed language and source."""
    import zlib

    raw, at = text_bytes(texts)
    n, sizes = len(at) - 1, np.diff(at).astype(float)
    doc = np.repeat(np.arange(n), np.diff(at))
    kinds = np.zeros(256, np.int64)          # 0 other, 1 lower, 2 upper, 3 digit, 4 mark, 5 blank, 6 line, 7 high
    kinds[97:123], kinds[65:91], kinds[48:58] = 1, 2, 3
    for b in b"!#$%&*+/<=>@[]^_`{|}~\\":
        kinds[b] = 4
    kinds[32], kinds[9], kinds[10], kinds[128:] = 5, 5, 6, 7
    count = np.bincount(doc * 8 + kinds[raw], minlength=n * 8).reshape(n, 8)
    lines = count[:, 6] + 1.0
    body = raw.tobytes()
    packed = np.array([len(zlib.compress(body[a:b], 1)) for a, b in zip(at[:-1], at[1:])], float)
    shape = np.column_stack([
        np.log1p(sizes), packed / (sizes + 16), np.log1p(packed), np.log1p(lines),
        np.log1p(sizes / lines), np.sqrt(count / np.maximum(sizes, 1)[:, None])])
    return np.hstack([shape, _hashed(lang, 1), _hashed(source, 2)]).astype(np.float32)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = batch.column("text")
    return (content_features(texts),
            metadata_features(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist()))


# ------------------------------------------------------------------ models


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression on standardised features, fitted by Newton steps with an L2 penalty."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 3.0, steps: int = 12) -> "Logistic":
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
        ridge[-1] = 1e-3
        for _ in range(steps):
            p = _sigmoid(z @ w)
            grad = z.T @ (p - y) + ridge * w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), grad)
            w = w - step
            if np.abs(step).max() < 1e-5:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]


@dataclass
class CoTrained:
    """Two views, the calibration of each, and the step that combines them."""

    views: list[Logistic]
    calibration: list[Logistic]
    combined: Logistic

    def score(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        odds = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibration, xs)]
        return _sigmoid(self.combined.logit(np.column_stack(odds)))


def co_train(labelled: tuple, y: np.ndarray, held: np.ndarray, pool: tuple) -> CoTrained | None:
    """``labelled`` and ``pool`` hold the two views' features; ``held`` marks the rows kept for
    calibration. None if one of the two classes has no training or calibration row."""
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    own = [(x[~held], y[~held]) for x in labelled]
    free = np.ones(len(pool[0]), bool)
    for _ in range(ROUNDS):
        models = [Logistic.fit(*t) for t in own]
        chosen = []
        for i, m in enumerate(models):
            p = _sigmoid(m.logit(pool[i])) if free.any() else np.empty(0)
            picked = []
            for value, conf in ((1.0, p), (0.0, 1 - p)):
                order = np.argsort(-conf, kind="stable")
                order = order[free[order] & (conf[order] >= SURE)][:PER_ROUND]
                picked.append((order, np.full(len(order), value)))
            chosen.append((np.concatenate([a for a, _ in picked]), np.concatenate([b for _, b in picked])))
        for i, (rows, values) in enumerate(chosen):  # what a view is sure of teaches the other one
            x, t = own[1 - i]
            own[1 - i] = (np.vstack([x, pool[1 - i][rows]]), np.concatenate([t, values]))
            free[rows] = False
    models = [Logistic.fit(*t) for t in own]
    odds = [m.logit(x[held]) for m, x in zip(models, labelled)]
    calibration = [Logistic.fit(o[:, None], y[held], 0.1) for o in odds]
    both = np.column_stack([c.logit(o[:, None]) for c, o in zip(calibration, odds)])
    return CoTrained(models, calibration, Logistic.fit(both, y[held], 0.1))


# ------------------------------------------------------------------ Spark jobs


def _inputs(docs: DataFrame) -> list:
    """The columns that the views read; a table without language or source has nulls there."""
    have = {c.lower() for c in docs.columns}
    return [F.coalesce(F.col("text"), F.lit("")).alias("text"),
            *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality",
        max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> CoTrained | None:
    """Co-train on at most ``max_labelled`` labelled rows and ``max_pool`` unlabelled ones."""
    key = F.xxhash64(F.col("id"), F.lit(ID_SALT))
    truth = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("double").alias("y")))
    known = truth.orderBy(key, "id").limit(max_labelled)
    spare = (docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
             .join(truth.select("id"), "id", "left_anti").withColumn("y", F.lit(None).cast("double"))
             .orderBy(key, "id").limit(max_pool))
    # max_labelled + max_pool ids at most: the join that picks their texts can be a broadcast
    wanted = F.broadcast(known.unionByName(spare))
    picked = (docs.select(F.col(id_col).alias("id"), *_inputs(docs)).join(wanted, "id")
              .groupBy("id", "y").agg(F.min(F.struct("text", "lang", "source")).alias("row"))
              .select("row.*", key.alias("h"), "y"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, TEXT_BYTES):
                a, b = _views(batch)
                yield pa.record_batch(
                    [batch.column("h"), batch.column("y"),
                     pa.array([r.astype("<f4").tobytes() for r in a], pa.binary()),
                     pa.array([r.astype("<f4").tobytes() for r in b], pa.binary())],
                    names=["h", "y", "a", "b"])

    rows = (picked.mapInArrow(features, "h long, y double, a binary, b binary").orderBy("h").toPandas())
    if rows.empty:
        return None
    views = [np.stack([np.frombuffer(v, "<f4") for v in rows[c]]).astype(float) for c in ("a", "b")]
    has = rows["y"].notna().to_numpy()
    held = (rows["h"].to_numpy()[has] >> 7) % 4 == 0
    return co_train(tuple(v[has] for v in views), rows["y"].to_numpy()[has], held,
                    tuple(v[~has] for v in views))


def with_scores(docs: DataFrame, model: CoTrained | None, score: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality of every row."""
    if model is None:
        return docs.withColumn(score, F.lit(0.5))
    names = ["text", "lang", "source"]
    carry = fresh(names, *[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(carry, docs.schema)]
                          + [T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, TEXT_BYTES):
                p = model.score(_views(batch))
                yield pa.record_batch([*[batch.column(c) for c in carry], pa.array(p, pa.float64())],
                                      names=[*carry, "score"])

    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, carry)], *_inputs(docs))
    return rows.mapInArrow(scored, schema).toDF(*docs.columns, score)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns unchanged."""
    (score,) = fresh(docs.columns, "score")
    return (with_scores(docs, fit(docs, labels), score).where(F.col(score) >= threshold)
            .select(*[f"`{c}`" for c in docs.columns]))
