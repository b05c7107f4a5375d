"""Toxicity by a classifier chain of linear models.

Categories are predicted in order: each model sees the words of a text and the probabilities of the categories before
it. In training those probabilities are out of fold (a document's come from models that didn't see it), so that later
models learn from predictions as they will be at scoring time. The models are logistic with an L1 penalty, which leaves
weights on the few words and word stems that tell something.

A text's features are the distinct digests of its words and of the first bytes (``STEM_BYTES``) of longer ones, over the
whole text. Training takes at most ``MAX_LABELLED`` labelled rows, those with the smallest digest of their id, and of these as many
as have ``MAX_FEATURE_BYTES`` of features together; it gathers these only. Scoring runs over all rows with weights of fixed size.

Defined results: a null or empty text has no features and gets the models' bias; rows without a label, with null labels
or without a document are not trained on; of several documents with one id the one whose features sort first is trained on; a category whose training rows are of one class gets a constant probability;
without any labelled row every probability is 0; equal texts have equal results; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.materialize import materialize
from .batches import map_rows
from .kernels import SEPARATOR, lower_utf8, mix, span_digests, words

#: Labelled rows to train on; folds; size of the feature space.
MAX_LABELLED, FOLDS, DIMENSIONS = 6000, 3, 1 << 18
#: Features to train on, four bytes each.
MAX_FEATURE_BYTES = 64 << 20
STEM_BYTES, MIN_ROWS, PENALTY, ROUNDS = (4, 6), 4, 4e-4, 200
#: A feature enters a model when its share differs between the classes by this many standard errors.
SCREEN = 3.0
_U = np.uint64
_CUT = SEPARATOR.copy()
_CUT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def features(text: str | None) -> np.ndarray:
    """The sorted distinct features of a text."""
    w = words(lower_utf8(text), _CUT)
    if not len(w.start):
        return np.zeros(0, dtype=np.int32)
    whole = span_digests(w.data, w.start, w.end)
    found = [whole % _U(DIMENSIONS)]
    for size in STEM_BYTES:
        long = w.end - w.start > size
        found.append(mix(span_digests(w.data, w.start[long], w.start[long] + size) + _U(size)) % _U(DIMENSIONS))
    return np.unique(np.concatenate(found)).astype(np.int32)


class Rows(NamedTuple):
    """Sparse binary rows."""

    at: np.ndarray
    index: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.index])])
        return total[self.at[1:]] - total[self.at[:-1]]

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=np.repeat(r, np.diff(self.at)), minlength=size)

    def take(self, keep: np.ndarray) -> Rows:
        size = np.diff(self.at)
        return Rows(np.concatenate([[0], np.cumsum(size[keep])]), self.index[np.repeat(keep, size)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Linear(NamedTuple):
    weights: np.ndarray  # of features
    chain: np.ndarray  # of the logits of earlier categories
    bias: float

    def predict(self, x: Rows, before: np.ndarray) -> np.ndarray:
        return sigmoid(x.dot(self.weights) + before @ self.chain + self.bias)


def screened(x: Rows, y: np.ndarray, size: int) -> np.ndarray:
    """The features whose shares in the two classes differ clearly."""
    n, ones = len(y), y.sum()
    hits = x.back(y, size)
    every = np.bincount(x.index, minlength=size)
    share = every / n
    z = (hits / ones - (every - hits) / (n - ones)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / ones + 1 / (n - ones)))
    return np.flatnonzero(np.abs(z) > SCREEN)


def fit(x: Rows, before: np.ndarray, y: np.ndarray, size: int) -> Linear:
    """Proximal gradient with momentum; rows of the rarer class weigh more, so both classes count alike."""
    n, k = len(y), before.shape[1]
    ones = float(y.sum())
    if not n or ones in (0.0, float(n)):
        return Linear(np.zeros(size), np.zeros(k), 20.0 if n and ones else -20.0)
    some = screened(x, y, size)
    number = np.full(size, -1, dtype=np.int64)
    number[some] = np.arange(len(some))
    owner, index = np.repeat(np.arange(n), np.diff(x.at)), number[x.index]
    owner, index = owner[index >= 0], index[index >= 0]
    x, full, size = Rows(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), index), size, len(some)
    weight = np.where(y > 0, 0.5 / ones, 0.5 / (n - ones))
    w, look = np.zeros(size + k + 1), np.zeros(size + k + 1)
    # A bound of the curvature from the largest rows and the columns' weighted sums.
    step, t = 4 / (1 + 4 * np.average(np.diff(x.at), weights=weight) ** 0.5 + float((before**2).sum(axis=1).max(initial=0.0))), 1.0
    loss = np.inf
    for _ in range(ROUNDS):
        r = (sigmoid(x.dot(look[:size]) + before @ look[size : size + k] + look[-1]) - y) * weight
        grad = np.concatenate([x.back(r, size), before.T @ r, [r.sum()]])
        new = look - step * grad
        new[:size] = np.sign(new[:size]) * np.maximum(np.abs(new[:size]) - step * PENALTY, 0)
        p = sigmoid(x.dot(new[:size]) + before @ new[size : size + k] + new[-1])
        now = -float((weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum()) + PENALTY * float(np.abs(new[:size]).sum())
        if now > loss:
            step, t, look = step / 2, 1.0, w
            continue
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t, loss = new + (t - 1) / after * (new - w), new, after, now
    weights = np.zeros(full)
    weights[some] = w[:size]
    return Linear(weights, w[size : size + k], float(w[-1]))


class Chain(NamedTuple):
    categories: tuple[str, ...]
    #: feature number of each weight, and for each category its model
    models: tuple[Linear, ...]
    used: np.ndarray
    cuts: tuple[float, ...]

    def score(self, text: str | None) -> list[float]:
        f = features(text)
        at = np.minimum(np.searchsorted(self.used, f), max(0, len(self.used) - 1))
        at = at[self.used[at] == f] if len(self.used) and len(f) else np.zeros(0, dtype=np.int64)
        out: list[float] = []
        for m in self.models:
            before = logit(np.array(out)) if out else np.zeros(0)
            out.append(float(sigmoid(m.weights[at].sum() + before @ m.chain + m.bias)))
        return out


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which F1 on out-of-fold predictions is largest."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = p[order[k]]
    rest = p[order[k + 1 :]]
    return float((low + rest[0]) / 2) if len(rest) else float(low)


def train(feats: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """Fit the chain; folds are by id, so repeated rows stay together."""
    n = len(feats)
    if not n:
        none = Linear(np.zeros(0), np.zeros(0), -20.0)
        return Chain(categories, tuple(none._replace(chain=np.zeros(k)) for k in range(len(categories))), np.zeros(0, dtype=np.int32), (0.5,) * len(categories))
    every = np.concatenate(feats)
    count = np.bincount(every, minlength=DIMENSIONS)
    used = np.flatnonzero((count >= MIN_ROWS) & (count <= 0.5 * n)).astype(np.int32)
    number = np.full(DIMENSIONS, -1, dtype=np.int64)
    number[used] = np.arange(len(used))
    size = np.array([len(f) for f in feats])
    owner = np.repeat(np.arange(n), size)
    index = number[every]
    owner, index = owner[index >= 0], index[index >= 0]
    x = Rows(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), index)
    with np.errstate(over="ignore"):
        fold = (mix(ids.astype(np.int64).view(_U)) % _U(FOLDS)).astype(int)
    before, models, cuts = np.zeros((n, 0)), [], []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        models.append(fit(x, before, y, len(used)))
        oof = np.zeros(n)
        for f in range(FOLDS):
            out = fold == f
            oof[out] = fit(x.take(~out), before[~out], y[~out], len(used)).predict(x.take(out), before[out])
        cuts.append(best_cut(oof, y))
        before = np.column_stack([before, logit(oof)])
    some = np.flatnonzero(np.any([m.weights != 0 for m in models], axis=0))
    return Chain(categories, tuple(m._replace(weights=m.weights[some]) for m in models), used[some], tuple(cuts))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED, most_bytes: int = MAX_FEATURE_BYTES) -> Chain:
    """Train on at most ``most`` labelled rows. ``categories`` maps names, in chain order, to 0/1 columns of ``labels``."""
    names = tuple(categories)
    marked = labels.select(F.col(id_col).cast("long").alias("doc"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]).where(" and ".join(["doc is not null", *[f"y{k} is not null" for k in range(len(names))]]))
    chosen = materialize(marked.withColumn("_order", F.xxhash64("doc")).orderBy("_order", *[f"y{k}" for k in range(len(names))]).limit(most).drop("_order"), "labelled")
    # At most ``most`` small rows: their size is bounded by the parameter.
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc")
    schema = T.StructType([T.StructField("doc", T.LongType()), *[T.StructField(f"y{k}", T.IntegerType()) for k in range(len(names))], T.StructField("features", T.BinaryType())])

    def run(part: pa.RecordBatch) -> dict:
        return {n: part.column(n) for n in schema.names[:-1]} | {"features": [features(t).tobytes() for t in part.column("text").to_pylist()]}

    # One document for each labelled row, so there are at most ``most``; then as many as the bound of bytes admits.
    each = map_rows(rows, run, schema).groupBy("doc", *schema.names[1:-1]).agg(F.min("features").alias("features"))
    so_far = F.sum(F.octet_length("features")).over(Window.orderBy(F.xxhash64("doc"), *schema.names))
    each = each.withColumn("_bytes", so_far).where(F.col("_bytes") <= most_bytes).drop("_bytes")
    found = sorted(((r[0], tuple(r[1:-1]), bytes(r[-1])) for r in each.collect()), key=lambda r: (r[0], r[2], r[1]))
    feats = [np.frombuffer(f, dtype=np.int32) for _, _, f in found]
    return train(feats, np.array([y for _, y, _ in found]).reshape(len(found), len(names)), np.array([i for i, _, _ in found], dtype=np.int64), names)


def classify(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """Add ``p_<category>`` and ``<category>`` (the probability reaches the category's cut) for each category."""
    added = [f"p_{c}" for c in chain.categories] + list(chain.categories)
    if taken := {a.lower() for a in added} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(taken)} exist already")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *[T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories], *[T.StructField(c, T.BooleanType()) for c in chain.categories]])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(part: pa.RecordBatch) -> dict:
        chain = shared.value
        p = [chain.score(t) for t in part.column(text_col).to_pylist()]
        out = {n: part.column(n) for n in names}
        for k, c in enumerate(chain.categories):
            out[f"p_{c}"] = [x[k] for x in p]
            out[c] = [x[k] >= chain.cuts[k] for x in p]
        return out

    return map_rows(docs, run, schema)
