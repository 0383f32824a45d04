"""Toxicity: a classifier chain. Category 1 is predicted from the text, category 2 from the text and the probability
of category 1, and so on; each later linear model is trained with the out-of-fold probabilities of the earlier ones.

Categories, in chain order: ``variant_1`` and ``variant_2``, the two kinds of toxic document that the labelled rows
themselves fall into, and ``toxic`` (the human label). The kinds are found by language-free clustering: of the features
that tell toxic rows apart, the main direction in which the toxic training rows differ splits them in two, for each fold
without its own rows. A document is
rejected if its ``toxic`` probability reaches the threshold, which is set on the out-of-fold probabilities of the
training rows.

Features are the distinct words of the whole text (A-Z and the lower-case forms of other letters; bytes of non-ASCII
characters count as letters) and their prefixes of 4 to 6 bytes, hashed to 2^20 buckets; each linear model keeps the
buckets that tell its classes apart best. Fitting uses a bounded sample of ``sample`` labelled documents (default
6,000), one row for each id; scores cover every document.

Defined edge cases: a null or empty text has no features and gets the prior; a very long text is scored whole, by its
distinct words; with no labels, or one class only, all probabilities are the smoothed prior and nothing is rejected (the
threshold is then 1.0 and probabilities lie below it); of rows that share a labelled id, the smallest text is learnt
from; equal labels and scores are no special case, as nothing is ranked; an empty table gives no rows; repeated rows and
rows without an id are scored each; other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmill.llm.common import bounded_sample, mix, per_text, slices, texts

CATEGORIES = ("variant_1", "variant_2", "toxic")
BUCKETS = 1 << 20
_LETTERS = bytes(c if chr(c).isascii() and chr(c).isalpha() or c >= 128 else 32 for c in range(256))


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _SPREAD)
_POWER = np.cumprod(np.full(64, _SPREAD))


def buckets(found: list[bytes]) -> np.ndarray:
    """The feature buckets of words, four columns: the word itself and its prefixes of 4, 5 and 6 bytes (-1: too short)."""
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    data = np.frombuffer(b"".join(found) + bytes(6), dtype=np.uint8)
    first = np.cumsum(size) - size
    out = np.full((len(found), 4), -1, dtype=np.int64)
    if not len(found):
        return out
    body = data[:-6]
    place = np.minimum(np.arange(len(body)) - np.repeat(first, size), 63)
    out[:, 0] = mix(np.add.reduceat(_BYTE[body] * _POWER[place], first)) >> np.uint64(44)
    head = np.zeros(len(found), dtype=np.uint64)
    for n in range(6):
        head |= data[first + n].astype(np.uint64) << np.uint64(8 * n)
        if n >= 3:
            long = size > n
            out[long, n - 2] = mix((head[long] + np.uint64(n + 1)) * _SPREAD) >> np.uint64(44)
    return out


def words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


@dataclass
class Linear:
    """A logistic model over a few hashed buckets and the earlier categories' log-odds."""

    bucket: np.ndarray
    weight: np.ndarray
    chain: np.ndarray
    bias: float


@dataclass
class Chain:
    models: list[Linear]
    threshold: float
    out_of_fold: dict[str, float]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _telling(start: np.ndarray, flat: np.ndarray, y: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (ascending) that tell two classes apart best, and how far each is from chance, in deviations."""
    n, n1 = len(y), float(y.sum())
    c = np.bincount(flat, minlength=BUCKETS).astype(np.float64)
    c1 = np.bincount(flat, weights=np.repeat(y, np.diff(start)), minlength=BUCKETS)
    expected = c * (n1 / n)
    z = np.where(c >= 3, (c1 - expected) / np.sqrt(expected * (1 - n1 / n) * np.maximum(1 - c / n, 1e-3) + 1), 0)
    best = np.argsort(-np.abs(z), kind="stable")[:keep]
    best = np.sort(best[np.abs(z[best]) > 2.0])
    return best, z[best]


def _within(start: np.ndarray, flat: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each occurrence of the buckets ``best``, in row order."""
    place = np.full(BUCKETS, -1)
    place[best] = np.arange(len(best))
    at = place[flat]
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    return row[at >= 0], at[at >= 0]


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of values in ascending groups."""
    out = np.zeros(n)
    if len(values):
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[begin]] = np.add.reduceat(values, begin)
    return out


def fit_linear(start: np.ndarray, flat: np.ndarray, y: np.ndarray, earlier: np.ndarray, keep: int = 2000, steps: int = 80) -> Linear:
    """Logistic regression on rows given as bucket lists (``flat`` cut at ``start``): screening, then Adam on all rows."""
    n, n1 = len(y), float(y.sum())
    prior = float(np.log((n1 + 0.5) / (n - n1 + 0.5))) if n else -4.0
    if n == 0 or n1 in (0.0, float(n)):
        return Linear(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(earlier.shape[1]), prior)
    best, _ = _telling(start, flat, y, keep)
    row, at = _within(start, flat, best)
    by_column = np.argsort(at, kind="stable")
    row_there, column = row[by_column], at[by_column]
    theta = np.zeros(len(best) + earlier.shape[1] + 1)
    theta[-1] = prior
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(best)
    balance = np.where(y == 1, 0.5 * n / n1, 0.5 * n / (n - n1)) ** 0.5
    for t in range(1, steps + 1):
        s = _sums(theta[at], row, n) + earlier @ theta[k:-1] + theta[-1]
        r = balance * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y)
        g = np.concatenate([_sums(r[row_there], column, k), earlier.T @ r, [r.sum()]]) / n + np.append(2e-4 * theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Linear(best, theta[:k], theta[k:-1], float(theta[-1]))


def variants(start: np.ndarray, flat: np.ndarray, toxic: np.ndarray, keep: int = 400) -> np.ndarray:
    """Two columns of labels that split the toxic rows along the main direction in which they differ."""
    out = np.zeros((len(toxic), 2))
    mine = np.flatnonzero(toxic == 1)
    if len(mine) < 4 or len(mine) == len(toxic):
        return out
    best, z = _telling(start, flat, toxic, keep)
    best = best[z > 0]
    row, at = _within(*_take(start, flat, mine), best)
    x = np.zeros((len(mine), max(1, len(best))))
    x[row, at] = 1.0
    x /= np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1.0)
    x -= x.mean(0)
    v = np.arange(1.0, x.shape[1] + 1)
    for _ in range(50):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    v *= np.sign(v[np.abs(v).argmax()]) or 1.0
    side = x @ v > 0
    out[mine[side], 0] = 1.0
    out[mine[~side], 1] = 1.0
    return out


def predict_linear(model: Linear, start: np.ndarray, flat: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    n = len(start) - 1
    weight = np.zeros(BUCKETS)
    weight[model.bucket] = model.weight
    s = np.bincount(np.repeat(np.arange(n), np.diff(start)), weights=weight[flat], minlength=n) + earlier @ model.chain + model.bias
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _take(start: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(start)[rows]
    out = np.concatenate([[0], np.cumsum(size)])
    return out, flat[np.repeat(start[rows] - out[:-1], size) + np.arange(out[-1])]


def fit_chain(start: np.ndarray, flat: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = 3, labels: Callable[[np.ndarray], np.ndarray] | None = None) -> Chain:
    """Fit the chain; ``y`` has a column for each category. The out-of-fold probabilities feed the next category.

    ``labels`` gives the columns of ``y`` as the rows of the other folds alone would set them, where a category is itself found in
    the data: a fold's probabilities then come from labels that have not seen it.
    """
    n = len(y)
    inside_of = {f: np.flatnonzero(fold != f) for f in range(folds)}
    seen = {f: labels(rows) if labels else y[rows] for f, rows in inside_of.items()}
    models, earlier, measured = [], np.zeros((n, 0)), {}
    oof = np.zeros(n)
    for j, name in enumerate(CATEGORIES):
        oof = np.zeros(n)
        for f in range(folds):
            inside, outside = inside_of[f], np.flatnonzero(fold == f)
            part = fit_linear(*_take(start, flat, inside), seen[f][:, j], earlier[inside])
            oof[outside] = predict_linear(part, *_take(start, flat, outside), earlier[outside])
        models.append(fit_linear(start, flat, y[:, j], earlier))
        measured[name] = float(((oof >= 0.5) == (y[:, j] == 1)).mean()) if n else 0.0
        earlier = np.column_stack([earlier, _logit(oof)])
    if n == 0 or y[:, -1].min() == y[:, -1].max():
        return Chain(models, 1.0, measured)
    grid = np.linspace(0.05, 0.95, 91)
    hit = np.array([((oof >= t) & (y[:, -1] == 1)).sum() for t in grid])
    all_ = np.array([(oof >= t).sum() for t in grid])
    f1 = 2 * hit / np.maximum(all_ + y[:, -1].sum(), 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return Chain(models, float(grid[best[len(best) // 2]]), measured)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> Chain:
    """Fit on a bounded sample of the labelled documents; folds follow a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    chosen = bounded_sample(known, "doc_id", sample)

    def features(batch) -> dict:
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": [np.unique(b[b >= 0]) for t in batch.column("text").to_pylist() for b in [buckets(sorted(words(t)))]]}

    learnt = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = per_text(learnt.select("doc_id", "text", "y"), features, "doc_id long, y int, x array<int>").toArrow().combine_chunks().sort_by("doc_id")
    size = np.array([len(v) for v in rows.column("x")], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(size) else np.zeros(0, dtype=np.int64)
    toxic = rows.column("y").to_numpy().astype(np.float64)
    y = np.column_stack([variants(start, flat, toxic), toxic])

    def labels(rows: np.ndarray) -> np.ndarray:
        kinds = variants(*_take(start, flat, rows), toxic[rows])
        same = (kinds == y[rows, :2]).all(1)[toxic[rows] == 1]
        return np.column_stack([kinds if not len(same) or same.mean() >= 0.5 else kinds[:, ::-1], toxic[rows]])  # which kind is called the first is no label

    fold = np.array([zlib.crc32(str(i).encode()) // 5 % 3 for i in rows.column("doc_id").to_pylist()], dtype=np.int64)
    return fit_chain(start, flat, y, fold, labels=labels)


class _Scorer:
    """Looks each word up once: only words with a kept bucket in any model contribute."""

    def __init__(self, chain: Chain, most: int = 500_000):
        self.chain, self.most = chain, most
        self.kept = np.zeros(BUCKETS, dtype=bool)
        self.weights = []
        for m in chain.models:
            self.kept[m.bucket] = True
            weight = np.zeros(BUCKETS)
            weight[m.bucket] = m.weight
            self.weights.append(weight)
        self.known: set[bytes] = set()
        self.telling: set[bytes] = set()
        self.hits: dict[bytes, list[int]] = {}

    def scores(self, texts_: list[str | None]) -> np.ndarray:
        """One row of chain probabilities for each text."""
        found = [words(t) for t in texts_]
        if len(self.known) > self.most:
            self.known, self.telling, self.hits = set(), set(), {}
        fresh = list(set().union(*found) - self.known)
        b = buckets(fresh)
        ok = self.kept[b] & (b >= 0)
        for i in np.flatnonzero(ok.any(axis=1)).tolist():
            self.hits[fresh[i]] = b[i][ok[i]].tolist()
            self.telling.add(fresh[i])
        self.known.update(fresh)
        mine = [sorted({k for w in f & self.telling for k in self.hits[w]}) for f in found]
        row = np.repeat(np.arange(len(mine)), [len(m) for m in mine])
        flat = np.array([k for m in mine for k in m], dtype=np.int64)
        out = np.zeros((len(mine), len(self.chain.models)))
        earlier = np.zeros((len(mine), 0))
        for j, (model, weight) in enumerate(zip(self.chain.models, self.weights, strict=True)):
            s = _sums(weight[flat], row, len(mine)) + earlier @ model.chain + model.bias
            out[:, j] = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
            earlier = np.column_stack([earlier, _logit(out[:, j])])
        return out

    def score(self, text: str | None) -> list[float]:
        return self.scores([text])[0].tolist()


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id, p_variant_1, p_variant_2, p_toxic, rejected`` of every row."""
    names = [f"p_{c}" for c in CATEGORIES]
    state: dict[str, _Scorer] = {}

    def run(batch) -> dict:
        scorer = state.setdefault("s", _Scorer(chain))
        p = scorer.scores(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), **{n: p[:, i] for i, n in enumerate(names)}, "rejected": p[:, -1] >= chain.threshold}

    return per_text(texts(docs), run, ", ".join(["doc_id long", *(f"{n} double" for n in names), "rejected boolean"]))


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that the chain doesn't reject, with the columns they came with; one pass, no shuffle."""
    state: dict[str, _Scorer] = {}

    def run(batches):
        scorer = state.setdefault("s", _Scorer(chain))
        for batch in slices(batches):
            yield batch.filter(pa.array(scorer.scores(batch.column("text").to_pylist())[:, -1] < chain.threshold))

    return docs.mapInArrow(run, docs.schema)

