"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat numpy arrays.

Labels are joined by ``doc_id``; rows whose ``crc32(doc_id as text) mod 5`` is 0 are held out of training. Training
uses a bounded sample of ``sample`` labelled rows (default 20,000); the scores cover every document and whole texts.

Defined edge cases: a null text counts as empty; an empty text gets the score of its (all-zero) statistics; a null
``doc_id`` is scored and counts as not held out; a very long text is measured whole; repeated rows are scored each, and
of rows that share a labelled id the smallest text is learnt from; ties need no rule, as nothing is ranked; an empty
table gives no rows; with no usable label every score is the smoothed prior. Columns other than id and text never enter
the plan.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmill.llm import gbdt
from weftmill.llm.common import bounded_sample, per_text, texts

FEATURES = (
    "log_bytes log_words mean_word letters upper digits spaces controls symbols high_bytes punctuation pipes repeated_symbol "
    "exclaims at_signs upper_words symbol_words long_words short_words digit_words distinct_words top_word lines mean_line "
    "repeated_lines longest_line sentence_ends commas entropy run_share"
).split()

_CLASS = np.zeros((256, 10))
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = [
        _s.isascii() and _s.isalpha(), _s.isascii() and _s.isupper(), _s.isascii() and _s.isdigit(), _c == 32, _c < 32, _c in b"#$%&*+<=>@[]^_{}~\\/",
        _c >= 128, _c in b".,;:?'\"()-", _c == ord("|"), _c == ord("!"),
    ]

_GAP = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8)).astype(np.int8)
_UPPER, _DIGIT = _CLASS[:, 1].astype(np.int32), _CLASS[:, 2].astype(np.int32)
_LOWER = ((np.arange(256) >= 97) & (np.arange(256) < 123)).astype(np.int32)
_REPEAT = np.isin(np.arange(256), np.frombuffer(b"#$%&*+=@^~!", dtype=np.uint8))
_TAIL = np.array([c < 128 and not chr(c).isalnum() and chr(c) not in ".,;:?" for c in range(256)], dtype=np.int32)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``; zeros for a null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    share = counts @ _CLASS / n
    words = raw.split()
    w = max(1, len(words))
    edge = np.flatnonzero(np.diff(_GAP[data], prepend=1, append=1))  # starts and ends of words by turns
    start, end = edge[::2], edge[1::2]
    size = end - start if len(start) else np.zeros(1, dtype=np.int64)
    first, last = data[start], data[end - 1]
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int32)])
    lower = np.concatenate([[0], np.cumsum(_LOWER[data], dtype=np.int32)])
    shouted = int(((upper[end] > upper[start]) & (lower[end] == lower[start])).sum())
    freq = Counter(words)
    lines = raw.split(b"\n")
    same = data[1:] == data[:-1]
    p = counts[counts > 0] / n
    symbol = int((_REPEAT[data[1:]] & same).sum())
    return [
        np.log1p(n), np.log1p(len(words)), float(size.mean()), *(float(share[i]) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8)), symbol / n, float(share[9]),
        counts[64] / w, shouted / w, int(_TAIL[last].sum()) / w, float((size > 14).mean()), float((size < 3).mean()), int(_DIGIT[first].sum()) / w,
        len(freq) / w, max(freq.values(), default=0) / w, np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), max(map(len, lines)) / n,
        float(counts[46] + counts[63] + counts[33]) / w, float(counts[44]) / w, float(-(p * np.log2(p)).sum()), float(same.sum()) / n,
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray([statistics(t) for t in column.to_pylist()], dtype=np.float64).reshape(len(column), len(FEATURES))


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = 20_000, **params) -> gbdt.Trees:
    """Fit on a bounded sample of the labelled rows outside the held-out fold (a repeated label counts once, its maximum)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("y"))
    chosen = bounded_sample(known.where(~held_out()), "doc_id", sample)
    rows = per_text(
        texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")),
        lambda b: {"y": b.column("y"), "x": _matrix(b.column("text")).tolist()},
        "y int, x array<double>",
    ).toArrow()
    x = np.asarray(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return gbdt.fit(x, rows.column("y").to_numpy(), **params)


def score(docs: DataFrame, model: gbdt.Trees) -> DataFrame:
    """``doc_id, score`` (probability that the label is 1) of every row."""
    return per_text(texts(docs), lambda b: {"doc_id": b.column("doc_id"), "score": model.probability(_matrix(b.column("text")))}, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels, sample=sample)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


__all__ = ["FEATURES", "statistics", "held_out", "train", "score", "classify"]
