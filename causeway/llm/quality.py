"""Quality scores learnt from preferences between documents (Bradley-Terry).

A pair of labelled documents, one good and one bad, is a preference. The chance that i is
preferred to j is modelled as sigmoid(w . (x_i - x_j)), so that w is found by logistic loss on
differences of features; no intercept enters. A document counts as good if w . x lies above a
quantile of the labelled documents' scores: the share of bad ones among them.

Features are shares and means over the whole text (kinds of bytes, words, lines); the id,
language, source and label are never among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm._io import require
from causeway.llm._text import lower, slices, span_hash, sums, utf8, words

#: At most so many labelled rows are learnt from; they are those with the smallest hash of the id.
LABELLED_ROWS = 20_000
#: Preferences for each labelled row.
PAIRS_A_ROW = 8

_KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "high", "bang", "bar", "mark")
_KIND = np.full(256, _KINDS.index("mark"), np.uint8)
for _name, _bytes in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("stop", b".?:;"), ("comma", b",'\"-()"), ("high", range(128, 256)), ("bang", b"!"), ("bar", b"|")):
    _KIND[list(_bytes)] = _KINDS.index(_name)

#: Names of the features, in the order of features()' list.
FEATURES = (*(f"share_{k}" for k in _KINDS), "log_words", "word_length", "word_length_sd", "distinct_words", "marked_words", "upper_words", "long_words", "log_line_words", "distinct_lines", "marked_lines", "upper_lines", "marks_sq", "upper_sq", "bar_sq", "bang_sq", "short", "words_a_stop")


@dataclass(frozen=True)
class Ranker:
    """Weights over standardised features; the score is sigmoid(w . z - threshold)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -40, 40)))


def feature_rows(column: pa.Array) -> np.ndarray:
    """Features of each text of an Arrow column; null counts as empty."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, len(FEATURES)))
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kind = _KIND[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(row * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, -1) / size[:, None]

    mark = np.isin(kind, [_KINDS.index(k) for k in ("bang", "bar", "mark")])
    upper = kind == _KINDS.index("upper")
    small = kind == _KINDS.index("lower")

    def total(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags)])

    marks, uppers, smalls, stops = total(mark), total(upper), total(small), total(kind == _KINDS.index("stop"))
    start, end, at = words(data, offsets)
    count = np.maximum(np.diff(at), 1).astype(float)

    def mean(values: np.ndarray) -> np.ndarray:
        t = np.concatenate([[0.0], np.cumsum(values)])
        return (t[at[1:]] - t[at[:-1]]) / count

    length = (end - start).astype(float)
    average = mean(length)
    h = span_hash(sums(lower(data)), start, end)
    word_row = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((h, word_row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
    distinct = np.bincount(word_row[order][new], minlength=n) / count

    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    line_start, line_end = cuts[:-1], cuts[1:]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lines = np.maximum(np.bincount(line_row, minlength=n), 1).astype(float)
    line_size = (line_end - line_start).astype(float)
    line_hash = span_hash(sums(data), line_start, line_end)
    order = np.lexsort((line_hash, line_row))
    new = np.ones(len(order), bool)
    new[1:] = (line_hash[order][1:] != line_hash[order][:-1]) | (line_row[order][1:] != line_row[order][:-1])
    distinct_lines = np.bincount(line_row[order][new], minlength=n) / lines
    # Shares of lines weigh by size, so that many short clean lines don't hide a long bad one.
    marked = np.bincount(line_row, weights=line_size * ((marks[line_end] - marks[line_start]) > 0.08 * line_size), minlength=n) / size
    loud = np.bincount(line_row, weights=line_size * ((uppers[line_end] - uppers[line_start]) > (smalls[line_end] - smalls[line_start])), minlength=n) / size
    s = dict(zip(_KINDS, share.T, strict=True))
    columns = [
        *share.T, np.log1p(np.diff(at)), average, np.sqrt(np.maximum(mean(length**2) - average**2, 0)), distinct,
        mean((marks[end] - marks[start]) > 0), mean((uppers[end] - uppers[start]) > 1), mean(length > 14),
        np.log1p(np.diff(at) / lines), distinct_lines, marked, loud,
        np.sqrt(s["mark"]), np.sqrt(s["upper"]), np.sqrt(s["bar"]), np.sqrt(s["bang"]), (np.diff(at) < 5).astype(float),
        np.log1p(count / (1 + stops[offsets[1:]] - stops[offsets[:-1]])),
    ]
    return np.stack(columns, 1)


def features(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and the features of each text (array<double>, in the order of FEATURES)."""
    require(df, text, *carry)
    picked = df.select(*[F.col(c) for c in carry], F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            x = feature_rows(batch.column("__text"))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["__text"]).columns, values], names=[*carry, "features"])

    return picked.mapInArrow(run, picked.drop("__text").withColumn("features", F.array(F.lit(0.0))).schema)


def fit_preferences(x: np.ndarray, good: np.ndarray, pairs_a_row: int = PAIRS_A_ROW, ridge: float = 1e-2, steps: int = 25) -> Ranker:
    """Weights by Newton steps on the pairwise logistic loss, and the threshold by quantile.

    Labels of one kind only leave all weights at 0: with good ones alone, or none at all, every
    text scores 0.5 and is predicted 1; with bad ones alone every text scores nearly 0.
    """
    mean, spread = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    spread = np.where(spread > 1e-9, spread, 1.0)
    w = np.zeros(x.shape[1] if len(x) else len(FEATURES))
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Ranker(mean, spread, w, 0.0 if len(up) or not len(x) else 40.0)
    z = np.clip((x - mean) / spread, -8, 8)
    pick = np.random.default_rng(17)
    i = np.concatenate([np.repeat(up, pairs_a_row), pick.choice(up, len(down) * pairs_a_row)])
    j = np.concatenate([pick.choice(down, len(up) * pairs_a_row), np.repeat(down, pairs_a_row)])
    for _ in range(steps):
        slope, curve = ridge * w * len(i), np.eye(len(w)) * ridge * len(i)
        for at in range(0, len(i), 20_000):
            d = z[i[at : at + 20_000]] - z[j[at : at + 20_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
            slope -= d.T @ p
            curve += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = len(down)
    return Ranker(mean, spread, w, float((s[k - 1] + s[min(k, len(s) - 1)]) / 2))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for testing: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = LABELLED_ROWS) -> Ranker:
    """Learns from at most `rows` labelled documents that aren't held out.

    Null ids and labels and documents whose labels contradict each other are not learnt from.
    Only the bounded sample's features come to the driver.
    """
    require(documents, doc_id, text)
    require(labels, doc_id, label)
    clear = (
        labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label"))
        .where(F.col("__id").isNotNull() & F.col("__label").isNotNull() & ~held_out(F.col("__id")))
        .groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most"))
        .where(F.col("__label") == F.col("__most")).drop("__most")
    )
    sample = clear.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    joined = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(sample), "__id")  # at most `rows` rows of two numbers
    found = features(joined, carry=("__id", "__label")).orderBy(F.xxhash64("__id"), "__id").limit(rows).toPandas()
    if not len(found):
        return fit_preferences(np.zeros((0, len(FEATURES))), np.zeros(0, bool))
    found = found.sort_values("__id", kind="stable")
    return fit_preferences(np.stack(found["features"].to_numpy()), found["__label"].to_numpy() > 0)


def score(df: DataFrame, ranker: Ranker, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, score (double, 0 to 1) and predicted (int, 1 from 0.5 on) of every whole text.

    Null and empty texts are scored as texts without words. Rows are kept one for one; other
    columns than `carry` are left out.
    """
    require(df, text, *carry)
    picked = df.select(*[F.col(c) for c in carry], F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            p = ranker.score(feature_rows(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["__text"]).columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*carry, "score", "predicted"])

    return picked.mapInArrow(run, picked.drop("__text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
