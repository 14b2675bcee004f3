"""Document quality by a regularised quadratic discriminant over text statistics.

Statistics of the whole text (``NAMES``) are transformed: counts by log(1 + x), shares by
arcsin(sqrt(x)).  Each class has a mean and a covariance that is shrunk twice: towards the pooled
covariance (``POOL``) and then towards a multiple of the identity (``RIDGE``), over statistics scaled
by their pooled deviation.  The score is the posterior of label 1: the difference of the two Gaussian
log-densities, whose Mahalanobis terms come from Cholesky factors computed once and sent to all
tasks, plus the log-ratio of class sizes.

Learning uses every labelled row whose crc32 of ``doc_id`` as text is not 0 modulo ``FOLDS``; sums and
products are added up by Spark, so only two means and covariances reach the driver.  A null
``doc_id`` counts as held out; null labels are passed over; a document with several labels counts for
each.  Null and empty texts have the statistics of an empty text and a score.  With no rows of a class
the score is the share of label 1 in what there is (0.5 of nothing).  Columns other than the named are ignored.  Texts are worked
on whole, a few megabytes of them at a time; a longer text is a chunk of its own, at some 20 bytes a byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.shared import released, stash
from voxelmill.llm.textops import PIECE_BYTES, Spans, Words, chunks, column_bytes, span_hashes

FOLDS = 5
POOL = 0.8
RIDGE = 0.05
THRESHOLD = 0.3
_GROUPS = {
    "digit": b"0123456789",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "stop": b".!?",
    "comma": b",;:",
    "mark": b"#$%&*@~^+=<>{}[]|\\/_`",
    "quote": b"\"'()-",
    "bang": b"!",
    "bar": b"|",
    "break": b"\n",
    "blank": b" \t\r\x0b\x0c",
    "high": bytes(range(128, 256)),
}
_COUNTS = ("bytes", "words", "lines", "longest")
_SHARES = (*_GROUPS, "unique_words", "unique_bigrams", "unique_lines", "top_word", "short_words", "long_words", "marked_words", "capital_words")
_PLAIN = ("mean_word", "spread_word", "entropy", "words_a_line")
NAMES = (*_COUNTS, *_SHARES, *_PLAIN)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a row is held out from learning; null ids are."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def _unique_share(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: number of values, of distinct values, and of the most frequent one."""
    total = np.bincount(rows, minlength=n)
    if not len(rows):
        return total, total, total
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    edge = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[edge], np.diff(np.append(edge, len(r))))
    return total, np.bincount(r[edge], minlength=n), most


def _byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each row has each byte value."""
    table = np.zeros((len(offsets) - 1, 256))
    for a in range(0, len(data), PIECE_BYTES):
        b = min(len(data), a + PIECE_BYTES)
        low, high = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b))
        row = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1].clip(a, b)))
        table[low:high] += np.bincount(row * 256 + data[a:b], minlength=(high - low) * 256).reshape(-1, 256)
    return table


def statistics(column: pa.Array) -> np.ndarray:
    """The transformed statistics of each text, a row each."""
    data, offsets = column_bytes(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    table = _byte_counts(data, offsets)
    some = np.maximum(size, 1)
    out = {name: table[:, list(group)].sum(1) / some for name, group in _GROUPS.items()}
    p = table / some[:, None]
    out["entropy"] = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    words = Words(data, offsets)
    rows, hashes = words.rows(), words.hashes()
    length = (words.end - words.start).astype(float)
    total, unique, most = _unique_share(rows, hashes, n)
    at = np.maximum(total, 1)
    pairs = np.flatnonzero(rows[1:] == rows[:-1]) if len(rows) else np.zeros(0, np.int64)
    two, two_unique, _ = _unique_share(rows[pairs], Spans(hashes, "word").hash(pairs, pairs + 2), n)
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1][size > 0], breaks + 1)
    start = start[start < len(data)]
    end = np.minimum(np.append(start[1:], len(data)), len(data))
    lines, lines_unique, _ = _unique_share(np.searchsorted(offsets, start, "right") - 1, span_hashes(data, start, end), n)
    ups = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=ups[1:])
    mark = np.zeros(256, bool)
    mark[list(_GROUPS["mark"] + b"!")] = True
    mean = np.bincount(rows, length, n) / at
    square = np.bincount(rows, length * length, n) / at
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    out |= {
        "bytes": size.astype(float), "words": total.astype(float), "lines": lines.astype(float), "longest": longest,
        "unique_words": unique / at, "unique_bigrams": two_unique / np.maximum(two, 1), "unique_lines": lines_unique / np.maximum(lines, 1), "top_word": most / at,
        "short_words": np.bincount(rows, length <= 3, n) / at, "long_words": np.bincount(rows, length >= 12, n) / at,
        "marked_words": np.bincount(rows, mark[data[words.end - 1]] if len(words) else None, n) / at,
        "capital_words": np.bincount(rows, ups[words.end] - ups[words.start] >= 2, n) / at,
        "mean_word": np.log1p(mean), "spread_word": np.log1p(np.sqrt(np.maximum(0, square - mean * mean))), "words_a_line": np.log1p(total / np.maximum(lines, 1)),
    }
    for name in _COUNTS:
        out[name] = np.log1p(out[name])
    for name in _SHARES:
        out[name] = np.arcsin(np.sqrt(np.clip(out[name], 0, 1)))
    return np.stack([out[name] for name in NAMES], axis=1)


@released
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        x = statistics(batch.column("text"))
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), lists], names=["doc_id", "held_out", "x"])


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, x (the transformed statistics)."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_vectors, "doc_id long, held_out boolean, x array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (label, x): for each label the sum of (1, x) (1, x)' as positions and values."""
    p = len(NAMES) + 1
    total = np.zeros((2, p, p))
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, p - 1)
        x = np.column_stack([np.ones(len(x)), x])
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            total[k] += x[label == k].T @ x[label == k]
    yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(2 * p * p)), "value": total.ravel()})


class Discriminant:
    """Two Gaussians with shrunk covariances: ``score(x)`` is the posterior of label 1."""

    def __init__(self, sums: np.ndarray, pool: float = POOL, ridge: float = RIDGE):
        count = sums[:, 0, 0]
        total = count.sum()
        self.share = float(count[1] / total) if total else 0.5
        self.parts = None
        if min(count) < 2:
            return
        mean = sums[:, 0, 1:] / count[:, None]
        scatter = np.stack([sums[k, 1:, 1:] - count[k] * np.outer(mean[k], mean[k]) for k in (0, 1)])
        pooled = scatter.sum(0) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        unit = np.outer(self.scale, self.scale)
        p = len(self.scale)
        self.parts = []
        for k in (0, 1):
            cov = ((1 - pool) * scatter[k] / count[k] + pool * pooled) / unit
            cov = (1 - ridge) * cov + ridge * np.trace(cov) / p * np.eye(p)
            factor = np.linalg.cholesky(cov)
            inverse = np.linalg.solve(factor, np.eye(p))  # distances are then one product
            self.parts.append((mean[k] / self.scale, inverse, float(np.log(count[k] / total) - np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        z = x / self.scale
        a, b = (const - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, const in self.parts)
        return 1 / (1 + np.exp(np.clip(a - b, -700, 700)))


def fit(features: DataFrame, labels: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """Learns from ``labels(doc_id, quality)`` of rows that are not held out."""
    rows = features.filter("not held_out").join(labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    sums = rows.select("label", "x").mapInArrow(_sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    p = len(NAMES) + 1
    total = np.zeros(2 * p * p)
    for row in sums.collect():  # 2 (p + 1)^2 numbers
        total[row["at"]] = row["value"]
    return Discriminant(total.reshape(2, p, p), pool, ridge)


@released
def _scored(batches: Iterator[pa.RecordBatch], model: Discriminant, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
        score = model.score(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    features = stash(vectors(docs), "op1-features")
    model = docs.sparkSession.sparkContext.broadcast(fit(features, labels))
    return features.mapInArrow(lambda it: _scored(it, model.value, threshold), "doc_id long, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
