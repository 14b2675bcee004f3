"""Repeated passages across documents, by super-k-mer partitioning.

A word is a maximal run outside ``[\\x20\\x09-\\x0D]``; a window is ``window`` consecutive words of
one document.  A word is removed if some window covering it has a word sequence that also starts
earlier: at a smaller document, or earlier in the same one.

Windows are dealt by their minimiser, the least hash among their ``gram``-word grams.  Consecutive
windows that share a minimiser travel as one packed string (a super-k-mer) to its bucket, where
sorting brings equal windows together; contents are compared wherever hashes agree.  Before that,
each pass over a chunk of text keeps only the first of its equal windows, so a passage that a third of
all documents share reaches its bucket once a chunk, not once a document.

A first pass counts what each slot of minimisers would hold.  There are as many slots as the bytes of all texts ask for
(``slots_of``: ``SLOT_BYTES`` each, ``SLOTS`` to ``MOST_SLOTS`` of them).  Slots are packed into
buckets of about ``BUCKET_BYTES``, so the number of buckets follows the input; a slot that is larger, as
that of a short phrase which many documents have between different neighbours, is dealt by a hash of the
whole window instead: equal windows still meet.  What can't be split is one window's own copies, one a
chunk.  With the most slots the table of them that tasks get has 64 MB; only past some 150 TB of text, where the mean slot
passes ``BUCKET_BYTES``, would all be dealt by windows, which sends more text.

Documents are ordered by ``doc_id`` (null first) and then by a hash of the text, so documents that
share an id have an order; rows that repeat id and text are one document and get the same result.
Null and empty texts have no words.  An empty table gives no rows.  Other columns are ignored.  Texts are worked on whole, a few
megabytes at a time; a longer text is a chunk of its own, at some 25 bytes a byte of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.shared import partitions, released
from voxelmill.llm.textops import Spans, Words, chunks, column_bytes, mix, repeats, sliding_min

WINDOW = 20
GRAM = 3
#: Least number of buckets of each shuffle partition; a task holds one bucket at a time.
BUCKETS = 8
#: Bytes that a bucket should take in its task, and what a window takes of them besides text.
BUCKET_BYTES = 64 << 20
_WINDOW_BYTES = 64
#: Minimisers are counted in slots, one for so many bytes of text; at least and at most so many of them.
SLOT_BYTES, SLOTS, MOST_SLOTS = 16 << 20, 1 << 16, 1 << 23
#: Bytes of a bucket's text that are hashed at a time.
_SLICE = 1 << 20
_ZSTD = pa.Codec("zstd", compression_level=6)
_NULL_KEY = -(1 << 63)
_HEAD = np.dtype([("key", "<i8"), ("uid", "<i8"), ("start", "<i4"), ("size", "<i4")])
_BLOB = "bucket int, marks binary, n long, heads binary, text binary, text_size long"
_RANGE = np.dtype([("key", "<i8"), ("uid", "<i8"), ("start", "<i4"), ("stop", "<i4")])


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers at which windows start, and the row of each."""
    rows = words.rows()
    start = np.flatnonzero(np.arange(len(words)) + window <= words.first[1:][rows]) if len(words) else np.zeros(0, np.int64)
    return start, rows[start]


def _ranges(start: np.ndarray, row: np.ndarray, marked: np.ndarray, window: int) -> list[np.ndarray]:
    """Word numbers [from, to) that the marked windows cover, one entry for each run of windows."""
    at = np.flatnonzero(marked)
    if not len(at):
        return [at, at, at]
    cut = np.flatnonzero((np.diff(start[at]) != 1) | (np.diff(row[at]) != 0))
    head, tail = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [row[head], start[head], start[tail] + window]


def _hashes(words: Words, start: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the minimiser of each window."""
    spans = Spans(words.hashes(), "word")
    number = np.arange(len(words) - gram + 1)
    return spans.hash(start, start + window), sliding_min(spans.hash(number, number + gram), window - gram + 1)[start]


def slots_of(size: int) -> int:
    """The slots for texts of so many bytes: a power of two."""
    return min(MOST_SLOTS, max(SLOTS, 1 << max(0, -(-size // SLOT_BYTES) - 1).bit_length()))


def _slot(least: np.ndarray, slots: int) -> np.ndarray:
    return (mix(least) % np.uint64(slots)).astype(np.int64)


@released
def slot_sizes(batches: Iterator[pa.RecordBatch], window: int, gram: int, slots: int = SLOTS) -> Iterator[pa.RecordBatch]:
    """From text: the bytes that each slot's different windows of a chunk take as super-k-mers, and
    window by window."""
    together, apart = np.zeros(slots), np.zeros(slots)
    for batch in chunks(batches, "text"):
        words = Words(*column_bytes(batch.column("text")))
        start, row = _windows(words, window)
        if not len(start):
            continue
        hashes, least = _hashes(words, start, window, gram)
        at = np.sort(np.unique(hashes, return_index=True)[1])
        start, row, least = start[at], row[at], least[at]
        sums = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
        size = sums[start + window] - sums[start]
        more = np.zeros(len(start), bool)
        more[1:] = (np.diff(start) == 1) & (np.diff(row) == 0) & (least[1:] == least[:-1])
        slot = _slot(least, slots)
        apart += np.bincount(slot, size + _WINDOW_BYTES, slots)
        together += np.bincount(slot, np.where(more, sums[start + window] - sums[start + window - 1], size) + _WINDOW_BYTES, slots)
    held = np.flatnonzero(apart)
    for slot in np.split(held, range(1 << 16, len(held), 1 << 16)):
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(together[slot].astype(np.int64)), pa.array(apart[slot].astype(np.int64))], names=["slot", "together", "apart"])


def deal(docs: DataFrame, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slot: its first bucket, and the number of buckets that its windows are dealt to."""
    slots = slots_of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sizes = docs.select("text").mapInArrow(lambda it: slot_sizes(it, window, gram, slots), "slot long, together long, apart long")
    sizes = sizes.groupBy("slot").agg(F.sum("together").alias("together"), F.sum("apart").alias("apart")).toArrow()  # MOST_SLOTS rows at most
    slot, together, apart = (sizes[c].to_numpy() for c in ("slot", "together", "apart"))
    hot = together > BUCKET_BYTES
    n = max(partitions(docs.sparkSession) * BUCKETS, -(-int(together[~hot].sum()) // BUCKET_BYTES))
    first, ways = (np.arange(slots) % n).astype(np.int32), np.ones(slots, np.int32)
    # The largest slot first, each to the bucket that holds least.
    held = [(0, b) for b in range(n)]
    for k in np.lexsort((slot, -together)).tolist():
        if not hot[k]:
            size, b = held[0]
            first[slot[k]] = b
            heapq.heapreplace(held, (size + int(together[k]), b))
    for k in np.flatnonzero(hot).tolist():
        first[slot[k]], ways[slot[k]] = n, -(-int(apart[k]) // BUCKET_BYTES)
        n += int(ways[slot[k]])
    return first, ways


@released
def super_kmers(batches: Iterator[pa.RecordBatch], window: int, gram: int, first_bucket: np.ndarray, ways: np.ndarray) -> Iterator[pa.RecordBatch]:
    """From (key, uid, text): for each chunk and bucket, the packed super-k-mers of windows that are
    first in their chunk; and the ranges of windows that are not."""
    for batch in chunks(batches, "text"):
        batch = pa.Table.from_batches([batch]).sort_by([("key", "ascending"), ("uid", "ascending")]).combine_chunks()
        key, uid = (batch.column(c).to_numpy() for c in ("key", "uid"))
        text = batch.column("text").combine_chunks()
        words = Words(*column_bytes(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text))
        start, row = _windows(words, window)
        if not len(start):
            continue
        packed, begin, end = words.joined()
        hashes, least = _hashes(words, start, window, gram)
        later, first = repeats(hashes, lambda i: packed[begin[start[i]] : end[start[i] + window - 1]])
        own = start - words.first[row]
        same = (key[row[later]] == key[row[first]]) & (uid[row[later]] == uid[row[first]]) & (own[later] == own[first])
        marked, sent = np.zeros(len(start), bool), np.ones(len(start), bool)
        marked[later[~same]] = True
        sent[later] = False

        r, a, b = _ranges(start, row, marked, window)
        ranges = np.zeros(len(r), _RANGE)
        ranges["key"], ranges["uid"], ranges["start"], ranges["stop"] = key[r], uid[r], a - words.first[r], b - words.first[r]

        at = np.flatnonzero(sent)
        slot = _slot(least[at], len(first_bucket))
        dealt = first_bucket[slot] + (hashes[at] % ways[slot].astype(np.uint64)).astype(np.int32)
        cut = np.flatnonzero((np.diff(start[at]) != 1) | (np.diff(row[at]) != 0) | (least[at][1:] != least[at][:-1]) | (np.diff(dealt) != 0))
        head, tail = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        bucket = dealt[np.concatenate([[0], cut + 1])]
        heads = np.zeros(len(head), _HEAD)
        heads["key"], heads["uid"], heads["start"] = key[row[head]], uid[row[head]], own[head]
        s, e = begin[start[head]], end[start[tail] + window - 1]
        heads["size"] = e - s
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
        s, e = s.tolist(), e.tolist()
        out: dict[str, list] = {"bucket": [], "marks": [], "n": [], "heads": [], "text": [], "text_size": []}
        for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            part = order[i:j]
            joined = b"".join([packed[s[x] : e[x]] for x in part.tolist()])
            out["bucket"].append(int(bucket[part[0]]))
            out["marks"].append(ranges.tobytes() if k == 0 and len(ranges) else None)
            out["n"].append(len(part))
            out["heads"].append(_ZSTD.compress(heads[part].tobytes(), asbytes=True))
            out["text"].append(_ZSTD.compress(joined, asbytes=True))
            out["text_size"].append(len(joined))
        yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("marks", pa.binary()), ("n", pa.int64()), ("heads", pa.binary()), ("text", pa.binary()), ("text_size", pa.int64())]))


def _bucket(blobs: list[tuple[bytes, int, bytes, int]], window: int) -> np.ndarray:
    """The ranges of windows of one bucket that also start earlier."""
    heads, texts = [], []
    for packed_heads, n, packed, size in blobs:
        texts.append(pa.decompress(packed, size, "zstd", asbytes=True))
        heads.append(np.frombuffer(pa.decompress(packed_heads, n * _HEAD.itemsize, "zstd", asbytes=True), _HEAD))
    head, text = np.concatenate(heads), b"".join(texts)
    del texts
    stop = np.cumsum(head["size"].astype(np.int64))
    begin = stop - head["size"]
    order = np.lexsort((head["start"], head["uid"], head["key"]))
    head, begin, stop = head[order], begin[order], stop[order]

    # Hashes of a slice of super-k-mers at a time; of each window its hash, super-k-mer, number and bytes.
    parts: list[tuple] = []
    cut = np.searchsorted(np.cumsum(stop - begin), np.arange(0, len(text), _SLICE))
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(head)]):
        if i == j:
            continue
        part = b"".join([text[a:b] for a, b in zip(begin[i:j].tolist(), stop[i:j].tolist())])
        words = Words(np.frombuffer(part, np.uint8), np.concatenate([[0], np.cumsum(stop[i:j] - begin[i:j])]))
        start, row = _windows(words, window)
        shift = begin[i:j][row] - words.offsets[row]
        hashes = Spans(words.hashes(), "word").hash(start, start + window)
        parts.append((hashes, (row + i).astype(np.int32), (start - words.first[row]).astype(np.int32), words.start[start] + shift, words.end[start + window - 1] + shift))
    hashes, row, number, a, b = (np.concatenate(x) for x in zip(*parts))
    del parts
    later, first = repeats(hashes, lambda i: text[a[i] : b[i]])
    at = number + head["start"][row]
    same = (head["key"][row[later]] == head["key"][row[first]]) & (head["uid"][row[later]] == head["uid"][row[first]]) & (at[later] == at[first])
    marked = np.zeros(len(hashes), bool)
    marked[later[~same]] = True
    r, i, j = _ranges(at, row, marked, window)
    ranges = np.zeros(len(r), _RANGE)
    ranges["key"], ranges["uid"], ranges["start"], ranges["stop"] = head["key"][r], head["uid"][r], i, j
    return ranges


def _as_batch(ranges: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ranges[c])) for c in _RANGE.names], names=list(_RANGE.names))


@released
def repeated(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """From blobs sorted by bucket: the ranges to remove, bucket by bucket."""
    now, blobs = None, []
    for batch in batches:
        bucket, n, size = (batch.column(c).to_pylist() for c in ("bucket", "n", "text_size"))
        for i in range(len(batch)):
            marks = batch.column("marks")[i]
            if marks.is_valid:
                yield _as_batch(np.frombuffer(marks.as_buffer(), _RANGE))
            if bucket[i] != now and blobs:
                yield _as_batch(_bucket(blobs, window))
                blobs = []
            now = bucket[i]
            blobs.append((batch.column("heads")[i].as_buffer(), n[i], batch.column("text")[i].as_buffer(), size[i]))
    if blobs:
        yield _as_batch(_bucket(blobs, window))


def packed_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """From (key, uid, text): the packed super-k-mers, with the bucket of each pack."""
    sent = docs.sparkSession.sparkContext.broadcast(deal(docs, window, gram))
    return docs.mapInArrow(lambda it: super_kmers(it, window, gram, *sent.value), _BLOB)


def removed_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """From (key, uid, text): key, uid, start, stop of word ranges to remove; ranges may overlap."""
    parts = partitions(docs.sparkSession)
    packed = packed_windows(docs, window, gram).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(lambda it: repeated(it, window), "key long, uid long, start int, stop int")


@released
def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_text": []}
        for text, ranges in zip(batch.column("text"), batch.column("ranges")):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            kept, at = [], 0
            for r in sorted((r["start"], r["stop"]) for r in ranges.as_py() or ()):
                if r[0] > at:
                    kept += words[at : r[0]]
                at = max(at, r[1])
            kept += words[at:]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_text"].append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words, one space apart)."""
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_KEY)).alias("key"), F.xxhash64("text").alias("uid"), "text")
    ranges = removed_ranges(docs, window, gram).groupBy("key", "uid").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    joined = docs.join(ranges, ["key", "uid"], "left")
    joined = joined.select(F.when(F.col("key") != _NULL_KEY, F.col("key")).alias("doc_id"), "text", "ranges")
    return joined.mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 19)) AS i, words FROM w WHERE len(words) >= 20),
v AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i+19], ' ') ORDER BY doc_id, i) AS k FROM x),
r AS (
  SELECT DISTINCT doc_id, i + j AS p FROM v, (SELECT unnest(generate_series(0, 19)) AS j) WHERE k > 1),
p AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
k AS (
  SELECT p.doc_id, count(r.p) AS n_removed, string_agg(p.word, ' ' ORDER BY p.p) FILTER (WHERE r.p IS NULL) AS kept
  FROM p LEFT JOIN r USING (doc_id, p) GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL = {"op5_substring_dedup": ORACLE}
