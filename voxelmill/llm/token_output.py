"""Token ids in shards, with a minimal perfect hash index for keyed access.

``write_tokens`` deals documents by ranges of ``doc_id``, encodes each whole text, appends an end id
and writes shards in ascending order of ``doc_id`` (null first; documents that share an id, by a hash
of their text).  The container is Spark's own committed Parquet writer, uncompressed, so retried and speculative tasks leave no second
copy and any file system that Spark writes will do.  Each shard is a row group; a file holds up to ``FILE_SHARDS`` of them, so
the number of files follows the tasks, not the shards.

Columns of a shard: ``task`` and ``shard`` (its place in the order), ``first_key``, ``last_key``, ``docs`` and ``n_ids``
(the manifest: read without the rest), ``entry`` (the index) and ``payload`` (the raw ids, little-endian, 2 bytes each for
vocabularies of up to 65,536 entries, else 4).  The entry is a header (``_HEADER``), the documents' keys and id offsets, and
a minimal perfect hash: a displacement for each bucket of about 2 keys, and for each slot the first document
of its key with a 32-bit fingerprint, so a lookup costs one bucket, one slot and one comparison, and
a key that is not there is told by its fingerprint (and then by the key stored with the document).

``lookup`` reads only the shards whose range of keys holds a wanted one: the file reader passes over the row groups of all others by
their statistics of ``first_key`` and ``last_key``.  ``token_digests`` takes each document's offsets through the index of its shard
too, and stops if a slot or a fingerprint leads elsewhere.  Null keys are stored but can't be looked up (they are read in
order); documents that share a key lie side by side, as their keys show, also over shards.

Null and empty texts have just the end id.  An empty table gives no shards.  A text of any length is encoded in pieces; its
ids are in one shard, which is then as large as they are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelmill.llm.encoder import encoder
from voxelmill.llm.shared import new_path, partitions, released, small

END_ID = 2
#: Payload bytes, and documents, after which a shard is closed.
SHARD_BYTES, SHARD_DOCS = 4 << 20, 1 << 18
#: Bytes of text that are encoded at once.
PIECE = 2 << 20
#: Shards of a file at most.
FILE_SHARDS = 256
NULL_KEY = -(1 << 63)
_MAGIC = b"VMTOKEN1"
#: magic, id width, documents, keys, displacements, ids
_HEADER = struct.Struct("<8sqqqqq")
_SHARD = "task long, shard long, first_key long, last_key long, docs long, n_ids long, entry binary, payload binary"
_GOLDEN = 0x9E3779B97F4A7C15
#: Keys of a bucket of the index, on average, and displacements that are tried at once.
_BUCKET = 2
_TRIES = 32


def _hash(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """Hashes of keys under a seed, or under each of a column of seeds."""
    h = keys.view(np.uint64) + (np.atleast_1d(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLDEN)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct int64 keys: displacement of each bucket, key number and fingerprint of each slot.

    Buckets are placed from the largest down; each tries displacements until all its keys fall into
    free slots.  A bucket of one key stores its slot itself, as -slot - 1.
    """
    n = len(keys)
    shift = np.zeros(max(1, -(-n // _BUCKET)), np.int64)
    slots, marks = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    if not n:
        return shift, slots, marks
    bucket = (_hash(keys, 0) % np.uint64(len(shift))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(len(shift) + 1))
    sizes = np.diff(edges)
    taken = np.zeros(n, bool)
    singles = []
    for b in np.argsort(-sizes, kind="stable").tolist():
        mine = order[edges[b] : edges[b + 1]]
        if len(mine) <= 1:
            singles += [(b, mine[0])] if len(mine) else []
            continue
        d = np.arange(1, _TRIES + 1)[:, None]
        while True:
            at = (_hash(keys[mine], d) % np.uint64(n)).astype(np.int64)
            apart = np.diff(np.sort(at, axis=1), axis=1).min(axis=1) > 0
            good = np.flatnonzero(apart & ~taken[at].any(axis=1))
            if len(good):
                break
            d += _TRIES
        at = at[good[0]]
        taken[at] = True
        shift[b], slots[at] = d[good[0], 0], mine
    for (b, k), at in zip(singles, np.flatnonzero(~taken).tolist()):
        shift[b], slots[at] = -at - 1, k
    marks = (_hash(keys, 1 << 40) >> np.uint64(32)).astype(np.uint32)[slots]
    return shift, slots, marks


class Shard:
    """One shard's bytes: ``keys``, ``start`` (n + 1 offsets in ids), ``ids(i)``, ``find(keys)``."""

    def __init__(self, entry: bytes, payload: bytes = b""):
        magic, self.width, n, m, b, total = _HEADER.unpack_from(entry)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = _HEADER.size

        def part(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(entry, dtype, count, at)
            at += out.nbytes
            return out

        self.keys, self.start, self.shift = part("<i8", n), part("<i8", n + 1), part("<i8", b)
        self.slots, self.marks = part("<u4", m), part("<u4", m)
        self.payload = np.frombuffer(payload, f"<u{self.width}")
        if len(self.payload) not in (0, total):
            raise ValueError("ids of another shard")

    def ids(self, i: int) -> np.ndarray:
        return self.payload[self.start[i] : self.start[i + 1]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, or -1; constant time each."""
        if not len(self.slots):
            return np.full(len(keys), -1)
        d = self.shift[(_hash(keys, 0) % np.uint64(len(self.shift))).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, (_hash(keys, np.maximum(d, 0)) % np.uint64(len(self.slots))).astype(np.int64))
        first = self.slots[slot].astype(np.int64)
        good = ((_hash(keys, 1 << 40) >> np.uint64(32)).astype(np.uint32) == self.marks[slot]) & (self.keys[first] == keys) & (keys != NULL_KEY)
        return np.where(good, first, -1)

    def documents(self, key: int) -> list[int]:
        """All documents with this key."""
        first = int(self.find(np.array([key], np.int64))[0])
        stop = first
        while first >= 0 and stop < len(self.keys) and self.keys[stop] == key:
            stop += 1
        return list(range(first, stop)) if first >= 0 else []


def pack(width: int, keys: np.ndarray, sizes: np.ndarray) -> bytes:
    """The entry of a shard of documents in order of their keys, with these numbers of ids."""
    key, start = keys.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)] & (key != NULL_KEY))
    shift, slots, marks = build_index(key[first])
    head = _HEADER.pack(_MAGIC, width, len(key), len(first), len(shift), int(start[-1]))
    slots = first[slots].astype("<u4") if len(first) else slots
    return b"".join([head, key.astype("<i8").tobytes(), start.tobytes(), shift.astype("<i8").tobytes(), slots.tobytes(), marks.astype("<u4").tobytes()])


@released
def _shards(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, limit: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    task, number = TaskContext.get().partitionId(), 0
    names = [c.split()[0] for c in _SHARD.split(", ")]
    keys, sizes, held = [], [], []

    def shard() -> pa.RecordBatch:
        key, size = np.concatenate(keys), np.concatenate(sizes)
        row = [task, number, int(key[0]), int(key[-1]), len(key), int(size.sum()), pack(enc.width, key, size), b"".join(held)]
        for x in (keys, sizes, held):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], names=names)

    for part, made in enc.encoded(batches, "text", PIECE):
        key, n = part.column("key").to_numpy(), np.diff(made.at)
        ids = np.insert(made.ids, made.at[1:], end_id)
        at = made.at + np.arange(len(part) + 1)
        done = 0
        while done < len(part):
            room = max(1, limit - sum(map(len, held))) // enc.width
            stop = int(np.searchsorted(at, at[done] + room, "left"))
            stop = min(max(stop, done + 1), done + SHARD_DOCS, len(part))
            keys.append(key[done:stop])
            sizes.append(n[done:stop] + 1)
            held.append(ids[at[done] : at[stop]].tobytes())
            done = stop
            if sum(map(len, held)) >= limit or sum(map(len, keys)) >= SHARD_DOCS:
                yield shard()
                number += 1
    if keys:
        yield shard()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the shards of ``docs`` to a new folder."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.xxhash64("text").alias("uid"), "text")
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "key", "uid").sortWithinPartitions("key", "uid")
    shards = rows.select("key", "text").mapInArrow(lambda it: _shards(it, vocabulary, end_id, shard_bytes), _SHARD)
    layout = {"maxRecordsPerFile": FILE_SHARDS, "compression": "none", "parquet.block.row.count.limit": 1, "parquet.enable.dictionary": "false"}
    shards.write.options(**layout).parquet(path)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder; columns that are not asked for are not read."""
    return spark.read.schema(_SHARD).parquet(path)


def _columns(s: Shard, i: int, j: int) -> list[pa.Array]:
    """doc_id, offset and n_tokens of documents i to j."""
    return [pa.array(s.keys[i:j], mask=s.keys[i:j] == NULL_KEY), pa.array(s.start[i:j]), pa.array(np.diff(s.start[i : j + 1]))]


@released
def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for task, number, entry, payload in zip(*(batch.column(c) for c in ("task", "shard", "entry", "payload"))):
            s = Shard(entry.as_buffer(), payload.as_buffer())
            for i in range(0, len(s.keys), 256):
                j = min(len(s.keys), i + 256)
                ids = [s.ids(k).astype("<u4").tobytes() for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([pa.array([task.as_py()] * (j - i)), pa.array([number.as_py()] * (j - i)), *_columns(s, i, j), pa.array(ids, pa.binary())], names=["task", "shard", "doc_id", "offset", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents in the order of the shards: task, shard, doc_id, offset (in the shard), n_tokens, ids
    (little-endian unsigned 32-bit)."""
    rows = open_shards(spark, path).select("task", "shard", "entry", "payload")
    return rows.mapInArrow(_documents, "task long, shard long, doc_id long, offset long, n_tokens long, ids binary")


@released
def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key of a shard is looked up in its index; what the index leads to is returned."""
    for batch in batches:
        for task, number, entry, payload in zip(*(batch.column(c) for c in ("task", "shard", "entry", "payload"))):
            s = Shard(entry.as_buffer(), payload.as_buffer())
            n = len(s.keys)
            run = np.flatnonzero(np.concatenate([[True], s.keys[1:] != s.keys[:-1]])[:n])
            found = s.find(s.keys[run])
            found[s.keys[run] == NULL_KEY] = run[s.keys[run] == NULL_KEY]
            if (found < 0).any() or len(np.unique(found)) != len(run):
                raise ValueError("the index leads to another document")
            copies = np.diff(np.append(run, n))
            at = np.repeat(found - (np.cumsum(copies) - copies), copies) + np.arange(n)
            crc = [zlib.crc32(s.ids(i).astype("<u4")) for i in at.tolist()]
            key, start, size = s.keys[at], s.start[at], s.start[at + 1] - s.start[at]
            columns = [pa.array(np.full(n, task.as_py())), pa.array(np.full(n, number.as_py())), pa.array(key, mask=key == NULL_KEY), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["task", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"])


def fetch_digests(spark: SparkSession, path: str) -> DataFrame:
    """task, shard, doc_id, offset, n_tokens, ids_crc32 of all documents, each reached by the index of its shard."""
    rows = open_shards(spark, path).select("task", "shard", "entry", "payload")
    return rows.mapInArrow(_fetched, "task long, shard long, doc_id long, offset long, n_tokens long, ids_crc32 long")


def _found(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for entry, payload in zip(batch.column("entry"), batch.column("payload")):
            s = Shard(entry.as_buffer(), payload.as_buffer())
            hits = [(k, s.ids(i).astype("<u4").tobytes()) for k in keys for i in s.documents(k)]
            if hits:
                yield pa.RecordBatch.from_pydict({"doc_id": [h[0] for h in hits], "ids": [h[1] for h in hits]}, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))


def holding(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """The shards whose range of keys holds one of some dozens of keys."""
    wanted = [(F.col("first_key") <= k) & (F.col("last_key") >= k) for k in sorted(set(keys))]
    while len(wanted) > 1:  # a balanced tree of conditions
        wanted = [a | b for a, b in zip(wanted[::2], wanted[1::2])] + wanted[len(wanted) & ~1 :]
    return open_shards(spark, path).filter(wanted[0] if wanted else F.lit(False))


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id, ids of the documents with these keys, by the indices of the shards that can hold them."""
    return holding(spark, path, keys).select("entry", "payload").mapInArrow(lambda it: _found(it, keys), "doc_id long, ids binary")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """task, shard, before: ids of all shards before each, from the manifest: sums by task first, so no window
    is wider than a task's shards or the tasks."""
    shards = open_shards(spark, path).select("task", "shard", "n_ids")
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("n_ids"))  # a row a partition of the writer
    tasks = tasks.select("task", ahead(Window.orderBy("task")).alias("base"))
    own = shards.select("task", "shard", ahead(Window.partitionBy("task").orderBy("shard")).alias("inside"))
    return own.join(tasks, "task").select("task", "shard", (F.col("base") + F.col("inside")).alias("before"))


def token_digests(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shards, reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    starts = small(shard_starts(spark, path), open_shards(spark, path).count(), 64)
    rows = fetch_digests(spark, path).join(starts, ["task", "shard"])
    return rows.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_token_output": op2_token_output}
SQL: dict[str, str] = {}
