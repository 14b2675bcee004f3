"""SimHash near-duplicates, with pivot distance tables.

A text is lower-cased in A-Z and cut into words ``[^\\x20\\x09-\\x0D]+`` and 4-word shingles, repeats
included (fewer words: the whole sequence is one shingle).  Bit i of the fingerprint is 1 if it is set
in over half of the shingles' XXH64 values (seed 42); a text without words, or null, has fingerprint
zero, which links like any other.  Fingerprints link at ``radius`` or fewer differing bits; a class is
what links reach.

How links are found without comparing all pairs: the 64 bits are cut into ``radius + 2`` blocks, of
which two linked fingerprints share at least two entirely, so each distinct fingerprint goes once to
each pair of blocks (with over some 2**29 fingerprints, into ``radius + 3`` and to each three of them, and so on, so that
groups of unlike fingerprints stay small).  Within such a group, the distances to ``PIVOTS`` reference fingerprints are laid
out beforehand; by the triangle inequality, pairs whose distance to any reference differs by more
than the radius can't link and are discarded, and the rest are verified.  Small groups are compared
row against shifted row; larger ones are explored from member to member, which leaves a spanning
forest of their links, not all pairs.  A group over ``split`` members is dealt as pairs of parts.

Equal fingerprints are one node, so exact copies add nothing to any group.  Rows that repeat a
``doc_id`` each get a row; null ids belong to their class, and a class of null ids alone has a null
``component_id``.  Other columns are ignored; an empty table gives no rows.  A text of any length is hashed whole, one at a time, at
some 20 bytes a byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.components import components
from voxelmill.llm.shared import hot_keys, packed, partitions, released, small, spread_join, stash

RADIUS = 4
SHINGLE = 4
PIVOTS = 16
#: Members up to which a group is compared shift by shift.
SHIFTS = 8
#: Unlike fingerprints that may meet in a group.
GROUP = 256
#: Members over which a group is dealt as pairs of parts.
SPLIT = 20_000

_BIT = np.array([8 * b + 7 - i for b in range(8) for i in range(8)])  # of np.unpackbits over little-endian bytes


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, k = end - size, min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    values = [digest(joined[i:j], 42) for i, j in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())]
    half, counts = len(values), np.zeros(64, np.int64)
    hashes = np.array(values, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, half, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    bits = np.zeros(64, np.uint8)
    bits[_BIT] = counts * 2 > half
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


@released
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        made = [fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in text]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "uid", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, uid (a hash of the text), fp (the fingerprint's 64 bits as a signed long)."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("uid"), "text").mapInArrow(_fingerprints, "doc_id long, uid long, fp long")


def blocks(radius: int, shared: int = 2) -> list[int]:
    """The masks of all choices of ``shared`` of ``radius + shared`` blocks of the 64 bits: two fingerprints within the
    radius agree in one of them at least."""
    edges = [round(64 * i / (radius + shared)) for i in range(radius + shared + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [reduce(or_, some) for some in combinations(single, shared)]


def shared_blocks(nodes: int, radius: int) -> int:
    """How many blocks a key should hold for so many fingerprints: the fewest (of which there are the fewest keys) that leave
    some ``GROUP`` in a group of unlike ones."""
    return next((k for k in range(2, 6) if nodes / 2 ** (64 * k / (radius + k)) <= GROUP), 6)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: a fixed sequence of hashes."""
    return np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(count)], np.uint64)


def pivot_table(fp: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.stack([np.bitwise_count(fp ^ p) for p in reference], axis=1).astype(np.int8)


def _verified(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those that link: the pivot coordinates discard, the rest are verified."""
    for c in range(table.shape[1]):
        near = np.abs(table[i, c] - table[j, c]) <= radius
        i, j = i[near], j[near]
    linked = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return i[linked], j[linked]


def _explore(fp: np.ndarray, table: np.ndarray, side: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one group.

    With ``side`` (0 or 1 for the two parts of a split group) links across count as within.
    """
    open_ = np.argsort(table[:, 0], kind="stable")  # not reached yet, by the first coordinate
    first = table[open_, 0]
    forest = []
    while len(open_):
        queue, open_, first = [int(open_[0])], open_[1:], first[1:]
        while queue and len(open_):
            x = queue.pop()
            a, b = np.searchsorted(first, [table[x, 0] - radius, table[x, 0] + radius + 1])
            near = np.arange(a, b)
            for c in range(1, table.shape[1]):
                if len(near) < 64:
                    break
                near = near[np.abs(table[open_[near], c] - table[x, c]) <= radius]
            near = near[np.bitwise_count(fp[open_[near]] ^ fp[x]) <= radius]
            if len(near):
                found = open_[near].tolist()
                forest += [(x, y) for y in found]
                queue += found
                open_, first = np.delete(open_, near), np.delete(first, near)
    return forest


def _group_links(key: np.ndarray, fp: np.ndarray, radius: int, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal consecutive keys, as pairs of fingerprints."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edges)
    several = np.repeat(size, size) > 1
    fp, key = fp[several], key[several]
    if not len(fp):
        return fp, fp
    table = pivot_table(fp, reference)
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edges)
    rest = np.repeat(edges[1:], size) - np.arange(len(fp)) - 1  # members after this one
    rest[np.repeat(size, size) > SHIFTS] = 0
    left, right = [], []
    for d in range(1, min(SHIFTS, int(size.max()))):
        i = np.flatnonzero(rest >= d)
        i, j = _verified(fp, table, i, i + d, radius)
        left.append(fp[i])
        right.append(fp[j])
    for a, b in zip(edges[:-1][size > SHIFTS].tolist(), edges[1:][size > SHIFTS].tolist()):
        forest = np.array(_explore(fp[a:b], table[a:b], None, radius), np.int64).reshape(-1, 2)
        left.append(fp[a:b][forest[:, 0]])
        right.append(fp[a:b][forest[:, 1]])
    return np.concatenate(left or [fp[:0]]), np.concatenate(right or [fp[:0]])


@released
def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """From (key, fp) sorted by key; a group may span batches."""
    reference = pivots()
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def done(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _group_links(key, fp, radius, reference)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        held_key = np.concatenate([held_key, batch.column("key").to_numpy()])
        held_fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0  # keys are sorted
        if cut:
            yield done(held_key[:cut], held_fp[:cut])
            held_key, held_fp = held_key[cut:], held_fp[cut:]
    if len(held_key):
        yield done(held_key, held_fp)


def links(nodes: DataFrame, radius: int = RADIUS, split: int = SPLIT, shared: int | None = None) -> DataFrame:
    """From distinct ``fp``: links (a, b) whose closure equals that of all links within the radius, whatever number of blocks
    (``shared``) a key has."""
    spark = nodes.sparkSession
    masks = blocks(radius, shared or shared_blocks(nodes.count(), radius))
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    spread = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    # Groups too large for one task; there are at most keys / split of the nodes of them, often none.
    large = stash(spread.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > split), "op3-large")
    count = large.count()
    if count:
        spread = spread.join(small(large, count, 24), "key", "left")
        parts = F.ceil(F.col("members") / split).cast("int")
        mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
        other = F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)
        spread = spread.select("fp", "key", "members", mine.alias("mine"), F.explode(other).alias("other"))
        pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
        spread = spread.select("fp", F.when(F.col("members").isNull(), F.col("key")).otherwise(pair).alias("key"))
    spread = spread.repartition(partitions(spark), "key").sortWithinPartitions("key")
    return spread.mapInArrow(lambda it: _links(it, radius), "a long, b long").distinct()


def simhash_classes(docs: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """One row per input row: doc_id, uid, fp, root (the class), component_id (its least doc_id)."""
    prints = stash(fingerprints(docs), "op3-fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "op3-nodes")
    size = nodes.agg(F.count("*").alias("nodes"), F.sum("rows").alias("rows")).first()
    roots = stash(components(links(nodes.select("fp"), radius, split)).withColumnRenamed("node", "fp"), "op3-roots")
    named = stash(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "op3-named")
    # Rows of a fingerprint, and fingerprints of a class, may be a third of all.
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows"))
    wide = hot_keys(classes.select("root", "rows"), size["nodes"], "op3-hot")
    named = spread_join(named.select("fp", "root"), classes.drop("rows"), "root", wide)
    copied = hot_keys(nodes.select("fp", "rows"), size["rows"] or 0, "op3-hot")
    return spread_join(prints, named, "fp", copied).select("doc_id", "uid", "fp", "root", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: the least ``doc_id`` (null last, ties by a
    hash of the text).  Of rows that repeat both id and text, one stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("keep")
    keep = simhash_classes(docs).groupBy("root").agg(first)
    keep = keep.select(_keyed("keep.doc_id").alias("key"), F.col("keep.uid").alias("uid"))
    rows = packed(docs).withColumns({"key": _keyed("row.doc_id"), "uid": F.xxhash64("row.text")})
    return rows.join(keep, ["key", "uid"], "left_semi").dropDuplicates(["key", "uid"]).select("row.*")  # one shuffle for both


def _keyed(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
SQL: dict[str, str] = {}
