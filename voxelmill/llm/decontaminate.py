"""Benchmark passages in documents: SimHash over item-sized windows, verified by weighted shingles.

Texts are lower-cased, ASCII punctuation is deleted, and words are cut at ``[\\x20\\x09-\\x0D]``.
Shingles are ``SHINGLE`` words (a shorter item is one shingle).  A shingle weighs
log(1 + items / items that have it), so common phrases of the benchmark count less; a shingle that no
item has weighs as one that a single item has.

For each item, every window of a document with the item's number of words that shares a shingle with
it is a candidate (a window that shares none has similarity 0).  Windows are fingerprinted by the
weighted signs of their shingles' hash bits.  Multi-index blocks find the items near a window: 64 bits
in 8 blocks, of which one at least differs in ``RADIUS // 8`` bits or fewer if the whole differs in
``RADIUS`` or fewer, so each block's table tells what is within that of each value and no
fingerprint in the radius is missed.  Since 3 of 8 bits may differ, the blocks let nearly all pairs through; what prunes is the
shared shingle before them and the radius after.  Candidates within the radius are then verified: the sum of
least weights over the sum of greatest weights of the two bags of shingles must be ``SIMILARITY`` or
more.  A document with fewer words than an item is one window.

The benchmark is the stated query set: it goes to all tasks in blocks of ``ITEMS`` items, so its size
there is bounded, and each block meets every document.  Weights count the items of all blocks: with
more than one, Spark counts the items and their shingles once, and what two items or more share goes
to each task (about 50 bytes a shared shingle), since windows hold shingles of other blocks too; any
other shingle weighs as one that a single item has.  Null and empty texts match nothing, nor do null
or empty items; repeated rows each get their result.  Columns other than the named are ignored.  Texts are worked on whole, a few
megabytes at a time; a longer text is a chunk of its own, at some 15 bytes a byte of it, while windows and pairs of one are in
hand in bounded pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.shared import released
from voxelmill.llm.textops import Spans, Words, chunks, column_bytes

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits up to which a window is verified; two bags at similarity 0.8 differ in 10 +- 3.
RADIUS = 24
#: Items that are sent to the tasks at once.
ITEMS = 5000
#: Pairs of window and item, and shingles of a document, that are in hand at once.
PAIRS, SPAN = 1 << 18, 1 << 14
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_OUT = "doc_id long, uid long, matches array<struct<item_id:long,start:int,words:int,similarity:double>>"


def plain_words(column: pa.Array) -> Words:
    """Words of a string column, lower-cased and without ASCII punctuation."""
    data, offsets = column_bytes(pc.utf8_lower(column))
    keep = ~_PUNCTUATION[data]
    return Words(data[keep], offsets - np.searchsorted(np.flatnonzero(~keep), offsets))


def _near() -> np.ndarray:
    """For each pair of byte values, whether they differ in RADIUS // 8 bits or fewer."""
    values = np.arange(256, dtype=np.uint8)
    return np.bitwise_count(values[:, None] ^ values[None, :]) <= RADIUS // 8


class Shared:
    """The number of items of the whole benchmark, and the shingles that two of them or more have: their
    hashes in rising order, texts and numbers of items."""

    def __init__(self, items: int, hashes: np.ndarray, texts: pa.Array, having: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.items, self.hash, self.text, self.having = items, hashes[order], texts.take(pa.array(order)), having[order]

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are here, and the first place of each of these."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == hashes)
        return hit, at[hit]

    def count(self, text: bytes, at: int) -> int:
        """Items that have the shingle, whose hash stands at this place first."""
        h = self.hash[at]
        while at < len(self.hash) and self.hash[at] == h:
            if self.text[at].as_py() == text:
                return int(self.having[at])
            at += 1
        return 1


class Items:
    """A block of the benchmark, ready for matching.  ``shared`` is of the whole benchmark; without it the
    block is the whole."""

    def __init__(self, ids: list[int], texts: list[str], shared: Shared | None = None):
        words = plain_words(pa.array(texts, pa.string()))
        joined, begin, end = words.joined()
        hashes = words.hashes()
        self.ids, self.size, self.texts, self.bag, self.hash = [], [], [], [], []
        for k, i in enumerate(ids):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if b > a:
                self.ids.append(i)
                self.size.append(b - a)
                n = min(SHINGLE, b - a)
                self.texts.append([joined[begin[x] : end[x + n - 1]] for x in range(a, b - n + 1)])
                self.bag.append(Counter(self.texts[-1]))
                at = np.arange(a, b - n + 1)
                self.hash.append(Spans(hashes[a:b], "word").hash(at - a, at - a + n))
        self.shared = shared
        self.items = len(self.ids) if shared is None else shared.items
        self.alone = float(np.log(1 + self.items))
        if shared is None:
            having = Counter(s for bag in self.bag for s in bag)
            self.weight = {s: float(np.log(1 + self.items / c)) for s, c in having.items()}
        else:
            self.weight = {s: self.alone for bag in self.bag for s in bag}
            for own, hashed in zip(self.texts, self.hash):
                self.weight |= self.common(own, hashed)
        # For each number of words a shingle has: the hashes, and the items that have each.
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(SHINGLE, n) for n in self.size}):
            pairs = sorted({(int(v), k) for k, n in enumerate(self.size) if min(SHINGLE, n) == size for v in self.hash[k]})
            values = np.array([p[0] for p in pairs], np.uint64)
            unique, first = np.unique(values, return_index=True)
            self.index[size] = (unique, np.append(first, len(pairs)), np.array([p[1] for p in pairs]))
        self.print_ = np.array([self.fingerprints(h, np.array([0]), len(h))[0] for h in self.hash], np.uint64)
        self.near = _near()

    def common(self, texts: list[bytes], hashes: np.ndarray) -> dict[bytes, float]:
        """Weights of those of the shingles that two items of the whole benchmark or more have."""
        hit, at = self.shared.found(hashes)
        return {texts[i]: float(np.log(1 + self.items / self.shared.count(texts[i], p))) for i, p in zip(hit.tolist(), at.tolist())}

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """Weights by shingle hash, for fingerprints."""
        out = np.full(len(hashes), self.alone)
        if self.shared is not None:
            hit, at = self.shared.found(hashes)
            out[hit] = np.log(1 + self.items / self.shared.having[at])
            return out
        for unique, first, _ in self.index.values():
            if len(unique):
                at = np.minimum(np.searchsorted(unique, hashes), len(unique) - 1)
                hit = unique[at] == hashes
                out[hit] = np.log(1 + self.items / np.diff(first)[at[hit]])
        return out

    def fingerprints(self, hashes: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
        """SimHash of the ``count`` shingles from each start on (rising), some ``SPAN`` of shingles at a time."""
        out = np.zeros(len(start), np.uint64)
        done = 0
        while done < len(start):
            a = int(start[done])
            stop = max(done + 1, int(np.searchsorted(start, a + SPAN)))
            b = int(start[stop - 1]) + count
            own = hashes[a:b]
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1
            sums = np.zeros((len(own) + 1, 64))
            np.cumsum(bits * self.weights(own)[:, None], axis=0, out=sums[1:])
            at = start[done:stop] - a
            out[done:stop] = np.packbits(sums[at + count] - sums[at] > 1e-9, axis=1, bitorder="little").view(np.uint64).ravel()
            done = stop
        return out

    def similarity(self, item: int, bag: Counter, weight: dict[bytes, float]) -> float:
        own = self.bag[item]
        least = sum(min(c, bag[s]) * weight[s] for s, c in own.items() if s in bag)
        most = sum(c * weight[s] for s, c in own.items()) + sum(c * weight.get(s, self.alone) for s, c in bag.items()) - least
        return least / most if most else 0.0

    def candidates(self, n: int, items: list[int], found: dict[int, list[int]], words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, start) of the windows of n words that share a shingle with an item of that size, in order of the
        start, some ``PAIRS`` at a time."""
        spread, last = np.arange(n - min(SHINGLE, n) + 1), max(0, words - n)
        at = [np.array(found[i]) for i in items]
        low, step = 0, max(1, PAIRS // (len(items) * len(spread)))
        edges = np.unique(np.concatenate(at))
        while low <= last:
            # Starts [low, high) that hold about PAIRS pairs, by the shingles that are found from low on.
            ahead = edges[np.searchsorted(edges, low) :]
            high = last + 1 if len(ahead) <= step else max(low + 1, int(ahead[step]) - len(spread) + 1)
            pairs = []
            for i, own in zip(items, at):
                near = own[np.searchsorted(own, low) : np.searchsorted(own, high + len(spread))]
                start = np.unique((near[:, None] - spread[None, :]).clip(0, last))
                start = start[(start >= low) & (start < high)]
                pairs.append((np.full(len(start), i), start))
            item, start = (np.concatenate(x) for x in zip(*pairs))
            if len(item):
                order = np.argsort(start, kind="stable")
                yield item[order], start[order]
            low = high

    def within(self, item: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Which windows are within the radius of their item: the blocks' tables first, then the whole."""
        block, own = prints.view(np.uint8).reshape(-1, 8), self.print_[item].view(np.uint8).reshape(-1, 8)
        at = np.flatnonzero(self.near[own, block].any(axis=1))
        out = np.zeros(len(item), bool)
        out[at] = np.bitwise_count(prints[at] ^ self.print_[item[at]]) <= RADIUS
        return out

    def matches(self, hashes: np.ndarray, found: dict[int, list[int]], text) -> list[tuple[int, int, int, float]]:
        """Of one document with these word hashes: (item, start, words, similarity), the best window of
        each item.  ``found``: for items that share a shingle, where it starts.  ``text(a, b)``: words a
        to b, joined."""
        out: dict[int, tuple[float, int, int]] = {}
        sizes: dict[int, list[int]] = {}
        for item in found:
            sizes.setdefault(self.size[item], []).append(item)
        for n, items in sizes.items():
            words, k = min(n, len(hashes)), min(SHINGLE, n)
            if words < k:
                continue
            number = np.arange(len(hashes) - k + 1)
            values = Spans(hashes, "word").hash(number, number + k)
            for item, start in self.candidates(n, items, found, len(hashes)):
                unique, back = np.unique(start, return_inverse=True)
                prints = self.fingerprints(values, unique, words - k + 1)[back]
                close = self.within(item, prints)
                w, i = start[close], item[close]
                for s in np.unique(w).tolist():
                    shingles = [text(j, j + k) for j in range(s, s + words - k + 1)]
                    bag = Counter(shingles)
                    # Shingles of other blocks have their weights too.
                    weight = self.weight if self.shared is None else self.common(shingles, values[s : s + len(shingles)]) | self.weight
                    for one in i[w == s].tolist():
                        value = self.similarity(one, bag, weight)
                        if value >= SIMILARITY - 1e-12 and (one not in out or (-value, s) < (-out[one][0], out[one][1])):
                            out[one] = (value, s, words)
        return sorted((self.ids[k], s, w, v) for k, (v, s, w) in out.items())


def found_in(column: pa.Array, items: Items) -> list[list[tuple[int, int, int, float]]]:
    """The matches of each text."""
    words = plain_words(column)
    hashes = words.hashes()
    spans = Spans(hashes, "word")
    row_of = words.rows()
    found: dict[int, dict[int, list[int]]] = {}
    for k, (unique, first, item) in items.index.items():
        at = np.flatnonzero(np.arange(len(words)) + k <= words.first[1:][row_of]) if len(words) else np.zeros(0, np.int64)
        value = spans.hash(at, at + k)
        place = np.minimum(np.searchsorted(unique, value), len(unique) - 1)
        hit = np.flatnonzero(unique[place] == value)
        for x, p in zip(at[hit].tolist(), place[hit].tolist()):
            own = found.setdefault(int(row_of[x]), {})
            for i in item[first[p] : first[p + 1]].tolist():
                own.setdefault(i, []).append(x - int(words.first[row_of[x]]))
    out: list[list] = [[] for _ in range(len(column))]
    for row, own in found.items():
        a, b = int(words.first[row]), int(words.first[row + 1])
        part = [words.data[i:j].tobytes() for i, j in zip(words.start[a:b].tolist(), words.end[a:b].tolist())]
        out[row] = items.matches(hashes[a:b], own, lambda i, j, part=part: b" ".join(part[i:j]))
    return out


@released
def _match(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("similarity", pa.float64())]))
    for batch in chunks(batches, "text"):
        lists = [[dict(zip(("item_id", "start", "words", "similarity"), m)) for m in row] for row in found_in(batch.column("text"), items)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(lists, kind)], names=["doc_id", "uid", "matches"])


@released
def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash and text of each item's different shingles; a null one for each item that has words."""
    for batch in chunks(batches, "text"):
        items = Items(list(range(len(batch))), batch.column("text").to_pylist())
        hashes, shingles = [None] * len(items.ids), [None] * len(items.ids)
        for texts, values in zip(items.texts, items.hash):
            own = dict(zip(texts, values.view(np.int64).tolist()))
            shingles += own.keys()
            hashes += own.values()
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(shingles, pa.binary())], names=["hash", "shingle"])


def shared_shingles(items: DataFrame) -> Shared:
    """Counted by Spark over all items; of the shingles, only those that two of them have come to the driver."""
    counts = items.select("text").mapInArrow(_shingles, "hash long, shingle binary").groupBy("hash", "shingle").agg(F.count("*").alias("having"))
    found = counts.filter("shingle is null or having > 1").toArrow()
    none = pc.is_null(found["shingle"])
    number = pc.sum(found.filter(none)["having"]).as_py() or 0
    found = found.filter(pc.invert(none))
    texts = found["shingle"].cast(pa.large_binary()).combine_chunks()
    return Shared(number, found["hash"].to_numpy().view(np.uint64), texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, found["having"].to_numpy())


def item_blocks(benchmark: DataFrame, items_at_once: int) -> list[Broadcast]:
    """The benchmark as broadcast blocks of some ``items_at_once`` items."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    blocks = max(1, -(-items.count() // items_at_once))
    shared = shared_shingles(items) if blocks > 1 else None
    out = []
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        out.append(benchmark.sparkSession.sparkContext.broadcast(Items([r.item_id for r in own], [r.text for r in own], shared)))
    return out


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS) -> DataFrame:
    """One row per input row: doc_id, uid (a hash of the text), matches (item_id, start and number of
    words, similarity; one for each item that the document holds)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("uid"), "text")
    found = [rows.mapInArrow(lambda it, sent=sent: _match(it, sent.value), _OUT) for sent in item_blocks(benchmark, items_at_once)]
    if len(found) == 1:
        return found[0]
    # Blocks meet on the document: one row of each block for it and for each repeat of it.
    out = found[0].withColumn("block", F.lit(0))
    for b, more in enumerate(found[1:], 1):
        out = out.unionByName(more.withColumn("block", F.lit(b)))
    rows = out.groupBy("doc_id", "uid").agg(F.flatten(F.transform(F.collect_set(F.struct("block", "matches")), lambda x: x["matches"])).alias("matches"), F.count_if(F.col("block") == 0).alias("repeats"))
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select("doc_id", "uid", F.array_sort("matches").alias("matches"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Only texts go to Python and only decisions come back, block after block of items, so nothing is shuffled.
    """
    for sent in item_blocks(benchmark, items_at_once):
        docs = docs.filter(_free(sent)(F.col("text")))
    return docs


def _free(items: Broadcast):  # noqa: ANN202
    @F.arrow_udf("boolean")
    @released
    def free(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = chunks(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text")
            yield pa.array([not found for part in parts for found in found_in(part.column("text"), items.value)], pa.bool_())

    return free


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.coalesce(F.array_max("matches.similarity"), F.lit(0.0))
    return out.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").alias("n_items"), F.col("matches.item_id").alias("item_ids"), best.alias("similarity"))


QUERIES = {"op7_decontamination": op7_decontamination}
SQL: dict[str, str] = {}
