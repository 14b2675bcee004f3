"""Ranked lexical search of a stated set of items over all documents, by dual trees.

Terms are the maximal runs outside ``[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``, A-Z lower-cased.  A term's weight is
w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document with n terms has m = 50 + (50 n N) div L, and its score for an item
is the sum of w * ((10**9 tf) div (1000 tf + 20 m)) over the item's different terms: a product of the item's terms and the
document's impacts, all whole numbers under 2**53, so sums of doubles are exact in any order.

1. One pass over the documents keeps of each what items can ask for: its number of terms, and of the terms that some item has their
   counts (an index of documents, written to the shared folder).  N, L and df are counted from it.
2. Items stand in a tree, split along the direction in which they vary most; so do the documents of each chunk of a task.  Each node has the
   greatest value of each coordinate below it.  No pair below two nodes can score over the product of these, so where
   that is under the least of the node's items' k-th scores, all its pairs are left out at once; what reaches the leaves is scored.
   Bounds equal to a k-th score are followed, since ties go to the smaller doc_id.
3. k-th scores start from those of a seed, a bounded number of documents taken by hash (any k documents give a lower bound), and rise
   within a task.  A task gives its best k of each item at its end, whatever it has read; these are merged in two steps, the first
   of which spreads an item over ``SPREAD`` groups.

Items go to the tasks in blocks of ``ITEM_BYTES`` of text, and of ``CELLS`` items times different terms, so what is broadcast and the width of a
tree's nodes are bounded; each block has its own pass.  An item over the bound is a block of its own.

Documents with a null or empty text match nothing and count nowhere; an item without terms has no rows.  Repeated items are ranked
each; repeated documents are documents of their own, those with the same id in any order.  A null doc_id comes after all others among equals.
Empty tables give no rows; other columns are not looked at.  Texts are whole: some megabytes at a time, a longer one a chunk of its own,
at some 15 bytes a byte of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelmill.llm.shared import released, stash
from voxelmill.llm.textops import Words, chunks, column_bytes, span_hashes

K = 50
ITEM_BYTES, CELLS = 4 << 20, 1 << 22
#: Documents of the seed, groups that an item's results are first merged in, and bytes of a chunk's impacts.
SEED, SPREAD, CHUNK_IMPACTS = 20_000, 64, 32 << 20
#: Documents and items of a leaf.
DOC_LEAF, ITEM_LEAF = 4, 1
_NO_ID = np.iinfo(np.int64).max
_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(column: pa.Array) -> Words:
    """Terms of a string column, lower-cased."""
    data, offsets = column_bytes(column)
    return Words(_LOWER[data], offsets, _GAP)


class Vocabulary:
    """The different terms of some items, found by hash and then by content."""

    def __init__(self, texts: list[str]):
        words = terms_of(pa.array(texts, pa.string()))
        raw = words.data.tobytes()
        spelt = [raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist())]
        self.terms = sorted(set(spelt))
        number = {t: i for i, t in enumerate(self.terms)}
        self.items = [np.unique([number[t] for t in spelt[a:b]]).astype(int) for a, b in zip(words.first[:-1], words.first[1:])]
        size = np.array([len(t) for t in self.terms], np.int64)
        self.data, self.end = np.frombuffer(b"".join(self.terms), np.uint8), np.cumsum(size)
        self.start = self.end - size
        hashes = span_hashes(self.data, self.start, self.end)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def __len__(self) -> int:
        return len(self.terms)

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word, -1 for one that is no term."""
        out = np.full(len(words), -1, np.int64)
        if not len(self) or not len(words):
            return out
        h = words.hashes()
        low, high = (np.searchsorted(self.hashes, h, side) for side in ("left", "right"))
        for step in range(int((high - low).max())):  # one step but where terms share a hash
            at = np.flatnonzero((low + step < high) & (out < 0))
            number = self.order[(low + step)[at]]
            size = self.end[number] - self.start[number]
            alike = words.end[at] - words.start[at] == size
            at, number, size = at[alike], number[alike], size[alike]
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                for some in np.array_split(own, len(own) * int(n) // (1 << 22) + 1):
                    place = np.arange(n)
                    same = (words.data[words.start[at[some], None] + place] == self.data[self.start[number[some], None] + place]).all(1)
                    out[at[some[same]]] = number[some[same]]
        return out


@released
def _index(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    width = max(len(vocabulary), 1)
    for batch in chunks(batches, "text"):
        words = terms_of(batch.column("text"))
        count = np.diff(words.first)
        number = vocabulary.numbers(words)
        row = words.rows()[number >= 0]
        key, tf = np.unique(row * width + number[number >= 0], return_counts=True)
        bounds = np.searchsorted(key // width, np.arange(len(count) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in ((key % width).astype(np.int32), tf.astype(np.int64))]
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seed"), pa.array(count.astype(np.int64)), *lists], names=["doc_id", "seed", "n", "terms", "tfs"])
        yield out.filter(pa.array(count > 0))


def index(docs: DataFrame, vocabulary: Vocabulary, share: float) -> DataFrame:
    """doc_id, seed (a share of the rows, by hash), n, and terms and tfs of the vocabulary, of documents with a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    seed = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(seed, F.lit(True)).alias("seed"), "text")
    return rows.mapInArrow(lambda it: _index(it, known.value), "doc_id long, seed boolean, n long, terms array<int>, tfs array<long>")


def along(rows: np.ndarray, steps: int = 4) -> np.ndarray:
    """Where rows lie along the direction in which they vary most, by a few power steps."""
    middle = rows.mean(0)
    off = rows[int(((rows - middle) ** 2).sum(1).argmax())] - middle
    for _ in range(steps):
        place = rows @ off - middle @ off
        off = place @ rows - place.sum() * middle
        off /= max(np.abs(off).max(), 1e-300)
    return rows @ off


class Tree:
    """Rows of non-negative numbers, halved along the direction in which they vary most, with each node's greatest coordinates.

    ``order`` lists the rows by leaf; node i holds ``order[low[i]:high[i]]`` and has the children ``child[i]`` (-1: a leaf).
    """

    def __init__(self, rows: np.ndarray, leaf: int):
        self.order = np.arange(len(rows))
        self.low, self.high, self.child, top = [0], [len(rows)], [-1], []
        at = 0
        while at < len(self.low):
            a, b = self.low[at], self.high[at]
            own = rows[self.order[a:b]]
            top.append(own.max(0) if b > a else np.zeros(rows.shape[1]))
            if b - a > leaf:
                self.order[a:b] = self.order[a:b][np.argsort(along(own), kind="stable")]
                middle = (a + b) // 2
                self.child[at] = len(self.low)
                self.low += [a, middle]
                self.high += [middle, b]
                self.child += [-1, -1]
            at += 1
        self.top = np.array(top)


class Search:
    """The best documents so far of each item of a block."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, documents: int, words: int, k: int = K, floor: np.ndarray | None = None):
        self.has = np.zeros((len(items), len(weights)))
        for i, terms in enumerate(items):
            self.has[i, terms] = 1.0
        self.weights, self.documents, self.words, self.k = weights, documents, words, k
        self.tree = Tree(self.has, ITEM_LEAF)
        #: A score that k documents reach; only better ones, and equal ones, can be among the best.
        self.floor = np.ones(len(items)) if floor is None else np.maximum(floor, 1.0)
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.scored = self.pairs = 0

    def impacts(self, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """Rows of w * ((10**9 tf) div (1000 tf + 20 m))."""
        m = 50 + 50 * n * self.documents // self.words
        row = np.repeat(np.arange(len(n)), np.diff(bounds))
        out = np.zeros((len(n), len(self.weights)))
        out[row, terms] = self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[row]))
        return out

    def add(self, doc: np.ndarray, impacts: np.ndarray) -> None:
        """Looks through a chunk of documents."""
        if not len(doc) or not len(self.has):
            return
        self.pairs += len(doc) * len(self.has)
        docs, items = Tree(impacts, DOC_LEAF), self.tree
        child = np.array(items.child)
        weakest = np.array([self.floor[items.order[a:b]].min() for a, b in zip(items.low, items.high)])
        found = []
        todo = [(0, np.array([0]))]
        while todo:
            node, some = todo.pop()
            some = some[items.top[some] @ docs.top[node] >= weakest[some]]
            if not len(some):
                continue
            inner = some[child[some] >= 0]
            below = np.concatenate([some[child[some] < 0], child[inner], child[inner] + 1])
            if docs.child[node] >= 0:  # both trees go down a level
                todo += [(docs.child[node], below), (docs.child[node] + 1, below)]
            elif len(inner):
                todo.append((node, below))
            else:
                rows = docs.order[docs.low[node] : docs.high[node]]
                own = np.concatenate([items.order[items.low[i] : items.high[i]] for i in some])
                score = impacts[rows] @ self.has[own].T
                self.scored += score.size
                r, c = np.nonzero(score >= self.floor[own])
                found.append((own[c], score[r, c], doc[rows[r]]))
        if found:
            self._keep(*(np.concatenate(x) for x in zip(*found)))

    def _keep(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.append(self.item, item), np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, np.arange(len(self.has) + 1))
        place = np.arange(len(item)) - first[item]
        best = place < self.k
        self.item, self.score, self.doc = item[best], score[best], doc[best]
        last = place == self.k - 1
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[last])


@released
def _search(batches: Iterator[pa.RecordBatch], search) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    own = search()
    at_once = max(16, CHUNK_IMPACTS // (8 * max(len(own.weights), 1)))
    for batch in batches:
        for a in range(0, batch.num_rows, at_once):
            part = batch.slice(a, at_once)
            doc = part.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            terms, tfs = part.column("terms"), part.column("tfs")
            bounds = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
            own.add(doc, own.impacts(part.column("n").to_numpy(), bounds, terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
    yield pa.RecordBatch.from_arrays([pa.array(own.item.astype(np.int32)), pa.array(own.score.astype(np.int64)), pa.array(own.doc, mask=own.doc == _NO_ID)], names=["item", "score", "doc_id"])


def _best(rows: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("item", *more).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks(items: DataFrame, size: int = ITEM_BYTES) -> list[DataFrame]:
    """The items in blocks of some ``size`` bytes of text, by hash."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // size)
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def search_block(docs: DataFrame, total: int, block: list, k: int = K, seed: int = SEED) -> DataFrame:
    """item_id, rank, doc_id, score of the items (rows of item_id, text, with a term each) of one block."""
    spark = docs.sparkSession
    vocabulary = Vocabulary([r["text"] for r in block])
    found = stash(index(docs, vocabulary, min(1.0, seed / max(total, 1))), "op11-index")
    one = found.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
    documents, words = one["documents"], one["words"] or 1
    weights = np.zeros(len(vocabulary))
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # at most the block's terms
        weights[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    shared = spark.sparkContext.broadcast((vocabulary.items, weights))

    def run(rows: DataFrame, floor: np.ndarray | None) -> DataFrame:
        make = lambda: Search(*shared.value, documents, words, k, floor)
        tops = rows.select("doc_id", "n", "terms", "tfs").mapInArrow(lambda it: _search(it, make), "item int, score long, doc_id long")
        spread = tops.withColumn("group", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SPREAD)))
        return _best(_best(spread, k, "group").drop("rank"), k)

    floor = np.ones(len(block))
    if total > seed:
        for r in run(found.filter("seed"), None).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k).collect():  # a row an item of the block
            floor[r["item"]] = r["score"]
    own = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "item int, item_id long")
    return run(found, floor).join(F.broadcast(own), "item").select("item_id", "rank", "doc_id", "score")  # a row an item of the block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, size: int = ITEM_BYTES, cells: int = CELLS, seed: int = SEED) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    docs = docs.select("doc_id", "text")
    total = docs.count()
    out = []
    for block in blocks(items.select(F.col("item_id").cast("long"), "text"), size):
        rows = block.collect()  # ``size`` bytes
        todo = [[r for r, own in zip(rows, Vocabulary([r["text"] or "" for r in rows]).items) if len(own)]]
        while todo:  # a block of too many items and terms is halved
            some = todo.pop()
            if len(some) > 1 and len(some) * len(Vocabulary([r["text"] for r in some])) > cells:
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]
            elif some:
                out.append(search_block(docs, total, some, k, seed))
    empty = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out) if out else empty


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT doc_id, row, ts, len(ts) AS n FROM w WHERE len(ts) > 0),
one AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
p AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row, term),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, one GROUP BY term),
s AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term), one GROUP BY item_id, row),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

QUERIES = {"op11_search": op11_search}
SQL = {"op11_search": ORACLE}
