"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A leaf holds up to ``LEAF`` consecutive pre-tokens of a text as two numbers, its characters and its
tokens; inner nodes hold sums, so the root holds the text's counts.  An edit replaces characters
[start, stop) by a string.  Byte-level BPE never merges over a pre-token's edge, and where a
pre-token ends is settled by at most ``CONTEXT`` characters after it, so after an edit only these are
cut and encoded again: from the last leaf that begins ``CONTEXT`` or more characters before the edit,
to the first old leaf edge behind it at which the new cut has an edge too.  The leaves between get
their new counts and the sums above them are updated; a leaf that has grown past ``GROW`` times
``LEAF`` pre-tokens has its region dealt to leaves anew, without encoding.

Edits of a document apply in order, each to the text as it then stands; positions beyond the text are
moved to its end, an edit without a start is passed over, a null replacement is empty.  Null texts
count as empty.  Texts that spell a special token of the tokenizer are counted whole by the library.
Repeated rows each get a result; an empty table gives none.  A very long text is cut and encoded in pieces; an edit of it takes
time by its own size, but its text and leaves are in memory together (some 3 bytes a byte of text).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.encoder import PRETOKEN, Encoder, encoder
from voxelmill.llm.shared import released
from voxelmill.llm.textops import chunks

LEAF = 32
GROW = 4
CONTEXT = 2
EDIT = "struct<start:int,stop:int,replacement:string>"


def pieces(enc: Encoder, text: str) -> list[str]:
    """The pre-tokens of a text without special tokens."""
    if enc.plain(text):
        return PRETOKEN.findall(text)
    return [text[a:b] for _, (a, b) in enc.library.pre_tokenizer.pre_tokenize_str(text)]


def _leaves(parts: list[str], counts: list[int]) -> tuple[list[int], list[int]]:
    """Characters and tokens of leaves of LEAF pre-tokens."""
    at = range(0, len(parts), LEAF)
    return [sum(map(len, parts[i : i + LEAF])) for i in at], [sum(counts[i : i + LEAF]) for i in at]


class Tree:
    """Sums of characters and tokens over leaves; node 1 is the root, node i has 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = max(1, len(chars))
        self.width = 1 << (self.leaves - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.width), np.int64)
        self.sums[0, self.width : self.width + len(chars)] = chars
        self.sums[1, self.width : self.width + len(tokens)] = tokens
        at = self.width
        while at > 1:
            self.sums[:, at // 2 : at] = self.sums[:, at : 2 * at : 2] + self.sums[:, at + 1 : 2 * at : 2]
            at //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, position: int) -> tuple[int, int]:
        """The last leaf that begins at or before a character, and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            left = int(self.sums[0, node])
            if position >= begin + left and self.sums[0, node + 1]:
                begin += left
                node += 1
        return node - self.width, begin

    def leaf(self, i: int) -> tuple[int, int]:
        return int(self.sums[0, self.width + i]), int(self.sums[1, self.width + i])

    def put(self, i: int, chars: int, tokens: int) -> None:
        """Sets a leaf and updates the sums above it."""
        node = self.width + i
        change = np.array([chars, tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> Tree:
        """The tree with leaves first..last replaced; the same one if there is room."""
        room = last - first + 1
        if len(chars) <= room:
            for k in range(room):
                self.put(first + k, *((chars[k], tokens[k]) if k < len(chars) else (0, 0)))
            return self
        old = self.sums[:, self.width : self.width + self.leaves].tolist()
        return Tree(old[0][:first] + chars + old[0][last + 1 :], old[1][:first] + tokens + old[1][last + 1 :])

    def dump(self) -> bytes:
        return self.sums[:, self.width : self.width + self.leaves].astype("<i4").tobytes()

    @staticmethod
    def load(content: bytes) -> Tree:
        chars, tokens = np.frombuffer(content, "<i4").reshape(2, -1)
        return Tree(chars.tolist(), tokens.tolist())


def counts(enc: Encoder, parts: list[str]) -> list[int]:
    """Tokens of each pre-token."""
    return [len(ids) // enc.width for ids in enc.cache.many([p.encode() for p in parts])]


def build(enc: Encoder, text: str) -> Tree:
    """The tree of a text; one leaf for a text with special tokens."""
    if enc.special and enc.special.search(text):
        return Tree([len(text)], [len(enc.whole(text)) // enc.width])
    parts = pieces(enc, text)
    return Tree(*_leaves(parts, counts(enc, parts)))


class Document:
    """A text by leaves, with its tree.  An edit touches the leaves around it alone; a tree that runs out of leaves is
    laid out anew, which takes GROW - 1 times LEAF pre-tokens put into one leaf, so it is rare."""

    def __init__(self, enc: Encoder, text: str, tree: Tree):
        self.enc, self.tree = enc, tree
        self.special = bool(enc.special and enc.special.search(text))
        ends = list(accumulate((tree.leaf(i)[0] for i in range(tree.leaves)), initial=0))
        self.leaves = [text[a:b] for a, b in zip(ends, ends[1:])]

    def text(self) -> str:
        return "".join(self.leaves)

    def between(self, a: int, b: int) -> str:
        """Characters a to b."""
        a, b = max(a, 0), min(b, self.tree.chars)
        if a >= b:
            return ""
        i, begin = self.tree.find(a)
        found, end = [], begin
        while end < b:
            found.append(self.leaves[i])
            end += len(self.leaves[i])
            i += 1
        return "".join(found)[a - begin : b - begin]

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replaces characters [start, stop); returns the number of characters that were encoded again."""
        enc, tree = self.enc, self.tree
        start = min(max(start, 0), tree.chars)
        stop = min(max(stop, start), tree.chars)
        reach = enc.special_size - 1
        if self.special or (enc.special and enc.special.search(self.between(start - reach, start) + new + self.between(stop, stop + reach))):
            text = self.text()
            text = text[:start] + new + text[stop:]
            self.__init__(enc, text, build(enc, text))
            return len(text)
        first, begin = tree.find(max(0, start - CONTEXT))
        last, end = first, begin + tree.leaf(first)[0]
        while last + 1 < tree.leaves and end < stop:
            last += 1
            end += tree.leaf(last)[0]
        grown = len(new) - (stop - start)
        while True:
            # Leaf ``last`` ends at ``end``; what follows it lets the cut see past that edge.
            ahead, look = last, end
            while ahead + 1 < tree.leaves and look < end + 2 * CONTEXT + 2:
                ahead += 1
                look += tree.leaf(ahead)[0]
            old = "".join(self.leaves[first : ahead + 1])
            parts = pieces(enc, old[: start - begin] + new + old[stop - begin :])
            edges = list(accumulate(map(len, parts), initial=0))
            k = bisect_right(edges, end + grown - begin) - 1
            if last + 1 >= tree.leaves or edges[k] == end + grown - begin:
                break
            last += 1
            end += tree.leaf(last)[0]
        parts = parts[:k] if last + 1 < tree.leaves else parts
        chars, tokens = _leaves(parts, counts(enc, parts))
        texts = ["".join(parts[i : i + LEAF]) for i in range(0, len(parts), LEAF)]
        room = last - first + 1
        if len(chars) > room and len(parts) <= GROW * LEAF * room:  # a little more than fits: fill the last leaf
            chars = chars[: room - 1] + [sum(chars[room - 1 :])]
            tokens = tokens[: room - 1] + [sum(tokens[room - 1 :])]
            texts = texts[: room - 1] + ["".join(texts[room - 1 :])]
        self.tree = tree.replace(first, last, chars, tokens)
        self.leaves[first : last + 1] = texts + [""] * (room - len(texts))
        return sum(map(len, parts))


def edit(enc: Encoder, tree: Tree, text: str, start: int, stop: int, new: str) -> tuple[Tree, str, int]:
    """The tree and text after one edit, and the number of characters that were encoded again."""
    doc = Document(enc, text, tree)
    n = doc.edit(start, stop, new)
    return doc.tree, doc.text(), n


@released
def _build(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    for part, made in enc.encoded(batches, "text"):
        chars, total = made.chars(), []
        trees = []
        for r, (a, b) in enumerate(zip(made.first[:-1].tolist(), made.first[1:].tolist())):
            if made.whole[r]:
                tree = build(enc, part.column("text")[r].as_py())
            else:
                at = np.arange(a, b, LEAF)
                tree = Tree(*(np.add.reduceat(x, at).tolist() if b > a else [] for x in (chars[:b], made.counts[:b])))
            total.append(tree.tokens)
            trees.append(tree.dump())
        columns = [pa.array(total, pa.int64()), pa.array(trees, pa.binary())]
        yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "n_tokens", "tree"])


def build_trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text and ``edits`` if there, with n_tokens and tree (leaf characters, leaf tokens)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", *(["edits"] if "edits" in docs.columns else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lambda it: _build(it, vocabulary), f"{schema}, n_tokens long, tree binary")


def attach(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits of ``edits(doc_id, seq, start, stop, replacement)``, in order of seq."""
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("edits"))
    own = own.select("doc_id", F.transform("edits", lambda e: F.struct(e.start.cast("int").alias("start"), e.stop.cast("int").alias("stop"), e.replacement.alias("replacement"))).alias("edits"))
    return trees.join(own, "doc_id", "left")


@released
def _edit(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    for batch in chunks(batches, "text"):
        out: dict[str, list] = {"text": [], "n_tokens": [], "tree": [], "encoded": []}
        for text, content, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "tree", "edits"))):
            doc, encoded = Document(enc, text or "", Tree.load(content)), 0
            for e in edits or ():
                if e is not None and e["start"] is not None:
                    encoded += doc.edit(e["start"], e["stop"] if e["stop"] is not None else e["start"], e["replacement"] or "")
            for name, value in zip(out, (doc.text(), doc.tree.tokens, doc.tree.dump(), encoded)):
                out[name].append(value)
        types = (pa.string(), pa.int64(), pa.binary(), pa.int64())
        made = [pa.array(v, t) for v, t in zip(out.values(), types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *made], names=["doc_id", "n_before", *out])


def apply_edits(trees: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_before, and after the ``edits``: text, n_tokens, tree, encoded (characters that were
    encoded again)."""
    rows = trees.select("doc_id", "text", "n_tokens", "tree", F.col("edits").cast(f"array<{EDIT}>"))
    return rows.mapInArrow(lambda it: _edit(it, vocabulary), "doc_id long, n_before long, text string, n_tokens long, tree binary, encoded long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document: its source is put first, 40 characters
    go from its middle, and 10 at three quarters become its language."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.char_length(F.coalesce("text", F.lit("")))
    head = F.concat(F.coalesce("source", F.lit("")), F.lit(": "))
    half, late = F.floor(n / 2).cast("int"), F.floor(n * 3 / 4).cast("int")

    def one(start, stop, new):  # noqa: ANN001, ANN202
        return F.struct(start.alias("start"), stop.alias("stop"), new.alias("replacement"))

    edits = F.array(one(F.lit(0), F.lit(0), head), one(half, half + 40, F.lit("")), one(late, late + 10, F.coalesce("lang", F.lit(""))))
    out = apply_edits(build_trees(docs.withColumn("edits", edits), vocabulary), vocabulary)
    return out.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.char_length("text").cast("long").alias("n_chars_edited"), F.col("encoded").alias("n_chars_encoded"))


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
