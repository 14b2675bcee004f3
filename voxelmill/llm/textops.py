"""Words, hashes and spans of Arrow string columns, by NumPy over whole byte buffers.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Hashes are polynomials modulo
2**64 taken from prefix sums, so a span of any length costs two lookups; callers that need exact
equality compare contents wherever hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one NumPy pass works on (a longer document is a pass of its own).
CHUNK_BYTES = 2 << 20
#: Bytes whose numbers are in hand at once within such a pass.
PIECE_BYTES = 1 << 20

_HIGH, _ONES = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "gram": 0xA0761D6478BD642F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        base, size = _BASES[kind], max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _powers[kind] = (made[0], made[1])
    up, down = _powers[kind]
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads differences over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Spans:
    """Hashes of spans of one value sequence."""

    def __init__(self, values: np.ndarray, kind: str):
        n = len(values)
        up, self.down = powers(kind, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64, copy=False) * up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of a byte buffer, as by ``Spans`` over its bytes plus 1, of which some ``PIECE_BYTES`` are in hand
    at once.  Starts and ends rise."""
    out = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        a = int(start[done])
        stop = max(done + 1, int(np.searchsorted(end, a + PIECE_BYTES, "right")))
        b = int(end[stop - 1])
        if b - a <= PIECE_BYTES:
            spans = Spans(data[a:b].astype(np.uint64) + np.uint64(1), "byte")
            out[done:stop] = spans.hash(start[done:stop] - a, end[done:stop] - a)
        else:  # one long span: the sums of its pieces, each raised to its place
            up, _ = powers("byte", PIECE_BYTES)
            total = 0
            for i in range(a, b, PIECE_BYTES):
                part = data[i : min(b, i + PIECE_BYTES)].astype(np.uint64) + np.uint64(1)
                total += int((part * up[: len(part)]).sum()) * pow(_BASES["byte"], i - a, 1 << 64)
            out[done] = mix(np.array([total % (1 << 64)], np.uint64))[0]
        done = stop
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        ends = np.cumsum(sizes)
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


class Words:
    """Words of the rows of a byte buffer: runs of bytes outside ``gap``.

    ``start`` and ``end`` are byte positions of each word, ``first`` the n + 1 word numbers at which
    the rows begin.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        solid = ~gap[data]
        begins, ends = solid.copy(), solid.copy()
        if len(data):
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            begins[1:] &= ~solid[:-1] | edge[1:-1]
            ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by single spaces, and where each begins and ends in that."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        start = end - size
        out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
        solid = np.ones(len(out), bool)
        solid[end[:-1]] = False
        out[solid] = self.data[~SPACE[self.data]]
        return out.tobytes(), start, end

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Units:
    """Ends of the code points of a UTF-8 buffer, marked eight bytes at a time."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)  # a zero byte after the last one ends it
        padded[: len(data)] = data
        w = padded.view("<u8")
        starts = ~(w & ~(w << np.uint64(1))) & _HIGH  # bytes other than 10xxxxxx, marked in their highest bits
        ends = starts[:-1] >> np.uint64(8) | starts[1:] << np.uint64(56)
        last = len(data) % 8
        ends[len(data) // 8 :] &= np.uint64((1 << 8 * last) - 1)  # the padding ends nothing
        self.marks = ends
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(ends), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many code points end before each byte position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        here = np.append(self.marks, np.uint64(0))[word] & below
        return self.before[word] + np.bitwise_count(here)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position after the k-th code point (from 1), 0 for k = 0."""
        word = np.clip(np.searchsorted(self.before, k, "left") - 1, 0, max(len(self.marks) - 1, 0))
        left = (k - self.before[word]).astype(np.uint64)  # 1 to 8 marks into the word
        sums = (self.marks[word] >> np.uint64(7)) * _ONES  # byte i: marks in bytes 0 to i
        less = ((((left - np.uint64(1)) * _ONES) | _HIGH) - sums) & _HIGH  # bytes whose sum is under the wanted number
        byte = np.bitwise_count(less)
        return np.where(k > 0, word * 8 + byte.astype(np.int64) + 1, 0)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values."""
    have = 1
    out = values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def repeats(hashes: np.ndarray, content) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose content occurs at a smaller position too, and the smallest such position.

    ``content(i)`` gives the content at position i; it decides wherever hashes agree, so a hash that
    two contents share neither adds nor hides a repeat.
    """
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    heads = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(order) else order
    later, first = order[~fresh], heads[~fresh]
    same = np.fromiter((content(a) == content(b) for a, b in zip(later.tolist(), first.tolist())), bool, len(later))
    if same.all():
        return later, first
    extra_later, extra_first = [], []
    seen: dict[tuple[int, bytes], int] = {}
    for i in later[~same].tolist():  # in rising position within a hash
        key = (int(hashes[i]), content(i))
        if key in seen:
            extra_later.append(i)
            extra_first.append(seen[key])
        else:
            seen[key] = i
    return np.concatenate([later[same], np.array(extra_later, later.dtype)]), np.concatenate([first[same], np.array(extra_first, first.dtype)])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
