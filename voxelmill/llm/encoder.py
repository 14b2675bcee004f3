"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

The library cuts a text into pre-tokens and encodes each by itself, so a pre-token's ids depend on
nothing else.  Texts are therefore worked on a chunk at a time: NumPy cuts all of them into pre-tokens,
equal pre-tokens of the chunk are brought together, and each different one is looked up once in a cache,
or else encoded by the library's model.  Pre-tokens of up to 16 bytes are compared as two 64-bit words and a
length, which is their whole content; longer ones as byte strings.

The cut is made here for texts of characters on which it and the library agree; all others, and texts that
spell a special token, go to the library whole.  A text over ``PIECE`` bytes is worked on in pieces that
begin at a space between two words, where a pre-token begins whatever stands around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from voxelmill.llm.textops import chunks, column_bytes, mix

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = "\t\n\r "
#: Pre-tokens of byte-level BPE over the characters that _OTHER lets through.
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]")
_JOINT = re.compile(rb"[A-Za-z] (?=[A-Za-z])")
#: Pre-tokens of each of the two generations that a worker keeps.
CACHE = 150_000
#: Bytes of text that are cut at once.
PIECE = 4 << 20
_OUTSIDE, _SIGN, _ALPHA, _DIGIT, _SPACE, _BREAK, _BAD = 9, 0, 1, 2, 3, 4, 8


def _alphabet() -> np.ndarray:
    """Byte-level BPE writes bytes as characters: printable ones as they are, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.arange(256, dtype="<u2")
    others = np.setdiff1d(out, plain)
    out[others] = 256 + np.arange(len(others))
    return out


_ALPHABET = _alphabet()


def _spelled(content: bytes) -> str:
    return _ALPHABET[np.frombuffer(content, np.uint8)].tobytes().decode("utf-16-le")


_GAP = _spelled(b"\x00")


def _kinds(points: range) -> np.ndarray:
    """The class of each character by the patterns above."""
    kind = [(_OTHER, _BAD), (re.compile(f"[{_LETTER}]"), _ALPHA), (re.compile(f"[{_NUMBER}]"), _DIGIT), (re.compile(" "), _SPACE), (re.compile(f"[{_BLANK}]"), _BREAK)]
    return np.array([next((k for pattern, k in kind if pattern.match(chr(c))), _SIGN) for c in points], np.uint8)


_ASCII = np.concatenate([_kinds(range(128)), np.full(128, _SIGN, np.uint8)])
_TWO, _THREE = _kinds(range(0x800)), _kinds(range(0x2000, 0x2100))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class _Cache:
    """Ids by pre-token.  When a generation is full it becomes the old one, and what is used of that
    moves to the new one, so frequent pre-tokens stay."""

    def __init__(self, encode):
        self.encode, self.new, self.old = encode, {}, {}

    def many(self, parts: list[bytes]) -> list[bytes]:
        """The ids of different pre-tokens; those that are new are encoded together."""
        known = list(map(self.new.get, parts))
        missing = [i for i, k in enumerate(known) if k is None]
        names = [parts[i] for i in missing]
        found = list(map(self.old.get, names))
        fresh = [i for i, k in enumerate(found) if k is None]
        for i, ids in zip(fresh, self.encode([names[i] for i in fresh])):
            found[i] = ids
        for i, ids in zip(missing, found):
            known[i] = ids
        if len(self.new) + len(missing) > CACHE:
            self.old, self.new = self.new, {}
        self.new.update(zip(names, found))
        return known


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        second = data[lead + 1].astype(np.int32) & 63
        two = first < 0xE0
        out[lead[two]] = out[lead[two] + 1] = _TWO[((first[two] & 31) << 6) | second[two]]
        lead, first, second = lead[~two], first[~two], second[~two]
        out[lead] = _BAD
        three = (first == 0xE2) & (second < 4)
        lead, point = lead[three], (second[three] << 6) | (data[lead[three] + 2] & 63)
        out[lead] = out[lead + 1] = out[lead + 2] = _THREE[point]
    return out


def begins(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, as PRETOKEN would cut each row.

    A run of letters, numbers or signs takes the space before it along; of a run of blanks before one, the last
    is cut off; the endings after an apostrophe stand alone unless a sign or a space comes before that.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.full(n, _OUTSIDE, np.uint8), np.full(n, _OUTSIDE, np.uint8)
    before[1:] = np.where(edge[1:-1], _OUTSIDE, kind[:-1])
    after[:-1] = np.where(edge[1:-1], _OUTSIDE, kind[1:])
    solid = kind < _SPACE
    new = (before != kind) & (before != _SPACE)
    out = np.where(solid, new, ((before < _SPACE) | (before == _OUTSIDE)) | (after < _SPACE))
    at = np.flatnonzero((data == 39) & new)
    if len(at):
        ahead = np.concatenate([data, np.zeros(3, np.uint8)])
        inside = [~edge[np.minimum(at + k, n)] for k in (1, 2)]  # the letter k after it is of the same row
        a, b = ahead[at + 1], ahead[at + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & inside[0]
        two = inside[0] & inside[1] & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
        out[at[one | two] + 1] = False
        for end in (at[one] + 2, at[two] + 3):
            out[end[end < n]] = True
    return out


class Encoded:
    """Texts of a column as ids: ``ids`` end to end, ``at`` the n + 1 positions where texts begin; and their
    pre-tokens: ``first`` the n + 1 numbers at which texts begin, ``counts`` of ids and ``start`` in ``data`` of
    each.  A text that went to the library whole is one pre-token, and ``whole`` for it is set."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, first: np.ndarray, counts: np.ndarray, start: np.ndarray, data: np.ndarray, whole: np.ndarray):
        self.ids, self.at, self.first, self.counts, self.start, self.data, self.whole = ids, at, first, counts, start, data, whole

    def chars(self) -> np.ndarray:
        """Characters of each pre-token."""
        heads = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return np.diff(heads[np.append(self.start, len(self.data))])

    @staticmethod
    def joined(parts: list[Encoded]) -> Encoded:
        """The pieces of one text as that text."""
        shift = np.cumsum([0] + [len(p.data) for p in parts])
        lists = {c: np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "counts", "data")}
        start = np.concatenate([p.start + s for p, s in zip(parts, shift)])
        return Encoded(lists["ids"], np.array([0, len(lists["ids"])]), np.array([0, len(start)]), lists["counts"], start, lists["data"], np.array([any(p.whole.any() for p in parts)]))


class Encoder:
    """``batch(column)`` encodes texts; ``pretoken(part)`` gives one pre-token's ids as little-endian bytes of
    ``width`` bytes each."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_size = max(map(len, special), default=0)
        self._special_bytes = re.compile(self.special.pattern.encode()) if self.special else None
        self._joint = None if any(re.search(r"\s", s) for s in special) else _JOINT
        self.cache = _Cache(self._encode)
        self.regular = "ByteLevel" in repr(self.library.pre_tokenizer) and "use_regex=True" in repr(self.library.pre_tokenizer) and "add_prefix_space=False" in repr(self.library.pre_tokenizer) and self.library.normalizer is None

    def pretoken(self, part: str) -> bytes:
        return self.cache.many([part.encode()])[0]

    def whole(self, text: str) -> bytes:
        """Ids by the library alone."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def plain(self, text: str) -> bool:
        """Whether PRETOKEN cuts this text as the library does."""
        return self.regular and not _OTHER.search(text) and not (self.special and self.special.search(text))

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens by the library's model."""
        out: list[bytes] = []
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            spelled = _spelled(b"\x00".join(some)).split(_GAP)
            if len(spelled) > len(some):  # a pre-token holds the gap
                spelled = list(map(_spelled, some))
            tokens = list(map(self.library.model.tokenize, spelled))
            ids = np.array([t.id for own in tokens for t in own], self.dtype).tobytes()
            ends = list(accumulate((self.width * len(own) for own in tokens), initial=0))
            out += [ids[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def ids(self, text: str) -> bytes:
        """Ids of one whole text, as the library gives them."""
        return self.batch(pa.array([text], pa.string())).ids.tobytes()

    def batch(self, column: pa.Array) -> Encoded:
        """All texts of a column at once; null is empty."""
        data, offsets = column_bytes(column)
        raw, rows = data.tobytes(), len(offsets) - 1
        kind = kinds(data)
        whole = np.full(rows, not self.regular)
        at = np.flatnonzero(kind == _BAD)
        whole[np.searchsorted(offsets, at, "right") - 1] = True
        if self._special_bytes:
            at = np.array([m.start() for m in self._special_bytes.finditer(raw)], np.int64)
            whole[np.searchsorted(offsets, at, "right") - 1] = True
        starts = begins(data, kind, offsets)
        filled = np.diff(offsets) > 0
        for r in np.flatnonzero(whole & filled).tolist():
            starts[offsets[r] : offsets[r + 1]] = False
            starts[offsets[r]] = True
        start = np.flatnonzero(starts)
        size = np.diff(np.append(start, len(data)))
        first = np.searchsorted(start, offsets)
        number, known = self._known(data, raw, start, size, np.flatnonzero(whole & filled), first, offsets)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        pool = np.frombuffer(b"".join(known), self.dtype)
        counts = lengths[number] if len(number) else np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        begin = np.cumsum(lengths) - lengths
        ids = pool[np.repeat(begin[number] - (ends - counts), counts) + np.arange(int(ends[-1]))] if len(start) else np.zeros(0, self.dtype)
        return Encoded(ids, np.concatenate([[0], ends])[first], first, counts, start, data, whole)

    def _known(self, data: np.ndarray, raw: bytes, start: np.ndarray, size: np.ndarray, whole: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """For each pre-token the number of its content, and the ids of each content."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        one, two = (np.ascontiguousarray(words[start + k]).view("<u8").ravel() & _MASK[np.clip(size - k, 0, 8)] for k in (0, 8))
        hashed = mix(one + mix(two + size.astype(np.uint64)))
        number = pa.array(hashed).dictionary_encode().indices.to_numpy().astype(np.int64)
        head = np.empty(int(number.max()) + 1 if len(number) else 0, np.int64)
        head[number] = np.arange(len(number))
        short = size <= 16
        alike = short & (one == one[head[number]]) & (two == two[head[number]]) & (size == size[head[number]])
        texts = dict(zip(first[whole].tolist(), whole.tolist()))
        alike[list(texts)] = False
        odd = np.flatnonzero(~alike).tolist()  # long ones, whole texts, and contents that share a hash
        single = ~np.isin(head, odd)
        known = np.empty(len(head), object)
        known[~single] = b""
        own = head[single]
        known[single] = self.cache.many([raw[a:b] for a, b in zip(start[own].tolist(), (start + size)[own].tolist())])
        known = known.tolist()
        number[odd] = np.arange(len(known), len(known) + len(odd))
        for k in odd:
            part = raw[start[k] : start[k] + size[k]]
            known.append(self.whole(part.decode()) if k in texts else self.cache.many([part])[0])
        return number, known

    def encoded(self, batches: Iterator[pa.RecordBatch], text: str, piece: int | None = None) -> Iterator[tuple[pa.RecordBatch, Encoded]]:
        """Parts of the batches, of some ``piece`` bytes of text (``PIECE`` where it is not given), with their ids."""
        piece = piece or PIECE
        for part in chunks(batches, text, piece):
            column = part.column(text)
            own = column[0].as_buffer().to_pybytes() if len(part) == 1 and column[0].is_valid else b""
            if len(own) <= piece or not self._joint:
                yield part, self.batch(column)
                continue
            cuts = [0]
            while cut := self._joint.search(own, min(cuts[-1] + piece, len(own))):
                cuts.append(cut.start() + 1)
            pieces = [self.batch(pa.array([own[a:b].decode()], pa.string())) for a, b in zip(cuts, [*cuts[1:], len(own)])]
            yield part, Encoded.joined(pieces)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
