"""Secrets in texts: three fixed patterns, and a character convolutional network over every other candidate.

Base findings (leftmost, not overlapping within a kind; a match that fails its length is dropped): ``assign``, a name of ``ASSIGN``
with a value of 8 or more characters; ``access``, 16 or more; ``hex``, 32 or more.  Spans are those of the whole match, in code points, end exclusive.
They always stay.

Candidates are the maximal runs of ``[A-Za-z0-9+/_.=-]`` that have 12 or more characters with an ASCII letter and a digit among them, or
8 or more behind ``:`` or ``=`` (with up to 8 spaces and a quote between), and the values of base findings that no such run holds.
Each is seen whole, with ``LEFT`` characters before and ``RIGHT`` behind it: characters are embedded, a flag tells those of the candidate, a
convolution of width ``WIDTH`` is pooled by its maximum over the candidate and over its surroundings apart, and a hidden
layer gives the logit.  A candidate that overlaps no base finding is added as ``cnn`` if its calibrated probability is at its group's threshold.

The network learns from labelled findings: all different candidates of the corpus, whole, labelled by whether a base finding holds them, and labelled
ones of known forms that a seeded rule writes between the surroundings of each (one for each, ``MADE`` at least).  A quarter, chosen by hash, is kept
from it: a line through the logits is calibrated on all of that, and each group's threshold (behind a sign, or bare) is the greatest that still finds
``RECALL`` of its true ones, as counted.  Findings are dealt by hash to shards of some ``SHARD`` characters.  In each epoch every shard's task takes
Adam's steps over all of its findings, from the same weights, and the mean of the shards' weights is where the next begins; only sums
come to the driver, and they are exact.  So the network does not depend on how rows are partitioned.

A null or empty text has no spans; repeated rows get the same result each; empty tables give no rows; other columns, whatever their
names, are not looked at.  Texts are read whole, some megabytes at a time; a longer one is a chunk of its own, at some
10 bytes a byte of it and a kilobyte a candidate.  A candidate of any length is pooled piece by piece.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.shared import give_back, partitions, released, stash
from voxelmill.llm.textops import Units, Words, chunks, column_bytes

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "cnn")
_BASE = {"assign": (re.compile(ASSIGN, re.A | re.I), 2, 8), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(r"[0-9a-f]+"), 0, 32)}
#: A text without a match of these has no base finding of the kind.
_MAYBE = {"assign": f"(?i){ASSIGN[:-2]}{{8}})", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
LEFT, RIGHT, WIDTH, SPACES = 24, 12, 5, 8
PER_LABEL, MADE, BODY, RECALL, SEED = 1000, 2000, 256, 0.98, 12
#: Characters of the findings of a shard, and steps of a unit in exact sums and in thresholds.
SHARD, UNIT = 1 << 17, 1 << 30
EMBEDDED, FILTERS, HIDDEN, EPOCHS, BATCH = 8, 24, 16, 8, 64
#: Positions that are convolved at once.
PIECE = 1 << 14
#: Windows that are labelled at once, and bins of a pass that looks for a threshold.
ROWS, BINS = 256, 4096
_LETTER, _OTHER, _PAD = 128, 129, 130
#: A name and a sign at the end of what is left of a finding.
_NAME = re.compile(r"""[^\s:=]*\s*[:=]\s*["']?$""")
_GAP = np.ones(256, bool)
_GAP[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = False
_WINDOW = "start:long,end:long,base:boolean,signed:boolean,left:string,body:string,right:string"
_FOUND = f"doc_id long, base array<struct<kind:string,start:long,end:long>>, windows array<struct<{_WINDOW}>>"
_LABELLED = "left string, body string, right string, signed boolean, label boolean, kept boolean, key long"
_SPANS = "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<start:long,end:long,probability:double>>"


def base_findings(text: str, kinds: tuple[str, ...] = KINDS[:3]) -> list[tuple[str, int, int, int, int]]:
    """kind, start, end, and start and end of the value, by start, then kind."""
    out = []
    for kind in kinds:
        pattern, group, least = _BASE[kind]
        out += [(m.start(), KINDS.index(kind), kind, m.end(), *m.span(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end, a, b) for start, _, kind, end, a, b in sorted(out)]


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, byte start, byte end and sign of the candidate runs of a buffer."""
    words = Words(data, offsets, _GAP)
    size = words.end - words.start
    at = np.flatnonzero(size >= 8)
    start, end, row = words.start[at], words.end[at], words.rows()[at]
    kinds = []
    for low, high in ((48, 57), (65, 90), (97, 122)):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data >= low) & (data <= high), out=sums[1:])
        kinds.append(sums[end] > sums[start])
    mixed = (end - start >= 12) & kinds[0] & (kinds[1] | kinds[2])
    before, first = start - 1, offsets[row]
    byte = lambda k: np.where(k >= first, data[np.maximum(k, 0)] if len(data) else 0, 0)
    before = before - np.isin(byte(before), list(b"\"'"))
    for _ in range(SPACES):
        before = before - (byte(before) == 32)
    signed = np.isin(byte(before), list(b":="))
    keep = mixed | signed
    return row[keep], start[keep], end[keep], signed[keep]


def _window(text: str, start: int, end: int, base: bool, signed: bool) -> dict:
    return {"start": start, "end": end, "base": base, "signed": signed, "left": text[max(0, start - LEFT) : start], "body": text[start:end], "right": text[end : end + RIGHT]}


@released
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
        ("windows", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("signed", pa.bool_()), ("left", pa.string()), ("body", pa.string()), ("right", pa.string())])))])
    for batch in chunks(batches, "text"):
        column = batch.column("text")
        n = len(column)
        data, offsets = column_bytes(column)
        row, start, end, signed = _runs(data, offsets)
        units = Units(data)
        rank = units.rank(offsets)
        start, end = units.rank(start) - rank[row], units.rank(end) - rank[row]
        maybe: dict[int, list[str]] = {}
        for kind, pattern in _MAYBE.items():
            for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, pattern), False).to_numpy(zero_copy_only=False)).tolist():
                maybe.setdefault(i, []).append(kind)
        base, windows = [[] for _ in range(n)], [[] for _ in range(n)]
        bounds = np.searchsorted(row, np.arange(n + 1))
        for i in np.union1d(row, list(maybe)).astype(int).tolist():
            text = column[i].as_py()
            found = base_findings(text, tuple(maybe.get(i, ())))
            base[i] = [{"kind": k, "start": a, "end": b} for k, a, b, _, _ in found]
            own = slice(bounds[i], bounds[i + 1])
            a, b = start[own], end[own]
            held = np.zeros(len(a), bool)
            for kind, left, right, low, high in found:
                inside = (a < right) & (b > left)
                held |= inside
                if not ((a <= low) & (b >= high)).any():
                    windows[i].append(_window(text, low, high, True, kind == "assign"))
            windows[i] += [_window(text, *x) for x in zip(a.tolist(), b.tolist(), held.tolist(), signed[own].tolist())]
            windows[i].sort(key=lambda w: (w["start"], w["end"]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, schema.field(k).type) for k, x in (("base", base), ("windows", windows)))], schema=schema)


def findings(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, base (kind, start, end) and windows (the candidates with their surroundings)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find, _FOUND)


@dataclass(frozen=True)
class Finding:
    """A candidate with its surroundings."""

    left: str
    body: str
    right: str
    signed: bool
    label: bool = False

    def key(self) -> int:
        return int.from_bytes(hashlib.md5("\0".join((self.left, self.body, self.right)).encode()).digest()[:8], "big")


def _codes(text: str) -> list[int]:
    return [c if c < 128 else _LETTER if chr(c).isalpha() else _OTHER for c in map(ord, text)]


def encoded(found: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of windows, padded on both sides, and where each position lies: 1 in the candidate, 2 around it, 0 in the padding."""
    size = max((len(f.left) + len(f.body) + len(f.right) for f in found), default=0)
    half = WIDTH // 2
    codes, place = np.full((len(found), size + 2 * half), _PAD, np.int16), np.zeros((len(found), size + 2 * half), np.int8)
    for i, f in enumerate(found):
        n, a, b = len(f.left) + len(f.body) + len(f.right), len(f.left), len(f.left) + len(f.body)
        codes[i, half : half + n] = _codes(f.left + f.body + f.right)
        place[i, half : half + n] = 2
        place[i, half + a : half + b] = 1
    return codes, place


class Network:
    """Embedding, convolution, maxima inside and around a candidate, a hidden layer, a calibrated logit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        wide = WIDTH * (EMBEDDED + 1)
        self.p = {
            "embed": rng.normal(0, 0.5, (_PAD + 1, EMBEDDED)), "conv": rng.normal(0, (2 / wide) ** 0.5, (wide, FILTERS)), "conv0": np.zeros(FILTERS),
            "hide": rng.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)), "hide0": np.zeros(HIDDEN), "out": rng.normal(0, 0.3, HIDDEN), "out0": np.zeros(1),
        }
        self.line, self.thresholds = (1.0, 0.0), {False: 0.5, True: 0.5}

    def _patches(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.p["embed"][codes], (place == 1)[:, :, None]], axis=2)
        size = codes.shape[1] - WIDTH + 1
        return np.stack([x[:, k : k + size] for k in range(WIDTH)], axis=2).reshape(len(codes), size, -1)

    def _pool(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima (rows, 2 x filters; 0 where a part has no positions), and their positions."""
        patches, place = self._patches(codes, place), place[:, WIDTH // 2 : place.shape[1] - WIDTH // 2]
        made = np.maximum(patches @ self.p["conv"] + self.p["conv0"], 0)
        best, at = [], []
        for part in (1, 2):
            own = np.where((place == part)[:, :, None], made, -1.0)
            where = own.argmax(1)
            best.append(np.maximum(np.take_along_axis(own, where[:, None], 1)[:, 0], 0))
            at.append(where)
        return np.hstack(best), np.hstack(at)

    def _peaks(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima, and the codes and flags (rows, 2 x filters, width) that they come from."""
        best, at = self._pool(codes, place)
        where = np.arange(len(codes))[:, None, None], at[:, :, None] + np.arange(WIDTH)
        return best, codes[where], place[where] == 1

    def _blocks(self, found: list[Finding]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """Places in the list of windows of like length, together, and their codes; a long one's in overlapping pieces."""
        size = np.array([len(f.left) + len(f.body) + len(f.right) for f in found], int)
        order = np.argsort(size, kind="stable")
        done = 0
        while done < len(order):
            stop = done + 1
            while stop < len(order) and (stop - done + 1) * size[order[stop]] <= PIECE:
                stop += 1
            some = order[done:stop]
            codes, place = encoded([found[i] for i in some])
            cuts = [slice(k, k + PIECE + WIDTH - 1) for k in range(0, codes.shape[1] - WIDTH + 1, PIECE)]
            yield some, [(codes[:, own], place[:, own]) for own in cuts]
            done = stop

    def peaks(self, found: list[Finding]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_peaks`` of windows of any length."""
        n = 2 * FILTERS
        best, codes, flags = np.zeros((len(found), n)), np.full((len(found), n, WIDTH), _PAD, np.int16), np.zeros((len(found), n, WIDTH), bool)
        for some, parts in self._blocks(found):
            for part in parts:
                own = self._peaks(*part)
                row, col = np.nonzero(own[0] > best[some])
                for out, x in zip((best, codes, flags), own):
                    out[some[row], col] = x[row, col]
        return best, codes, flags

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.p["hide"] + self.p["hide0"], 0)
        return hidden, hidden @ self.p["out"] + self.p["out0"][0]

    def logits(self, found: list[Finding]) -> np.ndarray:
        """Of windows of any length: those of like length together, a long one in overlapping pieces."""
        out = np.zeros(len(found))
        for some, parts in self._blocks(found):
            best = [self._pool(*part)[0] for part in parts]
            out[some] = self._head(np.maximum.reduce(best) if best else np.zeros((len(some), 2 * FILTERS)))[1]
        return out

    def gradient(self, codes: np.ndarray, place: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of labelled windows, and its slopes."""
        return self.slopes(self._peaks(codes, place), label, np.full(len(label), 1 / len(label)))

    def slopes(self, peaks: tuple[np.ndarray, np.ndarray, np.ndarray], label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted sum of the cross entropies of labelled windows, and its slopes."""
        pooled, codes, flags = peaks
        hidden, logit = self._head(pooled)
        loss = weight @ (np.logaddexp(0, logit) - label * logit)
        down = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - label) * weight
        g = {"out": hidden.T @ down, "out0": np.array([down.sum()])}
        back = np.outer(down, self.p["out"]) * (hidden > 0)
        g["hide"], g["hide0"] = pooled.T @ back, back.sum(0)
        back = (back @ self.p["hide"].T) * (pooled > 0)
        filters = np.tile(np.arange(FILTERS), 2)
        taken = np.concatenate([self.p["embed"][codes], flags[:, :, :, None]], axis=3).reshape(len(label), 2 * FILTERS, -1)
        each = np.einsum("nfk,nf->fk", taken, back)
        g["conv"], g["conv0"] = (each[:FILTERS] + each[FILTERS:]).T, (back.sum(0)[:FILTERS] + back.sum(0)[FILTERS:])
        inner = (back[:, :, None] * self.p["conv"].T[filters][None]).reshape(*back.shape, WIDTH, EMBEDDED + 1)[..., :EMBEDDED]
        flat = codes.ravel()
        g["embed"] = np.column_stack([np.bincount(flat, inner[..., d].ravel(), _PAD + 1) for d in range(EMBEDDED)])
        return float(loss), g

    def train(self, found: list[Finding], epochs: int = EPOCHS, rate: float = 3e-3, seed: int = SEED) -> None:
        """Adam over batches of windows, each label with half of the weight."""
        label = np.array([f.label for f in found], float)
        if not len(found) or label.min() == label.max():
            return
        for epoch in range(epochs):
            self.epoch(found, rate, (seed, epoch))

    def epoch(self, found: list[Finding], rate: float = 3e-3, seed: tuple[int, ...] = (SEED,)) -> None:
        """Adam's steps over batches that take every window once at least; those of the rarer label come again, so that each has half of the weight."""
        rng = np.random.default_rng(seed)
        label = np.array([f.label for f in found], float)
        own = [rng.permutation(np.flatnonzero(label == x)) for x in (1, 0)]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in "mv")
        for step in range(1, -(-max(map(len, own)) // (BATCH // 2)) + 1):
            parts = [np.take(x, np.arange((step - 1) * BATCH // 2, step * BATCH // 2), mode="wrap") for x in own if len(x)]
            some = np.concatenate(parts)
            _, g = self.slopes(self.peaks([found[i] for i in some]), label[some], np.full(len(some), 1 / BATCH))
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, found: list[Finding], recall: float = RECALL) -> None:
        """The line of the logits by Newton's steps, then each group's greatest threshold that finds ``recall`` of its true ones."""
        label, z = np.array([f.label for f in found], float), self.logits(found)
        if len(found) and label.min() != label.max():
            x, w = np.column_stack([z / max(np.abs(z).max(), 1e-9), np.ones(len(z))]), np.zeros(2)
            soft = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / (len(label) - label.sum() + 2))
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
                w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (soft - p) - 1e-3 * w)
            self.line = (float(w[0] / max(np.abs(z).max(), 1e-9)), float(w[1]))
        p = self.probability(z)
        every = np.sort(p[label == 1])
        for signed in (False, True):
            own = np.sort(p[(label == 1) & (np.array([f.signed for f in found], bool) == signed)])
            own = own if len(own) >= 20 else every
            if len(own):
                self.thresholds[signed] = float(own[int((1 - recall) * len(own))])

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] * logits + self.line[1], -500, 500)))


#: Forms of made findings.  Fixed values: heads of known keys, names that are given a secret, names and endings that are not.
_HEADS = ("", "", "", "sk_live_", "ghp_", "xoxb-", "AIza", "eyJ", "AKIA", "glpat-")
_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth", "credential", "access_key", "private_key")
_PLAIN_NAMES = ("version", "file", "url", "date", "id", "ref", "page", "host", "path", "name")
_ENDINGS = (".com", ".org", ".html", ".txt", ".py", ".png", ".tar.gz", "")
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def made_findings(around: list[tuple[str, str]], n: int = MADE, seed: int = SEED) -> list[Finding]:
    """n labelled findings of known forms between given surroundings: random keys, and names of hosts, files, versions, dates and things."""
    rng = np.random.default_rng(seed)
    pick = lambda of: of[int(rng.integers(len(of)))]
    out = []
    for k in range(n):
        left, right = pick(around) if around else ("", "")
        label, named = k % 2 == 0, rng.random() < 0.5
        if label:
            alphabet = pick(_ALPHABETS)
            body = pick(_HEADS) + "".join(pick(alphabet) for _ in range(int(rng.integers(16, 64))))
        else:
            word = lambda: "".join(pick("etaoinshrdlucmfgypbvk") for _ in range(int(rng.integers(2, 8))))
            parts = [word() if rng.random() < 0.6 else str(rng.integers(10 ** int(rng.integers(1, 5)))) for _ in range(int(rng.integers(2, 6)))]
            body = pick("._-/").join([word() + str(rng.integers(100)), *parts]) + pick(_ENDINGS)
        if named:
            left = f"{left}{pick(_NAMES if label else _PLAIN_NAMES)}{pick((' = ', '=', ': ', ':'))}{pick(('', chr(34), chr(39)))}"
        elif not label and rng.random() < 0.3:
            left = f"{left}{pick('0123456789')}@"
        out.append(Finding(left[-LEFT:], body, right, named, label))
    return out


def labelled_sample(found: DataFrame, per_label: int = PER_LABEL) -> list[Finding]:
    """Different windows of ``findings`` with the least hashes, so many of each label at most: some to look at, of which nothing is fitted."""
    rows = found.select(F.explode("windows").alias("w")).select("w.base", "w.signed", "w.left", "w.body", "w.right").filter(F.length("body") <= BODY).distinct()
    rows = rows.withColumn("hash", F.xxhash64("left", "body", "right", "signed"))
    out = []
    for label in (False, True):
        some = rows.filter(F.col("base") == label).orderBy("hash", "left", "body", "right", "signed").limit(per_label)
        out += [Finding(r["left"], r["body"], r["right"], r["signed"], label) for r in some.collect()]  # a bounded sample
    return out


def fit(sample: list[Finding], made: int = MADE, recall: float = RECALL) -> Network:
    """The network of labelled findings in hand; a quarter of them, by hash, calibrates it."""
    every = sample + made_findings([(f.left, f.right) for f in sample if not f.signed], made)
    kept = [f.key() % 4 == 0 for f in every]
    network = Network()
    network.train([f for f, k in zip(every, kept) if not k])
    network.calibrate([f for f, k in zip(every, kept) if k], recall)
    return network


@released
def _labelled(batches: Iterator[pa.RecordBatch], made: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_LABELLED``: every window, and so many made ones between its surroundings, of either label in turn."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            own = [Finding(w["left"], w["body"], w["right"], w["signed"], w["base"]) for w in batch.slice(start, ROWS).to_pylist()]
            out = []
            for f in own:
                key = f.key()
                around = (_NAME.sub("", f.left), f.right)  # the name before a sign is the made one's own
                out += [f, *made_findings([around], made + 1, key)[key % 2 :][:made]]
            keys = [f.key() for f in out]
            columns = [[getattr(f, k) for f in out] for k in ("left", "body", "right", "signed", "label")] + [[k % 4 == 0 for k in keys], [k >> 2 for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["left", "body", "right", "signed", "label", "kept", "key"])


def labelled_findings(found: DataFrame, made: int = MADE) -> DataFrame:
    """All different windows of ``findings``, and made ones: one for each, and ``made`` in all at least."""
    rows = found.select(F.explode("windows").alias("w")).select("w.base", "w.signed", "w.left", "w.body", "w.right").distinct()
    rows = stash(rows, "op12-windows")
    each = -(-made // max(rows.count(), 1))
    return stash(rows.mapInArrow(lambda it: _labelled(it, each), _LABELLED), "op12-labelled")


def _of(table: pa.Table) -> list[Finding]:
    """The findings of a shard, in an order of their own."""
    rows = sorted(table.select(["key", "left", "body", "right", "signed", "label"]).to_pylist(), key=lambda r: tuple(r.values()))
    return [Finding(r["left"], r["body"], r["right"], r["signed"], r["label"]) for r in rows]


def _exact(value: Column) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(F.round(value * float(UNIT)).cast("decimal(38,0)"))


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def mean_epoch(rows: DataFrame, network: Network, epoch: int) -> None:
    """One epoch: each shard's steps from the network's weights, and the mean of where they end, by the shards' findings."""

    def steps(table: pa.Table) -> pa.Table:
        found, own = _of(table), copy.deepcopy(network)
        own.epoch(found, seed=(SEED, epoch, table.column("shard")[0].as_py()))
        value = _flat(own.p)
        give_back()
        return pa.table({"at": np.arange(len(value), dtype=np.int32), "value": value, "n": np.full(len(value), len(found), np.int64)})

    moved = rows.groupBy("shard").applyInArrow(steps, "at int, value double, n long")
    ends = moved.groupBy("at").agg((_exact(F.col("value") * F.col("n")).cast("double") / F.sum("n") / float(UNIT)).alias("value")).collect()  # the network's weights
    value = np.zeros(len(ends))
    value[[r["at"] for r in ends]] = [r["value"] for r in ends]
    done = 0
    for k, x in network.p.items():
        network.p[k] = value[done : done + x.size].reshape(x.shape)
        done += x.size


def _nth(rows: DataFrame, n: int) -> int:
    """The n-th least (from 0) of the whole numbers ``q``, counted in ever narrower bins: ``BINS`` counts at most come to the driver at once."""
    low, high = rows.agg(F.min("q"), F.max("q")).first()
    while low < high:
        wide = -(-(high - low + 1) // BINS)
        counts = rows.filter(F.col("q").between(low, high)).groupBy(F.floor((F.col("q") - low) / wide).cast("long").alias("bin")).count()
        for r in sorted(counts.collect(), key=lambda r: r["bin"]):
            if n < r["count"]:
                low, high = low + r["bin"] * wide, min(high, low + (r["bin"] + 1) * wide - 1)
                break
            n -= r["count"]
    return low


def calibrate_all(rows: DataFrame, network: Network, recall: float = RECALL) -> None:
    """``Network.calibrate`` on a table of labelled findings of any size: each of Newton's steps is a sum over all, thresholds are found by counting."""

    def logits(table: pa.Table) -> pa.Table:
        found = _of(table)
        out = pa.table({"label": [f.label for f in found], "signed": [f.signed for f in found], "z": network.logits(found)})
        give_back()
        return out

    scored = stash(rows.groupBy("shard").applyInArrow(logits, "label boolean, signed boolean, z double"), "op12-logits")
    counts = {(r["label"], r["signed"]): (r["n"], r["most"]) for r in scored.groupBy("label", "signed").agg(F.count("*").alias("n"), F.max(F.abs("z")).alias("most")).collect()}
    ones, zeros = (sum(n for (label, _), (n, _) in counts.items() if label == x) for x in (True, False))
    if ones and zeros:
        most = max(max(x for _, x in counts.values()), 1e-9)
        x, w = F.col("z") / most, np.zeros(2)
        soft = F.when(F.col("label"), (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2))
        for _ in range(50):
            p = 1 / (1 + F.exp(-(x * float(w[0]) + float(w[1]))))
            own = scored.select(x.alias("x"), (p * (1 - p)).alias("v"), (soft - p).alias("off"))
            terms = ("v * x * x", "v * x", "v", "off * x", "off")
            a, b, c, d, e = (float(s) / UNIT for s in own.agg(*[_exact(F.expr(t)).alias(f"s{i}") for i, t in enumerate(terms)]).first())
            step = np.linalg.solve(np.array([[a, b], [b, c]]) + 1e-3 * np.eye(2), np.array([d, e]) - 1e-3 * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        network.line = (float(w[0] / most), float(w[1]))
    if ones:
        value = F.least(F.greatest(F.col("z") * network.line[0] + network.line[1], F.lit(-500.0)), F.lit(500.0))
        true = stash(scored.filter("label").select("signed", F.round(value * float(UNIT)).cast("long").alias("q")), "op12-true")
        for signed in (False, True):
            n = counts.get((True, signed), (0, 0))[0]
            own, n = (true.filter(F.col("signed") == signed), n) if n >= 20 else (true, ones)
            network.thresholds[signed] = float(1 / (1 + np.exp(-(_nth(own, int((1 - recall) * n)) - 0.5) / UNIT)))


def fit_all(found: DataFrame, made: int = MADE, recall: float = RECALL) -> Network:
    """The network of all different windows of ``findings`` and of made ones, fitted and calibrated in Spark tasks."""
    rows, network = labelled_findings(found, made), Network()
    chars = rows.agg(F.sum(F.length("left") + F.length("body") + F.length("right"))).first()[0]
    if not chars:
        return network
    shards = -(-chars // SHARD)
    rows = rows.withColumn("shard", F.pmod("key", F.lit(shards))).repartition(min(shards, partitions(found.sparkSession)), "shard")
    learnt = rows.filter("not kept")
    if len(learnt.select("label").distinct().collect()) == 2:
        for epoch in range(EPOCHS):
            mean_epoch(learnt, network, epoch)
    calibrate_all(rows.filter("kept"), network, recall)
    return network


@released
def _scan(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    for batch in batches:
        every = batch.column("windows").to_pylist()
        flat = [(i, w) for i, own in enumerate(every) for w in own]
        p = network.probability(network.logits([Finding(w["left"], w["body"], w["right"], w["signed"]) for _, w in flat]))
        added = [[] for _ in every]
        for (i, w), x in zip(flat, p.tolist()):
            if not w["base"] and x >= network.thresholds[w["signed"]]:
                added[i].append({"start": w["start"], "end": w["end"], "probability": x})
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(added, kind)], names=["doc_id", "base", "added"])


def secret_spans(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """One row per input row: doc_id, base (kind, start, end) and added (start, end, probability).  Without a ``network``, one is fitted
    to all of the documents' own findings."""
    found = stash(findings(docs), "op12-findings")
    model = docs.sparkSession.sparkContext.broadcast(network or fit_all(found))
    return found.mapInArrow(lambda it: _scan(it, model.value), _SPANS)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    order = F.array(*map(F.lit, KINDS))
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    extra = F.transform("added", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("place"), F.lit("cnn").alias("kind"), x["end"].alias("end")))
    own = F.transform("base", lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).cast("int").alias("place"), x["kind"].alias("kind"), x["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(join(F.col("base")), 256).alias("base_sha256"),
        join(F.array_sort(F.concat(own, extra))).alias("spans"), F.size("added").cast("long").alias("n_cnn"),
    )


QUERIES = {"op12_secrets": op12_secrets}
SQL: dict[str, str] = {}
