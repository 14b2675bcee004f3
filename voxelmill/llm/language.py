"""Word-level language ID with a linear-chain conditional random field.

Words are maximal runs of letters and their marks (``[\\p{L}\\p{M}]``, from the first letter on), lower-cased.  A word's emission
score for each language is a sum of learned weights: of its prefixes and suffixes of up to ``AFFIX`` bytes and its byte n-grams of
the orders ``ORDERS``, which share 2**``BITS`` hashed slots (fewer with over 64 languages, so that the table stays within
``TABLE_BYTES``), and of its entry in the lexicon, the words that the training sample has twice or more (all others share one entry).
Transitions between languages and the start scores are learned with the emissions by maximising the conditional likelihood with
forward-backward and AdaGrad.  A text's words are labelled by their marginals, so a text may switch
languages; its language is the one with the largest sum of marginals, and the score is that sum's
share.

The model is fitted on a bounded sample: about ``PER_LANGUAGE`` rows of each language, chosen by a hash
of ``doc_id`` among rows that are not held out (crc32 of ``doc_id`` as text not 0 modulo ``FOLDS``), never over twice that many,
of each a piece of ``PIECE`` characters at a random place and of that at most ``WORDS`` words.  Stretches of different rows are joined to
training sequences, so that switches are seen.  Everything else covers all rows and whole texts.

``in_language`` keeps documents whose language is known: with a score of ``SCORE`` or more, and unless their words speak against it: the log-odds of a
text in which a share of ``KNOWN`` of the words is in the lexicon to one in which ``STRAY`` is, over all its words, must not be under -``DOUBT``.  Without that any text
would be given to the language that it resembles most.  The rule is the same for texts of any length: some fifteen words of which none is
known are enough against a text, and a few say little.

Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing can be
learned.  A null ``doc_id`` counts as held out.  Repeated rows each get a result; other columns are
ignored.  A text over ``chunks``' limit is a chunk of its own, at some 30 bytes a byte of it; features and transfer matrices
are in hand in bounded pieces, of one long word too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelmill.llm.quality import held_out
from voxelmill.llm.shared import give_back, released
from voxelmill.llm.textops import PIECE_BYTES, Spans, Words, chunks, column_bytes, mix, span_hashes

AFFIX = 3
ORDERS = (2, 3)
BITS = 18
TABLE_BYTES = 64 << 20
#: Least score of a document whose language is known; shares of words in the lexicon of texts of a language and of others; log-odds against a text.
SCORE, KNOWN, STRAY, DOUBT = 0.35, 0.3, 0.02, 5.0
PER_LANGUAGE = 400
WORDS = 150
#: Characters of a sampled row that are fetched.
PIECE = 3000
EPOCHS = 6
#: Words of a training stretch before the language may change.
STRETCH = (5, 40)
UNKNOWN = "und"
#: Words whose messages are passed along together; chunks meet through their transfer matrices.
STEP = 64
#: Words of a sequence beyond which its messages go by such chunks.
LONG = 4096
#: Numbers of transfer matrices, or features, that are in hand at once; words whose features are.
NUMBERS, BLOCK = 1 << 20, 20_000


def letter_words(column: pa.Array) -> Words:
    """The runs of letters and marks of each text, lower-cased, from their first letter on."""
    text = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")), r"[^\p{L}\p{M}]+", " ")
    data, offsets = column_bytes(text)
    if len(data) and data.max() >= 0xCC:  # below that, there are no marks
        data, offsets = column_bytes(pc.replace_substring_regex(text, r"(^| )\p{M}+", r"\1"))
    return Words(data, offsets)


def word_hashes(words: Words) -> np.ndarray:
    return words.hashes()


def entries(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """The place of each word in the (rising) lexicon; its length for one that is not there."""
    at = np.searchsorted(lexicon, hashes)
    at[at < len(lexicon)] = np.where(lexicon[at[at < len(lexicon)]] == hashes[at < len(lexicon)], at[at < len(lexicon)], len(lexicon))
    return at


def _some(words: Words, which: np.ndarray) -> Words:
    """Some of the words, without their rows, and their bytes alone."""
    out = Words.__new__(Words)
    size = words.end[which] - words.start[which]
    out.end = np.cumsum(size)
    out.start = out.end - size
    out.data = words.data[np.repeat(words.start[which] - out.start, size) + np.arange(int(size.sum()))]
    return out


def features(words: Words, lexicon: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, feature) of all features of all words, some ``NUMBERS`` at a time: hashed slots first, then the lexicon
    and its last entry."""
    data, size, number = words.data, words.end - words.start, np.arange(len(words))
    if len(data) <= PIECE_BYTES:
        hashed = Spans(data.astype(np.uint64) + np.uint64(1), "byte").hash
    else:
        hashed = partial(span_hashes, data)

    def spans() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        for k in range(1, AFFIX + 1):
            long = number[size >= k]
            yield long, words.start[long], words.start[long] + k, k
            yield long, words.end[long] - k, words.end[long], 10 + k
        for k in ORDERS:
            count = np.maximum(size - k + 1, 0)
            stop = np.cumsum(count)
            for i in range(0, int(count.sum()), NUMBERS):
                at = np.arange(i, min(i + NUMBERS, int(stop[-1])))
                which = np.searchsorted(stop, at, "right")
                start = words.start[which] + at - (stop - count)[which]
                yield which, start, start + k, 20 + k

    at, slots, held = [], [], 0
    for which, start, end, kind in spans():
        value = mix(hashed(start, end) + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64)))
        at.append(which)
        slots.append((value >> np.uint64(64 - bits)).astype(np.int64))
        held += len(which)
        if held >= NUMBERS:
            yield np.concatenate(at), np.concatenate(slots)
            at, slots, held = [], [], 0
    own = (1 << bits) + entries(hashed(words.start, words.end), lexicon)
    yield np.concatenate([*at, number]), np.concatenate([*slots, own])


def _emissions(at: np.ndarray, feature: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights[feature, k], n) for k in range(weights.shape[1])], axis=1)


def _normal(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(a.sum(-1, keepdims=True), 1e-300)


def _pass(matrix: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For row-vector messages m_t = m_(t-1) matrix_t from m on, scaled to sum 1, all m_t.

    The sequence is cut into chunks of STEP; each chunk's product is built for all chunks at once, the
    messages at chunk edges follow one by one, and then those inside chunks, again at once.
    """
    n, k, _ = matrix.shape
    pad = -n % STEP
    if pad:
        matrix = np.concatenate([matrix, np.broadcast_to(np.eye(k), (pad, k, k))])
    block = matrix.reshape(-1, STEP, k, k)
    product = block[:, 0]
    for t in range(1, STEP):
        product = product @ block[:, t]
        product = product / product.sum((1, 2), keepdims=True)
    edge = np.empty((len(block), k))
    for c in range(len(block)):
        edge[c] = m
        m = m @ product[c]
        m = m / m.sum()
    out = np.empty((len(block), STEP, k))
    for t in range(STEP):
        edge = _normal(np.einsum("ck,ckl->cl", edge, block[:, t]))
        out[:, t] = edge
    return out.reshape(-1, k)[:n]


def _pass_long(e: np.ndarray, first: np.ndarray, step: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> None:
    """Messages of one long sequence, by chunks within it, of which so many are in hand that their matrices are bounded."""
    n, k = e.shape
    size = max(1, NUMBERS // (k * k * STEP)) * STEP
    m = np.full(k, 1.0 / k)
    for a in range(0, n, size):
        into = step[None] * e[a : a + size, None, :]
        if a == 0:
            into[0] = first * e[0]
        alpha[a : a + size] = _pass(into, m)
        m = alpha[min(a + size, n) - 1]
    # Backwards, word t hands on step @ (e_(t+1) * beta_(t+1)); the last word has 1.
    m = np.full(k, 1.0 / k)
    for b in range(n, 0, -size):
        a = max(0, b - size)
        ahead, onward = e[a + 1 : b + 1], np.ones((b - a, k, k))
        onward[: len(ahead)] = step.T[None] * ahead[:, :, None]
        beta[a:b] = _pass(onward[::-1], m)[::-1]
        m = beta[a]


def _pass_short(e: np.ndarray, head: np.ndarray, size: np.ndarray, first: np.ndarray, step: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> None:
    """Messages of sequences at ``head`` of ``size`` words, word by word in all of them at once."""
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    tail = head + size - 1
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")  # longer than t
    ahead = back = None
    for t, m in enumerate(alive.tolist()):
        at = head[:m] + t
        ahead = _normal((first if t == 0 else ahead[:m] @ step) * e[at])
        alpha[at] = ahead
        at = tail[:m] - t
        back = np.full((m, len(first)), 1 / len(first)) if t == 0 else _normal((back[:m] * e[at + 1]) @ step.T)
        beta[at] = back


def forward_backward(emission: np.ndarray, begins: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of sequences laid end to end; ``begins`` marks first words.

    Emission, start and transition are scores (logarithms).  Marginals are forward times backward,
    normalised.
    """
    e = np.exp(emission - emission.max(1, keepdims=True))
    step, first = np.exp(transition - transition.max()), np.exp(start - start.max())
    head = np.flatnonzero(begins)
    size = np.diff(np.append(head, len(e)))
    alpha, beta = np.empty_like(e), np.empty_like(e)
    long = size > LONG
    _pass_short(e, head[~long], size[~long], first, step, alpha, beta)
    for a, n in zip(head[long].tolist(), size[long].tolist()):
        _pass_long(e[a : a + n], first, step, alpha[a : a + n], beta[a : a + n])
    return alpha, beta


class Model:
    """Weights of features, transitions and start, the language of each column, and the lexicon's hashes."""

    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray, start: np.ndarray, lexicon: np.ndarray, bits: int):
        self.languages, self.weights, self.transition, self.start = languages, weights.astype(np.float32), transition, start
        self.lexicon, self.bits = lexicon, bits

    def marginals(self, words: Words) -> np.ndarray:
        """For each word, the probability of each language given its whole text."""
        if not len(words):
            return np.zeros((0, len(self.languages)))
        _, first, back = np.unique(word_hashes(words), return_index=True, return_inverse=True)
        blocks = []
        for i in range(0, len(first), BLOCK):
            own = _some(words, first[i : i + BLOCK])
            blocks.append(sum(_emissions(at, feature, self.weights, len(own)) for at, feature in features(own, self.lexicon, self.bits)))
        emission = np.concatenate(blocks)[back]
        begins = np.zeros(len(words), bool)
        begins[words.first[:-1][np.diff(words.first) > 0]] = True
        alpha, beta = forward_backward(emission, begins, self.start, self.transition)
        return _normal(alpha * beta)

    def known(self, words: Words) -> np.ndarray:
        """Whether each word is in the lexicon."""
        return entries(word_hashes(words), self.lexicon) < len(self.lexicon)


def train(texts: list[str], labels: list[str], seed: int = 17, epochs: int = EPOCHS) -> Model:
    """Fits the field on whole texts, each of one language."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k = len(languages)
    words = letter_words(pa.array(texts, pa.string()))
    taken, stretches, n = [], [], 0
    for row, label in enumerate(labels):
        a, b = int(words.first[row]), int(words.first[row + 1])
        if b - a > WORDS:
            a += int(rng.integers(0, b - a - WORDS + 1))
            b = a + WORDS
        taken.append(np.arange(a, b))
        while a < b:
            c = min(b, a + int(rng.integers(*STRETCH)))
            stretches.append((n, n + c - a, languages.index(label)))
            n, a = n + c - a, c
    chosen, counts, parts = np.concatenate(taken), [], []
    seen, times = np.unique(word_hashes(_some(words, chosen)), return_counts=True)
    lexicon = seen[times > 1]
    bits = min(BITS, int(np.log2(TABLE_BYTES / 4 / k)))
    for i in range(0, n, BLOCK):
        at, feature = map(np.concatenate, zip(*features(_some(words, chosen[i : i + BLOCK]), lexicon, bits)))
        counts.append(np.bincount(at, minlength=min(BLOCK, n - i)))
        parts.append(feature[np.argsort(at, kind="stable")].astype(np.int32))
    feature, edge = np.concatenate(parts or [np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))])
    del words, parts, chosen, taken
    weights, transition, start = np.zeros(((1 << bits) + len(lexicon) + 1, k)), np.zeros((k, k)), np.zeros(k)
    g_weights, g_transition, g_start = np.full_like(weights, 1e-2), np.full_like(transition, 1.0), np.full_like(start, 1.0)
    rate = 0.3
    for _ in range(epochs):
        order = rng.permutation(len(stretches))
        for i in range(0, len(order), 256):
            batch = [stretches[j] for j in order[i : i + 256]]
            number = np.concatenate([np.arange(a, b) for a, b, _ in batch])
            truth = np.concatenate([np.full(b - a, y) for a, b, y in batch])
            count = edge[number + 1] - edge[number]
            pick = np.repeat(edge[number] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            local, f = np.repeat(np.arange(len(number)), count), feature[pick]
            emission = _emissions(local, f, weights, len(number))
            begins = np.zeros(len(number), bool)
            sizes = np.array([b - a for a, b, _ in batch])
            begins[np.concatenate([[0], np.cumsum(sizes)[:-1]])[::4]] = True  # four stretches are one sequence
            alpha, beta = forward_backward(emission, begins, start, transition)
            gamma = _normal(alpha * beta)
            off = gamma.copy()
            off[np.arange(len(truth)), truth] -= 1
            inner = np.flatnonzero(~begins)
            e = np.exp(emission - emission.max(1, keepdims=True))
            pair = alpha[inner - 1][:, :, None] * np.exp(transition - transition.max())[None] * (e[inner] * beta[inner])[:, None, :]
            pair = pair / pair.sum((1, 2), keepdims=True)
            d_transition = pair.sum(0)
            np.subtract.at(d_transition, (truth[inner - 1], truth[inner]), 1)
            d_start = off[begins].sum(0)
            touched, where = np.unique(f, return_inverse=True)
            d = np.stack([np.bincount(where, off[local, c], len(touched)) for c in range(k)], axis=1) + 1e-4 * weights[touched]
            g_weights[touched] += d * d
            weights[touched] -= rate * d / np.sqrt(g_weights[touched])
            for value, grad, store in ((transition, d_transition + 0.1 * transition, g_transition), (start, d_start + 0.1 * start, g_start)):
                store += grad * grad
                value -= rate * grad / np.sqrt(store)
    return Model(languages, weights, transition, start, lexicon, bits)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model of a bounded sample of labelled rows; None if there are none."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"]))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Of a sampled row, a piece at a random place, in which WORDS words are taken.
    cut = F.col("text").substr((F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.char_length("text") - PIECE, F.lit(1))) + 1).cast("int"), F.lit(PIECE))
    sample = rows.filter(chance < F.try_element_at(share, F.col("lang"))).select("doc_id", F.xxhash64("text").alias("uid"), cut.alias("text"), "lang", chance.alias("chance"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "doc_id", "uid"))  # only rows that repeat an id make it large
    sample = sample.withColumn("place", place).filter(F.col("place") <= 2 * per_language).select("doc_id", "text", "lang").collect()
    sample = sorted(sample, key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample]) if sample else None


def _scores(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of each text, its share of the marginals, and the log-odds of its words in the lexicon."""
    n = len(texts)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    words = letter_words(texts)
    count = np.diff(words.first)
    gamma, rows = model.marginals(words), words.rows()
    total = np.stack([np.bincount(rows, g, n) for g in gamma.T], axis=1)
    best = total.argmax(1)
    score = np.where(count > 0, np.clip(total[np.arange(n), best] / np.maximum(count, 1), 0, 1), 0.0)
    known = np.bincount(rows, model.known(words), n)
    odds = known * np.log(KNOWN / STRAY) + (count - known) * np.log((1 - KNOWN) / (1 - STRAY))
    return [model.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), count.tolist())], score, odds


@released
def _identify(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        pred, score, _ = _scores(batch.column("text"), model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


@released
def _label(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        words = letter_words(batch.column("text"))
        best = model.marginals(words).argmax(1).tolist() if len(words) else []
        spelled = [words.data[a:b].tobytes().decode() for a, b in zip(words.start.tolist(), words.end.tolist())]
        edge = words.first.tolist()
        lists = {"words": [spelled[a:b] for a, b in zip(edge, edge[1:])], "langs": [[model.languages[x] for x in best[a:b]] for a, b in zip(edge, edge[1:])]}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.list_(pa.string())) for v in lists.values())], names=["doc_id", *lists])


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, words (runs of letters, lower-cased), langs (the label of each)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _label(it, sent.value), "doc_id long, words array<string>, langs array<string>")


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.  Without a model, one is fitted."""
    model = model or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _identify(it, sent.value), "doc_id long, held_out boolean, lang_pred string, score double")


def in_language(docs: DataFrame, least: float = SCORE, doubt: float = DOUBT) -> DataFrame:
    """The documents, with all their columns, of which a language is known: with this score or more, and log-odds of their words not
    under -``doubt``.

    Only texts go to Python and only decisions come back; the other columns stay in the JVM.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))
    give_back()  # what the fit held on the driver

    @F.arrow_udf("boolean")
    @released
    def known(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            keep: list[bool] = []
            for part in chunks(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text"):
                pred, score, odds = _scores(part.column("text"), sent.value)
                keep += [p != UNKNOWN and s >= least and o >= -doubt for p, s, o in zip(pred, score.tolist(), odds.tolist())]
            yield pa.array(keep, pa.bool_())

    return docs.filter(known(F.col("text")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_language": op8_language}
SQL: dict[str, str] = {}
