"""Fill-in-middle transformation: a text is cut at two code points and its middle moved to the end.

Cuts are found without decoding.  The bytes of a batch are read as 64-bit words; in each word, arithmetic marks the bytes that end
a code point (those before a byte that is no continuation), the marks are counted (``bitwise_count``), the words' counts are summed,
the word that holds a wanted code point is searched in the sums, and which of its eight bytes it is follows from sums of
marks inside the word.

Positions and forms come from the hex SHA-256 of ``1:`` and the decimal ``doc_id``, so reruns and any partitioning agree.  A text
that is empty or holds a sentinel stays plain, as does one in ten of the others; of the rest, one in five has its suffix first.

Each row is transformed alone, without a shuffle.  A null text is empty; a null ``doc_id`` hashes as ``1:`` alone; repeated rows get
the same result each; empty tables give no rows; other columns, whatever their names, are not looked at.  Texts are whole: some
megabytes at a time, a longer one a chunk of its own, at some six bytes a byte of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.shared import released
from voxelmill.llm.textops import Units, chunks, column_bytes

SENTINELS = PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, those from the first number on stay plain, and of the others those under the second have the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of the hash of an id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transformed(ids: list, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """n, form, prefix_chars, middle_chars, output of each text of a buffer."""
    units = Units(data)
    base = units.rank(offsets)
    count = np.diff(base)
    h = np.array([draws(i) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (count + 1)[:, None], axis=1)
    at = np.where(cuts > 0, units.select(base[:-1, None] + cuts), offsets[:-1, None])
    plain = (count == 0) | (h[:, 2] % 100 >= PLAIN_FROM)
    backward = h[:, 3] % 100 < SUFFIX_FIRST
    whole = data.tobytes()
    for i in range(len(ids)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        text = whole[a:b]
        if plain[i] or any(s in text for s in SENTINELS):
            yield int(count[i]), "plain", None, None, text
            continue
        p, m = int(at[i, 0]) - a, int(at[i, 1]) - a
        first, second, third = text[:p], text[p:m], text[m:]
        out = SUFFIX + third + PREFIX + first + MIDDLE + second if backward[i] else PREFIX + first + SUFFIX + third + MIDDLE + second
        yield int(count[i]), "spm" if backward[i] else "psm", int(cuts[i, 0]), int(cuts[i, 1] - cuts[i, 0]), out


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of, from it and its form alone."""
    if form == "plain":
        return output
    lead, inner = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    first, rest = output[len(lead) :].split(inner, 1)
    second, middle = rest.split(MIDDLE, 1)
    return second + middle + first if form == "spm" else first + middle + second


@released
def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    for batch in chunks(batches, "text"):
        ids = batch.column("doc_id").to_pylist()
        columns = [ids, *zip(*transformed(ids, *column_bytes(batch.column("text"))))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n (code points), form, prefix_chars, middle_chars (null if plain), output (UTF-8)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_transform, _OUT)


@released
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [hashlib.sha256(x.as_py()).hexdigest() for x in batch.column("output")]
        back = [hashlib.sha256(restored(x.as_py(), f.as_py())).hexdigest() for x, f in zip(batch.column("output"), batch.column("form"))]
        keep = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string()), pa.array(back, pa.string())], names=[*keep, "output_sha256", "restored_sha256"])


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.mapInArrow(_digest, _OUT.replace("output binary", "output_sha256 string, restored_sha256 string"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS keep, ('0x' || h[25:32])::BIGINT % 100 AS turn FROM d),
p AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR keep >= 90 THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""

QUERIES = {"op13_fill_middle": op13_fill_middle}
SQL = {"op13_fill_middle": ORACLE}
