"""Helpers shared by the training-data operators.

Everything that handles text in Python does so through Arrow batches cut into
bounded byte chunks, so a worker's memory depends on the longest single text
and never on the number of rows of a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.scratch import discard, stored  # noqa: F401 - the operators' own door to it

CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as -1 (never a learning row)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(-1))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, condition: Column, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label) that meet ``condition``.

    The sample is the ``rows`` smallest hashes of doc_id, so it is the same for any layout.  Its ids
    are joined by broadcast, which the bound makes safe.  Several labels of one id count as their minimum.
    """
    ids = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & condition)
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    )
    return documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def with_field(schema: T.StructType, name: str, kind: str) -> T.StructType:
    """A copy of ``schema`` with one more column (``StructType.add`` would change the frame's own)."""
    return T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(kind))])


# ---------------------------------------------------------------- Arrow text


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; nulls count as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES):
    """Cut a batch into slices of whole rows with about ``limit`` bytes of text: (slice, bytes, offsets)."""
    data, off = text_buffers(batch.column(batch.schema.get_field_index(name)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        if n <= CHUNK_BYTES + (1 << 16):
            _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Polynomial hashes of spans of one byte buffer, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), dtype=np.uint64, out=self.prefix[1:])
        self.back = powers(_INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) + np.uint64(salt << 40))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(data)(starts, ends)


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of non-separator bytes; runs never cross rows."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    step = np.diff(inside)
    first = step[: len(data)] == 1
    last = step[1:] == -1
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    word = inside[1:-1].astype(bool)
    first[cut] |= word[cut]
    last[cut - 1] |= word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of byte-wise counts over each row."""
    out = np.zeros(len(off) - 1, np.float64)
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, off[some], dtype=np.int64)
    return out


# ---------------------------------------------------------------- fitting


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, weight: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Newton's method for mean logistic loss with an L2 penalty (rows with y=1 only are fine)."""
    n, f = x.shape
    w = np.zeros(f)
    v = np.ones(n) if weight is None else weight
    v = v / max(v.sum(), 1e-12)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (v * (p - y)) + l2 * w
        h = (x * (v * p * (1 - p))[:, None]).T @ x + (l2 + 1e-9) * np.eye(f)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / max(np.linalg.norm(step), 1e-12))
        if np.linalg.norm(step) < 1e-8:
            break
    return w
