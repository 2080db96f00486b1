"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared after lower-casing ASCII and turning each run of other ASCII characters than letters and
digits into one space.  An item of m bytes has an error budget of e = floor(RATE * m) edits and is split into e + 1
pieces: whatever lies within e edits of it holds one piece unchanged.  One Aho-Corasick pass over a text finds all exact
piece hits; hits on neighbouring diagonals form one region, and Myers' bit-parallel distance decides each region exactly.

The benchmark is used in blocks of at most ``BLOCK_BYTES``, so what is sent to the workers is bounded; every block is held
against every document.

``item_id`` must be of an integer type.  Edge cases: null or empty texts have no match; items without letters or digits take no
part; an item without an id is searched like any other and reported with a null id; of several occurrences
the one with the least distance counts, then the first; repeated rows are reported each; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

RATE = 0.06
BLOCK_BYTES = 2 << 20

_MAP = np.full(256, 32, np.uint8)
_MAP[48:58] = np.arange(48, 58)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def normalised(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and the place of each in the original."""
    low = _MAP[data]
    keep = np.flatnonzero((low != 32) | (np.concatenate([[33], low[:-1]]) != 32)) if len(low) else np.zeros(0, np.int64)
    return low[keep], keep


class Pattern:
    def __init__(self, text: bytes) -> None:
        self.m, self.top, self.full = len(text), 1 << (len(text) - 1), (1 << len(text)) - 1
        self.eq: dict[int, int] = {}
        for i, c in enumerate(text):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def scan(self, text: bytes, anchored: bool = False):
        """Least distance of the pattern to a stretch of text, and where the first such stretch ends.

        The stretch may begin anywhere, or at the start of the text only if ``anchored``.
        """
        pv, mv, score, best, at = self.full, 0, self.m, self.m, 0
        eq, full, top, first = self.eq.get, self.full, self.top, 1 if anchored else 0
        for i, c in enumerate(text):
            x = eq(c, 0)
            xv = x | mv
            xh = (((x & pv) + pv) ^ pv) | x
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | first) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, at = score, i + 1
        return best, at


class Matcher:
    """All items of one block: automaton of pieces and bit patterns."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float) -> None:
        self.items, self.budget, self.pieces = [], [], ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalised(np.frombuffer(raw, np.uint8))[0].tobytes().strip()
            if not text:
                continue
            e = int(rate * len(text))
            n, m = len(self.items), len(text)
            self.items.append((item_id, text, Pattern(text), Pattern(text[::-1])))
            self.budget.append(e)
            for j in range(e + 1):
                a, b = m * j // (e + 1), m * (j + 1) // (e + 1)
                held.setdefault(text[a:b].decode("latin-1"), []).append((n, a))
        for piece, places in held.items():
            self.pieces.add_word(piece, (len(piece), places))
        if held:
            self.pieces.make_automaton()
        self.seen: OrderedDict = OrderedDict()

    def find(self, data: np.ndarray):
        """(item number, distance, start, end) in normalised bytes, one for each item that lies in the text."""
        if not self.items:
            return []
        raw = data.tobytes()
        hits: dict[int, set[int]] = {}
        for end, (size, places) in self.pieces.iter(raw.decode("latin-1")):
            for n, a in places:
                hits.setdefault(n, set()).add(end + 1 - size - a)
        found = []
        for n, diagonals in hits.items():
            e, (_, text, _, _) = self.budget[n], self.items[n]
            best, at = None, sorted(diagonals)
            i = 0
            while i < len(at):
                j = i
                while j + 1 < len(at) and at[j + 1] - at[j] <= 2 * e + 1 and at[j + 1] - at[i] <= len(text):
                    j += 1
                lo, hi = max(0, at[i] - e), min(len(raw), at[j] + len(text) + e)
                d, s, t = self._verify(n, raw[lo:hi])
                if d <= e and (best is None or d < best[0]):
                    best = (d, lo + s, lo + t)
                i = j + 1
            if best:
                found.append((n, *best))
        return found

    def _verify(self, n: int, region: bytes):
        key = (n, region)
        got = self.seen.get(key)
        if got is None:
            _, _, forward, backward = self.items[n]
            d, t = forward.scan(region)
            s = t - backward.scan(region[:t][::-1], anchored=True)[1] if d <= self.budget[n] else 0
            got = self.seen[key] = (d, s, t)
            if len(self.seen) > 4096:
                self.seen.popitem(last=False)
        return got


_matchers: dict[str, Matcher] = {}


def _matcher(token: str, items, rate: float) -> Matcher:
    if token not in _matchers:
        _matchers.clear()
        _matchers[token] = Matcher(items, rate)
    return _matchers[token]


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Lists of (item_id, text bytes), each of about ``block_bytes`` at most (a longer item is a block of its own)."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    now, size = [], 0
    for r in items.distinct().orderBy("item_id", "text").toLocalIterator():
        raw = bytes(r["text"])
        if now and size + len(raw) > block_bytes:
            yield now
            now, size = [], 0
        now.append((r["item_id"], raw))
        size += len(raw)
    if now:
        yield now


def matches(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start and end (code points of the original text) of each item found in each document."""
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id bigint, distance int, start bigint, `end` bigint"
    out = None
    for block in blocks_of(benchmark, block_bytes):
        found = documents.select("doc_id", "text").mapInArrow(_scanner(spark.sparkContext.broadcast(block), rate), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def _scanner(sent, rate: float):
    token = uuid.uuid4().hex

    def run(batches):
        matcher = _matcher(token, sent.value, rate)
        for batch in batches:
            for part, data, off in chunks(batch):
                ids = part.column("doc_id").to_pylist()
                rows = []
                for r in range(len(off) - 1):
                    own = data[off[r] : off[r + 1]]
                    text, place = normalised(own)
                    got = matcher.find(text)
                    if got:
                        lead = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                        rows += [(ids[r], matcher.items[n][0], d, int(lead[place[s]]), int(lead[place[t - 1] + 1]) if t else 0) for n, d, s, t in got]
                a = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(a[0], part.schema.field("doc_id").type), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int32()), pa.array(a[3], pa.int64()), pa.array(a[4], pa.int64())], ["doc_id", "item_id", "distance", "start", "end"])

    return run


def clean(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item lies; all columns, no shuffle."""
    for block in blocks_of(benchmark, block_bytes):
        documents = documents.mapInArrow(_sieve(documents.sparkSession.sparkContext.broadcast(block), rate), documents.schema)
    return documents


def _sieve(sent, rate: float):
    token = uuid.uuid4().hex

    def run(batches):
        matcher = _matcher(token, sent.value, rate)
        for batch in batches:
            for part, data, off in chunks(batch):
                good = [not matcher.find(normalised(data[off[r] : off[r + 1]])[0]) for r in range(len(off) - 1)]
                yield part.filter(pa.array(good, pa.bool_()))

    return run


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
