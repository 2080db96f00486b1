"""Removal of repeated passages: a hash-compared suffix sort over anchored stretches.

A byte goes if it lies in a string of ``WINDOW`` bytes that also starts earlier (smaller doc_id, or the same document and an
earlier start).

1. *Anchors.*  Each window's anchor is its leftmost ``GRAM``-byte substring of least hash, so equal windows have equal anchors at
   equal offsets.  Neighbouring windows share their anchor; such a run, about 39 windows, is one stretch of bytes.
2. *Suffix sort.*  Of the stretches of one anchor, those of one length are compared whole: the suffixes at their starts are put
   in order by mergesort, in which prefix polynomial hashes and a binary search give the common extension of two suffixes and so
   their order in a logarithmic number of steps.  Neighbours whose extension covers the stretch are equal once their bytes have
   been compared too.  Stretches that differ (where a shared passage begins or ends, or a copy was edited) may still share
   windows: their windows are classed by the anchor's place in quarters, all windows of a class hold the same 81 bytes about
   the anchor, and where two stretches agree on these, the suffixes at the windows of that class are sorted and compared likewise.
   All equal strings but the first (least document, then place) are repeats.
3. *Twice.*  Stretches overlap, so only those whose anchor occurs elsewhere are worth sending: 32-bit keys of all anchors are
   counted first, and each document bucket is told which of its anchors are shared.  The sort runs over these within the
   document bucket, so that a passage in a third of all documents leaves a bucket once; what is first there is dealt with its bytes
   by a hash of its anchor and sorted again.  The repeats are sent back to their documents as notes.

Hashes only bring candidates together and order them; what is removed has been compared byte by byte.  A task holds its
bucket's share, at most one copy of a stretch from each document bucket; sorting buffers are cut at whole anchors (``SORT_BYTES``).

``doc_id`` must be of an integer type.  Edge cases: null and empty texts have no bytes and the hash of nothing; texts under
``WINDOW`` bytes are kept whole; null ids come after all others and are one document; rows of one doc_id count as one document
at equal places (a fully repeated row is not a repeat of itself, each row is returned); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, chunks, mix, partitions, powers, table

WINDOW = 100
GRAM = 24
CLASSES = 4
STEP = (WINDOW - GRAM) // CLASSES  # places of the anchor in a window, cut into classes
BLOCK = 1 << 18
CHUNK = 8 << 20
SORT_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
_PLACE = np.uint64((1 << 28) - 1)

# d: id, z: null id, v: hash of the whole text, p: place, n: windows, o: place of the anchor in the stretch
ROW = np.dtype([("d", "<i8"), ("v", "<u8"), ("p", "<u4"), ("n", "u1"), ("o", "u1"), ("z", "u1")])
NOTE = np.dtype([("d", "<i8"), ("v", "<u8"), ("p", "<u4"), ("n", "<u4"), ("z", "u1")])


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = part.column("doc_id")
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _versions(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each text: tells rows of one doc_id apart."""
    raw = memoryview(data)
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[off[i] : off[i + 1]]) for i in range(len(off) - 1)), np.uint64, len(off) - 1)


def _dealt(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n)).astype(np.int64)


def _pack(rows: np.ndarray, tail: bytes = b"") -> bytes:
    """Rows column by column, ids and places as differences, and the bytes that follow, compressed."""
    parts = [np.diff(rows[f], prepend=rows[f].dtype.type(0)) if f in ("d", "p") else rows[f] for f in rows.dtype.names]
    return zstandard.ZstdCompressor(level=1).compress(len(rows).to_bytes(8, "little") + b"".join(np.ascontiguousarray(x).tobytes() for x in parts) + tail)


def _unpack(raw: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    out = np.zeros(int(raw[:8].view(np.int64)[0]), kind)
    at = 8
    for f in kind.names:
        size = kind[f].itemsize * len(out)
        own = np.frombuffer(raw[at : at + size].tobytes(), kind[f])
        out[f] = np.cumsum(own, dtype=own.dtype) if f in ("d", "p") else own
        at += size
    return out, raw[at:]


def _by_bucket(bucket: np.ndarray, rows: np.ndarray):
    """(bucket, numbers of its rows by document and place) of each bucket."""
    order = np.lexsort((rows["p"], rows["v"], rows["d"], bucket))
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    for i, j in zip(cut, np.r_[cut[1:], len(b)], strict=False):
        yield int(b[i]), order[i:j]


def _bytes_of(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``data`` one after another."""
    return data[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def runs_of(data: np.ndarray, off: np.ndarray):
    """Row, place in the data, number of windows and place of the anchor in the run of each run, block by block."""
    span = WINDOW - GRAM + 1
    for b0 in range(0, len(data), BLOCK):
        part = data[b0 : min(len(data), b0 + BLOCK + WINDOW - 1)]
        starts = min(BLOCK, len(data) - b0)
        if len(part) < WINDOW:
            continue
        at = np.arange(len(part) - GRAM + 1)
        least = (Spans(part)(at, at + GRAM) & ~_PLACE) | at.astype(np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        s = np.arange(min(starts, len(least)))
        row = np.searchsorted(off, s + b0, side="right") - 1
        s = s[s + b0 + WINDOW <= off[row + 1]]
        if not len(s):
            continue
        anchor = (least[s] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)])
        last = np.r_[first[1:], len(s)] - 1
        lo = s[first]
        yield np.searchsorted(off, lo + b0, side="right") - 1, lo + b0, last - first + 1, anchor[first] - lo


def _class(c: int, n: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of class c of runs of n windows whose anchor is at o."""
    far = o - (WINDOW - GRAM if c == CLASSES - 1 else c * STEP + STEP - 1)  # window of the class with the anchor farthest in
    first = np.maximum(far, 0)
    return first, np.minimum(n - 1, o - c * STEP) - first + 1


class Suffixes:
    """Order and common extensions of suffixes of one buffer, by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        base = 0xD1342543DE82EF95
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n)[:n], dtype=np.uint64, out=self.prefix[1:])
        self.lift = powers(base, n + 1)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the first ``size`` bytes agree, by hash: the earlier one's is lifted to the later one's power."""
        ha, hb = self.prefix[a + size] - self.prefix[a], self.prefix[b + size] - self.prefix[b]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        early, late = np.where(a <= b, ha, hb), np.where(a <= b, hb, ha)
        return early * self.lift[hi - lo] == late

    def extension(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Common extension of suffixes a and b, up to ``size``: the whole first, then binary search on hashes."""
        high = np.array(size, np.int64)
        low = np.where(self.same(a, b, high), high, 0)
        high = np.where(low == high, high, high - 1)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) >> 1
            ok = self.same(a[open_], b[open_], mid)
            low[open_] = np.where(ok, mid, low[open_])
            high[open_] = np.where(ok, high[open_], mid - 1)

    def before(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b within ``size`` bytes."""
        e = self.extension(a, b, size)
        inside = np.minimum(e, size - 1)
        return (e < size) & (self.data[a + inside] < self.data[b + inside])

    def sort(self, at: np.ndarray, group: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order of suffixes ``at`` within groups (sorted group numbers; one ``size`` a group): bottom-up mergesort, all merges
        of a level at once; runs that are in order already are left alone."""
        n = len(at)
        order = np.arange(n)
        begin = np.searchsorted(group, group, "left")
        many = np.searchsorted(group, group, "right") - begin
        width = 1
        while n and width < many.max():
            heads = np.flatnonzero((many > width) & ((np.arange(n) - begin) % (2 * width) == 0) & (np.arange(n) - begin + width < many))
            mid = heads + width
            wrong = self.before(at[order[mid]], at[order[mid - 1]], size[heads])
            heads, mid = heads[wrong], mid[wrong]
            end = np.minimum(heads + 2 * width, begin[heads] + many[heads])
            busy = np.repeat(heads - (np.cumsum(end - heads) - (end - heads)), end - heads) + np.arange(int((end - heads).sum()))
            base, mid, end = (np.repeat(x, end - heads) for x in (heads, mid, end))
            left = busy < mid
            lo = np.where(left, mid, base)
            hi = np.where(left, end, mid)
            own, floor, cap = at[order[busy]], lo.copy(), size[busy]
            while True:  # rank of each suffix in the other run
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                m = (lo[open_] + hi[open_]) >> 1
                other = at[order[m]]
                side = left[open_]
                x, y = np.where(side, other, own[open_]), np.where(side, own[open_], other)
                less = self.before(x, y, cap[open_])
                goes = np.where(side, less, ~less)  # stable
                lo[open_] = np.where(goes, m + 1, lo[open_])
                hi[open_] = np.where(goes, hi[open_], m)
            target = base + (busy - np.where(left, base, mid)) + (lo - floor)
            moved = order[busy]
            order = order.copy()
            order[target] = moved
            width *= 2
        return order

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Suffixes that agree on their first ``size`` bytes: by extension, then byte by byte."""
        out = np.zeros(len(a), bool)
        hit = np.flatnonzero(self.extension(a, b, size) >= size)
        for s in range(0, len(hit), 1 << 15):
            h = hit[s : s + (1 << 15)]
            different = _bytes_of(self.data, a[h], size[h]) != _bytes_of(self.data, b[h], size[h])
            owner = np.repeat(np.arange(len(h)), size[h])
            out[h] = np.bincount(owner, weights=different, minlength=len(h)) == 0
        return out

    def leads(self, at: np.ndarray, group: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first in the given order among the equal suffixes of the same group, for each (group numbers are sorted)."""
        order = self.sort(at, group, size)
        a = at[order]
        next_ = np.flatnonzero(group[1:] == group[:-1])
        head = np.ones(len(a), bool)
        head[next_ + 1] = ~self.equal(a[next_ + 1], a[next_], size[next_])
        out = np.zeros(len(a), np.int64)
        out[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        return out


def _words(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of the ``size`` bytes (a multiple of 8) from each place on."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    out = np.zeros(len(at), np.uint64)
    for j in range(0, size, 8):
        out = mix((out ^ eight[at + j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first counts most) and the number of each element's group in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def repeats(data: np.ndarray, at: np.ndarray, key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of the stretches at ``at`` repeat an earlier one: (stretch, first window, number of windows).

    key: of each stretch's anchor; rows: ids and places, as ROW.
    """
    data = np.ascontiguousarray(data)
    s = Suffixes(data)
    d, z, p, n, o = rows["d"], rows["z"], rows["p"].astype(np.int64), rows["n"].astype(np.int64), rows["o"].astype(np.int64)
    rank = np.empty(len(at), np.int64)  # by document and place; equal ones share the rank
    order, number = _groups(z, d, p)
    rank[order] = number
    some = np.unique(key, return_inverse=True, return_counts=True)
    shared = some[2][some[1]] > 1
    later = np.zeros(len(at), bool)
    if not shared.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.flatnonzero(shared)
    x = x[np.lexsort((rank[x], n[x], key[x]))]
    _, group = _groups(key[x], n[x])  # already in order
    lead = x[s.leads(at[x], group, n[x] + WINDOW - 1)]
    later[x] = rank[x] != rank[lead]
    # stretches of one anchor that remain and differ
    rest = x[~later[x]]
    stretch, window, cell = [], [], []
    cells = 0
    for c in range(CLASSES):
        first, many = _class(c, n[rest], o[rest])
        own = rest[many > 0]
        first, many = first[many > 0], many[many > 0]
        begin = at[own] + o[own] - c * STEP
        core = mix(_words(data, begin, 80) ^ key[own])
        order, group = _groups(core)
        size = np.bincount(group, minlength=1)[group] if len(group) else group
        own, first, many, group = own[order][size > 1], first[order][size > 1], many[order][size > 1], group[size > 1]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        stretch.append(np.repeat(own, many))
        window.append(np.repeat(first, many) + inner)
        cell.append(np.repeat(group, many) + cells)
        cells += int(group[-1]) + 1 if len(group) else 0
    stretch, window, cell = np.concatenate(stretch), np.concatenate(window), np.concatenate(cell)
    if len(stretch):
        # equal windows have their anchor at equal offsets
        place = p[stretch] + window
        order = np.lexsort((place, d[stretch], z[stretch], o[stretch] - window, cell))
        stretch, window, cell, place = stretch[order], window[order], cell[order], place[order]
        _, group = _groups(cell, o[stretch] - window)
        lead = s.leads(at[stretch] + window, group, np.full(len(stretch), WINDOW))
        gone = (d[stretch] != d[stretch][lead]) | (z[stretch] != z[stretch][lead]) | (place != place[lead])
        stretch, window = stretch[gone], window[gone]
        order = np.lexsort((window, stretch))
        stretch, window = stretch[order], window[order]
        new = np.flatnonzero(np.r_[True, (stretch[1:] != stretch[:-1]) | (window[1:] != window[:-1] + 1)]) if len(stretch) else np.zeros(0, np.int64)
        stretch, window, count = stretch[new], window[new], np.diff(np.r_[new, len(stretch)])
    else:
        count = window
    whole = np.flatnonzero(later)
    return np.concatenate([whole, stretch]), np.concatenate([np.zeros(len(whole), np.int64), window]), np.concatenate([n[whole], count])


def _left(n: np.ndarray, which: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of stretches of n windows that are not among the given ones: (stretch, first window, number)."""
    edge = np.cumsum(n + 1) - (n + 1)
    step = np.zeros(int((n + 1).sum()) + 1, np.int32)
    np.add.at(step, edge, 1)
    np.add.at(step, edge + n, -1)
    np.add.at(step, edge[which] + first, -1)
    np.add.at(step, edge[which] + first + count, 1)
    on = np.cumsum(step[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, on, False]))
    lo, hi = turn[::2], turn[1::2]
    row = np.searchsorted(edge, lo, side="right") - 1
    return row, lo - edge[row], hi - lo


def _notes(rows: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Repeated windows of documents; neighbouring ones joined."""
    p = rows["p"].astype(np.int64) + first
    order = np.lexsort((p, rows["v"], rows["z"], rows["d"]))
    rows, p, count = rows[order], p[order], count[order]
    new = np.ones(len(p), bool)
    new[1:] = (rows["d"][1:] != rows["d"][:-1]) | (rows["z"][1:] != rows["z"][:-1]) | (rows["v"][1:] != rows["v"][:-1]) | (p[1:] != (p + count)[:-1])
    at = np.flatnonzero(new)
    out = np.zeros(len(at), NOTE)
    for f in ("d", "v", "z"):
        out[f] = rows[f][at]
    out["p"], out["n"] = p[at], np.add.reduceat(count, at) if len(at) else 0
    return out


def _packed_notes(notes: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    got = [(b, _pack(notes[i])) for b, i in _by_bucket(_dealt(notes["d"], buckets), notes)]
    return [b for b, _ in got], [x for _, x in got]


def _keyed(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each anchor, and 32 bits that tell the anchors of a bucket apart (chance agreement costs a comparison)."""
    h = mix(key)
    return (h % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32)


KEY = np.dtype([("b", "<u4"), ("k", "<u4")])


def _anchors(buckets: int):
    """Keys of the anchors of a chunk by anchor bucket, with their document buckets; of equal ones two are enough."""

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch, limit=CHUNK):
                data = np.ascontiguousarray(data)
                home = _dealt(_ids(part)[0], buckets)
                got = [(*_keyed(_words(data, at + o, GRAM), buckets), home[r]) for r, at, _, o in runs_of(data, off)]
                if not got:
                    continue
                bucket, key, own = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.lexsort((key, own, bucket))
                bucket, key, own = bucket[order], key[order], own[order]
                third = np.zeros(len(key), bool)
                third[2:] = (key[2:] == key[:-2]) & (own[2:] == own[:-2]) & (bucket[2:] == bucket[:-2])
                bucket, key, own = bucket[~third], key[~third], own[~third]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                packed = []
                for i, j in zip(cut, np.r_[cut[1:], len(bucket)], strict=True):
                    rows = np.zeros(j - i, KEY)
                    rows["b"], rows["k"] = own[i:j], key[i:j]
                    packed.append(_pack(rows))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(packed, pa.binary())], ["bucket", "rows"])

    return run


def _shared(t: pa.Table) -> pa.Table:
    """The keys of an anchor bucket that occur more than once, for each document bucket that has them."""
    rows = np.concatenate([_unpack(x, KEY)[0] for x in t.column("rows").to_pylist()])
    kinds, back, count = np.unique(rows["k"], return_inverse=True, return_counts=True)
    rows = np.unique(rows[count[back] > 1])
    cut = np.flatnonzero(np.r_[True, rows["b"][1:] != rows["b"][:-1]]) if len(rows) else np.zeros(0, np.int64)
    packed = [zstandard.ZstdCompressor(level=1).compress(rows["k"][i:j].tobytes()) for i, j in zip(cut, np.r_[cut[1:], len(rows)], strict=False)]
    own = t.column("bucket")[0].as_py()
    return pa.table({"bucket": pa.array(rows["b"][cut].astype(np.int64)), "anchors": pa.array([own] * len(cut), pa.int64()), "rows": pa.array(packed, pa.binary())})


def _stretches(buckets: int):
    """What is first in its document bucket, with its bytes, by anchor bucket (to = -1); notes of repeats within it, to be passed on."""

    def run(texts: pa.Table, asks: pa.Table) -> pa.Table:
        b, packed, to = [], [], []
        if texts.num_rows and asks.num_rows:
            open_ = zstandard.ZstdDecompressor()
            asked = np.sort(np.concatenate([np.frombuffer(open_.decompress(x), np.uint32).astype(np.uint64) | np.uint64(a << 32) for a, x in zip(asks.column("anchors").to_pylist(), asks.column("rows").to_pylist(), strict=True)]))
            held, size, pieces = [], 0, []
            for i in range(texts.num_rows):
                ids, null, ver, sizes = (np.array(texts.column(c)[i].as_py(), np.int64) for c in ("ids", "nulls", "vers", "sizes"))
                off = np.r_[0, np.cumsum(sizes)]
                data = np.frombuffer(open_.decompress(texts.column("blob")[i].as_py(), max_output_size=max(1, int(off[-1]))), np.uint8)
                for r, at, n, o in runs_of(data, off):
                    bucket, key = _keyed(_words(data, at + o, GRAM), buckets)
                    code = key.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(32))
                    ok = asked[np.minimum(np.searchsorted(asked, code), len(asked) - 1)] == code
                    r, at, n, o = r[ok], at[ok], n[ok], o[ok]
                    rows = np.zeros(len(at), ROW)
                    rows["d"], rows["z"], rows["v"], rows["p"], rows["n"], rows["o"] = ids[r], null[r], ver[r].view(np.uint64), at - off[r], n, o
                    held.append((rows, at + size))
                pieces.append(data)
                size += len(data)
            rows, at = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, ROW), np.zeros(0, np.int64))
            data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
            del pieces, held
            found = []
            for x, own, begin, key in _batches(data, at, rows):
                which, first, count = repeats(own, begin, key, rows[x])
                found.append(_notes(rows[x[which]], first, count))
                row, first, count = _left(rows["n"][x].astype(np.int64), which, first, count)
                out = rows[x[row]]
                out["p"] += first.astype(np.uint32)
                out["o"], out["n"] = out["o"] - first, count
                # of fully repeated rows one is enough: notes go to every row of the same id and text
                _, once = np.unique(out[["d", "z", "v", "p"]], return_index=True)
                start = begin[row] + first
                for bucket, i in _by_bucket(_keyed(key[row], buckets)[0][once], out[once]):
                    j = once[i]
                    to.append(-1)
                    b.append(bucket)
                    packed.append(_pack(out[j], _bytes_of(own, start[j], count[j] + WINDOW - 1).tobytes()))
            if found:
                nb, notes = _packed_notes(np.concatenate(found), buckets)
                to, b, packed = to + nb, b + nb, packed + notes
        return pa.table({"to": pa.array(to, pa.int64()), "bucket": pa.array(b, pa.int64()), "rows": pa.array(packed, pa.binary())})

    return run


def _batches(data: np.ndarray, at: np.ndarray, rows: np.ndarray):
    """Stretches of whole anchors, about ``SORT_BYTES`` at a time: their numbers, their bytes, where each begins, and anchor keys."""
    size = rows["n"].astype(np.int64) + WINDOW - 1
    key = _words(data, at + rows["o"], GRAM)
    order, group = _groups(key)
    done = np.cumsum(size[order])
    i = 0
    while i < len(order):
        j = int(np.searchsorted(done, (done[i - 1] if i else 0) + SORT_BYTES, side="right"))
        j = int(np.searchsorted(group, group[min(max(j, i + 1), len(order)) - 1], side="right"))
        x = order[i:j]
        n = size[x]
        yield x, _bytes_of(data, at[x], n), np.cumsum(n) - n, key[x]
        i = j


def _resolve(buckets: int):
    """Notes of all stretches and windows of an anchor bucket that repeat an earlier one, and the notes passed on."""

    def run(t: pa.Table) -> pa.Table:
        to = t.column("to").to_numpy()
        passed = t.filter(pa.array(to >= 0))
        own = [_unpack(x, ROW) for x in t.filter(pa.array(to < 0)).column("rows").to_pylist()]
        b, packed = passed.column("to").to_pylist(), passed.column("rows").to_pylist()
        if own:
            rows, data = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
            del own
            size = rows["n"].astype(np.int64) + WINDOW - 1
            found = []
            for x, part, begin, key in _batches(data, np.cumsum(size) - size, rows):
                which, first, count = repeats(part, begin, key, rows[x])
                found.append(_notes(rows[x[which]], first, count))
            nb, notes = _packed_notes(np.concatenate(found), buckets)
            b, packed = b + nb, packed + notes
        return pa.table({"bucket": pa.array(b, pa.int64()), "rows": pa.array(packed, pa.binary())})

    return run


def _pack_texts(buckets: int):
    """Texts of a chunk by document bucket, compressed together."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, data, off in chunks(batch, limit=CHUNK):
                (ids, null), ver = _ids(part), _versions(data, off)
                bucket = _dealt(ids, buckets)
                out = []
                for b in np.unique(bucket).tolist():
                    at = np.flatnonzero(bucket == b)
                    blob = b"".join(data[off[i] : off[i + 1]].tobytes() for i in at)
                    out.append((b, ids[at], null[at].astype(np.int64), ver[at].view(np.int64), (off[at + 1] - off[at]), press.compress(blob)))
                a = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), *[pa.array(a[i], pa.list_(pa.int64())) for i in (1, 2, 3, 4)], pa.array(a[5], pa.binary())], ["bucket", "ids", "nulls", "vers", "sizes", "blob"])

    return run


FINAL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _final(texts: pa.Table, notes: pa.Table) -> pa.Table:
    """The verdict on each document of a bucket."""
    held = [_unpack(x, NOTE)[0] for x in notes.column("rows").to_pylist()] if notes.num_rows else []
    note = np.concatenate(held) if held else np.zeros(0, NOTE)
    note = note[np.lexsort((note["p"], note["v"], note["z"], note["d"]))]
    key = np.rec.fromarrays([note["d"], note["z"], note["v"]], dtype=np.dtype([("d", "<i8"), ("z", "u1"), ("v", "<u8")]))
    open_ = zstandard.ZstdDecompressor()
    out = []
    for i in range(texts.num_rows):
        ids, nulls, vers, sizes = (np.array(texts.column(c)[i].as_py(), np.int64) for c in ("ids", "nulls", "vers", "sizes"))
        data = np.frombuffer(open_.decompress(texts.column("blob")[i].as_py(), max_output_size=max(1, int(sizes.sum()))), np.uint8)
        off = np.r_[0, np.cumsum(sizes)]
        ask = np.rec.fromarrays([ids, nulls.astype(np.uint8), vers.view(np.uint64)], dtype=key.dtype)
        lo, hi = np.searchsorted(key, ask, "left"), np.searchsorted(key, ask, "right")
        for r in range(len(ids)):
            own = data[off[r] : off[r + 1]]
            removed = spans = 0
            if hi[r] > lo[r]:
                edge = np.zeros(len(own) + 1, np.int32)
                p, n = note["p"][lo[r] : hi[r]].astype(np.int64), note["n"][lo[r] : hi[r]].astype(np.int64)
                np.add.at(edge, p, 1)
                np.add.at(edge, p + n - 1 + WINDOW, -1)
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                own = own[~gone]
            out.append((None if nulls[r] else int(ids[r]), int(sizes[r]), removed, spans, hashlib.sha256(own.tobytes()).hexdigest()))
    a = list(zip(*out, strict=True)) if out else [[]] * 5
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return pa.table({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in zip(names, a, strict=True)})


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    documents = documents.select("doc_id", "text")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(documents.sparkSession), -(-size // BUCKET_BYTES))
    keys = documents.mapInArrow(_anchors(buckets), "bucket bigint, rows binary")
    asks = keys.groupBy("bucket").applyInArrow(_shared, "bucket bigint, anchors bigint, rows binary")
    texts = documents.mapInArrow(_pack_texts(buckets), "bucket bigint, ids array<bigint>, nulls array<bigint>, vers array<bigint>, sizes array<bigint>, blob binary")
    found = texts.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(_stretches(buckets), "to bigint, bucket bigint, rows binary")
    notes = found.groupBy("bucket").applyInArrow(_resolve(buckets), "bucket bigint, rows binary")
    return texts.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(_final, FINAL)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
