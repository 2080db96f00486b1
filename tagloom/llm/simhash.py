"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments.  The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so it is a lower bound.  The grid range join splits the 32
coordinates into ``GROUPS`` groups: two points within Manhattan distance r can differ in at most r groups, so they share
the grid cell (equal coordinates) of the other groups in at least one of the C(GROUPS, r) views.  Pairs of a cell are
held against the Manhattan bound and then against the exact Hamming distance.

Only distinct fingerprints are joined; copies never form pairs.  Cells with more than ``DENSE`` distinct fingerprints
are linked without pairs: two fingerprints lie within r bits exactly if some word lies within floor(r/2) of one and
ceil(r/2) of the other, so each is keyed by the words about it, and all keyed to a word are linked to one that is near it.

The corpus pipeline needs near copies down to a Jaccard similarity of 0.8, where fingerprints are too far apart for any
such bound.  ``one_of_each`` therefore takes candidates from banded minima of the shingle sets too, and holds every
candidate against the sets.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and are linked with each other and
whatever lies near zero; an empty table gives no rows; a null doc_id is a row of its own kind: its component is the
least non-null id reachable, or null if there is none; repeated rows are kept.
"""

from __future__ import annotations

import atexit
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, chunks, discard, mix, stored, table, with_field, words
from .components import components

GROUPS = 5
DENSE = 400
BANDS, BAND, UNEQUAL = 20, 5, 25  # a pair at Jaccard 0.8 shares a band with probability 1 - (1 - 0.8**5)**20 = 0.9996
FINE, FINE_UNEQUAL = 512, 85  # at Jaccard 0.8 the mean is 51.2 and the deviation 6.8: five deviations pass
BITMAPS = 8192  # of 4 KB and 32,768 row numbers each: 32 MB at most are broadcast
_EVEN = 0x5555555555555555


def shingles_of(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all k-word shingles, the rows that have any, and the edges of each such row's run of hashes."""
    low = LOWER[data]
    s, e, row = words(low, off)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    # the words of the chunk joined by single spaces, so that a shingle is one slice
    size = e - s
    end = np.cumsum(size + 1) - 1
    start = end - size
    text = np.full(int(end[-1]), 32, np.uint8)
    inside = np.ones(len(text), bool)
    inside[end[:-1]] = False
    text[inside] = low[np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))]
    raw = text.tobytes()
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    # shingle i runs from word i to word i+k-1 where both lie in one row; rows with fewer words have one shingle
    last = np.arange(len(row)) + k - 1
    whole = last < np.repeat(first + count, count)
    short = first[count < k]
    begin = np.flatnonzero(whole)
    stop = begin + k - 1
    if len(short):
        begin = np.concatenate([begin, short])
        stop = np.concatenate([stop, short + count[count < k] - 1])
        order = np.argsort(begin, kind="stable")
        begin, stop = begin[order], stop[order]
    digest = xxhash.xxh64_intdigest
    owner = row[begin]
    a, b = start[begin].tolist(), end[stop].tolist()
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    edges = np.r_[cuts, len(owner)]
    h = np.fromiter((digest(raw[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    return h, owner[cuts], edges


def fingerprints_of(data: np.ndarray, off: np.ndarray, k: int = 3, tables: int = 1) -> np.ndarray:
    """64-bit SimHash of each row over the XXH64 (seed 42) of its k-word shingles; further tables mix that hash."""
    return _fingerprints(*shingles_of(data, off, k), len(off) - 1, tables)


def _fingerprints(h: np.ndarray, rows: np.ndarray, edges: np.ndarray, n: int, tables: int) -> np.ndarray:
    out = np.zeros((tables, n), np.uint64)
    ones = (1 << np.arange(64, dtype=np.uint64)).astype(np.uint64)
    step = 1 << 16
    for j in range(tables):
        hj = mix(h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if j else h
        for lo in range(len(rows)):
            x, y = edges[lo], edges[lo + 1]
            bits = np.zeros(64, np.int64)
            for at in range(x, y, step):
                bits += np.unpackbits(hj[at : min(y, at + step)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[j, rows[lo]] = ones[bits * 2 > y - x].sum(dtype=np.uint64)
    return out


def with_fingerprint(documents: DataFrame, k: int = 3, column: str = "fp", keep_text: bool = False) -> DataFrame:
    """``documents`` with the signed 64-bit fingerprint of its text; the text goes unless ``keep_text``."""
    documents = documents.drop(column)
    out = documents if keep_text else documents.drop("text")
    schema = with_field(out.schema, column, "bigint")
    names = out.columns

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], pa.array(fingerprints_of(data, off, k)[0].view(np.int64))], [*names, column])

    return documents.mapInArrow(run, schema)


def _views(radius: int, groups: int) -> list[int]:
    """A bit mask of the embedded coordinates that make up the cell of each view."""
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    parts = [sum(3 << (2 * j) for j in range(edges[g], edges[g + 1])) for g in range(groups)]
    return [sum(parts[g] for g in kept) for kept in combinations(range(groups), groups - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedded(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary in its own two bits: 0 is 00, 1 is 01 and 2 is 11."""
    even = F.lit(_EVEN)
    lo, hi = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return lo.bitwiseOR(hi).bitwiseOR(F.shiftleft(lo.bitwiseAND(hi), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings: the unary places that differ."""
    return F.bit_count(a.bitwiseXOR(b))


def _ball(radius: int) -> Column:
    """Every 64-bit mask of at most ``radius`` bits, as an array."""
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    out = F.array(F.lit(0).cast("bigint"))
    for _ in range(radius):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda m: F.transform(one, lambda x: m.bitwiseXOR(x))))))
    return out


def links(fps: DataFrame, radius: int = 2, groups: int | None = None, dense: int = DENSE, kept: list[str] | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within ``radius`` bits; no pair inside a dense cell."""
    masks = _views(radius, groups or radius + 3)
    e = embedded(F.col("fp"))
    # a cell's key is a hash of its view and coordinates; what shares a key by chance fails the distance
    cells = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(v), e.bitwiseAND(F.lit(_signed(m)))) for v, m in enumerate(masks)])).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stored(cells.join(sizes, "cell"), kept)
    sparse = crowded.where(F.col("n") <= dense).select("cell", "fp")
    other = sparse.select("cell", F.col("fp").alias("fp2"))
    near = (
        sparse.join(other, "cell").where(F.col("fp") > F.col("fp2"))
        .where(manhattan(embedded(F.col("fp")), embedded(F.col("fp2"))) <= radius)
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    )
    hot = crowded.where(F.col("n") > dense).select("fp").distinct()
    inner, outer = _ball(radius // 2), _ball(radius - radius // 2)
    keyed = hot.select("fp", F.explode(F.concat(F.transform(inner, lambda m: F.struct(m.alias("m"), F.lit(True).alias("near"))), F.transform(outer, lambda m: F.struct(m.alias("m"), F.lit(False).alias("near"))))).alias("k"))
    keyed = keyed.select("fp", F.col("fp").bitwiseXOR(F.col("k.m")).alias("key"), F.col("k.near").alias("near"))
    hub = keyed.groupBy("key").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("b IS NOT NULL AND lo <> hi").select("key", "b")
    stars = keyed.join(hub, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return near.union(stars).distinct()


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def groups_of(documents: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of each document."""
    docs = stored(with_fingerprint(documents.select("doc_id", "text"), k))
    fps = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(fps.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    owner = fps.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    component = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(owner.join(component, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups_of(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, k: int = 5, radius: int = 3, kept: list[str] | None = None) -> DataFrame:
    """One document (least doc_id) of each group of near copies; all columns.

    Two documents are near copies if the Jaccard similarity of their sets of ``k``-word shingles is 0.8 or more, and
    groups are what chains of near copies connect.  Candidates share one of ``BANDS`` bands of ``BAND`` minima, or have
    fingerprints within ``radius`` bits; each is held against the sets themselves.  Working tables go as soon as the groups are
    known; the paths of the two that the result reads go to ``kept``.  Texts are read where they lie and not dealt out, as long
    as ``BITMAPS`` bitmaps of row numbers hold all rows.
    """
    names, spark, mine = documents.columns, documents.sparkSession, []
    lasting: list[str] = [] if kept is None else kept
    if kept is None:
        atexit.register(discard, spark, lasting)
    docs = stored(_sketched(documents.withColumn("__rid", F.monotonically_increasing_id()), k, 1), lasting)  # row numbers are fixed here
    few = docs.select(F.bitmap_bucket_number("__rid")).distinct().count() <= BITMAPS
    held = ["n", "m0", "m1"]
    nodes = stored(docs.groupBy("__d0", "__d1").agg(F.min("__rid").alias("node"), *[F.first(f"__{c}").alias(c) for c in held], F.first("__fp0").alias("fp"), F.first("__bands").alias("bands")), mine)
    one = F.struct("node", *held)
    members = nodes.select(F.explode("bands").alias("key"), one.alias("x"))
    crowded = stored(members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "key"), mine)
    # of equal fingerprints the first stands for all
    least = stored(nodes.groupBy("fp").agg(F.min(one).alias("x")), mine)
    same = nodes.select("fp", one.alias("y")).join(least, "fp").select("x", "y")
    pairs = links(least.select("fp"), radius, kept=mine)
    far = pairs.join(least.select(F.col("fp").alias("a"), "x"), "a").join(least.select(F.col("fp").alias("b"), F.col("x").alias("y")), "b").select("x", "y")
    near = stored(_alike(same.union(far)), mine)
    ids = crowded.select(F.col("x.node").alias("__rid")).union(near.select("a")).union(near.select("b")).distinct()
    sets = stored(_sets(_numbered(docs.select("__rid", "text"), ids, few, mine).withColumnRenamed("__rid", "node"), k), mine)
    # first each band's documents against two of them, one of which is the document whose bands are the fullest (what copies
    # were made from keeps the bands that each copy shares with it), then what this leaves apart against each other
    full = crowded.groupBy("x.node").agg(F.sum("c").alias("full")).select(F.col("node").alias("__node"), "full")
    at = F.struct(F.xxhash64("key", "x.node").alias("at"), "x")
    most = F.struct("full", F.xxhash64("x.node").alias("at"), "x")
    hubs = crowded.join(full, F.col("x.node") == F.col("__node")).groupBy("key").agg(F.min(at).alias("lo"), F.max(most).alias("hi")).select("key", F.explode(F.array("lo.x", "hi.x")).alias("y"))
    edges = stored(_verified(_alike(crowded.join(hubs, "key").select("x", "y")).union(near).distinct(), sets), mine)
    root = components(edges, kept=mine)
    placed = stored(crowded.join(root.select(F.col("node").alias("__node"), "root"), F.col("x.node") == F.col("__node"), "left").select("key", "x", F.coalesce("root", "x.node").alias("root")), mine)
    open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = stored(placed.join(open_, "key"), mine)
    common = _common(sets.join(left.select("x.node").distinct(), "node", "left_semi")).where("common * 5 >= n * 4").select(F.col("node").alias("__node"), "common", "fine")
    common = common.join(nodes.select(F.col("node").alias("__node"), "bands"), "__node")
    left = stored(left.join(common, F.col("x.node") == F.col("__node")).select("key", "x", "root", "common", "fine", "bands"), mine)
    other = left.select("key", F.col("x").alias("y"), F.col("root").alias("root2"), F.col("common").alias("common2"), F.col("fine").alias("fine2"), F.col("bands").alias("bands2"))
    # a pair comes from the first band it shares alone; that band is open too, as the pair's roots differ
    first_shared = F.get(F.filter(F.arrays_zip("bands", "bands2"), lambda z: z["bands"] == z["bands2"]), F.lit(0))["bands"]
    able = (F.least("common", "common2") * 9 >= (F.col("x.n") + F.col("y.n")) * 4) & (sum(F.bit_count(F.col("fine")[i].bitwiseXOR(F.col("fine2")[i])) for i in range(FINE // 64)) <= FINE_UNEQUAL)
    rest = stored(_alike(left.join(other, "key").where((F.col("root") < F.col("root2")) & able & (F.col("key") == first_shared)).select("x", "y")), mine)
    root = components(edges.union(_verified(rest, sets)), kept=mine)
    owner = nodes.join(root, "node", "left").select("__d0", "__d1", F.coalesce("root", "node").alias("root"))
    rows = docs.select("__rid", "doc_id", "__d0", "__d1").join(owner, ["__d0", "__d1"])
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__rid").alias("r"))).alias("m")).select(F.col("m.r").alias("__rid"))
    out = _numbered(docs, first, few, lasting).select(*names)
    discard(spark, mine)
    return out


def _numbered(documents: DataFrame, numbers: DataFrame, few: bool, keep: list[str]) -> DataFrame:
    """The rows of ``documents`` whose row number __rid is among the distinct ``numbers``, which are stored.

    ``few``: bitmaps hold the numbers and go to the documents.  Otherwise both are dealt out by row number.
    """
    if not few:
        return documents.join(stored(numbers, keep), "__rid", "left_semi").select(*documents.columns)
    at, bit = F.bitmap_bucket_number("__rid"), F.bitmap_bit_position("__rid")
    # numbers meet before they become bits: partial bitmaps would be as many as tasks times bitmaps
    maps = stored(numbers.select(at.alias("__at"), bit.alias("__bit")).repartition("__at").groupBy("__at").agg(F.bitmap_construct_agg("__bit").alias("__map")), keep)
    byte = F.conv(F.hex(F.substring("__map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return documents.join(F.broadcast(maps), at == F.col("__at")).where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*documents.columns)


def _alike(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of those of x and y whose set sizes allow a Jaccard similarity of 0.8 and whose minima do not speak against it.

    Of the ``BANDS * BAND`` lowest bits of minima a pair at 0.8 has a tenth unequal (10 of 100, deviation 3); 25 pass.
    """
    unequal = F.bit_count(F.col("x.m0").bitwiseXOR(F.col("y.m0"))) + F.bit_count(F.col("x.m1").bitwiseXOR(F.col("y.m1")))
    sizes = F.least("x.n", "y.n") * 5 >= F.greatest("x.n", "y.n") * 4
    return pairs.where(F.col("x.node") != F.col("y.node")).where(sizes & (unequal <= UNEQUAL)).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))


def _common(sets: DataFrame) -> DataFrame:
    """node, fine, n and common: how many of a set's n shingles another of ``sets`` holds too, so at most that many are shared with any one.

    A pair at Jaccard 0.8 shares 4/9 of the sum of its sizes, and sizes differ by a fifth at most: who has fewer than 4 n / 5
    common shingles is in no such pair.
    """
    held = sets.select("node", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("sets"))
    own = held.where("sets = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    n = F.size("set")
    return sets.join(own, "node", "left").select("node", "fine", n.alias("n"), (n - F.coalesce("own", F.lit(0))).alias("common"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more, in whole numbers: 9 |A and B| >= 4 (|A| + |B|)."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return both.where(F.size(F.array_intersect("sa", "sb")) * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b")


def _sets(documents: DataFrame, k: int) -> DataFrame:
    """node, its set of shingle hashes and the lowest bits of ``FINE`` minima; no batch of sets is larger than a chunk's."""
    salt = mix(np.arange(1, 2 * FINE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                h, rows, edges = shingles_of(data, off, k)
                sets: list = [np.zeros(0, np.uint64)] * part.num_rows
                for i, row in enumerate(rows):
                    sets[row] = np.unique(h[edges[i] : edges[i + 1]])
                flat = pa.array(np.concatenate(sets).view(np.int64))
                ends = np.cumsum([0, *[len(x) for x in sets]])
                fine = np.zeros((part.num_rows, FINE // 64), np.uint64)
                if len(rows):
                    h, first = np.concatenate([sets[row] for row in rows]), np.cumsum([0, *[len(sets[row]) for row in rows[:-1]]])
                    for j in range(FINE):
                        least = mix(np.minimum.reduceat((h ^ salt[j]) * (salt[FINE + j] | np.uint64(1)), first))
                        fine[rows, j // 64] |= (least & np.uint64(1)) << np.uint64(j % 64)
                fine = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * (FINE // 64), pa.int32()), pa.array(fine.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("node")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), fine], ["node", "set", "fine"])

    return documents.mapInArrow(run, "node bigint, set array<bigint>, fine array<bigint>")


def _sketched(documents: DataFrame, k: int, tables: int) -> DataFrame:
    """``documents`` with fingerprints __fp0, ..., and of the set of shingles: size __n, digest __d0 and __d1, lowest bits of the minima __m0 and __m1, keys of the bands."""
    schema = documents.schema
    added = [*[f"__fp{j}" for j in range(tables)], "__n", "__d0", "__d1", "__m0", "__m1"]
    for name in added:
        schema = with_field(schema, name, "bigint")
    schema = with_field(schema, "__bands", "array<bigint>")
    total = BANDS * BAND
    salt = mix(np.arange(1, 2 * total + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                n = part.num_rows
                h, rows, edges = shingles_of(data, off, k)
                fp = _fingerprints(h, rows, edges, n, tables)
                numbers = np.zeros((5, n), np.uint64)
                keys = np.zeros((len(rows), BANDS), np.uint64)
                if len(rows):
                    sets = [np.unique(h[edges[i] : edges[i + 1]]) for i in range(len(rows))]
                    size = np.array([len(x) for x in sets])
                    first = np.cumsum(size) - size
                    h = np.concatenate(sets)
                    numbers[0, rows] = size
                    for j in range(2):
                        numbers[1 + j, rows] = np.add.reduceat(mix(h ^ salt[j]), first)
                    for j in range(total):
                        least = mix(np.minimum.reduceat((h ^ salt[j]) * (salt[total + j] | np.uint64(1)), first))
                        numbers[3 + j // 64, rows] |= (least & np.uint64(1)) << np.uint64(j % 64)
                        keys[:, j // BAND] = mix(keys[:, j // BAND] + least + np.uint64(j))
                has = np.zeros(n, np.int64)
                has[rows] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has)], pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x.view(np.int64)) for x in [*fp, *numbers]], bands], schema.names)

    return documents.mapInArrow(run, schema)
