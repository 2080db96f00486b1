"""Nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks, and a tile is the product of one block of each, so a task's memory depends
on the block sizes alone.  Within a tile the unit vectors are quantised to int8 (one scale a vector); the integer
product of two of them bounds their cosine, since |x.y - q(x).q(y)| <= |x - q(x)| |y| + |q(x)| |y - q(y)|.  A
candidate survives where its upper bound reaches the k-th largest lower bound of its query in the tile.  Survivors
are recomputed from the original vectors in double precision and pass a k-heap; the heaps of a query's tiles are merged.

Nothing is approximate: the bounds hold for every pair, so the k nearest always survive.

Edge cases: null, zero, empty or non-finite vectors, vectors with null components and rows with a null id take no part;
only vectors of one length are compared; of repeated rows of one id the least vector counts; ties go to the smaller id;
a query with fewer than k candidates returns them all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
SCHEMA = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, d) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some)
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        .select("vec_id", v.alias("v"), F.size("embedding").alias("d"))
    )


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def quantised(x: np.ndarray):
    """int8 codes held as float32 (their products stay exact below 2**24), scales and error norms of unit vectors."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])
    return codes.astype(np.float32), scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def tile(q_id, q, c_id, c, k: int):
    """The k nearest candidates of each query within one tile: ids and exact cosines."""
    nq, nc = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    uq, uc = q / nq[:, None], c / nc[:, None]
    (iq, sq, eq), (ic, sc, ec) = quantised(uq), quantised(uc)
    for lo in range(0, len(q_id), 256):
        hi = min(lo + 256, len(q_id))
        near = _product(iq[lo:hi], ic) * (sq[lo:hi, None] * sc[None])
        slack = eq[lo:hi, None] + (1 + eq[lo:hi, None]) * ec[None] + 1e-9
        own = q_id[lo:hi, None] == c_id[None]
        low = np.where(own, -np.inf, near - slack)
        kth = np.partition(low, max(0, low.shape[1] - k), axis=1)[:, max(0, low.shape[1] - k)]
        alive = ~own & (near + slack >= kth[:, None])
        for r in range(hi - lo):
            at = np.flatnonzero(alive[r])
            cos = (c[at] * q[lo + r]).sum(1) / (nc[at] * nq[lo + r])
            best = heapq.nsmallest(k, zip((-cos).tolist(), c_id[at].tolist(), strict=True))
            for s, i in best:
                yield int(q_id[lo + r]), i, -s


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer product in slices of 1024 dimensions (127 * 127 * 1024 < 2**24)."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024] @ b[:, at : at + 1024].T
    return out


def nearest(vectors: DataFrame, query: Column, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` candidates of largest cosine for each row that meets ``query``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    size = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(query).alias("q"))
    most = size.agg(F.max("n"), F.max("q")).first()
    if not most or not most[0] or not most[1]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    blocks = max(-(-most[0] // candidate_block), min(most[0], partitions(spark)))
    bands = -(-most[1] // query_block)
    cell = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")
    band = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(bands)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("d", cell.alias("cell"), spread(bands).alias("band"), "vec_id", "v")
    queries = rows.where(query).select("d", spread(blocks).alias("cell"), band.alias("band"), "vec_id", "v")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and c.num_rows:
            d = q.column("d")[0].as_py()
            found = list(tile(q.column("vec_id").to_numpy(), _matrix(q.column("v"), d), c.column("vec_id").to_numpy(), _matrix(c.column("v"), d), k))
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    by = ["d", "band", "cell"]
    heaps = queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(run, SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return heaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
     n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
     p AS (SELECT q.vec_id AS query_id, c.vec_id,
                  list_dot_product(q.e, c.e) / (q.n * c.n) AS score
           FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
