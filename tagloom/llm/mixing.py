"""Mixing sources to target weights by Poisson replication.

The mean number of repetitions of a source's documents is its target share of the output over its present share.  A
uniform number is taken from a seeded hash of doc_id and the Poisson distribution of that mean is inverted at it, so a
document's count depends on its id, the seed and its source's mean alone: any layout, retry or lost executor gives the
same rows.  Each document is exploded by its count and the copies are sorted by a hash of (seed, doc_id, copy): a global shuffle.

Edge cases: a null source counts as the source ''; sources missing from given targets have weight 0 (their documents go);
null ids hash as the text ''; repeated rows have equal counts; an empty table gives no rows; clashing columns
``copy`` and ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

ALPHA = 0.5
SEED = "mix-1"
BROADCAST_SOURCES = 20_000


def unit(*parts: Column) -> Column:
    """Uniform in [0, 1) from 52 bits of md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _cdf(mean: Column) -> Column:
    """Cumulative Poisson probabilities up to 12 standard deviations and 30 above the mean."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.struct(F.array(F.exp(-mean)).alias("c"), (-mean).alias("l"))

    def step(s, k):
        l = s["l"] + F.ln(mean) - F.ln(k.cast("double"))  # noqa: E741
        return F.struct(F.concat(s["c"], F.array(F.element_at(s["c"], -1) + F.exp(l))).alias("c"), l.alias("l"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), top), first, step, lambda s: s["c"])).otherwise(F.array(F.lit(1.0)))


def rates(documents: DataFrame, targets: dict[str, float] | None = None, alpha: float = ALPHA, volume: float = 1.0, kept: list[str] | None = None) -> DataFrame:
    """source, n, mean repetitions and cumulative probabilities of each source.

    ``targets`` gives weights by source; without it the weight of a source is its count to the power ``alpha``.
    ``volume`` is the expected output size over the input size.
    """
    counts = stored(documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n")), kept)
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        given = documents.sparkSession.createDataFrame(list(targets.items()) or [("", 0.0)], "source string, w double")
        counts = counts.join(given, "source", "left")
        weight = F.coalesce("w", F.lit(0.0))
    sums = counts.agg(F.sum("n").alias("n"), F.sum(weight).alias("w")).first()
    scale = (sums["n"] or 0) * volume / (sums["w"] or 1.0)
    return counts.select("source", "n", (weight * F.lit(float(scale)) / F.col("n")).alias("mean")).select("source", "n", "mean", _cdf(F.col("mean")).alias("cdf"))


def replicate(documents: DataFrame, targets: dict[str, float] | None = None, alpha: float = ALPHA, volume: float = 1.0, seed: str = SEED, kept: list[str] | None = None) -> DataFrame:
    """The documents' own columns, copy (from 1) and shuffle_key, in the order of shuffle_key."""
    documents = documents.drop("copy", "shuffle_key")
    table_ = stored(rates(documents, targets, alpha, volume, kept).select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf")), kept)
    if table_.count() <= BROADCAST_SOURCES:
        table_ = F.broadcast(table_)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    u = unit(F.lit(seed), key)
    joined = documents.join(table_, F.coalesce(documents["source"], F.lit("")) == F.col("__source"))
    counted = joined.withColumn("__n", F.size(F.filter("__cdf", lambda c: c <= u))).where("__n > 0").drop("__cdf", "__source")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    return copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), key, F.col("copy").cast("string")).cast("binary"))).orderBy("shuffle_key")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
     w AS (SELECT s, n, pow(n::DOUBLE, {ALPHA}) AS w FROM c),
     m AS (SELECT s, w * ((SELECT sum(n) FROM w) / (SELECT sum(w) FROM w)) / n AS mean FROM w),
     k AS (SELECT s, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 30)::BIGINT + 1)) AS k FROM m),
     p AS (SELECT s, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1.0))) OVER (PARTITION BY s ORDER BY k) AS cdf FROM k),
     d AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS key,
                  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
     x AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.key, (p.k + 1)::INTEGER AS copy
           FROM d JOIN p ON coalesce(d.source, '') = p.s AND p.cdf <= d.u)
SELECT doc_id, text, lang, source, n_chars, copy, md5('{SEED}:order:' || key || ':' || copy::VARCHAR) AS shuffle_key FROM x
"""
