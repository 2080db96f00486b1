"""Secret scans with a randomness test battery, in SQL expressions only.

Base kinds are found by pattern (assign, access, hex).  The battery looks at every maximal run of 16 or more base-64 characters
that holds a letter, inside base spans and outside.  Its encoding is inferred (hex, base32, alphanumeric, base64), which fixes an
alphabet of k symbols.  Three tests of "uniformly random over the alphabet" are made: chi-squared of the symbol counts, runs
about the alphabet's middle and lag-1 serial correlation.  Fisher's method combines them; a token rejected as not random
at ``NOT_RANDOM`` is no secret.

What is controlled is the share of false discoveries, so the null hypothesis there is "ordinary text", and the same three tests
are turned round and combined by Fisher's method, too:

* chi-squared: the chance that text of this length and alphabet, whose letters repeat as natural language's do, has one as small;
* runs: of characters of one class (upper case, lower case, digits, others).  Ordinary text changes class after at most
  ``CLASS_CHANGES`` of its characters; the chance of as many changes as seen is bounded by Chernoff;
* serial correlation: ordinary text that mixes classes does so in stretches, so neighbours agree (``STRETCHES`` on average);
  the chance of so low a correlation.

The combined p-value depends on the length through all three, and Benjamini-Hochberg is applied to it within length classes over
the whole corpus (from a histogram of p-values, which has a fixed number of cells).  Tokens of fewer than 16 characters are not tested:
a random one changes class at about six in ten characters, which leaves it a p-value of about 1e-4, too large to be told from
the ordinary words of a large corpus.  Accepted tokens are spans of kind ``random``; base spans stay as they are.

Edge cases: null and empty texts have no spans and the hash of the empty string; repeated rows are reported each;
null ids are kept; an empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{12,})"  # runs are maximal, so a minimum in the pattern drops the same matches as a later filter
HEX = r"([0-9a-f]{32,})"
TOKEN = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{16,}={0,2})"
FALSE_DISCOVERIES = 0.01
NOT_RANDOM = 0.001
TEXT_COINCIDENCE = 0.0656  # chance that two letters of natural language agree
CLASS_CHANGES = 0.2
STRETCHES = 0.2
LENGTHS = (20, 24, 32, 48, 64, 128)
BINS = 400
BLOCK = 256
SPAN = "array<struct<start:int,end:int,g:string>>"


def located(text: Column, pattern: str) -> Column:
    """Start, end (code points) and first group of each match, leftmost and non-overlapping; empty where none."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("g"),
        F.split(text, pattern, -1).alias("s"),
    )

    def walk(p):
        many = F.size(p["m"])

        def step(a, i):
            start = a["at"] + F.length(F.get(p["s"], i))
            end = start + F.length(F.get(p["m"], i))
            span = F.struct(start.alias("start"), end.alias("end"), F.get(p["g"], i).alias("g"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        def block(a, b):  # arrays grow by one span within a block and by one block without, so long texts take no square of time
            first = F.struct(a["at"].alias("at"), F.array().cast(SPAN).alias("out"))
            own = F.aggregate(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, many) - 1), first, step)
            return _once(own, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((many - 1) / BLOCK).cast("int")), first, block, lambda a: F.flatten(a["out"]))

    return F.when(text.rlike(pattern), _once(parts, walk)).otherwise(F.array().cast(SPAN))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _normal(z: Column) -> Column:
    """Normal distribution function, to about 1e-4 and monotone."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070565992 * z * z * z)))


def _battery(token: Column) -> Column:
    """n, length class, p (under ordinary text) and fisher (under randomness) of one token."""
    body = F.regexp_replace(token, "=+$", "")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "0")
    hexa, b32 = body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), body.rlike("^[A-Z2-7]+$")
    alphabet = (
        F.when(hexa, F.lit("0123456789abcdef")).when(b32, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
        .when(body.rlike("^[A-Za-z0-9]+$"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
        .otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"))
    )
    folded = F.when(hexa, F.lower(body)).otherwise(body)
    base = F.struct(
        F.length(body).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"),
        F.transform(F.split(folded, ""), lambda c: F.position(c, alphabet).cast("double")).alias("x"),
        (F.length(F.regexp_replace(kinds, "[-+/_]+", "-")) - 1).cast("double").alias("changes"),
    )

    def tests(b):
        n, k, x = b["n"], b["k"], b["x"]
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0)))
        mean = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n
        spread = F.aggregate(x, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, c: F.struct(a.alias("a"), c.alias("c")))
        lag = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["c"] - mean))
        runs = 1.0 + F.size(F.filter(pairs, lambda p: (p["a"] > k / 2) != (p["c"] > k / 2)))
        high = F.size(F.filter(x, lambda y: y > k / 2)).cast("double")
        return F.struct(n.alias("n"), k.alias("k"), (squares * k / n - n).alias("chi"), F.when(spread > 0, lag / spread).otherwise(F.lit(1.0)).alias("r"), runs.alias("runs"), high.alias("hi"), b["changes"].alias("changes"))

    def combine(t):
        n, k, chi = t["n"], t["k"], t["chi"]
        df = k - 1
        wilson = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        p_chi = 1 - _normal(wilson)
        lo = n - t["hi"]
        mu = 2 * t["hi"] * lo / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        two = lambda z: F.greatest(F.lit(1e-12), 2 * (1 - _normal(F.abs(z))))
        p_runs = F.when(var > 0, two((t["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(F.lit(1e-12))
        p_serial = two(t["r"] * F.sqrt(n))
        half = -(F.ln(F.greatest(F.lit(1e-12), p_chi)) + F.ln(p_runs) + F.ln(p_serial))
        fisher = F.exp(-half) * (1 + half + half * half / 2)
        delta = F.greatest(k * TEXT_COINCIDENCE, F.lit(2.0)) - 1
        t_chi = _normal((chi - (df + n * delta)) / F.sqrt(2 * df + 4 * n * delta))
        share = F.least(t["changes"] / (n - 1), F.lit(1 - 1e-9))
        rate = share * F.ln(F.greatest(share, F.lit(1e-9)) / CLASS_CHANGES) + (1 - share) * F.ln((1 - share) / (1 - CLASS_CHANGES))
        t_runs = F.when(share > CLASS_CHANGES, F.exp(-(n - 1) * rate)).otherwise(F.lit(1.0))
        t_serial = _normal((t["r"] - STRETCHES) * F.sqrt(n))
        held = -(F.ln(F.greatest(F.lit(1e-15), t_chi)) + F.ln(F.greatest(F.lit(1e-15), t_runs)) + F.ln(F.greatest(F.lit(1e-15), t_serial)))
        p = F.exp(-held) * (1 + held + held * held / 2)
        stratum = sum((F.when(n >= x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
        return F.struct(n.cast("int").alias("n"), stratum.cast("int").alias("stratum"), p.alias("p"), fisher.alias("fisher"))

    return _once(_once(base, tests), combine)


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-20))))).cast("int")


def found(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, base spans (__base) and tested tokens (__tested) of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [
        F.transform(F.filter(located(text, ASSIGN), lambda x: F.length(x["g"]) >= 8), lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("o"), F.lit("assign").alias("kind"), x["end"].alias("end"))),
        F.transform(located(text, ACCESS), lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("o"), F.lit("access").alias("kind"), x["end"].alias("end"))),
        F.transform(located(text, HEX), lambda x: F.struct(x["start"].alias("start"), F.lit(2).alias("o"), F.lit("hex").alias("kind"), x["end"].alias("end"))),
    ]
    tokens = F.filter(located(text, TOKEN), lambda x: x["g"].rlike("[A-Za-z]"))
    tested = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _battery(t["g"]).alias("b")))
    return documents.select(*keep, F.array_sort(F.concat(*kinds)).alias("__base"), tested.alias("__tested"))


def thresholds(tested: DataFrame, q: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """The first accepted bin of each length class: Benjamini-Hochberg over the histogram of p-values."""
    cells = tested.select(F.explode("__tested").alias("t")).select("t.b.*").groupBy("stratum", _bin(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for s in {c["stratum"] for c in cells}:
        own = {c["bin"]: c["n"] for c in cells if c["stratum"] == s}
        total, below = sum(own.values()), 0
        for b in sorted(own, reverse=True):
            below += own[b]
            if 10 ** (-b / 20) * total <= q * below:
                out[s] = b
    return out


def scan(documents: DataFrame, keep: list[str], q: float = FALSE_DISCOVERIES, column: str = "secrets", kept: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``column``: all spans as structs (start, o, kind, end), base and added, in order.

    The path of the working table that the result reads goes to ``kept``.
    """
    tested = stored(found(documents, keep), kept)
    least = thresholds(tested, q)
    ok = lambda t: (t["b"]["fisher"] >= NOT_RANDOM) & _any([(t["b"]["stratum"] == s) & (_bin(t["b"]["p"]) >= b) for s, b in sorted(least.items())])
    added = F.transform(F.filter("__tested", ok), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("o"), F.lit("random").alias("kind"), t["end"].alias("end")))
    return tested.select(*keep, "__base", F.size("__tested").cast("bigint").alias("__n_tested"), F.array_sort(F.concat("__base", added)).alias(column))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    count = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), F.col("__n_tested").alias("n_tested"), (F.size("secrets") - F.size("__base")).cast("bigint").alias("n_random"))


def redacted(documents: DataFrame, mark: str = "[SECRET]", q: float = FALSE_DISCOVERIES, kept: list[str] | None = None) -> DataFrame:
    """The documents with every secret span replaced by ``mark``; n_chars, if there, follows; all other columns stay."""
    names = documents.columns
    out = scan(documents, names, q, "__secrets", kept)
    text = F.coalesce(F.col("text"), F.lit(""))

    def step(a, s):
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.when(F.size("__secrets") > 0, F.aggregate("__secrets", first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))).otherwise(F.col("text"))
    out = out.select(*[c for c in names if c != "text"], new.alias("text"), F.size("__secrets").alias("__n"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__n") > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)
