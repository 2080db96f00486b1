"""Relations of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

TAG = T.StructType([
    T.StructField("rel_file", T.StringType(), False),
    T.StructField("line", T.IntegerType(), False),
    T.StructField("end_line", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("lang", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
])

# The vocabulary of the tag relation.
DEFINITION_KINDS = ("function", "method", "class", "interface", "type", "variable", "constant")
SCOPE_KINDS = ("function", "method", "class")
OUTLINE_KINDS = ("function", "method", "class", "interface", "type", "def")
