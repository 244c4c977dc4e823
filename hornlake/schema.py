"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

#: Split of a triple: 0 train, 1 valid, 2 test.
TRIPLES = T.StructType([T.StructField("s", T.LongType()), T.StructField("p", T.StringType()), T.StructField("o", T.LongType()), T.StructField("split", T.IntegerType())])

_ATOM = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("p", T.StringType()), T.StructField("o", T.IntegerType())])
RULES = T.StructType([T.StructField("rule_id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("atoms", T.ArrayType(_ATOM)), T.StructField("head_idx", T.IntegerType())])
