"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

DEFAULT_COLLECTION = "default"

MEMORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("collection", T.StringType(), False),
        T.StructField("content", T.BinaryType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("created_at", T.LongType(), False),
        T.StructField("importance", T.FloatType(), False),
    ]
)
EDGE_SCHEMA = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False), T.StructField("relation", T.StringType(), False)])
CHUNK_SCHEMA = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType(), False), T.StructField("text", T.StringType(), False), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]), False)
COMMAND_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("id", T.LongType()),
        T.StructField("memory", T.StructType([T.StructField(f.name, f.dataType, True) for f in MEMORY_SCHEMA])),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("relation", T.StringType()),
    ]
)
