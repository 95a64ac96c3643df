"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())

MANIFEST = T.StructType(
    [T.StructField(c, k) for c, k in (("file_path", T.StringType()), ("rel_path", T.StringType()), ("language", T.StringType()), ("file_hash", T.StringType()), ("content", T.BinaryType()), ("error", T.StringType()))]
)

CHUNK = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("node_name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("package_name", T.StringType()),
        T.StructField("imports", _strings),
        T.StructField("signature", T.StringType()),
        T.StructField("receiver", T.StringType()),
        T.StructField("doc", T.StringType()),
        T.StructField("callees", _strings),
        T.StructField("param_types", _strings),
        T.StructField("return_types", _strings),
        T.StructField("has_error_return", T.BooleanType()),
    ]
)

#: What a parsed file gives: its chunks, or why it has none.
PARSED = T.StructType([*CHUNK.fields, T.StructField("error", T.StringType())])

FILE_EVENT = T.StructType([T.StructField("path", T.StringType()), T.StructField("op", T.StringType()), T.StructField("ts", T.TimestampType())])
