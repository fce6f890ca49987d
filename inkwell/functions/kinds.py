"""Types spelled as objects: workers import modules without a session, so no DDL is parsed there."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def structs(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(struct(**fields))


OUTLINE = structs(level=INT, text=STRING, path=STRING)
BLOCKS = structs(block_id=STRING, kind=STRING, text=STRING, char_len=INT)
CHUNKS = structs(chunk_id=STRING, chunk_index=INT, headings_path=STRING, est_tokens=LONG, text=STRING, char_len=INT)
NOTES = structs(text=STRING, reason=STRING)
WARNINGS = structs(type=STRING, message=STRING)
