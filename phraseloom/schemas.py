"""Fixed schemas and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model and of the file formats.
EOS = "</s>"
EOS_VID = 1
INVALID_VID = 0
MAX_LEN = 255
MAX_LEAF = 10_000
MAGIC_V2 = 0x3258444974706153
MAGIC_V3 = 0x3358444974706153
INVALID_LINK = (255, 255)

LINK = T.StructType([T.StructField("src", T.IntegerType()), T.StructField("trg", T.IntegerType())])
VOCAB = T.StructType([T.StructField("vid", T.LongType()), T.StructField("surface", T.StringType()), T.StructField("is_alias", T.BooleanType())])
SENTENCES = T.StructType([T.StructField("sid", T.LongType()), T.StructField("toks", T.ArrayType(T.IntegerType()))])
ALIGNMENT = T.StructType([T.StructField("sid", T.LongType()), T.StructField("links", T.ArrayType(LINK))])
POSITIONS = T.StructType([T.StructField("rank", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("off", T.IntegerType())])
RUN = T.StructType([*POSITIONS.fields, *[T.StructField(f"v{d}", T.IntegerType()) for d in range(8)]])
