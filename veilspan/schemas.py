"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

CATALOG = T.StructType(
    [
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("bucket", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("regex", T.StringType(), False),
        T.StructField("validator", T.StringType(), True),
    ]
)

CUSTOM_RULE = T.StructType(
    [
        T.StructField("name", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("severity", T.StringType(), True),
        T.StructField("regex", T.StringType(), True),
    ]
)

FINDING = (
    "struct<source:string,ord:int,name:string,category:string,severity:string,"
    "start:int,end:int,value:string,score:double>"
)

OCR_WORDS = T.StructType(
    [
        T.StructField("image_id", T.LongType(), False),
        T.StructField("word_ix", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("x", T.IntegerType(), False),
        T.StructField("y", T.IntegerType(), False),
        T.StructField("w", T.IntegerType(), False),
        T.StructField("h", T.IntegerType(), False),
        T.StructField("conf", T.FloatType(), False),
        T.StructField("block", T.IntegerType(), False),
        T.StructField("line", T.IntegerType(), False),
    ]
)

REDACTION_LOG = T.StructType(
    [T.StructField("ts", T.StringType(), True), T.StructField("count", T.LongType(), True)]
)

CHUNKS = T.StructType(
    [
        T.StructField("session", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), True),
        T.StructField("chunk", T.StringType(), True),
    ]
)
