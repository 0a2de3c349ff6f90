"""Schemas that cross module borders."""

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = "array<struct<role:string,content:string>>"
PARTS = "array<struct<type:string,value:string>>"
RICH_MESSAGES = f"array<struct<role:string,content:{PARTS},loss_weight:double>>"

# The hub row that every aligner produces.
ALIGNED = T.StructType([
    T.StructField("_prompt", T.ArrayType(MESSAGE)),
    T.StructField("_response", T.ArrayType(MESSAGE)),
    T.StructField("_system", T.StringType()),
    T.StructField("_tools", T.StringType()),
    T.StructField("_images", T.ArrayType(T.StringType())),
    T.StructField("_videos", T.ArrayType(T.StringType())),
    T.StructField("_audios", T.ArrayType(T.StringType())),
])

# Trainer log lines are sparse; every field is nullable.
TRAINER_LOG = T.StructType([
    T.StructField("run", T.LongType()),
    T.StructField("current_steps", T.LongType()),
    T.StructField("total_steps", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("lr", T.DoubleType()),
    T.StructField("epoch", T.DoubleType()),
    T.StructField("elapsed_s", T.DoubleType()),
    T.StructField("total_tokens", T.LongType()),
])
