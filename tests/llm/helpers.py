from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENT = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                       StructField("source", StringType()), StructField("n_chars", LongType()),
                       # names that operators use inside
                       StructField("score", StringType()), StructField("h", StringType()), StructField("family", StringType())])


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "s")[len(r) - 2:]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", "y", "z") for i, t, g, s in full], DOCUMENT)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
