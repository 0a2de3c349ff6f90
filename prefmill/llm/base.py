"""What the operators of this folder share: table readers, Arrow batch loops and held-out folds."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of text that one step inside a task holds as Python objects; a longer text is a step of its own.
STEP_CHARS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the host keeps a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_CHARS):
    """Consecutive slices of a batch with about ``limit`` bytes of text each."""
    values = batch.column(column)
    start, size = 0, 0
    for i in range(batch.num_rows):
        n = len(values[i].as_buffer()) if values[i].is_valid else 0
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_steps(df: DataFrame, schema: str, step, column: str = "text", limit: int = STEP_CHARS) -> DataFrame:
    """mapInArrow whose function gets slices of bounded text and returns a dict of columns, or yields several."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches):
        for batch in batches:
            for part in steps(batch, column, limit):
                yield pa.RecordBatch.from_arrays([_array(v, f.type) for v, f in zip(step(part), arrow)], schema=arrow)

    return df.mapInArrow(run, parsed)


def _array(values, kind) -> pa.Array:
    return values if isinstance(values, pa.Array) and values.type == kind else pa.array(values, kind)
