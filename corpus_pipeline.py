"""A cleaning pipeline over the documents table: five stages, each one operator of prefmill.llm.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the columns of documents; the last
returns packed pieces. Tables beside documents (labels, benchmark) are read from sf_dir.

Rows with a null text pass the filters: they score as texts without toxic signs, have no shingles, match no benchmark
item and hold no personal data; packing gives them the end id alone. Repeated rows are one document to the near-duplicate
stage, so one of them stays. Empty tables give empty results, and extra columns are carried through to the last stage.
The executors keep what a stage made them take, so every stage hands whole documents to Python in small batches.
"""

from pyspark.sql import DataFrame, SparkSession

from prefmill.llm import decontaminate, mixpack, pii, superminhash, toxicity
from prefmill.llm.base import table, tokenizer_path
from prefmill.session import gathered, settled, text_batches

SHINGLE, SIMILAR = 5, 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return gathered(toxicity.clean(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return gathered(superminhash.deduplicated(docs, SHINGLE, SIMILAR))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return gathered(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return gathered(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return mixpack.packed(docs, tokenizer_path())


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_copies), ("decontamination", without_benchmark),
          ("personal_data", without_personal_data), ("packing", packed)]

#: Embeddings, permutation sketches, latent spaces and subword ids are beyond SQL; tests compare each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
