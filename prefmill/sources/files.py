"""Reading and writing dataset files."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.errors import AnalysisException

from prefmill.functions.jsontext import quoted
from prefmill.operators.align import CONVERTERS
from prefmill.operators.media import list_files
from prefmill.operators.sampling import contiguous_shards, sample_max, sample_num, sample_weighted
from prefmill.sources.registry import DatasetSpec
from prefmill.session import entries, scratch_path, settled

# File ending -> reader.
KINDS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}


def file_kind(spark: SparkSession, path: str) -> str:
    """The one reader kind of all files below a path."""
    ending = F.regexp_extract("path", r"\.([^./]+)$", 1)
    try:
        found = {r["e"] for r in list_files(spark, path).select(ending.alias("e")).distinct().collect()}
    except AnalysisException:
        raise ValueError(f"file {path} not found") from None
    kinds = {KINDS.get(e) for e in found}
    if None in kinds or not kinds:
        raise ValueError(f"allowed file types: {', '.join(KINDS)}")
    if len(kinds) > 1:
        raise ValueError("file types should be identical")
    if kinds == {"arrow"}:
        raise ValueError("convert arrow files to parquet first; Spark has no arrow source")
    return kinds.pop()


def _is_array(spark: SparkSession, path: str) -> bool:
    lines = spark.read.text(path, recursiveFileLookup=True).filter(F.length(F.trim("value")) > 0)
    first = lines.head()
    return bool(first) and first["value"].lstrip().startswith("[")


#: Bytes from which a JSON array is cut into records by many tasks instead of being one task's.
SPLIT_BYTES = 128 << 20


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """value: the objects of JSON array files, one row each, without line ends. Many tasks read one file.

    Files are read as pieces that end in ``}``, wherever their blocks begin. Whether a piece starts inside a string follows
    from the number of quotes before it, its depth from the brackets before it that stand outside of strings; both are
    sums inside a block plus sums over the blocks before, of which there is one row each. A record ends where a brace
    outside of strings leads back to the array itself.
    """
    block = ["file", "block"]
    pieces = (spark.read.option("recursiveFileLookup", "true").option("lineSep", "}").text(path)
              .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
              .withColumn("at", F.monotonically_increasing_id()))
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes; none reaches over a brace
    pieces = settled(pieces.withColumn("plain", plain).withColumn("quotes", F.length("plain") - F.length(F.replace("plain", F.lit('"')))))
    inner = Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def before(rows, column):
        """Sum of a column over all pieces of the file before each one."""
        totals = rows.groupBy(*block).agg(F.sum(column).alias("_n"))
        totals = totals.select(*block, F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_above"))
        return rows.withColumn("_in", F.coalesce(F.sum(column).over(inner), F.lit(0))).join(totals, block).withColumn(
            f"{column}_before", F.col("_in") + F.col("_above")).drop("_in", "_above")
    rows = before(pieces, "quotes")
    # A quote in front closes the string that the piece starts in; strings that end inside go, and one that does not.
    whole = F.concat(F.when(F.col("quotes_before") % 2 == 1, F.lit('"')).otherwise(""), F.col("plain"))
    bare = F.regexp_replace(whole, '"[^"]*("|$)', "")
    outside = (F.col("quotes_before") + F.col("quotes")) % 2 == 0

    def count(*signs):
        return sum((F.length(bare) - F.length(F.replace(bare, F.lit(c))) for c in signs), F.lit(0))
    rows = rows.select(*block, "at", "value", outside.alias("outside"), (count("{", "[") - count("]") - F.when(outside, 1).otherwise(0)).cast("long").alias("step"))
    rows = before(settled(rows), "step")
    ends = (F.col("outside") & (F.col("step_before") + F.col("step") == 1)).cast("long")
    rows = before(settled(rows.withColumn("ends", ends).drop("step", "step_before")), "ends")
    cells = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    found = rows.groupBy("file", F.col("ends_before").alias("record")).agg(cells.alias("cells"), F.max("ends").alias("ends")).filter("ends = 1")
    text = F.concat(F.array_join(F.transform("cells", lambda c: c["value"]), "}"), F.lit("}"))
    return found.select(F.regexp_replace(F.regexp_replace(text, r"^[\s,\[]+", ""), r"[\r\n]+", " ").alias("value"))


def read_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of JSON array files by ``array_records``: the records become lines in the shared folder, which any number of
    tasks read."""
    lines = scratch_path(spark, "records")
    array_records(spark, path).write.text(lines)
    return (spark.read.schema(schema) if schema is not None else spark.read).json(lines)


def read_files(spark: SparkSession, path: str, schema=None, kind: str | None = None, multiline: bool = False) -> DataFrame:
    """A file or folder in the format its endings tell; JSON may be lines or arrays. CSV cells with line ends need
    ``multiline``, which makes each file one task; a large JSON array is read by many."""
    kind = kind or file_kind(spark, path)
    reader = spark.read.option("recursiveFileLookup", "true")
    if schema is not None and kind != "text":
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, multiLine=multiline, escape='"')
    if kind == "text":
        return reader.text(path).withColumnRenamed("value", "text")
    if kind == "json":
        if not _is_array(spark, path):
            return reader.json(path)
        largest = list_files(spark, path, "length").agg(F.max("length")).first()[0]
        return read_array(spark, path, schema) if largest >= SPLIT_BYTES else reader.json(path, multiLine=True)
    return reader.parquet(path)


def read_cloud_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All .json and .jsonl files below a path of any Hadoop file system (s3a://, gs://, file:); other files and blank
    lines are ignored. Credentials and anonymous access are file-system settings."""
    reader = spark.read.option("pathGlobFilter", "*.{json,jsonl}").option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, lines that do not). Blank lines are neither."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    bad = F.col("_r._bad").isNotNull()
    good = parsed.filter(~bad).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.filter(bad).select(F.col("value").alias("line"))


def read_csv_prompts(spark: SparkSession, path: str, column: str = "goal", multiline: bool = False) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=multiline, escape='"').select(column)


def read_set(spark: SparkSession, specs: dict[str, dict], converters: dict = CONVERTERS) -> DataFrame:
    """A named set of datasets: per name path, kind, split, converter, key, size, weight, streaming. Rows carry
    _dataset_name. Either all members stream or none does."""
    flags = {bool(s.get("streaming", False)) for s in specs.values()}
    if len(flags) > 1:
        raise ValueError("all datasets must be streaming or none")
    streaming = flags == {True}
    sampled = [name for name, s in specs.items() if s.get("size") is not None or s.get("weight") is not None]
    if streaming and sampled:
        raise ValueError(f"a stream has no size to sample from: {', '.join(sampled)}")
    out = None
    for name, spec in specs.items():
        if streaming:
            df = spark.readStream.schema(spec["schema"]).format(spec.get("kind", "json")).load(spec["path"])
        else:
            df = read_files(spark, spec["path"], spec.get("schema"))
        if "split" in spec and "split" in df.columns:
            df = df.filter(F.col("split") == spec["split"])
        if name in sampled:
            df = sample_weighted(df, spec["key"], spec.get("size"), spec.get("weight"), spec.get("seed", 0)).drop("idx")
        if spec.get("converter"):
            df = converters[spec["converter"]](df, [spec["key"]] if "key" in spec else [])
        df = df.withColumn("_dataset_name", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def load_spec(spark: SparkSession, spec: DatasetSpec, folder: str, key: str | None = None, max_samples: int | None = None,
              seed=0) -> DataFrame:
    """Read one registered dataset, with its own sample size and the general row limit."""
    if spec.load_from == "cloud_file":
        df = read_cloud_json(spark, spec.location)
    elif spec.load_from == "file":
        df = read_files(spark, f"{folder.rstrip('/')}/{spec.location}")
    else:
        raise ValueError(f"cannot load from {spec.load_from}; download the files first")
    if spec.num_samples is not None:
        df = sample_num(df, key, spec.num_samples, seed)
    return sample_max(df, key, max_samples) if max_samples is not None else df


def prepared(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path`` if it was written to its end and holds rows, else the built one, written there by split
    first. A table that is there but cannot be read is an error and is never overwritten."""
    if "_SUCCESS" in entries(spark, path):
        table = spark.read.parquet(path)
        if table.head() is not None:
            return table
    build().write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path)


# ---- sinks ----------------------------------------------------------------------------------------------------------

def _object(pairs) -> F.Column:
    cells = []
    for i, (name, text) in enumerate(pairs):
        cells += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), text]
    return F.concat(*cells, F.lit("}"))


def write_predictions(df: DataFrame, path: str, columns=("prompt", "predict", "label")) -> None:
    """One JSON object per line; text stays unescaped beyond what JSON needs."""
    df.select(_object([(c, quoted(F.col(c))) for c in columns]).alias("value")).write.text(path)


def write_pair_scores(df: DataFrame, path: str) -> None:
    """{"chosen": x, "rejected": y} per line, two decimals."""
    def shown(c):
        rounded = F.round(F.col(c).cast("double"), 2)
        return F.when((rounded == 0) & (F.col(c) < 0), "-0.0").otherwise(rounded.cast("string"))
    df.select(_object([("chosen", shown("chosen")), ("rejected", shown("rejected"))]).alias("value")).write.text(path)


def write_shards(df: DataFrame, key: str, world: int, path: str) -> None:
    """Contiguous shards as folders shard=00001-of-0000W of JSON lines."""
    rows = contiguous_shards(df, key, world)
    name = F.format_string(f"%05d-of-{world:05d}", F.col("shard") + 1)
    rows = rows.withColumn("shard", name).repartitionByRange("idx").sortWithinPartitions("idx")
    rows.drop("idx").write.partitionBy("shard").json(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Raw rows as JSON lines and a one-line table of means per run."""
    df.write.json(f"{path}/raw")
    means = df.groupBy("run").agg(F.avg("reward").alias("mean reward"), F.avg("cost").alias("mean cost"))
    means.write.partitionBy("run").csv(f"{path}/mean", header=True)
