"""Streaming jobs over file streams. Stateless chains are the batch expressions. Moments and the log monitor are streaming
aggregations and the shuffle buffer is keyed state, all in the engine's own store. The batcher and take-skip, where the order
of a shard or stream counts, keep a small table in the shared folder, versioned by micro-batch, so a replayed micro-batch
writes the same version again and a hot shard is still spread out."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prefmill.functions.hashing import draw60, keyed
from prefmill.operators.rowindex import ordered_index, shuffled_index
from prefmill.session import entries, scratch_path, settled


def open_stream(spark: SparkSession, path: str, schema, files: int = 1, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream to the end of its input into a parquet table and return the table."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def each_batch(stream: DataFrame, fn, checkpoint: str, mode: str = "append") -> None:
    def held(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            fn(df, batch)
        finally:
            df.unpersist()

    query = (stream.writeStream.foreachBatch(held).option("checkpointLocation", checkpoint).outputMode(mode)
             .trigger(availableNow=True).start())
    query.awaitTermination()


class Versions:
    """A table with one version per micro-batch. The newest version is looked up in the folder, so a restart on the same
    checkpoint goes on from it, also when no new data came."""

    def __init__(self, path: str):
        self.path = path

    def before(self, spark: SparkSession, batch: int) -> DataFrame | None:
        return spark.read.parquet(f"{self.path}/v={batch - 1}") if batch > 0 else None

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")

    def latest(self, spark: SparkSession) -> DataFrame:
        last = max(int(name[2:]) for name in entries(spark, self.path) if name.startswith("v="))
        return spark.read.parquet(f"{self.path}/v={last}")

    def all(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def stream_shuffle(stream: DataFrame, key: str, path: str, checkpoint: str, seed=0) -> DataFrame:
    """Rows of each micro-batch in hashed order: v (micro-batch) and pos. The micro-batch is the shuffle buffer; its size
    is set where the stream is opened."""
    out = Versions(path)

    def one(df: DataFrame, batch: int) -> None:
        out.write(shuffled_index(df, [key], seed, name="pos"), batch)

    each_batch(stream, one, checkpoint)
    return out.all(stream.sparkSession)


def shuffle_buffer(stream: DataFrame, key: str, path: str, checkpoint: str, buffer: int = 16384, seed=0) -> DataFrame:
    """Rows of the whole stream in the order of a seeded shuffle buffer that lives across micro-batches: the row and pos.

    The buffer has ``buffer`` places. A row's place follows from a hash of its key; the row it finds there leaves and it
    stays until the next one comes. Rows of a micro-batch come in hashed order, so a row leaves after as many others as
    chance has it, ``buffer`` on average, often some micro-batches later. Each place is a key of the engine's state, so
    places are spread over all tasks and a micro-batch writes those it touches. Rows still held when the input ends are
    read from the state and come last, in hashed order. A second run on the same folders goes on with the held rows.

    Rows travel as JSON texts, so map keys must be texts. Rows with equal keys share a place, also null ones, and follow
    each other by their texts. A stream without rows gives none.
    """
    spark, fields = stream.sparkSession, stream.schema
    as_text = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    coming = stream.select((keyed(seed, F.lit("place"), key) % buffer).alias("place"), draw60(seed, F.lit("turn"), key).alias("turn"),
                           F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns]), as_text).alias("row"))

    def swapped(_, frames, state):
        import pandas as pd
        rows = pd.concat(list(frames)).sort_values(["turn", "row"])
        texts, turns = rows["row"].tolist(), rows["turn"].tolist()
        if state.exists:
            texts = [state.get[1], *texts]
        else:
            turns = turns[1:]
        state.update((int(rows["turn"].iloc[-1]), texts[-1]))
        yield pd.DataFrame({"turn": pd.Series(turns, dtype="int64"), "row": pd.Series(texts[:-1], dtype="object")})

    left = coming.groupBy("place").applyInPandasWithState(swapped, "turn long, row string", "turn long, row string", "append", "NoTimeout")
    out = Versions(path)
    each_batch(left, out.write, checkpoint)
    last = F.lit(None).cast("int")
    held = spark.read.format("statestore").load(checkpoint).select(F.col("value.groupState.*"), last.alias("v"))
    gone = out.all(spark).select("turn", "row", "v")
    rows = gone.unionByName(held.select("turn", "row", "v")).withColumn("_rest", F.col("v").isNull())
    placed = ordered_index(rows, ["_rest", "v", "turn", "row"], name="pos")
    return placed.select(F.from_json("row", fields, as_text).alias("_r"), "pos").select("_r.*", "pos")


def stream_take_skip(stream: DataFrame, key: str, take: int, path: str, checkpoint: str) -> DataFrame:
    """The first ``take`` rows of the stream (by key inside a micro-batch) are validation rows, the rest training rows."""
    if int(take) != take:
        raise ValueError("a stream needs a whole number of validation rows")
    out, counts = Versions(path), Versions(f"{path}-taken")  # the count so far is one row per micro-batch

    def one(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = counts.before(spark, batch)
        taken = before.first()["taken"] if before is not None else 0
        counts.write(spark.range(1).select(F.lit(min(take, taken + df.count())).cast("long").alias("taken")), batch)
        if taken >= take:
            out.write(df.withColumn("split", F.lit("train")), batch)
            return
        held = ordered_index(df, [key])
        out.write(held.withColumn("split", F.when(F.col("idx") < take - taken, "validation").otherwise("train")).drop("idx"), batch)

    each_batch(stream, one, checkpoint)
    return out.all(stream.sparkSession)


def hash_split(stream: DataFrame, key: str, share: float, seed=0) -> DataFrame:
    """Stateless split for streams without a usable start: a row's hash decides."""
    return stream.withColumn("split", F.when(keyed(seed, key) < share * (1 << 32), "validation").otherwise("train"))


def _smoothed(parts: Column, decay: float) -> Column:
    """Stretches of losses in order (at, n, x0, s, loss) as one: n losses of which x0 is the first and loss the last; a
    value before them becomes decay ** n times itself plus s."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("x0"), F.lit(0.0).alias("s"),
                    F.lit(None).cast("double").alias("loss"))
    return F.aggregate(F.array_sort(parts), none, lambda a, p: F.struct(
        (a["n"] + p["n"]).alias("n"), F.coalesce(a["x0"], p["x0"]).alias("x0"),
        (F.pow(F.lit(decay), p["n"]) * a["s"] + p["s"]).alias("s"), F.coalesce(p["loss"], a["loss"]).alias("loss")))


def stream_log_monitor(stream: DataFrame, path: str, checkpoint: str, decay: float = 0.9, block: int = 1024) -> DataFrame:
    """Per run: the newest log row and a decayed loss, s = decay * s + (1 - decay) * loss in the order of the steps,
    starting at the first loss.

    The state is a streaming aggregation over (run, block of steps): the engine keeps a block's losses, and a micro-batch
    costs the blocks it touches, each written as one row of a version. A run with most of the rows is many blocks; they
    are folded as stretches, ``block`` at a time, in as many levels as needed, so no group holds more than ``block``
    stretches. A block holds ``block`` losses if steps differ; a step logged again and again adds to its block. Late
    rows take their place by step. Rows with a null step have a block of their own, before the others.
    """
    fields = ["current_steps", "total_steps", "lr", "total_tokens"]
    x = F.col("loss").cast("double")
    one = F.struct(F.col("current_steps").alias("at"), F.lit(1).cast("long").alias("n"), x.alias("x0"), ((1 - decay) * x).alias("s"), x.alias("loss"))
    last, spark, out = F.max_by("_row", "_row.current_steps").alias("_row"), stream.sparkSession, Versions(path)
    blocks = (stream.select("run", F.floor(F.col("current_steps") / block).alias("at"), F.struct(*fields).alias("_row"),
                            F.when(F.col("loss").isNotNull(), one).alias("_part"))
              .groupBy("run", "at").agg(last, F.collect_list("_part").alias("_parts"))
              .select("run", "at", "_row", _smoothed(F.col("_parts"), decay).alias("_part")))
    each_batch(blocks, out.write, checkpoint, "update")
    newest = settled(out.all(spark).groupBy("run", "at").agg(F.max_by(F.struct("_row", "_part"), "v").alias("_new")).select("run", "at", "_new.*"))
    span = newest.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    low, high = (span["a"] or 0, span["b"] or 0)
    part = F.struct("at", "_part.n", "_part.x0", "_part.s", "_part.loss")
    while high - low >= block:
        newest = (newest.groupBy("run", F.floor(F.col("at") / block).alias("_above")).agg(last, F.collect_list(part).alias("_parts"))
                  .select("run", F.col("_above").alias("at"), "_row", _smoothed(F.col("_parts"), decay).alias("_part")))
        low, high = low // block, high // block
    runs = newest.groupBy("run").agg(last, F.collect_list(part).alias("_parts")).withColumn("_part", _smoothed(F.col("_parts"), decay))
    return runs.select("run", "_row.*", "_part.loss", (F.pow(F.lit(decay), "_part.n") * F.col("_part.x0") + F.col("_part.s")).alias("smoothed"))


def stream_running_moments(stream: DataFrame, key: str, value: str, path: str, checkpoint: str) -> DataFrame:
    """key, n, mean, m2 over everything seen. The sums are a streaming aggregation, so the engine keeps them and a
    micro-batch costs the keys it touches: its new values are added to the table as one version, and the newest version
    of a key counts. A replayed micro-batch writes its version again."""
    sums = stream.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                   (F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(value)).alias("m2"))
    out = Versions(path)
    each_batch(sums, out.write, checkpoint, "update")
    seen = out.all(stream.sparkSession)
    return seen.groupBy(key).agg(F.max_by(F.struct("n", "mean", "m2"), "v").alias("_s")).select(key, "_s.*")


def stream_batcher(stream: DataFrame, key: str, shard: str, size: int, path: str, checkpoint: str, tokens: str | None = None,
                   max_tokens: int = 1_000_000_000) -> DataFrame:
    """Full batches of ``size`` rows per shard, in stream order: shard, batch, slot and the row. Rows that do not fill a
    batch wait in a buffer table for the next micro-batch and are dropped at the end of the stream."""
    rows_at, counts = Versions(f"{path}/rows"), Versions(f"{path}/counts")

    def one(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        rows = ordered_index(df, [key], group=[shard], name="_i")
        seen = counts.before(spark, batch)
        before = F.lit(0)
        if seen is not None:
            rows, before = rows.join(seen, shard, "left"), F.coalesce("_seen", F.lit(0))
        rows = rows.withColumn("_seq", F.col("_i") + before).drop("_i", "_seen")
        held = rows_at.before(spark, batch)
        if held is not None:
            rows = rows.unionByName(held.filter("not _ready").select(rows.columns))
        fresh = rows.groupBy(shard).agg((F.max("_seq") + 1).alias("_seen"))
        if seen is not None:
            fresh = fresh.unionByName(seen).groupBy(shard).agg(F.max("_seen").alias("_seen"))
        full = F.floor(F.col("_seen") / size) * size
        if tokens:
            waiting = rows.join(fresh, shard).filter(F.col("_seq") >= full)
            buffered = waiting.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("t")).first()["t"]
            if buffered > max_tokens:
                raise ValueError(f"buffer holds {buffered} tokens, more than {max_tokens}")
        counts.write(fresh, batch)
        placed = rows.join(counts.latest(spark), shard)
        rows_at.write(placed.withColumn("_ready", F.col("_seq") < full).drop("_seen"), batch)

    each_batch(stream, one, checkpoint)
    done = rows_at.all(stream.sparkSession).filter("_ready")
    return done.withColumn("batch", F.floor(F.col("_seq") / size)).withColumn("slot", F.col("_seq") % size).drop("_seq", "_ready", "v")


def folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output folder, checkpoint folder) for one run of a job."""
    base = scratch_path(spark, name)
    return f"{base}/table", f"{base}/progress"
