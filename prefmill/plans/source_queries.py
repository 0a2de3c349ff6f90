"""Sources and sinks: tables are written to the shared folder in a file format and read back."""

from pyspark.sql import functions as F

from prefmill.operators import encode as E, mixing as MX
from prefmill.plans import encode_queries as EQ, fixtures as X
from prefmill.plans.base import h, h60, query
from prefmill.session import scratch_path
from prefmill.sources import files as FS, registry as R
from prefmill.functions.hashing import hash32

TURN = "conv_id long, turn long, role string, text string"


def entries(spark, folder):
    """One registry entry per document source; some replace the column or tag block, some name a hub."""
    rows = X.table(spark, folder, "documents").select(F.col("source").alias("name")).distinct()
    n = hash32(F.col("name"))
    return rows.select("name", F.when(n % 2 == 0, "sharegpt").alias("formatting"), F.when(n % 3 == 0, True).alias("ranking"),
                       F.lit(None).cast("string").alias("split"), F.when(n % 6 == 0, F.concat(F.lit("hub/"), "name")).alias("hf_hub_url"),
                       F.concat("name", F.lit(".json")).alias("file_name"),
                       F.when(n % 4 == 0, F.create_map(F.lit("prompt"), F.lit("text"))).alias("columns"),
                       F.when(n % 5 == 0, F.create_map(F.lit("role_tag"), F.lit("role"), F.lit("content_tag"), F.lit("content"))).alias("tags"))


_ENTRIES = f"en AS (SELECT name, {h('name')} AS n FROM (SELECT DISTINCT source AS name FROM documents))"


@query("src_registry", f"""WITH {_ENTRIES} SELECT name, 'ok' AS status, CASE WHEN n%6=0 THEN 'hub' ELSE 'file' END AS load_from, CASE WHEN n%6=0 THEN 'hub/'||name ELSE name||'.json' END AS location,
  CASE WHEN n%2=0 THEN 'sharegpt' ELSE 'alpaca' END AS formatting, n%3=0 AS ranking, CASE WHEN n%4=0 THEN 'text' ELSE 'instruction' END AS prompt,
  CASE WHEN n%4<>0 THEN 'input' END AS query, CASE WHEN n%4<>0 THEN 'conversations' END AS messages, CASE WHEN n%5=0 THEN 'role' ELSE 'from' END AS role_tag, CASE WHEN n%5<>0 THEN 'human' END AS user_tag FROM en
UNION ALL SELECT 'missing_'||lang, 'undefined', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT lang FROM documents)""")
def src_registry(spark, folder):
    table = entries(spark, folder)
    lost = X.table(spark, folder, "documents").select(F.concat(F.lit("missing_"), "lang").alias("name")).distinct()
    found, missing = R.resolve_table(table, table.select("name").unionByName(lost))
    out = found.select("name", F.lit("ok").alias("status"), "load_from", "location", "formatting", "ranking", "prompt", "query", "messages", "role_tag", "user_tag")
    return out.unionByName(missing.withColumn("status", F.lit("undefined")), allowMissingColumns=True)


@query("dataset_inventory", f"""WITH {_ENTRIES} SELECT name, stage FROM en, (VALUES ('dpo'),('sft')) s(stage) WHERE (n%3=0) = (stage='dpo')""")
def dataset_inventory(spark, folder):
    table = entries(spark, folder)
    return R.usable_for(table, "dpo").select("name", F.lit("dpo").alias("stage")).unionByName(R.usable_for(table, "sft").select("name", F.lit("sft").alias("stage")))


def _turns(df, kind):
    return df.select(F.lit(kind).alias("kind"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.md5("text").alias("text"))


@query("src_files", "SELECT kind, conv_id, turn, role, md5(text) AS text FROM conversations, (VALUES ('json'),('csv'),('parquet')) k(kind)")
def src_files(spark, folder):
    rows = X.table(spark, folder, "conversations")
    base = scratch_path(spark, "files")
    rows.write.json(f"{base}/json")
    rows.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/csv", header=True)
    rows.write.parquet(f"{base}/parquet")
    out = None
    for kind in ("json", "csv", "parquet"):
        df = _turns(FS.read_files(spark, f"{base}/{kind}", TURN, multiline=True), kind)
        out = df if out is None else out.unionByName(df)
    return out


@query("src_cloud_json", "SELECT 'cloud' AS kind, conv_id, turn, role, md5(text) AS text FROM conversations")
def src_cloud_json(spark, folder):
    rows = X.table(spark, folder, "conversations")
    base = scratch_path(spark, "cloud")
    rows.write.json(f"{base}/a")
    rows.select("text").write.text(f"{base}/notes")
    return _turns(FS.read_cloud_json(spark, base, TURN), "cloud")


@query("src_jsonl_tolerant", f"""SELECT 'row' AS kind, conv_id, turn, md5(text) AS text FROM conversations WHERE {h("'bad:'||conv_id||':'||turn")} % 9 <> 0
UNION ALL SELECT 'line', NULL, NULL, md5('{{"conv_id": '||conv_id) FROM conversations WHERE {h("'bad:'||conv_id||':'||turn")} % 9 = 0""")
def src_jsonl_tolerant(spark, folder):
    rows = X.table(spark, folder, "conversations")
    bad = X.tag("bad", "conv_id", "turn") % 9 == 0
    line = F.when(bad, F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string"))).otherwise(F.to_json(F.struct("conv_id", "turn", "role", "text")))
    blank = F.when(bad, F.array(line, F.lit("  "))).otherwise(F.array(line))
    path = scratch_path(spark, "tolerant")
    rows.select(F.explode(blank).alias("value")).write.text(path)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    good, lost = FS.read_jsonl_tolerant(spark, path, schema)
    none = F.lit(None).cast("bigint")
    return good.select(F.lit("row").alias("kind"), "conv_id", "turn", F.md5("text").alias("text")).unionByName(
        lost.select(F.lit("line").alias("kind"), none.alias("conv_id"), none.alias("turn"), F.md5("line").alias("text")))


@query("src_csv_prompts", f"WITH {X.PAIRS} SELECT md5(instruction) AS goal FROM pairs")
def src_csv_prompts(spark, folder):
    path = scratch_path(spark, "goals")
    rows = X.pairs(spark, folder).select("id", F.col("instruction").alias("goal"), F.lit("x, \"y\"").alias("target"))
    rows.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    return FS.read_csv_prompts(spark, path, multiline=True).select(F.md5("goal").alias("goal"))


@query("src_tokenized", f"""WITH s AS (SELECT conv_id, n, row_number() OVER (ORDER BY {h("'4:'||conv_id")}, conv_id)-1 AS idx, count(*) OVER () AS total FROM ({EQ.sft_sql(EQ._C, EQ.CUT)}))
SELECT conv_id, n, CASE WHEN idx < ceil(total*0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM s""")
def src_tokenized(spark, folder):
    path = scratch_path(spark, "tokenized")

    def build():
        encoded = E.encode_sft(X.hub(spark, folder), "chatml", EQ.CUT, ["conv_id"])
        return MX.split(encoded, "conv_id", 0.2, seed=4).drop("idx")

    def never():
        raise RuntimeError("the prepared table should be reused")

    FS.prepared(spark, path, build)
    return FS.prepared(spark, path, never).select("conv_id", F.size("input_ids").cast("bigint").alias("n"), "split")


@query("src_v1_yaml", f"""WITH {X.PAIRS}, p AS (SELECT id, row_number() OVER (ORDER BY id)-1 AS idx, count(*) OVER () AS n FROM pairs)
SELECT 'half' AS dataset, id FROM (SELECT {h60("'0:weight:draw:'||draw")} % (SELECT max(n) FROM p) AS idx FROM (SELECT unnest(range((SELECT floor(max(n)*0.5)::BIGINT FROM p))) AS draw)) d JOIN p USING (idx)
UNION ALL SELECT 'whole', id FROM p""")
def src_v1_yaml(spark, folder):
    path = scratch_path(spark, "set")
    X.pairs(spark, folder).select("id", "instruction", "input", "output").write.json(path)
    spec = dict(path=path, converter="alpaca", key="id", schema="id long, instruction string, input string, output string")
    sets = FS.read_set(spark, {"half": dict(spec, weight=0.5), "whole": spec})
    return sets.select(F.col("_dataset_name").alias("dataset"), "id")


@query("sink_predictions", f"""WITH {X.PREDS} SELECT '{{"prompt": '||to_json(prompt)::VARCHAR||', "predict": '||to_json(predict)::VARCHAR||', "label": '||to_json(label)::VARCHAR||'}}' AS line FROM preds""")
def sink_predictions(spark, folder):
    path = scratch_path(spark, "predictions")
    FS.write_predictions(X.predictions(spark, folder), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_pair_scores", f"""WITH {X.SCORES} SELECT '{{"chosen": '||round(reward/7,2)::VARCHAR||', "rejected": '||round(cost/7,2)::VARCHAR||'}}' AS line FROM scores""")
def sink_pair_scores(spark, folder):
    path = scratch_path(spark, "pairs")
    FS.write_pair_scores(X.scores(spark, folder).select((F.col("reward") / 7).alias("chosen"), (F.col("cost") / 7).alias("rejected")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_shards", """WITH p AS (SELECT doc_id, md5(text) AS text, row_number() OVER (ORDER BY doc_id)-1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, text, lpad((floor(idx/ceil(n/7::DOUBLE))+1)::INT::VARCHAR,5,'0')||'-of-00007' AS shard FROM p""")
def sink_shards(spark, folder):
    path = scratch_path(spark, "shards")
    FS.write_shards(X.table(spark, folder, "documents").select("doc_id", F.md5("text").alias("text")), "doc_id", 7, path)
    return spark.read.schema("doc_id long, text string, shard string").json(path)


@query("sink_scores", f"""WITH {X.SCORES} SELECT run, count(*)::BIGINT AS rows, round(avg(reward),6)+0.0 AS mean_reward, round(avg(cost),6)+0.0 AS mean_cost FROM scores GROUP BY run""")
def sink_scores(spark, folder):
    path = scratch_path(spark, "scores")
    FS.write_scores(X.scores(spark, folder), path)
    raw = spark.read.schema("run double, reward double").json(f"{path}/raw").groupBy("run").agg(F.count(F.lit(1)).alias("rows"))
    means = spark.read.schema("`mean reward` double, `mean cost` double, run double").csv(f"{path}/mean", header=True)
    return raw.join(means, "run").select("run", "rows", (F.round("mean reward", 6) + 0.0).alias("mean_reward"), (F.round("mean cost", 6) + 0.0).alias("mean_cost"))
