"""Inputs of the registered queries, all derived from the given tables: once as DataFrames, once as SQL CTEs."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from prefmill.functions.hashing import hash32
from prefmill.operators.align import align_sharegpt, group_turns
from prefmill.plans.base import h
from prefmill.session import spread
from prefmill.sources.registry import DatasetSpec

LANGS = ["en", "fr", "de", "es"]
TOOLS_JSON = ('[{"name": "lookup", "description": "find a value", "parameters": {"type": "object", "properties": '
              '{"k": {"type": "number", "description": "key"}}, "required": ["k"]}}]')


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def tag(prefix: str, *cols) -> "F.Column":
    """hash32 of prefix:col:col, as text joined by colons."""
    return hash32(F.concat_ws(":", F.lit(prefix), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                                     for c in cols]))


def pairs(spark, folder) -> DataFrame:
    """Each user turn with the assistant turn that follows."""
    w = Window.partitionBy("conv_id")
    by_turn = w.orderBy("turn")
    seen = table(spark, folder, "conversations").select(
        "*", F.lead("text").over(by_turn).alias("output"), F.lead("role").over(by_turn).alias("_next"),
        F.max(F.when(F.col("role") == "system", F.col("text"))).over(w).alias("system"))
    ident = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    out = seen.filter("role = 'user' and _next = 'assistant'").select(
        ident, "conv_id", "turn", F.col("text").alias("instruction"), "output", "system")
    return out.withColumn("input", F.when(tag("in", "id") % 3 == 0, F.concat(F.lit("Note "), F.col("id").cast("string")))
                          .otherwise(""))


PAIRS = f"""pairs AS (
  SELECT *, CASE WHEN {h("'in:'||id")} % 3 = 0 THEN 'Note '||id ELSE '' END AS input FROM (
    SELECT conv_id*1000+turn AS id, conv_id, turn, text AS instruction, output, system FROM (
      SELECT *, lead(text) OVER w AS output, lead(role) OVER w AS nrole,
             max(CASE WHEN role='system' THEN text END) OVER (PARTITION BY conv_id) AS system
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role='user' AND nrole='assistant'))"""


def alpaca(spark, folder) -> DataFrame:
    """Pairs with the earlier pairs of the conversation as history."""
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return pairs(spark, folder).withColumn("history", F.collect_list(F.array("instruction", "output")).over(earlier))


def preferences(spark, folder) -> DataFrame:
    """A prompt with a better and a worse answer; the worse (or, after a swap, the better) one misses a letter."""
    thin = F.replace("output", F.lit("e"), F.lit(""))
    swap = tag("sw", "id") % 2 == 0
    return pairs(spark, folder).select("id", F.col("instruction").alias("prompt"),
                                       F.when(swap, thin).otherwise(F.col("output")).alias("chosen"),
                                       F.when(swap, F.col("output")).otherwise(thin).alias("rejected"))


PREFS = PAIRS + f""", prefs AS (
  SELECT id, instruction AS prompt,
         CASE WHEN {h("'sw:'||id")} % 2 = 0 THEN replace(output,'e','') ELSE output END AS chosen,
         CASE WHEN {h("'sw:'||id")} % 2 = 0 THEN output ELSE replace(output,'e','') END AS rejected FROM pairs)"""


def chats(spark, folder) -> DataFrame:
    """conv_id, conversations(from, value)."""
    grouped = group_turns(table(spark, folder, "conversations"))
    names = {"user": "human", "assistant": "gpt"}
    named = F.transform("messages", lambda m: F.struct(
        F.when(m["role"] == "user", names["user"]).when(m["role"] == "assistant", names["assistant"])
        .otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    return grouped.select("conv_id", named.alias("conversations"))


def hub(spark, folder) -> DataFrame:
    """Chats in the hub schema."""
    return align_sharegpt(chats(spark, folder), DatasetSpec("chats", formatting="sharegpt"), keep=["conv_id"])


# Body turns (no leading system), validity and hub rows in SQL.
BODY = """body AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE NOT (role='system' AND turn=0)),
valid AS (
  SELECT conv_id, bool_and(role = CASE WHEN i%2=0 THEN 'user' ELSE 'assistant' END) AS ordered, max(n) AS n
  FROM body GROUP BY conv_id),
sys AS (SELECT conv_id, coalesce(max(CASE WHEN role='system' AND turn=0 THEN text END),'') AS system
        FROM conversations GROUP BY conv_id),
good AS (SELECT b.*, s.system FROM body b JOIN valid v USING (conv_id) JOIN sys s USING (conv_id)
         WHERE v.ordered AND v.n%2=0)"""


def token_rows(spark, folder) -> DataFrame:
    """One row per token of prompt + answer: example_id, side, model, pos, label, logp. Prompt positions are masked,
    and so is every position of a few examples."""
    long = preferences(spark, folder).select(
        "id", "prompt", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("answer"))
                                            for s in ("chosen", "rejected")])).alias("x"))
    words = F.split(F.concat("prompt", F.lit(" "), F.col("x.answer")), " ")
    long = long.select(F.col("id").alias("example_id"), F.col("x.side").alias("side"),
                       F.size(F.split("prompt", " ")).alias("_n"), (tag("mask", "id") % 37 == 0).alias("_all"),
                       F.posexplode(words).alias("pos", "word"))
    label = F.when(F.col("_all") | (F.col("pos") < F.col("_n")), -100).otherwise(hash32(F.col("word")) % 1000)
    both = long.select("example_id", "side", F.explode(F.array(F.lit("policy"), F.lit("ref"))).alias("model"), "pos",
                       label.cast("bigint").alias("label"))
    return both.withColumn("logp", -(hash32(F.concat_ws(":", "model", "side", F.col("example_id").cast("string"),
                                                        F.col("pos").cast("string"))) % 1000) / 250.0)


TOKEN_ROWS = PREFS + f""", words AS (
  SELECT id AS example_id, side, prompt, string_split(prompt||' '||answer,' ') AS w
  FROM (SELECT id, prompt, 'chosen' AS side, chosen AS answer FROM prefs
        UNION ALL SELECT id, prompt, 'rejected', rejected FROM prefs)),
spread AS (SELECT example_id, side, len(string_split(prompt,' ')) AS np, unnest(w) AS word,
                  generate_subscripts(w,1)-1 AS pos FROM words),
tok AS (
  SELECT example_id, side, model, pos,
         CASE WHEN {h("'mask:'||example_id")} % 37 = 0 OR pos < np THEN -100 ELSE {h("word")} % 1000 END AS label,
         -({h("model||':'||side||':'||example_id||':'||pos")} % 1000)/250.0::DOUBLE AS logp
  FROM spread, (VALUES ('policy'),('ref')) m(model)),
lp AS (
  SELECT example_id, side, model, sum(CASE WHEN label<>-100 THEN logp ELSE 0 END) AS logps,
         count(*) FILTER (WHERE label<>-100) AS n
  FROM tok GROUP BY ALL),
pair AS (
  SELECT example_id, max(logps) FILTER (side='chosen' AND model='policy') AS pc,
         max(logps) FILTER (side='rejected' AND model='policy') AS pr,
         max(logps) FILTER (side='chosen' AND model='ref') AS rc,
         max(logps) FILTER (side='rejected' AND model='ref') AS rr,
         max(n) FILTER (side='chosen' AND model='policy') AS nc,
         max(n) FILTER (side='rejected' AND model='policy') AS nr
  FROM lp GROUP BY example_id)"""


def logit_rows(spark, folder) -> DataFrame:
    """Vectors as logits over a small vocabulary: example_id, pos, label, policy, ref."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 10)
    return table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("example_id"), (F.col("vec_id") % 8).alias("pos"),
        F.when(tag("lab", "vec_id") % 5 == 0, -100).otherwise(F.col("label")).cast("bigint").alias("label"),
        scaled.alias("policy"), F.reverse(scaled).alias("ref"))


LOGITS = f"""logit AS (
  SELECT vec_id//8 AS example_id, vec_id%8 AS pos,
         CASE WHEN {h("'lab:'||vec_id")} % 5 = 0 THEN -100 ELSE label END AS label,
         list_transform(embedding, lambda x: x::DOUBLE*10) AS policy,
         list_reverse(list_transform(embedding, lambda x: x::DOUBLE*10)) AS ref FROM embeddings)"""


def predictions(spark, folder) -> DataFrame:
    """id, prompt, predict, label: the prediction misses a seventh of the words; a few are empty or unrelated."""
    kept = F.array_join(F.filter(F.split("output", " "), lambda w, i: hash32(
        F.concat_ws(":", F.lit("drop"), F.col("id").cast("string"), i.cast("string"))) % 7 != 0), " ")
    kind = tag("kind", "id") % 23
    return pairs(spark, folder).select(
        "id", F.col("instruction").alias("prompt"),
        F.when(kind == 0, "").when(kind == 1, F.col("output")).when(kind == 2, "0 1 2 3 4 5").otherwise(kept)
        .alias("predict"), F.col("output").alias("label"))


PREDS = PAIRS + f""", preds AS (
  SELECT id, instruction AS prompt, output AS label,
         CASE {h("'kind:'||id")} % 23 WHEN 0 THEN '' WHEN 1 THEN output WHEN 2 THEN '0 1 2 3 4 5'
              ELSE array_to_string(list_filter(string_split(output,' '),
                   lambda w, i: {h("'drop:'||id||':'||(i-1)")} % 7 <> 0),' ') END AS predict
  FROM pairs)"""


def scores(spark, folder) -> DataFrame:
    """Reward and cost per (run, document)."""
    runs = F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("run")
    long = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("prompt_response"), runs)
    def value(name):
        return hash32(F.concat_ws(":", F.lit(name), F.col("run").cast("string"), F.col("doc_id").cast("string"))) % 2001 / 100 - 10
    return long.select("run", "doc_id", "prompt_response", value("reward").alias("reward"), value("cost").alias("cost"))


SCORES = f"""scores AS (
  SELECT run::DOUBLE AS run, doc_id, md5(text) AS prompt_response,
         {h("'reward:'||run||':'||doc_id")} % 2001 / 100.0::DOUBLE - 10 AS reward,
         {h("'cost:'||run||':'||doc_id")} % 2001 / 100.0::DOUBLE - 10 AS cost
  FROM documents, (VALUES ('0.1'),('0.5'),('0.9')) r(run))"""


def trainer_log(spark, folder) -> DataFrame:
    """Sparse log rows: one run per user, steps are event ids, error rows lack a loss."""
    lost = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("current_steps"),
        F.lit(999983).cast("bigint").alias("total_steps"),
        F.when(~lost, F.col("value")).alias("loss"), F.when(lost, F.col("value")).alias("eval_loss"),
        (F.col("value") / 1000).alias("lr"), (F.col("event_id") / 1000).alias("epoch"),
        (F.col("event_id") * 2.5).alias("elapsed_s"), (F.col("event_id") * 512).alias("total_tokens"))


LOG = """log AS (
  SELECT user_id AS run, event_id AS current_steps, 999983 AS total_steps,
         CASE WHEN event_type<>'error' THEN value END AS loss, CASE WHEN event_type='error' THEN value END AS eval_loss,
         value/1000 AS lr, event_id/1000 AS epoch, event_id*2.5::DOUBLE AS elapsed_s, event_id*512 AS total_tokens
  FROM events)"""


def members(spark, folder) -> DataFrame:
    """Documents as mix members, one per language."""
    order = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
    return table(spark, folder, "documents").select(order.cast("int").alias("ds"), F.col("doc_id").alias("id"), "text")


MEMBERS = "members AS (SELECT list_position(['en','fr','de','es'], lang)-1 AS ds, doc_id AS id, text FROM documents)"
