"""Streaming jobs on tables replayed as files, one micro-batch per file."""

from pyspark.sql import functions as F

from prefmill.functions.numeric import r6
from prefmill.operators import align as A, encode as E
from prefmill.plans import encode_queries as EQ, fixtures as X
from prefmill.plans.base import h, h60, query
from prefmill.plans.loss_queries import r
from prefmill.schemas import TRAINER_LOG
from prefmill.session import scratch_path
from prefmill.sources.registry import DatasetSpec
from prefmill.streaming import jobs as J

PARTS = 4
PLACES = 256  # places of the shuffle buffer


def replay(df, key, name):
    """Write PARTS JSON files, each holding a range of the key, oldest first."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    top = df.agg(F.max(key).alias("m")).first()["m"] + 1
    for part in range(PARTS):
        inside = (F.col(key) >= part * top // PARTS) & (F.col(key) < (part + 1) * top // PARTS)
        df.filter(inside).coalesce(1).write.mode("append").json(path)
    return path


@query("stream_align_encode", EQ.sft_sql(EQ._C, EQ.CUT))
def stream_align_encode(spark, folder):
    path = replay(X.chats(spark, folder), "conv_id", "chats")
    stream = J.open_stream(spark, path, "conv_id long, conversations array<struct<from:string,value:string>>")
    aligned = A.align(stream, DatasetSpec("chats", formatting="sharegpt"), ["conv_id"])
    encoded = E.encode_sft(aligned, "chatml", EQ.CUT, ["conv_id"])
    return EQ.summary(J.append_to(encoded, *J.folders(spark, "encoded")), "conv_id")


_PART = "(SELECT max(doc_id)+1 AS top FROM documents)"
_SLICE = f"""sl AS (SELECT doc_id, lang, (SELECT count(*) FROM range({PARTS}) t(p) WHERE doc_id >= (p+1)*top//{PARTS}) AS part FROM documents, {_PART})"""


@query("stream_shuffle", f"""WITH {_SLICE} SELECT doc_id, row_number() OVER (PARTITION BY part ORDER BY {h("'9:'||doc_id")}, doc_id)-1 AS pos FROM sl""")
def stream_shuffle(spark, folder):
    path = replay(X.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", "docs")
    stream = J.open_stream(spark, path, "doc_id long, lang string")
    return J.stream_shuffle(stream, "doc_id", *J.folders(spark, "shuffled"), seed=9).select("doc_id", "pos")


@query("stream_shuffle_buffer", f"""WITH {_SLICE}, p AS (SELECT doc_id, lang, part, {h("'9:place:'||doc_id")} % {PLACES} AS place, {h60("'9:turn:'||doc_id")} AS turn FROM sl),
o AS (SELECT doc_id, lang, turn, lead(part) OVER w AS v, lead(turn) OVER w AS by_turn FROM p WINDOW w AS (PARTITION BY place ORDER BY part, turn))
SELECT doc_id, lang, row_number() OVER (ORDER BY v NULLS LAST, coalesce(by_turn, turn))-1 AS pos FROM o""")
def stream_shuffle_buffer(spark, folder):
    path = replay(X.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", "docs")
    stream = J.open_stream(spark, path, "doc_id long, lang string")
    return J.shuffle_buffer(stream, "doc_id", *J.folders(spark, "buffered"), buffer=PLACES, seed=9)


@query("stream_take_skip", """WITH k AS (SELECT count(*)//3 AS k FROM documents)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT k FROM k) THEN 'validation' ELSE 'train' END AS split FROM documents""")
def stream_take_skip(spark, folder):
    docs = X.table(spark, folder, "documents").select("doc_id", "lang")
    stream = J.open_stream(spark, replay(docs, "doc_id", "docs"), "doc_id long, lang string")
    return J.stream_take_skip(stream, "doc_id", docs.count() // 3, *J.folders(spark, "taken")).select("doc_id", "split")


@query("stream_log_monitor", f"""WITH RECURSIVE {X.LOG}, sr AS (SELECT run, loss, row_number() OVER (PARTITION BY run ORDER BY current_steps) AS k FROM log WHERE loss IS NOT NULL),
em AS (SELECT run, k, loss, loss AS s FROM sr WHERE k=1 UNION ALL SELECT n.run, n.k, n.loss, 0.9*em.s+0.1*n.loss FROM em JOIN sr n ON n.run=em.run AND n.k=em.k+1),
la AS (SELECT run, max(current_steps) AS current_steps, max_by(total_tokens, current_steps) AS total_tokens FROM log GROUP BY run)
SELECT la.run, current_steps, total_tokens, max_by(loss,k) AS loss, {r('max_by(s,k)')} AS smoothed FROM la JOIN em ON em.run=la.run GROUP BY ALL""")
def stream_log_monitor(spark, folder):
    path = replay(X.trainer_log(spark, folder), "current_steps", "log")
    out = J.stream_log_monitor(J.open_stream(spark, path, TRAINER_LOG), *J.folders(spark, "monitor"))
    return out.select("run", "current_steps", "total_tokens", "loss", r6(F.col("smoothed")).alias("smoothed"))


@query("stream_running_moments", f"WITH {X.SCORES} SELECT run, count(*)::BIGINT AS n, {r('avg(reward)')} AS mean, {r('var_pop(reward)')} AS var FROM scores GROUP BY run")
def stream_running_moments(spark, folder):
    path = replay(X.scores(spark, folder).select("run", "doc_id", "reward"), "doc_id", "rewards")
    stream = J.open_stream(spark, path, "run double, doc_id long, reward double")
    out = J.stream_running_moments(stream, "run", "reward", *J.folders(spark, "moments"))
    return out.select("run", "n", r6(F.col("mean")).alias("mean"), r6(F.col("m2") / F.col("n")).alias("var"))


@query("stream_batcher", """WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)-1 AS seq, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, seq//16 AS batch, seq%16 AS slot FROM s WHERE seq//16 < n//16""")
def stream_batcher(spark, folder):
    docs = X.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    stream = J.open_stream(spark, replay(docs, "doc_id", "docs"), "doc_id long, lang string, n_chars long")
    path, checkpoint = J.folders(spark, "batches")
    return J.stream_batcher(stream, "doc_id", "lang", 16, path, checkpoint, tokens="n_chars").select("doc_id", "lang", "batch", "slot")
