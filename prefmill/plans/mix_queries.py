"""Sampling, mixing, splitting and sharding over the documents."""

from pyspark.sql import functions as F

from prefmill.operators import mixing as MX, sampling as S
from prefmill.plans import fixtures as X
from prefmill.plans.base import h, h60, query

PROBS = {0: 0.4, 1: 0.3, 2: 0.2, 3: 0.1}


def docs(spark, folder):
    return X.table(spark, folder, "documents").select("doc_id", "lang", "source", F.md5("text").alias("text"))


def placed(df):
    return df.select("pos", "ds", "id", F.md5("text").alias("text"))


def _perm(seed, ident="doc_id", part=""):
    return f"row_number() OVER ({part} ORDER BY {h(f'{chr(39)}{seed}:{chr(39)}||{ident}')}, {ident}) - 1"


@query("sample_num", f"""WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT doc_id, text, {_perm(7)} AS idx FROM documents),
d AS (SELECT draw, {h60("'7:draw:'||draw")} % (SELECT n FROM n) AS idx FROM (SELECT unnest(range((SELECT n FROM n), (SELECT n FROM n)*3//2)) AS draw))
SELECT idx AS draw, doc_id, md5(text) AS text FROM p UNION ALL SELECT d.draw, p.doc_id, md5(p.text) FROM d JOIN p USING (idx)""")
def sample_num(spark, folder):
    rows = docs(spark, folder)
    size = rows.count()
    return S.sample_num(rows, "doc_id", size * 3 // 2, seed=7, size=size).select("draw", "doc_id", "text")


@query("sample_max", """SELECT doc_id, md5(text) AS text FROM documents
WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT count(*)//3 FROM documents))""")
def sample_max(spark, folder):
    rows = docs(spark, folder)
    return S.sample_max(rows, "doc_id", rows.count() // 3).select("doc_id", "text")


@query("sample_v1", f"""WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS idx FROM documents),
a AS (SELECT draw, doc_id FROM (SELECT draw, {h60("'3:size:draw:'||draw")} % (SELECT n FROM n) AS idx FROM (SELECT unnest(range((SELECT n//2 FROM n))) AS draw)) JOIN p USING (idx)),
b AS (SELECT draw, {h60("'3:weight:draw:'||draw")} % (SELECT n//2 FROM n) AS pick FROM (SELECT unnest(range((SELECT floor((n//2)*1.5)::BIGINT FROM n))) AS draw))
SELECT b.draw AS idx, a.doc_id FROM b JOIN a ON a.draw=b.pick""")
def sample_v1(spark, folder):
    rows = docs(spark, folder)
    return S.sample_weighted(rows, "doc_id", rows.count() // 2, 1.5, seed=3).select("idx", "doc_id")


@query("select_rows", f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS idx, count(*) OVER () AS n FROM documents),
w AS (SELECT doc_id AS out, CASE WHEN doc_id%4=0 THEN -1-k ELSE k END AS want FROM (SELECT doc_id, {h("'pick:'||doc_id")} % (SELECT count(*) FROM documents) AS k FROM documents))
SELECT 'list' AS kind, w.out, p.doc_id FROM w JOIN p ON p.idx = CASE WHEN w.want<0 THEN w.want+p.n ELSE w.want END
UNION ALL SELECT 'slice', (idx-5)//3, doc_id FROM p WHERE idx>=5 AND idx<n-2 AND (idx-5)%3=0""")
def select_rows(spark, folder):
    rows = docs(spark, folder)
    size = rows.count()
    k = X.tag("pick", "doc_id") % size
    wanted = rows.select(F.col("doc_id").alias("out"), F.when(F.col("doc_id") % 4 == 0, -1 - k).otherwise(k).alias("idx"))
    listed = S.select_rows(rows, "doc_id", wanted).select(F.lit("list").alias("kind"), "out", "doc_id")
    sliced = S.select_slice(rows, "doc_id", 5, -2, 3).select(F.lit("slice").alias("kind"), "out", "doc_id")
    return listed.unionByName(sliced)


_RN = f"""WITH {X.MEMBERS}, r AS (SELECT ds, id, md5(text) AS text, row_number() OVER (PARTITION BY ds ORDER BY id)-1 AS rn,
  count(*) OVER (PARTITION BY ds) AS n FROM members), s AS (SELECT min(n) AS lo, max(n) AS hi FROM r)"""


@query("mix_concat", f"""{_RN} SELECT row_number() OVER (ORDER BY ds, id)-1 AS pos, ds, id, text FROM r""")
def mix_concat(spark, folder):
    return placed(MX.mix(X.members(spark, folder), "concat"))


@query("mix_interleave_under", f"""{_RN} SELECT row_number() OVER (ORDER BY rn, ds)-1 AS pos, ds, id, text FROM r, s WHERE rn<lo""")
def mix_interleave_under(spark, folder):
    return placed(MX.mix(X.members(spark, folder), "interleave_under"))


@query("mix_interleave_over", f"""{_RN}, g AS (SELECT i, ds FROM (SELECT unnest(range((SELECT hi FROM s))) AS i), (SELECT DISTINCT ds FROM r))
SELECT row_number() OVER (ORDER BY g.i, g.ds)-1 AS pos, g.ds, r.id, r.text FROM g JOIN r ON r.ds=g.ds AND r.rn=g.i%r.n""")
def mix_interleave_over(spark, folder):
    return placed(MX.mix(X.members(spark, folder), "interleave_over"))


@query("mix_interleave_once", f"""{_RN} SELECT row_number() OVER (ORDER BY rn, ds)-1 AS pos, ds, id, text FROM r""")
def mix_interleave_once(spark, folder):
    return placed(MX.mix(X.members(spark, folder), "interleave_once"))


def _prob_sql(stop):
    draws = f"""{_RN}, a AS (SELECT i, CASE WHEN u<0.4 THEN 0 WHEN u<0.7 THEN 1 WHEN u<0.9 THEN 2 ELSE 3 END AS ds FROM (
      SELECT i, {h("'5:pos:'||i")}/4294967296.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT hi*30 FROM s))) AS i))),
    d AS (SELECT i, a.ds, row_number() OVER (PARTITION BY a.ds ORDER BY i)-1 AS turn FROM a),
    e AS (SELECT d.ds, min(i) AS fin FROM d JOIN (SELECT DISTINCT ds, n FROM r) z ON z.ds=d.ds AND d.turn=z.n-1 GROUP BY d.ds)"""
    if stop == "once":
        return f"""{draws} SELECT row_number() OVER (ORDER BY d.i)-1 AS pos, r.ds, r.id, r.text FROM d JOIN r ON r.ds=d.ds AND r.rn=d.turn"""
    edge = "min" if stop == "under" else "max"
    return f"""{draws} SELECT d.i AS pos, r.ds, r.id, r.text FROM d JOIN r ON r.ds=d.ds AND r.rn=d.turn%r.n WHERE d.i <= (SELECT {edge}(fin) FROM e)"""


def _prob(stop):
    def run(spark, folder):
        return placed(MX.mix(X.members(spark, folder), f"interleave_{stop}", PROBS, seed=5))
    return run


for _stop in ("under", "over", "once"):
    query(f"mix_interleave_prob_{_stop}", _prob_sql(_stop))(_prob(_stop))


@query("split_ratio", f"""SELECT doc_id, CASE WHEN {_perm(11)} < ceil((SELECT count(*) FROM documents)*0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM documents""")
def split_ratio(spark, folder):
    return MX.split(docs(spark, folder), "doc_id", 0.1, seed=11).select("doc_id", "split")


@query("split_count", f"""SELECT doc_id, CASE WHEN {_perm(12)} < 64 THEN 'validation' ELSE 'train' END AS split FROM documents""")
def split_count(spark, folder):
    return MX.split(docs(spark, folder), "doc_id", 64, seed=12).select("doc_id", "split")


@query("split_named", """SELECT name, split, count(*)::BIGINT AS n, min(doc_id) AS first FROM (
  SELECT doc_id, 'train' AS split, 'train' AS name FROM documents WHERE lang='en'
  UNION ALL SELECT doc_id, 'validation_'||lang, lang FROM documents WHERE lang <> 'en') GROUP BY ALL""")
def split_named(spark, folder):
    rows = docs(spark, folder)
    sets = MX.split_named(rows.filter("lang = 'en'"), {x: rows.filter(F.col("lang") == x) for x in ("de", "es", "fr")})
    named = sets.filter("split = 'train'").withColumn("name", F.lit("train")).unionByName(MX.evaluation_sets(sets))
    return named.groupBy("name", "split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("shard_replica", f"""WITH p AS (SELECT doc_id, {_perm(0)} AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, idx, idx%7 AS replica FROM p WHERE idx < n//7*7""")
def shard_replica(spark, folder):
    return S.shard_replica(docs(spark, folder), "doc_id", 7).select("doc_id", "idx", "replica")


@query("preview_page", """WITH p AS (SELECT *, row_number() OVER (ORDER BY doc_id)-1 AS idx, count(*) OVER () AS total FROM documents)
SELECT idx, total, doc_id, md5(text) AS text FROM p WHERE idx>=6 AND idx<8""")
def preview_page(spark, folder):
    return S.preview_page(docs(spark, folder), "doc_id", 3).select("idx", "total", "doc_id", "text")


@query("first_n", "SELECT event_id, value FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY event_id LIMIT 500)")
def first_n(spark, folder):
    return S.first_n(X.table(spark, folder, "events").select("event_id", "value"), "event_id", 500)


@query("skip_n", "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r>500")
def skip_n(spark, folder):
    return S.skip_n(X.table(spark, folder, "events").select("event_id", "value"), "event_id", 500).select("event_id", "value")
