"""Media references and plans over documents and events."""

from pyspark.sql import functions as F

from prefmill.functions.hashing import hash32
from prefmill.functions.text import digest
from prefmill.operators import align as A, media as M, tokens as T
from prefmill.plans import fixtures as X
from prefmill.plans.base import chars, commas, h, query


def _h(prefix, *cols):
    return hash32(F.concat_ws(":", F.lit(prefix), *[c.cast("string") for c in cols]))


def media_docs(spark, folder):
    """Documents with image paths (a third of all uses is one file) and as many marks, now and then one too many."""
    rows = X.table(spark, folder, "documents").select("doc_id", "text", (X.tag("ni", "doc_id") % 4).cast("int").alias("n"))
    slots = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: k < F.col("n"))
    def path(k):
        p = _h("img", F.col("doc_id"), k)
        return F.when(p % 3 == 0, "common.png").otherwise(F.concat(F.lit("img_"), (p % 997).cast("string"), F.lit(".png")))
    marks = F.col("n") + F.when(X.tag("mis", "doc_id") % 7 == 0, 1).otherwise(0)
    content = F.concat(F.repeat(F.lit("<image>"), marks), F.col("text"))
    return rows.select("doc_id", F.transform(slots, path).alias("images"), F.array(A.message("user", content)).alias("messages"))


_USE = f"""us AS (SELECT doc_id, k, CASE WHEN p%3=0 THEN 'common.png' ELSE 'img_'||(p%997)||'.png' END AS path, p FROM (
  SELECT doc_id, k, {h("'img:'||doc_id||':'||k")} AS p FROM documents, range(4) t(k) WHERE k < {h("'ni:'||doc_id")} % 4))"""


def listing(spark, folder):
    """Files that exist: the common one and three quarters of the others."""
    used = media_docs(spark, folder).select(F.explode("images").alias("p")).distinct()
    number = F.regexp_extract("p", r"img_(\d+)", 1)
    return used.filter((F.col("p") == "common.png") | (F.try_to_number(number, F.lit("999")) % 4 != 0)).select(
        F.concat(F.lit("media/"), "p").alias("path"))


@query("media_resolve", f"""WITH {_USE} SELECT d.doc_id, coalesce(string_agg(CASE WHEN p%3=0 OR p%997%4<>0 THEN 'media/' ELSE '' END||path, ',' ORDER BY k), '') AS images,
count(*) FILTER (p%3<>0 AND p%997%4=0)::BIGINT AS missing FROM documents d LEFT JOIN us ON us.doc_id=d.doc_id GROUP BY d.doc_id""")
def media_resolve(spark, folder):
    out = M.media_resolve(media_docs(spark, folder), "doc_id", "images", listing(spark, folder), "media")
    return out.withColumn("images", F.array_join("images", ","))


@query("media_count_check", f"""SELECT doc_id, {h("'mis:'||doc_id")} % 7 <> 0 AS image_ok, true AS video_ok FROM documents""")
def media_count_check(spark, folder):
    rows = media_docs(spark, folder).withColumn("videos", F.lit(None).cast("array<string>"))
    return M.media_count_check(rows, "messages", {"image": "images", "video": "videos"}).select("doc_id", "image_ok", "video_ok")


@query("media_expand", f"""WITH c AS (SELECT doc_id, text, lang, {h("'n1:'||doc_id")} % 3 AS a, {h("'n2:'||doc_id")} % 3 AS b FROM documents),
m AS (SELECT doc_id, text, lang, a, b, list_transform(range(6), lambda k: '[s]'||repeat('*', ({h("'len:'||doc_id||':'||k")} % 5 + 1)::BIGINT)||'[e]') AS x FROM c)
SELECT doc_id, md5(text||array_to_string(x[1:a],'')) AS first, lang||array_to_string(x[a+1:a+b],'')||'.' AS second,
  md5(text||repeat('####', a)) AS uniform FROM m""")
def media_expand(spark, folder):
    rows = X.table(spark, folder, "documents")
    def marks(t):
        return F.repeat(F.lit("<image>"), (X.tag(t, "doc_id") % 3).cast("int"))
    messages = F.array(A.message("user", F.concat("text", marks("n1"))), A.message("assistant", F.concat(F.col("lang"), marks("n2"), F.lit("."))))
    counts = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (_h("len", F.col("doc_id"), k) % 5 + 1).cast("int"))
    rows = rows.select("doc_id", messages.alias("m"), counts.alias("c"))
    out = rows.select("doc_id", M.media_expand(F.col("m"), F.col("c"), "*", before="[s]", after="[e]").alias("e"),
                      M.media_expand_uniform(F.col("m"), F.lit(4), "#").alias("u"))
    return out.select("doc_id", F.md5(F.col("e")[0]["content"]).alias("first"), F.col("e")[1]["content"].alias("second"), F.md5(F.col("u")[0]["content"]).alias("uniform"))


def _images(spark, folder):
    """Two messages with placeholders, and sizes of the first five images; a sixth has none."""
    rows = X.table(spark, folder, "documents")
    def marks(t):
        return F.repeat(F.lit("<image>"), (X.tag(t, "doc_id") % 4).cast("int"))
    messages = F.array(A.message("user", F.concat(F.col("lang"), marks("g1"), F.lit("!"))), A.message("assistant", F.concat(marks("g2"), F.col("source"))))
    def side(t, k):
        return (_h(t, F.col("doc_id"), k) % 190 + 10).cast("int")
    sizes = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(side("gw", k).alias("w"), side("gh", k).alias("h")))
    return rows.select("doc_id", messages.alias("m"), sizes.alias("s"), (X.tag("g1", "doc_id") % 4 + X.tag("g2", "doc_id") % 4).cast("int").alias("n"))


def _filled(shown):
    """SQL: both messages with shown (a list per document, by (w, h) lists) in the order of the placeholders."""
    return f"""c AS (SELECT doc_id, lang, source, {h("'g1:'||doc_id")} % 4 AS a, {h("'g2:'||doc_id")} % 4 AS b,
  list_transform(range(5), lambda k: {h("'gw:'||doc_id||':'||k")} % 190 + 10) AS w, list_transform(range(5), lambda k: {h("'gh:'||doc_id||':'||k")} % 190 + 10) AS h FROM documents),
m AS (SELECT *, list_transform(range(1, 6), lambda k: {shown}) AS x FROM c),
f AS (SELECT *, lang||array_to_string(x[1:a],'')||'!' AS first, array_to_string(x[a+1:a+b],'')||source AS second FROM m)"""


def _both(expanded):
    return F.md5(expanded[0]["content"]).alias("first"), F.md5(expanded[1]["content"]).alias("second")


_GRID = _filled("CASE WHEN h[k]//16=0 THEN '' ELSE repeat(repeat('[IMG]', (w[k]//16)::BIGINT)||'[IMG_BREAK]', (h[k]//16-1)::BIGINT)||repeat('[IMG]', (w[k]//16)::BIGINT)||'[IMG_END]' END")


@query("media_grid", f"WITH {_GRID} SELECT doc_id, md5(first) AS first, md5(second) AS second FROM f")
def media_grid(spark, folder):
    """Images as rows of patches, with row ends and an image end."""
    return _images(spark, folder).select("doc_id", *_both(M.expand_by_rule(F.col("m"), F.col("s"), "pixtral")))


_FITS = [f"""struct_pack(kept := least(floor(w*least({b}/w::DOUBLE, {a}/h::DOUBLE))::BIGINT * floor(h*least({b}/w::DOUBLE, {a}/h::DOUBLE))::BIGINT, w*h),
  waste := least(floor(w*least({b}/w::DOUBLE, {a}/h::DOUBLE))::BIGINT * floor(h*least({b}/w::DOUBLE, {a}/h::DOUBLE))::BIGINT, w*h) - {a * b}, i := {-i}, r := {a // 336 * 24}, c := {b // 336 * 24})"""
         for i, (a, b) in enumerate(M.TILINGS)]


@query("media_tiled", f"""WITH e AS (SELECT event_id, {h("'w:'||event_id")} % 3000 + 1 AS w, {h("'h:'||event_id")} % 3000 + 1 AS h FROM events),
b AS (SELECT *, list_max([{', '.join(_FITS)}]) AS z FROM e), g AS (SELECT event_id, w, h, z.r AS r, z.c AS c FROM b),
u AS (SELECT event_id, CASE WHEN w/h::DOUBLE > c/r::DOUBLE THEN r - 2*((r - floor(round(h*(c/w::DOUBLE),7))::BIGINT)//2) ELSE r END AS r,
  CASE WHEN w/h::DOUBLE > c/r::DOUBLE THEN c ELSE c - 2*((c - floor(round(w*(r/h::DOUBLE),7))::BIGINT)//2) END AS c FROM g)
SELECT event_id, (r*c + r + 576)::BIGINT AS tokens FROM u""")
def media_tiled(spark, folder):
    """Tokens of images shown in tiles, from their sizes."""
    rows = X.table(spark, folder, "events").select("event_id", (X.tag("w", "event_id") % 3000 + 1).alias("w"), (X.tag("h", "event_id") % 3000 + 1).alias("h"))
    return rows.select("event_id", M.tiled_tokens(F.col("w"), F.col("h")).alias("tokens"))


_BARE = _filled("''")


@query("media_prefix", f"""WITH {_BARE}, t AS (SELECT doc_id, a+b AS n, {chars("first||second")} AS ids FROM f)
SELECT doc_id, {commas("list_transform(range(n*3), lambda z: 7)||ids")} AS input_ids, {commas("list_transform(range(n*3), lambda z: -100)||ids")} AS labels FROM t""")
def media_prefix(spark, folder):
    """Placeholders leave the text; their tokens stand before it, outside of the loss."""
    rows = _images(spark, folder).select("doc_id", "n", M.expand_by_rule(F.col("m"), F.col("s"), "paligemma").alias("m"))
    ids = T.char_ids(F.concat(F.col("m")[0]["content"], F.col("m")[1]["content"]))
    new, labels = M.media_prefix(ids, ids, F.col("n"), 3, 7)
    return rows.select("doc_id", digest(new).alias("input_ids"), digest(labels).alias("labels"))


def _sizes():
    return f"""sz AS (SELECT event_id, CASE WHEN e%50=0 THEN 30 ELSE {h("'w:'||event_id")} % 3000 + 1 END AS w, CASE WHEN e%50=0 THEN 9000 ELSE {h("'h:'||event_id")} % 3000 + 1 END AS h
      FROM (SELECT event_id, {h("'x:'||event_id")} AS e FROM events)),
    s1 AS (SELECT event_id, CASE WHEN w*h>589824 THEN floor(w*sqrt(589824.0::DOUBLE/(w*h)))::BIGINT ELSE w END AS w, CASE WHEN w*h>589824 THEN floor(h*sqrt(589824.0::DOUBLE/(w*h)))::BIGINT ELSE h END AS h FROM sz),
    s2 AS (SELECT event_id, CASE WHEN w*h<1024 THEN floor(w*sqrt(1024.0::DOUBLE/(w*h)))::BIGINT ELSE w END AS w, CASE WHEN w*h<1024 THEN floor(h*sqrt(1024.0::DOUBLE/(w*h)))::BIGINT ELSE h END AS h FROM s1),
    s3 AS (SELECT event_id, CASE WHEN least(w,h)<28 THEN greatest(w,28) ELSE w END AS w, CASE WHEN least(w,h)<28 THEN greatest(h,28) ELSE h END AS h FROM s2),
    s4 AS (SELECT event_id, CASE WHEN w/h::DOUBLE>200 THEN h*180 ELSE w END AS w, h FROM s3)"""


@query("media_resize_plan", f"WITH {_sizes()} SELECT event_id, w::BIGINT AS new_w, (CASE WHEN h/w::DOUBLE>200 THEN w*180 ELSE h END)::BIGINT AS new_h FROM s4")
def media_resize_plan(spark, folder):
    odd = X.tag("x", "event_id") % 50 == 0
    rows = X.table(spark, folder, "events").select("event_id", F.when(odd, 30).otherwise(X.tag("w", "event_id") % 3000 + 1).alias("w"),
                                                   F.when(odd, 9000).otherwise(X.tag("h", "event_id") % 3000 + 1).alias("h"))
    return M.media_resize_plan(rows, 589824, 1024).select("event_id", "new_w", "new_h")


@query("video_frame_plan", f"""WITH v AS (SELECT event_id, CASE WHEN f%40=0 THEN 0 ELSE f END AS total FROM (SELECT event_id, {h("'fr:'||event_id")} % 3000 AS f FROM events)),
n AS (SELECT *, least(total,16,greatest(1,floor(total/25.0::DOUBLE*2)))::BIGINT AS n FROM v)
SELECT event_id, array_to_string(CASE WHEN total=0 THEN range(16) ELSE list_transform(range(n), lambda i: CASE WHEN i=0 THEN 0 WHEN i=n-1 THEN total-1 ELSE floor(i*((total-1)/(n-1)::DOUBLE))::BIGINT END) END,',') AS frames FROM n""")
def video_frame_plan(spark, folder):
    f = X.tag("fr", "event_id") % 3000
    rows = X.table(spark, folder, "events").select("event_id", F.when(f % 40 == 0, 0).otherwise(f).cast("int").alias("total"))
    plan = M.video_frame_plan(F.col("total"), F.col("total") / 25.0, 2.0, 16)
    return rows.select("event_id", F.array_join(plan.cast("array<string>"), ",").alias("frames"))
