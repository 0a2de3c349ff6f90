"""Tokens, encoding, truncation, packing and batching."""

from pyspark.sql import functions as F

from prefmill.functions.text import digest
from prefmill.operators import align as A, encode as E, packing as P, tokens as TK
from prefmill.operators.templates import TEMPLATES, pieces
from prefmill.plans import fixtures as X
from prefmill.plans.base import chars, commas, h, query
from prefmill.plans.render_queries import lit
from prefmill.sources.registry import DatasetSpec

CUT = 600
_C = pieces(TEMPLATES["chatml"])
_F = pieces(TEMPLATES["falcon"])
_WORDS = r"'[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f]'"
VOCAB = f"""tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, {_WORDS})) AS token,
    generate_subscripts(regexp_extract_all(text, {_WORDS}),1) AS pos FROM documents),
counted AS (SELECT token, count(*) AS n FROM tokens WHERE token NOT IN ('<pad>','<s>','</s>','<unk>') GROUP BY token),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM counted
          UNION ALL VALUES ('<pad>',0,0),('<s>',0,1),('</s>',0,2),('<unk>',0,3))"""


@query("vocab_build", f"WITH {VOCAB} SELECT token, n::BIGINT AS n, id::BIGINT AS id FROM vocab")
def vocab_build(spark, folder):
    return TK.vocab_build(X.table(spark, folder, "documents"))


@query("encode_tokens", f"""WITH {VOCAB} SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(id,',' ORDER BY pos)) AS input_ids
FROM tokens JOIN vocab USING (token) GROUP BY doc_id""")
def encode_tokens(spark, folder):
    docs = X.table(spark, folder, "documents")
    out = TK.encode_tokens(docs, TK.vocab_build(docs), "doc_id")
    return out.select("doc_id", F.size("input_ids").cast("bigint").alias("n"), digest(F.col("input_ids")).alias("input_ids"))


def fit_sql(s, t, c):
    room = f"CASE WHEN {t}*2<{c} THEN {c} WHEN {s}*2<{c} THEN {c}-{s} ELSE floor({c}*({t}::DOUBLE/({s}+{t})))::BIGINT END"
    kept = f"least({room}, {t})"
    return f"least(greatest({c}-{kept},0),{s})", kept


_IS, _IT = fit_sql("s", "t", "c")


@query("infer_seqlen", f"""WITH {X.PAIRS}, l AS (SELECT id, length(instruction) AS s, length(output) AS t, c FROM pairs, (VALUES (100),(400),(2048)) v(c))
SELECT id, c::BIGINT AS cutoff, ({_IS})::BIGINT AS source, ({_IT})::BIGINT AS target FROM l""")
def infer_seqlen(spark, folder):
    rows = X.pairs(spark, folder).withColumn("c", F.explode(F.array(F.lit(100), F.lit(400), F.lit(2048))))
    kept = E.infer_seqlen(F.length("instruction"), F.length("output"), F.col("c"))
    return rows.select("id", F.col("c").cast("bigint").alias("cutoff"), kept["source"].cast("bigint").alias("source"), kept["target"].cast("bigint").alias("target"))


def summary(df, *keep):
    return df.select(*keep, F.size("input_ids").cast("bigint").alias("n"), digest(F.col("input_ids")).alias("input_ids"), digest(F.col("labels")).alias("labels"))


def sft_sql(p, cutoff, train_on_prompt=False, mask_history=False):
    eff = 1 if p["efficient_eos"] else 0
    order = "np-1-k" if mask_history else "k"
    s, t = fit_sql("len(p.src)", "len(p.tgt)", f"({cutoff}-r.total)")
    src = "src[1:s]" if train_on_prompt else "list_transform(range(s), lambda z: -100)"
    if eff:
        src = "CASE WHEN o<>0 THEN [2]||list_transform(range(greatest(s-1,0)), lambda z: -100) ELSE list_transform(range(s), lambda z: -100) END"
    tgt = "CASE WHEN o<>0 THEN list_transform(range(t), lambda z: -100) ELSE tgt[1:t] END" if mask_history else "tgt[1:t]"
    turn = "DESC" if mask_history else "ASC"
    end = "||[2]" if eff else ""
    return f"""WITH RECURSIVE {X.BODY}, pr AS (
  SELECT a.conv_id, a.i//2 AS k, a.n//2 AS np,
    {chars(f"CASE WHEN a.i=0 AND a.system<>'' THEN {lit(p['system_head'])}||a.system||{lit(p['system_tail'])} ELSE '' END||{lit(p['user_head'])}||a.text||{lit(p['user_tail'])}")} AS src,
    {chars(f"{lit(p['assistant_head'])}||b.text||{lit(p['assistant_tail'])}")} AS tgt
  FROM good a JOIN good b ON a.conv_id=b.conv_id AND b.i=a.i+1 WHERE a.i%2=0),
q AS (SELECT *, {order} AS o FROM pr),
r AS (SELECT DISTINCT conv_id, -1::BIGINT AS o, {eff}::BIGINT AS total, 0::BIGINT AS s, 0::BIGINT AS t FROM q
  UNION ALL SELECT p.conv_id, p.o, (r.total+{s}+{t})::BIGINT, ({s})::BIGINT, ({t})::BIGINT FROM r JOIN q p ON p.conv_id=r.conv_id AND p.o=r.o+1 WHERE r.total<{cutoff}),
x AS (SELECT conv_id, o, src[1:s]||tgt[1:t] AS ids, {src}||{tgt} AS labels FROM r JOIN q USING (conv_id, o)),
y AS (SELECT conv_id, flatten(list(ids ORDER BY o {turn})){end} AS ids, flatten(list(labels ORDER BY o {turn})){end} AS labels FROM x GROUP BY conv_id)
SELECT conv_id, len(ids)::BIGINT AS n, {commas('ids')} AS input_ids, {commas('labels')} AS labels FROM y"""


def _sft(name, **options):
    def run(spark, folder):
        return summary(E.encode_sft(X.hub(spark, folder), name, CUT, ["conv_id"], **options), "conv_id")
    return run


query("encode_sft", sft_sql(_C, CUT))(_sft("chatml"))
query("encode_sft_train_on_prompt", sft_sql(_C, CUT, train_on_prompt=True))(_sft("chatml", train_on_prompt=True))
query("encode_sft_mask_history", sft_sql(_C, CUT, mask_history=True))(_sft("chatml", mask_history=True))
query("encode_sft_eff_eos", sft_sql(_F, CUT))(_sft("falcon"))

RANKING = DatasetSpec("prefs", ranking=True, prompt="prompt", query=None, response=None, chosen="chosen", rejected="rejected")
_ASK = chars(f"{lit(_C['user_head'])}||prompt||{lit(_C['user_tail'])}")


def _answer(expr):
    return chars(f"{expr}||{lit(_C['assistant_tail'])}")


_PS, _PT = fit_sql("len(s)", "greatest(len(c),len(r))", "300")
PAIRWISE = f"""{X.PREFS}, e AS (SELECT id, {_ASK} AS s, {_answer('chosen')} AS c, {_answer('rejected')} AS r FROM prefs),
pw AS (SELECT id, ks, s[1:ks]||c[1:kt] AS ci, list_transform(range(ks), lambda z: -100)||c[1:kt] AS cl,
  s[1:ks]||r[1:kt] AS ri, list_transform(range(ks), lambda z: -100)||r[1:kt] AS rl FROM (SELECT *, {_PS} AS ks, {_PT} AS kt FROM e))"""


def pairwise(spark, folder):
    return E.encode_pairwise(A.align(X.preferences(spark, folder), RANKING, ["id"]), "chatml", 300, ["id"])


@query("encode_pairwise", f"""WITH {PAIRWISE} SELECT id, {commas('ci')} AS chosen_input_ids, {commas('cl')} AS chosen_labels,
{commas('ri')} AS rejected_input_ids, {commas('rl')} AS rejected_labels FROM pw""")
def encode_pairwise(spark, folder):
    out = pairwise(spark, folder)
    return out.select("id", *[digest(F.col(c)).alias(c) for c in out.columns if c != "id"])


FEEDBACK = DatasetSpec("feedback", prompt="prompt", query=None, response="chosen", kto_tag="tag")


def feedback(spark, folder):
    return A.align(X.preferences(spark, folder).withColumn("tag", X.tag("kto", "id") % 2 == 0), FEEDBACK, ["id"])


_FS, _FT = fit_sql("len(s)", "len(t)", "300")
_KS, _KT = fit_sql("len(s)", "len(kt)", "300")
SHIFT = f"""{X.PREFS}, ix AS (SELECT *, (row_number() OVER (ORDER BY id)-1) AS idx FROM prefs),
sh AS (SELECT *, coalesce(lag(chosen) OVER b, last_value(chosen) OVER (PARTITION BY idx//100 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS klc
  FROM ix WINDOW b AS (PARTITION BY idx//100 ORDER BY idx))"""


@query("encode_feedback", f"""WITH {SHIFT}, e AS (SELECT id, {_ASK} AS s, {_answer('chosen')} AS t, {_answer('klc')} AS kt FROM sh),
k AS (SELECT *, {_FS} AS a, {_FT} AS b, {_KS} AS c, {_KT} AS d FROM e)
SELECT id, {commas('s[1:a]||t[1:b]')} AS input_ids, {commas('list_transform(range(a), lambda z: -100)||t[1:b]')} AS labels,
  {commas('s[1:c]||kt[1:d]')} AS kl_input_ids, {commas('list_transform(range(c), lambda z: -100)||kt[1:d]')} AS kl_labels,
  {h("'kto:'||id")} % 2 = 0 AS kto_tags FROM k""")
def encode_feedback(spark, folder):
    out = E.encode_feedback(feedback(spark, folder), "chatml", "id", 300, batch=100)
    return out.select("id", "kto_tags", *[digest(F.col(c)).alias(c) for c in ("input_ids", "labels", "kl_input_ids", "kl_labels")])


@query("kl_shift", f"WITH {SHIFT} SELECT id, idx, klc AS kl_chosen FROM sh")
def kl_shift(spark, folder):
    return E.kl_shift(X.preferences(spark, folder), "id", ["chosen"], 100).select("id", "idx", "kl_chosen")


@query("preference_type_check", f"""WITH {X.PREFS}, t AS (SELECT {h("'kto:'||id")} % 2 = 0 AS tag FROM prefs)
SELECT count(*) FILTER (tag)::BIGINT AS desirable, count(*) FILTER (NOT tag)::BIGINT AS undesirable, count(*) FILTER (tag)=0 OR count(*) FILTER (NOT tag)=0 AS one_sided FROM t""")
def preference_type_check(spark, folder):
    return E.preference_type_check(feedback(spark, folder).select((F.length(F.col("_response")[0]["content"]) > 0).alias("kto_tags")))


_OS, _OT = fit_sql("len(s)", "len(t)", "300")


@query("encode_prompt_only", f"""WITH {X.PREFS}, e AS (SELECT id, {_ASK} AS s, {_answer('chosen')} AS t FROM prefs), k AS (SELECT *, {_OS} AS a, {_OT} AS b FROM e)
SELECT id, a::BIGINT AS n, {commas('s[1:a]')} AS input_ids, {commas('t[1:b]')} AS labels FROM k""")
def encode_prompt_only(spark, folder):
    spec = DatasetSpec("prefs", prompt="prompt", query=None, response="chosen")
    return summary(E.encode_prompt_only(A.align(X.preferences(spark, folder), spec, ["id"]), "chatml", 300, ["id"]), "id")


@query("encode_pretrain", f"""WITH e AS (SELECT doc_id, ({chars('text')}||[2])[1:1024] AS ids FROM documents)
SELECT doc_id, len(ids)::BIGINT AS n, {commas('ids')} AS input_ids FROM e""")
def encode_pretrain(spark, folder):
    out = E.encode_pretrain(X.table(spark, folder, "documents"), "text", 1024, ["doc_id"])
    return out.select("doc_id", F.size("input_ids").cast("bigint").alias("n"), digest(F.col("input_ids")).alias("input_ids"))


@query("prefix_mask", f"""WITH {X.PREFS}, e AS (SELECT id, {chars('prompt')} AS p, {chars('prompt||chosen')} AS ids FROM prefs)
SELECT id, len(p)::BIGINT AS masked, {commas('list_transform(range(len(p)), lambda z: -100)||ids[len(p)+1:]')} AS labels FROM e""")
def prefix_mask(spark, folder):
    rows = X.preferences(spark, folder).select("id", F.size(TK.char_ids(F.col("prompt"))).alias("n"), TK.char_ids(F.concat("prompt", "chosen")).alias("ids"))
    return rows.select("id", F.col("n").cast("bigint").alias("masked"), digest(E.prefix_mask(F.col("ids"), F.col("n"))).alias("labels"))


def padded_rows(spark, folder):
    """Sequences with pads (0) and masked positions (-100) at the left and pads at the right."""
    rows = X.pairs(spark, folder)
    left, right, masked = X.tag("lp", "id") % 6, X.tag("rp", "id") % 5, X.tag("mp", "id") % 3
    def rep(v, n):
        return F.array_repeat(F.lit(v), n.cast("int"))
    body = TK.char_ids(F.col("output"))
    empty = X.tag("void", "id") % 29 == 0
    return rows.select("id", F.when(empty, rep(0, left + 1)).otherwise(F.concat(rep(0, left), body, rep(0, right))).alias("ids"),
                       F.when(empty, rep(0, left + 1)).otherwise(F.concat(rep(0, left), rep(-100, masked), body, rep(0, right))).alias("pred"))


_PADS = f"""{X.PAIRS}, z AS (SELECT id, {chars('output')} AS body, {h("'lp:'||id")}%6 AS l, {h("'rp:'||id")}%5 AS r, {h("'mp:'||id")}%3 AS m, {h("'void:'||id")}%29=0 AS void FROM pairs)"""


def _rep(v, n):
    return f"list_transform(range({n}), lambda z: {v})"


@query("strip_padding", f"""WITH {_PADS} SELECT id, {commas(f"CASE WHEN void THEN [] ELSE body||{_rep(0, 'r')} END")} AS query,
{commas(f"CASE WHEN void THEN [0] ELSE {_rep(0, 'l')}||body END")} AS response,
{commas(f"CASE WHEN void THEN [0] ELSE {_rep(0, 'l')}||body||{_rep(0, 'least(r,1)')} END")} AS response_eos FROM z""")
def strip_padding(spark, folder):
    ids = F.col("ids")
    return padded_rows(spark, folder).select("id", digest(E.strip_query(ids, 0)).alias("query"), digest(E.strip_response(ids, 0, 2)).alias("response"),
                                             digest(E.strip_response(ids, 0, 0)).alias("response_eos"))


@query("rotate_left_pad", f"""WITH {_PADS} SELECT id, {commas(f"CASE WHEN void THEN {_rep(0, 'l+1')} ELSE body||{_rep(0, 'r')}||{_rep(0, 'l+m')} END")} AS ids FROM z""")
def rotate_left_pad(spark, folder):
    return padded_rows(spark, folder).select("id", digest(E.rotate_left_pad(F.col("pred"), 0)).alias("ids"))


# ---- packing --------------------------------------------------------------------------------------------------------

BLOCK = 2048
_STREAM = """ix AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id)-1 AS idx FROM documents),
st AS (SELECT idx//200 AS batch, string_agg(text||chr(1),'' ORDER BY idx) AS s, count(*) AS n FROM ix GROUP BY 1)"""


def pretrain_ids(spark, folder):
    return E.encode_pretrain(X.table(spark, folder, "documents"), "text", None, ["doc_id"], eos=9)


@query("pack_blocks", f"""WITH {_STREAM}, b AS (SELECT batch, unnest(range(length(s)//{BLOCK})) AS block, s FROM st)
SELECT batch, block, {commas(chars(f"substr(s, (block*{BLOCK}+1)::BIGINT, {BLOCK})"))} AS input_ids FROM b""")
def pack_blocks(spark, folder):
    out = P.pack_blocks(pretrain_ids(spark, folder), "doc_id", BLOCK, batch=200)
    return out.select("batch", "block", digest(F.col("input_ids")).alias("input_ids"))


@query("pack_stats", f"""WITH {_STREAM} SELECT batch, n::BIGINT AS rows, length(s)::BIGINT AS tokens, (length(s)//{BLOCK})::BIGINT AS blocks, (length(s)%{BLOCK})::BIGINT AS dropped,
round((length(s)//{BLOCK})*{BLOCK}/length(s)::DOUBLE,6) AS kept_share FROM st""")
def pack_stats(spark, folder):
    lengths = X.table(spark, folder, "documents").select("doc_id", (F.length("text") + 1).cast("bigint").alias("length"))
    return P.pack_stats(lengths, "doc_id", BLOCK, batch=200).withColumn("kept_share", F.round("kept_share", 6))


@query("drop_overlong", "SELECT doc_id, n_chars AS length, n_chars<=4096 AS kept FROM documents")
def drop_overlong(spark, folder):
    lengths = X.table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("length"))
    kept, dropped = P.drop_overlong(lengths, 4096)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


@query("sort_length", """SELECT doc_id, (row_number() OVER (ORDER BY doc_id)-1)//200 AS batch, n_chars AS length,
row_number() OVER (PARTITION BY (r-1)//200 ORDER BY n_chars, doc_id) AS place FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM documents)""")
def sort_length(spark, folder):
    from pyspark.sql import Window
    rows = P.batched(X.table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("length")), "doc_id", 200)
    return rows.select("doc_id", "batch", "length", F.row_number().over(Window.partitionBy("batch").orderBy("length", "doc_id")).cast("bigint").alias("place"))


# One step takes the longest row that fits, or closes the bin.
_FILL = """WITH RECURSIVE ix AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id)-1 AS idx FROM documents),
s AS (SELECT idx//200 AS batch, list(struct_pack(l := n_chars, i := idx, d := doc_id) ORDER BY n_chars, idx) AS rest FROM ix WHERE n_chars<=4096 GROUP BY 1),
k AS (SELECT batch, rest, 4096::BIGINT AS room, 0::BIGINT AS pack, -1::BIGINT AS slot, NULL::BIGINT AS doc_id, NULL::BIGINT AS length FROM s
  UNION ALL SELECT batch, CASE WHEN fit>0 THEN rest[1:fit-1]||rest[fit+1:] ELSE rest END, CASE WHEN fit>0 THEN room-rest[fit].l ELSE 4096 END,
    CASE WHEN fit>0 THEN pack ELSE pack+1 END, CASE WHEN fit>0 THEN slot+1 ELSE -1 END, CASE WHEN fit>0 THEN rest[fit].d END, CASE WHEN fit>0 THEN rest[fit].l END
  FROM (SELECT *, len(list_filter(rest, lambda x: x.l<=room)) AS fit FROM k WHERE len(rest)>0))
SELECT batch, pack, slot, doc_id, length FROM k WHERE doc_id IS NOT NULL"""


@query("pack_knapsack", _FILL)
def pack_knapsack(spark, folder):
    lengths = X.table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return P.pack_knapsack(lengths, "doc_id", 4096, batch=200)


@query("pack_totals", """WITH d AS (SELECT (row_number() OVER (ORDER BY doc_id)-1)//200 AS batch, n_chars FROM documents)
SELECT batch, count(*)::BIGINT AS rows, sum(n_chars)::BIGINT AS tokens, true AS fits FROM d WHERE n_chars<=4096 GROUP BY 1""")
def pack_totals(spark, folder):
    """What the bins of each batch hold together: every row that fits once, and no bin above the capacity."""
    bins = pack_knapsack(spark, folder).groupBy("batch", "pack").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t"))
    return bins.groupBy("batch").agg(F.sum("n").alias("rows"), F.sum("t").alias("tokens"), (F.max("t") <= 4096).alias("fits"))


def trios(spark, folder):
    """Preference pairs three to a pack, with the chosen side's arrays."""
    rows = pairwise(spark, folder).select("id", F.col("chosen_input_ids").alias("input_ids"), F.col("chosen_labels").alias("labels"))
    plan = P.batched(rows.select("id"), "id", 30).select("batch", F.floor(F.col("idx") / 3).alias("pack"), (F.col("idx") % 3).alias("slot"), "id")
    return rows, plan


TRIOS = f"""{PAIRWISE}, tr AS (SELECT *, row_number() OVER (ORDER BY id)-1 AS idx FROM pw),
mat AS (SELECT idx//30 AS batch, idx//3 AS pack, flatten(list(ci ORDER BY idx)) AS ids, flatten(list(cl ORDER BY idx)) AS labels,
  flatten(list(range(len(ci)) ORDER BY idx)) AS pos, flatten(list(list_transform(ci, lambda z: idx%3+1) ORDER BY idx)) AS mask FROM tr GROUP BY 1,2)"""


def _fill(expr, v):
    return commas(f"{expr}||list_transform(range(1001-len(ids)), lambda z: {v})")


@query("pack_materialise", f"""WITH {TRIOS} SELECT batch, pack, {_fill('ids', 0)} AS input_ids, {_fill('labels', -100)} AS labels, {_fill('pos', 0)} AS position_ids, {_fill('mask', 0)} AS attention_mask FROM mat""")
def pack_materialise(spark, folder):
    out = P.pack_materialise(*trios(spark, folder), "id", 1000, neat=True)
    return out.select("batch", "pack", *[digest(F.col(c)).alias(c) for c in ("input_ids", "labels", "position_ids", "attention_mask")])


@query("seqlens", f"""WITH {TRIOS}, l AS (SELECT idx//30 AS batch, idx//3 AS pack, idx%3 AS segment, len(ci) AS length FROM tr)
SELECT batch, pack, segment, length::BIGINT AS length, coalesce(sum(length) OVER (PARTITION BY batch ORDER BY pack, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS start,
max(length) OVER (PARTITION BY batch)::BIGINT AS longest FROM l""")
def seqlens(spark, folder):
    out = P.seqlens(P.pack_materialise(*trios(spark, folder), "id", 1000, neat=True), "batch", "pack", "attention_mask")
    return out.select("batch", "pack", *[F.col(c).cast("bigint").alias(c) for c in ("segment", "length", "start", "longest")])


@query("attn_pairs", f"""WITH {TRIOS} SELECT idx//30 AS batch, idx//3 AS pack, sum(len(ci)*(len(ci)+1)//2)::BIGINT AS pairs FROM tr GROUP BY 1,2""")
def attn_pairs(spark, folder):
    out = P.pack_materialise(*trios(spark, folder), "id", 1000, neat=True)
    return out.select("batch", "pack", P.attn_pairs(F.col("attention_mask")).alias("pairs"))


def in_batches(spark, folder, size=8):
    rows = pairwise(spark, folder).select("id", F.col("chosen_input_ids").alias("input_ids"), F.col("chosen_labels").alias("labels"))
    return P.batched(rows, "id", size)


_BATCHES = f"""{PAIRWISE}, bt AS (SELECT *, (row_number() OVER (ORDER BY id)-1)//8 AS batch FROM pw),
wd AS (SELECT *, max(len(ci)) OVER (PARTITION BY batch) AS top FROM bt)"""


@query("pad_batch", f"""WITH {_BATCHES}, w AS (SELECT *, ((top+7)//8)*8 AS w FROM wd)
SELECT batch, id, w::BIGINT AS width, {commas("ci||list_transform(range(w-len(ci)), lambda z: 0)")} AS input_ids,
{commas("cl||list_transform(range(w-len(ci)), lambda z: -100)")} AS labels, {commas("list_transform(ci, lambda z: 1)||list_transform(range(w-len(ci)), lambda z: 0)")} AS attention_mask FROM w""")
def pad_batch(spark, folder):
    out = P.pad_batch(in_batches(spark, folder))
    return out.select("batch", "id", F.size("input_ids").cast("bigint").alias("width"), *[digest(F.col(c)).alias(c) for c in ("input_ids", "labels", "attention_mask")])


@query("pad_truncate_v1", f"""WITH {_BATCHES}, w AS (SELECT *, least(top,250) AS w FROM wd)
SELECT batch, id, {commas("ci[1:w]||list_transform(range(greatest(w-len(ci),0)), lambda z: 0)")} AS input_ids,
{commas("cl[1:w]||list_transform(range(greatest(w-len(ci),0)), lambda z: -100)")} AS labels FROM w""")
def pad_truncate_v1(spark, folder):
    out = P.pad_truncate(in_batches(spark, folder), 250)
    return out.select("batch", "id", digest(F.col("input_ids")).alias("input_ids"), digest(F.col("labels")).alias("labels"))


@query("stack_pairs", f"""WITH {PAIRWISE}, bt AS (SELECT *, row_number() OVER (ORDER BY id)-1 AS idx FROM pw), n AS (SELECT *, count(*) OVER (PARTITION BY idx//8) AS n FROM bt)
SELECT idx//8 AS batch, idx%8 AS slot, id, 'chosen' AS side, {commas('ci')} AS input_ids FROM n UNION ALL SELECT idx//8, idx%8+n, id, 'rejected', {commas('ri')} FROM n""")
def stack_pairs(spark, folder):
    return P.stack_pairs(pairwise(spark, folder), "id", 8).select("batch", "slot", "id", "side", digest(F.col("input_ids")).alias("input_ids"))


@query("micro_batches", f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {h("'0:'||doc_id")}, doc_id)-1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, idx%4 AS replica, idx//4//8 AS step, (idx//4%8)//2 AS micro, idx//4%2 AS slot FROM p WHERE idx//4//8 < n//4//8""")
def micro_batches(spark, folder):
    return P.micro_batches(X.table(spark, folder, "documents"), "doc_id", 4, 2, 32)


@query("valid_tokens", f"""WITH {_BATCHES} SELECT batch, sum(len(list_filter(cl, lambda z: z<>-100)))::BIGINT AS valid FROM bt GROUP BY batch""")
def valid_tokens(spark, folder):
    from prefmill.operators.metrics import valid_tokens as count
    return count(in_batches(spark, folder), "batch")


@query("length_cdf", sft_sql(_C, 1000000).rsplit("SELECT conv_id, len(ids)", 1)[0] + """, b AS (SELECT len(ids)//1000*1000 AS bin, count(*) AS n FROM y GROUP BY 1)
SELECT bin::BIGINT AS bin, n::BIGINT AS n, sum(n) OVER (ORDER BY bin)::BIGINT AS total, round(sum(n) OVER (ORDER BY bin)/(SELECT sum(n) FROM b)::DOUBLE*100,6) AS percent FROM b""")
def length_cdf(spark, folder):
    from prefmill.operators.metrics import length_cdf as cdf
    encoded = E.encode_sft(X.hub(spark, folder), "chatml", 1000000, ["conv_id"])
    return cdf(encoded.select(F.size("input_ids").alias("length")), 1000).withColumn("percent", F.round("percent", 6))
