"""Log-probabilities, rewards, losses, reports and rank studies."""

from pyspark.sql import Window, functions as F

from prefmill.functions.hashing import hash32
from prefmill.functions.numeric import r6
from prefmill.operators import logps as L, losses as S, metrics as MT, rewards as W
from prefmill.operators.rowindex import ordered_index
from prefmill.plans import encode_queries as EQ, fixtures as X
from prefmill.plans.base import h, query
from prefmill.session import settled

BETA = 0.1
_LS = "(least({x},0.0) - ln(1+exp(-abs({x}))))"


def ls(x):
    """SQL text of log sigmoid."""
    return _LS.format(x=f"({x})")


def sg(x):
    return f"(1.0/(1.0+exp(-({x}))))"


def r(x):
    return f"round({x},6)+0.0"


def sequences(spark, folder):
    return L.seq_logps(X.token_rows(spark, folder))


def pairs(spark, folder, value="logps"):
    rows = sequences(spark, folder)
    return L.pair_logps(L.logps_avg(rows) if value == "logps_avg" else rows, value)


AVG = X.TOKEN_ROWS + """, av AS (
  SELECT example_id, max(logps/n) FILTER (side='chosen' AND model='policy' AND n>0) AS pc, max(logps/n) FILTER (side='rejected' AND model='policy' AND n>0) AS pr,
    max(logps/n) FILTER (side='chosen' AND model='ref' AND n>0) AS rc, max(logps/n) FILTER (side='rejected' AND model='ref' AND n>0) AS rr
  FROM lp GROUP BY example_id)"""


@query("seq_logps", f"WITH {X.TOKEN_ROWS} SELECT example_id, side, model, {r('logps')} AS logps, n::BIGINT AS n FROM lp")
def seq_logps(spark, folder):
    return sequences(spark, folder).withColumn("logps", r6(F.col("logps")))


@query("seq_logps_ld", f"""WITH {X.TOKEN_ROWS}, f AS (SELECT *, min(CASE WHEN label<>-100 THEN pos END) OVER (PARTITION BY example_id, side, model) AS first,
  sum(CASE WHEN label<>-100 AND side='chosen' THEN 1 ELSE 0 END) OVER (PARTITION BY example_id, model) AS a,
  sum(CASE WHEN label<>-100 AND side='rejected' THEN 1 ELSE 0 END) OVER (PARTITION BY example_id, model) AS b FROM tok)
SELECT example_id, side, model, {r("coalesce(sum(logp*CASE WHEN pos<first+least(a,b) THEN 1.0 ELSE 0.3 END) FILTER (label<>-100),0.0)")} AS logps,
  count(*) FILTER (label<>-100)::BIGINT AS n FROM f GROUP BY ALL""")
def seq_logps_ld(spark, folder):
    return L.seq_logps_ld(X.token_rows(spark, folder), 0.3).withColumn("logps", r6(F.col("logps")))


@query("logps_avg", f"WITH {X.TOKEN_ROWS} SELECT example_id, side, model, {r('CASE WHEN n>0 THEN logps/n END')} AS logps_avg FROM lp")
def logps_avg(spark, folder):
    return L.logps_avg(sequences(spark, folder)).select("example_id", "side", "model", r6(F.col("logps_avg")).alias("logps_avg"))


@query("join_policy_ref", f"""WITH {X.TOKEN_ROWS} SELECT p.example_id, p.side, {r('p.logps')} AS logps, {r('q.logps')} AS ref_logps
FROM lp p JOIN lp q ON p.example_id=q.example_id AND p.side=q.side AND p.model='policy' AND q.model='ref'""")
def join_policy_ref(spark, folder):
    rows = sequences(spark, folder)
    out = L.join_policy_ref(rows.filter("model = 'policy'"), rows.filter("model = 'ref'"))
    return out.select("example_id", "side", r6(F.col("logps")).alias("logps"), r6(F.col("ref_logps")).alias("ref_logps"))


@query("ppl", f"""WITH {X.TOKEN_ROWS}, p AS (SELECT CASE WHEN n>0 THEN exp(-logps/n) END AS ppl FROM lp WHERE model='policy')
SELECT {r('avg(ppl)')} AS mean_ppl, count(ppl)::BIGINT AS rows, count(*) FILTER (ppl IS NULL)::BIGINT AS without_labels FROM p""")
def ppl(spark, folder):
    out = L.ppl_mean(L.ppl(sequences(spark, folder).filter("model = 'policy'")))
    return out.withColumn("mean_ppl", r6(F.col("mean_ppl")))


@query("ppl_by_dataset", f"""WITH {X.TOKEN_ROWS} SELECT example_id%3 AS dataset, {r('-sum(logps)/sum(n)')} AS loss, {r('exp(-sum(logps)/sum(n))')} AS ppl FROM lp WHERE model='policy' GROUP BY 1""")
def ppl_by_dataset(spark, folder):
    rows = sequences(spark, folder).filter("model = 'policy'").withColumn("dataset", F.col("example_id") % 3)
    return L.ppl_by_dataset(rows, "dataset").select("dataset", r6(F.col("loss")).alias("loss"), r6(F.col("ppl")).alias("ppl"))


@query("pref_rewards", f"WITH {X.TOKEN_ROWS} SELECT example_id, {r('0.1*(pc-rc)')} AS chosen, {r('0.1*(pr-rr)')} AS rejected, {r('0.1*pc')} AS free_chosen, {r('0.1*pr')} AS free_rejected FROM pair")
def pref_rewards(spark, folder):
    c, d = W.pref_rewards(BETA)
    e, f = W.pref_rewards(BETA, reference=False)
    return pairs(spark, folder).select("example_id", *[r6(x).alias(n) for x, n in ((c, "chosen"), (d, "rejected"), (e, "free_chosen"), (f, "free_rejected"))])


@query("pref_accuracy", f"WITH {X.TOKEN_ROWS} SELECT {r('avg(CASE WHEN 0.1*(pc-rc) > 0.1*(pr-rr) THEN 1 ELSE 0 END)')} AS accuracy FROM pair")
def pref_accuracy(spark, folder):
    return pairs(spark, folder).agg(r6(W.pref_accuracy(*W.pref_rewards(BETA))).alias("accuracy"))


@query("dpo_report", f"""WITH {X.TOKEN_ROWS}, q AS (SELECT *, CASE WHEN {h("'ev:'||example_id")} % 4 = 0 THEN 'eval' ELSE 'train' END AS split FROM pair)
SELECT split, {r('avg(0.1*(pc-rc))')} AS rewards_chosen, {r('avg(0.1*(pr-rr))')} AS rewards_rejected, {r('avg(CASE WHEN 0.1*(pc-rc)>0.1*(pr-rr) THEN 1 ELSE 0 END)')} AS accuracies,
  {r('avg(0.1*(pc-rc)-0.1*(pr-rr))')} AS margins, {r('avg(pc)')} AS logps_chosen, {r('avg(pr)')} AS logps_rejected,
  {r('avg(pc/(nc+1))')} AS logits_chosen, {r('avg(pr/(nr+1))')} AS logits_rejected FROM q GROUP BY split""")
def dpo_report(spark, folder):
    rows = pairs(spark, folder).withColumn("split", F.when(X.tag("ev", "example_id") % 4 == 0, "eval").otherwise("train"))
    rows = rows.withColumn("chosen_logits", F.col("pc") / (F.col("nc") + 1)).withColumn("rejected_logits", F.col("pr") / (F.col("nr") + 1))
    out = W.dpo_report(rows, ["split"], BETA)
    return out.select("split", *[r6(F.col(c)).alias(c) for c in out.columns if c != "split"])


def _loss(name, value, expr, sql):
    source, table = (X.TOKEN_ROWS, "pair") if value == "logps" else (AVG, "av")

    @query(name, f"WITH {source} SELECT example_id, {r(sql)} AS loss FROM {table}")
    def run(spark, folder):
        return pairs(spark, folder, value).select("example_id", r6(expr()).alias("loss"))


_M = "((pc-pr)-(rc-rr))"
_loss("loss_sigmoid", "logps", lambda: S.loss_sigmoid(BETA, 0.1), f"-{ls('0.1*' + _M)}*0.9-{ls('-0.1*' + _M)}*0.1")
_loss("loss_hinge", "logps", lambda: S.loss_hinge(BETA), f"greatest(1-0.1*{_M},0.0)")
_loss("loss_ipo", "logps_avg", lambda: S.loss_ipo(BETA), f"pow({_M}-5.0,2)")
_loss("loss_orpo", "logps_avg", lambda: S.loss_orpo(BETA), f"-pc-0.1*{ls('(pc-pr)-(ln(1-exp(pc))-ln(1-exp(pr)))')}")
_loss("loss_simpo", "logps_avg", lambda: S.loss_simpo(BETA, 0.5), f"-{ls('0.1*(pc-pr-0.5/0.1)')}")


@query("loss_ftx", f"""WITH {X.TOKEN_ROWS} SELECT example_id, {r(f"-{ls('0.1*' + _M)} - 0.2*CASE WHEN nc>0 THEN pc/nc END")} AS loss FROM pair""")
def loss_ftx(spark, folder):
    avg = F.when(F.col("nc") > 0, F.col("pc") / F.col("nc"))
    return pairs(spark, folder).select("example_id", r6(S.loss_ftx(S.loss_sigmoid(BETA), avg, 0.2)).alias("loss"))


@query("loss_kto_pair", f"""WITH {X.TOKEN_ROWS}, q AS (SELECT *, example_id//4000 AS batch FROM pair),
k AS (SELECT *, greatest(avg(pc-rc) OVER (PARTITION BY batch),0.0) AS kc, greatest(avg(pr-rr) OVER (PARTITION BY batch),0.0) AS kr FROM q)
SELECT batch, {r(f"avg((1-{sg('0.1*((pc-rc)-kr)')})+(1-{sg('0.1*(kc-(pr-rr))')}))/2")} AS loss FROM k GROUP BY batch""")
def loss_kto_pair(spark, folder):
    rows = pairs(spark, folder).withColumn("batch", F.floor(F.col("example_id") / 4000))
    return S.loss_kto_pair(rows, "batch", BETA).withColumn("loss", r6(F.col("loss")))


def feedback_rows(spark, folder):
    """Feedback rows from the pairs: the tag picks the side, the other side serves as the mismatched answer."""
    rows = pairs(spark, folder).withColumn("batch", F.floor(F.col("example_id") / 4000)).withColumn("tag", X.tag("kto", "example_id") % 2 == 0)
    def side(a, b):
        return F.when(F.col("tag"), F.col(a)).otherwise(F.col(b))
    return rows.select("example_id", "batch", "tag", side("pc", "pr").alias("logps"), side("rc", "rr").alias("ref_logps"),
                       side("pr", "pc").alias("kl_logps"), side("rr", "rc").alias("ref_kl_logps"))


_FB = f"""fb AS (SELECT example_id, example_id//4000 AS batch, tag, CASE WHEN tag THEN pc ELSE pr END AS lp, CASE WHEN tag THEN rc ELSE rr END AS rl,
  CASE WHEN tag THEN pr ELSE pc END AS kp, CASE WHEN tag THEN rr ELSE rc END AS kq FROM (SELECT *, {h("'kto:'||example_id")} % 2 = 0 AS tag FROM pair)),
kk AS (SELECT *, greatest(avg(kp-kq) OVER (PARTITION BY batch),0.0) AS kl FROM fb),
lk AS (SELECT *, 0.1*(lp-rl) AS reward, CASE WHEN tag THEN 1.0*(1-{sg('0.1*((lp-rl)-kl)')}) ELSE 0.8*(1-{sg('0.1*(kl-(lp-rl))')}) END AS loss FROM kk)"""


@query("loss_kto", f"WITH {X.TOKEN_ROWS}, {_FB} SELECT example_id, tag, {r('reward')} AS reward, {r('kl')} AS kl, {r('loss')} AS loss FROM lk")
def loss_kto(spark, folder):
    out = S.loss_kto(feedback_rows(spark, folder), "batch", BETA, 1.0, 0.8)
    return out.select("example_id", "tag", *[r6(F.col(c)).alias(c) for c in ("reward", "kl", "loss")])


@query("kto_report", f"""WITH {X.TOKEN_ROWS}, {_FB} SELECT batch, {r('avg(reward) FILTER (tag)')} AS reward_chosen, {r('avg(lp) FILTER (tag)')} AS logps_chosen, {r('avg(rl) FILTER (tag)')} AS logits_chosen,
  {r('avg(reward) FILTER (NOT tag)')} AS reward_rejected, {r('avg(lp) FILTER (NOT tag)')} AS logps_rejected, {r('avg(rl) FILTER (NOT tag)')} AS logits_rejected,
  {r('avg(kl)')} AS kl, {r('avg(reward) FILTER (tag)-avg(reward) FILTER (NOT tag)')} AS margin FROM lk GROUP BY batch""")
def kto_report(spark, folder):
    rows = S.loss_kto(feedback_rows(spark, folder), "batch", BETA, 1.0, 0.8).withColumn("logits", F.col("ref_logps"))
    out = W.kto_report(rows, ["batch"])
    return out.select("batch", *[r6(F.col(c)).alias(c) for c in out.columns if c != "batch"])


_DELTA = """ix AS (SELECT *, (row_number() OVER (ORDER BY example_id)-1)//16 AS batch FROM pair),
bm AS (SELECT batch, avg(0.1*(pc-rc)+0.1*(pr-rr))/2 AS m FROM ix GROUP BY 1), dl AS (SELECT batch, avg(m) OVER (ORDER BY batch) AS delta FROM bm)"""


@query("loss_bco", f"""WITH {X.TOKEN_ROWS}, {_DELTA} SELECT example_id, batch, {r('delta')} AS delta,
  {r(f"((-{ls('0.1*' + _M)}) + 0.5*(-{ls('0.1*(pc-rc)-delta')}-{ls('-(0.1*(pr-rr)-delta)')}))/1.5")} AS loss FROM ix JOIN dl USING (batch)""")
def loss_bco(spark, folder):
    rows = pairs(spark, folder)
    indexed = ordered_index(rows, ["example_id"])
    out = S.loss_bco(indexed, "idx", 16, BETA, 0.5, S.loss_sigmoid(BETA))
    return out.select("example_id", "batch", r6(F.col("delta")).alias("delta"), r6(F.col("loss")).alias("loss"))


def token_scores(spark, folder):
    """Per-token scores; the last positions of each sequence are padding."""
    rows = X.token_rows(spark, folder).filter("model = 'policy'")
    pad = (X.tag("pad", "example_id", "side") % 4).cast("int")
    top = F.max("pos").over(Window.partitionBy("example_id", "side"))
    return rows.select("example_id", "side", "pos", (F.col("logp") * 3).alias("score"), F.when(F.col("pos") > top - pad, 0).otherwise(1).alias("mask"))


_LAST = f"""sc AS (SELECT example_id, side, pos, logp*3 AS score, max(pos) OVER (PARTITION BY example_id, side) - {h("'pad:'||example_id||':'||side")} % 4 AS edge FROM tok WHERE model='policy'),
ends AS (SELECT example_id, side, score FROM sc WHERE pos=edge)"""


@query("loss_rm", f"""WITH {X.TOKEN_ROWS}, {_LAST}, e AS (SELECT example_id, max(score) FILTER (side='chosen') AS c, max(score) FILTER (side='rejected') AS d FROM ends GROUP BY 1)
SELECT example_id, {r('c')} AS chosen, {r('d')} AS rejected, {r('-' + ls('c-d'))} AS loss FROM e""")
def loss_rm(spark, folder):
    return S.loss_rm(token_scores(spark, folder)).select("example_id", *[r6(F.col(c)).alias(c) for c in ("chosen", "rejected", "loss")])


@query("last_token_score", f"WITH {X.TOKEN_ROWS}, {_LAST} SELECT example_id, side, {r('score')} AS score FROM ends")
def last_token_score(spark, folder):
    from prefmill.operators.series import last_token_score as last
    return last(token_scores(spark, folder), ["example_id", "side"]).withColumn("score", r6(F.col("score")))


# ---- losses over logits ---------------------------------------------------------------------------------------------

_T = f"""{X.LOGITS}, tg AS (SELECT * FROM (SELECT *, lead(label) OVER (PARTITION BY example_id ORDER BY pos) AS target FROM logit) WHERE target<>-100),
nl AS (SELECT *, ln(list_sum(list_transform(policy, lambda x: exp(x)))) - policy[target+1] AS nll,
  list_reverse_sort(policy)[1:20] AS top, ln(list_sum(list_transform(policy, lambda x: exp(x)))) AS zp, ln(list_sum(list_transform(ref, lambda x: exp(x)))) AS zr FROM tg)"""


@query("loss_dft", f"WITH {_T} SELECT {r('avg(nll*exp(-nll))')} AS loss FROM nl")
def loss_dft(spark, folder):
    return S.loss_dft(X.logit_rows(spark, folder)).select(r6(F.col("loss")).alias("loss"))


@query("loss_asft", f"""WITH {_T}, k AS (SELECT nll, list_sum(list_transform(range(1,65), lambda i: exp(ref[i]-zr)*((ref[i]-zr)-(policy[i]-zp)))) AS kl FROM nl)
SELECT {r('avg(nll*exp(-nll))')} AS dft, {r('avg(kl)')} AS kl, {r('avg(nll*exp(-nll))+0.1*avg(kl)')} AS loss FROM k""")
def loss_asft(spark, folder):
    return S.loss_asft(X.logit_rows(spark, folder), 0.1).select(*[r6(F.col(c)).alias(c) for c in ("dft", "kl", "loss")])


@query("loss_eaft", f"""WITH {_T}, z AS (SELECT nll, top, ln(list_sum(list_transform(top, lambda x: exp(x)))) AS zt FROM nl),
e AS (SELECT nll, -list_sum(list_transform(top, lambda x: exp(x-zt)*(x-zt))) AS ent FROM z) SELECT {r('avg(nll*pow(ent/3.0,1.0))')} AS loss FROM e""")
def loss_eaft(spark, folder):
    return S.loss_eaft(X.logit_rows(spark, folder)).select(r6(F.col("loss")).alias("loss"))


@query("token_accuracy", f"""WITH {_T}, a AS (SELECT example_id, avg(CASE WHEN list_position(policy, list_max(policy))-1=target THEN 1 ELSE 0 END) AS a FROM tg GROUP BY 1)
SELECT {r('avg(a)')} AS accuracy, count(*)::BIGINT AS rows FROM a""")
def token_accuracy(spark, folder):
    return S.token_accuracy(X.logit_rows(spark, folder)).withColumn("accuracy", r6(F.col("accuracy")))


@query("topk_logits", f"""WITH {X.LOGITS} SELECT example_id, pos, md5(array_to_string(list_transform(list_reverse_sort(policy)[1:20], lambda x: floor(x*1000000)::BIGINT),',')) AS top FROM logit""")
def topk_logits(spark, folder):
    rows = X.logit_rows(spark, folder).withColumn("top", S.topk_logits(F.col("policy")))
    shown = F.transform("top", lambda x: F.floor(x * 1000000).cast("string"))
    return rows.select("example_id", "pos", F.md5(F.array_join(shown, ",")).alias("top"))


# ---- rank study -----------------------------------------------------------------------------------------------------

def adapters(spark, folder):
    """Twelve adapter folders per pair example; the noise on the policy sums shrinks with the folder number."""
    k = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")
    once = settled(pairs(spark, folder).select("example_id", "pc", "pr", "rc", "rr"))
    rows = once.select("*", k)
    def noisy(name):
        return F.col(name) + (hash32(F.concat_ws(":", F.lit(name), F.col("k").cast("string"), F.col("example_id").cast("string"))) % 200 - 100) / (F.col("k") + 1.0)
    policy = rows.select(F.concat(F.lit("noise_k"), F.col("k").cast("string")).alias("folder"), "example_id", noisy("pc").alias("pc"), noisy("pr").alias("pr"))
    reference = once.select("example_id", "rc", "rr")
    number = F.col("id").cast("int")
    table = spark.range(12).select(F.concat(F.lit("noise_k"), number.cast("string")).alias("folder"), F.when(number == 7, 12).otherwise(number * 2).alias("rank"))
    return table, policy, reference


def _noise(name):
    return f"{name}+({h(chr(39) + name + ':' + chr(39) + '||k||' + chr(39) + ':' + chr(39) + '||example_id')} % 200 - 100)/(k+1.0::DOUBLE)"


@query("accuracy_by_rank", f"""WITH {X.TOKEN_ROWS}, k AS (SELECT unnest(range(12)) AS k), po AS (SELECT k, example_id, rc, rr, {_noise('pc')} AS pc, {_noise('pr')} AS pr FROM pair, k),
a AS (SELECT k, CASE WHEN k=7 THEN 12 ELSE k*2 END AS rank, avg(CASE WHEN 0.1*(pc-rc)>0.1*(pr-rr) THEN 1 ELSE 0 END) AS acc FROM po WHERE k BETWEEN 1 AND 10 GROUP BY k)
SELECT rank::BIGINT AS rank, 'noise_k'||max(k) AS folder, {r('max_by(acc,k)')} AS accuracy FROM a GROUP BY rank""")
def accuracy_by_rank(spark, folder):
    out = W.accuracy_by_rank(*adapters(spark, folder), BETA)
    return out.select(F.col("rank").cast("bigint").alias("rank"), "folder", r6(F.col("accuracy")).alias("accuracy"))


@query("sort_numeric_suffix", """WITH f AS (SELECT DISTINCT 'noise_k'||(event_id%40) AS folder FROM events)
SELECT folder, place FROM (SELECT folder, row_number() OVER (ORDER BY substr(folder,8)::INT)-1 AS place FROM f) WHERE place BETWEEN 1 AND 10""")
def sort_numeric_suffix(spark, folder):
    rows = X.table(spark, folder, "events").select(F.concat(F.lit("noise_k"), (F.col("event_id") % 40).cast("string")).alias("folder"))
    return W.studied_folders(rows).withColumn("place", F.col("place").cast("bigint"))


# ---- corpus measures over encoded rows ------------------------------------------------------------------------------

_RATIO = f"""{EQ._BATCHES}, per AS (SELECT batch, sum(len(list_filter(cl, lambda z: z<>-100))) AS v, max(len(cl))*count(*) AS c FROM bt GROUP BY 1)"""


@query("valid_ratio", f"WITH {_RATIO} SELECT sum(v)::BIGINT AS valid, sum(c)::BIGINT AS cells, {r('sum(v)/sum(c)::DOUBLE')} AS ratio FROM per")
def valid_ratio(spark, folder):
    return MT.valid_ratio(EQ.in_batches(spark, folder), "batch").withColumn("ratio", r6(F.col("ratio")))


@query("suggest_lr", f"""WITH {_RATIO}, x AS (SELECT sum(v)/sum(c)::DOUBLE AS ratio FROM per)
SELECT {r('ratio*2048*16')} AS token_batch, round(3e-4*sqrt(ratio*2048*16/4000000.0)*1e9,3) AS lr_e9, round(3e-4*sqrt(ratio*2048*16/4000000.0)/6*1e9,3) AS small_lr_e9 FROM x""")
def suggest_lr(spark, folder):
    ratio = MT.valid_ratio(EQ.in_batches(spark, folder), "batch")
    both = MT.suggest_lr(ratio, 2048, 16).withColumnRenamed("lr", "full")
    small = MT.suggest_lr(both, 2048, 16, small=True)
    return small.select(r6(F.col("token_batch")).alias("token_batch"), F.round(F.col("full") * 1e9, 3).alias("lr_e9"), F.round(F.col("lr") * 1e9, 3).alias("small_lr_e9"))


@query("tokens_per_sec", f"WITH {EQ.PAIRWISE} SELECT sum(len(ci)+len(ri))::BIGINT AS tokens, {r('sum(len(ci)+len(ri))*3.0/120/4')} AS tokens_per_sec FROM pw")
def tokens_per_sec(spark, folder):
    out = MT.tokens_per_sec(EQ.pairwise(spark, folder), ["chosen_input_ids", "rejected_input_ids"], 3.0, 120, 4)
    return out.withColumn("tokens_per_sec", r6(F.col("tokens_per_sec")))
