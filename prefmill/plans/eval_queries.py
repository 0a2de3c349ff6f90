"""Evaluation of predictions, judge replies, scores and logs."""

from pyspark.sql import functions as F

from prefmill.functions.hashing import hash32
from prefmill.functions.numeric import r6
from prefmill.operators import judge as J, mcq as M, ngrams as N, rewards as W, series as S
from prefmill.operators.rowindex import ordered_index
from prefmill.plans import fixtures as X
from prefmill.plans.base import h, query
from prefmill.plans.loss_queries import r
from prefmill.plans.render_queries import EXAM, exam

_BLEU = X.PREDS + """, n AS (SELECT unnest([1,2,3,4]) AS n),
hg AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, substr(predict, unnest(range(1, length(predict)-n+2))::BIGINT, n) AS g FROM preds, n) GROUP BY ALL),
rg AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, substr(label, unnest(range(1, length(label)-n+2))::BIGINT, n) AS g FROM preds, n) GROUP BY ALL),
pn AS (SELECT hg.id, hg.n, sum(least(hg.c, coalesce(rg.c,0))) AS hit, sum(hg.c) AS total FROM hg LEFT JOIN rg ON rg.id=hg.id AND rg.n=hg.n AND rg.g=hg.g GROUP BY ALL),
pp AS (SELECT p.id, n.n, coalesce(hit,0) AS hit, greatest(coalesce(total,0),1) AS total FROM preds p CROSS JOIN n LEFT JOIN pn ON pn.id=p.id AND pn.n=n.n),
ps AS (SELECT *, sum(CASE WHEN hit=0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS miss FROM pp),
sc AS (SELECT id, sum(0.25*ln(CASE WHEN hit=0 THEN 1/(pow(2.0,miss)*total) ELSE hit/total::DOUBLE END)) AS lg, max(CASE WHEN n=1 THEN hit END) AS h1 FROM ps GROUP BY id),
bleu AS (SELECT id, CASE WHEN length(predict)=0 OR h1=0 THEN 0.0 ELSE round(100*exp(lg)*CASE WHEN length(predict)>length(label) THEN 1.0 ELSE exp(1-length(label)/length(predict)::DOUBLE) END,4) END AS bleu4
  FROM preds JOIN sc USING (id))"""


@query("bleu4", f"WITH {_BLEU} SELECT id, bleu4 FROM bleu")
def bleu4(spark, folder):
    return X.predictions(spark, folder).select("id", N.bleu4(F.col("predict"), F.col("label")).alias("bleu4"))


def _rouge_sql(n):
    def grams(c):
        return f"list_distinct(list_transform(range(1, greatest(len({c})-{n - 1},0)+1), lambda i: array_to_string({c}[i:i+{n - 1}],' ')))"
    return f"""(SELECT id, round(2*(p*q/(p+q+1e-8))*100,4) AS f FROM (SELECT id, len(list_intersect(a,b))/greatest(len(a),1)::DOUBLE AS p,
      len(list_intersect(a,b))/greatest(len(b),1)::DOUBLE AS q FROM (SELECT id, {grams('pw')} AS a, {grams('lw')} AS b FROM wd)))"""


_ROUGE = X.PREDS + f""", wd AS MATERIALIZED (SELECT id, regexp_extract_all(predict, '[^ \\t\\n\\r\\f]+') AS pw, regexp_extract_all(label, '[^ \\t\\n\\r\\f]+') AS lw FROM preds),
r1 AS {_rouge_sql(1)}, r2 AS {_rouge_sql(2)}"""


@query("rouge_n", f"WITH {_ROUGE} SELECT id, r1.f AS rouge_1, r2.f AS rouge_2 FROM r1 JOIN r2 USING (id)")
def rouge_n(spark, folder):
    p, t = F.col("predict"), F.col("label")
    return X.predictions(spark, folder).select("id", N.rouge_n(p, t, 1).alias("rouge_1"), N.rouge_n(p, t, 2).alias("rouge_2"))


# The fold keeps, for every length, the first place of the prediction at which a common subsequence of that length can end.
_LCS = f"""WITH {_ROUGE}, lc AS (SELECT id, len(pw) AS m, len(lw) AS n, len(list_reduce(
  list_transform(lw, lambda t: list_filter(range(1, len(pw)+1), lambda i: pw[i]=t)),
  lambda k, x: list_filter(list_transform(range(0, len(k)+1), lambda l: least(coalesce(k[l+1], 1000000000), coalesce(list_min(list_filter(x, lambda p: p > coalesce(k[l], 0))), 1000000000))),
    lambda v: v < 1000000000), []::BIGINT[])) AS c FROM wd)
SELECT id, round(2*((c/greatest(m,1)::DOUBLE)*(c/greatest(n,1)::DOUBLE)/(c/greatest(m,1)::DOUBLE+c/greatest(n,1)::DOUBLE+1e-8))*100, 4) AS rouge_l FROM lc"""


@query("rouge_l", _LCS)
def rouge_l(spark, folder):
    return X.predictions(spark, folder).select("id", N.rouge_l(F.col("predict"), F.col("label")).alias("rouge_l"))


@query("metric_means", f"""WITH {_BLEU.replace(X.PREDS, _ROUGE)} SELECT {r('avg(bleu4)')} AS predict_bleu4, {r('avg(r1.f)')} AS predict_rouge_1, count(*)::BIGINT AS samples,
  round(count(*)/131.664,3) AS predict_samples_per_second, round(10/131.664,3) AS predict_steps_per_second FROM bleu JOIN r1 USING (id)""")
def metric_means(spark, folder):
    rows = X.predictions(spark, folder)
    p, t = F.col("predict"), F.col("label")
    both = rows.select(N.bleu4(p, t).alias("bleu4"), N.rouge_n(p, t, 1).alias("rouge_1"))
    out = N.metric_means(both, ["bleu4", "rouge_1"], 131.664, 10)
    return out.withColumn("predict_bleu4", r6(F.col("predict_bleu4"))).withColumn("predict_rouge_1", r6(F.col("predict_rouge_1")))


def replies(spark, folder):
    """Judge replies over the pairs; an eleventh does not start with two scores."""
    rows = X.pairs(spark, folder)
    score = [(X.tag(t, "id") % 10 + 1).cast("string") for t in ("base", "new")]
    text = F.concat(score[0], F.lit(" "), score[1], F.lit("\nbecause"))
    return rows.select("id", F.when(X.tag("bad", "id") % 11 == 0, "I prefer 1").otherwise(text).alias("reply"), F.col("output").alias("response"))


@query("win_rate", f"""WITH {X.PAIRS}, s AS (SELECT {h("'bad:'||id")} % 11 = 0 AS bad, {h("'base:'||id")} % 10 AS b, {h("'new:'||id")} % 10 AS n, length(output) AS l FROM pairs)
SELECT count(*)::BIGINT AS questions, count(*) FILTER (bad)::BIGINT AS errors, {r('count(*) FILTER (NOT bad AND n>=b)/count(*)::DOUBLE')} AS win_rate, {r('avg(l)')} AS average_length FROM s""")
def win_rate(spark, folder):
    out = J.win_rate(replies(spark, folder))
    return out.withColumn("win_rate", r6(F.col("win_rate"))).withColumn("average_length", r6(F.col("average_length")))


@query("harmless_rate", f"SELECT count(*)::BIGINT AS n, {r('avg(1-toxic)')} AS harmless_rate FROM labels")
def harmless_rate(spark, folder):
    verdict = F.when(F.col("toxic") == 1, F.concat(F.lit("unsafe\nS"), (F.col("doc_id") % 9).cast("string"))).otherwise("safe")
    out = J.harmless_rate(X.table(spark, folder, "labels").select(verdict.alias("verdict")))
    return out.withColumn("harmless_rate", r6(F.col("harmless_rate")))


@query("mean_scores", f"WITH {X.SCORES} SELECT run, {r('avg(reward)')} AS mean_reward, {r('avg(cost)')} AS mean_cost FROM scores GROUP BY run")
def mean_scores(spark, folder):
    return W.mean_scores(X.scores(spark, folder)).select("run", r6(F.col("mean_reward")).alias("mean_reward"), r6(F.col("mean_cost")).alias("mean_cost"))


@query("scalarise", f"""WITH {X.SCORES} SELECT doc_id, run, w::DOUBLE AS w, {r('w*reward+(1-w)*cost')} AS r, {r('reward+0.01*-length(prompt_response)')} AS penalised
FROM scores, (VALUES (0.1::DOUBLE),(0.5::DOUBLE),(0.9::DOUBLE)) x(w)""")
def scalarise(spark, folder):
    out = W.scalarise(X.scores(spark, folder), "reward", "cost", [0.1, 0.5, 0.9])
    return out.select("doc_id", "run", "w", r6(F.col("r")).alias("r"), r6(W.length_penalty(F.col("reward"), F.length("prompt_response"), 0.01)).alias("penalised"))


def graded(spark, folder):
    """Exam rows with choice scores, some tied, and the picked letter."""
    test, _ = exam(spark, folder)
    scores = {c: (X.tag(c, "qid") % 7).cast("double") / 7 for c in M.CHOICES}
    return test.select("qid", "subject", "answer", M.argmax_choice(scores).alias("prediction"))


_PICK = EXAM + f""", pk AS (SELECT qid, subject, answer, {h("'A:'||qid")}%7 AS sa, {h("'B:'||qid")}%7 AS sb, {h("'C:'||qid")}%7 AS sc, {h("'D:'||qid")}%7 AS sd FROM exam WHERE NOT train),
gr AS (SELECT qid, subject, answer, CASE greatest(sa,sb,sc,sd) WHEN sa THEN 'A' WHEN sb THEN 'B' WHEN sc THEN 'C' ELSE 'D' END AS prediction FROM pk),
ct AS (SELECT 'subject_'||i AS subject, ['STEM','Social Sciences','Humanities'][i%3+1] AS category FROM range(8) t(i))"""


def categories(spark, folder):
    """subject -> category from the subjects that occur; one category has none."""
    test, _ = exam(spark, folder)
    number = F.regexp_extract("subject", r"(\d+)", 1).cast("int")
    return test.select("subject").distinct().withColumn("category", F.get(F.array(*[F.lit(c) for c in M.CATEGORIES[:3]]), number % 3))


@query("argmax_choice", f"WITH {_PICK} SELECT qid, prediction FROM gr")
def argmax_choice(spark, folder):
    return graded(spark, folder).select("qid", "prediction")


@query("mcq_accuracy", f"""WITH {_PICK}, j AS (SELECT category, CASE WHEN prediction=answer THEN 1 ELSE 0 END AS hit FROM gr JOIN ct USING (subject))
SELECT category, count(*)::BIGINT AS n, {r('avg(hit)*100')} AS accuracy FROM j GROUP BY 1 UNION ALL SELECT 'Average', count(*), {r('avg(hit)*100')} FROM j""")
def mcq_accuracy(spark, folder):
    return M.mcq_accuracy(graded(spark, folder), categories(spark, folder)).withColumn("accuracy", r6(F.col("accuracy")))


@query("join_subject_category", f"WITH {_PICK} SELECT qid, subject, category FROM gr JOIN ct USING (subject)")
def join_subject_category(spark, folder):
    return graded(spark, folder).join(categories(spark, folder), "subject").select("qid", "subject", "category")


@query("join_pred_label", f"""WITH {X.PREDS} SELECT id, md5(prompt) AS prompt, md5(predict) AS predict, md5(label) AS label, true AS matched FROM preds WHERE {h("'lost:'||id")} % 13 <> 0
UNION ALL SELECT id, NULL, md5(predict), NULL, false FROM preds WHERE {h("'lost:'||id")} % 13 = 0""")
def join_pred_label(spark, folder):
    from prefmill.operators.joins import join_pred_label as join
    rows = X.predictions(spark, folder)
    labels = rows.filter(X.tag("lost", "id") % 13 != 0).select("id", "prompt", "label")
    matched, lost = join(rows.select("id", "predict"), labels, "id")
    cells = matched.select("id", *[F.md5(c).alias(c) for c in ("prompt", "predict", "label")], F.lit(True).alias("matched"))
    none = F.lit(None).cast("string")
    return cells.unionByName(lost.select("id", none.alias("prompt"), F.md5("predict").alias("predict"), none.alias("label"), F.lit(False).alias("matched")))


@query("join_baseline", f"""WITH {X.PREFS}, a AS (SELECT *, row_number() OVER (ORDER BY id)-1 AS idx FROM prefs)
SELECT idx, md5(prompt) AS question, md5(chosen) AS baseline, md5(rejected) AS response FROM a""")
def join_baseline(spark, folder):
    from prefmill.operators.joins import join_baseline as join
    rows = X.preferences(spark, folder)
    out = join(rows.select("id", F.col("chosen").alias("output")), rows.select("id", F.col("prompt").alias("question"), F.col("rejected").alias("response")), "id")
    return out.select("idx", F.md5("question").alias("question"), F.md5("output").alias("baseline"), F.md5("response").alias("response"))


# ---- series ---------------------------------------------------------------------------------------------------------

_EMA = """, sr AS (SELECT run, key, step, value, row_number() OVER (PARTITION BY run, key ORDER BY step) AS k, 1.8*(1/(1+exp(-0.05*count(*) OVER (PARTITION BY run, key)))-0.5) AS w FROM long),
em AS (SELECT run, key, step, value, k, w, value AS s FROM sr WHERE k=1
  UNION ALL SELECT n.run, n.key, n.step, n.value, n.k, n.w, em.s*n.w+(1-n.w)*n.value FROM em JOIN sr n ON n.run=em.run AND n.key=em.key AND n.k=em.k+1)"""


@query("ema_smooth", f"""WITH RECURSIVE {X.LOG}, long AS (SELECT run, 'loss' AS key, current_steps AS step, loss AS value FROM log WHERE loss IS NOT NULL){_EMA}
SELECT run, step AS current_steps, value AS loss, {r('s')} AS smoothed FROM em""")
def ema_smooth(spark, folder):
    rows = X.trainer_log(spark, folder).filter("loss IS NOT NULL").select("run", "current_steps", "loss")
    return S.ema_smooth(rows, ["run"], "current_steps", "loss").withColumn("smoothed", r6(F.col("smoothed")))


@query("loss_series", f"""WITH RECURSIVE {X.LOG}, long AS (SELECT run, 'loss' AS key, current_steps AS step, loss AS value FROM log WHERE loss IS NOT NULL
  UNION ALL SELECT run, 'eval_loss', current_steps, eval_loss FROM log WHERE eval_loss IS NOT NULL){_EMA}
SELECT run, key, step, value, {r('s')} AS smoothed FROM em""")
def loss_series(spark, folder):
    return S.loss_series(X.trainer_log(spark, folder), ["loss", "eval_loss"]).withColumn("smoothed", r6(F.col("smoothed")))


_MOM = X.SCORES + """, bt AS (SELECT run, doc_id, reward, (row_number() OVER (PARTITION BY run ORDER BY doc_id)-1)//64 AS batch FROM scores),
bm AS (SELECT run, batch, count(*) AS n, avg(reward) AS m, coalesce(var_samp(reward),0) AS v FROM bt GROUP BY ALL)"""
_RUNNING = _MOM + """, rm AS (SELECT run, batch, n::DOUBLE AS c, m AS mean, v AS var FROM bm WHERE batch=0
  UNION ALL SELECT b.run, b.batch, rm.c+b.n, rm.mean+(b.m-rm.mean)*b.n/(rm.c+b.n), (rm.var*rm.c + b.v*b.n + pow(b.m-rm.mean,2)*(rm.c*b.n/(rm.c+b.n)))/(rm.c+b.n)
  FROM rm JOIN bm b ON b.run=rm.run AND b.batch=rm.batch+1)"""


def moments(spark, folder):
    return S.batch_moments(X.scores(spark, folder).select("run", "doc_id", "reward"), ["run"], "doc_id", "reward", 64)


@query("running_moments", f"WITH RECURSIVE {_RUNNING} SELECT run, batch, c::BIGINT AS count, {r('mean')} AS mean, {r('var')} AS var FROM rm")
def running_moments(spark, folder):
    return S.running_moments(moments(spark, folder), ["run"]).withColumn("mean", r6(F.col("mean"))).withColumn("var", r6(F.col("var")))


@query("ema_moments", f"""WITH RECURSIVE {_MOM}, em AS (SELECT run, batch, 0.1*m AS mean, 0.9+0.1*v AS var FROM bm WHERE batch=0
  UNION ALL SELECT b.run, b.batch, 0.9*em.mean+0.1*b.m, 0.9*em.var+0.1*b.v FROM em JOIN bm b ON b.run=em.run AND b.batch=em.batch+1)
SELECT run, batch, {r('mean')} AS ema_mean, {r('var')} AS ema_var FROM em""")
def ema_moments(spark, folder):
    out = S.ema_moments(moments(spark, folder), ["run"])
    return out.withColumn("ema_mean", r6(F.col("ema_mean"))).withColumn("ema_var", r6(F.col("ema_var")))


@query("normalise", f"""WITH RECURSIVE {_RUNNING}, z AS (SELECT run, max_by(mean,batch) AS mean, max_by(var,batch) AS var FROM rm GROUP BY run)
SELECT run, doc_id, {r('(reward-mean)/(sqrt(var)+1e-8)')} AS affine, {r('reward/(sqrt(var)+1e-8)')} AS scale, {r('reward-mean')} AS translate, {r('reward')} AS identity FROM scores JOIN z USING (run)""")
def normalise(spark, folder):
    last = S.running_moments(moments(spark, folder), ["run"]).groupBy("run").agg(F.max_by(F.struct("mean", "var"), "batch").alias("m"))
    rows = X.scores(spark, folder).join(last, "run")
    return rows.select("run", "doc_id", *[r6(S.normalise(F.col("reward"), F.col("m.mean"), F.col("m.var"), how)).alias(how)
                                          for how in ("affine", "scale", "translate", "identity")])


@query("weighted_avg", f"""WITH {X.LOG} SELECT run, {r('sum(loss*total_tokens)/sum(total_tokens)')} AS avg, sum(total_tokens)::BIGINT AS count FROM log WHERE loss IS NOT NULL GROUP BY run""")
def weighted_avg(spark, folder):
    rows = X.trainer_log(spark, folder).filter("loss IS NOT NULL")
    return S.weighted_avg(rows, ["run"], "loss", "total_tokens").withColumn("avg", r6(F.col("avg")))


@query("latest_row", f"""WITH {X.LOG} SELECT run, current_steps, loss, eval_loss, {r('lr')} AS lr, total_tokens FROM log QUALIFY row_number() OVER (PARTITION BY run ORDER BY current_steps DESC)=1""")
def latest_row(spark, folder):
    out = S.latest_row(X.trainer_log(spark, folder), "run", "current_steps")
    return out.select("run", "current_steps", "loss", "eval_loss", r6(F.col("lr")).alias("lr"), "total_tokens")


def _dur(x):
    s = f"floor({x})::BIGINT"
    clock = f"(({s})%86400//3600)||':'||lpad((({s})%3600//60)::VARCHAR,2,'0')||':'||lpad((({s})%60)::VARCHAR,2,'0')"
    return f"CASE ({s})//86400 WHEN 0 THEN '' WHEN 1 THEN '1 day, ' ELSE (({s})//86400)||' days, ' END||{clock}"


@query("progress", f"""WITH {X.LOG} SELECT run, current_steps, round(current_steps/total_steps*100,2) AS percentage, {_dur('elapsed_s')} AS elapsed_time,
{_dur('CASE WHEN current_steps<>0 THEN (total_steps-current_steps)*(elapsed_s/current_steps) ELSE 0 END')} AS remaining_time FROM log""")
def progress(spark, folder):
    return S.progress(X.trainer_log(spark, folder)).select("run", "current_steps", "percentage", "elapsed_time", "remaining_time")


@query("throughput", f"WITH {X.LOG} SELECT run, current_steps, CASE WHEN elapsed_s>0 THEN round(total_tokens/elapsed_s,2) END AS throughput FROM log")
def throughput(spark, folder):
    return S.throughput(X.trainer_log(spark, folder)).select("run", "current_steps", "throughput")
