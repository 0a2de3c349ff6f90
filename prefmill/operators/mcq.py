"""Multiple-choice prompts, choice picking and accuracy."""

from pyspark.sql import Column, DataFrame, functions as F

from prefmill.functions.hashing import keyed
from prefmill.operators.align import message
from prefmill.operators.rowindex import shuffled_index

CHOICES = ("A", "B", "C", "D")
PER_COPY = 10_000  # questions that one copy of a support row serves
# Fixed values: (header, choice line, answer marker) per language.
LAYOUTS = {
    "en": ("The following are multiple choice questions (with answers) about {subject}.\n\n", "\n{choice}. {content}",
           "\nAnswer:"),
    "zh": ("以下是中国关于{subject}考试的单项选择题，请选出其中的正确答案。\n\n", "\n{choice}. {content}", "\n答案："),
}
CATEGORIES = ("STEM", "Social Sciences", "Humanities", "Other")


def question_text(row, lang: str = "en") -> Column:
    """Question, choices and answer marker; ``row`` maps a field name to a column."""
    _, line, marker = LAYOUTS[lang]
    left, right = line.split("{choice}")
    middle, _ = right.split("{content}")
    choices = [F.concat(F.lit(left + c + middle), row(c)) for c in CHOICES]
    return F.concat(row("question"), *choices, F.lit(marker))


def mcq_prompt(questions: DataFrame, support: DataFrame, shots: int, lang: str = "en", seed=0) -> DataFrame:
    """qid, subject, messages. Each question takes ``shots`` consecutive rows, from a hashed start, of its subject's
    support rows in hashed order: distinct rows without listing a subject's rows anywhere.

    A subject with few support rows and many questions would make each support row a hot join key. Such rows are copied
    so that a copy serves about PER_COPY questions; the copies follow from the counts per subject.
    """
    indexed = shuffled_index(support.select("subject", F.col("qid").alias("sid"), "question", *CHOICES, "answer"), ["sid"], seed,
                             group=["subject"], name="at", total="of")
    uses = F.ceil(F.col("asked") * F.least(F.lit(shots).cast("bigint"), F.col("of")) / F.col("of") / PER_COPY)
    sizes = support.groupBy("subject").agg(F.count(F.lit(1)).alias("of")).join(
        questions.groupBy("subject").agg(F.count(F.lit(1)).alias("asked")), "subject").select("subject", "of", uses.alias("copies"))
    picks = (questions.select("qid", "subject").join(sizes, "subject")
             .withColumn("shot", F.explode(F.sequence(F.lit(0), F.least(F.lit(shots).cast("bigint"), F.col("of")) - 1)))
             .withColumn("at", (keyed(seed, "qid") + F.col("shot")) % F.col("of"))
             .withColumn("copy", keyed("copy", "qid") % F.col("copies")).drop("of", "copies"))
    shelf = indexed.drop("of").join(sizes.select("subject", "copies"), "subject").withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).drop("copies")
    asked = message("user", question_text(F.col, lang))
    shown = picks.join(shelf, ["subject", "at", "copy"]).select("qid", "shot", F.array(
        asked, message("assistant", F.col("answer"))).alias("_m"))
    shots_of = shown.groupBy("qid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shot", "_m"))),
                                                              lambda s: s["_m"])).alias("_shots"))
    target = F.array(asked, message("assistant", F.col("answer")))
    header, _, _ = LAYOUTS[lang]
    left, right = header.split("{subject}")
    lead = F.concat(F.lit(left), F.col("subject"), F.lit(right))
    joined = questions.join(shots_of, "qid", "left").withColumn(
        "_all", F.concat(F.coalesce("_shots", F.array().cast("array<struct<role:string,content:string>>")), target))
    messages = F.transform("_all", lambda m, i: F.struct(m["role"].alias("role"), F.when(
        i == 0, F.concat(lead, m["content"])).otherwise(m["content"]).alias("content")))
    return joined.select("qid", "subject", messages.alias("messages"))


def argmax_choice(scores: dict[str, Column]) -> Column:
    """Letter with the highest score; ties go to the earlier letter."""
    top = F.greatest(*scores.values())
    return F.coalesce(*[F.when(v == top, k) for k, v in scores.items()])


def mcq_accuracy(results: DataFrame, categories: DataFrame) -> DataFrame:
    """category, n, accuracy in percent; ``Average`` covers all questions. ``categories`` maps subject to category."""
    joined = results.join(categories, "subject", "left")  # an unmapped subject counts in the average, under no category
    graded = joined.select("category", (F.col("prediction") == F.col("answer")).cast("int").alias("hit"))
    out = graded.groupingSets([["category"], []], "category").agg(F.grouping("category").alias("_all"), F.count(F.lit(1)).alias("n"),
                                                                  (F.avg("hit") * 100).alias("accuracy"))
    return out.select(F.when(F.col("_all") == 1, "Average").otherwise(F.col("category")).alias("category"), "n", "accuracy")
