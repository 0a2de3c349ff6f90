"""Preference rewards and reports over (pc, pr, rc, rr) pair rows."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def pref_rewards(beta: float = 0.1, reference: bool = True) -> tuple[Column, Column]:
    """(chosen, rejected) rewards."""
    if not reference:
        return beta * F.col("pc"), beta * F.col("pr")
    return beta * (F.col("pc") - F.col("rc")), beta * (F.col("pr") - F.col("rr"))


def pref_accuracy(chosen: Column, rejected: Column) -> Column:
    """Share of pairs whose chosen reward is strictly larger."""
    return F.avg((chosen > rejected).cast("int"))


def dpo_report(pairs: DataFrame, by: list[str], beta: float = 0.1, reference: bool = True) -> DataFrame:
    """Means per group; logits are reported when the pairs carry chosen_logits and rejected_logits."""
    c, r = pref_rewards(beta, reference)
    cells = [F.avg(c).alias("rewards_chosen"), F.avg(r).alias("rewards_rejected"), pref_accuracy(c, r).alias("accuracies"),
             F.avg(c - r).alias("margins"), F.avg("pc").alias("logps_chosen"), F.avg("pr").alias("logps_rejected")]
    if "chosen_logits" in pairs.columns:
        cells += [F.avg("chosen_logits").alias("logits_chosen"), F.avg("rejected_logits").alias("logits_rejected")]
    return pairs.groupBy(*by).agg(*cells)


def kto_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means per feedback class from sums and counts, reward margin and mean kl. ``rows``: tag, reward, logps, logits,
    kl; not-a-number values are left out of the sums but counted, as the trainer does."""
    def mean(tag: bool, name: str) -> Column:
        mine = F.col("tag") if tag else ~F.col("tag")
        total = F.sum(F.when(mine, F.nanvl(F.col(name), F.lit(0.0))))
        return total / F.sum(F.when(mine, 1))
    cells = [mean(tag, name).alias(f"{name}_{side}") for tag, side in ((True, "chosen"), (False, "rejected"))
             for name in ("reward", "logps", "logits")]
    out = rows.groupBy(*by).agg(*cells, F.avg("kl").alias("kl"))
    return out.withColumn("margin", F.col("reward_chosen") - F.col("reward_rejected"))


def folder_number(folder: Column) -> Column:
    return F.regexp_extract(folder, r"noise_k(\d+)$", 1).cast("int")


def studied_folders(folders: DataFrame, skip: int = 1, count: int = 10) -> DataFrame:
    """Adapter folders by number; the first is skipped and ten are kept. Only the rows up to the last kept one are numbered."""
    named = folders.select("folder").distinct().filter(F.col("folder").startswith("noise_k"))
    first = named.orderBy(folder_number(F.col("folder"))).limit(skip + count)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy(folder_number(F.col("folder")))) - 1)
    return ranked.filter((F.col("place") >= skip) & (F.col("place") < skip + count))


def accuracy_by_rank(adapters: DataFrame, policy: DataFrame, reference: DataFrame, beta: float = 0.1) -> DataFrame:
    """rank, folder, accuracy. ``adapters``: folder, rank; ``policy``: folder, example_id, pc, pr; ``reference``:
    example_id, rc, rr. When two folders have one rank, the later folder counts."""
    chosen = studied_folders(adapters).join(adapters, "folder")
    c, r = pref_rewards(beta)
    per = (policy.join(F.broadcast(chosen), "folder").join(reference, "example_id")
           .groupBy("folder", "rank", "place").agg(pref_accuracy(c, r).alias("accuracy")))
    last = F.max(F.struct("place", "folder", "accuracy")).alias("m")
    return per.groupBy("rank").agg(last).select("rank", "m.folder", "m.accuracy")


def mean_scores(scores: DataFrame, by: str = "run") -> DataFrame:
    return scores.groupBy(by).agg(F.avg("reward").alias("mean_reward"), F.avg("cost").alias("mean_cost"))


def scalarise(rows: DataFrame, first: str, second: str, weights: list[float]) -> DataFrame:
    """One row per weight: w * first + (1 - w) * second."""
    spread = rows.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return spread.withColumn("r", F.col("w") * F.col(first) + (1 - F.col("w")) * F.col(second))


def length_penalty(reward: Column, tokens: Column, weight: float) -> Column:
    """Reward minus a weighted token count."""
    return reward + weight * -tokens
