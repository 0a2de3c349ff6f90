"""SpotSigs fingerprints with DataFrame functions only.

A text is lower-cased and everything but letters and digits separates words. Every common word (an anchor) starts a
chain: itself and the next ``CHAIN`` content words, skipping up to ``SKIP`` anchors before each; at the text's end a chain
may be shorter. A signature is a 32-bit hash of a chain, a fingerprint the sorted set of signatures as hexadecimal text.
Likeness is the Jaccard coefficient of two sets.

A text without any chain takes every word as an anchor; one without letters and digits is its own signature. So equal
texts have equal fingerprints, an empty or null text has the empty one, and two empty sets have likeness 1.

``near_copies`` joins sets by their rarest signatures inside partitions of similar set length and prunes by the bound
that lengths and prefixes put on the coefficient.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from prefmill.session import settled

CHAIN, SKIP = 3, 8
KEY = ["given", "id", "h"]  # whether there is a doc_id, the doc_id, a hash of the text

#: Frequent function words of four languages.
ANCHORS = """a about an and are as at be but by can do for from had has have he her his in is it not of on or she that the
    their there they this to was we were which will with you
    als auch auf aus bei das dem den der des die ein eine er es für ich im ist mit nicht sich sie sind und von war werden
    wie zu
    au avec ce dans de des du elle en est et il je la le les mais ne nous on par pas plus pour que qui se sont sur un une
    vous al como con del el esta ha la las lo los más me no para pero por que se si sin su sus una y""".split()


def _anchor_pattern() -> str:
    return r"(?<![^ ])(" + "|".join(sorted(set(ANCHORS))) + r")(?![^ ])"


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the distinct 32-bit hashes of the chains of ``text`` (never null), ascending.

    Each step is a column of its own that later ones use more than once, so no pattern runs twice on a text.
    """
    skip, word = rf"(?: ~[^ ]+){{0,{SKIP}}}", r"[^~ ][^ ]*"
    chains = rf"(?=(~[^ ]+(?:{skip} {word}){{1,{CHAIN}}}))"
    every = rf"(?<![^ ])(?=([^ ]+(?: [^ ]+){{0,{CHAIN}}}))"
    df = df.withColumn("_plain", F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")))
    df = df.withColumn("_found", F.regexp_extract_all(F.regexp_replace("_plain", _anchor_pattern(), "~$1"), F.lit(chains), F.lit(1)))
    # A line per chain; the skipped anchors go, the one that starts the line stays.
    kept = F.split(F.regexp_replace(F.array_join("_found", "\n"), " ~[^ ]+", ""), "\n")
    sets = (F.when(F.size("_found") > 0, kept).when(F.col("_plain") != "", F.regexp_extract_all("_plain", F.lit(every), F.lit(1)))
            .when(F.col(text) != "", F.array(text)).otherwise(F.array().cast("array<string>")))
    hashed = F.transform(sets, lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return df.withColumn(name, F.array_sort(F.array_distinct(hashed))).drop("_plain", "_found")


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def neighbours(keys: DataFrame) -> DataFrame:
    """KEY and next_KEY: each key's successor in order; the last key's is the first. Keys are distinct.

    Keys alone are range partitioned and written. A window sees one partition; a row per partition links them.
    """
    ranged = keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    ranged = settled(ranged.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_slot", F.shiftright("_at", 33))
    inner = Window.partitionBy("_slot").orderBy("_at")
    firsts = ranged.groupBy("_slot").agg(F.min_by(F.struct(*KEY), "_at").alias("first"))
    slots = Window.orderBy("_slot")  # a row for each partition, not for each document
    firsts = firsts.withColumn("_after", F.coalesce(F.lead("first").over(slots), F.first("first").over(slots)))
    following = ranged.withColumn("_next", F.lead(F.struct(*KEY)).over(inner)).join(firsts, "_slot")
    following = following.withColumn("_next", F.coalesce("_next", "_after"))
    return following.select(*KEY, "n", *[F.col(f"_next.{k}").alias(f"next_{k}") for k in KEY])


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Documents are ordered by doc_id (null first), then by a hash of the text; a repeated row counts once in that order and
    is returned as often as it occurs. Texts move twice: to their key, and their first halves to the key before.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.isnotnull("doc_id").alias("given"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"),
                       F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    after = neighbours(rows.groupBy(*KEY).agg(F.max(F.char_length("text")).alias("n")))
    # The joins below are of tables that grow alike, so they have one plan at every size.
    before = after.select(*[F.col(f"next_{k}").alias(k) for k in KEY], *[F.col(k).alias(f"to_{k}") for k in KEY],
                          F.floor(F.col("n") / 2).cast("int").alias("_k")).hint("merge")
    first = F.isnull(F.lag("h").over(Window.partitionBy(*KEY).orderBy(*KEY)))  # one of repeated rows
    heads = rows.withColumn("_first", first).filter("_first").join(before, KEY)
    heads = with_signatures(heads, "text", "next_sigs").select(
        *[F.col(f"to_{k}").alias(k) for k in KEY], F.substring("text", F.lit(1), F.col("_k")).alias("head"), "next_sigs")
    both = rows.join(heads.hint("merge"), KEY).withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    both = both.withColumn("edited", F.concat(kept, "head"))
    both = with_signatures(with_signatures(both, "text", "sigs"), "edited", "edited_sigs")
    return both.select(F.when(F.col("given"), F.col("id")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_copies(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, cls) and pairs of classes (a, b, likeness) with a < b and likeness >= threshold.

    A class is all documents with one fingerprint, named after its smallest id. Documents without words are alike.
    Two sets this alike share one of the n - ceil(threshold n) + 1 rarest signatures of either, and their lengths differ
    by the threshold at most, so only those signatures are joined, inside one length partition or two neighbouring ones.
    """
    sigs = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sigs")
    sets = settled(sigs.drop("text").withColumn("print", F.sha2(fingerprint(F.col("sigs")), 256)))
    classes = settled(sets.groupBy("print").agg(F.min_by("sigs", "doc_id").alias("sigs"), F.min("doc_id").alias("cls"))
                      .withColumn("n", F.size("sigs")))
    member = sets.join(classes.select("print", "cls"), "print").select("doc_id", "cls")
    single = classes.select("cls", "n", F.explode("sigs").alias("sig"))
    common = single.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("cls").orderBy("df", "sig")  # one document's signatures
    prefix = (single.join(common, "sig").filter("df > 1").withColumn("_r", F.row_number().over(rare))
              .filter(F.col("_r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1))
    part = F.floor(F.log("n") / math.log(1 / threshold) + 1e-9)
    prefix = settled(prefix.select("cls", "n", "sig", part.alias("part")))
    left = prefix.select(F.col("cls").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "sig", "part")
    close = (F.col("na") <= F.col("nb")) & (F.col("na") >= threshold * F.col("nb")) & (F.col("a") != F.col("b"))
    found = left.join(right, ["sig", "part"]).filter(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = classes.select(F.col("cls").alias("a"), F.col("sigs").alias("sa"))
    other = classes.select(F.col("cls").alias("b"), F.col("sigs").alias("sb"))
    pairs = found.join(own, "a").join(other, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return member, pairs.filter(F.col("likeness") >= threshold)
