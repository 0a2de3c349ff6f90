"""Tokenizers as Column -> Column of array<int>, vocabulary building and vocabulary encoding."""

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from prefmill.operators.rowindex import ordered_index
from prefmill.operators.tools import literal
from prefmill.session import width

PAD, BOS, EOS, UNK = 0, 1, 2, 3
SPECIALS = ["<pad>", "<s>", "</s>", "<unk>"]
SHIFT = 8  # ids below are kept for specials
WORDS = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f]"
HOT = 1 << 20  # at most this many of the most frequent tokens are broadcast,
HOT_CHARS = 64  # and of a larger vocabulary only tokens up to this length, which bounds the bytes
PART_BYTES = 1 << 24  # of text whose tokens one task regroups; its memory holds them, however large the table is


def char_ids(text: Column) -> Column:
    """Code points shifted past the special ids."""
    ids = F.transform(F.split(text, ""), lambda c: F.ascii(c) + SHIFT)
    return F.when(F.length(text) > 0, ids).otherwise(F.array().cast("array<int>"))


def with_specials(tokenize, marks: dict[str, int]):
    """A tokenizer that turns each of ``marks`` into its one id and leaves the text between them to ``tokenize``. Of marks
    that begin alike the longest wins."""
    if not marks:
        return tokenize
    one = "|".join(literal(m) for m in sorted(marks, key=len, reverse=True))
    pattern = f"(?s){one}|(?:(?!{one}).)+"
    ids = F.create_map(*[F.lit(x) for m, i in marks.items() for x in (m, i)])

    def run(text: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        special = list(marks)
        return F.flatten(F.transform(parts, lambda p: F.when(p.isin(*special), F.array(F.element_at(ids, p))).otherwise(tokenize(p))))

    return run


class Subwords:
    """A tokenizer file of the ``tokenizers`` library as Column -> Column. Python runs in Arrow batches on the executors,
    which must find the file at ``path``; marks that the file names as special become their ids. For supervised rows and
    plain text; the encoders of answer pairs take column tokenizers only, as they compare lengths inside array expressions."""

    def __init__(self, path: str):
        self.path = path

    def many(self, texts: Column) -> Column:
        """Ids of each of an array of texts."""
        path = self.path

        @F.pandas_udf("array<array<int>>")
        def run(rows: pd.Series) -> pd.Series:
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)

            def ids(row):
                return None if row is None else [e.ids for e in tokenizer.encode_batch([t or "" for t in row], add_special_tokens=False)]
            return rows.map(ids)

        return run(texts)

    def __call__(self, text: Column) -> Column:
        return F.get(self.many(F.array(text)), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def vocab_build(df: DataFrame, text: str = "text") -> DataFrame:
    """token, n, id: specials first, then by falling count and token."""
    counted = df.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    keys = counted.filter(~F.col("token").isin(*SPECIALS)).select((-F.col("n")).alias("_falling"), "token")
    ranked = ordered_index(keys, ["_falling", "token"], name="id").select(
        "token", (-F.col("_falling")).alias("n"), (F.col("id") + len(SPECIALS)).alias("id"))
    special = df.sparkSession.createDataFrame([(t, 0, i) for i, t in enumerate(SPECIALS)], "token string, n long, id long")
    return special.unionByName(ranked)


def encode_tokens(df: DataFrame, vocab: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, input_ids in text order; a text without tokens gives an empty list.

    Texts are placed by key before they are exploded, so regrouping needs no second shuffle; there are more places for more
    text, so that regrouping spills nothing. Frequent short tokens are joined by broadcast; the rest, none of which can be
    hot, by shuffle.
    """
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    places = max(width(df.sparkSession), -(-total // PART_BYTES))
    spread = df.select(key, text).repartition(places, key).select(key, F.posexplode_outer(words(F.col(text))).alias("pos", "token"))
    ids = vocab.select("token", F.col("id").alias("_id"))
    size = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.length("token")), F.lit(0)).alias("longest")).first()
    if size["n"] <= HOT and size["longest"] <= HOT_CHARS:
        coded = spread.join(F.broadcast(ids), "token", "left")
    else:
        hot = (F.col("_id") < HOT) & (F.length("token") <= HOT_CHARS)
        marked = spread.join(F.broadcast(ids.filter(hot)), "token", "left")
        known = marked.filter(F.col("_id").isNotNull())
        rest = marked.filter(F.col("_id").isNull()).drop("_id").join(ids.filter(~hot), "token", "left")
        coded = known.unionByName(rest)
    # Place and id in one number: small, and sorted as such.
    cell = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.coalesce("_id", F.lit(UNK)).cast("long"))
    packed = coded.groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("_t"))
    return packed.select(key, F.transform("_t", lambda t: t.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("input_ids"))
