"""Spelling variants: words one edit apart, found by a variable-length gram index.

1. Dictionary: grams are counted level by level from two signs on (words have a begin and an end mark). A gram that occurs more than
   ``bound`` times is frequent and is pruned from the index; its extensions are looked at instead, as long as both of
   their shorter parts are frequent. What remains are the shortest grams that occur at most ``bound`` times.
2. A word's variable grams are those of its places. Whether a place holds one depends on the gram alone, so an edit can only
   touch the grams that cover its place: the most grams that cover one letter is the word's bound on affected grams. Two
   near words thus share all others, and each finds the other among its (bound + 1) rarest grams: only those go into
   the lists. No list is longer than ``bound``, so the lists of a table grow with its words, whatever its most common syllables.
3. Words of one list with places and lengths at most one apart are verified by their edit distance.
4. A place that all grams of a word cover leaves no gram to meet by (in words of frequent syllables). Only for such places, and
   exactly there, words meet by what is left without the letter at that place; every pair so met is verified too.

Forms: a word's near word with most occurrences, when it has at least twice as many; roots follow forms by pointer jumping.

Defined cases: null words are left out, repeated words are added up, a null text holds no words, a null document id counts as
the empty text, an empty table gives no rows, extra columns are ignored. Ties between near words go to the smallest in code
point order.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prefmill.session import settled

#: Occurrences of an indexed gram, and signs of the longest one (frequent beyond that: step 4).
BOUND, LONGEST = 256, 12
BEGIN, END = "\u0002", "\u0003"
#: Frequent grams that are sent to every task; more meet by a shuffle join over copies.
SENT, COPIES = 1 << 19, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-z\\u00C0-\\u00FF]"


def _flagged(rows: DataFrame, frequent: DataFrame, size: int, gram: Column, how: str) -> DataFrame:
    """Join on the gram; frequent grams are the hot keys of ``rows``, so a large dictionary is copied and rows are spread."""
    rows = rows.withColumn("_gram", gram)
    if size <= SENT:
        return rows.join(F.broadcast(frequent.withColumnRenamed("gram", "_gram")), "_gram", how)
    copies = frequent.select(F.col("gram").alias("_gram"), "hit", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("_copy"))
    spread = rows.withColumn("_copy", F.pmod(F.xxhash64("padded", "at"), F.lit(COPIES)).cast("int"))
    return spread.join(copies, ["_gram", "_copy"], how).drop("_copy")


def variable_grams(words: DataFrame, bound: int = BOUND, longest: int = LONGEST) -> DataFrame:
    """word, gram, at, size: all shortest grams with at most ``bound`` occurrences, by their places in the marked word."""
    padded = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    live = words.select(padded.alias("padded")).withColumn("at", F.explode(F.sequence(F.lit(0), F.char_length("padded") - 2)))
    found, size = [], 2
    while True:
        def gram(shift, n):
            return F.substring(F.col("padded"), F.col("at") + 1 + shift, F.lit(n))
        rows = live.withColumn("gram", gram(0, size))
        counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        frequent = settled(counts.filter(F.col("n") > bound).select("gram", F.lit(True).alias("hit")))
        known = frequent.count()
        rows = settled(_flagged(live, frequent, known, gram(0, size), "left").select("padded", "at", F.col("_gram").alias("gram"), "hit"))
        found.append(rows.filter("hit IS NULL").select("padded", "gram", "at", F.lit(size).alias("size")))
        if size == longest or not known:
            break
        # One sign more, where the gram without its first sign is frequent as well.
        longer = rows.filter("hit").filter(F.col("at") + size < F.char_length("padded")).select("padded", "at")
        live = _flagged(longer, frequent, known, gram(1, size), "left_semi").select("padded", "at")
        size += 1
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out.select(F.col("padded").substr(F.lit(2), F.char_length("padded") - 2).alias("word"), "gram", "at", "size")


def entries(word: str, grams: list[tuple[int, str, int, int]]) -> list[tuple[str, str, int]]:
    """(kind, key, at) under which a word is listed. ``grams``: (occurrences, gram, place, size) in the marked word.

    ``g``: its rarest grams, one more than an edit can touch. ``d`` and ``w``: for a letter, or a gap between letters, that all
    grams cover, the word without the letter, and the whole word.
    """
    cover = [0] * (len(word) + 1)  # differences, then grams over each letter
    gaps = [0] * (len(word) + 2)
    for _, _, at, size in grams:
        first, last = max(at - 1, 0), min(at + size - 2, len(word) - 1)  # letters
        if first <= last:
            cover[first] += 1
            cover[last + 1] -= 1
        gaps[at] += 1  # gap k lies before letter k, marks included in the count of signs
        gaps[at + size - 1] -= 1
    for of in (cover, gaps):
        for i in range(1, len(of)):
            of[i] += of[i - 1]
    most = max(cover[:len(word)], default=0)
    out = [("g", gram, at) for _, gram, at, _ in sorted(grams)[:most + 1]]
    out += [("d", word[:i] + word[i + 1:], i) for i in range(len(word)) if cover[i] == len(grams)]
    return out + [("w", word, k) for k in range(len(word) + 1) if gaps[k] == len(grams)]


def listed(words: DataFrame, bound: int = BOUND, longest: int = LONGEST) -> DataFrame:
    """kind, key, at, word, n: the lists of the index."""
    # Groups of at most ``bound`` rows.
    grams = variable_grams(words, bound, longest)
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    cells = grams.join(counts, "gram").select("word", F.struct("often", "gram", "at", "size").alias("cell"), F.lit(0).cast("long").alias("n"))
    none = F.lit(None).cast("struct<often:bigint,gram:string,at:int,size:int>")
    cells = cells.unionByName(words.select("word", none.alias("cell"), "n"))
    held = cells.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("cell").alias("cells"))
    schema = pa.schema([("kind", pa.string()), ("key", pa.string()), ("at", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            lists = batch.column("cells")
            flat = lists.flatten()
            columns = [flat.field(i).to_pylist() for i in range(4)]
            cells, start = list(zip(*columns)), 0
            out = []
            for word, n, size in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), lists.value_lengths().to_pylist()):
                out += [(*e, word, n) for e in entries(word, cells[start:start + size])]
                start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, schema)], schema=schema)

    return held.mapInArrow(run, "kind string, key string, at int, word string, n bigint")


def links(words: DataFrame, bound: int = BOUND, longest: int = LONGEST) -> DataFrame:
    """a, n_a, b, n_b with a < b: every pair of words one inserted, deleted or replaced code point apart, once.

    ``words``: word, n, each word once.
    """
    lists = settled(listed(words, bound, longest))
    one = "levenshtein(x.word, y.word, 1) = 1"
    near = "x.word < y.word AND abs(char_length(x.word) - char_length(y.word)) <= 1"

    def met(x, y, condition):
        return x.alias("x").join(y.alias("y"), F.expr(f"x.key = y.key AND {condition} AND {one}")).selectExpr(
            "x.word AS a", "x.n AS n_a", "y.word AS b", "y.n AS n_b")
    grams = lists.filter("kind = 'g'")
    # Words that only differ at this place: at most as many as there are letters.
    rest = lists.filter("kind != 'g'")
    pairs = met(grams, grams, f"{near} AND abs(x.at - y.at) <= 1").unionByName(
        met(rest, rest, f"x.at = y.at AND {near} AND (x.kind = 'd' OR y.kind = 'd')"))
    return pairs.distinct()


def followed(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain word -> form. ``forms``: word, form, each word once, no cycles."""
    ends = forms.select(F.col("form").alias("_to")).distinct().join(forms.select(F.col("word").alias("_to"), F.lit(True).alias("_on")), "_to", "left")
    at = settled(forms.join(ends, forms["form"] == ends["_to"]).select("word", F.col("form").alias("root"), F.coalesce("_on", F.lit(False)).alias("open")))
    while not at.filter("open").isEmpty():
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("_root"), F.col("open").alias("_open"))
        moved = at.filter("open").join(jump, "root").select("word", F.col("_root").alias("root"), F.col("_open").alias("open"))
        at = settled(at.filter("NOT open").unionByName(moved))
    return at.select("word", "root")


def grouped(words: DataFrame, bound: int = BOUND, longest: int = LONGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of (word, n)."""
    words = settled(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")),
                              F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    near = links(words, bound, longest).select(sides.alias("s")).select("s.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("top"))
    fits = -F.col("top.m") >= 2 * F.col("n")
    out = settled(words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("top.m")).alias("form_n")))
    roots = followed(out.filter("form IS NOT NULL").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, key: str = "doc_id", column: str = "text", least_signs: int = 5, least_n: int = 3) -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, where a share of one in 97 (by a hash of document and run) has lost
    one letter; words of at least ``least_signs`` code points and ``least_n`` occurrences. Shorter runs cannot become
    such words, so they are never listed."""
    runs = F.regexp_extract_all(F.translate(F.col(column), UPPER, LOWER), F.lit(RUN + "{%d,}" % least_signs), F.lit(0))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat(F.col("_key"), F.lit(":"), F.col("run")).cast("binary")))
    at = F.pmod(F.col("h"), F.char_length("run").cast("long")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.pmod(F.col("h"), F.lit(97)) == 0, lost).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= least_n) & (F.char_length("word") >= least_signs))
