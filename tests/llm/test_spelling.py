import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import documents

from prefmill.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    table = {}
    close = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) <= 1 and near(a, b):
                close[a].append(b)
                close[b].append(a)
    for w in words:
        best = min(close[w], key=lambda x: (-counts[x], x), default=None)
        table[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while table[w] is not None:
            w = table[w]
        return w
    return [(w, table[w], root(w), counts[w], len(close[w]), counts.get(table[w])) for w in words]


def brute_vocabulary(rows):
    counts = Counter()
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for key, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def random_words(seed, parts, most, size):
    rng = random.Random(seed)
    return {"".join(rng.choice(parts) for _ in range(rng.randint(0, most))): rng.randint(1, 500) for _ in range(size)}


# Small bounds leave most places without a gram, large ones none, short grams stay frequent: all ways are needed.
@pytest.mark.parametrize("bound, longest", [(1, 2), (3, 4), (20, 12), (256, 12)])
def test_groups_equal_brute_force(spark, bound, longest):
    counts = random_words(1, ["th", "er", "on", "é", "a", "b"], 5, 900) | {"": 3, "aaaaaaaaaaaaaaaaaaaaaaaa": 9, "aaaaaaaaaaaaaaaaaaaaaaa": 4}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.grouped(df, bound, longest).collect())) == brute(counts)


def test_lists_are_bounded_and_grams_find_links(spark):
    counts = random_words(2, ["tha", "er", "on", "ie", "a", "b"], 6, 4000)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    grams = spelling.variable_grams(df, 40)
    marked = ["\u0002%s\u0003" % w for w in counts]
    texts = {r["gram"] for r in grams.select("gram").distinct().collect()}

    def often(gram):
        return sum(len(re.findall("(?=%s)" % re.escape(gram), w)) for w in marked)
    for gram in sorted(texts)[::37]:
        assert often(gram) <= 40 and (len(gram) == 2 or min(often(gram[1:]), often(gram[:-1])) > 40), gram
    lists = spelling.listed(df, 40)
    assert lists.filter("kind = 'g'").groupBy("key").count().agg({"count": "max"}).first()[0] <= 40
    # letters whose place needs no gram at all are a minority
    rest = lists.filter("kind = 'd'").count()
    assert 0 < rest < sum(map(len, counts)) / 2


def test_large_dictionary_is_joined_over_copies(spark, monkeypatch):
    counts = random_words(3, ["th", "er", "on", "a"], 5, 500)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    monkeypatch.setattr(spelling, "SENT", 0)
    assert sorted(map(tuple, spelling.grouped(df, 10).collect())) == brute(counts)


def test_table_cases(spark):
    df = spark.createDataFrame([("again", 4, 1), ("agian", 1, 2), ("again", 2, 3), (None, 9, 4), ("agains", 3, 5), ("agein", 3, 6), ("agaon", 3, 7)],
                               "word string, n long, key long")
    out = {r["word"]: tuple(r)[1:] for r in spelling.grouped(df).collect()}
    assert out == {"again": (None, "again", 6, 3, None), "agian": (None, "agian", 1, 0, None), "agains": ("again", "again", 3, 1, 6),
                   "agein": ("again", "again", 3, 1, 6), "agaon": ("again", "again", 3, 1, 6)}
    assert spelling.grouped(df.limit(0)).count() == 0
    chain = spark.createDataFrame([("abcdefgh"[:i + 1], 3 ** i) for i in range(8)], "word string, n long")
    assert {r["root"] for r in spelling.grouped(chain).collect()} == {"abcdefgh"}
    tie = spark.createDataFrame([("hausz", 1), ("hausé", 5), ("hausy", 5), ("hausß", 5)], "word string, n long")
    assert {r["word"]: r["form"] for r in spelling.grouped(tie).collect()}["hausz"] == "hausy"


def test_vocabulary_equals_brute_force(spark):
    rng = random.Random(4)
    parts = ["Hello", "hello", "ÀBCDE", "àbcde", "a×b÷c", "word5words", "don't", "Straße", "ſhort", "x", "ABCDE fghij", "\u0178abcd"]
    rows = [(i, " ".join(rng.choice(parts) + rng.choice(["", "s", "é"]) for _ in range(30))) for i in range(200)]
    rows += [(None, "nulls nulls nulls"), (900, None), (901, ""), (901, "hello " * 20000), (901, "hello " * 20000)]
    got = {r["word"]: r["n"] for r in spelling.vocabulary(documents(spark, rows)).collect()}
    assert got == brute_vocabulary(rows) and "nulls" in got


def test_given_documents(spark, folder):
    from prefmill.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    counts = brute_vocabulary(rows)
    by_size = defaultdict(list)
    for w in counts:
        by_size[len(w)].append(w)
    got = {r["word"]: tuple(r) for r in QUERIES["op12_spelling"](spark, folder).collect()}
    assert {w: r[3] for w, r in got.items()} == counts
    for w in sorted(counts)[::23]:
        close = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 2 * counts[w] else None
        assert got[w][1] == form and got[w][2] == (got[form][2] if form else w) and got[w][4:] == (len(close), counts.get(form))
