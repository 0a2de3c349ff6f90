import hashlib
import random
import zlib

from helpers import documents

from prefmill.llm import wordruns


def brute(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def random_text(rng):
    words = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 20))]
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(words))
        words[at:at] = [rng.choice("abcd") for _ in range(rng.randint(1, 6))] * rng.randint(1, 8)
    return words


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        texts = [random_text(rng) for _ in range(rng.randint(0, 6))]
        assert wordruns.runs_of(texts) == [brute(t) for t in texts], texts


def test_long_texts():
    texts = [["a"] * 30_000, list("abc") * 9_000, [str(i) for i in range(5_000)] * 4, ["x"] * 9 + [str(i) for i in range(20_000)] + ["x"] * 7]
    assert wordruns.runs_of(texts) == [[(0, 30_000, 1)], [(0, 27_000, 3)], [(0, 20_000, 5_000)], [(0, 9, 1), (20_009, 7, 1)]]


def expected(key, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(key).encode() if key is not None else b""), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    lost = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (key, len(runs), *best, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in lost)).hexdigest())


def test_query_equals_brute_force(spark):
    rng = random.Random(12)
    cases = [None, "", " \t\n", "a a a a a a", "a\x0ba\x0ca\ra\ta a", "a\u00a0a a\u00a0a", "é 😀 " * 5, "b " * 6 + "c"]
    cases += [" ".join(random_text(rng)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(cases)] + [(7, cases[7]), (None, "a a a a a a a")]
    got = wordruns.digests(documents(spark, rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert wordruns.digests(documents(spark, rows).limit(0)).count() == 0


def test_given_documents(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    from prefmill.llm.queries import QUERIES
    got = sorted(map(tuple, QUERIES["op11_wordruns"](spark, folder).collect()))
    short = {i: t for i, t in rows if len(t or "") < 4000}
    assert len(got) == len(rows) and sum(r[1] for r in got) > 5
    assert [r for r in got if r[0] in short] == sorted(expected(i, t) for i, t in short.items())


def test_texts_and_spans(spark):
    out = wordruns.word_runs(documents(spark, [(1, "x  a b a b a b a b\ny")])).first()
    assert out["collapsed"] == "x a b y" and [tuple(r) for r in out["runs"]] == [(1, 8, 2)]
