import hashlib
import re

from helpers import documents

from prefmill.llm import spotsigs
from prefmill.llm.base import table

ANCHORS = set(spotsigs.ANCHORS)


def chains(text):
    """Brute force: the chains of a text as strings."""
    plain = [w for w in re.sub(r"[^\w]|_", "\0", text.lower()).split("\0") if w]
    out = []
    for i, word in enumerate(plain):
        chain, j = [word], i + 1
        while word in ANCHORS and len(chain) <= spotsigs.CHAIN:
            skipped = 0
            while j < len(plain) and plain[j] in ANCHORS and skipped < spotsigs.SKIP:
                j, skipped = j + 1, skipped + 1
            if j >= len(plain) or plain[j] in ANCHORS:
                break
            chain.append(plain[j])
            j += 1
        if len(chain) > 1:
            out.append(" ".join(chain))
    if not out:
        out = [" ".join(plain[i:i + spotsigs.CHAIN + 1]) for i in range(len(plain))] or [text] * bool(text)
    return set(out)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def compare(rows, out):
    order = sorted({(d is not None, d or 0, t) for d, t in rows})
    assert len(out) == len(rows)
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in out}
    for (given, d, text), following in zip(order, order[1:] + order[:1]):
        k = len(text) // 2
        edited = text[:len(text) - k] + following[2][:k]
        r = got[d if given else None, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        assert abs(r["near_edited"] - jaccard(chains(text), chains(edited))) < 1e-9
        assert abs(r["near_next"] - jaccard(chains(text), chains(following[2]))) < 1e-9
        assert len(r["fingerprint"]) == 8 * len(chains(text)) and len(r["edited_fingerprint"]) == 8 * len(chains(edited))


def test_given_table_equals_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    compare([(r["doc_id"], r["text"] or "") for r in docs.collect()], spotsigs.edited(docs).collect())


def test_odd_rows(spark):
    rows = [(3, None), (7, ""), (5, "the cat sat on the mat with a dog"), (1, "*** !!!"), (2, "the the the"), (4, "plain"),
            (9, "the " * 20_000 + "end"), (8, "Ünï the cödé 𝄞 x"), (-4, "a b c"), (10, "word " * 30_000 + "the last one")]
    docs = documents(spark, rows)
    out = spotsigs.edited(docs).collect()
    compare([(d, t or "") for d, t in rows], out)
    repeated = spotsigs.edited(documents(spark, rows + rows[2:3] * 2)).collect()
    assert sorted(map(repr, set(repeated))) == sorted(map(repr, out)) and len(repeated) == len(out) + 2
    alone = spotsigs.edited(documents(spark, [(None, "the one text")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0 and alone[0]["doc_id"] is None
    assert spotsigs.edited(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = spotsigs.edited(table(spark, folder, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_near_copies_equal_all_pairs(spark):
    base = "the quick fox and the lazy dog are in a big house with many doors for the people of that old town by the sea"
    words = base.split()
    texts = [" ".join(words[:i] + ["new"] * (i % 3) + words[i:]) for i in range(len(words))] + [base, base, "", "other thing", None]
    docs = documents(spark, list(enumerate(texts)))
    member, pairs = spotsigs.near_copies(docs, 0.8)
    cls = {r["doc_id"]: r["cls"] for r in member.collect()}
    sets = {i: chains(t or "") for i, t in enumerate(texts)}
    assert all((cls[i] == cls[j]) == (sets[i] == sets[j]) for i in sets for j in sets)
    reps = sorted(set(cls.values()))
    want = {(a, b) for a in reps for b in reps if a < b and sets[a] | sets[b] and jaccard(sets[a], sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
