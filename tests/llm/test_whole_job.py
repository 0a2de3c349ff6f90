"""Rows, sources, lines and strings that an operator must not skip."""

import random

import numpy as np
from helpers import documents

from prefmill.llm import mainhtml, mixpack, secretforest, toxicity
from prefmill.llm.base import tokenizer_path
from prefmill.llm.tokenizing import Pieces


def test_toxicity_learns_from_every_passage():
    rng = random.Random(4)
    plain = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]

    def text(bad):
        out = [rng.choice(plain) for _ in range(2000)]
        if bad:
            out[80:84] = ["vile", "zorgle", "awful", "blimfark"]  # block 20 of 500, far from evenly spread ones
        return " ".join(out)
    texts = [text(i % 2) for i in range(60)]
    model = toxicity.train(texts, np.arange(60) % 2 > 0, (30, 30))
    bad, good = model.scores([text(True) for _ in range(20)]), model.scores([text(False) for _ in range(20)])
    assert bad.min() > good.max() and (bad > 0.7).mean() > 0.9 and (good < 0.7).mean() > 0.9


def shares_of_windows(out):
    found = {}
    for r in out.collect():
        window = found.setdefault(r["sequence_id"], {})
        window[r["source"]] = window.get(r["source"], 0) + r["length"]
    return found


def test_small_sources_hold_their_shares_in_every_window(spark, monkeypatch):
    monkeypatch.setattr(mixpack, "QUEUES", 4)
    rows = [(i, "alpha beta gamma delta " * (120 if i % 20 < 3 else 40), "en", f"s{i % 20}") for i in range(400)]
    found = shares_of_windows(mixpack.packed(documents(spark, rows), tokenizer_path(), 512))
    total = sum(sum(w.values()) for w in found.values())
    assert total == sum(4 * (120 if i % 20 < 3 else 40) + 2 for i in range(400))  # the last blank and the end id
    for s in {r[3] for r in rows}:
        wanted = 512 * sum(w.get(s, 0) for w in found.values()) / total
        assert all(abs(w.get(s, 0) - wanted) <= 4 for k, w in found.items() if k < max(found) - 1), s


def test_small_sources_keep_their_own_targets(spark, monkeypatch):
    monkeypatch.setattr(mixpack, "QUEUES", 3)
    rows = [(i, "alpha beta gamma " * 60, "en", f"s{i % 8}") for i in range(160)]
    targets = {"s0": 40.0, "s1": 30.0, "s2": 12.0, "s3": 8.0, "s4": 6.0, "s5": 4.0}
    found = shares_of_windows(mixpack.packed(documents(spark, rows), tokenizer_path(), 400, targets))
    for w in range(8):
        assert all(abs(found[w].get(s, 0) - 4 * share) <= 4 for s, share in targets.items())
    assert sum(sum(w.values()) for w in found.values()) == 160 * 182


def test_a_source_for_each_document(spark, monkeypatch):
    monkeypatch.setattr(mixpack, "QUEUES", 4)
    rows = [(i, "alpha beta " * (5 + i % 7), "en", f"site{i}") for i in range(300)]
    out = mixpack.packed(documents(spark, rows), tokenizer_path(), 64).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in out} == {i: 2 * (5 + i % 7) + 2 for i in range(300)}
    assert sum(r["length"] for r in out) == sum(2 * (5 + i % 7) + 2 for i in range(300))
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    assert all(a[1] + a[2] == (b[1] or 64) for a, b in zip(places, places[1:]))


def test_special_tokens_are_single_ids():
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(tokenizer_path())
    mark = next(t.content for t in fresh.get_added_tokens_decoder().values())
    texts = [f"a {mark} b", mark, f"{mark}{mark}", f" {mark}\n\n x", f"word{mark}word  {mark} ", f"a b\n{mark}\nc d", mark[:-1] + " " + mark]
    texts += ["nothing here", "", f"é {mark}²"]
    pieces = Pieces(tokenizer_path())
    for _ in range(2):
        for got, text in zip(pieces.encode(texts), texts):
            assert np.frombuffer(got, "<u2").tolist() == fresh.encode(text, add_special_tokens=False).ids, text
    number = fresh.token_to_id(mark)
    assert np.frombuffer(pieces.encode([f"a {mark} b"])[0], "<u2").tolist().count(number) == 1


LONG = "This is a sentence of the article that goes on for a while. " * 12


def test_names_of_wrappers_and_articles_drop_no_text():
    want = LONG.strip() + "\nShort end."
    body = f"<p>{LONG}</p><p>Short end.</p>"
    for page in (f'<article class="post category-social">{body}</article>', f'<article class="related">{body}</article>',
                 f'<div class="content-sidebar-wrap"><article>{body}</article></div><div class="sidebar">menu</div>',
                 f'<div class="layout has-sidebar"><div>{body}</div></div><div class="site-header">Site name</div>',
                 f'<div class="sidebar"><main>{body}</main></div>', f'<div class="banner"><div>{body}</div></div>'):
        assert mainhtml.main_text(f"<html><body>{page}</body></html>") == want, page
    page = f'<article>{body}</article><section class="comments"><article class="comment"><p>{LONG}</p></article></section>'
    assert mainhtml.main_text(page) == want


def test_short_sections_and_articles_stay():
    long = f"<p>{LONG}</p>" * 6
    page = f"<body><div><p>A short opening.</p></div><section>{long}</section><table><tr><td>42</td></tr></table><section><p>Brief.</p></section></body>"
    assert mainhtml.main_text(page) == "\n".join(["A short opening.", *[LONG.strip()] * 6, "42", "Brief."])
    page = f"<main><article>{long}</article><article><p>Small one.</p></article></main>"
    assert mainhtml.main_text(page).endswith("\nSmall one.")
    page = f"<div><article><p>Teaser of another page.</p></article></div><div><h2>Title</h2>{long}<p>The end.</p></div>"
    assert mainhtml.main_text(page) == "\n".join(["Teaser of another page.", "Title", *[LONG.strip()] * 6, "The end."])


def test_short_and_signed_secrets_are_found(spark):
    rng = random.Random(9)
    signs = "abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!$#%"

    def secret(n):
        return "".join(rng.choice(signs) for _ in range(n - 1)) + "7"
    rows, truth = [], {}
    for i in range(150):
        value = [secret(9), secret(8), f"{secret(7)}.{secret(20)}.{secret(5)}"][i % 3]
        text = f"some ordinary words in a row, password: required and then {['password = ', 'pwd: ', 'api_key='][i % 3]}"
        quote = ['"', "'", ""][i % 3]
        at = len(text) + len(quote)
        rows.append((i, f"{text}{quote}{value}{quote} and more counterrevolutionary text"))
        truth[i] = f"{at}:{at + len(value)}"
    out = {r["doc_id"]: r["spans"].split(",") for r in secretforest.scan(documents(spark, rows)).collect()}
    assert sum(truth[i] in out[i] for i in truth) >= 145


def test_candidates_and_features_are_whole():
    def found(text):
        return [text[a:b] for a, b in secretforest.spans_of(text)]
    assert found("password = \"S3cr3t!pw\", pwd: 'aB3$kd9@' token == x") == ["S3cr3t!pw", "aB3$kd9@"]
    assert found("API_KEY=ab.cd.ef; x: token=9z 0123456789abcdef0") == ["ab.cd.ef", "9z", "0123456789abcdef0"]
    assert found("0123456789abcdef/secret=qq") == ["0123456789abcdef/secret=", "qq"]
    corpus = secretforest.Corpus(np.ones(secretforest.SIGNS ** 3, np.int64))
    plain = "a" * 150_000
    mixed = plain[:70_000] + "Z9" * 5_000 + plain[80_000:]
    a, b = corpus.features(plain, 0, len(plain), ""), corpus.features(mixed, 0, len(mixed), "")
    assert a[2] == 0 and abs(b[2] - 5_000 / 150_000) < 1e-9 and abs(b[7] - 10_001 / 149_999) < 1e-9
