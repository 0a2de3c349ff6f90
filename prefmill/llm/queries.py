"""Registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

import corpus_pipeline
from prefmill.llm import (chatform, decontaminate, langid, mainhtml, mixpack, pii, quality, secretforest, spelling, spotsigs, superminhash,
                          toxicity, wordruns)
from prefmill.llm.base import table, tokenizer_path

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii(spark, folder):
    return pii.scan(table(spark, folder, "documents"))


@query
def op6_superminhash(spark, folder):
    return superminhash.grouped(table(spark, folder, "documents"), 3, 85)


@query
def op4_mixpack(spark, folder):
    return mixpack.packed(table(spark, folder, "documents"), tokenizer_path())


@query
def op3_decontaminate(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_langid(spark, folder):
    return langid.predictions(table(spark, folder, "documents"))


@query
def op5_quality(spark, folder):
    return quality.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_mainhtml(spark, folder):
    return mainhtml.extracted(table(spark, folder, "pages"))


@query
def op10_toxicity(spark, folder):
    return toxicity.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_spotsigs(spark, folder):
    return spotsigs.edited(table(spark, folder, "documents"))


@query
def op7_secrets(spark, folder):
    return secretforest.scan(table(spark, folder, "documents"))


@query
def op11_wordruns(spark, folder):
    return wordruns.digests(table(spark, folder, "documents"))


@query
def op12_spelling(spark, folder):
    return spelling.grouped(spelling.vocabulary(table(spark, folder, "documents")))


@query
def op13_chatform(spark, folder):
    return chatform.digests(chatform.with_probe(table(spark, folder, "conversations")))


ORACLES["op13_chatform"] = chatform.SQL


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
