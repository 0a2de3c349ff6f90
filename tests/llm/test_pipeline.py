import zlib

import corpus_pipeline
import numpy as np
from helpers import documents

from prefmill import session
from prefmill.llm import decontaminate, queries
from prefmill.llm.base import table, tokenizer_path
from prefmill.llm.tokenizing import Pieces


def write(spark, folder, rows):
    docs = documents(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 1) for i in range(40)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "which colour does the evening sky of an early autumn day show us. It is red")],
                          "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_and_run(spark, tmp_path):
    rows = [(i, f"you awful zorgle person number{i}" if i % 2 else f"nice day{i} for walking{i} in park{i}") for i in range(40)]
    long = " ".join(f"w{i}" for i in range(60))
    rows += [(100, long), (101, long), (102, long.replace("w30", "x")), (103, None), (104, ""),
             (105, "so which colour does the evening sky of an early autumn day show us. It is red they say"),
             (106, "mail joe@ex.org or 10.0.0.1 today please dear friend")]
    docs = write(spark, str(tmp_path), rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.collect()}
        assert {103, 104, 106, 100} <= ids
        if k >= 0:
            assert sum(i in ids for i in range(0, 40, 2)) == 20 and sum(i in ids for i in range(1, 40, 2)) <= 2
        if k >= 1:
            assert not {101, 102} & ids
        if k >= 2:
            assert 105 not in ids
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert text[106] == "mail [EMAIL] or [IP] today please dear friend" and text[100] == long
    plain = Pieces(tokenizer_path()).tokenizer
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(text)
    for r in out:
        ids = np.array(plain.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [1], "<u4")
        assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in out if r["start"] == 0)


def test_empty_documents(spark, tmp_path):
    docs = documents(spark, [(1, "x")]).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_given_table_keeps_clean_documents(spark, folder):
    docs, bench = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    leaked = {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()}
    assert not out & leaked and out
    clean = [d for d, t in labels.items() if not t and d not in leaked]
    assert sum(d in out for d in clean) > 0.7 * len(clean)


def test_stages_hand_documents_to_python_in_small_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = write(spark, str(tmp_path), [(i, f"word{i} and another") for i in range(10)])
    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES:
            for given, then in (("10000", "2000"), ("77", "77")):  # a number of the caller's stays
                spark.conf.set(name, given)
                stage(spark, docs, str(tmp_path))
                assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)


def test_scratch_tables_cost_one_file_for_each_partition(spark, tmp_path, monkeypatch):
    """On a local file system processes are started for each file; scratch needs no checksums and no mark of success."""
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = [(i, f"text {i}") for i in range(100)]
    back = session.settled(documents(spark, rows).repartition(3), "own")
    names = sorted(p.name for p in (tmp_path / "own").iterdir())
    assert len(names) == 3 and all(n.startswith("part-") and n.endswith(".parquet") for n in names)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows


def test_numbered_texts_of_many_partitions_are_gathered(spark, tmp_path, monkeypatch):
    docs = write(spark, str(tmp_path), [(i, f"word{i} and another") for i in range(200)])
    files, settled = [], decontaminate.settled
    monkeypatch.setattr(decontaminate, "settled", lambda df: files.append(df.rdd.getNumPartitions()) or settled(df))
    found = decontaminate.leaks(docs.repartition(90), table(spark, str(tmp_path), "benchmark"))
    assert files == [4 * spark.sparkContext.defaultParallelism] and found.count() == 0


def test_every_operator_is_registered():
    assert sorted(q for q in queries.QUERIES if q.startswith("op")) == sorted(
        ["op1_pii", "op2_spotsigs", "op3_decontaminate", "op4_mixpack", "op5_quality", "op6_superminhash", "op7_secrets", "op8_langid",
         "op9_mainhtml", "op10_toxicity", "op11_wordruns", "op12_spelling", "op13_chatform"])
    assert "pipeline" in queries.QUERIES
