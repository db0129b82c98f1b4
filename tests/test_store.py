import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import plugins
from tessella.operators import store
from tessella.sources import files
from tessella.streaming import requests


def corpus(spark):
    docs = spark.createDataFrame([("d1", "A"), ("d2", "B")], "doc_id string, title string")
    secs = spark.createDataFrame([("s1", "d1", None), ("s2", "d1", "s1"), ("s3", "d2", None)], "section_id string, doc_id string, parent_id string")
    chunks = spark.createDataFrame([(f"c{i}", "d1" if i < 4 else "d2", ("s1", "s2", "s3")[i // 2]) for i in range(6)], "chunk_id string, doc_id string, section_id string")
    vectors = chunks.select("chunk_id", F.array(F.lit(3.0), F.lit(4.0)).alias("vector"))
    return docs, secs, chunks, vectors


def test_bundle_round_trip(spark, tmp_path):
    docs, secs, chunks, vectors = corpus(spark)
    path = f"file://{tmp_path}/bundle"
    parts = {"documents": (docs, ["doc_id"]), "sections": (secs, ["doc_id", "section_id"]), "chunks": (chunks, ["chunk_id"])}
    store.write_bundle(spark, path, parts, vectors, {"corpus_version": "1"})
    opened = store.open_bundle(spark, path)
    assert [r["chunk_id"] for r in store.records(spark, path, "chunks").collect()] == [f"c{i}" for i in range(6)]
    assert [r["ordinal"] for r in opened["chunks"].orderBy("chunk_id").collect()] == list(range(6))
    assert [round(x, 6) for x in opened["vectors"].head()["vector"]] == [0.6, 0.8]
    with pytest.raises(FileExistsError):
        store.write_bundle(spark, path, parts, vectors, {})
    part = next((tmp_path / "bundle" / "documents").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    next((tmp_path / "bundle" / "documents").glob(".part-*.crc")).unlink()
    with pytest.raises(ValueError, match="changed"):
        store.open_bundle(spark, path)


def test_bundle_refusals(spark, tmp_path):
    docs, secs, chunks, vectors = corpus(spark)
    path = f"file://{tmp_path}/b"
    base = {"chunks": (chunks, ["chunk_id"])}
    for records, v in (({"chunks": (chunks.union(chunks), ["chunk_id"])}, vectors), (base, vectors.filter("chunk_id <> 'c0'")), (base, vectors.withColumn("vector", F.array(F.lit(0.0)))), ({"other": (docs, ["doc_id"])} | base, vectors), ({"documents": (docs.withColumn("doc_id", F.lit(None).cast("string")), ["title"])} | base, vectors)):
        with pytest.raises(ValueError):
            store.write_bundle(spark, path, records, v, {})


def test_scopes(spark):
    docs, secs, chunks, _ = corpus(spark)
    got = lambda s: sorted(r["chunk_id"] for r in store.scope_chunks(chunks, secs, docs, s).collect())
    assert got(None) == [f"c{i}" for i in range(6)] and got({"section_ids": ["s1"]}) == ["c0", "c1", "c2", "c3"] and got({"doc_ids": ["d2"]}) == ["c4", "c5"] and got({"doc_ids": ["d1"], "section_ids": ["s2", "s3"]}) == ["c2", "c3"]
    for bad in ({}, {"x": ["d1"]}, {"doc_ids": []}, {"doc_ids": ["zz"]}, {"section_ids": "s1"}, {"doc_ids": ["d2"], "section_ids": ["s1"]}):
        with pytest.raises(ValueError):
            got(bad)


def test_ordinals_and_fingerprint(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(6)
    got = store.dense_ordinals(rows, "k").collect()
    assert all(r["ordinal"] == r["k"] for r in got) and len(got) == 500
    a = store.fingerprint(rows.withColumn("d", F.lit("x")), "k", "d").head()
    assert a == store.fingerprint(rows.orderBy("k").withColumn("d", F.lit("x")), "k", "d").head() and a["records"] == 500
    assert a["fingerprint"] != store.fingerprint(rows.withColumn("d", F.when(F.col("k") == 3, "y").otherwise("x")), "k", "d").head()["fingerprint"]


def test_files(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    for n, c in (("b_two.pdf", b"2"), ("A one.pdf", b"1"), ("c.PDF", b"3"), ("d.txt", b"4")):
        (tmp_path / "pdf" / n).write_bytes(c)
    rows = files.pdf_registry(spark, f"file://{tmp_path}/pdf").collect()
    assert [(r["title"], r["bytes"]) for r in rows] == [("A one", 1), ("b two", 1)] and rows[0]["doc_id"].startswith("doc:6b86b273ff34fce19d6b804e")
    pages = files.pdf_pages(spark, f"file://{tmp_path}/pdf", lambda c: [" " + c.decode() * 100, "x"]).orderBy("source_filename", "page_index").collect()
    assert [(r["page_index"], r["chars"], r["low_text"]) for r in pages[:2]] == [(0, 100, False), (1, 1, True)]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        files.pdf_registry(spark, f"file://{tmp_path}/none")
    (tmp_path / "l.json").write_text(json.dumps({"body": {"self_ref": "#/body", "children": []}, "texts": [{"self_ref": "#/texts/0", "text": "é"}, {"no": 1}], "name": "x"}))
    got = {r["self_ref"]: (r["collection"], json.loads(r["item"]).get("text")) for r in files.layout_items(spark, f"file://{tmp_path}/l.json").collect()}
    assert got == {"#/body": ("body", None), "#/texts/0": ("texts", "é")}
    files.write_jsonl(spark.createDataFrame([(1, "é"), (2, None)], "a int, b string"), f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in files.read_jsonl(spark, f"file://{tmp_path}/out", "a int, b string").collect()) == [(1, "é"), (2, None)]


def test_configuration(tmp_path):
    (tmp_path / "a.toml").write_text('[llm]\napi_key_env = "X"\n')
    assert files.load_config(str(tmp_path / "a.toml"))["chunking"]["max_tokens"] == 384
    for text in ('[llm]\napi_key = "x"\n', "[chunking]\nmax_tokens = 513\n"):
        (tmp_path / "b.toml").write_text(text)
        with pytest.raises(ValueError):
            files.load_config(str(tmp_path / "b.toml"))
    assert files.settings({})["rewrite_mode"] == "conditional"
    with pytest.raises(ValueError):
        files.settings({"TESSELLA_REWRITE_MODE": "always"})


def test_plugins(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "passage: a b"), (3, None), (4, "w " * 600)], "i int, t string")
    got = {r["i"]: r for r in plugins.encode(df, "t", plugins.hashing_encoder(8)).collect()}
    assert got[1]["vector"] == got[2]["vector"] and got[3]["vector_fault"] == "null" and got[4]["vector_fault"] == "too_long" and got[4]["vector"] is None
    assert abs(np.linalg.norm(got[1]["vector"]) - 1) < 1e-6
    good = '{"response_type":"answer","answerable":true,"answer":"x","citation_ids":["C001"]}'
    asked = spark.createDataFrame([("first ok",), ("repair",), ("never",)], "p string").withColumn("ids", F.array(F.lit("C001")))
    model = lambda p: good if "ok" in p or "repair" in p and "not usable" in p else "no json"
    out = {r["p"]: r["reply_faults"] for r in plugins.generate(asked, "p", "ids", model).collect()}
    assert out["first ok"] == [] and out["repair"] == [] and "not_an_object" in out["never"]


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"conversation_id": 1, "context": [], "question": "a"}\nbroken\n')
    answer = lambda d: d.withColumn("status", F.lit(200)).withColumn("response", F.lit("x"))
    requests.serve(requests.request_stream(spark, f"file://{tmp_path}/in"), answer, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(60)
    assert sorted((r["status"], r["response"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(200, "x"), (422, "not_an_object")]
