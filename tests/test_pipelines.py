import json

import pytest

from tessella import plugins
from tessella.operators import store
from tessella.plans.pipelines import answer_batch, answers, build_corpus
from tessella.sources import files

ITEMS = [
    ("d", 0, "h0", "title", 1, "Restart", 0, "body"), ("d", 1, "p0", "text", None, "Restart the server with care. Wait ten seconds.", 0, None), ("d", 2, "f0", "page_footer", None, "page 1", 0, "furniture"),
    ("d", 3, "h1", "section_header", 2, "Alarms", 1, "body"), ("d", 4, "p1", "text", None, "The alarm lamp blinks. " * 12, 1, "body"), ("d", 5, "t1", "table_row", None, "lamp | 3 bar", 2, "body"), ("d", 6, "e", "text", None, "  ", 2, "body"), ("e", 0, "q0", "text", None, "A pump without heading.", 4, "body"),
]
ANSWER = json.dumps({"response_type": "answer", "answerable": True, "answer": " Wait. ", "citation_ids": ["C002", "C001"]})


@pytest.fixture(scope="module")
def corpus(spark):
    documents = spark.createDataFrame([("d", "Guide", "guide.pdf"), ("e", None, "other.pdf")], "doc_id string, title string, source_filename string")
    items = spark.createDataFrame(ITEMS, "doc_id string, ordinal bigint, ref string, label string, level int, text string, page_index int, layer string")
    out = build_corpus(documents, items, 24, plugins.hashing_encoder())
    out["chunks"] = store.dense_ordinals(out["chunks"], "doc_id", "section_id", "piece").persist()
    return out


def test_build(corpus):
    sections = {r["section_id"]: r for r in corpus["sections"].collect()}
    assert sorted(r["path"] for r in sections.values()) == [["Guide"], ["Guide", "Restart"], ["Guide", "Restart", "Alarms"], ["e"]]
    assert all(r["parent_id"] in sections or r["parent_id"] is None for r in sections.values())
    blocks = {r["block_id"]: r for r in corpus["blocks"].collect()}
    assert len(blocks) == 7 and corpus["furniture"].count() == 1
    for c in corpus["chunks"].collect():
        assert c["token_count"] <= 24 and c["text"]
        for s in c["source_spans"]:
            assert blocks[s["block_id"]]["text"][s["source_start_char"]:s["source_end_char"]] == c["text"][s["chunk_start_char"]:s["chunk_end_char"]]
    units = [r["text"] for r in corpus["source_units"].collect()]
    assert "Wait ten seconds." in units and "lamp | 3 bar" in units
    assert corpus["vectors"].filter("vector is null").count() == 0


def body(question, *context, **more):
    return json.dumps({"conversation_id": 1, "context": [{"Q": q, "A": a} for q, a in context], "question": question} | more)


def test_answers(spark, corpus):
    def model(prompt):
        p = json.loads(prompt.split("\n")[0])
        if "broken" in p["question"]:
            return "no json"
        if "weather" in p["question"]:
            return json.dumps({"response_type": "abstain", "answerable": False, "answer": "no idea", "citation_ids": []})
        return ANSWER

    rows = [(1, body("Restart the server with care. Wait ten seconds?")), (2, body("What should I check after that?")), (3, body("What about it?", ("How?", "Restart."))), (4, body("What about nothing?", ("How?", "Restart."))), (5, body("The broken one")), (6, body("How is the weather?")), (7, body("x", extra=1)), (8, body("w " * 600)), (9, body("Which one?", ("How?", "I can't answer this")))]
    requests = spark.createDataFrame(rows, "request_id bigint, body string")
    got = {r["request_id"]: r for r in answer_batch(requests, corpus, plugins.hashing_encoder(), model, lambda q, h: None if "nothing" in q else "alarm lamp").collect()}
    assert {k: (r["status"], r["response_type"]) for k, r in got.items()} == {1: (200, "answer"), 2: (200, "clarify"), 3: (200, "answer"), 4: (200, "clarify"), 5: (502, None), 6: (200, "abstain"), 7: (422, None), 8: (502, None), 9: (200, "clarify")}
    assert got[1]["answer"] == "Wait." and len(got[1]["sources"]) == 2 and got[1]["sources"][0]["document"] == "Guide" and got[1]["sources"][0]["pages"] == [1] and got[6]["answer"] == "I can't answer this"
    assert "Restart the server" in got[1]["sources"][0]["excerpt"] and "alarm lamp" in got[3]["sources"][0]["excerpt"]
    assert got[7]["answer"] == "unknown_field" and got[6]["sources"] == []
    with pytest.raises(ValueError):
        answer_batch(requests, corpus, plugins.hashing_encoder(), model, final_k=21)
    assert {r["status"] for r in answer_batch(requests, None, plugins.hashing_encoder(), model).collect()} == {503, 422} and got[1]["conversation_id"] is not None and got[7]["conversation_id"] is None
    traces = {r["request_id"]: r for r in answers(requests, corpus, plugins.hashing_encoder(), model, lambda q, h: None if "nothing" in q else "alarm lamp")["traces"].collect()}
    assert set(traces) == {1, 2, 3, 4, 6, 9} and traces[3]["rewrite_query"] == "alarm lamp" and traces[3]["rewrite_calls"] == 1 and not traces[4]["rewrite_succeeded"]
    assert traces[1]["answer_calls"] == 1 and [c["rank"] for c in traces[1]["retrieved_chunks"]] == list(range(1, len(traces[1]["retrieved_chunks"]) + 1)) and traces[1]["retrieved_documents"][0] == "Guide"
    assert traces[6]["response_type"] == "abstain" and traces[6]["generated_answer"] == "no idea" and traces[2]["retrieved_chunks"] == [] and traces[6]["missing_information"] == []


def test_build_with_order_tables_figures_and_native_cells(spark):
    documents = spark.createDataFrame([("d", "Guide", "guide.pdf")], "doc_id string, title string, source_filename string")
    box = lambda t: (0.0, t, 100.0, t + 10)
    rows = [
        ("d", 0, "#/body", None, "body", None, None, None, "body", None, None), ("d", 9, "h", "#/body", "title", 1, "Restart", 0, None, None, box(0.0)), ("d", 12, "t", "#/body", "table", None, None, 0, None, None, box(20.0)),
        ("d", 10, "g", "#/body", "group", None, None, None, None, None, None), ("d", 1, "p2", "g", "text", None, "Second line.", 0, None, None, box(50.0)), ("d", 0, "p1", "g", "text", None, "First line.", 0, None, None, box(70.0)),
        ("d", 13, "pic", "#/body", "picture", None, None, 1, None, ["c2", "c1", "none"], box(90.0)), ("d", 14, "c1", "#/body", "caption", None, "Front view.", 1, None, None, box(120.0)), ("d", 15, "c2", "#/body", "caption", None, "Rear view.", 1, None, None, box(140.0)),
        ("d", 1, "lost", "gone", "text", None, "Nobody links this.", 1, None, None, box(160.0)), ("d", 30, "#/furniture", None, "furniture", None, None, None, "furniture", None, None), ("d", 1, "foot", "#/furniture", "text", None, "page 1", 0, None, None, box(300.0)),
    ]
    B = "struct<l:double,t:double,r:double,b:double>"
    items = spark.createDataFrame(rows, f"doc_id string, ordinal bigint, ref string, parent_ref string, label string, level int, text string, page_index int, layer string, caption_refs array<string>, item_box {B}")
    table_cells = spark.createDataFrame([("d", "t", 0, 0, 0, "lamp"), ("d", "t", 1, 0, 1, "red"), ("d", "t", 3, 1, 1, "3 bar"), ("d", "t", 2, 1, 0, "pump"), *[("d", "t", k, k, 0, f"row {k}") for k in range(4, 12)]], "doc_id string, ref string, cell_index int, row int, col int, text string")
    native = spark.createDataFrame([("d", 0, "n1", "pump", 0, box(21.0)), ("d", 0, "n2", "missed by the layout", 0, box(22.0)), ("d", 0, "n3", "page 1", 0, box(300.0)), ("d", 7, "n4", "Alone on its page", 0, box(0.0)), ("d", 0, "n5", "hidden", 3, box(22.0))], f"doc_id string, page_index int, cell_ref string, text string, rendering_mode int, cell_box {B}")
    out = build_corpus(documents, items, 64, table_cells=table_cells, native_cells=native)
    blocks = sorted(out["blocks"].collect(), key=lambda r: r["ordinal"])
    tables = ["lamp | red", "pump | 3 bar", *[f"row {k}" for k in range(4, 12)]]
    assert [r["text"] for r in blocks] == ["Restart", "First line.", "Second line.", *tables, None, "Front view.", "Rear view.", "Nobody links this.", "missed by the layout", "Alone on its page"]
    assert [r["text"] for r in blocks if r["reading_order_unresolved"]] == ["Nobody links this.", "missed by the layout", "Alone on its page"]
    assert {r["kind"] for r in blocks if r["text"] in tables} == {"table_row"} and blocks[-1]["kind"] == "native_pdf_text_recovery"
    section = {r["title"]: r["section_id"] for r in out["sections"].collect()}
    assert blocks[-2]["section_id"] == section["Restart"] and blocks[-1]["section_id"] == section["Guide"]
    (figure,) = out["figures"].collect()
    text = {r["block_id"]: r["text"] for r in blocks}
    assert [text[b] for b in figure["caption_block_ids"]] == ["Rear view.", "Front view."] and text[figure["block_id"]] is None
    passages = "\n".join(r["text"] for r in out["chunks"].orderBy("section_id", "piece").collect())
    assert all(r["text"] in passages for r in blocks if r["text"]) and [r["ref"] for r in out["furniture"].collect()] == ["foot"]
    assert {r["cell_ref"]: r["status"] for r in out["native_cells"].collect()} == {"n1": "matched", "n2": "recovered", "n3": "matched", "n4": "recovered", "n5": "invisible"}


def test_build_refuses_items_without_document_and_cells_without_table(spark):
    documents = spark.createDataFrame([("d", "Guide", "guide.pdf")], "doc_id string, title string, source_filename string")
    schema = "doc_id string, ordinal bigint, ref string, label string, level int, text string, page_index int, layer string"
    with pytest.raises(ValueError, match="item of a document"):
        build_corpus(documents, spark.createDataFrame(ITEMS, schema))
    items = spark.createDataFrame([r for r in ITEMS if r[0] == "d"], schema)
    with pytest.raises(ValueError, match="cell of a table"):
        build_corpus(documents, items, table_cells=spark.createDataFrame([("d", "t9", 0, 0, 0, "x")], "doc_id string, ref string, cell_index int, row int, col int, text string"))


LAYOUT = {
    "pages": {"1": {"size": {"height": 792}}},
    "body": {"self_ref": "#/body", "children": [{"$ref": "#/texts/0"}, {"cref": "#/tables/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/pictures/0"}, {"$ref": "#/texts/99"}]},
    "groups": [{"self_ref": "#/groups/0", "label": "list", "children": [{"$ref": "#/texts/2"}, {"$ref": "#/texts/1"}]}],
    "texts": [
        {"self_ref": "#/texts/0", "label": "section_header", "level": 1, "text": "Restart", "prov": [{"page_no": 1, "bbox": {"l": 10, "t": 700, "r": 90, "b": 680, "coord_origin": "BOTTOMLEFT"}}]},
        {"self_ref": "#/texts/1", "label": "text", "text": "Second line.", "prov": [{"page_no": 2}]},
        {"self_ref": "#/texts/2", "label": "text", "text": "First line."},
        {"self_ref": "#/texts/3", "label": "caption", "text": "Front view."},
        {"self_ref": "#/texts/4", "label": "text", "text": "Nobody links this."},
        {"self_ref": "#/texts/5", "label": "page_footer", "text": "page 1"},
        {"self_ref": "#/texts/4", "label": "text", "text": "Nobody links this, later."},
    ],
    "pictures": [{"self_ref": "#/pictures/0", "label": "picture", "captions": [{"$ref": "#/texts/3"}]}],
    "tables": [{"self_ref": "#/tables/0", "label": "table", "data": {"table_cells": [{"start_row_offset_idx": 0, "start_col_offset_idx": 1, "text": "red"}, {"start_row_offset_idx": 0, "start_col_offset_idx": 0, "text": "lamp"}]}}],
    "furniture": {"self_ref": "#/furniture", "children": [{"$ref": "#/texts/5"}]},
}


def test_layout_to_corpus(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps(LAYOUT))
    documents = spark.createDataFrame([("d", "Guide", "guide.pdf", "l.json")], "doc_id string, title string, source_filename string, file string")
    heights = spark.createDataFrame([("d", 0, 792.0)], "doc_id string, page_index int, height double")
    flat = files.flat_layout(files.layout_items(spark, f"file://{tmp_path}/l.json"), documents, heights)
    assert {r["warning"] for r in flat["warnings"].collect()} == {"unresolved_reference:#/texts/99", "unlinked_item_appended_unknown_reading_order:#/texts/4"}
    boxes = {r["ref"]: r["item_box"] for r in flat["items"].collect()}
    assert tuple(boxes["#/texts/0"]) == (10.0, 92.0, 90.0, 112.0) and boxes["#/texts/1"] is None
    out = build_corpus(documents.drop("file"), flat["items"], 64, table_cells=flat["table_cells"])
    blocks = sorted(out["blocks"].collect(), key=lambda r: r["ordinal"])
    assert [r["text"] for r in blocks] == ["Restart", "lamp | red", "First line.", "Second line.", "", "Front view.", "Nobody links this, later."]
    assert [r["reading_order_unresolved"] for r in blocks] == [False] * 6 + [True] and [r["ref"] for r in out["furniture"].collect()] == ["#/texts/5"]
    (figure,) = out["figures"].collect()
    assert [b["text"] for b in blocks if b["block_id"] in figure["caption_block_ids"]] == ["Front view."]
