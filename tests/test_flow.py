import json

import pytest

from loomgraph.operators import documents, evaluation
from loomgraph.plans.skew import skew_join
from loomgraph.sources import io
from loomgraph.streaming import ingest


def test_text_metrics_by_hand():
    a, b = "the cat sat".split(), "the cat sat on".split()
    assert evaluation.rouge_l(a, b) == pytest.approx(2 * 3 / 7)
    assert evaluation.bleu(b, b, (0.25,) * 4) == pytest.approx(1.0)
    assert evaluation.bleu(["x"], b, (1.0,)) == 0.0 and evaluation.bleu([], b, (1.0,)) == 0.0
    assert evaluation.meteor(b, b) == pytest.approx(1 - 0.5 / 64)
    assert evaluation.rouge_l([], b) == evaluation.meteor([], b) == 0.0


def test_best_and_summary(spark):
    d = spark.createDataFrame([("1", "Paris", [["paris", "London"]]), ("1", "Paris", [["paris", "London"]]), ("2", None, [["x"]]), ("3", "x", None)], "id string, answer string, answers array<array<string>>")
    best = evaluation.best(evaluation.score(evaluation.predictions(d))).collect()
    assert [(r.uid, r.f1, r.exact_match) for r in best] == [("1", 1.0, 1)]
    assert evaluation.text_scores(evaluation.predictions(d)).count() == 2


def test_questions(spark):
    q = spark.createDataFrame([("1", "q", " a ", ["a", None, "b "], None, [(0, None, " x ", None), None, (1, None, "", None)]), ("2", "q", "a", None, False, None)], io.QA_SCHEMA)
    r = evaluation.load_questions(q).collect()
    assert [(x.id, x.answers, x.context) for x in r] == [("1", ["a", "b"], "x")]


def test_io(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "", "doc_id": "7", "text": "t"}) + "\n")
    assert io.read_chunks(spark, str(tmp_path / "c.jsonl")).first().id == "7"
    (tmp_path / "m.json").write_text(json.dumps({"3": {"summary_texts": ["s"], "title": "t"}}))
    assert io.read_community_map(spark, str(tmp_path / "m.json")).first().title == "t"
    (tmp_path / "a.PDF").write_bytes(b"one|two")
    (tmp_path / "x.txt").write_bytes(b"no")
    pages = io.read_pdf(spark, str(tmp_path), lambda data: data.decode().split("|")).orderBy("page_no").collect()
    assert [p.text for p in pages] == ["one", "two"]
    with pytest.raises(ValueError):
        io.read_pdf(spark, str(tmp_path / "x.txt"))
    old = spark.createDataFrame([("1", "a")], "id string, v string")
    assert {r.v for r in io.insert_absent(old, spark.createDataFrame([("1", "b"), ("2", "c")], "id string, v string")).collect()} == {"a", "c"}
    assert not io.write_if_any(old.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    n = spark.createDataFrame([("a", "T", "x"), ("g", None, None)], "id string, type string, text string")
    io.write_graph(n, spark.createDataFrame([("a", "g", "l")], "src string, dst string, label string"), str(tmp_path / "g"))
    nodes, edges = io.read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 2 and edges.count() == 1


def test_stream_and_retry(spark, tmp_path):
    d = spark.createDataFrame([(1, "Alice met Bob Stone in Paris. She left."), (2, None), (3, "")], "doc_id bigint, text string")
    d.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), "doc_id BIGINT, text STRING", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/chunks")).collect()
    nodes, edges = ingest.merged_graph(spark, str(tmp_path / "out"))
    assert {r.type for r in nodes.collect()} >= {"T", "S", "N"} and edges.where("label = 'derived_from'").count() == 1
    assert [(r.doc_id, r.n_words) for r in got] == [(1, 8)] and "Bob Stone" in got[0].entities
    todo = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    done, left = ingest.retry(todo, lambda x: x.where("doc_id = 'a'"))
    assert [r.doc_id for r in left.collect()] == ["b"] and done.count() == 1


def test_skew_join_hot_and_cold(spark):
    left = spark.range(50_000).selectExpr("case when id < 30000 then 0 else id end as k", "id")
    right = spark.range(50_000).selectExpr("id as k", "id * 2 as v").where("k % 2 = 0")
    sizes = left.groupBy("k").count().withColumnRenamed("count", "n")
    assert skew_join(left, right, ["k"], sizes).count() == left.join(right, "k").count()
    assert skew_join(left, right, ["k"], sizes, "left").count() == 50_000
    assert skew_join(left, right, ["k"], sizes, "left").agg({"v": "sum"}).first()[0] == left.join(right, "k", "left").agg({"v": "sum"}).first()[0]
    gone = skew_join(left, right.where("k <> 0"), ["k"], sizes)
    assert gone.count() == left.join(right.where("k <> 0"), "k").count() and gone.columns == ["k", "id", "v"]
    none = spark.createDataFrame([(None, 1), (2, 2), (3, 3)], "k bigint, id int")
    n = none.groupBy("k").count().withColumnRenamed("count", "n")
    assert sorted((r.id, r.v) for r in skew_join(none, right, ["k"], n, "left").collect() if r.v is not None) == [(2, 4)]
    assert skew_join(none, right, ["k"], n, "left").count() == 3 and skew_join(none, right, ["k"], n).count() == 1


def test_pending_and_progress(spark):
    c = spark.createDataFrame([("1", "s", ["e"], []), ("2", "", None, None)], "id string, summary string, entities array<string>, relations array<string>")
    assert {(r.task, r.processed, r.unprocessed) for r in documents.progress(c).collect()} == {("summary", 1, 1), ("entity", 1, 1), ("relationship", 0, 2)}


def test_oracles_are_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_model_calls_fail_to_null_and_are_repeated(spark):
    seen = []

    def sometimes(x):
        seen.append(x)
        if len(seen) < 3:
            raise OSError
        return x

    assert documents.call(sometimes, "a") == "a" and len(seen) == 3 and documents.call(lambda: 1 / 0) is None

    class Broken(documents.OfflineModel):
        def summary(self, text):
            raise OSError

    r = documents.enrich(spark.createDataFrame([("1", "A Bo met Cy Dee.")], "id string, text string"), Broken).first()
    assert r.summary is None and r.entities
    e = documents.entity_attributes(spark.createDataFrame([("1", "Bo Li left. He saw Cy. Cy stayed.", ["Cy", " ", None, "Cy"]), ("2", None, ["x"])], "id string, text string, entities array<string>")).collect()
    assert [tuple(x) for x in e] == [("1", "Cy", "He saw Cy. Cy stayed.")]


def test_readers_and_progress(spark, tmp_path, monkeypatch):
    g = {"nodes": [{"id": "a", "type": "T"}, {"id": "b", "community": 3}], "edges": [{"source": "a", "target": "b", "label": "x"}, {"source": "a", "target": "b", "label": "y", "weight": 2}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    nodes, edges = io.read_graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and [(r.label, r.weight) for r in edges.collect()] == [("y", 2)]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        io.read_graph_json(spark, str(tmp_path / "bad.json"))
    (tmp_path / "d.json").write_text(json.dumps({"u": {"query": "q", "answers": [["x"]], "G_raw": g, "answer": None}, "w": {"id": "w2"}}))
    d = {r.id: r for r in io.read_eval_dump(spark, str(tmp_path / "d.json")).collect()}
    assert set(d) == {"u", "w2"} and json.loads(d["u"].g_raw) == g and d["u"].answers == [["x"]]
    left = spark.createDataFrame([("7",)], "doc_id string")
    assert io.load_progress(spark, str(tmp_path / "p"), "entity")[0] == 0
    io.save_progress(spark, str(tmp_path / "p"), "entity", 5, left)
    n, rows = io.load_progress(spark, str(tmp_path / "p"), "entity")
    assert n == 5 and [r.doc_id for r in rows.collect()] == ["7"]
    io.delete_progress(spark, str(tmp_path / "p"), "entity")
    assert io.load_progress(spark, str(tmp_path / "p"), "entity")[0] == 0
    monkeypatch.setenv("LOOMGRAPH_DEPTH", "3")
    assert io.settings(spark, depth="1", other="o") == {"depth": "3", "other": "o"}
    pages = spark.createDataFrame([("f", 1, "b"), ("f", 0, "a"), ("f", 2, None)], "path string, page_no bigint, text string")
    assert io.join_pages(pages).first().text == "ab"
    ctx = spark.createDataFrame([("c", "summary", "s2", 2), ("c", "summary", "s1", 1), ("c", "relation", "r", 0)], "community string, kind string, text string, seq int")
    io.write_community_map(ctx, spark.createDataFrame([("c", "h", "t")], "community string, hl_summary string, title string"), str(tmp_path / "cm"))
    r = spark.read.json(str(tmp_path / "cm")).first()
    assert r.summary_texts == ["s1", "s2"] and r.relation_texts == ["r"] and r.title == "t"


def test_store_builds_once_and_pipeline_answers(spark):
    from loomgraph.operators import evaluation as ev
    from loomgraph.plans import pipeline
    from loomgraph.plans.runtime import stored

    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert stored(spark, "x", "k1", build).count() == stored(spark, "x", "k1", build).count() == 3 and len(calls) == 1
    rows = [(str(i), 1, i, f"Ann Bo of unit {i} treats fever with drug{i}.", f"Ann Bo treats with drug{i}.", ["Ann Bo", f"Drug{i}"], [("Ann Bo", "treats with", f"Drug{i}")]) for i in range(4)]
    chunks = spark.createDataFrame(rows, "id string, book_id bigint, chunk_no bigint, text string, summary string, entities array<string>, relations array<struct<Source:string,Relationship:string,Destination:string>>")
    near = spark.createDataFrame([("T_0", "T_1"), ("S_0", "S_1")], "src string, dst string")
    g = pipeline.build(spark, chunks, "test", near)
    assert {"T", "S", "N", "R", "H", "O"} <= {r.type for r in g.nodes.select("type").distinct().collect()}
    assert {"semantic_hnsw", "summarizes", "overview_of"} <= {r.label for r in g.edges.select("label").distinct().collect()}
    q = spark.createDataFrame([("q1", "What does unit 2 treat fever with?", ["drug2"])], "id string, question string, answers array<string>")
    dump, total = pipeline.evaluate(g, q)
    r = dump.first()
    assert r.prompt and r.reasoning_chain and r.answer and total.first().questions == 1 and total.first().avg_tokens > 0
    assert set(ev.TEXT_METRICS) <= set(total.columns)
