import json

from loomgraph.operators import nested

N, E = [{"id": "a", "type": "T"}, {"id": "b"}], [{"source": "a", "target": "b", "label": "l"}, {"source": "a", "target": "zz"}]
WANT = {("node", "a"), ("node", "b"), ("edge", "a>b>l"), ("edge", "a>zz>")}


def children(v):
    return {(r[0], r[3]) for r in nested.walk(nested.read_json(v))}


def test_shapes_give_the_same_children():
    g = {"nodes": N, "edges": E}
    shapes = [
        g, {"G_raw": g}, {"result": {"deep": [g]}}, {"directed": True, "nodes": N, "links": E},
        {"nodes": {"a": {"type": "T", "text": "x"}, "b": {"text": "y"}}, "edges": E},
        {"nodes": [{"group": "T", "nodes": [N[0]]}, {"group": "", "nodes": [N[1]]}], "edges": E},
        {"nodes": [{"id": "a", "data": {"type": "T"}}, {"id": "b", "data": {}}], "edges": E},
        {"nodes": N, "edges": {"l": [{"source": "a", "target": "b"}], "": [{"source": "a", "target": "zz"}]}},
        {"nodes": N, "edges": [{"source": {"id": "a"}, "target": {"id": "b"}, "label": "l"}, {"source": {"id": "a"}, "target": {"id": "zz"}, "label": None}]},
    ]
    for s in shapes:
        assert children(json.dumps(s)) == WANT, s
    assert children(json.dumps(json.dumps(g))) == WANT
    assert children(json.dumps({"nodes": N[0], "edges": E[0]})) == {("node", "a"), ("edge", "a>b>l")}


def test_unreadable_and_odd():
    for v in (None, "", "  ", "null", "{", json.dumps({"nodes": N})[:-3], "[1, 2]", "7", json.dumps({"nodes": [{"text": "no id"}, None, 3]})):
        assert children(v) == set()


def test_maps_of_lists_and_missing_attributes():
    assert children(json.dumps({"nodes": {"T": [N[0]], "": [N[1]]}, "edges": E})) == WANT
    assert children(json.dumps({"nodes": {"a": {"type": "T"}, "b": None}, "edges": E})) == WANT
    groups = {r[3]: r[8] for r in nested.walk({"nodes": {"T": [N[0]], "": [N[1]]}})}
    assert groups == {"a": "T", "b": ""}
    g = json.dumps({"nodes": N, "edges": E})
    for _ in range(10):
        g = json.dumps(g)
    assert children(g) == WANT


def test_states_choose_the_rows(monkeypatch):
    g = {"nodes": [{"id": "a"}, {"id": "b", "data": {"type": "S"}}], "edges": [{"source": "a", "target": {"id": "b"}}, {"source": None, "target": "b"}]}
    got = nested.states(g)
    assert [got[id(x)] for x in (g, g["nodes"], *g["nodes"], *g["edges"])] == ["graph", "list", "node", "wrapped", "joined", "loose"]
    monkeypatch.setattr(nested, "object_state", lambda fields: "object")
    assert children(json.dumps(g)) == set()


def test_tables(spark):
    ev = spark.createDataFrame([("1", json.dumps({"nodes": N, "edges": E}), "x"), ("1", json.dumps({"nodes": N, "edges": E}), "y"), ("2", None, None), (None, "{}", None)], "id string, g_raw string, path string")
    p = "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
    mu = spark.createDataFrame([("m", [(0, "t", "x", None), None, (1, None, "  ", None)], ["a", None, "", "a"]), ("m", [(0, "t", "x", None), None, (1, None, "  ", None)], ["a", None, "", "a"]), ("e", None, None)], f"id string, paragraphs {p}, answer_aliases array<string>")
    got = {tuple(r) for r in nested.found(mu, ev).collect()}
    assert got == {("1", *w) for w in WANT} | {("m", "paragraph", "0"), ("m", "alias", "0"), ("m", "alias", "3")}
    kids = nested.graph_children(ev)
    assert nested.node_table(kids).count() == 2 and nested.edge_table(kids).count() == 2
    assert nested.found(mu.limit(0), ev.limit(0)).count() == 0


def test_tables_hold_all_fields(spark):
    g = {"nodes": [{"group": "T", "nodes": [{"id": "a", "type": "T", "text": "x", "community": 3, "extra": [1]}]}, {"id": "b", "data": {"type": "S", "community": "c"}}],
         "edges": [{"source": "a", "target": "b", "label": "l", "weight": 2, "since": None}]}
    kids = nested.graph_children(spark.createDataFrame([("1", json.dumps(g))], "id string, g_raw string"))
    nodes = {r.child_key: r for r in nested.node_table(kids).collect()}
    assert (nodes["a"].community, nodes["a"].node_group, json.loads(nodes["a"].rest)) == ("3", "T", {"community": 3, "extra": [1]})
    assert (nodes["b"].community, nodes["b"].node_group, json.loads(nodes["b"].rest)) == ("c", None, {"data": {"type": "S", "community": "c"}})
    e = nested.edge_table(kids).first()
    assert e.weight == 2.0 and json.loads(e.rest) == {"since": None}
    p = "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
    mu = spark.createDataFrame([("m", [(4, "t", "x", True), None], ["a", " ", "b"])] * 2, f"id string, paragraphs {p}, answer_aliases array<string>")
    assert [tuple(r) for r in nested.paragraph_table(mu).collect()] == [("m", "0", "whole", 4, "t", "x", True)]
    assert {tuple(r) for r in nested.alias_table(mu).collect()} == {("m", "0", "a"), ("m", "2", "b")}
