import pytest
from pyspark.sql import functions as F

from loomgraph.operators import community, gnn, graph, knn, retrieval

CHUNK = "id string, book_id bigint, chunk_no bigint, text string, summary string, entities array<string>, relations array<struct<Source:string,Relationship:string,Destination:string>>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("1", 1, 0, "t1", "s1", ["Foo-Bar", "foo bar", None], [("X", "r", "Foo-Bar")]),
        ("1", 1, 0, "t1", "s1", ["Foo-Bar", "foo bar", None], [("X", "r", "Foo-Bar")]),
        ("2", 1, 1, "t2", "s2", ["X", "acme"], [("acme", "p", None)]),
        ("3", 1, 2, "", None, [], None),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, CHUNK)


def test_nodes_first_wins_and_ghosts(chunks):
    n = {r.id: (r.type, r.text) for r in graph.nodes_g1(chunks).collect()}
    assert n["N_foo_bar"] == ("N", "Foo-Bar") and n["N_x"] == (None, None) and "T_3" not in n
    p = {r.id: (r.type, r.text) for r in graph.nodes_g1(chunks, "promote").collect()}
    assert p["N_x"] == ("N", "X")


def test_edges_keep_parallels(chunks):
    e = [(r.src, r.dst, r.label) for r in graph.edges_g1(chunks).collect()]
    assert e.count(("S_1", "N_foo_bar", "mentions")) == 2
    assert sum(x[2] == "obj" for x in e) == 1 and sum(x[2] == "subj" for x in e) == 2


def test_incomplete_names_fields_in_order(chunks):
    got = {r.doc_id: r.missing_fields for r in graph.incomplete(graph.unique_chunks(chunks)).collect()}
    assert got == {"3": ["text", "summary", "entities", "relations"]}


def test_g4_uses_the_raw_name(chunks):
    g = {(r.src, r.dst, r.label) for r in graph.g4_edges(chunks, graph.nodes_g1(chunks)).collect()}
    assert ("T_2", "N_acme", "mentions_entity") in g and ("T_1", "S_1", "derived_from") in g
    assert not any(d == "N_X" for _, d, _ in g)


def test_g5_rule(spark):
    edges = spark.createDataFrame([("T1", "T2", "a", None), ("T1", "T2", "b", 3), ("S1", "N", "c", None)], "src string, dst string, label string, weight int")
    near = spark.createDataFrame([("T1", "T2"), ("T2", "T1"), ("S1", "T1"), ("S1", "S2"), ("S1", "S3"), ("T1", "T1")], "src string, dst string")
    comm = spark.createDataFrame([("S1", "x"), ("S2", "x"), ("S3", "y")], "id string, community string")
    got = {(r.src, r.dst, r.label): r.weight for r in graph.g5_edges(edges, near, comm).collect()}
    assert got == {("T1", "T2", "a"): 2, ("T1", "T2", "b"): 4, ("S1", "N", "c"): None, ("T2", "T1", "semantic_hnsw"): 1, ("S1", "S2", "semantic_hnsw"): 1}


def test_components_against_union_find(spark):
    import random

    rnd = random.Random(3)
    ids = [f"n{i:03d}" for i in range(120)]
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(70)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    assert {r.id: r.component for r in community.components(nodes, edges).collect()} == {i: find(i) for i in ids}


def test_empty_graph(spark, chunks):
    none = chunks.limit(0)
    assert graph.nodes_g1(none).count() == 0 and graph.edges_g1(none).count() == 0
    nodes = spark.createDataFrame([], "id string")
    edges = spark.createDataFrame([], "src string, dst string")
    assert community.components(nodes, edges).count() == 0
    assert community.label_propagation(nodes, edges, 1).count() == 0


def test_modularity_of_two_triangles(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    edges = spark.createDataFrame(e, "src string, dst string")
    comm = spark.createDataFrame([(n, "1" if n in "abc" else "2") for n in "abcxyz"], "id string, community string")
    assert community.modularity(edges, comm).first().modularity == round(2 * (3 / 7 - (7 / 14) ** 2), 6)


def test_ppr_loses_mass_and_fills_by_seq(spark):
    edges = spark.createDataFrame([("T1", "S1", None), ("S1", "N1", None), ("S1", "N1", 1)], "src string, dst string, weight int")
    entry = spark.createDataFrame([("q", "T1", 1.0)], "uid string, id string, weight double")
    s = {r.id: r.score for r in retrieval.shallow_ppr(entry, retrieval.transitions(edges)).collect()}
    assert s["T1"] == 0.5 and abs(s["S1"] - 0.25) < 1e-6 and abs(s["N1"] - 0.25) < 1e-6 and sum(s.values()) <= 1 + 1e-9
    nodes = spark.createDataFrame([("T1", "T", "x", 1), ("S1", "S", "y", 2), ("R1", "R", "r", 3), ("R2", "R", "r", 4), ("N1", "N", "n", 5)], "id string, type string, text string, seq int")
    top = {(r.type, r["rank"]): r.id for r in retrieval.top_per_type(retrieval.shallow_ppr(entry, retrieval.transitions(edges)), nodes, 2).collect()}
    assert top == {("T", 1): "T1", ("S", 1): "S1", ("R", 1): "R1", ("R", 2): "R2"}


def test_lexical_hits_equal_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(1)
    words = "a b c d e f g h".split()
    q = [(f"q{i}", " ".join(rnd.sample(words, rnd.randint(1, 6)))) for i in range(20)] + [("q_null", None), ("q_blank", " ")]
    n = [(f"n{i}", rnd.choice("NO"), " ".join(rnd.sample(words, rnd.randint(1, 5)))) for i in range(30)] + [("t", "T", "a b"), ("x", "N", None)]
    got = {(r.uid, r.id) for r in retrieval.lexical_hits(spark.createDataFrame(q, "uid string, question string"), spark.createDataFrame(n, "id string, type string, text string")).collect()}
    exp = set()
    for (u, x), (i, t, y) in itertools.product(q, n):
        if x and x.split() and y and t in "NO":
            a, b = set(x.split()), set(y.split())
            if len(a & b) / len(a | b | {"."}) > 0.3:
                exp.add((u, i))
    assert got == exp


def test_top_k_ties_and_unusable(spark):
    v = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0]), ("m", [float("nan"), 1.0])]
    df = spark.createDataFrame(v, "id string, v array<double>")
    got = [(r.query_id, r.id, r["rank"]) for r in knn.top_k(df, "id", "v", df, "id", "v", 2, 2).orderBy("query_id", "rank").collect()]
    assert got == [("a", "a", 1), ("a", "b", 2), ("b", "a", 1), ("b", "b", 2), ("c", "c", 1), ("c", "a", 2)]


def test_collapse_and_offsets(spark, chunks):
    e = spark.createDataFrame([("a", "b", "x", 1, 1), ("a", "b", "y", None, 2)], "src string, dst string, label string, weight int, seq int")
    assert [(r.label, r.weight) for r in graph.collapse_parallel(e).collect()] == [("y", None)]
    d = spark.createDataFrame([("g", i, "x" * (i % 3)) for i in range(20)], "g string, i bigint, t string")
    got = {r.i: r.start_pos for r in graph.offsets(d, "g", "i", F.length("t"), block=4).collect()}
    assert got == {i: sum(j % 3 for j in range(i)) for i in range(20)}


def test_attention_scores_sum_to_one(spark):
    f = spark.createDataFrame([("u", "a", [1.0, 0.0]), ("u", "b", [0.0, 1.0]), ("v", "a", [1.0, 1.0])], "uid string, id string, x array<double>")
    e = spark.createDataFrame([("u", "a", "b")], "uid string, src string, dst string")
    q = spark.createDataFrame([("u", [1.0]), ("v", [0.5])], "uid string, q array<double>")
    got = gnn.gnn_scores(f, e, q).groupBy("uid").agg(F.round(F.sum("p"), 6).alias("s")).collect()
    assert {r.uid: r.s for r in got} == {"u": 1.0, "v": 1.0}


def test_modularity_communities(spark):
    """Two cliques with one edge between them fall apart where they should; the result never has less modularity than label propagation."""
    ids = [f"n{i:02d}" for i in range(12)]
    pairs = [(ids[a], ids[b]) for h in (0, 6) for a in range(h, h + 6) for b in range(a + 1, h + 6)] + [(ids[0], ids[6])]
    nodes = spark.createDataFrame([(i,) for i in [*ids, "alone"]], "id string")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    c = {r.id: r.community for r in community.communities(nodes, edges).collect()}
    assert len({c[i] for i in ids[:6]}) == len({c[i] for i in ids[6:]}) == 1 and c[ids[0]] != c[ids[6]] and c["alone"] == "alone"
    q = lambda f: community.modularity(edges, f).first().modularity
    assert q(community.communities(nodes, edges)) >= q(community.label_propagation(nodes, edges, 2))
    assert community.communities(nodes, edges, part_edges=0).count() == 13 and community.communities(nodes, edges.limit(0)).count() == 13


def test_components_that_do_not_settle_are_refused(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(30)], "id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(29)], "src string, dst string")
    with pytest.raises(RuntimeError):
        community.components(nodes, edges, rounds=1)


def test_lexical_hits_against_brute_force(spark):
    import random

    rnd = random.Random(6)
    word = lambda: rnd.choice(["a", "b", "c", "d", "e", ".", "f", "g"])
    qs = [(f"q{i}", " ".join(word() for _ in range(rnd.randint(1, 8)))) for i in range(30)]
    ns = [(f"n{i}", "N", " ".join(word() for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    got = {(r.uid, r.id) for r in retrieval.lexical_hits(spark.createDataFrame(qs, "uid string, question string"), spark.createDataFrame(ns, "id string, type string, text string")).collect()}
    want = {(u, i) for u, a in qs for i, _, b in ns if len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()) | {"."}) > 0.3}
    assert got == want


def test_g5_takes_up_semantic_edges(spark):
    none = spark.createDataFrame([], "src string, dst string, label string, weight int")
    near = spark.createDataFrame([("S1", "S2"), ("S2", "S1"), ("S1", "S3")], "src string, dst string")
    comm = spark.createDataFrame([(f"S{i}", "x") for i in (1, 2, 3)], "id string, community string")
    groups = spark.createDataFrame([("g", "S1"), ("g", "S2")], "group_id string, id string")
    got = {(r.src, r.dst): (r.label, r.weight) for r in graph.g5_edges(none, near, comm, groups).collect()}
    assert got == {("S1", "S2"): ("semantically_related", 2), ("S2", "S1"): ("semantic_hnsw", 1), ("S1", "S3"): ("semantic_hnsw", 1)}
