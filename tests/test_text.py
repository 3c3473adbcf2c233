from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.registry import register


def test_chunk_fold_matches_list_and_orders(spark):
    sents = ["a1 a2 a3.", "b1 b2.", "c1 c2 c3.", "d1 d2 d3 d4 d5 d6 d7 d8 d9."]
    for order in ("natural", "reference"):
        df = spark.createDataFrame([(sents,)], "s array<string>")
        got = df.select(T.chunk_fold(F.col("s"), 8, 4, order).alias("c")).first().c
        assert [(r.n_words, r.text) for r in got] == T.chunk_list(sents, 8, 4, order)
    assert T.chunk_list(sents, 8, 4)[1][1].startswith("b1 b2. c1 c2 c3.")
    assert T.chunk_list(sents, 8, 4, "reference")[1][1].startswith("b2. b1 c3. c2 c1 d1")
    assert T.chunk_list([], 8, 4) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=30), st.integers(1, 20), st.integers(0, 8))
def test_chunks_cover_all_words(sizes, size, overlap):
    sents = [" ".join(f"w{i}_{j}" for j in range(n)) for i, n in enumerate(sizes)]
    seen = {w for _, t in T.chunk_list(sents, size, overlap) for w in t.split()}
    assert seen == {w for s in sents for w in s.split()}


def test_parsers(spark):
    rows = [('"Acme" {"entities": ["B2", "Foo Bar"]}', "{'Source': 'A b', 'Relationship': 'r', 'Destination': 'C'}"), (None, "{'a','b'}"), ("", "{'Source': 'A, b', 'Relationship': 'r', 'Destination': 'C'}")]
    df = spark.createDataFrame(rows, "e string, r string")
    got = df.select(T.parse_entities(F.col("e")).alias("e"), T.parse_relations(F.col("r")).alias("r")).collect()
    assert got[0].e == ["Acme", "entities", "Foo Bar"]
    assert [tuple(x) for x in got[0].r] == [("A b", "r", "C")]
    assert got[1].e is None and got[1].r is None and got[2].r is None


def test_answer_metrics(spark):
    df = spark.createDataFrame([("The cat sat, sat.", "a cat sat"), ("the", "an"), ("dog", "cat"), ("", "")], "p string, g string")
    got = df.select(T.answer_f1(F.col("p"), F.col("g")).alias("f"), T.normalize_answer(F.col("p")).alias("n")).collect()
    assert got[0].n == "cat sat sat"
    assert abs(got[0].f.precision - 2 / 3) < 1e-9 and got[0].f.recall == 1.0
    assert got[1].f.f1 == got[2].f.f1 == got[3].f.f1 == 0.0


def test_jaccard_counts_the_dot(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "c"]), (["."], ["."])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(T.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.75, 1.0]


def test_hit_count(spark):
    df = spark.createDataFrame([("aXaxa", "A"), ("abc", ""), (None, "a"), ("aaa", "aa")], "h string, n string")
    assert [r.c for r in df.select(T.hit_count(F.col("h"), F.col("n")).alias("c")).collect()] == [3, 4, 0, 1]


def test_registry(spark):
    register(spark)
    r = spark.sql("SELECT graph_normalize('Foo-Bar baz') a, answer_exact('The cat!', 'cat') b, round(vector_cosine(array(1D, 0D), array(1D, 1D)), 3) c, token_jaccard(word_tokens('a b'), word_tokens('b')) d").first()
    assert (r.a, r.b, r.c) == ("foo_bar_baz", 1, 0.707) and abs(r.d - 1 / 3) < 1e-9
