"""Vectors, copies, packing, mixing: brute force, exactness and edge rows."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import boost, foldcopies, mixing, packing, vectors


def brute(rows, k=5, least=0.85):
    ok = [(i, np.array(v, float)) for i, v in sorted({i: v for i, v in rows}.items()) if v is not None and len(v) == 64 and not any(x is None or x != x for x in v) and any(v)]
    ids = np.array([i for i, _ in ok])
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:k] if s[a, b] >= least}


def test_nearest_recall_copies_and_unusable(spark):
    r = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(60):
        c = r.normal(size=64)
        for _ in range(12):
            n += 1
            rows.append((n, ((c + 0.25 * r.normal(size=64)) * r.uniform(0.1, 9)).tolist()))
    same = r.normal(size=64).tolist()
    rows += [(1000 + i, same) for i in range(40)] + [(2000 + i, (2 * np.array(rows[0][1])).tolist()) for i in range(3)]
    rows += [(3000, None), (3001, [0.0] * 64), (3002, [1.0] * 48), (3003, [float("nan")] * 64), (3004, [None] * 64), rows[5]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("code", F.lit("clash"))
    got = {tuple(x) for x in vectors.nearest(df).collect()}
    want = brute([(i, None if v is None else np.array(v, np.float32).tolist() if None not in v else v) for i, v in rows])
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert {p for p in want if p[0] >= 1000 and p[1] < 2000} <= got
    assert vectors.nearest(df.limit(0)).count() == 0 and vectors.nearest(df.where("vec_id = 1")).count() == 0


def test_hot_bucket_blocks_lose_nothing(spark, monkeypatch):
    """Split into pairs of blocks, a bucket gives the same pairs as whole, and here they are all."""
    r = np.random.default_rng(1)
    c = r.normal(size=64)
    rows = [(i, (c + 0.1 * r.normal(size=64)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = {tuple(x) for x in vectors.nearest(df).collect()}
    sample = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    ix = vectors.Index(vectors.fit(sample, 300).rotations, 0, 1, 0, 64, 1.0)
    monkeypatch.setattr(vectors, "fit", lambda *a, **k: ix)
    monkeypatch.setattr(vectors, "BLOCK", 37)
    split = {tuple(x) for x in vectors.nearest(df).collect()}
    want = brute([(i, np.array(v, np.float32).tolist()) for i, v in rows])
    assert whole == split and len(split ^ want) <= 0.01 * len(want)  # fixed point can swap equals


def test_several_tables_and_probes_give_each_pair_once(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(np.repeat(r.normal(size=(40, 64)), 9, axis=0) + 0.3 * r.normal(size=(360, 64)))]
    sample = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    monkeypatch.setattr(vectors, "COPY_COST", 0.0)
    monkeypatch.setattr(vectors, "BLOCK", 60)
    ix = vectors.fit(sample, 100_000)
    assert ix.bits > 1 and ix.tables > 1
    monkeypatch.setattr(vectors, "fit", lambda *a, **k: ix)
    got = [tuple(x) for x in vectors.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()]
    want = brute([(i, np.array(v, np.float32).tolist()) for i, v in rows])
    assert len(got) == len(set(got)) and len(want & set(got)) >= 0.97 * len(want)


@pytest.mark.parametrize("rows", [20_000, 1_000_000, 60_000_000])
def test_pairs_meet_at_every_size(rows):
    """Pairs that the choice of the index did not see, at the least similarity, share a bucket and lie within the radius."""
    r = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    ix = vectors.fit(unit(r.normal(size=(6000, 64))), rows)
    x, z = unit(r.normal(size=(3000, 64))), r.normal(size=(3000, 64))
    y = 0.85 * x + np.sqrt(1 - 0.85**2) * unit(z - (x * z).sum(1, keepdims=True) * x)
    met = np.array([bool(np.intersect1d(a, b).size) for a, b in zip(vectors.bucket_keys(x, ix), vectors.bucket_keys(y, ix))])
    within = np.bitwise_count(vectors._codes(x, ix) ^ vectors._codes(y, ix)) <= ix.radius
    assert (met & within).mean() >= 0.93


def test_an_index_that_cannot_reach_the_target_is_refused(monkeypatch):
    monkeypatch.setattr(vectors, "TABLES", 1)
    monkeypatch.setattr(vectors, "FLIPS", 0)
    x = np.random.default_rng(0).normal(size=(500, 64))
    with pytest.raises(ValueError):
        vectors.fit(x / np.linalg.norm(x, axis=1, keepdims=True), 10**9, min_sim=0.3)


def test_fold_hash_and_compare():
    same = [("Foo-Bar", " foo  BAR."), ("Straße", "STRASSE"), ("café", "Café"), ("ＡＢ１", "ａｂ１"), ("", " .,")]
    for a, b in same:
        h1, h2, _ = foldcopies.hash_strings([a, b])
        assert h1[0] == h1[1] and h2[0] == h2[1] and foldcopies.equal(a, b)
    for a, b in (("cafe", "café"), ("ab", "ba"), ("a1", "a"), ("x", "")):
        h1, _, _ = foldcopies.hash_strings([a, b])
        assert h1[0] != h1[1] and not foldcopies.equal(a, b)
    assert len(foldcopies.hash_strings([])[0]) == 0 and foldcopies.hash_strings([None, "!"])[2].tolist() == [0, 0]


def test_parse_raw_layouts():
    want = ("A b", "r s", "C")
    for raw in ('{"Source": "A b", "Destination": "C", "Relationship": "r s"}', "SOURCE = A b\nDESTINATION = C\nRELATIONSHIP = r s", "{Destination: C; Relationship: r s; Source: A b}", '{"triple": {"source": "A b", "relationship": "r s", "destination": "C"}}', "{'Relationship': 'r s', 'Source': 'A b', 'Destination': 'C'}"):
        assert foldcopies.parse_triple(raw) == want
    assert foldcopies.parse_triple(None) == foldcopies.parse_triple("nothing here") == (None, None, None)


def test_copies_against_brute_force(spark):
    rnd = random.Random(5)
    names = ["Foo Bar", "foo-bar", "FOO  BAR.", "baz", "Baz!", "q x"]
    rows = [(i, rnd.choice(names), rnd.choice(["r", "R."]), rnd.choice(names), None) for i in range(300)]
    rows += [(1000, None, None, None, '{"Source": "foo bar", "Relationship": "r", "Destination": "BAZ"}'), (1001, " ", "r", "x", None), (1002, None, "r", "x", None), rows[0]]
    df = spark.createDataFrame(rows, "rel_id bigint, source string, relationship string, destination string, raw string").withColumn("h1", F.lit("clash"))
    can = lambda s: "".join(c for c in s.casefold() if c.isalnum())
    groups = defaultdict(set)
    for i, s, p, d, raw in rows:
        if raw:
            s, p, d = foldcopies.parse_triple(raw)
        if s and p and d and can(s) and can(p) and can(d):
            groups[can(s), can(p), can(d)].add(i)
    want = {(str(i), str(min(g))) for g in groups.values() if len(g) > 1 for i in g}
    hashed = foldcopies.hash_triples(df, "rel_id", ["source", "relationship", "destination"], "raw")
    assert {tuple(r) for r in foldcopies.group_copies(hashed, True).collect()} == want
    lists = spark.createDataFrame([("b", ["X", "y "]), ("a", ["Y", "x", "x"]), ("c", ["x"]), ("d", [None, " "]), ("e", None), (None, ["x"]), ("a", ["Y", "x", "x"])], "id string, entities array<string>")
    got = foldcopies.group_copies(foldcopies.hash_lists(lists, "id", "entities"), False)
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("b", "a")}
    assert [tuple(r) for r in foldcopies.collapse(got).collect()] == [("a", 2)]
    assert foldcopies.group_copies(foldcopies.hash_lists(lists.limit(0), "id", "entities"), False).count() == 0


def test_colliding_hashes_are_told_apart(spark):
    rows = [("a", 1, 1, ["Foo"]), ("b", 1, 1, ["foo."]), ("c", 1, 1, ["Straße"]), ("d", 1, 1, ["STRASSE!"]), ("e", 1, 1, ["x"]), ("f", 2, 2, ["y"])]
    df = spark.createDataFrame(rows, "rec_id string, h1 bigint, h2 bigint, parts array<string>")
    assert {tuple(r) for r in foldcopies.group_copies(df, False).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    one = spark.createDataFrame([("a", 1, 1, ["Foo"]), ("b", 1, 1, ["bar"])], df.schema)
    assert foldcopies.group_copies(one, False).count() == 0


def test_bin_completion():
    rnd = random.Random(9)
    for _ in range(40):
        cap = rnd.randint(20, 200)
        sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 60))]
        bins = packing.complete(sizes, cap, 100_000)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, cap))
    assert len(packing.complete([6, 6, 5, 5, 5, 3, 3, 3, 2, 2, 2, 2, 2, 2, 2], 10)) == 5


def test_bin_completion_is_exact_on_small_groups_and_beats_best_fit():
    rnd = random.Random(4)

    def fewest(sizes, cap):
        best = [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for k, r in enumerate(rooms):
                if r >= sizes[i]:
                    place(i + 1, rooms[:k] + [r - sizes[i]] + rooms[k + 1 :])
            place(i + 1, [*rooms, cap - sizes[i]])

        place(0, [])
        return best[0]

    for _ in range(60):
        cap = rnd.randint(10, 40)
        sizes = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))), reverse=True)
        want = fewest(sizes, cap)
        assert packing.least_containers(sizes, cap) <= want == len(packing.complete(sizes, cap))
    sizes = [rnd.randint(300, 1500) for _ in range(600)]
    got, best, bound = len(packing.complete(sizes, 2048)), len(packing.best_fit(sizes, 2048)), packing.least_containers(sizes, 2048)
    assert bound <= got < best
    many = [rnd.randint(1, 40) for _ in range(2500)] + [rnd.randint(1000, 2048) for _ in range(300)]
    began = time.process_time()
    assert len(packing.complete(many, 2048)) <= len(packing.best_fit(many, 2048)) and time.process_time() - began < 60  # small items do not blow the enumeration up
    assert packing.dominates((5,), (3, 2)) and not packing.dominates((4, 1), (3, 2)) and packing.dominates((4, 3), (3, 2, 2))


def test_pack_rows(spark):
    rows = [(i, "word " * (i % 50 + 1)) for i in range(200)] + [(500, "word " * 300), (501, None), (502, ""), (0, "word "), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("g", F.lit(1))
    p = packing.pack(df, capacity=64, group=50)
    fill = packing.container_fill(p, 64).collect()
    assert all(0 < r.tokens <= 64 for r in fill)
    whole = p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("tok_end") - F.col("tok_start")).alias("t")).collect()
    assert {r.doc_id for r in whole} == set(range(200)) | {500}
    assert all(r.n == 1 for r in whole if r.t <= 64) and next(r.n for r in whole if r.doc_id == 500) == -(-next(r.t for r in whole if r.doc_id == 500) // 64)
    total = sum(r.tokens for r in fill)
    assert len(fill) <= total / 64 * 1.1 + 5
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)


def test_mix_meets_shares_and_repeats(spark):
    rows = [(i, "token " * (i % 30 + 5), ["Big Feed", "big-feed", " BIG_FEED"][i % 3]) for i in range(2000)] + [(5000 + i, "token " * 20, "small") for i in range(60)] + [(9000, "x", None), (9001, None, "small"), (9002, "x", "other"), (0, "token " * 5, "Big Feed")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copies", F.lit("clash"))
    t = spark.createDataFrame([("big feed", 0.8, 1), ("small", 0.15, 3), ("absent", 0.05, 9)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, t, bins=16)
    s = {r.source: r for r in mixing.shares(m, t).collect()}
    assert abs(s["big_feed"].share - 0.8 / 0.95) < 0.01 and abs(s["small"].share - 0.15 / 0.95) < 0.01 and s["absent"].tokens == 0
    assert s["big_feed"].most_copies == 1 and s["small"].most_copies <= 3
    assert m.count() == m.select("doc_id").distinct().count() and m.where("source = 'other'").count() == 0
    assert {tuple(r) for r in m.collect()} == {tuple(r) for r in mixing.mix(df, t, bins=64).collect()}  # the bins do not matter
    assert mixing.mix(df.limit(0), t).count() == 0


def test_inclusion_follows_the_weights(spark):
    """Expected copies are in proportion to the weight and capped; over many seeds the copies drawn have that mean, and the tokens are met every time."""
    rows = [(i, "token " * (i % 7 + 3), "s", [1.0, 2.0, 6.0][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, w double")
    t = spark.createDataFrame([("s", 0.5, 2), ("t", 0.5, 1)], "source string, target_share double, max_repeats int")
    df = df.unionByName(spark.createDataFrame([(1000 + i, "token " * 6, "t", None) for i in range(150)], df.schema)).persist()
    sizes = {r.doc_id: (r.source, r.tokens, r.copies) for r in mixing.mix(df, t, "w").collect()}
    assert all(c <= 2 for s, _, c in sizes.values() if s == "s")
    total, mean, runs = [], [0.0] * 3, 5
    for seed in range(runs):
        m = [r for r in mixing.mix(df, t, "w", seed=seed).collect() if r.source == "s"]
        total.append(sum(r.tokens * r.copies for r in m))
        for r in m:
            mean[r.doc_id % 3] += r.copies / 100 / runs
    assert max(total) - min(total) <= 10  # tokens of one text
    assert abs(mean[1] / mean[0] - 2) < 0.25 and abs(mean[2] - min(2, 6 * mean[0])) < 0.2


def test_rarity_counts_texts_once(spark):
    """Of a text under two ids each has half the chance of one that stands alone."""
    rows = [(i, f"own text number {i}", "s") for i in range(200)] + [(1000 + i, f"twin text number {i // 2}", "s") for i in range(200)] + [(5000, None, "s"), (5001, "", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df = df.unionByName(spark.createDataFrame([(9000 + i, "other text", "t") for i in range(60)], df.schema))
    m = mixing.mix(df, spark.createDataFrame([("s", 0.8, 1), ("t", 0.2, 1)], "source string, target_share double, max_repeats int"), mixing.RARITY)
    got = [r.doc_id for r in m.collect() if r.source == "s"]
    own, twins = sum(i < 1000 for i in got), sum(i >= 1000 for i in got)
    assert 1.4 < own / twins < 2.8


def test_boosting_learns():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = boost.Boosted().fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == (y[400:] > 0.5)).mean() > 0.9
