"""Communities of the graph: components, label propagation, modularity, context texts, H and O nodes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import simple_graph
from loomgraph.plans.runtime import cut, ship
from loomgraph.plans.skew import skew_join


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, without parallels and self-loops."""
    e = simple_graph(edges).where("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that is connected with the node.

    Large-star and small-star steps in turn: every step joins and aggregates by key,
    a hub's neighbours are only reduced to their minimum, and the number of steps
    grows with the logarithm of the graph's width. Each round is checkpointed; the
    end is reached when number and checksum of the edges stay; without that within
    ``rounds`` an error is raised, never an unfinished result.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(simple_graph(edges).where("a <> b"))
    before = mark(e)
    for _ in range(rounds):
        two = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = two.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = two.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        down = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
        new = cut(small.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        e, now = new, mark(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("c"))
    return nodes.select("id").distinct().join(root, "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, community) after a fixed number of synchronous rounds.

    A node takes the label most frequent among its neighbours, the smallest at a tie;
    one without neighbours keeps its own. Counts are combined before the shuffle.
    """
    two = both_ways(edges).persist()
    degree = two.groupBy("b").agg(F.count("*").alias("n")).persist()  # a hub's edges are split
    label = nodes.select("id", F.col("id").alias("community")).distinct()
    for _ in range(rounds):
        votes = skew_join(two, label.withColumnRenamed("id", "b"), ["b"], degree).groupBy("a", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("k"), "community")).alias("x")).select(F.col("a").alias("id"), F.col("x.community").alias("new"))
        label = cut(label.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
    two.unpersist()
    degree.unpersist()
    return label


#: Edges of a part of the quotient graph that one task optimises.
PART_EDGES = 200_000


def louvain(edges: list[tuple[str, str, float]], m: float, degree: dict[str, float]) -> dict[str, str]:
    """Local moving and aggregation that raise modularity; ``m`` is the weight of the whole graph, ``degree`` that of each node in it.

    Nodes are visited in order and ties go to the smallest label, so the result is the same every time.
    """
    label = {x: x for x in degree}
    graph: dict[str, dict[str, float]] = {x: {} for x in degree}
    for a, b, w in edges:
        if a != b:
            graph[a][b] = graph[a].get(b, 0.0) + w
            graph[b][a] = graph[b].get(a, 0.0) + w
    total = dict(degree)
    while True:
        own, weight, moved = {x: x for x in graph}, dict(total), False
        again = True
        while again:
            again = False
            for x in sorted(graph):
                links: dict[str, float] = {}
                for y, w in graph[x].items():
                    links[own[y]] = links.get(own[y], 0.0) + w
                here = own[x]
                weight[here] -= total[x]
                gain = lambda c: links.get(c, 0.0) - total[x] * weight[c] / (2 * m)  # noqa: B023, E731
                best = min(links, key=lambda c: (-round(gain(c), 12), c), default=here)
                if best != here and gain(best) > gain(here) + 1e-12:
                    own[x], again, moved = best, True, True
                weight[own[x]] += total[x]
        if not moved:
            return label
        label = {x: own[c] for x, c in label.items()}
        new: dict[str, dict[str, float]] = {c: {} for c in set(own.values())}
        for a, near in graph.items():
            for b, w in near.items():
                if own[a] != own[b]:
                    new[own[a]][own[b]] = new[own[a]].get(own[b], 0.0) + w
        sums: dict[str, float] = dict.fromkeys(new, 0.0)
        for x, c in own.items():
            sums[c] += total[x]
        graph, total = new, sums


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 2, part_edges: int = PART_EDGES) -> DataFrame:
    """(id, community): modularity communities of the multigraph without direction.

    Label propagation over all rows comes first; the graph of its communities, whose
    parallel edges are summed, is then optimised component by component, one task for
    each of up to ``part_edges`` edges (optimal communities never span components); a
    larger component keeps what label propagation found, so no task grows without
    bound. Nodes without edges are communities of their own.
    """
    first = label_propagation(nodes, edges, rounds)
    lab = lambda end, name: first.select(F.col("id").alias(end), F.col("community").alias(name))
    degree_of = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    e = skew_join(edges.select("src", "dst"), lab("src", "ca"), ["src"], degree_of.withColumnRenamed("id", "src"))
    e = skew_join(e, lab("dst", "cb"), ["dst"], degree_of.withColumnRenamed("id", "dst"))
    quotient = cut(e.groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.count("*").cast("double").alias("w")))
    m = quotient.agg(F.sum("w")).first()[0]
    if not m:
        return first
    tops = quotient.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    part = components(tops, quotient)
    deg = quotient.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("d"))
    rows = quotient.join(part.withColumnRenamed("id", "src"), "src").select("component", "src", "dst", "w")
    small = rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= part_edges).select("component")
    work = rows.join(small, "component").unionByName(part.join(deg, "id").join(small, "component").select("component", F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("d").alias("w")))
    ship(nodes.sparkSession)

    def run(key, t):
        r = list(zip(*(t.column(c).to_pylist() for c in ("src", "dst", "w"))))
        got = louvain([x for x in r if x[1] is not None], m, {a: w for a, b, w in r if b is None})
        return pa.table({"c": pa.array(list(got), pa.string()), "better": pa.array(list(got.values()), pa.string())})

    better = work.groupBy("component").applyInArrow(run, "c string, better string")
    return first.join(better, F.col("community") == F.col("c"), "left").select("id", F.coalesce("better", "community").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (modularity): sum over communities of inner edges / m - (degrees / 2m)^2, on the multigraph without direction."""
    c = communities.select("id", "community")
    e = edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst")
    e = e.groupBy("ca", "cb").agg(F.count("*").alias("n")).persist()
    m = e.agg(F.sum("n").alias("m"))
    inner = e.where("ca = cb").select(F.col("ca").alias("c"), F.col("n").alias("l"), F.lit(0).alias("d"))
    degree = e.select(F.col("ca").alias("c"), F.lit(0).alias("l"), F.col("n").alias("d")).unionByName(e.select(F.col("cb").alias("c"), F.lit(0).alias("l"), F.col("n").alias("d")))
    by = inner.unionByName(degree).groupBy("c").agg(F.sum("l").alias("l"), F.sum("d").alias("d"))
    q = F.sum(F.col("l") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0)))
    return by.crossJoin(F.broadcast(m)).agg(F.round(q, 6).alias("modularity"))  # m is one row


def community_context(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, kind, text, seq): summary texts, and triple texts of the relations whose three parts have text."""
    c = communities.select("id", "community")
    s = nodes.where("type = 'S' and trim(coalesce(text, '')) <> ''").join(c, "id").select("community", F.lit("summary").alias("kind"), "text", "seq")
    last = edges.where("label in ('subj', 'obj')").groupBy("src").agg(F.max_by(F.when(F.col("label") == "subj", F.col("dst")), F.when(F.col("label") == "subj", F.col("seq"))).alias("s"), F.max_by(F.when(F.col("label") == "obj", F.col("dst")), F.when(F.col("label") == "obj", F.col("seq"))).alias("o"))
    t = nodes.select("id", "text")
    r = nodes.where("type = 'R' and trim(coalesce(text, '')) <> ''").join(c, "id").join(last, F.col("id") == F.col("src"))
    r = r.join(t.select(F.col("id").alias("s"), F.col("text").alias("st")), "s", "left").join(t.select(F.col("id").alias("o"), F.col("text").alias("ot")), "o", "left")
    r = r.where("coalesce(st, '') <> '' and coalesce(ot, '') <> ''").select("community", F.lit("relation").alias("kind"), F.concat_ws(" ", "st", "text", "ot").alias("text"), "seq")
    return s.unionByName(r)


def titles(context: DataFrame, n_words: int = 150, title_words: int = 8) -> DataFrame:
    """(community, hl_summary, title): offline stand-ins for the two generated texts.

    The first ``n_words`` words of the context (that many texts suffice, so no
    community is gathered whole) and its most frequent words.
    """
    w = Window.partitionBy("community").orderBy(F.desc("kind"), "seq")
    few = context.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_words)
    text = few.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ").alias("t"))
    summary = text.select("community", F.array_join(F.slice(F.filter(F.split("t", r"\s+"), lambda x: x != ""), 1, n_words), " ").alias("hl_summary"))
    word = context.select("community", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 3)).alias("word")).groupBy("community", "word").agg(F.count("*").alias("n"))
    top = word.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "word"))).where(F.col("r") <= title_words)
    title = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " ").alias("title"))
    return summary.join(title, "community")


def ho_nodes(texts: DataFrame) -> DataFrame:
    """(id, type, text): an H and an O node of each community that has both texts."""
    t = texts.where("coalesce(hl_summary, '') <> '' and coalesce(title, '') <> ''")
    return t.select(F.concat(F.lit("H_"), "community").alias("id"), F.lit("H").alias("type"), F.col("hl_summary").alias("text")).unionByName(t.select(F.concat(F.lit("O_"), "community").alias("id"), F.lit("O").alias("type"), F.col("title").alias("text")))


def ho_edges(texts: DataFrame, nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """(src, dst, label): O overview_of H, H summarizes every S of its community."""
    t = texts.where("coalesce(hl_summary, '') <> '' and coalesce(title, '') <> ''").select("community")
    h = F.concat(F.lit("H_"), "community")
    over = t.select(F.concat(F.lit("O_"), "community").alias("src"), h.alias("dst"), F.lit("overview_of").alias("label"))
    s = nodes.where("type = 'S'").select("id").join(communities.select("id", "community"), "id")
    s = skew_join(s, t, ["community"], s.groupBy("community").agg(F.count("*").alias("n")))  # one community may hold most texts
    return over.unionByName(s.select(h.alias("src"), F.col("id").alias("dst"), F.lit("summarizes").alias("label")))
