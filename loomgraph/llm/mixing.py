"""Problem 9: mixing sources to target weights, by Pareto order sampling.

Each source is to give its share of all tokens. The largest total that every source
with texts can meet within its repeats is used. Within a source a text's expected
copies are in proportion to its weight and at most the repeats allowed; the factor is
calibrated so that they add up to the source's tokens. The whole copies are certain;
for what is left of each expectation, its inclusion probability, a sample is drawn:
texts are ranked by random odds divided by inclusion odds and taken until the tokens
that are missing are reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.tokens import VOCABULARY, token_counts
from loomgraph.llm.truncation import source_key
from loomgraph.plans.runtime import cut
from loomgraph.plans.skew import skew_join

#: Ranks are cut at the border by a histogram of this many bins, so that no task sorts a whole source.
BINS = 4096
#: Rows of (source, weight) that may be broadcast; more are joined by shuffle.
WEIGHTS = 500_000


def _plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: its share, the total of the mixture, and the tokens that the source is to give (``need``)."""
    t = targets.select(source_key(F.col("source")).alias("src"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    t = t.where("src is not null").groupBy("src").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    supply = sized.groupBy("src").agg(F.sum("tokens").cast("double").alias("supply"), F.count("*").alias("documents"))
    p = t.join(supply, "src", "left").fillna({"supply": 0.0, "documents": 0})
    live = (F.col("supply") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    one = Window.partitionBy(F.lit(0))  # one row per target source
    p = p.withColumn("share", F.when(live, F.col("target_share")).otherwise(0.0)).withColumn("share", F.coalesce(F.try_divide(F.col("share"), F.sum("share").over(one)), F.lit(0.0)))
    p = p.withColumn("total", F.min(F.when(live, F.try_divide(F.col("supply") * F.col("max_repeats"), F.col("share")))).over(one))
    return p.withColumn("need", F.when(live, F.least(F.col("share") * F.col("total"), F.col("supply") * F.col("max_repeats"))).otherwise(0.0))


def calibrate(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(src, w, whole, part): per source and weight the certain copies of a text and the probability of one more.

    The expected copies are least(max_repeats, c w) with the c for which they give
    ``need`` tokens: from the largest weight down, texts are capped until c w falls
    below the cap. One row per source and weight; weights have three digits.
    """
    b = sized.groupBy("src", "w").agg(F.sum("tokens").cast("double").alias("t")).join(F.broadcast(plan.where("need > 0").select("src", "need", "max_repeats")), "src")
    down = Window.partitionBy("src").orderBy(F.desc("w"))
    b = b.withColumn("above", F.sum("t").over(down) - F.col("t")).withColumn("rest", F.sum(F.col("w") * F.col("t")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    b = b.withColumn("c", F.greatest((F.col("need") - F.col("max_repeats") * F.col("above")) / F.col("rest"), F.lit(0.0)))
    c = b.where(F.col("c") * F.col("w") <= F.col("max_repeats") * (1 + 1e-12)).groupBy("src").agg(F.max_by("c", "w").alias("c"))
    e = F.coalesce(F.least(F.col("c") * F.col("w"), F.col("max_repeats").cast("double")), F.col("max_repeats").cast("double"))
    b = b.drop("c").join(F.broadcast(c), "src", "left").withColumn("e", e).withColumn("whole", F.floor(F.col("e") + 1e-9))  # c has one row per source
    return b.select("src", "w", "t", "whole", F.greatest(F.col("e") - F.col("whole"), F.lit(0.0)).alias("part"), "max_repeats")


#: The weight 1 / times a text stands in the table, so that one delivered under several ids counts as one.
RARITY = "1 / occurrences"


def _rarity(sized: DataFrame) -> DataFrame:
    """Counted rows with ``w`` by their text's occurrences; texts are compared by hash and length, so only short rows are joined."""
    n = sized.groupBy("h", "chars").agg(F.count("*").alias("n")).persist()
    return skew_join(sized.drop("w"), n.select("h", "chars", (1 / F.col("n")).alias("w")), ["h", "chars"], n)


def mix(docs: DataFrame, targets: DataFrame, weight: str | None = None, vocabulary: str = VOCABULARY, seed: int = 11, bins: int = BINS) -> DataFrame:
    """(doc_id, source, tokens, copies) of the texts in the mixture.

    Sources are compared in one spelling; texts of sources without a target, of
    unknown source, empty or NULL take no part; target sources without texts give
    nothing and the others' shares are scaled up. ``weight`` names a positive column
    to which a text's expected copies are in proportion, up to max_repeats (NULL, NaN
    and what is not positive count as 1), or is ``RARITY``; without it they are equal
    within a source. A doc_id counts once.
    """
    given = F.col(weight).cast("double") if weight and weight != RARITY else F.lit(1.0)
    t = docs.select("doc_id", source_key(F.col("source")).alias("src"), "text", F.xxhash64("text").alias("h"), F.length("text").alias("chars"), given.alias("w")).where("doc_id is not null and src is not null")
    sized = token_counts(t, "doc_id", "text", ("src", "h", "chars", "w"), vocabulary).dropDuplicates(["doc_id"]).where("tokens > 0").persist()
    if weight == RARITY:
        sized = _rarity(sized)
    w = F.when((F.col("w") > 0) & (F.col("w") < float("inf")), F.col("w")).otherwise(1.0)
    scale = F.pow(F.lit(10.0), F.floor(F.log10(w)) - 2)
    sized = cut(sized.select("doc_id", "src", "tokens", (F.round(w / scale) * scale).alias("w")))  # short rows; what follows reads them several times
    plan = _plan(sized, targets).persist()
    rates = cut(calibrate(sized, plan))
    few = rates.count() <= WEIGHTS
    rows = sized.join(F.broadcast(rates.drop("t")) if few else rates.drop("t"), ["src", "w"])
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    odds = F.when(F.col("part") > 0, F.col("part") / F.greatest(1 - F.col("part"), F.lit(1e-12)))
    q = u / (1 - u) / odds
    rows = rows.withColumn("rank", q / (1 + q)).withColumn("bin", F.floor(F.col("rank") * bins).cast("int"))
    can = rows.where((F.col("part") > 0) & (F.col("whole") < F.col("max_repeats")))
    hist = can.groupBy("src", "bin").agg(F.sum("tokens").alias("t"))
    up = Window.partitionBy("src").orderBy("bin")
    need = rates.groupBy("src").agg(F.sum(F.col("part") * F.col("t")).alias("need"))
    hist = hist.withColumn("below", F.sum("t").over(up) - F.col("t")).join(F.broadcast(need), "src")  # one row per target source
    border = hist.where("below < need").groupBy("src").agg(F.max("bin").alias("border"), F.max(F.struct("bin", (F.col("need") - F.col("below")).alias("left"))).alias("s")).select("src", "border", F.col("s.left").alias("left"))
    rows = rows.join(F.broadcast(border), "src", "left")  # one row per target source
    inside = F.coalesce(F.col("bin") < F.col("border"), F.lit(False)) & (F.col("part") > 0)
    edge = F.coalesce(F.col("bin") == F.col("border"), F.lit(False)) & (F.col("part") > 0) & (F.col("whole") < F.col("max_repeats"))
    sure = rows.where(~edge).withColumn("extra", F.when(inside & (F.col("whole") < F.col("max_repeats")), 1).otherwise(0))
    run = Window.partitionBy("src").orderBy("rank", "doc_id")
    last = rows.where(edge).withColumn("cum", F.sum("tokens").over(run)).withColumn("extra", F.when(F.col("cum") - F.col("tokens") / 2 <= F.col("left"), 1).otherwise(0)).drop("cum")
    out = sure.unionByName(last).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))
    return out.where("copies > 0").select("doc_id", F.col("src").alias("source"), "tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, share, most_copies): what each source actually gives."""
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    r = t.join(got, "source", "left").fillna({"documents": 0, "tokens": 0, "most_copies": 0})
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per target source
    return r.withColumn("share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), total.cast("double")), F.lit(0.0))).select("source", "target_share", "max_repeats", "documents", "tokens", "share", "most_copies")
