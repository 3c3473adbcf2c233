"""Questions, answers and their metrics."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import answer_f1, normalize_answer
from loomgraph.functions.tokens import VOCABULARY, token_counts
from loomgraph.plans.runtime import ship, spread


def load_questions(qa: DataFrame, max_samples: int | None = None) -> DataFrame:
    """(id, question, answers, context): answerable rows (a missing flag counts as yes), once per id.

    Answers: the answer and its aliases, trimmed, non-blank, distinct, sorted; context: the
    non-blank paragraph texts, trimmed, joined by a space. ``max_samples`` keeps the
    first so many of them by id.
    """
    tidy = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    answers = F.array_sort(F.array_distinct(tidy(F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>"))))))
    texts = F.transform(F.coalesce("paragraphs", F.array().cast("array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>")), lambda p: p["paragraph_text"])
    q = qa.where("id is not null and coalesce(answerable, true)").select("id", "question", answers.alias("answers"), F.array_join(tidy(texts), " ").alias("context"))
    q = q.dropDuplicates(["id"])
    return q if max_samples is None else q.orderBy("id").limit(max_samples)


def predictions(dump: DataFrame) -> DataFrame:
    """(uid, prediction, gold): one row per reference of each answered question; answers are stored nested."""
    d = dump.where("id is not null and answer is not null").select("id", "answer", "answers").dropDuplicates(["id"])
    return d.select(F.col("id").alias("uid"), F.col("answer").alias("prediction"), F.explode(F.flatten(F.filter("answers", lambda x: x.isNotNull()))).alias("gold")).where("gold is not null")


def score(pairs: DataFrame) -> DataFrame:
    """(uid, gold, f1, precision, recall, exact_match, accuracy) of each reference."""
    f = answer_f1(F.col("prediction"), F.col("gold"))
    p, g = normalize_answer(F.col("prediction")), normalize_answer(F.col("gold"))
    s = pairs.select("uid", "prediction", "gold", f.alias("f"), (p == g).cast("int").alias("exact_match"), F.contains(p, g).cast("int").alias("accuracy"))
    r = lambda c: F.round(F.col(f"f.{c}"), 6).alias(c)
    return s.select("uid", "prediction", "gold", r("f1"), r("precision"), r("recall"), "exact_match", "accuracy")


def best(scores: DataFrame, metrics: tuple[str, ...] = ("f1", "precision", "recall", "exact_match", "accuracy")) -> DataFrame:
    """The best value over the references, of each metric by itself."""
    return scores.groupBy("uid").agg(*[F.max(m).alias(m) for m in metrics])


def summary(best_scores: DataFrame, metrics: tuple[str, ...] = ("f1", "precision", "recall", "exact_match", "accuracy")) -> DataFrame:
    """One row of means."""
    return best_scores.agg(F.count("*").alias("questions"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def bleu(pred: list[str], ref: list[str], weights: tuple[float, ...], smooth: float = 0.0) -> float:
    """Sentence BLEU against one reference; ``smooth`` replaces a zero count of matches."""
    if not pred:
        return 0.0
    logs = 0.0
    for n, w in enumerate(weights, 1):
        have = Counter(tuple(pred[i : i + n]) for i in range(len(pred) - n + 1))
        want = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
        hit, total = sum((have & want).values()), max(sum(have.values()), 1)
        if n == 1 and not hit:
            return 0.0
        if not w:
            continue
        p = hit / total if hit else (smooth / total if smooth else 2.2250738585072014e-308)
        logs += w * math.log(p)
    short = 1.0 if len(pred) > len(ref) else math.exp(1 - len(ref) / len(pred))
    return short * math.exp(logs)


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: a row of the table is one number, so a word costs a few operations on len(b) bits."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def rouge_l(pred: list[str], ref: list[str]) -> float:
    """F1 of the longest common subsequence."""
    n = common(pred, ref) if pred and ref else 0
    return 2 * n / (len(pred) + len(ref)) if n else 0.0


def meteor(pred: list[str], ref: list[str]) -> float:
    """Exact-match METEOR: unigram F (recall weighted 9 to 1) less a fragmentation penalty."""
    free: dict[str, list[int]] = {}
    for j in range(len(ref) - 1, -1, -1):
        free.setdefault(ref[j], []).append(j)
    at = [(i, free[x].pop()) for i, x in enumerate(pred) if free.get(x)]
    if not at:
        return 0.0
    m = len(at)
    p, r = m / len(pred), m / len(ref)
    chunks = 1 + sum(b[0] != a[0] + 1 or b[1] != a[1] + 1 for a, b in zip(at, at[1:]))
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


TEXT_METRICS = ("bleu_1", "bleu_4", "bleu_1_smooth", "bleu_4_smooth", "meteor", "rouge_l")


def text_scores(pairs: DataFrame) -> DataFrame:
    """(uid, gold, bleu_1, bleu_4, bleu_1_smooth, bleu_4_smooth, meteor, rouge_l) over white-space words, in Arrow batches."""
    ship(pairs.sparkSession)
    schema = pa.schema([("uid", pa.string()), ("gold", pa.string()), *((m, pa.float64()) for m in TEXT_METRICS)])
    one, four = (1.0,), (0.25,) * 4

    def run(batches):
        for b in batches:
            u, p, g = (c.to_pylist() for c in b.columns)
            rows = []
            for x, y in zip(p, g):
                a, r = x.split(), y.split()
                rows.append([round(v, 6) for v in (bleu(a, r, one), bleu(a, r, four), bleu(a, r, one, 0.1), bleu(a, r, four, 0.1), meteor(a, r), rouge_l(a, r))])
            cols = list(zip(*rows)) if rows else [()] * len(TEXT_METRICS)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(g, pa.string()), *(pa.array(c, pa.float64()) for c in cols)], schema=schema)

    ddl = "uid string, gold string, " + ", ".join(f"{m} double" for m in TEXT_METRICS)
    return spread(pairs.select("uid", "prediction", "gold")).mapInArrow(run, ddl)


def full_summary(dump: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row: questions, the mean of every metric over the questions, and avg_tokens of prompt and answer.

    Each metric is the best over a question's references by itself; questions without
    references count for avg_tokens alone.
    """
    pairs = predictions(dump)
    one = score(pairs).join(text_scores(pairs).dropDuplicates(["uid", "gold"]), ["uid", "gold"])
    metrics = ("f1", "precision", "recall", "exact_match", "accuracy", *TEXT_METRICS)
    asked = dump.where("id is not null and answer is not null").select("id", F.concat(F.coalesce("prompt", F.lit("")), "answer").alias("x")).dropDuplicates(["id"])
    tokens = token_counts(asked, "id", "x", vocabulary=vocabulary).agg(F.round(F.avg("tokens"), 6).alias("avg_tokens"))
    return summary(best(one, metrics), metrics).crossJoin(F.broadcast(tokens))  # one row each
