"""SQL names of the engine's functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomgraph.functions.text import PUNCTUATION


def register(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions (all expanded by the optimiser, none in Python); returns their names."""
    p = PUNCTUATION.replace("\\", "\\\\").replace("'", "\\'")
    defs = {
        "graph_normalize": ("s STRING", "STRING", "translate(lower(s), ' -', '__')"),
        "word_tokens": ("s STRING", "ARRAY<STRING>", r"filter(split(coalesce(s, ''), '\\s+'), x -> x <> '')"),
        "token_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "size(array_intersect(a, b)) / size(array_union(array_union(a, b), array('.')))"),
        "answer_normalize": ("s STRING", "STRING", f"trim(regexp_replace(regexp_replace(translate(lower(s), '{p}', ''), '\\\\b(a|an|the)\\\\b', ' '), '\\\\s+', ' '))"),
        "answer_exact": ("p STRING, g STRING", "INT", "cast(answer_normalize(p) = answer_normalize(g) as int)"),
        "answer_contains": ("p STRING, g STRING", "INT", "cast(contains(answer_normalize(p), answer_normalize(g)) as int)"),
        "vector_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))"),
    }
    for name, (args, out, body) in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
    return list(defs)
