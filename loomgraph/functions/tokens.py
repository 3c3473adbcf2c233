"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.plans.runtime import ship, spread

#: Rank file of the tokenizer the project counts with; a parameter of every operator that counts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str):
    """The tokenizer of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, keep..., tokens): whole texts are counted; NULL has none."""
    ship(df.sparkSession)
    cols = df.select(key, *keep, text)
    fields = [f for f in cols.schema.fields if f.name != text]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens bigint"

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            n = [0 if not t else len(enc.encode_ordinary(t)) for t in b.column(len(fields)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], pa.array(n, pa.int64())], names=[*(f.name for f in fields), "tokens"])

    return spread(cols).mapInArrow(run, ddl)

