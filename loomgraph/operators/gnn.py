"""Graph attention scores of evidence nodes: seeded forward pass in NumPy, one evidence graph at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.runtime import ship

SLOTS = ("T", "S", "N", "R", "H", "O")


def one_hot(kind) -> object:
    """Seven slots, the last never set."""
    return F.array(*[(F.coalesce(kind, F.lit("")) == s).cast("double") for s in (*SLOTS, "-")])


class Attention:
    """Two attention layers (2 heads, then 1) and a query-conditioned score; weights from a seed."""

    def __init__(self, dim: int, query: int, hidden: int = 128, out: int = 256, seed: int = 0):
        r = np.random.default_rng(seed)
        w = lambda *s: r.normal(size=s) / np.sqrt(s[0])
        self.first = [(w(dim, hidden), w(hidden), w(hidden)) for _ in range(2)]
        self.second = [(w(2 * hidden, out), w(out), w(out))]
        self.mlp = (w(out + query, hidden), w(hidden, 1))

    @staticmethod
    def _layer(x: np.ndarray, mask: np.ndarray, heads) -> np.ndarray:
        out = []
        for w, a, b in heads:
            h = x @ w
            e = (h @ a)[:, None] + (h @ b)[None, :]
            e = np.where(mask, np.where(e > 0, e, 0.2 * e), -np.inf)
            e = np.exp(e - e.max(1, keepdims=True))
            out.append(e / e.sum(1, keepdims=True) @ h)
        return np.concatenate(out, axis=1)

    def scores(self, x: np.ndarray, pairs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Softmax over the nodes."""
        mask = np.eye(len(x), dtype=bool)
        if len(pairs):
            mask[pairs[:, 0], pairs[:, 1]] = mask[pairs[:, 1], pairs[:, 0]] = True
        h = self._layer(self._layer(x, mask, self.first), mask, self.second)
        z = np.maximum(np.concatenate([h, np.repeat(query[None], len(x), 0)], axis=1) @ self.mlp[0], 0) @ self.mlp[1]
        z = np.exp(z[:, 0] - z.max())
        return z / z.sum()


def gnn_scores(features: DataFrame, edges: DataFrame, queries: DataFrame, seed: int = 0, weights: Attention | None = None) -> DataFrame:
    """(uid, id, p) by ``weights``, else by seeded ones: features (uid, id, x), edges (uid, src, dst), queries (uid, q). An evidence graph is a few nodes."""
    ship(features.sparkSession)
    schema = pa.schema([("uid", pa.string()), ("id", pa.string()), ("p", pa.float64())])
    e = edges.groupBy("uid").agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    g = features.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("n")).join(e, "uid", "left").join(queries, "uid")

    def run(batches):
        nets: dict[tuple[int, int], Attention] = {}  # built once a task
        for b in batches:
            out = []
            for u, n, e_, q in zip(*(c.to_pylist() for c in b.columns)):
                ids = [r["id"] for r in n]
                at = {i: k for k, i in enumerate(ids)}
                pairs = np.array([(at[r["src"]], at[r["dst"]]) for r in e_ or () if r["src"] in at and r["dst"] in at], np.int64).reshape(-1, 2)
                x = np.array([r["x"] for r in n])
                shape = (x.shape[1], len(q))
                if shape not in nets:
                    nets[shape] = weights or Attention(*shape, seed=seed)
                net = nets[shape]
                out += zip([u] * len(ids), ids, np.round(net.scores(x, pairs, np.array(q)), 9).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return g.select("uid", "n", "e", "q").mapInArrow(run, "uid string, id string, p double")
