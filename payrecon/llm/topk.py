"""Exact top-k inner products by ball trees: branch and bound in every shard, with the k-th score shared between shards.

Vectors are dealt into shards; each shard's task builds a ball tree and answers blocks of queries. A node with centre c
and radius r holds no vector above ``q.c + |q| r``, so nodes are visited in the order of that bound and a query leaves a
shard as soon as the bound falls below its k-th score. The search has two rounds: in the first each query searches one
shard, which gives a k-th score; in the second that score goes with the query to every other shard, where most
nodes are then never opened. Scores are integers of ``floor(scale * x)`` vectors, so they are exact.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, as query or candidate;
vectors of different lengths are never compared; repeated vectors are separate candidates; ties go to the smaller id;
rows with a null id take no part; with fewer than k candidates all are returned; an empty table gives no rows.
Only the id and the vector column are read, so further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from payrecon.llm.common import staged

BLOCK_ROWS = 512
LEAF_ROWS = 128
#: Above this absolute sum a float64 product of integers could be inexact; such queries use Python integers.
EXACT = float(1 << 52)


@dataclass
class Tree:
    """Leaves of a ball tree over the rows of one shard and one vector length."""

    rows: list[np.ndarray]
    centres: np.ndarray
    radii: np.ndarray


def build(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Split at the median along the axis between two far points until a node has at most ``leaf_rows`` rows."""
    leaves, open_nodes = [], [np.arange(len(x))]
    while open_nodes:
        node = open_nodes.pop()
        if len(node) <= leaf_rows:
            leaves.append(node)
            continue
        part = x[node]
        a = part[np.argmax(((part - part.mean(0)) ** 2).sum(1))]
        b = part[np.argmax(((part - a) ** 2).sum(1))]
        order = np.argsort((part - a) @ (b - a), kind="stable")
        open_nodes += [node[order[:len(node) // 2]], node[order[len(node) // 2:]]]
    centres = np.stack([x[n].mean(0) for n in leaves])
    radii = np.array([np.sqrt(((x[n] - c) ** 2).sum(1).max()) for n, c in zip(leaves, centres)])
    return Tree(leaves, centres, radii)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if (np.abs(q).sum(1).max(initial=0) * np.abs(x).max(initial=0)) < EXACT:
        return (q @ x.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q], dtype=object).reshape(len(q), len(x))


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int) -> list[tuple]:
    """(query index, id, score) of every query's k best rows of the shard that reach its score ``floor``."""
    norms = np.sqrt((q ** 2).sum(1))
    bounds = q @ tree.centres.T + norms[:, None] * tree.radii[None, :]
    bounds += 1e-6 * (1 + np.abs(bounds))  # rounding of the bound itself must not cut a tie
    best = [([], []) for _ in q]
    kth = floor.astype(float).copy()
    for leaf in np.argsort(-bounds.max(0)):
        live = np.flatnonzero(bounds[:, leaf] >= kth)
        if not len(live):
            continue
        rows = tree.rows[leaf]
        scores = _products(q[live], x[rows])
        for i, s in zip(live, scores):
            take = (s >= kth[i]) & (ids[rows] != q_ids[i])
            if not take.any():
                continue
            all_s = np.concatenate([best[i][1], s[take]]) if len(best[i][1]) else s[take]
            all_i = np.concatenate([best[i][0], ids[rows][take]]) if len(best[i][0]) else ids[rows][take]
            order = np.lexsort((all_i, -all_s))[:k] if all_s.dtype != object else np.array(sorted(range(len(all_s)), key=lambda n: (-all_s[n], all_i[n]))[:k])
            best[i] = (all_i[order], all_s[order])
            if len(order) == k:
                kth[i] = max(kth[i], float(all_s[order[-1]]) if all_s.dtype != object else np.nextafter(float(all_s[order[-1]]), -np.inf))
    return [(i, int(v), int(s)) for i, (vs, ss) in enumerate(best) for v, s in zip(vs, ss)]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, shard_rows: int = 8192,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product for each row of ``queries`` but itself (by id).

    Returns query_id, rank (from 1), the candidate's id as vec_id, and score.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_column)
        whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole).select(
            F.col(id_column).cast("long").alias("id"),
            F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))

    rows, asked = clean(vectors), clean(queries)
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    rows = staged(rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), "topk-rows")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    schema = "query_id long, vec_id long, score decimal(38,0)"

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = []
        for size, part in left.groupby(left["v"].map(len)):
            x = np.stack(part["v"].to_numpy())
            ids, tree = part["id"].to_numpy(), build(x)
            same = right[right["v"].map(len) == size]
            for at in range(0, len(same), BLOCK_ROWS):
                block = same.iloc[at:at + BLOCK_ROWS]
                q, q_ids = np.stack(block["v"].to_numpy()), block["id"].to_numpy()
                found = search(tree, x, ids, q, q_ids, block["floor"].fillna(-np.inf).to_numpy(dtype=float), k)
                out += [(int(q_ids[i]), v, s) for i, v, s in found]
        frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        frame["score"] = frame["score"].map(Decimal).astype(object)
        return frame

    def ask(q: DataFrame) -> DataFrame:
        return rows.groupBy("shard").cogroup(q.groupBy("shard")).applyInPandas(answer, schema)

    def best(found: DataFrame) -> DataFrame:
        """The k best of each query; a query has at most k rows from each shard."""
        x = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id")))
        return found.groupBy("query_id").agg(F.slice(x, 1, k).alias("top"))

    first = staged(ask(asked.withColumn("shard", home).withColumn("floor", F.lit(None).cast("double"))), "topk-first")
    kth = best(first).where(F.size("top") == k).select(
        F.col("query_id").alias("id"), (-F.element_at("top", k)["neg"]).cast("double").alias("floor"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
    rest = ask(asked.join(kth, "id", "left").withColumn("shard", F.explode(others)))
    return best(first.unionByName(rest)).select("query_id", F.posexplode("top").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
        (-F.col("x.neg")).cast("long").alias("score"))
