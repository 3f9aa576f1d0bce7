"""Connected components, their anchors, neighbours and searches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovewise.operators.hotkeys import top_per_key
from grovewise.storage import Scratch


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (v, u) that join the same vertices: of each run of edges, one from every vertex but one of each component."""
    held, rows, kept = [], 0, 0

    def thinned() -> pa.RecordBatch:
        ends = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held]).dictionary_encode()
        code = ends.indices.to_numpy()
        a, b = code[: len(code) // 2], code[len(code) // 2 :]
        top = np.arange(len(ends.dictionary))
        while True:
            x, y = top[a], top[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
            while (top != (over := top[top])).any():
                top = over
        v = np.flatnonzero(top != np.arange(len(top)))
        return pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(x)) for x in (v, top[v])], names=["v", "u"])

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows - kept >= max(500_000, kept):
            held = [thinned()]
            rows = kept = len(held[0])
            if kept > 1_000_000:  # the others follow by themselves
                yield held[0]
                held, rows, kept = [], 0, 0
    if rows:
        yield thinned()


def components(edges: DataFrame, scratch: Scratch | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """``v``, ``component``: the smallest vertex that each vertex of ``edges(a, b)`` is joined to.

    A vertex of ``vertices(v)`` without edges is its own component.

    Edges that their own task can do without go first. Then alternates two steps until nothing moves: every vertex sends its larger neighbours, then its smaller
    ones and itself, to the smallest vertex that it sees. Each step is a minimum for each vertex, combined
    before the shuffle, and a join. The rounds grow with the logarithm of the graph's size.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    ends = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    kind = ends.schema["v"].dataType.simpleString()
    ends = ends.mapInArrow(_spanning, f"v {kind}, u {kind}")
    links = scratch.keep(ends.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct())
    before = None
    while True:
        both = links.unionAll(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.filter(F.col("u") > F.col("v")).join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = scratch.keep(large)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
        small = scratch.keep(small.select("e.*").filter(F.col("v") != F.col("u")).distinct())
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        scratch.drop(large, links)
        links = small
        if now == before:  # links are distinct, so their number and the sum of their hashes tell whether any moved
            break
        before = now
    found = links.groupBy("v").agg(F.min("u").alias("component"))
    roots = found.select(F.col("component").alias("v"), "component").distinct()
    found = found.unionAll(roots)
    if vertices is None:
        return found
    lone = vertices.filter(F.col("v").isNotNull()).select("v", F.col("v").alias("component"))
    return found.unionAll(lone).groupBy("v").agg(F.min("component").alias("component"))


def anchors(members: DataFrame, component: str, tip: str, copies: str) -> DataFrame:
    """The member of each component with the most copies; ties go to the smaller id."""
    best = F.min(F.struct((-F.col(copies)).alias("n"), F.col(tip).alias("tip")))
    return members.groupBy(component).agg(best["tip"].alias("anchor"), F.count(F.lit(1)).alias("n_tips"))


def neighbours(hits: DataFrame, k: int) -> DataFrame:
    """The k most similar targets of each query, ties to the larger target (S6, W1): ``query, target, identity``."""
    return top_per_key(hits, ["query"], [("identity", "descending"), ("target", "descending")], k, ["query", "target", "identity"])


def nearest(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int, block: int = 2000, row_block: int = 16_000) -> DataFrame:
    """The k rows with the greatest dot product for each query row, itself excluded: ``query, target, score``.

    Exact. Rows are gathered in blocks of about ``row_block`` by hash, each once; queries, in blocks of about
    ``block``, go to every block of rows and meet it where it lies. Each pair of blocks is one product, and
    only its k best a query go on. Scores of integers are integers.
    With fractions the product only picks: whatever lies within twice its bound on rounding of the k-th best
    goes on with a correctly rounded sum, so scores don't depend on the blocks. Ties go to the smaller key.
    """
    whole = isinstance(vectors.schema[vector].dataType.elementType, T.IntegralType)
    number, score_type = (np.int64, "bigint") if whole else (np.float64, "double")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), is_query.alias("asks")).filter(F.col("vector").isNotNull() & F.col("key").isNotNull())
    n = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    if not n[0]:
        return rows.select(F.col("key").alias("query"), F.col("key").alias("target"), F.lit(0).cast(score_type).alias("score"))
    b_rows, b_queries = max(-(-n[0] // row_block), min(-(-n[0] // 500), vectors.sparkSession.sparkContext.defaultParallelism)), max(1, -(-n[1] // block))
    cell = F.collect_list(F.struct("key", "vector"))
    held = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(b_rows).cast("bigint")).alias("row_block")).agg(cell.alias("rows"))
    asked = rows.filter("asks").groupBy(F.pmod(F.xxhash64("key"), F.lit(b_queries)).alias("query_block")).agg(cell.alias("queries"))
    # each block of queries goes to every block of rows: a pair of blocks is one row
    sent = asked.withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(b_rows - 1).cast("bigint"))))
    pairs = sent.join(held, "row_block").select("queries", "rows")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for queries, targets in zip(batch["queries"], batch["rows"]):
                q, t = (np.array([x["key"] for x in part]) for part in (queries, targets))
                a, b = (np.array([np.asarray(x["vector"], number) for x in part]) for part in (queries, targets))
                score = a @ b.T
                if not whole:
                    score[q[:, None] == t[None, :]] = -np.inf
                    kth = np.partition(score, -k, axis=1)[:, -k] if len(t) > k else np.full(len(q), -np.inf)
                    bound = 2 * a.shape[1] * np.finfo(float).eps * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
                    at, of = np.nonzero((score >= (kth - 2 * bound)[:, None]) & (q[:, None] != t[None, :]))
                    yield pd.DataFrame({"query": q[at], "target": t[of], "score": [math.fsum(a[i] * b[j]) for i, j in zip(at, of)]})
                    continue
                order = np.lexsort((np.broadcast_to(t, score.shape), -score, q[:, None] == t[None, :]), axis=1)[:, :k]
                found = pd.DataFrame({"query": np.repeat(q, order.shape[1]), "target": t[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()})
                yield found[found["query"] != found["target"]]

    kind = vectors.schema[key].dataType.simpleString()
    partial = pairs.mapInPandas(products, f"query {kind}, target {kind}, score {score_type}")
    return top_per_key(partial, ["query"], [("score", "descending"), ("target", "ascending")], k)
