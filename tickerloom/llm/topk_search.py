"""Exact top-k search by a uniform threshold in three phases.

Vectors are cut into slices; a slice of a block of candidates is a node that knows part
of every score.  (1) Each node ranks its block by its own part; the whole scores of the
leaders are gathered, and the k-th best of them over all blocks is a safe cutoff: the
k-th best of all can't be lower.  (2) The cutoff goes to all blocks with the queries; a
candidate whose score reaches it must reach an equal share of it in some slice, so each
node hands over the entries that do.  (3) What is missing of their scores is resolved
exactly, and the entries that reach the cutoff are ranked.

Equal vectors are one candidate (and one query) that carries its k + 1 smallest ids, so
copies of a vector cost one row each, however many there are.

Blocks of queries are sent to every block of candidates by a shuffle that brings both
together (never as a broadcast, which would pass the copies for all blocks through the
driver), as the smallest whole numbers that hold them.

Defined cases: a vector that is null or empty, or holds a null or a component that is
not finite, takes no part, nor does a row without id; vectors of another length than a
query's aren't compared with it; equal rows (same id and vector) are one row; ties go
to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: a block holds at most about so many bytes of vectors as doubles
BLOCK_BYTES = 4 << 20
#: queries of a block, and blocks of queries that meet a block of candidates at once
QUERY_ROWS = 256
QUERY_BLOCKS = 64
MOST_TASKS = 2000
BLOCK = "side_block int, dims int, ids array<long>, kind string, data binary"


def scaled(vector: Column, factor: int = 256) -> Column:
    """Components as floor(factor * x) in whole doubles; null if one is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("double"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & sound, whole)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """One row for each vector with its smallest ids: id (the smallest), ids (k + 1), vector."""
    keyed = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).dropDuplicates(["vec_id", "vector"])
    # the smallest ids per vector: reduced within parts of the ids first, so that no task meets all copies
    part = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    smallest = lambda ids: F.slice(F.sort_array(ids), 1, k + 1)
    few = part.groupBy("vector", "part").agg(smallest(F.collect_set("vec_id")).alias("ids"))
    return few.groupBy("vector").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("id", F.col("ids")[0])


def _packed(vectors: np.ndarray) -> tuple[str, bytes]:
    """Type and bytes of whole doubles in the smallest type that holds them."""
    most = np.abs(vectors).max(initial=0)
    kind = next((k for k in ("i1", "i2", "i4") if most <= np.iinfo(k).max), "f8")
    return kind, vectors.astype(kind).tobytes()


def _matrix(dims: int, kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dims).astype(np.float64)


def blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Vectors gathered in blocks of one length of vector."""
    numbered = rows.withColumn("side_block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("dims", F.size("vector"))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        kind, data = _packed(np.array(frame["vector"].tolist(), np.float64))
        return pd.DataFrame(
            {"side_block": frame["side_block"].iloc[:1], "dims": frame["dims"].iloc[:1], "ids": [frame["id"].tolist()], "kind": [kind], "data": [data]}
        )

    return numbered.groupBy("side_block", "dims").applyInPandas(gather, BLOCK)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a @ b.T


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of every row, in any order."""
    k = min(k, scores.shape[1])
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, slices: int = 4, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, id and score of the k best candidates of every query, its own row left out.

    ``queries`` are rows of ``vectors``.
    """
    prepare = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), scaled(F.col(f"`{vector_col}`"), factor).alias("vector"))
    asked = prepare(queries).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).dropDuplicates()
    points = cut_lineage(distinct_vectors(prepare(vectors), k))
    wanted = cut_lineage(asked.select("vector").distinct().join(points, "vector"))
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    per_block = max(64, BLOCK_BYTES // (8 * (size["d"] or 1)))
    n_blocks = max(1, -(-size["n"] // per_block))
    n_query_blocks = max(1, -(-wanted.count() // QUERY_ROWS))
    n_parts = -(-n_query_blocks // QUERY_BLOCKS)
    candidates = cut_lineage(blocks(points, n_blocks))
    asked_blocks = cut_lineage(
        blocks(wanted, n_query_blocks).select(F.col("side_block").alias("q_block"), "dims", *[F.col(c).alias(f"q_{c}") for c in ("ids", "kind", "data")])
    )

    def parts(dims: int) -> list[slice]:
        cuts = np.linspace(0, dims, min(slices, dims) + 1).astype(int)
        return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]

    def paired(asked_blocks: DataFrame, fn: Callable[[tuple, tuple], pd.DataFrame], schema: str) -> DataFrame:
        """Rows that ``fn`` gives for every block of queries with every block of candidates of its length."""

        def each(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            found = [fn(q, c) for c in own.itertuples() for q in asked.itertuples()]
            return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        key = ["side_block", "q_part", "dims"]
        # the driver keeps an entry for each task, so their number is bounded
        dealt = lambda df: df.repartition(min(n_blocks * n_parts, MOST_TASKS), *key).groupBy(*key)
        sent = asked_blocks.withColumn("side_block", every(n_blocks)).withColumn("q_part", F.floor(F.col("q_block") / QUERY_BLOCKS).cast("int"))
        return dealt(sent).cogroup(dealt(candidates.withColumn("q_part", every(n_parts)))).applyInPandas(each, schema)

    def leaders(r: tuple, own: tuple) -> pd.DataFrame:
        q, c = _matrix(r.dims, r.q_kind, r.q_data), _matrix(own.dims, own.kind, own.data)
        found = np.concatenate([_top(_exact(q[:, s], c[:, s]), k + 1) for s in parts(r.dims)], axis=1)
        out = []
        for i in range(len(q)):
            best = np.unique(found[i])
            out.append(np.sort(_exact(q[i : i + 1], c[best])[0])[::-1][: k + 1].astype(np.int64).tolist())
        return pd.DataFrame({"q_block": r.q_block, "dims": r.dims, "query": r.q_ids, "scores": out})

    gathered = paired(asked_blocks, leaders, "q_block int, dims int, query long, scores array<long>").select(
        "q_block", "dims", "query", F.explode("scores").alias("score")
    )
    # the (k+1)-th best of the gathered scores: each block gives k + 1 at most
    best = gathered.groupBy("q_block", "dims", "query").agg(
        F.element_at(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k + 1), -1).alias("kth"),
        F.count(F.lit(1)).alias("n"),
    )
    # with fewer gathered than k + 1 there are no more candidates; nothing may be cut off then
    cutoffs = best.groupBy("q_block", "dims").agg(
        F.sort_array(F.collect_list(F.struct("query", F.when(F.col("n") > k, F.col("kth")).alias("cutoff")))).alias("cutoffs")
    )

    def resolve(r: tuple, own: tuple) -> pd.DataFrame:
        q, c = _matrix(r.dims, r.q_kind, r.q_data), _matrix(own.dims, own.kind, own.data)
        cut = {x["query"]: x["cutoff"] for x in r.cutoffs}
        low = np.array([np.iinfo(np.int64).min if cut.get(i) is None else cut[i] for i in r.q_ids], np.float64)
        cells = parts(r.dims)
        reach = np.zeros((len(q), len(c)), bool)
        for s in cells:
            reach |= _exact(q[:, s], c[:, s]) >= (low / len(cells))[:, None]
        at, who = np.nonzero(reach)
        ids = np.array(own.ids)
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        for begin in range(0, len(at), 200_000):
            a, w = at[begin : begin + 200_000], who[begin : begin + 200_000]
            if np.abs(q).max() * np.abs(c).max() * r.dims >= 2**53:
                scores = np.einsum("ij,ij->i", q[a].astype(np.int64), c[w].astype(np.int64))
            else:
                scores = np.einsum("ij,ij->i", q[a], c[w]).astype(np.int64)
            keep = scores >= low[a]
            # a block gives k + 1 entries of a query at most; each stands for one row or more, its smallest id first
            a, w, scores = a[keep], w[keep], scores[keep]
            order = np.lexsort((ids[w], -scores, a))
            first = np.searchsorted(a[order], a[order], "left")
            order = order[np.arange(len(order)) - first <= k]
            out.append(pd.DataFrame({"query": np.array(r.q_ids)[a[order]], "id": ids[w[order]], "score": scores[order]}))
        return pd.concat(out)

    entries = paired(asked_blocks.hint("merge").join(cutoffs, ["q_block", "dims"]), resolve, "query long, id long, score long")
    # back to rows: each query vector stands for its rows, each candidate for its smallest ids
    ids = points.select("id", "ids")
    hits = entries.join(ids, "id").select("query", "score", F.explode("ids").alias("vec_id"))
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    near = hits.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= k + 1)
    lists = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id"))).alias("hits"))
    rows = asked.select(F.col("vec_id").alias("query_id"), "vector").join(points.select("vector", F.col("id").alias("query")), "vector").select("query_id", "query")
    own_out = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return (
        rows.join(lists, "query")
        .select("query_id", F.posexplode(own_out).alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))
    )
