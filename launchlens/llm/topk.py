"""Exact top-k search by columnar branch and bound.

Candidates are dealt into blocks held dimension by dimension. A block adds up the
inner products of all its vectors a few dimensions at a time; after each step a
vector stays only if its sum so far plus the most that the remaining dimensions can
add (their norms multiplied) reaches the query's k-th best lower bound. The survivors are compacted, so later dimensions touch few vectors. Blocks give their k best,
and these are merged for each query.

Queries and candidates meet in blocks of bounded size; a vector is sent once for each
block of the other side. Sums are exact integers in double precision (components
of up to 2^20 and 2^12 dimensions); larger ones fall back to Python integers.

Cases: a null vector, or one with a null or non-finite component, takes no part;
shorter vectors count as ending in zeros; a query is compared with all rows of
another id, so repeated ids are candidates of others but not of themselves; ties go
to the smaller id; fewer than k candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 2048
DIMENSIONS_AT_ONCE = 16


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and ``v`` (array<bigint>): floor(scale * x) of each component; vectors with missing or non-finite parts are left out."""
    real = F.transform(F.col(vector), lambda x: x.cast("double"))
    odd = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull()).where(~odd).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(real, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(v, np.int64) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _packed(rows: DataFrame, size: int, blocks: int, others: int, own: str, other: str) -> DataFrame:
    """Vectors as bytes with the number of their block, once for each block of the other side."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, np.int64).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "packed": pa.array(vectors, pa.binary())})

    packed = rows.select("vec_id", "v").mapInArrow(pack, "vec_id long, packed binary")
    return packed.select("vec_id", "packed", F.pmod(F.xxhash64("vec_id", "packed"), F.lit(blocks)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of the block (id, score), by branch and bound over blocks of dimensions."""
    width = max(queries.shape[1], block.shape[1])
    queries, block = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, block))
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * width
    kind = np.float64 if most < 2 ** 52 else object
    columns = np.ascontiguousarray(block.T.astype(kind))
    queries = queries.astype(kind)
    steps = range(0, width, DIMENSIONS_AT_ONCE)
    # norms of what lies beyond each step, rounded up
    beyond = [(_tail_norm(queries, s + DIMENSIONS_AT_ONCE), _tail_norm(block, s + DIMENSIONS_AT_ONCE)) for s in steps]
    first = queries[:, :DIMENSIONS_AT_ONCE] @ columns[:DIMENSIONS_AT_ONCE]
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[q])
        sums = first[q][alive] if width else np.zeros(len(alive))
        for s, (query_rest, block_rest) in zip(steps, beyond, strict=True):
            if s:
                sums = sums + queries[q, s: s + DIMENSIONS_AT_ONCE] @ columns[s: s + DIMENSIONS_AT_ONCE, alive]
            if len(alive) > k:
                slack = query_rest[q] * block_rest[alive]
                lower = (sums - slack).astype(np.float64)
                bar = np.partition(lower, len(lower) - k)[len(lower) - k]
                keep = (sums + slack).astype(np.float64) >= bar
                alive, sums = alive[keep], sums[keep]
        order = np.lexsort((ids[alive], -sums))[:k]
        yield q, ids[alive[order]], sums[order]


def _tail_norm(vectors: np.ndarray, begin: int) -> np.ndarray:
    tail = vectors[:, begin:].astype(np.float64)
    return np.sqrt((tail * tail).sum(1)) * (1 + 1e-9) + 1e-6 * (tail.shape[1] > 0)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long) of ``queries`` against all of ``candidates`` (both vec_id, v)."""
    n_queries, n_candidates = queries.count(), candidates.count()
    query_blocks, candidate_blocks = -(-max(1, n_queries) // QUERY_BLOCK), -(-max(1, n_candidates) // CANDIDATE_BLOCK)
    left = _packed(queries, QUERY_BLOCK, query_blocks, candidate_blocks, "qb", "cb")
    right = _packed(candidates, CANDIDATE_BLOCK, candidate_blocks, query_blocks, "cb", "qb")

    def search(key: tuple, wanted: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, query_ids = block["vec_id"].to_numpy(), wanted["vec_id"].to_numpy()
        out = [(query_ids[q], i, int(s)) for q, found, sums in best_in_block(
            _matrix(list(wanted["packed"])), query_ids, _matrix(list(block["packed"])), ids, k) for i, s in zip(found, sums, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    ranked = met.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
