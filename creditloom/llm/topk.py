"""Exact top-k inner-product search by MaxScore over a sharded inverted index.

A term is a dimension with a sign; its postings are the vectors of a shard whose component has the query component's
sign there, so a posting adds to the score and its bound is the largest such addition. Terms are taken by falling
bound. While the bounds of the terms still to come add up to the k-th best score or more, the next term is essential
and its postings are traversed; after that the rest are only probed, term by term, for candidates that can still get
in. Components of the other sign only lower a score. Vectors that no essential posting holds score at most the sum
of the other bounds, so leaving them out is exact. Shards return their own best k and these are merged.

Vectors that are null or hold a null or non-finite component take no part. Vectors may differ in length: missing
components count as 0. Ties go to the smaller id. Empty tables give no rows. Null ids take no part. Rows that repeat
an id are candidates of their own, but a query never meets rows of its own id. A query's rows of a repeated id are queries
of their own, and their results are ranked together. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS, QUERY_ROWS, LEAST_GROUPS, LEAST_QUERIES = 16_384, 4_096, 64, 128


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """Rows (id, vec): floor(scale * x) of every component, of vectors whose components are all finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("vec"))


class Shard:
    """Vectors of one shard with their postings: for each dimension, the rows by falling component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.top, self.low = self.columns.max(1), self.columns.min(1)
        self.up = [np.flatnonzero(c > 0) for c in self.columns]
        self.down = [np.flatnonzero(c < 0) for c in self.columns]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of the query's own id, ties to smaller ids."""
        n_dims = min(len(query), len(self.columns))
        q = query[:n_dims]
        bound = np.maximum(np.where(q > 0, q * self.top[:n_dims], q * self.low[:n_dims]), 0)
        terms = np.argsort(-bound, kind="stable")
        terms = terms[q[terms] != 0]
        rest = np.concatenate((np.cumsum(bound[terms][::-1])[::-1], [0]))
        seen = np.zeros(len(self.ids), bool)
        a, b = np.searchsorted(self.ids, [own, own + 1])
        seen[a:b] = True
        best, scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for at in range(len(terms) + 1):
            if floor is not None and rest[at] < floor:
                break
            if at < len(terms):
                d = terms[at]
                post = self.up[d] if q[d] > 0 else self.down[d]
                rows = post[~seen[post]]
            else:  # rows without a posting of any term still count when the k-th score is not above 0
                rows = np.flatnonzero(~seen)
            seen[rows] = True
            # Rows new at this term have no posting of an earlier one, so earlier terms only lower their scores.
            partial = np.zeros(len(rows), np.int64)
            for j in [*range(at, len(terms)), *range(at)]:
                if not len(rows):
                    break
                d = terms[j]
                partial += q[d] * self.columns[d][rows]
                left = rest[j + 1] if j >= at else 0
                if floor is not None and j % 4 == 3:
                    live = partial + left >= floor
                    rows, partial = rows[live], partial[live]
            best, scores = np.concatenate((best, rows)), np.concatenate((scores, partial))
            if len(best) > k:
                order = np.lexsort((best, -scores))[:k]
                best, scores = best[order], scores[order]
            if len(best) == k:
                floor = scores.min()
        order = np.lexsort((best, -scores))
        return self.ids[best[order]], scores[order]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if len(values) == out.size:
        return values.reshape(out.shape)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of rows (id, vec).

    Shards of about shard_rows vectors meet blocks of about query_rows queries, so a task holds one of each.
    """
    n, queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-queries // query_rows))
    # A table of few shards has smaller blocks, so that its groups occupy the cluster.
    blocks = max(blocks, min(-(-LEAST_GROUPS // shards), -(-queries // LEAST_QUERIES)))
    spread = lambda parts, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = vectors.select("id", "vec", F.lit(False).alias("is_query"), spread(shards, 1).alias("shard"), every(blocks).alias("block"))
    asked = vectors.where(is_query).select("id", "vec", F.lit(True).alias("is_query"), every(shards).alias("shard"), spread(blocks, 2).alias("block"))

    def search(table: pa.Table) -> pa.Table:
        of = table.column("is_query").to_numpy()
        width = int(np.diff(table.column("vec").combine_chunks().offsets.to_numpy()).max(initial=0))
        matrix, ids = _matrix(table.column("vec"), width), table.column("id").to_numpy()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        if (~of).any():
            shard = Shard(ids[~of], matrix[~of])
            for own, q in zip(ids[of], matrix[of], strict=True):
                found, scores = shard.search(q, own, k)
                for column, values in zip(out, (np.full(len(found), own), found, scores), strict=True):
                    column.append(values)
        return pa.table([np.concatenate(c) for c in out], ["query_id", "vec_id", "score"])

    found = candidates.unionByName(asked).groupBy("shard", "block").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return exact_top_k(vectors, F.col("id") % 50 == 0)


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vec
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
