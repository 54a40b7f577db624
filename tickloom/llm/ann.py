"""Nearest neighbours by randomly rotated one-bit codes.

Unit vectors are turned by one seeded rotation and kept as one bit per
dimension plus a correction scalar, the inner product of the vector with its own
code. The inner product of a query with the code, divided by that scalar,
estimates the cosine; its error is bounded by the scalar with high probability.
A query first scores its best estimates exactly, and then every vector whose
upper bound reaches the k-th best of those. No list of candidates is cut.

Queries and vectors meet in blocks of bounded size, dealt by hash; each block
pair gives the k best per query, and the k best of those remain. Equal vectors
score equally, so ties go to the smaller id. Rows with a null id, a null, zero
or empty vector, null or non-finite components, or another length than the
first vector take no part. A row does not find rows of its own id; a repeated
query id asks once. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.texts import ready_workers
from tickloom.session import materialise

ERROR = 3.0
QUERY_BLOCK = 2048
VECTOR_BLOCK = 8192
CODES = "vec_id long, vector binary, code binary, scale double"
FOUND = "query_id long, vec_id long, score double"


def rotation(dims: int) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(8).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part."""
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return table.where(F.col("vec_id").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))


def encoded(table: DataFrame, dims: int) -> DataFrame:
    """Vector, packed code and correction scalar of each usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            if batch.num_rows:
                own = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                turned = unit(own) @ turn
                columns = [
                    batch.column("vec_id"),
                    pa.array([v.tobytes() for v in own], pa.binary()),
                    pa.array([c.tobytes() for c in np.packbits(turned > 0, axis=1)], pa.binary()),
                    pa.array(np.abs(turned).sum(axis=1) / np.sqrt(dims)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "code", "scale"])

    return table.where(F.size("embedding") == dims).mapInArrow(run, CODES)


def search_block(asked: pd.DataFrame, block: pd.DataFrame, dims: int, k: int, error: float) -> pd.DataFrame:
    """The k nearest of a block of vectors for each query of a block."""
    block = block.sort_values("vec_id", kind="stable")
    ids = block["vec_id"].to_numpy()
    own = np.frombuffer(b"".join(block["vector"]), np.float64).reshape(-1, dims)
    norms = np.sqrt((own * own).sum(axis=1))
    packed = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(ids), -1)
    signs = np.unpackbits(packed, axis=1, count=dims).astype(np.float32) * 2 - 1
    scale = block["scale"].to_numpy()
    bound = error * np.sqrt(np.maximum(0, 1 - scale**2)) / scale / np.sqrt(max(1, dims - 1)) + 1e-5
    queries = np.frombuffer(b"".join(asked["vector"]), np.float64).reshape(-1, dims)
    turned = (unit(queries) @ rotation(dims)).astype(np.float32)
    rows = []
    for a in range(0, len(queries), 256):
        estimate = (turned[a : a + 256] @ signs.T) / np.sqrt(dims) / scale
        for query_id, query, guess in zip(asked["query_id"].iloc[a : a + 256], queries[a : a + 256], estimate):
            norm = np.sqrt((query * query).sum())
            guess[ids == query_id] = -np.inf
            reach = min(4 * k, len(ids))
            first = np.argpartition(-guess, reach - 1)[:reach]
            exact = np.sort((own[first] * query).sum(axis=1) / (norms[first] * norm))[::-1]
            least = exact[min(k, len(exact)) - 1] if len(exact) >= k else -np.inf
            at = np.flatnonzero((guess + bound >= least) & (ids != query_id))
            score = (own[at] * query).sum(axis=1) / (norms[at] * norm)
            best = np.lexsort((ids[at], -score))[:k]
            rows += zip([query_id] * len(best), ids[at][best].tolist(), score[best].tolist())
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: str, k: int = 5, error: float = ERROR) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each row for which
    the SQL condition `is_query` on vec_id holds."""
    spark = vectors.sparkSession
    ready_workers(spark)
    table = usable(vectors)
    dims = table.agg(F.min_by(F.size("embedding"), "vec_id")).first()[0] or 1
    codes = materialise(encoded(table, dims), "codes")
    asked = codes.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    n_vectors, n_queries = codes.agg(F.count("*"), F.count_if(F.expr(is_query))).first()
    vector_blocks, query_blocks = -(-n_vectors // VECTOR_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1

    def dealt(frame: DataFrame, column: str, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        own = F.pmod(F.xxhash64(column), F.lit(blocks).cast("long")).alias(mine)
        return frame.select("*", own, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    left = dealt(asked, "query_id", "q", query_blocks, "v", vector_blocks).groupBy("q", "v")
    right = dealt(codes, "vec_id", "v", vector_blocks, "q", query_blocks).groupBy("q", "v")

    def search(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(asked, block, dims, k, error)

    found = left.cogroup(right).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
