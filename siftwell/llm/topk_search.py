"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights over terms (the dimensions). Rows are numbered in a stored table, and
candidates dealt into blocks by a hash of that number; a block stores postings, per term the slots that hold it and their weights. Queries are dealt into chunks
the same way. Every chunk meets every block (chunks are repeated, as queries are the fewer): each query row scatters its weighted postings into a dense score array
over the block's slots, a partition selection takes the block's best, and a window over the blocks' few best merges
them. Blocks and chunks have a bounded number of rows, whatever one source or copied vector makes of the table.

Defined cases: null vectors, and those with a null or non-finite component, take no part (nor do rows without an
id); every row but the query's own is a candidate, so rows that repeat an id or a vector count each, and a query row that
repeats an id has its own answer; ties go to the smaller id; absent components weigh 0; with fewer candidates than k, all
are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, stored, tidy

BLOCK_ROWS = 8192
CHUNK_ROWS = 1024


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component, or null for vectors that take no part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """The rows packed into blocks: name, their numbers, ids, lengths, weights (all of a block end to end)."""
    parts = max(1, -(-rows.count() // size))
    dealt = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(parts)).alias(name)).agg(F.collect_list(F.struct("row", "vec_id", "weights")).alias("held"))
    return dealt.select(name, F.col("held.row").alias(f"{name}_rows"), F.col("held.vec_id").alias(f"{name}_ids"), F.transform("held.weights", F.size).alias(f"{name}_sizes"), F.flatten("held.weights").alias(f"{name}_weights")), parts


def _rows(sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-zero entries as row, term, weight."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = weights != 0
    return row[some], term[some], weights[some]


def best_in_block(q_rows: np.ndarray, q: tuple, b_rows: np.ndarray, b_ids: np.ndarray, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's place, candidate id, score of each query's k best in the block."""
    slot, term, weight = b
    order = np.argsort(term, kind="stable")
    slot, weight = slot[order], weight[order]
    n_terms = int(max(term.max(initial=-1), q[1].max(initial=-1))) + 1
    ends = np.searchsorted(term[order], np.arange(n_terms + 1))
    q_first = np.searchsorted(q[0], np.arange(len(q_rows) + 1))
    full = [int(ends[t + 1] - ends[t]) == len(b_ids) for t in range(n_terms)]
    out = []
    for at, query in enumerate(q_rows.tolist()):
        scores = np.zeros(len(b_ids), dtype=np.int64)
        for e in range(q_first[at], q_first[at + 1]):
            t, w = q[1][e], q[2][e]
            own = slice(ends[t], ends[t + 1])
            if full[t]:
                scores += weight[own] * w  # every slot holds the term, in order
            else:
                scores[slot[own]] += weight[own] * w
        others = np.flatnonzero(b_rows != query)
        mine = scores[others]
        if len(others) > k:
            least = np.partition(mine, len(mine) - k)[len(mine) - k]
            others = others[mine >= least]  # ties at the cut stay until ids decide
            mine = scores[others]
        top = np.lexsort((b_ids[others], -mine))[:k]
        out.append((np.full(len(top), at), b_ids[others][top], mine[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """rows: vec_id, weights array<long>. Returns query_id, rank, vec_id, score."""
    frugal(rows.sparkSession)
    rows = stored(rows.where("vec_id is not null and weights is not null").select(F.monotonically_increasing_id().alias("row"), "vec_id", "weights"))
    blocks, n_blocks = _dealt(rows, BLOCK_ROWS, "block")
    chunks, _ = _dealt(rows.where(is_query), CHUNK_ROWS, "chunk")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    # Repeated chunks look as small as the chunks themselves, so the planner would send all repeats through the driver.
    met = blocks.join(chunks.withColumn("block", everywhere).hint("merge"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {x: batch.column(x)[k_row].values.to_numpy(zero_copy_only=False) for x in batch.schema.names if x not in ("chunk", "block")}
                at, *best = best_in_block(row["chunk_rows"], _rows(row["chunk_sizes"], row["chunk_weights"]), row["block_rows"], row["block_ids"], _rows(row["block_sizes"], row["block_weights"]), k)
                found = (row["chunk_rows"][at], row["chunk_ids"][at], *best)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query", "query_id", "vec_id", "score"])

    found = met.mapInArrow(tidy(run), "query bigint, query_id bigint, vec_id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vector_top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """top_k over a table of vec_id and embedding, its components turned to integers."""
    return top_k(table.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("weights")), is_query, k)
