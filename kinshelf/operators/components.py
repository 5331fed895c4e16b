"""Connected components of an edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinshelf.session import cut_lineage

#: Edges that a task contracts at once.
CHUNK = 1 << 19


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values in their order, and the values."""
    coded = pc.dictionary_encode(column).combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = pa.concat_arrays(coded.chunks) if coded.num_chunks else pa.array([], column.type).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, before[u], low)
        np.minimum.at(root, before[v], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def _contract(by: list[str]):
    """The stars of the edges that come together in one chunk, each with the number of its chunk."""

    def stars(table: pa.Table, chunk: int) -> pa.RecordBatch:
        ends, names = _codes(pa.chunked_array([*table["hi"].chunks, *table["lo"].chunks], table.schema.field("hi").type))
        group, groups = np.zeros(len(table), np.int64), []
        for column in by:
            codes, values = _codes(table[column])
            group = group * max(1, len(values)) + codes
            groups.append(values)
        keys, nodes = np.unique(np.tile(group, 2) * max(1, len(names)) + ends, return_inverse=True)
        root = _roots(nodes[: len(table)], nodes[len(table) :], len(keys))
        below = np.flatnonzero(root != np.arange(len(keys)))
        out, rest = [], keys[below] // max(1, len(names))
        for values in reversed(groups):
            out.insert(0, values.take(pa.array(rest % max(1, len(values)))))
            rest = rest // max(1, len(values))
        for end in (keys[below], keys[root[below]]):
            out.append(names.take(pa.array(end % max(1, len(names)))))
        out.append(pa.array(np.full(len(below), chunk)))
        return pa.RecordBatch.from_arrays(out, names=[*by, "hi", "lo", "chunk"])

    def each(batches):
        held, rows, chunk = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield stars(pa.Table.from_batches(held), chunk)
                held, rows, chunk = [], 0, chunk + 1
        if rows:
            yield stars(pa.Table.from_batches(held), chunk)

    return each


def _settle(pairs: DataFrame, by: list[str]) -> tuple[DataFrame, dict]:
    """Contract and materialise a round, counting and fingerprinting its pairs on the way."""
    seen = Observation()
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "hi", "lo"]) + ", chunk long"
    watched = pairs.select(*by, "hi", "lo").mapInArrow(_contract(by), schema).observe(
        seen,
        F.count(F.lit(1)).alias("pairs"),
        F.bit_xor(F.xxhash64(*by, "hi", "lo")).alias("fingerprint"),
        F.min("chunk").alias("first"),
        F.max("chunk").alias("last"),
    )
    return cut_lineage(watched).drop("chunk"), seen.get


def connected_components(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, doc_id, component)`` for each end of ``edges(*by, src, dst)``.

    ``component`` is the smallest id that can be reached. ``by`` names graphs that are
    worked on at once, each for itself. Every task contracts the edges it has to stars;
    if all edges came to one, as those of a small graph do, that is the result. Otherwise
    the two star operations of Kiveris et al. (2014) alternate: every node hangs its larger
    neighbours, then its smaller ones, below the smallest neighbour, until only stars are
    left. Rounds grow with the logarithm of the graph, and each is a pair of
    aggregations and equi-joins on pre-aggregated minima.
    """
    by = by or []
    high, low = F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")
    pairs, state = _settle(edges.where(F.col("src") != F.col("dst")).select(*by, high, low).distinct(), by)
    while state["pairs"] and state["first"] != state["last"]:
        both = pairs.select(*by, F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            pairs.select(*by, F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        # written first: a node with very many neighbours can then be split in the join
        nearest = cut_lineage(both.groupBy(*by, "u").agg(F.min("v").alias("m")))
        large = (
            both.join(nearest, [*by, "u"])
            .where(F.col("v") > F.col("u"))
            .select(*by, F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
            .distinct()
        )
        large = cut_lineage(large)
        lowest = cut_lineage(large.groupBy(*by, "hi").agg(F.min("lo").alias("m")))
        small = (
            large.join(lowest, [*by, "hi"])
            .select(*by, F.explode(F.array(F.struct("lo", "m"), F.struct(F.col("hi").alias("lo"), "m"))).alias("e"))
            .where("e.lo != e.m")
            .select(*by, F.col("e.lo").alias("hi"), F.col("e.m").alias("lo"))
            .distinct()
        )
        before = state
        pairs, state = _settle(small, by)
        if (before["pairs"], before["fingerprint"]) == (state["pairs"], state["fingerprint"]):
            break
    return pairs.select(*by, F.col("hi").alias("doc_id"), F.col("lo").alias("component")).unionAll(
        pairs.select(*by, F.col("lo").alias("doc_id"), F.col("lo").alias("component")).distinct()
    )


def nested_components(edges: DataFrame, levels: list[float]) -> DataFrame:
    """``(level, doc_id, component)`` of the ``edges(src, dst, sim)`` at or above each of ``levels``.

    All levels are one run, so they share its rounds. A node without an edge at a level
    has no row there.
    """
    numbers = F.array_compact(
        F.array(*[F.when(F.col("sim") >= limit, F.lit(i)) for i, limit in enumerate(levels)])
    )
    return connected_components(edges.select(F.explode(numbers).alias("level"), "src", "dst"), ["level"])
