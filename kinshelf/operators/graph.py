"""Components of similar vectors, kept while documents come, change and go.

A node is a distinct vector, so copies cost nothing and a copy that goes takes nothing
along. What is kept are the components at every level, not the similar pairs: pairs would
grow with the square of a crowd, and components are all that clustering asks for.

New nodes are compared with all others in one pass over the vectors, which do not move,
and join the components they meet. A node that goes may have held its component together;
the nodes that are left of it are compared anew, and no others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinshelf.operators.components import connected_components, nested_components
from kinshelf.operators.dense import as_matrix, dense_links, forest_links
from kinshelf.session import cut_lineage, fresh_path, number_rows

#: Most bytes of new vectors that are broadcast at once.
BLOCK_BYTES = 16 << 20


@dataclass
class Graph:
    """``members(doc_id, node)`` with a NULL node for zero vectors, ``vectors(node, embedding)``
    and ``components(level, node, component)``; a node that is alone at a level has no row there.
    ``levels`` are the similarities that the components were made for."""

    members: DataFrame
    vectors: DataFrame
    components: DataFrame
    levels: list[float] = field(default_factory=list)


def node_of(embedding: Column) -> Column:
    """What equal vectors share; NULL for a vector of zeros, which is like no other."""
    told = F.sha2(F.array_join(embedding.cast("array<double>"), " "), 256)
    return F.when(F.exists(embedding, lambda x: x != 0), told)


def _nodes(documents: DataFrame) -> DataFrame:
    given = documents.where(F.col("embedding").isNotNull())
    return cut_lineage(given.select("doc_id", node_of(F.col("embedding")).alias("node"), "embedding"))


def _vectors(nodes: DataFrame) -> DataFrame:
    known = nodes.where(F.col("node").isNotNull())
    return known.groupBy("node").agg(F.first("embedding").cast("array<double>").alias("embedding"))


def _linked(vectors: DataFrame, levels: list[float], by: list[str] | None = None) -> DataFrame:
    """``(level, node, component)`` of vectors that are compared with each other, within ``by``."""
    named = vectors.select(*(by or []), F.col("node").alias("doc_id"), "embedding")
    links = cut_lineage(dense_links(named, levels[0], by).select("src", "dst", "sim"))
    return nested_components(links, levels).select("level", F.col("doc_id").alias("node"), "component")


def build_graph(documents: DataFrame, levels: list[float]) -> Graph:
    """The graph of ``documents(doc_id, embedding)`` at ascending similarity ``levels``."""
    nodes = _nodes(documents)
    vectors = cut_lineage(_vectors(nodes))
    return Graph(nodes.select("doc_id", "node"), vectors, cut_lineage(_linked(vectors, levels)), levels)


def links_with(fresh: DataFrame, vectors: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs ``(src, dst, sim)`` of ``fresh`` and other ``vectors`` that connect as all similar pairs do.

    Both are ``(node, embedding)``. ``fresh`` goes to the tasks in blocks of bounded size, one
    pass over the vectors for each; a task gives back a spanning forest of what it compared.
    """
    spark = fresh.sparkSession
    schema = "src string, dst string, sim double"
    numbered = number_rows(fresh, [], [F.col("node")])
    count, width = numbered.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not count:
        return spark.createDataFrame([], schema)
    path, per_block = fresh_path(spark, "links"), max(1, block_bytes // (8 * max(1, width)))
    for first in range(0, count, per_block):
        own = numbered.where(F.col("ordinal").between(first + 1, first + per_block)).orderBy("ordinal")
        table = own.select("node", "embedding").toArrow()
        shared = spark.sparkContext.broadcast((table["node"].combine_chunks(), as_matrix(table["embedding"])))

        def compare(batches):
            names, matrix = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                src, dst, sims = forest_links(matrix, as_matrix(pa.chunked_array([batch.column(1)])), threshold, False)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(src)), batch.column(0).take(pa.array(dst)), pa.array(sims)],
                    names=["src", "dst", "sim"],
                )

        vectors.select("node", "embedding").mapInArrow(compare, schema).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def _without(components: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``components`` that lost no node, and ``(node, touched)``: what is left of the others.

    A component of the first level holds those of all higher levels of its nodes.
    """
    first = components.where("level = 0").select("node", F.col("component").alias("touched"))
    hit = cut_lineage(first.join(gone, "node", "left_semi").select("touched").distinct())
    affected = cut_lineage(first.join(hit, "touched", "left_semi"))
    whole = components.join(affected.select("node"), "node", "left_anti")
    return whole, affected.join(gone, "node", "left_anti")


def _joined(components: DataFrame, links: DataFrame, levels: list[float]) -> DataFrame:
    """``components`` after new ``links(src, dst, sim)``; only the components that these touch are looked at."""
    numbers = F.array_compact(F.array(*[F.when(F.col("sim") >= t, F.lit(i)) for i, t in enumerate(levels)]))
    ends = links.select(F.explode(numbers).alias("level"), "src", "dst")
    for end in ("src", "dst"):
        named = components.select("level", F.col("node").alias(end), F.col("component").alias("_of"))
        ends = ends.join(named, ["level", end], "left").withColumn(end, F.coalesce("_of", end)).drop("_of")
    merged = cut_lineage(connected_components(cut_lineage(ends.distinct()), ["level"]))
    names = merged.select("level", F.col("doc_id").alias("_old"), F.col("component").alias("_new"))
    old = components.withColumnRenamed("component", "_old").join(names, ["level", "_old"], "left")
    kept = old.select("level", "node", F.coalesce("_new", "_old").alias("component"))
    alone = merged.withColumnRenamed("doc_id", "node").join(components, ["level", "node"], "left_anti")
    return kept.unionByName(alone.select("level", "node", "component"))


def change_graph(graph: Graph, changed: DataFrame, gone: DataFrame, levels: list[float]) -> Graph:
    """The graph after ``changed(doc_id, embedding)`` came or changed, and ``gone(doc_id)`` went.

    The same as ``build_graph`` of the documents there are then. A document in both is gone.
    """
    changed = _nodes(changed.join(gone, "doc_id", "left_anti"))
    touched = gone.select("doc_id").unionAll(changed.select("doc_id")).distinct()
    rest = graph.members.join(touched, "doc_id", "left_anti")
    members = cut_lineage(rest.unionByName(changed.select("doc_id", "node")))

    dealt = graph.members.join(touched, "doc_id", "left_semi").select("node").where(F.col("node").isNotNull())
    lost = cut_lineage(dealt.distinct().join(members.select("node"), "node", "left_anti"))
    fresh = cut_lineage(_vectors(changed).join(graph.vectors.select("node"), "node", "left_anti"))
    kept = cut_lineage(graph.vectors.join(lost, "node", "left_anti"))

    whole, loose = _without(graph.components, lost)
    again = _linked(kept.join(cut_lineage(loose), "node"), levels, ["touched"])
    components = cut_lineage(whole.unionByName(again))
    if not fresh.isEmpty():
        among = dense_links(fresh.select(F.col("node").alias("doc_id"), "embedding"), levels[0])
        new = links_with(fresh, kept, levels[0]).unionByName(among.select("src", "dst", "sim"))
        components = cut_lineage(_joined(components, cut_lineage(new), levels))
    return Graph(members, cut_lineage(kept.unionByName(fresh)), components, levels)


def document_components(graph: Graph, copies: DataFrame) -> DataFrame:
    """``(level, doc_id, component)`` of the documents in ``copies(doc_id, rep, n)``.

    Copies are similar at every level, also where no other vector is near them. A component is
    named after its smallest document, as ``level_components`` does; a document that comes with
    several vectors joins what each of them meets.
    """
    known = graph.members.where(F.col("node").isNotNull())
    known = cut_lineage(known.join(copies.select("doc_id"), "doc_id", "left_semi").select("doc_id", "node").distinct())
    levels = F.array(*[F.lit(i) for i, limit in enumerate(graph.levels) if limit <= 1]).cast("array<int>")
    several = known.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = several.select(F.explode(levels).alias("level"), "node")
    alone = several.join(graph.components, ["level", "node"], "left_anti")
    components = graph.components.unionByName(alone.select("level", "node", F.col("node").alias("component")))
    placed = cut_lineage(known.join(components, "node").select("level", "doc_id", "component").distinct())
    bridges = placed.groupBy("level", "doc_id").agg(F.min("component").alias("src"), F.collect_set("component").alias("_of"))
    bridges = cut_lineage(bridges.where(F.size("_of") > 1).select("level", "src", F.explode("_of").alias("dst")))
    if not bridges.isEmpty():
        merged = connected_components(bridges, ["level"]).select("level", F.col("doc_id").alias("component"), F.col("component").alias("_one"))
        placed = placed.join(merged, ["level", "component"], "left").select(
            "level", "doc_id", F.coalesce("_one", "component").alias("component")
        )
        placed = cut_lineage(placed.distinct())
    ends = placed.groupBy("level", "component").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    named = cut_lineage(ends.where(F.col("first") != F.col("last")))
    return placed.join(named, ["level", "component"]).select("level", "doc_id", F.col("first").alias("component"))
