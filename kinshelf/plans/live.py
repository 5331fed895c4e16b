"""A catalog that follows changes: every batch is clustered anew and published as a version.

A version has, besides the catalog tables, what clustering needs of every document: its
words, and the graph of vectors. A batch reads the texts of the changed documents only,
makes vectors for content that has none, and updates the components that it touches.
Names, sizes and moves are then worked out as in a full run, and come out the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinshelf.config import Settings
from kinshelf.functions.fixed_values import NAMING_IGNORE, STOP_WORDS
from kinshelf.functions.paths import file_name
from kinshelf.functions.text import UNICODE_WORD
from kinshelf.operators.catalog import reassign_all
from kinshelf.operators.features import document_tokens, hashed_terms, represented, vectors_by_content
from kinshelf.operators.graph import Graph, build_graph, change_graph, document_components
from kinshelf.operators.spaces import DenseSpace
from kinshelf.plans.organize import Collection, cluster_centroids, recluster
from kinshelf.session import cut_lineage
from kinshelf.sources.catalog_io import (
    CLUSTERS_SCHEMA,
    FILES_SCHEMA,
    complete_columns,
    latest_version,
    publish_version,
    read_version,
)

TABLES = ("files", "clusters", "moves", "tokens", "members", "vectors", "components")


@dataclass
class LiveCatalog:
    """Versions in the folder ``catalog``; readers take the latest one that is complete.

    ``vectorize`` turns ``(doc_id, text)`` into ``(doc_id, embedding)``, each from its own text
    alone; the default hashes words. ``clusters``, ``assignments`` in ``files.cluster_id`` and
    ``moves(doc_id, folder)`` are those of a full run over the documents there are.
    Documents stay where they are; carrying out the moves is the caller's, and comes back
    as changes.
    """

    spark: SparkSession
    catalog: str
    settings: Settings = Settings()
    vectorize: Callable[[DataFrame], DataFrame] | None = None
    word: str = UNICODE_WORD
    ignore: list[str] = field(default_factory=lambda: list(NAMING_IGNORE))
    stop_words: list[str] = field(default_factory=lambda: list(STOP_WORDS))

    @property
    def levels(self) -> list[float]:
        return [self.settings.threshold_at(depth) for depth in range(self.settings.max_depth + 1)]

    def tables(self) -> dict[str, DataFrame]:
        """The tables of the latest version."""
        version = latest_version(self.spark, self.catalog)
        return {name: read_version(self.spark, self.catalog, name, version) for name in TABLES}

    def _words(self, docs: DataFrame) -> DataFrame:
        given = docs.select(F.col("file_path").alias("doc_id"), "filename", "text")
        return document_tokens(given, filename="filename", ignore=self.ignore, word=self.word)

    def _vectors(self, files: DataFrame, docs: DataFrame) -> DataFrame:
        made = vectors_by_content(files, docs, self.vectorize or self._hashed)
        return cut_lineage(made)

    def _hashed(self, docs: DataFrame) -> DataFrame:
        return hashed_terms(document_tokens(docs, ignore=self.ignore, word=self.word))

    def begin(self, described: DataFrame) -> None:
        """The first version, from all documents as ``describe_documents`` makes them."""
        described = cut_lineage(described)
        vectors = self._vectors(complete_columns(described.limit(0), FILES_SCHEMA), described)
        files = complete_columns(described.drop("text").join(vectors, "file_path", "left"), FILES_SCHEMA)
        graph = build_graph(vectors.withColumnRenamed("file_path", "doc_id"), self.levels)
        files = cut_lineage(files.select(*FILES_SCHEMA.names))
        self._publish(1, None, files, cut_lineage(self._words(described)), graph, None)

    def apply(
        self, batch: DataFrame, batch_id: int, describe: Callable[[DataFrame], DataFrame], stream: str = "changes"
    ) -> int:
        """Publish the version after one batch ``(action, path)``; returns its number.

        ``describe`` turns ``(file_path)`` into described documents with ``text``, leaving out
        paths it cannot read; their rows stay. A path in both actions ends deleted. A batch that
        was published already, by ``batch_id`` of ``stream``, is not applied again, and what an
        unfinished attempt has left is overwritten.
        """
        version = latest_version(self.spark, self.catalog)
        marks = self.spark.read.parquet(f"{self.catalog}/v*/complete")
        done = marks.where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).agg(F.max("version")).first()[0]
        if done is not None:
            return done
        now = {name: read_version(self.spark, self.catalog, name, version) for name in TABLES}
        path = F.col("path").alias("file_path")
        gone = cut_lineage(batch.where(F.col("action") == "deleted").select(path).distinct())
        changed = batch.where(F.col("action") == "changed").select(path).distinct()
        described = cut_lineage(describe(changed.join(gone, "file_path", "left_anti")))

        vectors = self._vectors(now["files"], described)
        carried = ["file_path", "cluster_id", "confidence_score", "denied_folder_path", "proposed_cluster_id"]
        rows = described.drop("text", *carried[1:], "embedding").join(vectors, "file_path", "left")
        rows = rows.join(now["files"].select(*carried), "file_path", "left")  # a denial outlives an edit
        touched = cut_lineage(described.select("file_path").unionAll(gone))
        files = now["files"].join(touched, "file_path", "left_anti").unionByName(
            complete_columns(rows, FILES_SCHEMA).select(*FILES_SCHEMA.names)
        )
        names = touched.withColumnRenamed("file_path", "doc_id")
        tokens = now["tokens"].join(names, "doc_id", "left_anti").unionByName(self._words(described))
        graph = change_graph(
            Graph(now["members"], now["vectors"], now["components"]),
            vectors.withColumnRenamed("file_path", "doc_id"),
            gone.withColumnRenamed("file_path", "doc_id"),
            self.levels,
        )
        shelves = now["clusters"]
        self._publish(version + 1, (stream, batch_id), cut_lineage(files), cut_lineage(tokens), graph, shelves)
        return version + 1

    def _publish(self, version, mark, files, tokens, graph: Graph, existing) -> None:
        copies = cut_lineage(represented(graph.members.withColumnRenamed("node", "bag")))
        vectors = files.select(F.col("file_path").alias("doc_id"), "embedding")
        kept = vectors.join(copies.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
        collection = Collection(tokens, copies, DenseSpace(cut_lineage(kept)))
        denied = files.where(F.col("denied_folder_path").isNotNull()).select(
            F.col("file_path").alias("doc_id"), F.col("denied_folder_path").alias("denied_folder")
        )
        fresh, moves, _ = recluster(
            collection, self.settings, existing, denied, self.stop_words, document_components(graph, copies)
        )
        assigned = cut_lineage(fresh.assignments.withColumnRenamed("doc_id", "file_path"))
        centroids = cluster_centroids(collection, fresh).select(
            "cluster_id", F.col("embedding").cast("array<float>").alias("centroid_embedding")
        )
        shelves = fresh.clusters.join(centroids, "cluster_id", "left").withColumn("folder_path", F.col("folder_name"))
        shelves = shelves.withColumn("folder_name", file_name(F.col("folder_path")))
        shelves = cut_lineage(complete_columns(shelves, CLUSTERS_SCHEMA).select(*CLUSTERS_SCHEMA.names))
        tables = {
            "files": reassign_all(files, assigned.select("file_path", "cluster_id"), shelves),
            "clusters": shelves,
            "moves": moves.select("doc_id", "folder"),
            "tokens": tokens,
            "members": graph.members,
            "vectors": graph.vectors,
            "components": graph.components,
        }
        publish_version(tables, self.catalog, version, mark, "overwrite")
