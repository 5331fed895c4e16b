"""Every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import Tables
from kinshelf.config import Settings
from kinshelf.functions.paths import clean_folder_name, is_excluded, is_supported
from kinshelf.functions.text import UNICODE_WORD, drop_parent_words, label_from_keywords, naming_tokens, terms_1_2
from kinshelf.functions.vectors import cosine_similarity
from kinshelf.operators import catalog, clustering, delta, features, graph, moves, naming, search_index, views
from kinshelf.operators.components import connected_components
from kinshelf.operators.dense import dense_pairs
from kinshelf.operators.similarity import sparse_links, sparse_pairs
from kinshelf.operators.spaces import DenseSpace, SparseSpace
from kinshelf.plans import full_run as full
from kinshelf.plans import organize
from kinshelf.session import cut_lineage, fresh_path
from kinshelf.sources import catalog_io, corpus
from kinshelf.streaming import changes as stream

VECTOR_SETTINGS = Settings(similarity_threshold=0.35)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[Tables], DataFrame]):
    QUERIES[run.__name__] = lambda spark, folder: run(Tables(spark, folder))
    return run


# --- Sources and sinks ----------------------------------------------------------------


@query
def fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", corpus.fingerprint(F.col("text")).alias("checksum"))


@query
def scan_files(t: Tables) -> DataFrame:
    """All documents as files, some under names that start with "_" or ".", read back."""
    root = fresh_path(t.spark, "files")
    name = F.concat_ws("/", "lang", "filename")
    place = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("_"), name)).when(
        F.col("doc_id") % 11 == 0, F.concat(F.lit(".hidden/"), name)
    )
    corpus.write_files(t.files.select(F.coalesce(place, name).alias("file_path"), "text"), root)
    scanned = corpus.describe_documents(corpus.scan_corpus(t.spark, root), "content")
    return scanned.select("file_path", "filename", "file_size", "file_type", "checksum")


@query
def describe_documents(t: Tables) -> DataFrame:
    return corpus.describe_documents(t.files).drop("text", "creation_date", "content_summary")


@query
def catalog_lookup(t: Tables) -> DataFrame:
    found = catalog_io.find_file(t.catalog, "src7/7.txt")
    return found.select("file_path", "filename", "checksum", "cluster_id", "confidence_score")


@query
def schema_evolution(t: Tables) -> DataFrame:
    old = t.files.select("file_path", "filename", "file_size")
    new = catalog_io.complete_columns(old, catalog_io.FILES_SCHEMA)
    return new.select(
        "file_path", "file_size", "cluster_id", "confidence_score", "denied_folder_path"
    )


@query
def operation_log(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "operations")
    rows = t.operations.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    known = rows.select("operation_id", "timestamp", "operation_type", "source_path", "destination_path", "success")
    catalog_io.log_operations(known.where("success"), path)
    catalog_io.log_operations(known.where(~F.col("success")), path)
    logged = t.spark.read.schema(catalog_io.OPERATIONS_SCHEMA).parquet(path)
    return logged.groupBy("operation_type", "success").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("source_path").alias("sources"),
        F.count("checksum_before").alias("checksums"),
        F.max("timestamp").cast("timestamp_ntz").alias("latest"),
    )


@query
def organized_sink(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "organized")
    folder = F.when(F.col("toxic") == 0, F.concat(F.lit("q"), "quality", F.lit("/"), "source"))
    assigned = t.labelled.select("doc_id", folder.alias("folder"))
    catalog_io.write_organized(t.files.select("doc_id", "filename", "text"), assigned, path)
    return (
        t.spark.read.parquet(path)
        .groupBy("folder")
        .agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("chars"))
    )


# --- Catalog maintenance --------------------------------------------------------------


@query
def upsert_files(t: Tables) -> DataFrame:
    base = t.catalog.select("file_path", "filename", "checksum", "cluster_id")
    edited = t.labelled.select(
        "file_path",
        "filename",
        F.explode(F.array(F.lit(1), F.lit(2))).alias("version"),
        F.col("text").alias("body"),
    ).select(
        "file_path",
        "filename",
        F.sha2(F.concat("body", F.col("version").cast("string")), 256).alias("checksum"),
        "version",
    )
    added = t.benchmark.select(
        F.concat(F.lit("bench/"), "item_id", F.lit(".txt")).alias("file_path"),
        F.concat("item_id", F.lit(".txt")).alias("filename"),
        F.sha2("text", 256).alias("checksum"),
        F.lit(1).alias("version"),
    )
    return catalog.upsert(base, edited.unionByName(added), "file_path", "version")


@query
def delete_files(t: Tables) -> DataFrame:
    gone = t.labelled.where("toxic = 1")
    return catalog.delete(t.catalog.select("file_path", "checksum"), gone, "file_path")


@query
def assign_cluster(t: Tables) -> DataFrame:
    assigned = t.labelled.select(
        "file_path",
        F.when(F.col("toxic") == 0, F.concat(F.lit("t"), "quality")).alias("cluster_id"),
        (F.col("quality") + 0.25).cast("double").alias("confidence_score"),
    )
    # half of the rows are assigned twice, and the larger assignment counts
    again = t.labelled.where("doc_id % 2 = 0").select(
        "file_path", F.lit("z").alias("cluster_id"), F.lit(0.125).alias("confidence_score")
    )
    assigned = assigned.unionByName(again)
    rows = t.catalog.select("file_path", "filename", "cluster_id", "confidence_score")
    return catalog.assign_cluster(rows, assigned)


@query
def propose_cluster(t: Tables) -> DataFrame:
    proposed = t.labelled.where("quality = 1").select(
        "file_path", F.lit("next").alias("proposed_cluster_id")
    )
    return catalog.propose_cluster(
        t.catalog.select("file_path", "cluster_id", "proposed_cluster_id"), proposed
    )


@query
def deny_folder(t: Tables) -> DataFrame:
    denied = t.labelled.where("toxic = 1").select(
        "file_path", F.concat(F.lit("q"), "quality").alias("denied_folder_path")
    )
    return catalog.deny_folder(
        t.catalog.select("file_path", "denied_folder_path", "proposed_cluster_id"), denied
    )


@query
def rename_paths(t: Tables) -> DataFrame:
    # by twos to one path; some to a path that is there
    renames = t.labelled.where("quality = 1").select(
        "file_path",
        F.when(F.col("doc_id") % 5 == 0, F.lit("src0/0.txt"))
        .otherwise(F.concat(F.lit("renamed/"), F.floor(F.col("doc_id") / 2), F.lit(".txt")))
        .alias("new_path"),
    )
    return catalog.rename_paths(t.catalog.select("file_path", "filename", "checksum"), renames)


@query
def rename_files(t: Tables) -> DataFrame:
    # some to a name that is there, some to their own, and the others race for a few names
    stem = F.when(F.col("quality") == 1, F.col("doc_id") + 20).otherwise(
        F.when(F.col("toxic") == 1, F.col("doc_id")).otherwise(F.col("doc_id") % 60 + 10_000_000)
    )
    renames = t.labelled.select("file_path", F.concat(stem, F.lit(".txt")).alias("new_name"))
    return catalog.rename_files(t.catalog.select("file_path", "filename", "checksum"), renames)


@query
def invalidate_embeddings(t: Tables) -> DataFrame:
    emptied = catalog.invalidate_embeddings(t.vectors, "model-a", "model-b")
    kept = catalog.invalidate_embeddings(t.vectors, "model-a", "model-a")
    return emptied.select("doc_id", F.col("embedding").isNull().alias("emptied")).join(
        kept.select("doc_id", F.size("embedding").alias("kept_width")), "doc_id"
    )


@query
def reassign_all(t: Tables) -> DataFrame:
    assignments = t.labelled.select("file_path", F.concat(F.lit("c"), "quality").alias("cluster_id"))
    clusters = t.labels.groupBy("quality").agg(F.avg("toxic").alias("average_similarity"))
    clusters = clusters.select(F.concat(F.lit("c"), "quality").alias("cluster_id"), "average_similarity")
    rows = t.catalog.select("file_path", "cluster_id", "confidence_score", "proposed_cluster_id")
    return catalog.reassign_all(rows, assignments, clusters).withColumn(
        "confidence_score", F.round("confidence_score", 6)
    )


@query
def purge_stale(t: Tables) -> DataFrame:
    return catalog.purge_stale(t.catalog.select("file_path", "checksum"), t.labelled)


@query
def catalog_diff(t: Tables) -> DataFrame:
    added = t.benchmark.select(F.concat(F.lit("bench/"), "item_id", F.lit(".txt")).alias("file_path"))
    scan = t.labelled.select("file_path").unionByName(added)
    return catalog.catalog_diff(t.catalog, scan)


@query
def scan_changes(t: Tables) -> DataFrame:
    """A scan in which files of one language are gone, some longer, some later and some new."""
    seen = t.labelled.where("lang != 'de'").select(
        F.when(F.col("quality") == 0, F.concat(F.lit("new/"), "file_path")).otherwise(F.col("file_path")).alias("file_path"),
        (F.col("file_size") + F.col("toxic")).alias("file_size"),
        F.when(F.col("lang") == "fr", F.col("modification_date") + F.make_dt_interval(secs=F.lit(1)))
        .otherwise(F.col("modification_date"))
        .alias("modification_date"),
    )
    return catalog.scan_changes(t.files, seen)


@query
def incremental_analyze(t: Tables) -> DataFrame:
    vector = F.when(F.col("quality") == 1, F.array(F.lit(1.0).cast("float")))
    files = t.catalog.withColumn("embedding", vector).where(F.col("quality").isNotNull())
    edited = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    described = t.catalog.select("file_path", F.sha2(edited, 256).alias("checksum"))
    reused, renewed = catalog.incremental_analyze(files, described)
    columns = ["file_path", "checksum", "cluster_id", "confidence_score"]
    return (
        reused.select(*columns)
        .withColumn("status", F.lit("reused"))
        .unionByName(renewed.select(*columns).withColumn("status", F.lit("renewed")))
    )


@query
def classify_incoming(t: Tables) -> DataFrame:
    offered = t.benchmark.select(
        "item_id", F.concat(F.col("item_id") * 17, F.lit(".txt")).alias("filename")
    )
    at_root = t.table("conversations").select(F.concat(F.col("conv_id") * 3, F.lit(".txt")).alias("file_path"))
    known = t.files.where(F.col("source") != "src0")
    return catalog.classify_incoming(known, at_root, offered)


# --- Filters, projections, views ------------------------------------------------------


@query
def supported_files(t: Tables) -> DataFrame:
    return t.paths.where(is_supported(F.col("path"))).select("page_id", "path")


@query
def excluded_paths(t: Tables) -> DataFrame:
    return t.paths.select("page_id", is_excluded(F.col("path")).alias("excluded"))


@query
def clean_folder_names(t: Tables) -> DataFrame:
    return t.paths.select("page_id", clean_folder_name(F.col("url")).alias("name"))


@query
def search_documents(t: Tables) -> DataFrame:
    return views.search(t.catalog, "  NDer ").select("doc_id")


#: Long and short, frequent, rare and missing ones, over words and in names.
SEARCHED = ["  NDer ", "Un", "é", "3.txt", "the and of", "no such passage"]


@query
def search_by_index(t: Tables) -> DataFrame:
    """Several searches through one stored index of all documents."""
    path = fresh_path(t.spark, "search")
    search_index.build_search_index(t.catalog, path)
    found = None
    for text in SEARCHED:
        rows = search_index.search_indexed(t.catalog, path, text).select(F.lit(text).alias("query"), "doc_id")
        found = rows if found is None else found.unionAll(rows)
    return found


@query
def pending_documents(t: Tables) -> DataFrame:
    vectors = t.vectors.select("doc_id", "embedding")
    waiting = views.pending(t.files.join(vectors, "doc_id", "left"))
    return waiting.groupBy("source").agg(F.count(F.lit(1)).alias("waiting"))


@query
def highlight_documents(t: Tables) -> DataFrame:
    return views.highlight(t.catalog, "eau").select("doc_id", "opacity")


def _clusters(t: Tables) -> DataFrame:
    return t.labels.where("quality = 1").select(
        F.concat(F.lit("q"), "quality").alias("cluster_id"), F.lit("Good/Texts").alias("folder_name")
    ).distinct()


@query
def folder_lookup(t: Tables) -> DataFrame:
    return views.with_folder(t.catalog, _clusters(t)).select("doc_id", "folder")


@query
def library_rows(t: Tables) -> DataFrame:
    return views.library_rows(views.with_folder(t.catalog, _clusters(t)))


@query
def library(t: Tables) -> DataFrame:
    return views.library(views.with_folder(t.catalog, _clusters(t), "[Uncategorized]"))


@query
def preview(t: Tables) -> DataFrame:
    return views.preview(t.files.withColumn("folder", F.col("source")))


@query
def run_summary(t: Tables) -> DataFrame:
    return views.run_summary(t.catalog.where(F.col("cluster_id").isNotNull()))


@query
def showing_counts(t: Tables) -> DataFrame:
    vectors = t.vectors.select("doc_id", "embedding")
    return views.showing(t.catalog.join(vectors, "doc_id", "left"), "tion")


@query
def map_coordinates(t: Tables) -> DataFrame:
    return views.map_coordinates(t.vectors)


@query
def map_terms(t: Tables) -> DataFrame:
    """Places of all documents by their TF-IDF vectors."""
    tokens = cut_lineage(_tokens(t))
    copies = cut_lineage(features.fold_copies(tokens))
    return views.map_terms(features.tfidf_vectors(tokens, copies), copies)


@query
def map_layer(t: Tables) -> DataFrame:
    points = t.vectors.select(
        F.concat(F.lit("v"), "doc_id").alias("label"),
        F.concat(F.lit("f"), "label").alias("folder"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        F.lit(1.0).alias("opacity"),
    )
    return views.map_layer(points).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query
def folder_colours(t: Tables) -> DataFrame:
    return views.folder_colours(t.files.select(F.concat("lang", F.lit("/"), "source").alias("folder")))


# --- Text features --------------------------------------------------------------------


@query
def document_tokens(t: Tables) -> DataFrame:
    tokens = naming_tokens(F.col("text"))
    return t.documents.select(
        "doc_id",
        F.size(tokens).cast("long").alias("n"),
        F.sha2(F.array_join(tokens, " "), 256).alias("digest"),
    )


@query
def unicode_tokens(t: Tables) -> DataFrame:
    """Words of every script, as the whole job takes them."""
    tokens = naming_tokens(F.col("text"), word=UNICODE_WORD)
    return t.documents.select(
        "doc_id",
        F.size(tokens).cast("long").alias("n"),
        F.sha2(F.array_join(tokens, " "), 256).alias("digest"),
    )


@query
def word_pairs(t: Tables) -> DataFrame:
    terms = terms_1_2(naming_tokens(F.col("text")))
    return t.documents.select(
        "doc_id",
        F.size(terms).cast("long").alias("n"),
        F.sha2(F.array_join(terms, ","), 256).alias("digest"),
    )


def _tokens(t: Tables) -> DataFrame:
    return features.document_tokens(t.documents)


@query
def copy_groups(t: Tables) -> DataFrame:
    return features.fold_copies(_tokens(t)).select("doc_id", "rep", "n")


@query
def tfidf_vectors(t: Tables) -> DataFrame:
    return features.tfidf_vectors(_tokens(t)).withColumn("w", F.round("w", 6))


@query
def hashed_vectors(t: Tables) -> DataFrame:
    return features.hashed_vectors(_tokens(t), 256)


def _families(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("lang").alias("family"), F.col("source").alias("grp"), "doc_id"
    )


@query
def group_tfidf(t: Tables) -> DataFrame:
    weights = naming.group_tfidf(_tokens(t), _families(t))
    return weights.select("family", "grp", "term", F.round("w", 6).alias("w"))


def _boosted(t: Tables, most_frequent: int | None) -> DataFrame:
    tokens, members = cut_lineage(_tokens(t)), _families(t)
    weights = cut_lineage(naming.group_tfidf(tokens, members, most_frequent=most_frequent))
    shares = naming.term_shares(tokens, members, weights)
    scores = naming.boosted_terms(weights, shares, members)
    return scores.withColumn("score", F.round("score", 6))


@query
def df_boost(t: Tables) -> DataFrame:
    """All terms of every group."""
    return _boosted(t, None)


@query
def df_boost_bounded(t: Tables) -> DataFrame:
    """With the reference's own bound on compared terms, as a parameter."""
    return _boosted(t, 40)


@query
def contrast_terms(t: Tables) -> DataFrame:
    """The six best terms of each group, through the bounds."""
    tokens, members = cut_lineage(_tokens(t)), _families(t)
    weights = cut_lineage(naming.group_tfidf(tokens, members))
    hopeful = cut_lineage(naming.promising_terms(weights, members))
    shares = naming.term_shares(tokens, members, hopeful)
    scores = naming.boosted_terms(hopeful, shares, members)
    return naming.contrast_labels(scores).select("family", "grp", F.array_join("ranked", ",").alias("ranked"))


@query
def name_groups(t: Tables) -> DataFrame:
    members = _families(t).withColumn("kind", F.lit(0))
    return naming.name_groups(cut_lineage(_tokens(t)), members)


def _keywords(t: Tables) -> DataFrame:
    alone = t.labels.select(F.concat(F.lit("d"), "doc_id").alias("cluster_id"), "doc_id")
    members = t.documents.select(F.col("source").alias("cluster_id"), "doc_id").unionByName(alone)
    return naming.extract_keywords(_tokens(t), members, 5)


@query
def extract_keywords(t: Tables) -> DataFrame:
    return _keywords(t).select("cluster_id", F.array_join("keywords", ",").alias("keywords"))


@query
def keyword_labels(t: Tables) -> DataFrame:
    return _keywords(t).select("cluster_id", label_from_keywords(F.col("keywords")).alias("label"))


@query
def unique_sibling_labels(t: Tables) -> DataFrame:
    names = t.files.select(
        F.col("lang").alias("family"),
        F.col("doc_id").alias("grp"),
        F.col("doc_id").alias("ordinal"),
        F.col("source").alias("name"),
        (F.col("lang") != "de").alias("compared"),
    )
    return naming.unique_sibling_labels(names).select("family", "grp", "name")


@query
def parent_words_dropped(t: Tables) -> DataFrame:
    """All words of a text are its name, those with an even number of letters its parents."""
    words = F.array_sort(F.array_distinct(naming_tokens(F.col("text"))))
    name = F.array_join(F.transform(words, F.initcap), "_")
    parents = F.filter(words, lambda w: F.length(w) % 2 == 0)
    parent = F.array_join(F.transform(parents, F.initcap), "/")
    return t.documents.select("doc_id", F.sha2(drop_parent_words(name, parent), 256).alias("name"))


# --- Similarity and clustering --------------------------------------------------------


@query
def cosine_similarities(t: Tables) -> DataFrame:
    a = t.vectors.select("doc_id", F.col("embedding").alias("a"))
    b = t.vectors.select((F.col("doc_id") - 1).alias("doc_id"), F.col("embedding").alias("b"))
    sim = cosine_similarity(F.col("a"), F.col("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(sim, 6).alias("sim"))


def _folded(t: Tables) -> tuple[DataFrame, SparseSpace]:
    tokens = cut_lineage(_tokens(t))
    copies = cut_lineage(features.fold_copies(tokens))
    return copies, SparseSpace(cut_lineage(features.tfidf_vectors(tokens, copies)))


@query
def similarity_join(t: Tables) -> DataFrame:
    _, space = _folded(t)
    return sparse_pairs(space.vectors, 0.55).withColumn("sim", F.round("sim", 6))


@query
def similarity_join_blocked(t: Tables) -> DataFrame:
    """The same pairs with entry lists cut into many blocks."""
    _, space = _folded(t)
    return sparse_pairs(space.vectors, 0.55, block=16).withColumn("sim", F.round("sim", 6))


@query
def similarity_links_blocked(t: Tables) -> DataFrame:
    """Links among crowded entry lists connect what all pairs connect."""
    _, space = _folded(t)
    return connected_components(sparse_links(space.vectors, 0.55, 0.9, block=16)).select(
        "doc_id", F.col("component").alias("grp")
    )


@query
def dense_pairs_blocked(t: Tables) -> DataFrame:
    """The same pairs with many blocks and pivots."""
    pairs = dense_pairs(t.vectors.select("doc_id", "embedding"), 0.35, block=64)
    return pairs.withColumn("sim", F.round("sim", 6))


@query
def similarity_join_dense(t: Tables) -> DataFrame:
    pairs = dense_pairs(t.vectors.select("doc_id", "embedding"), 0.35)
    return pairs.withColumn("sim", F.round("sim", 6))


@query
def document_groups(t: Tables) -> DataFrame:
    groups = organize.document_groups(t.documents)
    return groups.withColumn("average_similarity", F.round("average_similarity", 6))


def _vector_groups(t: Tables) -> tuple[DenseSpace, DataFrame]:
    space = DenseSpace(t.vectors)
    members = t.vectors.select(F.lit(clustering.ROOT).alias("parent"), "doc_id", F.lit(1).alias("n"))
    edges = space.links(0.35, 0.35)
    return space, cut_lineage(clustering.density_groups(edges, members))


@query
def density_groups(t: Tables) -> DataFrame:
    _, grouped = _vector_groups(t)
    return grouped.where(F.col("grp").isNotNull()).select("doc_id", "grp")


@query
def assign_noise(t: Tables) -> DataFrame:
    space, grouped = _vector_groups(t)
    return clustering.assign_noise(space, grouped, 0.30).select("doc_id", "grp")


@query
def regroup_noise(t: Tables) -> DataFrame:
    space, grouped = _vector_groups(t)
    noise = grouped.where(F.col("grp").isNull()).drop("grp")
    return clustering.regroup_noise(space, noise, 0.30).select("doc_id", "grp", "kind")


@query
def recursive_clusters(t: Tables) -> DataFrame:
    members = t.vectors.select("doc_id", F.lit(1).alias("n"))
    _, leaves = clustering.recursive_groups(DenseSpace(t.vectors), members, VECTOR_SETTINGS)
    return leaves.select("doc_id", F.col("level").cast("long").alias("level"), "parent")


@query
def components_after_changes(t: Tables) -> DataFrame:
    """A graph of all vectors is changed: one label goes, one turns round, one comes again under new ids, moved a little."""
    levels = [0.35, 0.45, 0.55]
    made = graph.build_graph(t.vectors, levels)
    turned = t.vectors.where("label = 1").select("doc_id", F.reverse("embedding").alias("embedding"))
    near = F.transform("embedding", lambda x, i: F.when(i < 8, -x).otherwise(x))
    again = t.vectors.where("label = 2").select((F.col("doc_id") + 1_000_000).alias("doc_id"), near.alias("embedding"))
    after = graph.change_graph(made, turned.unionAll(again), t.vectors.where("label = 0").select("doc_id"), levels)
    copies = features.represented(after.members.withColumnRenamed("node", "bag"))
    found = graph.document_components(after, copies)
    return found.select(F.col("level").cast("long").alias("level"), "doc_id", "component")


@query
def cluster_stats_dense(t: Tables) -> DataFrame:
    members = t.vectors.select(F.col("label").alias("cluster_id"), "doc_id", F.lit(1).alias("n"))
    stats = clustering.cluster_stats(DenseSpace(t.vectors), members)
    return stats.select("cluster_id", F.col("size").cast("long"), F.round("average_similarity", 6).alias("average_similarity"))


@query
def cluster_stats(t: Tables) -> DataFrame:
    space = SparseSpace(cut_lineage(features.tfidf_vectors(_tokens(t))))
    members = t.documents.select(F.col("source").alias("cluster_id"), "doc_id", F.lit(1).alias("n"))
    stats = clustering.cluster_stats(space, members)
    return stats.select("cluster_id", F.col("size").cast("long"), F.round("average_similarity", 6).alias("average_similarity"))


@query
def cluster_centroids(t: Tables) -> DataFrame:
    members = t.vectors.select("label", "doc_id", F.lit(1).alias("n"))
    means = DenseSpace(t.vectors).group_means(members, ["label"])
    return means.select("label", F.posexplode("embedding").alias("pos", "value")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")
    )


@query
def build_clusters(t: Tables) -> DataFrame:
    """Every document with its cluster and what is told of the cluster."""
    made = organize.build_clusters(organize.prepare(t.files, "filename"))
    return made.assignments.select("doc_id", "cluster_id").join(cut_lineage(made.clusters), "cluster_id")


@query
def recluster(t: Tables) -> DataFrame:
    denials = t.labels.where("toxic = 1").select("doc_id", F.lit("Group_1").alias("denied_folder"))
    existing = t.labels.select(F.concat(F.lit("q"), "quality").alias("cluster_id")).distinct()
    _, moved, removed = organize.recluster(
        organize.prepare(t.files, "filename"), existing=existing, denials=denials
    )
    return moved.select(F.col("doc_id").cast("string").alias("key"), "folder").unionByName(
        removed.select(F.col("cluster_id").alias("key"), F.lit("removed").alias("folder"))
    )


@query
def full_run(t: Tables) -> DataFrame:
    """The whole job over all documents: a third are known and unchanged, others edited or new."""
    described = t.files.withColumn("file_type", F.lit("text")).withColumn("checksum", F.sha2("text", 256))
    described = described.select(
        "file_path", "filename", "file_size", F.col("modification_date").cast("timestamp").alias("modification_date"),
        "file_type", "checksum", "text",
    )
    known = described.drop("text").withColumn(
        "embedding", F.when(F.crc32("file_path") % 3 == 0, F.array_repeat(F.lit(0.0625).cast("float"), 256))
    )
    gone = known.limit(1).withColumn("file_path", F.lit("gone/1.txt"))
    run = full.organize(known.unionByName(gone), described)
    run.publish(catalog := fresh_path(t.spark, "catalog"), 1)
    version = catalog_io.latest_version(t.spark, catalog)
    written = catalog_io.read_version(t.spark, catalog, "files", version)
    shelves = catalog_io.read_version(t.spark, catalog, "clusters", version)
    return (
        written.join(shelves.select("cluster_id", "folder_path"), "cluster_id", "left")
        .groupBy("folder_path")
        .agg(F.count(F.lit(1)).alias("files"), F.count("embedding").alias("vectors"))
    )


# --- Re-clustering delta --------------------------------------------------------------


def _assigned(t: Tables) -> DataFrame:
    return t.labelled.select(
        "doc_id", F.concat(F.lit("A/q"), "quality", F.lit("/"), "source").alias("folder")
    )


def _denials(t: Tables) -> DataFrame:
    denied = (
        F.when(F.col("doc_id") % 4 == 0, F.lit("/A/q1/"))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("A/q0/"), "source", F.lit("/deep")))
        .when(F.col("doc_id") % 4 == 2, F.lit("A/q"))
        .otherwise(F.concat(F.lit("A/q1/"), "source"))
    )
    return t.files.select("doc_id", denied.alias("denied_folder"))


@query
def apply_denials(t: Tables) -> DataFrame:
    return delta.apply_denials(_assigned(t), _denials(t))


@query
def removed_clusters(t: Tables) -> DataFrame:
    old = t.files.select(F.concat("lang", F.lit("-"), "source").alias("cluster_id")).distinct()
    new = t.labelled.select(F.concat("lang", F.lit("-"), "source").alias("cluster_id")).distinct()
    return delta.removed_clusters(old, new)


@query
def unclustered_to_root(t: Tables) -> DataFrame:
    return delta.unclustered_to_root(t.files, delta.apply_denials(_assigned(t), _denials(t)))


# --- Moves, audit, undo ---------------------------------------------------------------


def _moves(t: Tables) -> DataFrame:
    number = F.col("doc_id")
    target = (
        F.when(number % 5 == 0, F.col("source"))
        .when(number % 5 == 1, F.lit("."))
        .otherwise(F.concat(F.lit("src"), (number + 20) % 7))
    )
    known = t.files.select(F.col("file_path").alias("source_path"), target.alias("target_folder"))
    gone = t.benchmark.select(
        F.concat(F.lit("old/"), "item_id", F.lit(".txt")).alias("source_path"),
        F.lit("src1").alias("target_folder"),
    )
    # Twins want the same name in the same folder.
    twins = t.benchmark.select(
        F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"), "item_id"
    ).select(
        F.concat("side", F.lit("/"), "item_id", F.lit(".txt")).alias("source_path"),
        F.lit("twins").alias("target_folder"),
    )
    return known.unionByName(gone).unionByName(twins)


def _existing(t: Tables) -> DataFrame:
    twins = t.benchmark.select(
        F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"), "item_id"
    ).select(F.concat("side", F.lit("/"), "item_id", F.lit(".txt")).alias("file_path"))
    at_root = t.labels.where("toxic = 1").select(F.concat("doc_id", F.lit(".txt")).alias("file_path"))
    return t.files.select("file_path").unionByName(twins).unionByName(at_root)


@query
def move_plan(t: Tables) -> DataFrame:
    return moves.move_plan(_moves(t), _existing(t))


@query
def integrity_audit(t: Tables) -> DataFrame:
    moved = t.labelled.select(
        F.col("file_path").alias("source_path"),
        F.concat(F.lit("new/"), "filename").alias("destination_path"),
        F.lit("2024-06-01 00:00:00").cast("timestamp").alias("timestamp"),
    )
    before = t.files.select("file_path", F.sha2("text", 256).alias("checksum"))
    changed = F.when(F.col("toxic") == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    after = t.labelled.where("quality = 1").select(
        F.concat(F.lit("new/"), "filename").alias("file_path"), F.sha2(changed, 256).alias("checksum")
    )
    return moves.integrity_audit(moved, before, after).drop("operation_id", "timestamp")


@query
def folder_plan(t: Tables) -> DataFrame:
    folders = t.files.select(F.col("source").alias("folder")).distinct()
    targets = t.labelled.select(F.concat(F.lit("q"), "quality", F.lit("/"), "lang").alias("target_folder"))
    after = t.files.where("lang = 'es'").select("file_path").unionByName(
        t.labelled.select(F.concat(F.lit("q"), "quality", F.lit("/"), "filename").alias("file_path"))
    )
    return moves.folder_plan(targets, folders, after)


@query
def unique_destinations(t: Tables) -> DataFrame:
    wanted = t.files.select("doc_id", F.concat("lang", F.lit("/note.txt")).alias("path"))
    taken = t.labelled.select(
        F.concat("lang", F.lit("/note_"), F.col("doc_id") % 50, F.lit(".txt")).alias("file_path")
    )
    return moves.unique_destinations(wanted, taken)


@query
def recent_operations(t: Tables) -> DataFrame:
    return moves.recent_operations(t.operations, 100).select("operation_id", "timestamp", "operation_type")


@query
def undo_plan(t: Tables) -> DataFrame:
    existing = t.operations.where("value > 8").select(F.col("destination_path").alias("file_path"))
    folders = t.operations.select(F.concat(F.lit("user"), "user_id").alias("folder")).distinct()
    # a third of the moves come from the root
    source = F.when(F.col("user_id") % 3 == 0, F.concat("operation_id", F.lit(".txt")))
    from_root = F.when(F.col("source_path").isNotNull(), F.coalesce(source, "source_path"))
    return moves.undo_plan(t.operations.withColumn("source_path", from_root), existing, folders, 40)


# --- Change stream --------------------------------------------------------------------


@query
def normalize_changes(t: Tables) -> DataFrame:
    return stream.normalize_changes(t.changes, ["event_id"]).select("event_id", "action", "path")


@query
def suppress_own_changes(t: Tables) -> DataFrame:
    own = t.changes.where("kind = 'moved'").select("path").distinct()
    return stream.suppress_own_changes(t.changes, own).select("event_id")


def _syncs(t: Tables) -> DataFrame:
    return t.changes.where("kind = 'created'").select(F.col("ts").alias("sync_ts"))


@query
def changes_while_running(t: Tables) -> DataFrame:
    pauses = _syncs(t).select(
        F.col("sync_ts").alias("start"),
        (F.col("sync_ts") + F.make_dt_interval(mins=F.lit(10))).alias("end"),
    )
    return stream.while_running(t.changes, pauses).select("event_id")


@query
def cooldown(t: Tables) -> DataFrame:
    return stream.cooldown(t.changes, _syncs(t), 300).select("event_id")


@query
def debounce(t: Tables) -> DataFrame:
    events = stream.normalize_changes(t.changes, ["user_id"])
    sessions = stream.debounce_batch(events, 6 * 3600, ["user_id"])
    return (
        sessions.groupBy("user_id", "session")
        .agg(
            F.max("ts").cast("timestamp_ntz").alias("last"),
            F.count_distinct(F.when(F.col("action") == "changed", F.col("path"))).alias("changed"),
            F.count_distinct(F.when(F.col("action") == "deleted", F.col("path"))).alias("deleted"),
        )
        .withColumn("session", F.col("session").cast("timestamp_ntz"))
    )


@query
def apply_changes(t: Tables) -> DataFrame:
    files = t.catalog.withColumn("embedding", F.array(F.lit(1.0).cast("float"))).select(
        "file_path", "filename", "checksum", "cluster_id", "confidence_score", "embedding"
    )
    batch = t.labelled.select(
        F.explode(
            F.when(F.col("toxic") == 1, F.array(F.lit("changed"), F.lit("deleted"))).otherwise(
                F.array(F.lit("changed"))
            )
        ).alias("action"),
        F.col("file_path").alias("path"),
    )
    edited = t.labelled.select(
        "file_path",
        "filename",
        F.sha2(F.concat("text", F.lit("?")), 256).alias("checksum"),
        F.array(F.lit(2.0).cast("float")).alias("embedding"),
    )

    def describe(paths: DataFrame) -> DataFrame:
        return edited.join(paths, "file_path", "left_semi")

    return stream.apply_changes(files, batch, describe).select(
        "file_path", "checksum", "cluster_id", "confidence_score", F.col("embedding")[0].cast("double").alias("mark")
    )
