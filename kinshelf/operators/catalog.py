"""Row changes to the document and cluster tables, as new DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinshelf.functions.paths import child_path, parent_folder
from kinshelf.session import cut_lineage


def _whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def latest_per_key(changes: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the highest ``order``; that column is dropped."""
    return (
        changes.groupBy(key)
        .agg(F.max_by(_whole_row(changes.drop(key, order)), F.col(order)).alias("_row"))
        .select(key, "_row.*")
    )


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace the base rows of the same key, or are added.

    A replaced row is replaced whole: columns ``changes`` lacks become NULL. With
    ``order``, the batch may name a key several times and the last change wins.
    """
    if order:
        changes = latest_per_key(changes, key, order)
    return base.join(changes.select(key), key, "left_anti").unionByName(
        changes, allowMissingColumns=True
    )


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def clear(base: DataFrame) -> DataFrame:
    return base.limit(0)


def _one_per_key(changes: DataFrame, key: str) -> DataFrame:
    """One row per key; of several the largest, column by column, so that repeats never multiply rows."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, "_row.*")


def _update(files: DataFrame, changes: DataFrame, new_values: dict[str, Column]) -> DataFrame:
    """Set columns on the rows ``changes`` names; other rows keep their values.

    Of several changes to one row the largest counts.
    """
    named = [c for c in changes.columns if c == "file_path" or c in new_values]
    marked = _one_per_key(changes.select(named), "file_path").withColumn("_hit", F.lit(True))
    joined = files.alias("f").join(marked.alias("c"), "file_path", "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), new_values[c]).otherwise(F.col(f"f.{c}")).alias(c)
            if c in new_values
            else F.col(f"f.{c}" if c != "file_path" else c)
            for c in files.columns
        ]
    )


def assign_cluster(files: DataFrame, assigned: DataFrame) -> DataFrame:
    """``assigned(file_path, cluster_id, confidence_score)``."""
    return _update(
        files,
        assigned,
        {
            "cluster_id": F.col("c.cluster_id"),
            "confidence_score": F.col("c.confidence_score"),
        },
    )


def propose_cluster(files: DataFrame, proposed: DataFrame) -> DataFrame:
    """``proposed(file_path, proposed_cluster_id)``."""
    return _update(files, proposed, {"proposed_cluster_id": F.col("c.proposed_cluster_id")})


def deny_folder(files: DataFrame, denied: DataFrame) -> DataFrame:
    """``denied(file_path, denied_folder_path)``; an open proposal is withdrawn."""
    return _update(
        files,
        denied,
        {
            "denied_folder_path": F.col("c.denied_folder_path"),
            "proposed_cluster_id": F.lit(None).cast("string"),
        },
    )


def rename_paths(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Change keys by ``renames(file_path, new_path)``; the filename stays as it is.

    A rename to a path the catalog already holds is not done, and of several to one
    new path the first by its present path is. Of several renames of one path the
    largest new path counts.
    """
    wanted = _one_per_key(renames.select("file_path", "new_path"), "file_path")
    done = _granted(files, wanted.join(files.select("file_path"), "file_path", "left_semi"))
    return (
        files.join(done, "file_path", "left")
        .withColumn("file_path", F.coalesce("new_path", "file_path"))
        .select(files.columns)
    )


def _granted(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``wanted(file_path, new_path, ...)`` whose new path is free, the first of each."""
    taken = files.select(F.col("file_path").alias("new_path"))
    free = wanted.where(F.col("new_path").isNotNull()).join(taken, "new_path", "left_anti")
    rest = [c for c in wanted.columns if c not in ("file_path", "new_path")]
    first = F.min(F.struct("file_path", *rest)).alias("_row")
    return free.groupBy("new_path").agg(first).select("new_path", "_row.*")


def rename_files(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Give documents a new filename inside their folder.

    ``renames(file_path, new_name)``. A rename to the present name, or to a path
    the catalog already holds, is not done; of several documents that want one path
    the first by path gets it.
    """
    wanted = (
        files.select("file_path", "filename")
        .join(_one_per_key(renames.select("file_path", "new_name"), "file_path"), "file_path")
        .where(F.col("new_name") != F.col("filename"))
        .select(
            "file_path",
            "new_name",
            child_path(parent_folder(F.col("file_path")), F.col("new_name")).alias("new_path"),
        )
    )
    done = _granted(files, wanted)
    return (
        files.join(done, "file_path", "left")
        .withColumn("file_path", F.coalesce("new_path", "file_path"))
        .withColumn("filename", F.coalesce("new_name", "filename"))
        .select(files.columns)
    )


def invalidate_embeddings(
    files: DataFrame, recorded_model: str | None = None, configured_model: str | None = None
) -> DataFrame:
    """Forget all vectors, on demand or when they come from another model."""
    if recorded_model is not None and recorded_model == configured_model:
        return files
    kind = files.schema["embedding"].dataType
    return files.withColumn("embedding", F.lit(None).cast(kind))


def reassign_all(files: DataFrame, assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Replace every cluster link by ``assignments(file_path, cluster_id)``.

    The score of a document is the average similarity of its cluster.
    """
    scored = assignments.join(clusters.select("cluster_id", "average_similarity"), "cluster_id")
    fresh = scored.select(
        "file_path",
        "cluster_id",
        F.col("average_similarity").alias("confidence_score"),
        F.col("cluster_id").alias("proposed_cluster_id"),
    )
    bare = files.drop("cluster_id", "confidence_score", "proposed_cluster_id")
    return (
        bare.join(fresh, "file_path", "left")
        .withColumn("confidence_score", F.coalesce("confidence_score", F.lit(0.0)))
        .select(files.columns)
    )


def purge_stale(files: DataFrame, existing_paths: DataFrame) -> DataFrame:
    """Keep the rows whose document still exists, supported or not."""
    return files.join(existing_paths.select("file_path"), "file_path", "left_semi")


def catalog_diff(files: DataFrame, scan: DataFrame) -> DataFrame:
    """``(file_path, status)``: "new" only in the scan, "removed" only in the catalog."""
    known = files.select("file_path", F.lit(True).alias("_known"))
    seen = scan.select("file_path", F.lit(True).alias("_seen"))
    return (
        known.join(seen, "file_path", "full_outer")
        .where(F.col("_known").isNull() | F.col("_seen").isNull())
        .select("file_path", F.when(F.col("_known").isNull(), "new").otherwise("removed").alias("status"))
    )


def folder_digests(files: DataFrame) -> DataFrame:
    """``(folder, files, digest, other)`` of the files that lie directly in each folder.

    The digests tell, in two independent hashes, the paths, sizes and times of its files
    whatever their order.
    """
    told = [F.col("file_path"), F.col("file_size"), F.unix_micros(F.col("modification_date").cast("timestamp"))]
    return files.groupBy(parent_folder(F.col("file_path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("files"),
        F.bit_xor(F.xxhash64(*told)).alias("digest"),
        F.bit_xor(F.xxhash64(F.lit(1), *told)).alias("other"),
    )


def scan_changes(files: DataFrame, scan: DataFrame) -> DataFrame:
    """``(file_path, status)``: "new", "removed", or "edited" where size or time differ.

    Both have ``file_path, file_size, modification_date``. Folders are compared first; only
    the files of those that differ meet.
    """
    mine, seen = folder_digests(files).alias("a"), folder_digests(scan).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("files", "digest", "other")]
    differing = (
        mine.join(seen, "folder", "full_outer").where(~(same[0] & same[1] & same[2])).select("folder")
    )
    differing = cut_lineage(differing)

    def within(rows: DataFrame, name: str) -> DataFrame:
        told = F.struct("file_size", F.col("modification_date").cast("timestamp").alias("time"))
        inside = rows.withColumn("folder", parent_folder(F.col("file_path"))).join(differing, "folder", "left_semi")
        return inside.select("file_path", told.alias(name))

    both = within(files, "_a").join(within(scan, "_b"), "file_path", "full_outer")
    status = (
        F.when(F.col("_a").isNull(), "new")
        .when(F.col("_b").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "edited")
    )
    return both.select("file_path", status.alias("status")).where(F.col("status").isNotNull())


def incremental_analyze(files: DataFrame, described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split scanned documents into catalog rows to reuse and documents to analyse.

    A row is reused when its checksum is unchanged and it has a vector. The rest
    come back as described, with the cluster link and the denied folder the catalog has
    for them; their vectors are still to be made.
    """
    cached = files.select(
        "file_path",
        F.col("checksum").alias("_checksum"),
        F.col("embedding").isNotNull().alias("_has_vector"),
        F.col("cluster_id"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
        *[c for c in ("denied_folder_path",) if c in files.columns],  # a denial outlives an edit
    )
    fits = F.coalesce((F.col("_checksum") == F.col("checksum")) & F.col("_has_vector"), F.lit(False))
    reused = files.join(described.select("file_path", "checksum"), ["file_path", "checksum"], "left_semi")
    reused = reused.where(F.col("embedding").isNotNull())
    renewed = (
        described.join(cached, "file_path", "left")
        .where(~fits)
        .withColumn("confidence_score", F.coalesce("confidence_score", F.lit(0.0)))
        .drop("_checksum", "_has_vector")
    )
    return reused, renewed


def classify_incoming(files: DataFrame, existing_paths: DataFrame, offered: DataFrame) -> DataFrame:
    """Status of each ``offered(filename)``: tracked, waiting at the root, or new."""
    tracked = files.select("filename").distinct().withColumn("_tracked", F.lit(True))
    at_root = existing_paths.select(F.col("file_path").alias("filename")).distinct()
    at_root = at_root.where(~F.col("filename").contains("/")).withColumn("_waiting", F.lit(True))
    return (
        offered.join(tracked, "filename", "left")
        .join(at_root, "filename", "left")
        .withColumn(
            "status",
            F.when(F.col("_tracked"), "tracked").when(F.col("_waiting"), "waiting").otherwise("new"),
        )
        .drop("_tracked", "_waiting")
    )
