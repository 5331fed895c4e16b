"""The given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def labels(self) -> DataFrame:
        return self.table("labels")

    @property
    def benchmark(self) -> DataFrame:
        return self.table("benchmark")

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")

    @property
    def files(self) -> DataFrame:
        """Documents as scanned files: the source is the folder they are in."""
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        return self.documents.select(
            "doc_id",
            F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"),
            F.concat("doc_id", F.lit(".txt")).alias("filename"),
            F.octet_length("text").cast("long").alias("file_size"),
            (start + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("modification_date"),
            "source",
            "lang",
            "text",
        )

    @property
    def catalog(self) -> DataFrame:
        """Files with the links the labels give them."""
        marks = self.labels
        return (
            self.files.join(marks, "doc_id", "left")
            .withColumn("file_type", F.lit("text"))
            .withColumn("checksum", F.sha2("text", 256))
            .withColumn("cluster_id", F.concat(F.lit("q"), "quality"))
            .withColumn("confidence_score", F.coalesce(F.col("quality") * 0.5, F.lit(0.0)))
            .withColumn("proposed_cluster_id", F.col("cluster_id"))
            .withColumn("denied_folder_path", F.lit(None).cast("string"))
        )

    @property
    def labelled(self) -> DataFrame:
        return self.files.join(self.labels, "doc_id")

    @property
    def operations(self) -> DataFrame:
        """Events as an operation log."""
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").cast("string").alias("operation_id"),
            F.col("ts").alias("timestamp"),
            F.when(kind == "signup", "create_folder")
            .when(kind == "error", "delete_folder")
            .otherwise("move")
            .alias("operation_type"),
            F.when(kind != "signup", F.concat(F.lit("user"), "user_id", F.lit("/"), "event_id", F.lit(".txt"))).alias("source_path"),
            F.when(
                kind != "error",
                F.concat(F.lit("folder"), F.col("user_id") % 10, F.lit("/"), "event_id", F.lit(".txt")),
            ).alias("destination_path"),
            (F.col("value") > 5).alias("success"),
            "user_id",
            "value",
        )

    @property
    def changes(self) -> DataFrame:
        """Events as raw changes; a user is a root."""
        kind = F.col("event_type")
        endings = F.array(*[F.lit(e) for e in ("txt", "md", "png", "PDF", "log", "jpg", "rst")])
        dirs = F.array(*[F.lit(d) for d in ("notes", ".git", "build", "a/b", "c/.x")])
        number = F.floor(F.abs("value") * 100)

        def path(offset: int):
            return F.concat(
                F.get(dirs, (number + offset) % 5),
                F.lit("/"),
                (number + offset) % 400,
                F.lit("."),
                F.get(endings, (number + offset) % 7),
            )

        return self.table("events").select(
            F.col("ts").cast("timestamp").alias("ts"),
            "event_id",
            "user_id",
            F.when(kind == "signup", "created")
            .when(kind.isin("view", "click"), "modified")
            .when(kind == "purchase", "moved")
            .otherwise("deleted")
            .alias("kind"),
            path(0).alias("path"),
            F.when(kind == "purchase", path(3)).alias("dest_path"),
        )

    @property
    def paths(self) -> DataFrame:
        """Paths made of page addresses, with varied endings and directories."""
        endings = F.array(*[F.lit(e) for e in (".TXT", ".md", "", ".pdf", ".html", ".log")])
        dirs = F.array(*[F.lit(d) for d in ("", ".git/", "build/", "src/", "x/.hidden/", "env/", "envy/")])
        bare = F.regexp_extract("url", "^https?://([^?#]*[^/?#])", 1)
        return self.table("pages").select(
            "page_id",
            "url",
            F.concat(
                F.get(dirs, F.col("page_id") % 7), bare, F.get(endings, F.col("page_id") % 6)
            ).alias("path"),
        )
