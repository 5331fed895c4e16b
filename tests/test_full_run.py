"""The whole job, run twice on a small collection."""

from datetime import datetime

from pyspark.sql import functions as F

from kinshelf import Settings
from kinshelf.functions.text import UNICODE_WORD, naming_tokens
from kinshelf.plans.full_run import empty_catalog, organize
from kinshelf.session import fresh_path
from kinshelf.sources import catalog_io, corpus

TEXTS = {
    "a1.txt": "Telescope images show planets orbiting distant stars near the galaxy center",
    "in/a2.txt": "Planets orbiting stars in a distant galaxy seen through the telescope",
    "b1.txt": "Knead bread dough with flour and yeast, then bake the bread in the oven",
    "b2.txt": "Bake bread dough made of flour yeast and water in a hot oven",
}


def scan(spark, texts):
    rows = [(p, len(t), datetime(2024, 1, 1), t) for p, t in texts.items()]
    found = spark.createDataFrame(rows, "file_path string, file_size long, modification_date timestamp, text string")
    return corpus.describe_documents(found)


def test_two_runs(spark):
    catalog, config = fresh_path(spark, "catalog"), Settings(similarity_threshold=0.3)
    assert catalog_io.latest_version(spark, catalog) is None
    first = organize(empty_catalog(spark), scan(spark, TEXTS), settings=config)
    assert {r.status for r in first.moves.collect()} == {"move"}
    assert all(r.success for r in first.operations.collect())
    first.publish(catalog, 1)
    # a version without its marker does not count
    catalog_io.write_snapshot(first.files.limit(1), catalog, "files", 2)
    assert catalog_io.latest_version(spark, catalog) == 1

    files = catalog_io.read_version(spark, catalog, "files", 1)
    shelves = catalog_io.read_version(spark, catalog, "clusters", 1)
    assert files.schema.names == catalog_io.FILES_SCHEMA.names
    rows = {r.filename: r for r in files.collect()}
    assert rows["a1.txt"].cluster_id == rows["a2.txt"].cluster_id != rows["b1.txt"].cluster_id
    named = {r.cluster_id: r for r in shelves.collect()}
    for r in rows.values():
        shelf = named[r.cluster_id]
        assert r.file_path == f"{shelf.folder_path}/{r.filename}"
        assert r.confidence_score == shelf.average_similarity and len(shelf.centroid_embedding) == 256

    # one document is edited after its folder was denied, one is gone
    texts = {r.file_path: TEXTS.get(n, TEXTS.get(f"in/{n}")) for n, r in rows.items() if n != "b2.txt"}
    edited = rows["a1.txt"].file_path
    texts[edited] += " again"
    denied = files.withColumn(
        "denied_folder_path", F.when(F.col("filename") == "a1.txt", named[rows["a1.txt"].cluster_id].folder_path)
    )
    second = organize(denied, scan(spark, texts), shelves, settings=config)
    after = {r.filename: r for r in second.files.collect()}
    assert set(after) == {"a1.txt", "a2.txt", "b1.txt"}
    assert after["a1.txt"].denied_folder_path and after["a1.txt"].checksum != rows["a1.txt"].checksum
    target = {r.source_path: r.target_folder for r in second.moves.collect()}
    assert target[edited] == "." or not target[edited].startswith(after["a1.txt"].denied_folder_path)
    assert after["a2.txt"].embedding == rows["a2.txt"].embedding


def test_other_scripts(spark):
    texts = {
        "r1.txt": "Планеты вращаются вокруг далёких звёзд нашей галактики",
        "r2.txt": "Планеты вращаются вокруг далёких звёзд другой галактики",
        "j1.txt": "東京 の 天気 は 晴れ です 明日 雨 カメラ",
        "j2.txt": "東京 の 天気 は 晴れ です 昨日 雨 カメラ",
    }
    run = organize(empty_catalog(spark), scan(spark, texts), settings=Settings(similarity_threshold=0.3))
    rows = {r.filename: r for r in run.files.collect()}
    assert rows["r1.txt"].cluster_id == rows["r2.txt"].cluster_id != rows["j1.txt"].cluster_id
    assert rows["j1.txt"].cluster_id == rows["j2.txt"].cluster_id
    words = spark.createDataFrame([("Élan 東京タワーは雨 हिन्दी ab naïve",)], "text string")
    found = words.select(naming_tokens(F.col("text"), word=UNICODE_WORD).alias("w")).first().w
    assert found == ["élan", "東京", "タワー", "हिन्दी", "naïve"]
