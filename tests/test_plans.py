from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinshelf import Settings
from kinshelf.operators import catalog, moves, naming, views
from kinshelf.operators.delta import apply_denials
from kinshelf.plans.organize import build_clusters, prepare, prepare_with_vectors, recluster
from kinshelf.sources import catalog_io, corpus
from kinshelf.streaming import changes as stream

T0 = datetime(2024, 1, 1)

TOPICS = [
    ("a1.txt", "Telescope images show planets orbiting distant stars near the galaxy center"),
    ("a2.txt", "Planets orbiting stars in a distant galaxy seen through the telescope"),
    ("b1.txt", "Knead bread dough with flour and yeast, then bake the bread in the oven"),
    ("b2.txt", "Bake bread dough made of flour yeast and water in a hot oven"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "doc_id long, filename string, text string")


def test_topics_separate(spark):
    made = build_clusters(prepare(docs(spark, TOPICS), "filename"), Settings(similarity_threshold=0.3))
    cluster = {r.doc_id: r.cluster_id for r in made.assignments.collect()}
    assert len(cluster) == 4
    assert cluster[0] == cluster[1] != cluster[2] == cluster[3]
    rows = {r.cluster_id: r for r in made.clusters.collect()}
    assert len(rows) == 2 and all(r["size"] == 2 and r.keywords for r in rows.values())
    assert all(r.folder_name not in ("", "Uncategorized") for r in rows.values())


def test_one_document_is_named_by_its_words(spark):
    made = build_clusters(prepare(docs(spark, [("x.txt", "zebra zebra lion")]), "filename"))
    row = made.clusters.first()
    assert row.folder_name == "Zebra_Lion" and row.keywords == ["zebra", "lion"]
    assert row.average_similarity == 1.0


def test_wordless_documents(spark):
    made = build_clusters(prepare(docs(spark, [("1.txt", "12"), ("2.txt", "12"), ("3.txt", "34")])))
    assert made.clusters.count() == 3
    assert {r.folder_name for r in made.clusters.collect()} == {"Collection"}


def test_given_vectors(spark):
    vectors = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.0, 1.0])], "doc_id long, embedding array<float>"
    )
    made = build_clusters(prepare_with_vectors(docs(spark, TOPICS), vectors, "filename"))
    cluster = {r.doc_id: r.cluster_id for r in made.assignments.collect()}
    assert cluster[0] == cluster[1] != cluster[2] == cluster[3]


def test_recluster_delta(spark):
    collection = prepare(docs(spark, TOPICS), "filename")
    config = Settings(similarity_threshold=0.3)
    first = build_clusters(collection, config)
    folder = {r.doc_id: r.folder for r in first.assignments.collect()}
    denials = spark.createDataFrame([(0, folder[0])], "doc_id long, denied_folder string")
    old = first.clusters.select("cluster_id").unionAll(spark.createDataFrame([("gone",)], "cluster_id string"))
    made, moved, removed = recluster(collection, config, old, denials)
    assert {r.doc_id: r.folder for r in moved.collect()} == {**folder, 0: "."}
    assert [r.cluster_id for r in removed.collect()] == ["gone"]
    assert made.assignments.count() == 3


@pytest.mark.parametrize("denied, target, dropped", [
    ("A", "A", True), ("A", "A/B", True), ("A/B", "A", True), ("A", "AB", False), ("/A/", "A", True),
])
def test_denials(spark, denied, target, dropped):
    assigned = spark.createDataFrame([(1, target)], "doc_id long, folder string")
    refused = spark.createDataFrame([(1, denied)], "doc_id long, denied_folder string")
    assert (apply_denials(assigned, refused).count() == 0) is dropped


def test_sibling_suffixes(spark):
    names = spark.createDataFrame(
        [(1, i, i, n, True) for i, n in enumerate("XYXX")], "family long, grp long, ordinal long, name string, compared boolean"
    )
    made = {r.grp: r.name for r in naming.unique_sibling_labels(names).collect()}
    assert [made[i] for i in range(4)] == ["X", "Y", "X_1", "X_2"]


def test_long_words_in_shares(spark):
    long = "q" * 30
    tokens = spark.createDataFrame(
        [(1, [], ["party", "scarred", "carpet", "xx" + long]), (2, [], ["art", "red", "car", long])],
        "doc_id long, stem_tokens array<string>, tokens array<string>",
    )
    members = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "family long, grp long, doc_id long")
    wanted = ["art", "red car", "party", long, "car", "absent"]
    terms = spark.createDataFrame([(0, 0, t) for t in wanted], "family long, grp long, term string")
    made = {r.term: r.share for r in naming.term_shares(tokens, members, terms).collect()}
    assert made == {"art": 1.0, "red car": 1.0, "party": 0.5, long: 1.0, "car": 1.0}


def test_move_plan(spark):
    plan = moves.move_plan(
        spark.createDataFrame(
            [("gone.txt", "A"), ("A/in.txt", "A"), ("x/dup.txt", "A"), ("x/go.txt", "A"), ("y/go.txt", "A"), ("A/up.txt", ".")],
            "source_path string, target_folder string",
        ),
        spark.createDataFrame([(p,) for p in ("A/in.txt", "x/dup.txt", "A/dup.txt", "x/go.txt", "y/go.txt", "A/up.txt")], "file_path string"),
    )
    assert {r.source_path: (r.status, r.destination_path) for r in plan.collect()} == {
        "gone.txt": ("missing", "A/gone.txt"),
        "A/in.txt": ("in place", "A/in.txt"),
        "x/dup.txt": ("taken", "A/dup.txt"),
        "x/go.txt": ("move", "A/go.txt"),
        "y/go.txt": ("taken", "A/go.txt"),
        "A/up.txt": ("move", "up.txt"),
    }


def log(spark, kinds):
    rows = [
        (f"{i:02d}", T0 - timedelta(minutes=i), kind, f"src/{i}.txt", f"dst/{i}.txt", ok)
        for i, (kind, ok) in enumerate(kinds)
    ]
    return spark.createDataFrame(rows, "operation_id string, timestamp timestamp, operation_type string, source_path string, destination_path string, success boolean")


def test_undo(spark):
    here = spark.createDataFrame([(f"dst/{i}.txt",) for i in range(9)], "file_path string")
    folders = spark.createDataFrame([("src",)], "folder string")
    ops = log(spark, [("create_folder", True), ("move", False), ("move", True), ("move", True)])
    assert [tuple(r) for r in moves.undo_plan(ops, here, folders).collect()] == [("02", "dst/2.txt", "src/2.txt")]
    ops = log(spark, [("create_folder", True)] * 3 + [("move", True)])
    assert moves.undo_plan(ops, here, folders).count() == 0


def test_unique_destinations(spark):
    wanted = spark.createDataFrame([(i, p) for i, p in enumerate(["d/a.txt", "d/a.txt", "d/a_7.txt", "d/b.txt", "d/a_1_1.txt"])], "doc_id long, path string")
    taken = spark.createDataFrame([(p,) for p in ("d/a.txt", "d/a_1.txt", "d/a_3.txt", "d/a_7.txt", "d/a_1_1.txt")], "file_path string")
    made = {r.doc_id: r.destination for r in moves.unique_destinations(wanted, taken).collect()}
    assert made == {0: "d/a_2.txt", 1: "d/a_4.txt", 4: "d/a_5.txt", 2: "d/a_6.txt", 3: "d/b.txt"}


def test_incremental(spark):
    files = spark.createDataFrame(
        [("a", "1", [1.0], "c1", 0.5), ("b", "1", None, "c2", 0.5), ("c", "1", [1.0], "c3", 0.5)],
        "file_path string, checksum string, embedding array<float>, cluster_id string, confidence_score double",
    )
    seen = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")], "file_path string, checksum string")
    reused, renewed = catalog.incremental_analyze(files, seen)
    assert [r.file_path for r in reused.collect()] == ["a"]
    assert {r.file_path: r.cluster_id for r in renewed.collect()} == {"b": "c2", "c": "c3", "d": None}


def test_files_on_disk(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    for name, data in {
        "a.txt": b"hello", "empty.md": b"", "sub/raw.log": bytes(range(256)), "x.png": b"1", ".hidden/h.txt": b"2",
    }.items():
        (root / name).write_bytes(data)
    scan = corpus.scan_corpus(spark, str(root))
    rows = {r.file_path: r for r in corpus.describe_documents(scan, "content").collect()}
    assert set(rows) == {"a.txt", "sub/raw.log", "empty.md"} and rows["empty.md"].text == ""
    assert rows["a.txt"].text == "hello" and rows["a.txt"].file_size == 5
    blank = spark.createDataFrame([("e.md", 0, T0, "")], "file_path string, file_size long, modification_date timestamp, text string")
    assert corpus.describe_documents(blank).first().content_summary is None
    assert "\ufffd" in rows["sub/raw.log"].text
    path = catalog_io.write_snapshot(spark.createDataFrame([("a.txt", "a.txt")], "file_path string, filename string"), str(tmp_path / "cat"), "files", 1)
    row = catalog_io.read_files(spark, path).first()
    assert row.confidence_score == 0.0 and row.embedding is None


def test_map_needs_two_documents(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, embedding array<float>")
    assert [tuple(r) for r in views.map_coordinates(one).collect()] == [(1, 0.0, 0.0)]


CHANGE = "ts timestamp, kind string, path string, dest_path string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_normalize(spark):
    raw = [("moved", "a.txt", "b.jpg"), ("moved", "a.jpg", "b.md"), ("created", "x.png", None), ("deleted", "y.png", None), ("modified", ".git/a.txt", None)]
    rows = stream.normalize_changes(spark.createDataFrame([(T0, *r) for r in raw], CHANGE)).collect()
    assert sorted((r.action, r.path) for r in rows) == [
        ("changed", "b.md"), ("deleted", "a.jpg"), ("deleted", "a.txt"), ("deleted", "y.png"),
    ]


K8 = [(0.0, "changed", "a"), (1.0, "changed", "b"), (2.5, "deleted", "a"), (6.0, "changed", "c"), (8.0, "changed", "z")]


def test_debounce_table(spark):
    rows = spark.createDataFrame([(at(s), a, p, 1) for s, a, p in K8], "ts timestamp, action string, path string, root int")
    made = stream.debounce_batch(rows, 2, ["root"]).collect()
    assert {(r.path, r.action): (r.session - T0).total_seconds() for r in made} == {
        ("a", "changed"): 0.0, ("b", "changed"): 0.0, ("a", "deleted"): 0.0, ("c", "changed"): 6.0, ("z", "changed"): 6.0,
    }


def test_intervals(spark):
    rows = spark.createDataFrame([(at(s), str(s)) for s in (0, 9, 10, 12, 13, 100)], "ts timestamp, path string")
    syncs = spark.createDataFrame([(at(10),)], "sync_ts timestamp")
    assert {r.path for r in stream.cooldown(rows, syncs).collect()} == {"0", "9", "13", "100"}


def test_stream_updates_catalog(spark, tmp_path):
    """Files of changes arrive; the debounced batches keep a catalog."""
    source = tmp_path / "changes"
    raw = [(at(0), "created", "a.txt", None), (at(1), "created", "b.txt", None), (at(1.5), "deleted", "a.txt", None), (at(60), "created", "late.txt", None)]
    schema = CHANGE + ", root string"
    raw = [(*r, "home") for r in raw]
    spark.createDataFrame(raw[:3], schema).coalesce(1).write.parquet(str(source))
    applied = []

    def apply(batch, batch_id):
        applied.append(sorted((r.action, r.path) for r in batch.collect()))

    def run():
        changes = spark.readStream.schema(schema).parquet(str(source))
        query = stream.follow_changes(changes, str(tmp_path / "check"), apply, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    spark.createDataFrame(raw[3:], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert applied == [[("changed", "a.txt"), ("changed", "b.txt"), ("deleted", "a.txt")]]

    files = spark.createDataFrame([("a.txt", "0", "c1", 0.5, [1.0])], "file_path string, checksum string, cluster_id string, confidence_score double, embedding array<float>")
    batch = spark.createDataFrame(applied[0], "action string, path string")
    after = stream.apply_changes(files, batch, lambda p: p.select("file_path", F.lit("1").alias("checksum"), F.array(F.lit(2.0).cast("float")).alias("embedding")))
    assert [(r.file_path, r.checksum) for r in after.collect()] == [("b.txt", "1")]


def test_last_burst_is_applied_after_its_quiet_time(spark, tmp_path):
    """No later change comes; the clock alone ends the burst. A paused time is left out."""
    import time

    now = datetime.now()
    rows = [(now, "created", "a.txt", None, "r"), (now - timedelta(hours=2), "created", "b.txt", None, "r")]
    schema = "ts timestamp, kind string, path string, dest_path string, root string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    pauses = spark.createDataFrame([(now - timedelta(hours=3), now - timedelta(hours=1))], "start timestamp, end timestamp")
    changes = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    applied = []
    query = stream.follow_changes(
        changes, str(tmp_path / "state"), lambda batch, _: applied.extend(batch.collect()),
        Settings(debounce_seconds=1), heartbeat=True, pauses=pauses,
    )
    try:
        until = time.time() + 90
        while not applied and time.time() < until:
            assert query.isActive, query.exception()
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r.root, r.action, r.path) for r in applied] == [("r", "changed", "a.txt")]


def test_steps_are_removed(spark):
    import os

    from kinshelf.session import cut_lineage, fresh_path, removing_steps

    with removing_steps(spark):
        kept = fresh_path(spark, "written")
        inner = cut_lineage(spark.range(3))
        assert inner.count() == 3
        path = inner.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path) and not os.path.exists(kept)
    outside = cut_lineage(spark.range(3))
    assert outside.count() == 3


def test_scan_reads_all_visible_files(spark, tmp_path):
    root = tmp_path / "root"
    (root / "_sub").mkdir(parents=True)
    texts = {"a.txt": "x", "empty.txt": "", "_note.txt": "y", "_sub/b.md": "z", ".hidden.txt": "h", "c.exe": "", "ü b.txt": "é"}
    texts |= {"deep/er/and/deeper/x.log": "1", "deep/.git/y.txt": "2", "long.txt": "w " * 200_000}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "deep" / "back").symlink_to(root)
    (root / "deep" / ".git").chmod(0o000)  # never entered
    found = corpus.scan_corpus(spark, str(root))
    rows = {r.file_path: r for r in found.collect()}
    want = set(texts) - {".hidden.txt", "c.exe", "deep/.git/y.txt"}
    assert set(rows) == want and found.count() == len(want)
    for name in want:
        data = texts[name].encode()
        assert bytes(rows[name].content) == data and rows[name].file_size == len(data)
        assert abs(rows[name].modification_date.timestamp() - (root / name).stat().st_mtime) < 0.001
    listed = corpus.list_files(spark, f"file://{root}/")
    assert {(r.file_path, r.file_size) for r in listed.collect()} == {(n, r.file_size) for n, r in rows.items()}
    (root / "a.txt").unlink()
    assert {r.file_path for r in corpus.with_content(listed, str(root)).collect()} == want - {"a.txt"}
    (tmp_path / "bare").mkdir()
    assert corpus.scan_corpus(spark, str(tmp_path / "bare")).count() == 0

    # a reconcile run keeps their rows
    known = [(r.file_path, r.file_size, r.modification_date) for r in rows.values()]
    files = spark.createDataFrame(known, "file_path string, file_size long, modification_date timestamp")
    files = catalog_io.complete_columns(files, catalog_io.FILES_SCHEMA)
    assert stream.reconcile(files, listed, lambda paths: None) is None


def test_build_clusters_query_places_every_document(spark, tmp_path):
    """The whole clustering: each document, copies too, with its cluster and what is told of it."""
    from checks.queries import QUERIES

    texts = [text for _, text in TOPICS] + [TOPICS[0][1], "", None]
    rows = [(i, text, "en", "src0", len(text or "")) for i, text in enumerate(texts)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["build_clusters"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    clusters = {(r.cluster_id, r.folder_name, r.size, r.average_similarity, tuple(r.keywords)) for r in found}
    assert len(clusters) == len({r.cluster_id for r in found})
    assert all(size == sum(r.cluster_id == c for r in found) for c, _, size, _, _ in clusters)
