"""The kept graph and the live catalog against full runs, on random changes."""

import random
import time
from collections import defaultdict
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinshelf import Settings
from kinshelf.functions.text import UNICODE_WORD
from kinshelf.operators import features, graph
from kinshelf.operators.components import connected_components, nested_components
from kinshelf.plans.full_run import empty_catalog, organize
from kinshelf.plans.live import LiveCatalog
from kinshelf.session import fresh_path
from kinshelf.sources import catalog_io, corpus
from kinshelf.streaming import changes as stream

LEVELS = [0.5, 0.6, 0.7, 0.8]


def by_hand(vectors, levels):
    """``{(level, doc): smallest doc}`` for documents that are not alone."""
    docs = sorted(vectors)
    unit = {d: np.array(v) / np.linalg.norm(v) for d, v in vectors.items() if any(v)}
    found = {}
    for level, limit in enumerate(levels):
        part = {d: d for d in docs}
        for a in docs:
            for b in docs:
                if a < b and a in unit and b in unit and unit[a] @ unit[b] >= limit and part[a] != part[b]:
                    low, high = sorted((part[a], part[b]))
                    part = {d: low if p == high else p for d, p in part.items()}
        sizes = defaultdict(int)
        for p in part.values():
            sizes[p] += 1
        found |= {(level, d): p for d, p in part.items() if sizes[p] > 1}
    return found


def told(g, spark):
    """``{(level, doc): smallest doc}`` of a graph, copies expanded."""
    names, members, found = {(r.level, r.node): r.component for r in g.components.collect()}, g.members.collect(), {}
    for level in range(len(LEVELS)):
        own = defaultdict(list)
        for r in members:
            if r.node is not None:
                own[names.get((level, r.node), r.node)].append(r.doc_id)
        for docs in own.values():
            if len(docs) > 1:
                found |= {(level, d): min(docs) for d in docs}
    return found


@pytest.mark.parametrize("chunk, coalesce", [(1 << 20, "true"), (7, "false")])
def test_components_of_all_levels_at_once(spark, chunk, coalesce, monkeypatch):
    """In one task, and in many that have to go through rounds."""
    from kinshelf.operators import components

    monkeypatch.setattr(components, "CHUNK", chunk)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60), rng.random()) for _ in range(90)]
    frame = spark.createDataFrame([(f"n{a}", f"n{b}", s) for a, b, s in edges], "src string, dst string, sim double")
    got = {(r.level, r.doc_id, r.component) for r in nested_components(frame, LEVELS).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = set()
    for level, limit in enumerate(LEVELS):
        part = {f"n{x}": f"n{x}" for a, b, s in edges if s >= limit and a != b for x in (a, b)}
        for a, b, s in edges * 2:
            if s >= limit and a != b and part[f"n{a}"] != part[f"n{b}"]:
                low, high = sorted((part[f"n{a}"], part[f"n{b}"]))
                part = {d: low if p == high else p for d, p in part.items()}
        want |= {(level, d, p) for d, p in part.items()}
    assert got == want
    chain = spark.createDataFrame([(i, i + 1, i % 2) for i in range(0, 400)], "src long, dst long, side int")
    ends = connected_components(chain.unionAll(chain.select("src", F.col("src").alias("dst"), "side")))
    assert {(r.doc_id, r.component) for r in ends.collect()} == {(i, 0) for i in range(401)}
    assert connected_components(chain, ["side"]).where("doc_id - component > 1").count() == 0


def test_graph_after_random_changes(spark):
    """Copies, chains that break, crowds and zero vectors; each step as if built anew."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    schema = "doc_id string, embedding array<float>"

    def vector():
        kind = rng.random()
        if kind < 0.05:
            return [0.0] * 6
        if kind < 0.15:
            return [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
        return [float(np.float32(x)) for x in centres[rng.integers(4)] + rng.normal(size=6) * rng.choice([0.2, 0.6, 1.0])]

    docs = {f"d{i:03d}": vector() for i in range(60)}
    g = graph.build_graph(spark.createDataFrame(list(docs.items()), schema), LEVELS)
    assert told(g, spark) == by_hand(docs, LEVELS)
    for step in range(2):
        changed = {f"d{i:03d}": vector() for i in rng.integers(0, 90, 15)}
        gone = {f"d{i:03d}" for i in rng.integers(0, 90, 12)}
        docs = {d: v for d, v in {**docs, **changed}.items() if d not in gone}
        g = graph.change_graph(
            g, spark.createDataFrame(list(changed.items()), schema), spark.createDataFrame([(d,) for d in gone], "doc_id string"), LEVELS
        )
        assert told(g, spark) == by_hand(docs, LEVELS), step
        assert g.vectors.count() == len({tuple(v) for v in docs.values() if any(v)}) and g.members.count() == len(docs)
    every = spark.createDataFrame([(d,) for d in docs], "doc_id string")
    none = graph.change_graph(g, spark.createDataFrame([], schema), every, LEVELS)
    assert none.members.count() == none.vectors.count() == none.components.count() == 0
    again = graph.change_graph(none, spark.createDataFrame(list(docs.items()), schema), every.limit(0), LEVELS)
    assert told(again, spark) == by_hand(docs, LEVELS)


def test_components_of_documents_have_all_copies(spark):
    """Copies are rows of their own, also alone, and a document with two vectors joins what both meet."""
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 1.0]), ("d", [0.0, 1.0]), ("e", [-1.0, 0.0])]
    rows += [("f", [0.0, 0.0]), ("g", [0.0, 0.0]), ("h", [0.0, -1.0]), ("h", [0.0, -1.0])]

    def found(rows):
        made = graph.build_graph(spark.createDataFrame(rows, "doc_id string, embedding array<double>"), LEVELS)
        copies = features.represented(made.members.withColumnRenamed("node", "bag"))
        return sorted((r.level, r.doc_id, r.component) for r in graph.document_components(made, copies).collect())

    pairs = [(i, d, c) for i in range(4) for d, c in (("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"))]
    assert found(rows) == pairs
    assert found([*rows, ("d", [1.0, 0.0])]) == [(i, d, "a") for i, d, _ in pairs]


def test_components_after_changes_with_copies(spark, tmp_path):
    """The query and its SQL on vectors of which many are equal."""
    from checks.compare import TABLES, compare

    rng = np.random.default_rng(2)
    own = [[float(np.float32(x)) for x in rng.normal(size=16)] for _ in range(12)]
    vectors = pa.array([own[i % 12] for i in range(40)], pa.list_(pa.float32()))
    labels = pa.array(rng.integers(0, 5, 40), pa.int32())
    for name in TABLES:
        pq.write_table(pa.table({"id": [0]}), f"{tmp_path}/{name}.parquet")
    table = pa.table({"vec_id": pa.array(range(40), pa.int64()), "embedding": vectors, "label": labels})
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    same, note = compare(spark, str(tmp_path), "components_after_changes")
    assert same, note


def test_only_touched_components_are_compared(spark, monkeypatch):
    rows = [(f"{g}{i}", [float(g == k) + 0.01 * i * (k == 5) for k in range(6)]) for g in range(4) for i in range(8)]
    made = graph.build_graph(spark.createDataFrame(rows, "doc_id string, embedding array<double>"), LEVELS)
    seen = []
    monkeypatch.setattr(graph, "dense_links", lambda v, t, by=None, f=graph.dense_links: seen.append(v.count()) or f(v, t, by))
    graph.change_graph(made, made.members.limit(0).select("doc_id", F.array(F.lit(1.0)).alias("embedding")), spark.createDataFrame([("13",)], "doc_id string"), LEVELS)
    assert seen == [7]


WORDS = {
    "s": "telescope planets orbiting distant stars galaxy images moon".split(),
    "b": "knead bread dough flour yeast bake oven crust".split(),
    "g": "plant garden seeds water soil roses prune weeds".split(),
}


def text(rng):
    words = WORDS[rng.choice("sbg")]
    return "" if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randint(3, 12)))


def described(spark, texts):
    rows = [(p, len(t), datetime(2024, 1, 1), t) for p, t in texts.items()]
    found = spark.createDataFrame(rows, "file_path string, file_size long, modification_date timestamp, text string")
    return corpus.describe_documents(found)


def state(files, clusters, moves):
    return (
        {r.file_path: r.cluster_id for r in files.collect()},
        {r.cluster_id: (r.folder_path, round(r.average_similarity, 9), tuple(r.keywords)) for r in clusters.collect()},
        {(r[0], r[1]) for r in moves.collect()},
    )


def as_full_run(spark, live, texts):
    """What ``organize`` makes of the documents, under the paths they have now."""
    run = organize(empty_catalog(spark), described(spark, texts), settings=live.settings, vectorize=live._hashed)
    back = {r.destination_path: r.source_path for r in run.moves.where("status = 'move'").collect()}
    files, clusters, _ = state(run.files, run.clusters, run.moves.select("source_path", "target_folder"))
    moves = {(r.source_path, r.target_folder) for r in run.moves.collect()}
    return {back.get(p, p): c for p, c in files.items()}, clusters, moves


def test_live_catalog_is_as_a_full_run(spark):
    rng = random.Random(4)
    texts = {f"n{i:02d}.txt": text(rng) for i in range(25)}
    live = LiveCatalog(spark, fresh_path(spark, "live"), Settings(similarity_threshold=0.4, max_depth=1))
    live.begin(described(spark, texts))
    now = live.tables()
    for batch_id in range(1):
        edits = {f"n{rng.randrange(40):02d}.txt": text(rng) for _ in range(6)}
        gone = set(rng.sample(sorted(texts), 4))
        texts = {p: t for p, t in {**texts, **edits}.items() if p not in gone}
        batch = [("changed", p) for p in edits] + [("deleted", p) for p in gone] + [("changed", "unreadable.txt")]
        frame = spark.createDataFrame([("home", *r) for r in batch], "root string, action string, path string")
        content = described(spark, {**edits, **{p: "x" for p in gone}})
        describe = lambda paths: content.join(paths, "file_path", "left_semi")  # noqa: B023, E731
        # what an attempt without a marker has left does no harm
        catalog_io.write_snapshot(now["files"].limit(1), live.catalog, "files", batch_id + 2)
        version = live.apply(frame, batch_id, describe)
        assert version == batch_id + 2 and live.apply(frame, batch_id, lambda paths: 1 / 0) == version
        now = live.tables()
        got, want = state(now["files"], now["clusters"], now["moves"]), as_full_run(spark, live, texts)
        assert got == want, batch_id


def test_stream_reclusters(spark, tmp_path):
    """Changes arrive as files, bursts end by the clock, and every burst is a version."""
    texts = {f"n{i}.txt": " ".join(WORDS["sbg"[i % 3]][:6]) for i in range(6)}
    live = LiveCatalog(spark, fresh_path(spark, "live"), Settings(similarity_threshold=0.4, max_depth=0, debounce_seconds=1))
    live.begin(described(spark, texts))
    texts["n9.txt"] = " ".join(WORDS["g"])
    del texts["n0.txt"]
    old = datetime(2020, 1, 1)  # far too late for any watermark
    rows = [(old, "created", "n9.txt", None, "home"), (datetime.now(), "deleted", "n0.txt", None, "home")]
    schema = "ts timestamp, kind string, path string, dest_path string, root string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    content = described(spark, texts)

    def apply(batch, batch_id):
        live.apply(batch, batch_id, lambda paths: content.join(paths, "file_path", "left_semi"))

    query = stream.follow_changes(source, str(tmp_path / "state"), apply, live.settings, by_arrival=True)
    try:
        until = time.time() + 180
        while catalog_io.latest_version(spark, live.catalog) < 2 and time.time() < until:
            assert query.isActive, query.exception()
            time.sleep(0.5)
    finally:
        query.stop()
    rows = {r.file_path: r.cluster_id for r in live.tables()["files"].collect()}
    assert set(rows) == set(texts) and len(set(rows.values())) == 3
    assert rows["n9.txt"] == rows["n2.txt"] == rows["n5.txt"] and rows["n1.txt"] == rows["n4.txt"] != rows["n3.txt"]


def test_bursts_by_arrival(spark, tmp_path):
    """A burst goes on while changes arrive, ends by the clock, and leaves no state."""
    told_, path = [], str(tmp_path / "in")
    schema = "ts timestamp, action string, path string, root string, top string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)

    def arrive(*rows):
        spark.createDataFrame([(datetime(2020, 1, 1), a, p, r, "t") for a, p, r in rows], schema).coalesce(1).write.mode("append").parquet(path)

    arrive(("changed", "a", "x"), ("changed", "a", "x"), ("deleted", "a", "x"), ("changed", "q", "y"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    bursts = stream.debounce_arrivals(source, 3, ["root", "top"])
    query = bursts.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(
        lambda frame, n: told_.extend(frame.collect())
    ).start()
    try:
        until = time.time() + 120
        while not query.recentProgress and time.time() < until:
            time.sleep(0.2)
        arrive(("changed", "b", "x"))
        while len({(r.root, r.path) for r in told_}) < 3 and time.time() < until:
            assert query.isActive, query.exception()
            time.sleep(0.5)
        arrive(("changed", "a", "x"))
        while len(told_) < 5 and time.time() < until:
            assert query.isActive, query.exception()
            time.sleep(0.5)
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted((r.root, r.action, r.path) for r in told_) == [
        ("x", "changed", "a"), ("x", "changed", "a"), ("x", "changed", "b"), ("x", "deleted", "a"), ("y", "changed", "q"),
    ]
    assert all(r.ts == datetime(2020, 1, 1) and r.started <= r.ended and r.top == "t" for r in told_)


def test_equal_content_is_encoded_once(spark, tmp_path):
    """Loads and encoded texts of a model are counted by the files it leaves."""
    marks = tmp_path / "marks"
    marks.mkdir()

    def load():
        import os
        import uuid

        (marks / f"load-{os.getpid()}-{uuid.uuid4().hex}").touch()

        def encode(texts):
            for t in texts:
                (marks / f"text-{t.strip()[:20]}-{uuid.uuid4().hex}").touch()
            return np.array([[len(t), 1.0] for t in texts], np.float32)

        return encode

    def vectorize(docs):
        return features.model_vectors(docs, f"counting-{tmp_path}", load, 2, at_once=3)

    rows = [(f"p{i}", f"c{i % 4}", f"text {i % 4}") for i in range(12)] + [("blank", "cb", " \n"), ("none", "cn", None), ("known", "ck", "old")]
    renewed = spark.createDataFrame(rows, "file_path string, checksum string, text string")
    files = spark.createDataFrame([("elsewhere", "ck", [7.0, 7.0]), ("empty", "c1", None)], "file_path string, checksum string, embedding array<float>")
    got = {r.file_path: r.embedding for r in features.vectors_by_content(files, renewed, vectorize).collect()}
    assert got == {**{f"p{i}": [6.0, 1.0] for i in range(12)}, "blank": [0.0, 0.0], "none": [0.0, 0.0], "known": [7.0, 7.0]}
    names = [p.name for p in marks.iterdir()]
    assert sorted(n.split("-")[1] for n in names if n.startswith("text")) == [f"text {i}" for i in range(4)]
    workers = {n.split("-")[1] for n in names if n.startswith("load")}
    assert len(workers) == sum(n.startswith("load") for n in names)


@pytest.mark.parametrize("word", [UNICODE_WORD])
def test_hashed_terms_stay(spark, word):
    one = spark.createDataFrame([("a", ["x", "y", "x"])], "doc_id string, tokens array<string>")
    two = one.unionAll(spark.createDataFrame([("b", ["x", "z"])], one.schema))
    first = features.hashed_terms(one, 32).first().embedding
    assert features.hashed_terms(two, 32).where("doc_id = 'a'").first().embedding == first
    assert abs(sum(x * x for x in first) - 1) < 1e-6
