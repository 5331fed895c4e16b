"""Terms inside words, places of sparse vectors, and edits that a scan finds."""

import math
import random
import re
import time
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinshelf import Settings
from kinshelf.operators import catalog, features, naming, spaces, views
from kinshelf.session import cut_lineage
from kinshelf.streaming import changes as stream


@pytest.mark.parametrize("piece", [24, 4])
def test_terms_inside_words(spark, piece, monkeypatch):
    """Every term in every word, with terms inside terms, repeats inside a word and long words."""
    monkeypatch.setattr(naming, "PIECE", piece)
    rng = random.Random(piece)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(150)}
    words |= {"party", "art", "parties", "éart", "x" * 3000, "cart" * 500}
    terms = set(rng.sample(sorted(words), 60)) | {"art", "arty", "tie", "xxx", "cartcart", "none", "x" * 40}
    got = naming.term_holders(
        spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string")
    )
    assert sorted(map(tuple, got.collect())) == sorted((w, t) for w in words for t in terms if t in w)


def test_shares_of_words_and_pairs(spark):
    rng = random.Random(2)
    stock = ["car", "scar", "carpet", "pet", "red", "scarred", "carp", "bored", "petal", "redcar"]
    docs = {i: [rng.choice(stock) for _ in range(rng.randint(0, 9))] for i in range(30)}
    tokens = spark.createDataFrame([(i, [], w) for i, w in docs.items()], "doc_id int, stem_tokens array<string>, tokens array<string>")
    members = spark.createDataFrame([("f", str(i % 4), i) for i in docs], "family string, grp string, doc_id int")
    terms = [*stock, "red car", "red carp", "car pet", "pet red", "scarred carpet", "car car"]
    wanted = spark.createDataFrame([("f", str(g), t) for g in range(4) for t in terms], "family string, grp string, term string")
    got = {(r.grp, r.term): r.share for r in naming.term_shares(tokens, members, wanted).collect()}
    for g in range(4):
        own = [" ".join(w) for i, w in docs.items() if i % 4 == g]
        for t in terms:
            assert got.get((str(g), t), 0.0) == pytest.approx(sum(t in text for text in own) / len(own)), (g, t)


def test_map_of_sparse_vectors_is_that_of_exact_axes(spark):
    rng = np.random.default_rng(3)
    dense = (rng.random((40, 25)) < 0.2) * rng.random((40, 25))
    dense[:, 0] += rng.random(40) * 3
    dense[:20, 1] += 2
    dense[7] = 0
    rows = [(d, f"t{t:02d}", float(dense[d, t])) for d in range(40) for t in range(25) if dense[d, t]]
    copies = [(d, d, 1 + 2 * (d == 5)) for d in range(40)] + [(100, 5, 3), (101, 5, 3)]
    made = views.map_terms(
        spark.createDataFrame(rows, "doc_id int, term string, w double"),
        spark.createDataFrame(copies, "doc_id int, rep int, n int"),
        rounds=12,
    )
    got = {r.doc_id: (r.x, r.y) for r in made.collect()}
    every = np.vstack([dense, dense[5], dense[5]])
    centred = every - every.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2] * np.sign(axes[:2][np.arange(2), np.abs(axes[:2]).argmax(axis=1)])[:, None]
    want = centred @ axes.T
    assert set(got) == {*range(40), 100, 101} and got[100] == got[5]
    assert np.allclose([got[d] for d in [*range(40), 100, 101]], want, atol=1e-3)


FILES = "file_path string, file_size long, modification_date timestamp"
T0 = datetime(2024, 1, 1)


def test_scan_finds_edits_and_opens_only_folders_that_differ(spark):
    files = [(f"d{i % 5}/f{i}.txt", i, T0) for i in range(50)] + [("top.txt", 1, T0), ("d0/sub/x.txt", 1, None)]
    now = {p: (p, s, t) for p, s, t in files}
    now["d1/f1.txt"] = ("d1/f1.txt", 99, T0)
    now["d1/f6.txt"] = ("d1/f6.txt", 6, T0 + timedelta(microseconds=1))
    now["d9/new.txt"] = ("d9/new.txt", 1, T0)
    del now["top.txt"]
    old, new = spark.createDataFrame(files, FILES), spark.createDataFrame(list(now.values()), FILES)
    got = {r.file_path: r.status for r in catalog.scan_changes(old, new).collect()}
    assert got == {"d1/f1.txt": "edited", "d1/f6.txt": "edited", "d9/new.txt": "new", "top.txt": "removed"}
    assert catalog.scan_changes(new, new).isEmpty()
    batches = []
    assert stream.reconcile(old, new, lambda paths: None, apply=lambda batch: batches.append(batch) or batch) is not None
    assert sorted(map(tuple, batches[0].collect())) == [
        ("changed", "d1/f1.txt"), ("changed", "d1/f6.txt"), ("changed", "d9/new.txt"), ("deleted", "top.txt"),
    ]
    assert stream.reconcile(new, new, lambda paths: None) is None


def test_reconcile_runs_in_a_rhythm(spark, tmp_path):
    runs = []
    query = stream.every_few_seconds(spark, lambda: runs.append(time.time()), str(tmp_path / "clock"), Settings(reconcile_seconds=1))
    try:
        until = time.time() + 60
        while len(runs) < 3 and time.time() < until:
            assert query.isActive, query.exception()
            time.sleep(0.2)
    finally:
        query.stop()
    assert len(runs) >= 3 and runs[2] - runs[1] > 0.5


def test_keywords_of_clusters_in_slices(spark, monkeypatch):
    """A cluster dealt out to many slices has the keywords that brute force finds."""
    monkeypatch.setattr(naming, "SLICE", 3)
    rng = np.random.default_rng(4)
    vocabulary = ["apple", "berry", "cedar", "delta", "ember", "fjord", "grape", "hazel", "irony", "joker"]
    docs = [(i, i % 2, [vocabulary[k] for k in rng.integers(0, 10, rng.integers(1, 9))]) for i in range(30)]
    tokens = spark.createDataFrame([(i, [], words) for i, _, words in docs], "doc_id long, stem_tokens array<string>, tokens array<string>")
    members = spark.createDataFrame([(f"c{c}", i) for i, c, _ in docs], "cluster_id string, doc_id long")
    for most_frequent in (None, 12):
        found = naming.extract_keywords(tokens, members, 5, [], most_frequent)
        got = {r.cluster_id: r.keywords for r in found.collect()}
        for c in (0, 1):
            counts = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for _, own, w in docs if own == c]
            df, total = Counter(t for d in counts for t in d), Counter()
            for d in counts:
                total.update(d)
            kept = set(sorted(total, key=lambda t: (-total[t], t))[:most_frequent])
            score = Counter()
            for d in counts:
                w = {t: (1 + math.log(n)) * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, n in d.items() if t in kept}
                length = math.sqrt(sum(x * x for x in w.values()))
                for t, x in w.items():
                    score[t] += x / length
            usable = {t: x * (1.4 if " " in t else 1) for t, x in score.items() if " " not in t or len(set(t.split())) > 1}
            best = sorted(((round(x, 12), t) for t, x in usable.items()), reverse=True)[:5]
            assert got[f"c{c}"] == [t for _, t in best]


def test_words_are_counted_where_their_document_is(spark, monkeypatch):
    """Counting the words of a document does not move them."""
    tokens = spark.createDataFrame(
        [(i, [], ["red", "car", f"w{'x' * i}"]) for i in range(6)], "doc_id long, stem_tokens array<string>, tokens array<string>"
    )
    plan = features.tfidf_vectors(tokens)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term#", plan)
    plans, cut = [], naming.cut_lineage

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(naming, "cut_lineage", watched)
    members = tokens.select((F.col("doc_id") % 2).alias("family"), (F.col("doc_id") % 3).alias("grp"), "doc_id")
    assert naming.group_tfidf(tokens, members).count() > 0
    assert not any(re.search(r"hashpartitioning\([^)]*doc_id#\d+L?, term#", p) for p in plans)


def _contrast(tokens, members, max_share=0.7):
    """Weights of ``group_tfidf`` by its definition: ``{(family, grp, term): (docs, w)}``."""
    tf, docs = Counter(), Counter()
    for family, grp, doc in members:
        own = tokens[doc][0] * naming.STEM_WEIGHT + tokens[doc][1]
        terms = Counter(own + [f"{a} {b}" for a, b in zip(own, own[1:])])
        tf.update({(family, grp, t): n for t, n in terms.items()})
        docs.update((family, grp, t) for t in terms)
    n = Counter(family for family, _ in {(f, g) for f, g, _ in members})
    df = Counter((f, t) for f, _, t in tf)
    raw = {
        (f, g, t): (1 + math.log(k)) * (math.log((1 + n[f]) / (1 + df[f, t])) + 1)
        for (f, g, t), k in tf.items()
        if df[f, t] <= max_share * n[f]
    }
    square = Counter()
    for (f, g, _), w in raw.items():
        square[f, g] += w * w
    return {k: (docs[k], w / math.sqrt(square[k[:2]])) for k, w in raw.items()}


def _grouped_texts(spark):
    rng = random.Random(5)
    stock = [a + b + c for a in "bcd" for b in "aeo" for c in "lmr"]
    tokens = {i: ([rng.choice(stock)], [rng.choice(stock) for _ in range(rng.choice([2, 9, 40]))]) for i in range(70)}
    members = [("wide", f"g{i // 2}" if i < 40 else "big", i) for i in tokens]
    members += [(f"f{i % 9}", f"g{i // 30}", i) for i in tokens]
    return tokens, members, (
        spark.createDataFrame([(i, *w) for i, w in tokens.items()], "doc_id int, stem_tokens array<string>, tokens array<string>"),
        spark.createDataFrame(members, "family string, grp string, doc_id int"),
    )


@pytest.mark.parametrize("words", [1 << 19, 400, 50])
def test_contrast_of_siblings_in_slices(spark, words, monkeypatch):
    """All families in one task, families over several, and groups too large for a task."""
    monkeypatch.setattr(naming, "SLICE_WORDS", words)
    tokens, members, (texts, rows) = _grouped_texts(spark)
    wanted = _contrast(tokens, members)
    got = {(r.family, r.grp, r.term): (r.docs, r.w) for r in naming.group_tfidf(texts, rows, stop_words=["none"]).collect()}
    assert got.keys() == wanted.keys()
    assert all(got[k][0] == wanted[k][0] and got[k][1] == pytest.approx(wanted[k][1]) for k in wanted)


def test_likely_terms_are_all_that_promise(spark, monkeypatch):
    """What is left out in the tasks is what the bounds leave out, and names stay."""
    monkeypatch.setattr(naming, "SLICE_WORDS", 400)
    _, _, (texts, rows) = _grouped_texts(spark)
    every = cut_lineage(naming.group_tfidf(texts, rows))
    likely = cut_lineage(naming.group_tfidf(texts, rows, likely=True))
    assert likely.count() < every.count()
    assert likely.select("family", "grp").distinct().count() == every.select("family", "grp").distinct().count()
    key = ["family", "grp", "term"]
    kept = [sorted(map(tuple, naming.promising_terms(w, rows).select(key).collect())) for w in (every, likely)]
    assert kept[0] == kept[1]


def test_no_term_of_a_group_moves_but_once_a_slice(spark):
    """The rows that are joined or dealt out are those of slices, not those of groups."""
    _, _, (texts, rows) = _grouped_texts(spark)
    rows = rows.withColumn("family", F.lit("f")).withColumn("grp", F.pmod("doc_id", F.lit(35)).cast("string"))
    made = naming.group_tfidf(texts, rows)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert "hashpartitioning(family" not in plan


def test_means_are_made_once_for_a_join(spark, monkeypatch):
    """The join reads the means twice, so it gets a written table."""
    seen = []
    real = spaces.sparse_matches
    monkeypatch.setattr(spaces, "sparse_matches", lambda left, right, *rest: seen.append(right) or real(left, right, *rest))
    rows = [(1, "a", 0.6), (1, "b", 0.8), (2, "a", 0.8), (2, "b", 0.6), (3, "a", 1.0)]
    vectors = spark.createDataFrame(rows, "doc_id long, term string, w double")
    points = spark.createDataFrame([("root", 3)], "parent string, doc_id long")
    members = spark.createDataFrame([("root", 1, 1, 1), ("root", 2, 1, 1)], "parent string, doc_id long, n long, grp long")
    found = spaces.SparseSpace(vectors).nearest(points, members, 0.5).collect()
    assert [(r.doc_id, r.grp, round(r.sim, 9)) for r in found] == [(3, 1, round(math.sqrt(0.5), 9))]
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
