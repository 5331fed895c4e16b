"""Search through the stored index against the scan of all texts."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from kinshelf.operators import search_index, views
from kinshelf.session import fresh_path


def test_pieces(spark):
    rows = spark.createDataFrame([("aBab",), ("",), (None,), ("é😀x",), ("z",)], "t string")
    got = [sorted(r.p) for r in rows.select(search_index.pieces(F.col("t")).alias("p")).collect()]
    assert got == [sorted(["a", "b", "ab", "ba", "aba", "bab"]), [], [], sorted(["é", "😀", "x", "é😀", "😀x", "é😀x"]), ["z"]]


def test_index_finds_what_the_scan_finds(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc é\n😀") for _ in range(rng.randrange(40))) for _ in range(80)]
    texts += [None, "", "the " * 50_000, "Straße ÉCOLE"]
    rows = [(f"p{i}", f"n{i}.txt", t, "text" if i % 2 else "pdf", "x") for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "file_path string, filename string, text string, file_type string, piece string").cache()
    path = fresh_path(spark, "search")
    search_index.build_search_index(files, path)
    for query in ["a", "AB", " bca b", "é😀", "école", "the the", "n1", "zzz", " "]:
        want = {r.file_path for r in views.search(files, query).collect()}
        assert {r.file_path for r in search_index.search_indexed(files, path, query).collect()} == want, query
    # only the lists of the rarest pieces are read
    few = search_index.candidates(spark, path, "abc é")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("(bucket#", "(bucket") or "PartitionFilters: [bucket" in plan
    assert "In(piece" in plan


def test_lists_are_the_pieces_of_documents(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé\n😀\0x") for _ in range(rng.randrange(9))) for _ in range(40)] + ["", "a"]
    rows = [(i, f"N{i % 3}", t, None if i % 5 else "T") for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "id long, filename string, text string, file_type string")
    fields = [search_index.pieces(F.col(c)) for c in ("filename", "text", "file_type")]
    listed = files.select("id", F.explode(F.array_distinct(F.concat(*fields))).alias("piece")).collect()
    want = sorted((r.piece, r.id) for r in listed)
    path = fresh_path(spark, "search")
    search_index.build_search_index(files.coalesce(1), path, key="id")
    lists = spark.read.parquet(f"{path}/lists")
    assert sorted((r.piece, i) for r in lists.collect() for i in r.documents) == want
    # a row for a piece of a task, not for every document that has it
    assert lists.count() == len({p for p, _ in want}) < len(want) / 3
    counts = {r.piece: r.documents for r in spark.read.parquet(f"{path}/counts").collect()}
    assert counts == {p: sum(q == p for q, _ in want) for p, _ in want}
    # slices and a very large alphabet give the same
    monkeypatch.setattr(search_index, "LETTERS", 20)
    low = [[(r[k] or "").lower() for r in rows] for k in (1, 2, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), *map(pa.array, low)], names=["id", "a", "b", "c"])
    slices = list(search_index._slices(batch))
    assert len(slices) > 5 and sum(s.num_rows for s in slices) == len(rows)
    found = [r for s in slices for r in search_index._listed(s.column(0), [c.to_pylist() for c in s.columns[1:]])]
    assert sorted((r["piece"], i) for b in found for r in b.to_pylist() for i in r["documents"]) == want
    wide = [list(map(chr, [*range(32, 0xD800), *range(0xE000, 0x110000)]))]
    wide = ["".join(wide[0][i :: 9]) for i in range(9)]
    halves = list(search_index._listed(pa.array(range(9)), [wide]))
    assert len(halves) > 1 and sum(len(b) for b in halves) > 3_000_000


def test_empty_index(spark):
    files = spark.createDataFrame([], "file_path string, filename string, text string, file_type string")
    path = fresh_path(spark, "search")
    search_index.build_search_index(files, path + "-none")
    assert search_index.search_indexed(files, path + "-none", "abc").count() == 0
    one = files.unionAll(spark.createDataFrame([("p", "n", None, None)], files.schema))
    search_index.build_search_index(one, path)
    assert [r.file_path for r in search_index.search_indexed(one, path, "N").collect()] == ["p"]
    assert search_index.search_indexed(one, path, "q").count() == 0
