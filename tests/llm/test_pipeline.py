"""The pipeline on a small collection, stage by stage against brute force."""

import random
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from kinshelf.llm import pack, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def sentence(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnpr") + str(rng.randrange(40)) for _ in range(n))


def write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(29)
    rows, labels = [], []
    for i in range(300):
        text, toxic = sentence(rng, rng.randint(30, 120)), i % 3 == 0
        if toxic:
            words = text.split()
            for w in ("idiot", "moron", "scum"):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        rows.append((i, text, "en", None, len(text), 0.5))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 3]
    item = sentence(rng, 20)
    extra = [
        clean[0][1], clean[1][1] + " changed", f"{clean[2][1]} {item} {sentence(rng, 40)}",
        sentence(rng, 60) + " mail me@example.org now", None, "", "",
    ]
    rows += [(1000 + i, t, "en", None, len(t or ""), None) for i, t in enumerate(extra)]
    rows.append((None, "no id at all", None, None, None, None))
    write(spark, str(tmp_path), rows, labels, [(1, item), (2, None), (3, "")])
    return str(tmp_path), rows


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, toxicity), (_, copies), (_, clean), (_, private), (_, packing) = corpus_pipeline.STAGES
    columns = docs.columns

    docs = toxicity(spark, docs, folder)
    assert docs.columns == columns
    left = {r.doc_id for r in docs.collect()}
    assert left == {r[0] for r in rows if r[0] is None or r[0] >= 1000 or r[0] % 3}

    docs = copies(spark, docs, folder)
    assert docs.columns == columns
    prints = {r[0]: simhash.fingerprint((r[1] or "").encode(), 3) & (2**64 - 1) for r in rows if r[0] in left}
    ids = sorted(i for i in left if i is not None)
    left -= {b for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2}
    assert not left & {1000, 1005, 1006} and {1002, 1003, 1004, None} <= left
    assert {r.doc_id for r in docs.collect()} == left

    docs = clean(spark, docs, folder)
    assert docs.columns == columns
    left -= {1002}
    assert {r.doc_id for r in docs.collect()} == left

    before = {r.doc_id: r.text for r in docs.collect()}
    docs = private(spark, docs, folder)
    kinds = dict(docs.dtypes)
    assert docs.columns == columns and (kinds["text"], kinds["n_chars"]) == ("string", "bigint")
    for r in docs.collect():
        text = before[r.doc_id]
        assert r.text == (text and re.sub(r"me@example\.org", "[EMAIL]", text))
        assert r.n_chars == (None if r.text is None else len(r.text))

    placed = packing(spark, docs, folder).collect()
    assert {r.doc_id for r in placed} == left
    column = [r.text for r in docs.select("text").collect()]
    assert sum(r.length for r in placed) == sum(len(ids) for _, ids in pack.token_rows(pa.array(column)))


def test_run_and_empty_tables(spark, tables, tmp_path_factory):
    folder, _rows = tables
    assert corpus_pipeline.run(spark, folder).select("sequence_id").distinct().count() > 1
    empty = str(tmp_path_factory.mktemp("none"))
    write(spark, empty, [], [], [])
    assert corpus_pipeline.run(spark, empty).collect() == []
