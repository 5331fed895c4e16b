"""Files of token ids against plain lists of ids."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinshelf.llm import token_files
from kinshelf.session import fresh_path


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.word_vocabulary())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


TEXTS = [
    "Hello, world! it's 2024...", None, "", " \t\n", "Ünïcödé ÉCOLE éá á.", "日本語。テキスト", "a\x01b \x01 c", "x" * 5000,
    "<|endoftext|> and <|startoftext|>x", "don't 'stop' I'LL (see [1], p.12)", "a\x85b c d", "tab\tand\x0bmore\x1cend",
    "same", "same", "A.B,C-d_e/f", "…,“quoted”.", "İstanbul ΣΑΣ K", "﻿bom", "12.5% of $3,000",
]


def test_units_have_the_ids_of_whole_texts():
    rng = random.Random(1)
    signs = "aB é1'’s.,-—\n\x01_日́ⅷ½"
    texts = [*TEXTS, *("".join(rng.choice(signs) for _ in range(60)) for _ in range(300))]
    got = token_files.token_rows(pa.array(texts), token_files.word_vocabulary(), token_files.WordUnits)
    for (row, ids), want in zip(got, encoded(texts)):
        assert ids.tolist() == want, texts[row]


@pytest.mark.parametrize("size, top", [(0, 1), (1, 1), (300, 7), (70_000, 49_407), (33_000, 1 << 20)])
def test_wavelet_matrix(size, top):
    rng = np.random.default_rng(size)
    ids = (rng.zipf(1.3, size) % top).astype(np.uint32)
    blob = token_files.to_file(ids, pa.table({"doc_id": pa.array([1]), "n_tokens": pa.array([size])}))
    matrix = token_files.WaveletMatrix.of(blob)
    assert matrix.size == size and (matrix.tokens() == ids).all()
    at = rng.integers(0, size, min(size, 400)) if size else np.zeros(0, int)
    assert (token_files.WaveletMatrix.of(blob).access(at) == ids[at]).all()
    for token in {0, 1, 2, top - 1, 1 << 25, *ids[:5].tolist()}:
        low, high = sorted(rng.integers(0, size + 1, 2).tolist())
        assert matrix.count(token) == (ids == token).sum()
        assert matrix.count(token, low, high) == (ids[low:high] == token).sum()
        assert (matrix.occurrences(token) == np.flatnonzero(ids == token)).all()
        assert (matrix.occurrences(token, low, high) == low + np.flatnonzero(ids[low:high] == token)).all()
    for wrong in (-1, size):
        with pytest.raises(IndexError):
            matrix.access([wrong])


def test_a_question_reads_few_blocks_and_the_file_is_small():
    ids = (np.random.default_rng(4).zipf(1.2, 1 << 20) % 49_000).astype(np.uint32)
    blob = token_files.to_file(ids, pa.table({"doc_id": [1], "n_tokens": [len(ids)]}))
    assert len(blob) < 0.9 * 2 * len(ids)
    matrix = token_files.WaveletMatrix.of(blob)
    blocks = matrix.planes * (len(ids) // token_files.BLOCK)
    matrix.access([777_777])
    assert matrix.read_blocks <= matrix.planes
    matrix.count(int(ids[9]), 1000, 900_000)
    assert matrix.read_blocks <= 3 * matrix.planes < blocks / 5


SCHEMA = "doc_id long, text string, file string, n_tokens int, row string"


def written(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "f", 1, "r") for i, t in rows], SCHEMA)
    folder = fresh_path(spark, "token-files")
    manifest = token_files.write_token_files(docs, folder, **how)
    files = token_files.read_token_files(spark, folder)
    found = token_files.documents_of(files).join(token_files.file_starts(manifest), "file")
    return manifest, files, [(r.doc_id, r.file_start + r.start_in_file, r.n_tokens, r.ids_crc32) for r in found.collect()]


@pytest.mark.parametrize("shard_tokens", [1, 40, 1 << 20])
def test_documents_come_back_in_order(spark, shard_tokens):
    rng = random.Random(2)
    rows = [(i * 7 % 101 - 20, rng.choice(TEXTS)) for i in range(101)] + [(500, "word " * 20_000)]
    rows += [(None, "no id"), (3, "twice"), (3, "twice"), (3, "thrice")]
    manifest, _files, got = written(spark, rows, shard_tokens=shard_tokens)
    want, at = [], 0
    ids = encoded([t for _, t in rows])
    crc = [zlib.crc32(np.array(own, "<u4").tobytes()) for own in ids]
    assert sorted((str(d), n, c) for d, _, n, c in got) == sorted((str(r[0]), len(own), c) for r, own, c in zip(rows, ids, crc))
    for doc, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        want.append(doc)
        at += n
    assert want == sorted(want, key=lambda d: (d is not None, d or 0)) and at == sum(map(len, ids))
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == at
    if shard_tokens == 1:
        assert manifest.count() == len(rows)


def test_occurrences_over_all_files(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    _, files, _ = written(spark, rows, shard_tokens=50)
    ids = encoded(TEXTS)
    tokens = [1, ids[0][0], ids[7][3], 40_000]
    got = token_files.token_occurrences(files, tokens).collect()
    want = [(t, d, p) for d, own in enumerate(ids) for p, t in enumerate(own) if t in tokens]
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark):
    manifest, files, got = written(spark, [])
    assert got == [] and manifest.count() == 0 and files.count() == 0
