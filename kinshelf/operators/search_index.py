"""Search by an index of letters: which documents have which one, two or three letters in a row.

A query has all its three-letter pieces in every document that it is found in. The index
is stored by piece, so a query reads the lists of its rarest pieces only, and the few
documents on all of them are compared. Shorter queries are pieces themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinshelf.operators.views import matches

#: Parts that the pieces are dealt into, by hash; lists of pieces that a query reads at most.
BUCKETS, LISTS = 64, 4

#: Letters and documents that a task lists at once; parts that the lists of a bucket are written in.
LETTERS, DOCUMENTS, PARTS = 1 << 21, 1024, 8


def pieces(text: Column) -> Column:
    """The distinct pieces of one to three letters of a text, in lower case; linear in its length."""
    # bound once: an expression inside a lambda would be worked out for every letter
    letters = F.array(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != ""))

    def of(c: Column) -> Column:
        def after(n: int) -> Column:
            return F.slice(c, F.lit(n + 1), F.greatest(F.size(c) - n, F.lit(0)))

        cut = F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
        two = F.zip_with(cut, after(1), lambda a, b: F.concat(a, b))
        cut = F.slice(two, F.lit(1), F.greatest(F.size(c) - 2, F.lit(0)))
        three = F.zip_with(cut, after(2), lambda a, b: F.concat(a, b))
        return F.concat(F.array_distinct(c), F.array_distinct(two), F.array_distinct(three))

    return F.flatten(F.transform(letters, of))


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def _listed(keys: pa.Array, fields: list[list[str]]) -> Iterator[pa.RecordBatch]:
    """``(piece, n, documents)`` of some documents: a row a piece, with the keys of those that have it."""
    texts = [t for document in zip(*fields) for t in document]
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if not len(letters):
        return
    alphabet, code = np.unique(letters, return_inverse=True)
    base, many = len(alphabet) + 1, len(keys)
    if base**3 * many >= 1 << 63 and many > 1:
        for own in (slice(0, many // 2), slice(many // 2, many)):
            yield from _listed(keys[own], [f[own] for f in fields])
        return
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    document, found = text // len(fields), []
    piece = np.zeros(len(code), np.int64)
    for n in range(3):  # pieces do not cross from one text to the next
        piece = piece[: len(code) - n] * base + code[n:] + 1
        inside = text[: len(code) - n] == text[n:]
        found.append((piece * many + document[: len(piece)])[inside])
    found = np.sort(np.concatenate(found))
    found = found[np.diff(found, prepend=-1) > 0]
    piece = found // many
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    names = ["", *map(chr, alphabet.tolist())]
    rest, three = divmod(piece[first], base)
    one, two = divmod(rest, base)
    pieces = [names[a] + names[b] + names[c] for a, b, c in zip(one.tolist(), two.tolist(), three.tolist())]
    ends = np.append(first, len(found)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), keys.take(pa.array(found % many)))
    counts = pa.array(np.diff(ends).astype(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), counts, lists], names=["piece", "n", "documents"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, in slices of bounded size."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[1:]:
        size += pc.binary_length(column).to_numpy(zero_copy_only=False)
    total, first = np.cumsum(size), 0
    while first < batch.num_rows:
        full = int(np.searchsorted(total, (total[first - 1] if first else 0) + LETTERS, "right"))
        last = min(max(first + 1, full), first + DOCUMENTS)
        yield batch.slice(first, last - first)
        first = last


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_listed`` of ``(key, *texts in lower case)``, with a part by task: what a task lists is written as a whole."""
    part = TaskContext.get().partitionId() % PARTS
    for batch in batches:
        for some in _slices(batch):
            texts = [[t.decode("utf-8", "replace") for t in c.cast(pa.binary()).to_pylist()] for c in some.columns[1:]]
            for found in _listed(some.column(0), texts):
                parts = pa.array(np.full(found.num_rows, part, np.int32))
                yield pa.RecordBatch.from_arrays([*found.columns, parts], names=["piece", "n", "documents", "part"])


def build_search_index(files: DataFrame, path: str, content: str = "text", key: str = "file_path") -> None:
    """Write the index of ``files(<key>, filename, <content>, file_type)`` below ``path``.

    ``lists(bucket, piece, n, documents)``, with ``n`` keys a row, and ``counts(bucket, piece,
    documents)`` are stored by bucket and sorted by piece. A task lists many documents at once,
    so a row moves for a piece and not for every document that has it. A piece that is
    everywhere is written by many tasks.
    """
    spark = files.sparkSession
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"_{i}") for i, c in enumerate(("filename", content, "file_type"))]
    kind = files.schema[key].dataType.simpleString()
    schema = f"piece string, n long, documents array<{kind}>"
    found = files.select(key, *low).mapInArrow(_postings, f"{schema}, part int")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.withColumn("bucket", _bucket(F.col("piece"))).repartition(tasks, "bucket", "part").drop("part")
    dealt.sortWithinPartitions("bucket", "piece").write.partitionBy("bucket").parquet(f"{path}/lists")
    lists = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/lists")
    counts = lists.groupBy("bucket", "piece").agg(F.sum("n").alias("documents"))
    counts.sortWithinPartitions("bucket", "piece").write.partitionBy("bucket").parquet(f"{path}/counts")


def _wanted(query: str) -> list[str]:
    """The pieces of a query; one of up to three letters is a piece itself."""
    low = query.strip().lower()
    return sorted({low[i : i + 3] for i in range(max(1, len(low) - 2))})


def _of(spark: SparkSession, path: str, wanted: list[str], column: str) -> DataFrame:
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(_bucket(F.col("w"))).distinct().collect()]
    rows = spark.read.schema(f"piece string, {column}, bucket int").parquet(path)
    return rows.where(F.col("bucket").isin(buckets) & F.col("piece").isin(wanted))


def candidates(
    spark: SparkSession, path: str, query: str, key: str = "file_path", kind: str = "string"
) -> DataFrame | None:
    """``(<key>)``, of type ``kind``, of the documents that have the rarest pieces of ``query``; None if it is blank."""
    if not query.strip():
        return None
    wanted = _wanted(query)
    counts = {r.piece: r.documents for r in _of(spark, f"{path}/counts", wanted, "documents long").collect()}  # a row a piece
    rarest = sorted(wanted, key=lambda w: (counts.get(w, 0), w))[:LISTS]
    lists = _of(spark, f"{path}/lists", rarest, f"documents array<{kind}>").select(F.explode("documents").alias(key))
    return lists.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select(key)


def search_indexed(
    files: DataFrame, path: str, query: str, content: str = "text", key: str = "file_path"
) -> DataFrame:
    """The rows that ``views.search`` finds, through the index that ``build_search_index`` wrote of them."""
    few = candidates(files.sparkSession, path, query, key, files.schema[key].dataType.simpleString())
    if few is None:
        return files
    return files.join(few, key, "left_semi").where(matches(query, content))
