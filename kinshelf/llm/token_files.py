"""Token ids of documents in succinct files: a wavelet matrix for each shard.

Documents go to shards in ascending order of their id. A shard's ids are kept as bit
planes, highest bit first; each plane moves the ids whose bit is 0 before the others, in
stable order. Planes are stored in blocks of 32,768 bits, compressed one by one, with the
number of ones of every block in the directory. So one compressed file answers which id is
at a place, how often an id occurs in a range, and where, and reads only the blocks that
the question touches.

A file is ``KWM1``, a header of five numbers, the Arrow table of documents, the directory
and the blocks, in this order. It is written whole under another name and then renamed, so
a repeated task replaces a file by the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinshelf.llm.pack import Units, token_rows
from kinshelf.llm.textual import NOT_BLANK, mask_of, word_spans
from kinshelf.session import cut_lineage, fresh_path

MAGIC, HEADER, ENDING = b"KWM1", struct.Struct("<QBIII"), ".kwm"
#: Bits of a plane that are compressed together.
BLOCK = 1 << 15
#: A shard ends with the document that brings it to so many ids.
SHARD_TOKENS = 1 << 23


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ALNUM = mask_of((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: ASCII signs but the apostrophe, which may belong to the letters after it.
_SIGN = mask_of((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) & ~mask_of((0x27, 0x27))


class WordUnits(Units):
    """Units of a vocabulary that lower-cases and takes white space for a mere border.

    They are the words between ASCII blanks, cut once more where an ASCII sign follows an
    ASCII letter or digit, since the vocabulary never joins those.
    """

    end = 1
    #: A word of its own; it stands between the units that are encoded joined.
    MARK = b"\x01"

    def __init__(self, path: str):
        super().__init__(path)
        ids = self.tokenizer.encode(self.MARK.decode(), add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else -1

    def cut(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last, _ = word_spans(data, starts, NOT_BLANK)
        signs = np.flatnonzero(_SIGN[data[1:]] & _ALNUM[data[:-1]]) + 1
        signs = signs[~np.isin(signs, starts)]
        return np.sort(np.append(first, signs)), np.sort(np.append(last, signs))

    def _by_units(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return super()._by_units(_LOWER[data], starts)

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, between = [np.zeros(0, np.uint32)] * len(texts), b" " + self.MARK + b" "
        joinable = [i for i, t in enumerate(texts) if self.mark >= 0 and self.MARK not in t]
        alone = sorted({*range(len(texts))} - {*joinable})
        groups = [joinable[i : i + 1024] for i in range(0, len(joinable), 1024)]
        whole = [between.join(texts[i] for i in own).decode() for own in groups]
        for own, e in zip(groups, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(own) - 1:
                alone += own
                continue
            for i, a, b in zip(own, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                parts[i] = ids[a:b]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([texts[i].decode() for i in alone], add_special_tokens=False)):
            parts[i] = np.array(e.ids, np.uint32)
        return np.array([len(p) for p in parts], np.int64), np.concatenate([np.zeros(0, np.uint32), *parts])


# --- One file


def _packed_blocks(bits: np.ndarray) -> tuple[list[bytes], list[int]]:
    """The blocks of a plane, each compressed where that is shorter, and the ones in each."""
    squeeze, blobs, ones = zstandard.ZstdCompressor(level=3), [], []
    for at in range(0, len(bits), BLOCK):
        own = bits[at : at + BLOCK]
        raw = np.packbits(own, bitorder="little").tobytes()
        small = squeeze.compress(raw)
        blobs.append(small if len(small) < len(raw) else raw)
        ones.append(int(np.count_nonzero(own)))
    return blobs, ones


def to_file(ids: np.ndarray, documents: pa.Table) -> bytes:
    """The file of a shard: its ids, and the table of its documents with ``n_tokens`` each."""
    now, blobs, ones = ids.astype(np.uint32), [], []
    planes = max(1, int(now.max()).bit_length()) if len(now) else 1
    if planes <= 16:
        now = now.astype(np.uint16)
    for shift in range(planes - 1, -1, -1):
        bits = (now >> now.dtype.type(shift)) & now.dtype.type(1) == 1
        made, counted = _packed_blocks(bits)
        blobs += made
        ones += counted
        now = np.concatenate([now[~bits], now[bits]])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(documents)
    table = sink.getvalue().to_pybytes()
    directory = zstandard.compress(np.array([[len(b) for b in blobs], ones], "<u4").tobytes())
    header = HEADER.pack(len(ids), planes, BLOCK, len(table), len(directory))
    return b"".join([MAGIC, header, table, directory, *blobs])


class WaveletMatrix:
    """The ids of a file. Positions and ranges are places among all ids of the shard.

    ``fetch(start, length)`` reads a piece of the file; ``read_blocks`` counts the blocks
    that questions have read so far.
    """

    def __init__(self, fetch):
        front = len(MAGIC) + HEADER.size
        head = fetch(0, front)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        self.size, self.planes, self.block, table, directory = HEADER.unpack(head[len(MAGIC) :])
        self._fetch, self._table = fetch, (front, table)
        per_plane = -(-self.size // self.block)
        sizes, ones = np.frombuffer(zstandard.decompress(fetch(front + table, directory)), "<u4").reshape(
            2, self.planes, per_plane
        )
        at = front + table + directory
        self._starts = at + np.append(0, np.cumsum(sizes.ravel(), dtype=np.int64))
        #: ones before each block of a plane, and in the whole plane at the end
        self._before = np.zeros((self.planes, per_plane + 1), np.int64)
        np.cumsum(ones, axis=1, out=self._before[:, 1:])
        self.zeros = self.size - self._before[:, -1]
        self._words: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.read_blocks = 0

    @classmethod
    def of(cls, blob) -> WaveletMatrix:
        view = memoryview(blob)
        return cls(lambda start, length: bytes(view[start : start + length]))

    def documents(self) -> pa.Table:
        start, length = self._table
        return pa.ipc.open_stream(self._fetch(start, length)).read_all()

    def _raw(self, plane: int, block: int) -> bytes:
        k = plane * (self._before.shape[1] - 1) + block
        length = -(-min(self.block, self.size - block * self.block) // 8)
        blob = self._fetch(int(self._starts[k]), int(self._starts[k + 1] - self._starts[k]))
        self.read_blocks += 1
        return blob if len(blob) == length else zstandard.decompress(blob, max_output_size=length)

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of a block and the ones before each of them."""
        known = self._words.get((plane, block))
        if known is None:
            raw = self._raw(plane, block)
            words = np.frombuffer(raw.ljust(-(-len(raw) // 8) * 8, b"\0"), "<u8")
            known = words, np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
            self._words[plane, block] = known
        return known

    def _look(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place, and the ones before it. A place may be the end of the plane."""
        bits, ranks = np.zeros(len(at), bool), np.full(len(at), self._before[plane, -1])
        order = np.argsort(at, kind="stable")
        order = order[: np.searchsorted(at[order], self.size)]
        blocks = at[order] // self.block
        cuts = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(order))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if len(order) else ():
            own, block = order[a:b], int(blocks[a])
            words, before = self._block(plane, block)
            inner = at[own] - block * self.block
            word, bit = words[inner >> 6], (inner & 63).astype(np.uint64)
            bits[own] = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            ranks[own] = self._before[plane, block] + before[inner >> 6] + below
        return bits, ranks

    def _select(self, plane: int, nth: np.ndarray, ones: bool) -> np.ndarray:
        """Places of the bits of one kind, by their numbers from 0."""
        counts = self._before[plane]
        if not ones:
            counts = np.minimum(np.arange(len(counts)) * self.block, self.size) - counts
        blocks = np.searchsorted(counts, nth, "right") - 1
        places = np.zeros(len(nth), np.int64)
        for block in np.unique(blocks).tolist():
            own, first = blocks == block, block * self.block
            bits = np.unpackbits(self._block(plane, block)[0].view(np.uint8), bitorder="little")
            bits = bits[: min(self.block, self.size - first)]
            places[own] = first + np.flatnonzero(bits == ones)[nth[own] - counts[block]]
        return places

    def access(self, at) -> np.ndarray:
        """The ids at some places."""
        at = np.asarray(at, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.size):
            raise IndexError("no such place")
        ids = np.zeros(len(at), np.uint32)
        for plane in range(self.planes):
            bits, ranks = self._look(plane, at)
            ids = (ids << np.uint32(1)) | bits
            at = np.where(bits, self.zeros[plane] + ranks, at - ranks)
        return ids

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the ids of a range that equal ``token`` stand after the last plane."""
        if token < 0 or token >> self.planes:
            return 0, 0
        both = np.array([low, high], np.int64)
        for plane in range(self.planes):
            ranks = self._look(plane, both)[1]
            both = self.zeros[plane] + ranks if token >> (self.planes - 1 - plane) & 1 else both - ranks
            if both[0] == both[1]:
                break
        return int(both[0]), int(both[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs from ``low`` up to before ``high``."""
        first, last = self._range(token, low, self.size if high is None else high)
        return last - first

    def occurrences(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Where an id occurs from ``low`` up to before ``high``, in ascending order."""
        first, last = self._range(token, low, self.size if high is None else high)
        at = np.arange(first, last)
        for plane in range(self.planes - 1, -1, -1) if len(at) else ():
            ones = bool(token >> (self.planes - 1 - plane) & 1)
            at = self._select(plane, at - self.zeros[plane] if ones else at, ones)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, from the last plane back to the first."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        ids = np.zeros(self.size, kind)
        for plane in range(self.planes - 1, -1, -1):
            raw = b"".join(self._raw(plane, k) for k in range(self._before.shape[1] - 1))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.size, bitorder="little").view(bool)
            earlier, zeros = np.empty_like(ids), self.zeros[plane]
            earlier[~bits] = ids[:zeros]
            earlier[bits] = ids[zeros:] | kind(1 << (self.planes - 1 - plane))
            ids = earlier
        return ids.astype(np.uint32)


# --- Many files

MANIFEST = "file string, part int, place int, n_documents long, n_tokens long, n_bytes long"


def _put(folder: str, name: str, blob: bytes) -> None:
    system, base = fs.FileSystem.from_uri(folder)
    unfinished = f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(unfinished) as out:
        out.write(blob)
    system.move(unfinished, f"{base}/{name}")


def _shards(folder: str, path: str, shard_tokens: int):
    def each(batches):
        part, place, kind = TaskContext.get().partitionId(), 0, None
        held, ids, lengths, n = [], [], [], 0

        def written():
            column = pa.chunked_array(held, kind)
            documents = pa.table({"doc_id": column, "n_tokens": pa.array(lengths, pa.int64())})
            name, blob = f"shard-{part:06d}-{place:06d}{ENDING}", to_file(np.concatenate(ids), documents)
            _put(folder, name, blob)
            row = (name, part, place, len(lengths), n, len(blob))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            kind, first = batch.column(0).type, 0
            for row, own in token_rows(batch.column(1), path, WordUnits):
                ids.append(own.copy())
                lengths.append(len(own))
                n += len(own)
                if n >= shard_tokens:
                    held.append(batch.column(0).slice(first, row + 1 - first))
                    yield written()
                    held, ids, lengths, n, place, first = [], [], [], 0, place + 1, row + 1
            if first < batch.num_rows:
                held.append(batch.column(0).slice(first))
        if lengths:
            yield written()

    return each


def word_vocabulary(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_token_files(
    docs: DataFrame,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the ids of all texts to files in ``folder``; a row about each file.

    ``folder`` is one that all executors reach, as a path or address that pyarrow opens.
    Documents go by ``doc_id``, null first, equal ones by a hash of the text and the text;
    repeated rows are repeated documents. A null or empty text has the end id alone. Sorting
    is by ranges, so a repeated id is no hot task. ``path`` is the vocabulary. A shard holds
    ``shard_tokens`` ids and the rest of its last document. Other columns are left out.
    """
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col("doc_id").asc_nulls_first(), "spread", "text", "row"]
    ordered = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        .withColumn("spread", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(parts, keys[0], "spread", "row")
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )
    return cut_lineage(ordered.mapInArrow(_shards(folder, word_vocabulary(path), shard_tokens), MANIFEST))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of the files in a folder; files that are not finished are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ENDING}").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file"), "content")


def _matrices(batches) -> Iterator[tuple[str, WaveletMatrix]]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield file, WaveletMatrix.of(content.as_buffer())


DOCUMENTS = "file string, start_in_file long, n_tokens long, ids_crc32 long"


def documents_of(files: DataFrame, kind: str = "bigint") -> DataFrame:
    """``(doc_id, file, start_in_file, n_tokens, ids_crc32)`` of each document, from the ids in its file.

    ``kind`` is the type of the ids of documents.
    """

    def each(batches):
        for file, matrix in _matrices(batches):
            table, ids = matrix.documents(), matrix.tokens().astype("<u4", copy=False)
            lengths = table["n_tokens"].to_numpy()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield from pa.table(
                {
                    "doc_id": table["doc_id"],
                    "file": pa.repeat(file, len(lengths)),
                    "start_in_file": pa.array(starts, pa.int64()),
                    "n_tokens": table["n_tokens"],
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
            ).to_batches()

    return files.mapInArrow(each, f"doc_id {kind}, {DOCUMENTS}")


def file_starts(manifest: DataFrame) -> DataFrame:
    """``(file, file_start)``: the ids in all files before.

    Parts are added up first, so no task orders more rows than there are parts, or files in a part.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    parts = parts.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
    return manifest.withColumn("inside", inside).join(parts, "part").select(
        "file", (F.col("base") + F.col("inside")).alias("file_start")
    )


def token_occurrences(files: DataFrame, tokens: list[int], kind: str = "bigint") -> DataFrame:
    """``(token, doc_id, position)`` of every occurrence of some ids, found by rank and select."""

    def each(batches):
        for _file, matrix in _matrices(batches):
            table = matrix.documents()
            ends = np.cumsum(table["n_tokens"].to_numpy())
            for token in tokens:
                at = matrix.occurrences(token)
                row = np.searchsorted(ends, at, "right")
                starts = ends - table["n_tokens"].to_numpy()
                yield from pa.table(
                    {
                        "token": pa.array(np.full(len(at), token, np.int64)),
                        "doc_id": table["doc_id"].take(pa.array(row)),
                        "position": pa.array(at - starts[row], pa.int64()),
                    }
                ).to_batches()

    return files.mapInArrow(each, f"token long, doc_id {kind}, position long")


def op13_wavelet_matrix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "token-files")
    manifest = write_token_files(docs, folder)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = documents_of(read_token_files(spark, folder), kind).join(file_starts(manifest), "file")
    start = F.col("file_start") + F.col("start_in_file")
    return found.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", "file")
