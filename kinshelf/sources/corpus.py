"""Reading document collections."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinshelf.functions.paths import file_name, file_type, has_hidden_part, is_supported
from kinshelf.session import cut_lineage

#: Rows, and bytes of content, that a task hands on at once; bytes that a task reads in all.
LISTED, HANDED, READ = 10_000, 16 << 20, 128 << 20

ENTRY = "path string, folder boolean, file_size long, modification_date timestamp"


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", root))


def _entries(root: str):
    """What lies in each of some folders, given relative to ``root``; hidden entries are passed over."""

    def rows(system: fs.FileSystem, base: str, folder: str) -> Iterator[tuple]:
        where = f"{base}/{folder}" if folder else base
        for entry in system.get_file_info(fs.FileSelector(where, allow_not_found=bool(folder))):
            name, is_folder = entry.base_name, entry.type == fs.FileType.Directory
            if name.startswith(".") or entry.type == fs.FileType.NotFound:
                continue
            if is_folder and isinstance(system, fs.LocalFileSystem) and os.path.islink(entry.path):
                continue  # it may lead back up
            changed = entry.mtime_ns // 1000 if entry.mtime_ns is not None else None
            yield f"{folder}/{name}" if folder else name, is_folder, None if is_folder else entry.size, changed

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [[]] * 4
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
        names = [x.split()[0] for x in ENTRY.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    def each(batches):
        system, base = _open(root)
        held = []
        for given in batches:
            for folder in given.column(0).to_pylist():
                for row in rows(system, base.rstrip("/"), folder):
                    held.append(row)
                    if len(held) >= LISTED:
                        yield batch(held)
                        held = []
        yield batch(held)

    return each


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(file_path, file_size, modification_date)`` of the supported, visible files below ``root``.

    The folders of one depth are listed by tasks, and the folders they found are the
    next round: the driver sees no file. Hidden folders are not entered, nor links to folders.
    ``root`` is a path, or an address that pyarrow opens. Paths are relative to it.
    """
    level, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        entries = cut_lineage(level.mapInArrow(_entries(root), ENTRY))
        files = entries.where(~F.col("folder") & is_supported(F.col("path")))
        found = files if found is None else found.unionAll(files)
        folders = entries.where("folder")
        if folders.isEmpty():
            return found.select(F.col("path").alias("file_path"), "file_size", "modification_date")
        level = cut_lineage(folders.select("path").repartition("path"))


CONTENT = "file_path string, file_size long, modification_date timestamp, content binary"


def _read(root: str):
    def each(batches):
        system, base = _open(root)
        for given in batches:
            rows, contents, held = [], [], 0

            def batch():
                return pa.RecordBatch.from_arrays(
                    [*(given.column(k).take(pa.array(rows, pa.int64())) for k in range(3)), pa.array(contents, pa.binary())],
                    names=["file_path", "file_size", "modification_date", "content"],
                )

            for row, path in enumerate(given.column(0).to_pylist()):
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                        data = stream.readall()
                except FileNotFoundError:
                    continue  # gone since it was listed
                rows.append(row)
                contents.append(data)
                held += len(data)
                if held >= HANDED:
                    yield batch()
                    rows, contents, held = [], [], 0
            yield batch()

    return each


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``files(file_path, file_size, modification_date)`` of ``list_files`` with their bytes, as ``content``.

    The files are dealt out anew, so that a folder with a third of them is read by many
    tasks. Files that have gone are left out.
    """
    size = files.agg(F.sum("file_size")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, size // READ + 1)
    dealt = files.select("file_path", "file_size", "modification_date").repartition(tasks, F.xxhash64("file_path"))
    return dealt.mapInArrow(_read(root), CONTENT)


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Supported, visible files below ``root`` with their bytes: ``(file_path, file_size, modification_date, content)``.

    Empty files have no bytes. Names that start with "_", which Spark's file source passes
    over, are read like others. ``list_files`` gives the same rows without reading.
    """
    return with_content(list_files(spark, root), root)


def _write(root: str):
    def each(batches):
        system, base = _open(root)
        base = base.rstrip("/")
        for given in batches:
            paths, contents = given.column(0).to_pylist(), given.column(1)
            for path, content in zip(paths, contents):
                folder, _, name = f"{base}/{path}".rpartition("/")
                system.create_dir(folder, recursive=True)
                unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(unfinished) as stream:
                    stream.write(content.as_buffer() if content.is_valid else b"")
                system.move(unfinished, f"{folder}/{name}")
            sizes = pa.compute.fill_null(pa.compute.binary_length(contents), 0)
            yield pa.RecordBatch.from_arrays([given.column(0), sizes.cast(pa.int64())], names=["file_path", "file_size"])

    return each


def write_files(docs: DataFrame, root: str, content: str = "text") -> DataFrame:
    """Write ``docs(file_path, <content>)`` as files below ``root``; returns ``(file_path, file_size)``.

    A file is written under a hidden name and then renamed, so a repeated task replaces it
    by the same bytes and a scan never sees half of it. NULL content makes an empty file.
    """
    rows = docs.select("file_path", F.col(content).cast("binary").alias("content"))
    return cut_lineage(rows.mapInArrow(_write(root), "file_path string, file_size long"))


def decode_text(content: Column) -> Column:
    """UTF-8 bytes as text; byte sequences that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def fingerprint(content: Column) -> Column:
    """SHA-256 of the content, as hex digits."""
    return F.sha2(content, 256)


def describe_documents(
    docs: DataFrame, content: str = "text", summary_chars: int | None = None
) -> DataFrame:
    """Catalog rows for ``docs(file_path, file_size, modification_date, <content>)``.

    Bytes are decoded. The summary is a field for display, NULL unless
    ``summary_chars`` asks for so many characters; whatever analyses a document reads
    all of its text.
    """
    binary = docs.schema[content].dataType == T.BinaryType()
    text = decode_text(F.col(content)) if binary else F.col(content)
    summary = F.substring(text, 1, summary_chars) if summary_chars else F.lit(None).cast("string")
    return docs.select(
        "file_path",
        file_name(F.col("file_path")).alias("filename"),
        "file_size",
        F.lit(None).cast("timestamp").alias("creation_date"),
        "modification_date",
        file_type(F.col("file_path")).alias("file_type"),
        fingerprint(F.col(content)).alias("checksum"),
        F.nullif(summary, F.lit("")).alias("content_summary"),
        text.alias("text"),
    )
