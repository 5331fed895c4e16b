"""SimHash fingerprints and their links, found through deletion-variant signatures.

Two fingerprints of 64 bits that differ in two bits at most have a half that differs in
one bit at most. Each half is therefore indexed with each of its bits left out, and equal
entries are verified. Where many fingerprints share an entry they are not compared with
each other: each of them is indexed once more with every two bits left out, which puts
exactly the linked ones together, four at most under one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from kinshelf.llm.repeats import free_name
from kinshelf.operators.components import connected_components
from kinshelf.session import cut_lineage

SEED = 42
#: An entry with more fingerprints than this is looked up by every two bits instead.
CROWD = 64


def fingerprint(text: bytes | None, size: int) -> int:
    """Bits set in more than half of the hashes of the text's shingles of ``size`` words, as a signed number."""
    words = (text or b"").lower().split()  # both are ASCII only on bytes
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[:count].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in spans), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """``docs`` and ``fingerprint`` (long, 64 bits); null texts and texts without a word get 0.

    Words are stretches without ASCII white space after A-Z are lower-cased. A text with
    fewer words than ``size`` is one shingle.
    """

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, size) for t in column.cast(pa.binary()).to_pylist()], pa.int64())

    return docs.withColumn("fingerprint", of(F.col(text)))


def _variants(prints: DataFrame) -> DataFrame:
    """``(entry, fp)``: either half, with one bit left out; half and bit are part of the entry."""
    half = F.when(F.col("i") < 32, F.col("fp")).otherwise(F.shiftright("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    bit = F.expr("~shiftleft(1L, i % 32)")
    return (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
        .select(half.bitwiseAND(bit).bitwiseOR(F.expr("shiftleft(CAST(i AS BIGINT), 32)")).alias("entry"), "fp")
    )


def _pairs(most: int):
    """Links within each entry of a sorted partition, or the crowded fingerprints with a null."""

    def each(batches):
        entry, held, crowded = None, np.zeros(0, np.uint64), False
        for batch in batches:
            entries = np.asarray(batch.column(0))
            fps = np.asarray(batch.column(1)).view(np.uint64)
            if not len(fps):
                continue
            left, right, crowd = [], [], [np.zeros(0, np.uint64)]
            cuts = np.append(np.flatnonzero(np.append(True, entries[1:] != entries[:-1])), len(entries))
            sizes = np.diff(cuts)
            sizes[[0, -1]] += 1  # may go on from the last batch, or in the next
            for k in np.flatnonzero(sizes > 1).tolist():
                own = fps[cuts[k] : cuts[k + 1]]
                if entries[cuts[k]] != entry:
                    entry, held, crowded = entries[cuts[k]], np.zeros(0, np.uint64), False
                if not crowded and len(held) + len(own) <= CROWD:
                    first, held = len(held), np.concatenate([held, own])
                    for i in range(first, len(held)):
                        near = held[:i][np.bitwise_count(held[:i] ^ held[i]) <= most]
                        left.append(near)
                        right.append(np.full(len(near), held[i]))
                else:
                    crowd += [own] if crowded else [held, own]
                    crowded = True
            alone = np.concatenate(crowd)
            src = np.concatenate([*left, alone]).view(np.int64)
            dst = np.concatenate([*right, alone]).view(np.int64)
            known = np.arange(len(src)) < len(src) - len(alone)
            yield pa.RecordBatch.from_arrays(
                [pa.array(src), pa.array(dst, mask=~known)], names=["src", "dst"]
            )

    return each


def links(prints: DataFrame) -> DataFrame:
    """``(src, dst)`` with which fingerprints ``fp`` (distinct) at two or fewer differing bits hang together."""
    parts = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cut_lineage(
        _variants(prints).repartition(parts, "entry").sortWithinPartitions("entry")
        .mapInArrow(_pairs(2), "src long, dst long")
        .distinct()
    )
    crowded = found.where("dst IS NULL").select(F.col("src").alias("fp")).distinct()
    two_out = crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select(
        "fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j")
    )
    alike = (
        two_out.groupBy("i", "j", F.expr("fp & ~shiftleft(1L, i) & ~shiftleft(1L, j)").alias("rest"))
        .agg(F.collect_set("fp").alias("fps"))  # four at most
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst"))
        .where("src != dst")
        .distinct()
    )
    return found.where("dst IS NOT NULL").unionAll(alike)


def components(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(fp, group, component_id)`` for each distinct fingerprint of ``prints(doc_id, fp)``.

    ``group`` is the smallest fingerprint that links reach, ``component_id`` the smallest id
    of a document they reach, null if none has one.
    """
    lowest = cut_lineage(prints.groupBy("fp").agg(F.min(doc_id).alias("lowest")))
    joined = connected_components(links(lowest.select("fp"))).select(
        F.col("doc_id").alias("fp"), F.col("component").alias("group")
    )
    # both written, so that Spark can split the join at a component of very many fingerprints
    grouped = cut_lineage(lowest.join(joined, "fp", "left").withColumn("group", F.coalesce("group", "fp")))
    first = cut_lineage(grouped.groupBy("group").agg(F.min("lowest").alias("component_id")))
    return cut_lineage(grouped.join(first, "group").select("fp", "group", "component_id"))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``fingerprint`` has 16 hexadecimal digits. Empty and null texts share fingerprint
    zero and link like any other. Rows without an id are kept; they never name a
    component. Repeated rows come out repeated.
    """
    prints = cut_lineage(
        with_fingerprints(docs.select(doc_id, text), text, size).select(doc_id, F.col("fingerprint").alias("fp"))
    )
    return prints.join(components(prints, doc_id).drop("group"), "fp").select(
        doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3) -> DataFrame:
    """``docs`` with one row of each component of fingerprints: the one with the smallest id.

    A row without an id stays only if no other of its component has one. Rows of one id go
    by a hash of all their columns but maps, and repeated rows are one. Null and empty
    texts are near copies of each other.
    """
    key = free_name(docs, "_row")
    hashed = F.xxhash64(*[f"`{f.name}`" for f in docs.schema.fields if not isinstance(f.dataType, MapType)])
    marked = docs.withColumn(key, hashed)
    prints = cut_lineage(
        with_fingerprints(
            marked.select(F.col(doc_id).alias("doc_id"), F.col(key).alias("row"), F.col(text).alias("text")), "text", size
        ).select("doc_id", "row", F.col("fingerprint").alias("fp"))
    )
    found = prints.groupBy("fp", "doc_id", "row").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "times"))
    kept = cut_lineage(
        cut_lineage(found).join(components(prints), "fp").groupBy("group").agg(first.alias("x")).select(
            F.col("x.row").alias("_row"), F.col("x.doc_id").alias("_id"), F.col("x.times").alias("_times")
        )
    )
    same = (marked[key] == kept["_row"]) & marked[doc_id].eqNullSafe(kept["_id"])
    once = marked.join(kept.where("_times = 1"), same, "left_semi")
    several = marked.join(kept.where("_times > 1"), same, "left_semi").dropDuplicates([key, doc_id])
    return once.unionAll(several).drop(key)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
