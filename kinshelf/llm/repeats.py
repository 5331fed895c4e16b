"""Which pieces of text occur more than once in a collection, asked block by block.

Distinct texts are dealt into blocks by their digest. A block asks about each of its
piece hashes once, however often it has them, so a passage that a third of all rows
share costs one entry for each block and never meets in one task. Askers and answers
are packed arrays that Spark shuffles; the texts themselves are shuffled once, since
all uses of ``by_block`` share one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinshelf.llm.textual import joined, pack

#: Bytes of text that a block and a partition have on average.
BLOCK_BYTES, PARTITION_BYTES = 4 << 20, 16 << 20
ASK = "part int, block int, single binary, multi binary"
ANSWER = "block int, repeated binary"


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` is called that."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def digest_column(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _distinct_texts(column: str, blocks: int):
    import hashlib

    def each(batches):
        for batch in batches:
            held: dict[bytes, list] = {}
            for text in batch.column(column).cast(pa.binary()).to_pylist():
                text = text or b""
                held.setdefault(hashlib.sha256(text).digest(), [text, 0])[1] += 1
            keys = list(held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(k[:8], "big") % blocks for k in keys], pa.int32()),
                    pa.array(keys, pa.binary()),
                    pa.array([held[k][1] for k in keys], pa.int64()),
                    pa.array([held[k][0] for k in keys], pa.binary()),
                ],
                names=["block", "digest", "n", "text"],
            )

    return each


class Blocks:
    """The distinct texts of ``docs[text]`` in blocks of bounded size."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        self.partitions = max(
            int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PARTITION_BYTES)
        )
        self.blocks = max(1, math.ceil(size / BLOCK_BYTES))
        #: Answers are worked out in more parts than there are partitions, which keeps one part small.
        self.parts = 2 * self.partitions
        self.texts = (
            docs.select(F.col(text).alias("text"))
            .mapInArrow(_distinct_texts("text", self.blocks), "block int, digest binary, n long, text binary")
            .repartition(self.partitions, "block")
        )

    def ask(self, pieces: Callable, answers: DataFrame | None = None, wide: bool = False) -> DataFrame:
        """Answers ``(block, repeated)``: those hashes of each block's pieces that occur again.

        ``pieces(texts, answers)`` takes the texts of a block and the earlier answers
        (None without) and returns hashes and how often each counts; with ``wide`` two
        columns of hashes, both of which have to agree.
        """
        parts = self.parts
        asked = self.each(
            lambda block, texts, known: _questions(block, parts, wide, *pieces(texts, repeated(known))), ASK, answers
        )
        return self.gather(asked, lambda t: _answers(t, wide), ANSWER)

    def gather(self, asked: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """``answer`` of all rows with one ``part``."""
        return asked.repartition(self.partitions, "part").groupBy("part").applyInArrow(answer, schema)

    def each(self, function: Callable, schema: str, answers: DataFrame | None = None) -> DataFrame:
        """``function(block, texts, answers)`` of every block; answers are rows with its ``block`` or None."""
        if answers is None:
            return self.texts.groupBy("block").applyInArrow(
                lambda t: function(t.column("block")[0].as_py(), merged(t), None), schema
            )
        dealt = answers.repartition(self.partitions, "block")
        return (
            self.texts.groupBy("block")
            .cogroup(dealt.groupBy("block"))
            .applyInArrow(lambda t, a: function(t.column("block")[0].as_py(), merged(t), a), schema)
        )


def repeated(answers: pa.Table | None) -> np.ndarray | None:
    return None if answers is None else joined(answers.column("repeated").to_pylist())


def merged(table: pa.Table) -> pa.Table:
    """One row for each distinct text, in the order of digests, with all its copies counted."""
    counts: dict[bytes, int] = {}
    place: dict[bytes, int] = {}
    for i, (k, n) in enumerate(zip(table.column("digest").to_pylist(), table.column("n").to_pylist())):
        counts[k] = counts.get(k, 0) + n
        place[k] = i
    keys = sorted(counts)
    kept = table.select(["digest", "text"]).take(pa.array([place[k] for k in keys], pa.int64()))
    return kept.append_column("n", pa.array([counts[k] for k in keys], pa.int64()))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _questions(block: int, parts: int, wide: bool, hashes: np.ndarray, counts: np.ndarray) -> pa.Table:
    if wide:
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        hashes, counts = hashes[order], counts[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]).any(axis=1)
    else:
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
    at = np.flatnonzero(new)
    multi = np.add.reduceat(counts, at) > 1 if len(at) else np.zeros(0, bool)
    hashes = hashes[at]
    lead = hashes[:, 0] if wide else hashes
    part = part_of(lead, parts)  # in the order of hashes
    cuts = np.searchsorted(part, np.arange(parts + 1))
    rows = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    single, several = [], []
    for p in rows:
        own, many = hashes[cuts[p] : cuts[p + 1]], multi[cuts[p] : cuts[p + 1]]
        single.append(pack(own[~many]))
        several.append(pack(own[many]))
    return pa.table(
        {
            "part": pa.array(rows, pa.int32()),
            "block": pa.array([block] * len(rows), pa.int32()),
            "single": pa.array(single, pa.binary()),
            "multi": pa.array(several, pa.binary()),
        }
    )


def _answers(table: pa.Table, wide: bool) -> pa.Table:
    single, multi = table.column("single").to_pylist(), table.column("multi").to_pylist()
    width = 16 if wide else 8
    owner = np.repeat(np.arange(len(single)), [len(b) // width for b in single])
    every, sure = joined(single), joined(multi)
    both = np.concatenate([every, sure])
    certain = np.zeros(len(both) // (width // 8), bool)
    certain[len(owner) :] = True
    if wide:
        both = both.reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        same = (both[order][1:] == both[order][:-1]).all(axis=1)
    else:
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
    again = certain[order].copy()
    again[1:] |= same
    again[:-1] |= same
    flags = np.empty(len(order), bool)
    flags[order] = again
    blobs, blocks = [], []
    cuts = np.searchsorted(owner, np.arange(len(single) + 1))
    for i, block in enumerate(table.column("block").to_pylist()):
        mine = both[cuts[i] : cuts[i + 1]][flags[cuts[i] : cuts[i + 1]]]
        blocks.append(block)
        blobs.append(pack(mine) + (multi[i] or b""))
    return pa.table({"block": pa.array(blocks, pa.int32()), "repeated": pa.array(blobs, pa.binary())})


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def among_wide(wide: Callable[[np.ndarray], np.ndarray], at: np.ndarray, lead: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Those places of ``at`` whose pair of hashes is in ``known``; ``lead`` has the first of each pair.

    ``wide(places)`` gives both, and is only asked where the first one fits.
    """
    pairs = known.reshape(-1, 2)
    at = at[among(lead, pairs[:, 0])]
    if not len(at):
        return at
    every = np.concatenate([pairs, wide(at)])
    order = np.lexsort((np.arange(len(every)), every[:, 1], every[:, 0]))
    new = np.ones(len(every), bool)
    new[1:] = (every[order][1:] != every[order][:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    named = (order < len(pairs))[new]  # answers come first among equals
    fits = np.empty(len(every), bool)
    fits[order] = named[group]
    return at[fits[len(pairs) :]]
