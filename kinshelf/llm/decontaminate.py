"""Short test items inside long documents, by size-partitioned MinHash containment search.

Items are put in classes by their number of shingles, each class up to twice the last.
The MinHash sketch of an item is its smallest shingle hashes, as many as its class needs
for the threshold: an item of n shingles that a document contains to a share t lacks
at most (1 - t) * n of them, so one more than that cannot all be missing. A document is
searched whole: each of its shingles is looked up among the sketches, which finds every
pair to report whatever the document's length. (A banded signature of the document would
not: a short item's Jaccard similarity with a long document is near zero.) Candidates
are verified by exact containment of the item's shingle set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinshelf.llm.repeats import among
from kinshelf.llm.textual import (
    SALTS,
    joined,
    mask_of,
    pack,
    runs,
    span_hashes,
    text_buffers,
    word_hashes,
    word_spans,
)

#: Item shingles that are sent to the tasks at once (16 bytes each); more take further passes.
ITEM_SHINGLES = 1 << 20
#: Rows whose texts are prepared at once.
ROWS = 2000
_WORD = mask_of((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def lowered(column: pa.Array) -> pa.Array:
    """Lower case, with a space for every character beyond ASCII that is neither letter nor digit."""
    text = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    return pc.replace_substring_regex(text, r"[^\x00-\x7F\p{L}\p{N}]", " ")


def shingle_runs(column: pa.Array, size: int):
    """For runs of rows: the first row, both hashes of every shingle, and the first shingle of each row.

    Words are stretches of letters and digits. A text with fewer words than ``size`` is
    one shingle, one without any has none.
    """
    for at in range(0, len(column), ROWS):
        yield from _shingle_runs(column.slice(at, ROWS), size, at)


def _shingle_runs(column: pa.Array, size: int, before: int):
    data, starts = text_buffers(lowered(column))
    for lo, hi in runs(starts):
        own = data[starts[lo] : starts[hi]]
        first, last, of = word_spans(own, starts[lo : hi + 1] - starts[lo], _WORD)
        symbols = word_hashes(own, first, last)
        words = np.diff(of)
        counts = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
        cuts = np.append(0, np.cumsum(counts))
        row = np.repeat(np.arange(hi - lo), counts)
        begin = np.arange(cuts[-1]) - cuts[row] + of[row]
        end = np.minimum(begin + size, of[row + 1])
        yield lo + before, cuts, lambda k, s=symbols, b=begin, e=end: span_hashes(s, b, e, SALTS[k])


def _item_sets(item_id: str, text: str, size: int):
    def each(batches):
        for batch in batches:
            ids, blobs = batch.column(0), []
            for _lo, cuts, hashes in shingle_runs(batch.column(1), size):
                both = np.stack([hashes(0), hashes(1)], axis=1)
                blobs += [pack(np.unique(both[a:b], axis=0)) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(b) // 16 for b in blobs], pa.int64()), pa.array(blobs, pa.binary())],
                names=[item_id, "n_shingles", "shingles"],
            )

    return each


def sketch_length(shingles: int, share: float) -> int:
    """Hashes in the sketch of an item, by the upper end of its size class."""
    upper = (1 << shingles.bit_length()) - 1
    return min(shingles, math.floor((1 - share) * upper + 1e-9) + 1)


class _Items:
    def __init__(self, rows, share: float):
        self.ids = [r[0] for r in rows]
        self.share = share
        self.sets = [joined([r[2]]).reshape(-1, 2) for r in rows]
        sketches = [np.sort(s[:, 0])[: sketch_length(len(s), share)] for s in self.sets]
        keys = np.concatenate([*sketches, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sketches)), np.array([len(s) for s in sketches], np.int64))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def found(self, lead: np.ndarray, second: np.ndarray):
        """``(item, shared)`` for the items that a document with these shingles contains."""
        hits = lead[among(lead, self.keys)]
        a, b = np.searchsorted(self.keys, hits, "left"), np.searchsorted(self.keys, hits, "right")
        named = {int(i) for x, y in set(zip(a.tolist(), b.tolist())) for i in self.owner[x:y]}
        order = np.lexsort((second, lead))
        lead, second = lead[order], second[order]
        for i in sorted(named):
            s = self.sets[i]
            at = np.searchsorted(lead, s[:, 0])
            shared = 0
            for k, (h, g) in zip(at.tolist(), s.tolist()):
                while k < len(lead) and lead[k] == h and second[k] < g:
                    k += 1
                shared += k < len(lead) and lead[k] == h and second[k] == g
            if shared >= self.share * len(s) - 1e-9:
                yield i, shared


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = 0.8,
    size: int = 5,
) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for documents that hold ``share`` of an item.

    Shingles are sets of ``size`` words of letters and digits in lower case; a text with
    fewer words is one shingle. Null and empty texts hold nothing and are held by
    nothing. Repeated rows give repeated pairs, ids may be null, other columns are left
    out. Items are expected to be short: one item is sent to the tasks whole.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, item long, n_shared long"
    out = None
    for own in _passes(items, item_id, item_text, size):
        held = spark.sparkContext.broadcast(own)
        pairs = docs.select(doc_id, text).mapInArrow(_search(held, share, size, doc_id), schema)
        named = spark.createDataFrame(
            [(i, r[0], r[1]) for i, r in enumerate(own)], f"item long, {item_id} {kind}, n_shingles long"
        )
        pairs = pairs.join(named, "item").select(
            doc_id, item_id, "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
        )
        out = pairs if out is None else out.unionAll(pairs)
    return out


def without_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", share: float = 0.8, size: int = 5
) -> DataFrame:
    """Those rows of ``docs`` that hold no item to ``share`` or more, found as ``contained_items`` does."""
    spark = docs.sparkSession
    named = items.select(F.monotonically_increasing_id().alias("_item"), F.col(item_text).alias("_item_text"))
    for own in _passes(named, "_item", "_item_text", size):
        docs = docs.where(~_holds(spark.sparkContext.broadcast(own), share, size)(F.col(text)))
    return docs


def _holds(held, share: float, size: int):
    @F.arrow_udf("boolean")
    def holds(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), bool)
        for row, _item, _shared in _hits(column, _Items(held.value, share), size):
            out[row] = True
        return pa.array(out)

    return holds


def _passes(items: DataFrame, item_id: str, item_text: str, size: int):
    """Items with their shingles, in lists of bounded size; at least one list."""
    kind = items.schema[item_id].dataType.simpleString()
    sets = (
        items.select(item_id, item_text)
        .mapInArrow(_item_sets(item_id, item_text, size), f"{item_id} {kind}, n_shingles long, shingles binary")
        .where("n_shingles > 0")
    )
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    passes = max(1, math.ceil(total / ITEM_SHINGLES))
    for k in range(passes):
        own = sets.where(F.pmod(F.xxhash64("shingles"), F.lit(passes)) == k).collect()
        yield [tuple(r) for r in own]


def _hits(column: pa.Array, items: _Items, size: int):
    """``(row, item, shared)`` of every item that a row of the column holds."""
    for lo, cuts, hashes in shingle_runs(column, size):
        lead = hashes(0)
        hit = np.unique(np.searchsorted(cuts, np.flatnonzero(among(lead, items.keys)), "right") - 1)
        second = hashes(1) if len(hit) else None
        for r in hit.tolist():
            for i, n in items.found(lead[cuts[r] : cuts[r + 1]], second[cuts[r] : cuts[r + 1]]):
                yield lo + r, i, n


def _search(held, share: float, size: int, doc_id: str):
    def each(batches):
        items = _Items(held.value, share)
        for batch in batches:
            found = np.array(list(_hits(batch.column(1), items, size)), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(found[:, 2])],
                names=[doc_id, "item", "n_shared"],
            )

    return each


def op9_containment(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained_items(docs, items)


OP9_SQL = """
WITH said AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') FROM benchmark
), places AS (
  SELECT kind, id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM said WHERE len(ws) > 0
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(ws[i : i + 4], ' ') AS s FROM places
), sizes AS (
  SELECT id AS item_id, count(*) AS n_shingles FROM shingles WHERE kind = 1 GROUP BY id
), pairs AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles b ON d.s = b.s WHERE d.kind = 0 AND b.kind = 1 GROUP BY 1, 2
)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared::DOUBLE / n_shingles AS containment
FROM pairs JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""
