"""Hard negatives of vectors, found by the means and deviations of their segments.

A vector is cut into segments. With the mean and the deviation of each segment stored, the
inner product of two vectors is the sum of the products of means, give or take the sum of
the products of deviations. The bounds are taken for one segment first, then for four,
then sixteen, each time only among the pairs that the bounds before have left; what is
still open is scored exactly.

Rows lie in packed chunks. The anchors are a stated set; they are dealt out to the tasks
in blocks of bounded size, one pass over the chunks for each block, and a task keeps the
best rows of every anchor, so what is shuffled does not grow with the rows of a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinshelf.session import cut_lineage, fresh_path, number_rows, spread

#: Most components in a chunk, and most bytes of anchors that are broadcast at once.
CHUNK, BLOCK_BYTES = 1 << 18, 16 << 20
#: Anchors that meet a chunk at once.
SLICE = 256
POSITIVES, NEGATIVES = 5, 10
LEAST, GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector is there and has neither nulls nor infinite components nor NaN."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & fine


def segments(width: int) -> list[np.ndarray]:
    """Where the segments of each level begin: one, four, sixteen and so on, of four components at least."""
    counts = [1]
    while counts[-1] * 16 <= width:
        counts.append(counts[-1] * 4)
    return [np.linspace(0, width, n + 1).astype(np.int64)[:-1] for n in counts]


def summaries(vectors: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means times the root of a segment's size, and deviations, of all segments of each level."""
    made = []
    for begins in segments(width):
        sizes = np.diff(np.append(begins, width))
        sums = np.add.reduceat(vectors, begins, axis=1)
        squares = np.add.reduceat(vectors * vectors, begins, axis=1)
        means = sums / np.sqrt(sizes)
        spreads = np.sqrt(np.maximum(squares - means * means, 0.0))
        # the rounding of a difference of squares, seen from the smaller side
        made.append((means.astype(np.float32), (spreads + 1e-7 * np.sqrt(squares)).astype(np.float32)))
    return made


class Vectors:
    """Rows of vectors of whole numbers with their summaries."""

    def __init__(self, rows, ids, labels, vectors, levels=None):
        self.rows, self.ids, self.labels = rows, ids, labels
        self.exact = vectors
        self.floats = vectors.astype(np.float64)
        self.levels = levels or summaries(self.floats, vectors.shape[1])
        self.norms = np.sqrt((self.floats * self.floats).sum(axis=1))
        self.largest = float(np.abs(self.floats).max(initial=0.0))

    def __len__(self):
        return len(self.ids)

    def part(self, low: int, high: int) -> Vectors:
        own = slice(low, high)
        levels = [(m[own], s[own]) for m, s in self.levels]
        return Vectors(self.rows[own], self.ids[own], self.labels[own], self.exact[own], levels)


def _scores(left: Vectors, right: Vectors, a: np.ndarray, b: np.ndarray, paired: bool) -> np.ndarray:
    """Inner products of all ``a`` with all ``b``, or of their pairs; beyond 64 bits they wrap."""
    small = left.largest * right.largest * left.exact.shape[1] < 2.0**52
    x, y = (left.floats[a], right.floats[b]) if small else (left.exact[a], right.exact[b])
    found = np.einsum("ij,ij->i", x, y) if paired else x @ y.T
    return np.rint(found).astype(np.int64) if small else found


def survivors(
    left: Vectors, right: Vectors, mask: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs of ``mask`` with a score from ``low`` to ``high`` (per row of ``left``), and how many were scored.

    Returns both places and the scores. Limits are rounded outwards where they have more
    digits than a float.
    """
    low, high = np.nextafter(low.astype(np.float64), -np.inf), np.nextafter(high.astype(np.float64), np.inf)
    a, b = np.arange(len(left)), np.arange(len(right))
    for (means, spreads), (other_means, other_spreads) in zip(left.levels, right.levels):
        a, b, mask = _narrowed(a, b, mask)
        if not mask.size:
            break
        middle = means[a].astype(np.float64) @ other_means[b].T.astype(np.float64)
        room = spreads[a].astype(np.float64) @ other_spreads[b].T.astype(np.float64)
        room += 1e-6 * np.outer(left.norms[a], right.norms[b]) + 1e-6
        mask = mask & (middle + room >= low[a][:, None]) & (middle - room <= high[a][:, None])
    a, b, mask = _narrowed(a, b, mask)
    i, j = np.nonzero(mask)
    if 4 * len(i) > mask.size:
        scores, scored = _scores(left, right, a, b, False)[i, j], mask.size
    else:
        parts = [
            _scores(left, right, a[i[k : k + (1 << 15)]], b[j[k : k + (1 << 15)]], True)
            for k in range(0, len(i), 1 << 15)
        ]
        scores, scored = np.concatenate([np.zeros(0, np.int64), *parts]), len(i)
    fits = (scores >= low[a[i]]) & (scores <= high[a[i]])
    return a[i[fits]], b[j[fits]], scores[fits], scored


def _narrowed(a, b, mask):
    """Rows and columns of a mask that still have something in them."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return a[rows], b[columns], mask[np.ix_(rows, columns)]


class Best:
    """The ``most`` best entries of each key: higher scores first, then smaller ids."""

    def __init__(self, keys: int, most: int):
        self.most = most
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: The least score that may still get in.
        self.bar = np.full(keys, LEAST)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        may = score >= self.bar[key]
        if not may.any():
            return
        touched = np.zeros(len(self.bar), bool)
        touched[key[may]] = True
        old = touched[self.key]
        key = np.concatenate([self.key[old], key[may]])
        score = np.concatenate([self.score[old], score[may]])
        ids = np.concatenate([self.id[old], ids[may]])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        full = rank == self.most - 1
        self.bar[key[full]] = score[full]
        kept = rank < self.most
        self.key = np.concatenate([self.key[~old], key[kept]])
        self.score = np.concatenate([self.score[~old], score[kept]])
        self.id = np.concatenate([self.id[~old], ids[kept]])


# --- Chunks

STORE = "n int, width int, kind string, rows binary, ids binary, labels binary, asked binary, vectors binary, summary binary"
ANCHOR = "row long, id long, label long, vector array<long>"


def _pack(width: int):
    most = max(1, CHUNK // width)

    def each(batches):
        for batch in batches:
            rows, ids, labels, asked = (np.asarray(batch.column(k)) for k in range(4))
            lengths = np.asarray(batch.column(4).value_lengths())
            flat = np.asarray(batch.column(4).flatten())
            ends = np.cumsum(lengths)
            for low in range(0, len(ids), most):
                own = slice(low, low + most)
                sizes = lengths[own]
                vectors = np.zeros((len(sizes), width), np.int64)
                vectors[np.arange(width) < sizes[:, None]] = flat[ends[own][0] - sizes[0] : ends[own][-1]]
                top = np.abs(vectors.astype(np.float64)).max(initial=0.0)
                kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
                levels = [x for pair in summaries(vectors.astype(np.float64), width) for x in pair]
                summary = np.concatenate(levels, axis=1).astype("<f4")
                blobs = [
                    rows[own].astype("<i8"), ids[own].astype("<i8"), labels[own].astype("<i8"),
                    asked[own].astype(np.uint8), vectors.astype(kind), summary,
                ]
                values = (len(sizes), width, kind, *(np.ascontiguousarray(b).tobytes() for b in blobs))
                kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 6)
                names = [x.split()[0] for x in STORE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

    return each


def _chunks(batches):
    """``(vectors, asked)`` of each chunk."""
    for batch in batches:
        for n, width, kind, rows, ids, labels, asked, vectors, summary in zip(*(c.to_pylist() for c in batch.columns)):
            columns = np.frombuffer(summary, "<f4").reshape(n, -1)
            levels, at = [], 0
            for begins in segments(width):
                k = len(begins)
                levels.append((columns[:, at : at + k], columns[:, at + k : at + 2 * k]))
                at += 2 * k
            rows, ids, labels = (np.frombuffer(x, "<i8") for x in (rows, ids, labels))
            whole = np.frombuffer(vectors, kind).reshape(n, width).astype(np.int64)
            yield Vectors(rows, ids, labels, whole, levels), np.frombuffer(asked, np.uint8).view(bool)


def _asked(batches):
    for vectors, asked in _chunks(batches):
        own = vectors.exact[asked]
        lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1], own.ravel())
        columns = [vectors.rows[asked], vectors.ids[asked], vectors.labels[asked]]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c) for c in columns), lists], names=["row", "id", "label", "vector"]
        )


def vector_store(rows: DataFrame) -> DataFrame:
    """Chunks of ``rows(id, label, asked, vector)`` with summaries, written to the shared folder."""
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 1)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "asked", "vector")
    return cut_lineage(numbered.mapInArrow(_pack(width), STORE))


# --- Both passes

FOUND = "anchor int, slot int, id long, score long"


def _of_table(table: pa.Table) -> Vectors:
    rows, ids, labels = (table[k].to_numpy() for k in ("row", "id", "label"))
    flat = table["vector"].combine_chunks().flatten().to_numpy()
    return Vectors(rows, ids, labels, flat.reshape(len(ids), -1))


def _found(best: Best, slots: int):
    values = [best.key // slots, best.key % slots, best.id, best.score]
    kinds = [np.int32, np.int32, np.int64, np.int64]
    names = [x.split()[0] for x in FOUND.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(v.astype(k)) for v, k in zip(values, kinds)], names=names)


def _positives(shared, most: int):
    """The best rows of the same label of every anchor in a task."""

    def each(batches):
        anchors: Vectors = shared.value
        best, high = Best(len(anchors), most), np.full(SLICE, GREATEST)
        for chunk, _ in _chunks(batches):
            for low in range(0, len(anchors), SLICE):
                own = anchors.part(low, low + SLICE)
                mask = (own.labels[:, None] == chunk.labels) & (own.rows[:, None] != chunk.rows)
                a, b, scores, _ = survivors(own, chunk, mask, best.bar[low : low + SLICE], high[: len(own)])
                best.add(a + low, scores, chunk.ids[b])
        yield from _found(best, 1)

    return each


def _negatives(shared, most: int, slots: int):
    """The best rows of other labels within the windows of every anchor and positive in a task."""

    def each(batches):
        anchors, least, greatest = shared.value
        best = Best(len(anchors) * slots, most)
        for chunk, _ in _chunks(batches):
            for first in range(0, len(anchors), SLICE):
                own = anchors.part(first, first + SLICE)
                least_own, most_own = least[first : first + SLICE], greatest[first : first + SLICE]
                bars = best.bar.reshape(-1, slots)[first : first + SLICE]
                open_ = least_own <= most_own
                low = np.where(open_, np.maximum(least_own, bars), GREATEST).min(axis=1)
                high = np.where(open_, most_own, LEAST).max(axis=1)
                mask = (own.labels[:, None] != chunk.labels) & open_.any(axis=1)[:, None]
                a, b, scores, _ = survivors(own, chunk, mask, low, high)
                for slot in range(slots):
                    fits = (scores >= least_own[a, slot]) & (scores <= most_own[a, slot])
                    best.add((a[fits] + first) * slots + slot, scores[fits], chunk.ids[b[fits]])
        yield from _found(best, slots)

    return each


def _merged(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with ``low * score <= 100 * s <= high * score``, as whole numbers; none if the first is greater."""
    return -(-low * score // 100), high * score // 100


RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def mine_hard_negatives(
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = 30,
    high: int = 90,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows(id, label, asked, vector)`` have whole numbers as components; ``asked`` marks the
    anchors. An anchor's positives are the ``positives`` best other rows of its label. For
    each, the ``negatives`` best rows of other labels come back whose score is from ``low``
    to ``high`` per cent of the positive's. Higher scores come first, then smaller ids.
    Shorter vectors count as filled up with zeros. Rows without id or label take no part;
    repeated rows are rows of their own. Scores beyond 64 bits wrap.

    Anchors go to the tasks in blocks of ``block_bytes``, and a block's results are
    written before the next one starts. All rows meet all anchors, so the work of the
    bounds grows with both.
    """
    spark = rows.sparkSession
    fine = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select(
        F.col("id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce("asked", F.lit(False)).alias("asked"),
        F.col("vector").cast("array<long>").alias("vector"),
    )
    store = vector_store(fine)
    anchors = number_rows(store.mapInArrow(_asked, ANCHOR), [], [F.col("id"), F.col("row")])
    count, width = anchors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    per_block = max(1, block_bytes // (16 * (width or 1)))
    path = fresh_path(spark, "hard-negatives")
    for first in range(0, count, per_block):
        block = anchors.where(F.col("ordinal").between(first + 1, first + per_block)).orderBy("ordinal")
        held = _of_table(block.select("row", "id", "label", "vector").toArrow())
        shared = spark.sparkContext.broadcast(held)
        best = cut_lineage(_merged(store.mapInArrow(_positives(shared, positives), FOUND), positives))
        shared.destroy()
        least, greatest = np.ones((len(held), positives), np.int64), np.zeros((len(held), positives), np.int64)
        for r in best.collect():
            if r.score >= 0:
                at = r.anchor, r["rank"] - 1
                least[at], greatest[at] = window_of(r.score, low, high)
        shared = spark.sparkContext.broadcast((held, least, greatest))
        found = _merged(store.mapInArrow(_negatives(shared, negatives, positives), FOUND), negatives)
        ids = anchors.select((F.col("ordinal") - (first + 1)).cast("int").alias("anchor"), F.col("id").alias("anchor_id"))
        pairs = best.select(
            "anchor",
            (F.col("rank") - 1).alias("slot"),
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ).join(ids, "anchor")
        made = found.join(pairs, ["anchor", "slot"]).select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
        made.write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(RESULT).parquet(path) if count else spark.createDataFrame([], RESULT)


def op11_segment_summaries(spark, sf_dir: str) -> DataFrame:
    given = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return mine_hard_negatives(
        given.where(usable(F.col("embedding"))).select(
            F.col("vec_id").alias("id"), label.alias("label"), (F.col("vec_id") % 100 == 0).alias("asked"), whole.alias("vector")
        )
    )


OP11_SQL = """
WITH fine AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM fine
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id != r.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
