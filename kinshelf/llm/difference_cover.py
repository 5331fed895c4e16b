"""Repeated word windows, found through anchors at the positions of a difference cover.

Anchors shorter than a window are hashed only where the word's position modulo a period
lies in a difference cover. For any two positions of a match some shift below the period
puts both on the cover, so two equal windows always share an anchor; windows that hold a
repeated anchor are then extended to their full length and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinshelf.llm.repeats import Blocks, among, among_wide, digest_column, free_name, repeated
from kinshelf.llm.textual import (
    NOT_BLANK,
    SALTS,
    runs,
    span_hashes,
    text_buffers,
    word_hashes,
    word_spans,
)


def difference_cover(period: int) -> tuple[int, ...]:
    """Positions whose differences make up every remainder modulo ``period``; the smallest set up to 31."""
    if period > 31:
        step = int(np.ceil(np.sqrt(period)))
        return tuple(sorted({*range(step), *range(step, period, step)}))
    wanted = set(range(period))
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            chosen = (0, *rest)
            if {(a - b) % period for a in chosen for b in chosen} == wanted:
                return chosen
    return (0,)


def cover_period(window: int) -> int:
    """Period for a window length; what remains of the window is the anchor's length."""
    return max(1, window * 3 // 5)


class _Words:
    """Words of a run of texts: hashes, and each word's and text's place."""

    def __init__(self, table: pa.Table):
        self.data, self.starts = text_buffers(table.column("text"))
        self.n = np.asarray(table.column("n"))

    def runs(self):
        for lo, hi in runs(self.starts):
            data = self.data[self.starts[lo] : self.starts[hi]]
            first, last, of = word_spans(data, self.starts[lo : hi + 1] - self.starts[lo], NOT_BLANK)
            hashes = word_hashes(data, first, last)
            yield lo, hi, hashes, of, np.repeat(np.arange(lo, hi), np.diff(of))


def _starts(of: np.ndarray, owner: np.ndarray, lo: int, length: int) -> np.ndarray:
    """Words at which a window of ``length`` words of one text begins."""
    at = np.arange(len(owner))
    return at[at + length <= of[owner - lo + 1]] if len(at) else at


def _anchors(of, owner, lo, window):
    period = cover_period(window)
    length = window - period + 1
    on = np.zeros(period, bool)
    on[list(difference_cover(period))] = True
    at = _starts(of, owner, lo, length)
    return at[on[(at - of[owner[at] - lo]) % period]], length


def _ask_anchors(window: int) -> Callable:
    def pieces(table, _):
        words, hashes, counts = _Words(table), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, _hi, symbols, of, owner in words.runs():
            at, length = _anchors(of, owner, lo, window)
            hashes.append(span_hashes(symbols, at, at + length, SALTS[0]))
            counts.append(words.n[owner[at]])
        return np.concatenate(hashes), np.concatenate(counts)

    return pieces


def _candidates(lo, symbols, of, owner, window, known):
    """Windows that hold a repeated anchor within their first period."""
    at, length = _anchors(of, owner, lo, window)
    hit = np.zeros(len(symbols) + 1, np.int64)
    hit[at[among(span_hashes(symbols, at, at + length, SALTS[0]), known)] + 1] = 1
    before = np.cumsum(hit)
    starts = _starts(of, owner, lo, window)
    return starts[before[starts + cover_period(window)] > before[starts]]


def _wide(symbols, starts, window):
    return np.stack([span_hashes(symbols, starts, starts + window, s) for s in SALTS], axis=1)


def _ask_windows(window: int) -> Callable:
    def pieces(table, known):
        words, hashes, counts = _Words(table), [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
        for lo, _hi, symbols, of, owner in words.runs():
            starts = _candidates(lo, symbols, of, owner, window, known)
            hashes.append(_wide(symbols, starts, window))
            counts.append(words.n[owner[starts]])
        return np.concatenate(hashes), np.concatenate(counts)

    return pieces


def kept_text(text: bytes) -> str:
    return text.decode()


def kept_digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _removal(window: int, derive: Callable[[bytes], str]) -> Callable:
    def result(_block, table, answers):
        words, known, out = _Words(table), repeated(answers), []
        texts, digests = table.column("text"), table.column("digest").to_pylist()
        for lo, hi, symbols, of, owner in words.runs():
            starts = _starts(of, owner, lo, window)
            lead = span_hashes(symbols, starts, starts + window, SALTS[0])
            again = among_wide(lambda at, s=symbols: _wide(s, at, window), starts, lead, known)
            step = np.zeros(len(symbols) + 1, np.int64)
            step[again] += 1
            step[again + window] -= 1
            keep = np.cumsum(step)[:-1] == 0
            for i in range(lo, hi):
                own = keep[of[i - lo] : of[i - lo + 1]]
                kept = b" ".join(compress(texts[i].as_py().split(), own.tolist()))
                out.append((digests[i], len(own), int(len(own) - own.sum()), derive(kept)))
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        names = ("digest", "n_words", "n_removed", "kept")
        return pa.table({k: pa.array(list(c), t) for k, c, t in zip(names, columns, kinds)})

    return result


def remove_repeated_windows(
    docs: DataFrame, text: str = "text", window: int = 35, derive: Callable[[bytes], str] = kept_text
) -> DataFrame:
    """``docs`` and ``n_words``, ``n_removed``, ``kept``: the words no repeated window covers.

    A word is a stretch without space, tab, line feed, vertical tab, form feed or
    carriage return. A window is ``window`` consecutive words of one text; it is
    repeated if its words also start anywhere else, in the same text or another,
    overlaps included. ``kept`` has the other words, joined by one space, passed
    through ``derive``. Null and empty texts have no words and keep "". Copies of a
    row lose every window; texts shorter than a window stay whole. Columns of
    ``docs`` with the names of the results give way; other columns stay.
    """
    blocks = Blocks(docs, text)
    anchors = blocks.ask(_ask_anchors(window))
    windows = blocks.ask(_ask_windows(window), anchors, wide=True)
    schema = "digest binary, n_words long, n_removed long, kept string"
    found = blocks.each(_removal(window, derive), schema, windows)
    key = free_name(docs, "_digest")
    kept = docs.withColumn(key, digest_column(text)).drop("n_words", "n_removed", "kept")
    return kept.join(found.withColumnRenamed("digest", key), key).drop(key)


def op4_difference_cover(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = remove_repeated_windows(docs, window=35, derive=kept_digest)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP4_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), words AS (
  SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM texts WHERE len(ws) > 0
), starts AS (
  SELECT r, unnest(range(1, len(ws) - 33)) AS i FROM texts WHERE len(ws) >= 35
), windows AS (
  SELECT s.r, s.i, md5(array_to_string(t.ws[s.i : s.i + 34], ' ')) AS h
  FROM starts s JOIN texts t ON s.r = t.r
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT w.r, w.i, w.w,
         max(x.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS UNBOUNDED PRECEDING) AS latest
  FROM words w LEFT JOIN repeated x ON w.r = x.r AND w.i = x.i
), kept AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE latest > i - 35) AS n_removed,
         string_agg(w, ' ' ORDER BY i) FILTER (WHERE latest IS NULL OR latest <= i - 35) AS kept
  FROM covered GROUP BY r
)
SELECT t.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.r = k.r
"""
