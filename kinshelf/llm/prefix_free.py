"""Repeated byte strings, found through a prefix-free parse of the texts.

A rolling hash over eight bytes triggers where its value is small, so the same content
is cut at the same places wherever it stands. A phrase runs from one trigger to the end
of the next. The dictionary of phrases tells which occur again in the collection; a
window of ``window`` bytes can only be repeated if all phrases of the parse inside it
are. Such windows are brought together by their smallest rolling hash, neighbours as one
stretch of text, and are compared byte string by byte string.

Dictionary and windows are kept as equality classes, sorted within a partition, and not
as one suffix order of the corpus: equality of bounded strings is all that a removal
asks, and an order would have to be built across all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinshelf.llm.repeats import Blocks, among, digest_column, free_name, part_of, repeated
from kinshelf.llm.textual import SALTS, byte_symbols, joined, mix, pack, runs, span_hashes, text_buffers

#: Bytes that the rolling hash sees, and bytes from one trigger to the next on average.
TRIGGER, SPACING = 8, 24
ASK = "part int, block int, stretches binary, lengths binary, sure binary, phrases binary"
ANSWER = "block int, part int, repeated binary, phrases binary"


class _Parse:
    """Triggers, phrases and windows of some texts that follow each other in ``data``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, window: int):
        self.data, self.window = data, window
        padded = np.concatenate([data, np.zeros(TRIGGER, np.uint8)])
        self.rolling = mix(np.ndarray((len(data),), "<u8", padded, strides=(1,)))
        self.end_of = np.repeat(starts[1:], np.diff(starts))
        at = np.flatnonzero(self.rolling < np.uint64((1 << 64) // SPACING))
        self.at = at[at + TRIGGER <= self.end_of[at]]
        ends, text = self.at + TRIGGER, self.end_of[self.at]
        #: phrase k goes from trigger k to the end of trigger k + 1, if both are of one text and a window holds it
        self.whole = np.zeros(len(self.at), bool)
        self.whole[:-1] = (text[1:] == text[:-1]) & (ends[1:] - self.at[:-1] <= window)
        self.symbols = byte_symbols(data, SALTS[0])

    def phrase_hashes(self) -> np.ndarray:
        k = np.flatnonzero(self.whole)
        return span_hashes(self.symbols, self.at[k], self.at[k + 1] + TRIGGER, SALTS[0])

    def candidates(self, again: np.ndarray) -> np.ndarray:
        """Windows whose phrases all occur again, or that hold none."""
        starts = np.arange(len(self.data))
        starts = starts[starts + self.window <= self.end_of]
        once = np.append(0, np.cumsum(~again))
        first = np.searchsorted(self.at, starts)
        beyond = np.searchsorted(self.at, starts + self.window - TRIGGER, "right")
        return starts[once[np.maximum(beyond - 1, first)] == once[first]]

    def stretches(self, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates that follow each other under one smallest rolling hash: first, last and that hash."""
        at = self.candidates(again)
        if not len(at):
            return at, at, at.astype(np.uint64)
        least = _sliding_least(self.rolling, self.window - TRIGGER + 1)[at]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]))
        cuts = np.flatnonzero(new)
        return at[cuts], at[np.append(cuts[1:], len(at)) - 1], least[cuts]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` values from each place on; the last places see fewer."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        np.minimum(out[: len(out) - step], out[step:], out=out[: len(out) - step])
        have += step
    return out


def _parses(table: pa.Table, window: int):
    """The runs of a block: first row, places of rows, parse, and the copies of the text at a place."""
    data, starts = text_buffers(table.column("text"))
    n = np.asarray(table.column("n"))
    for lo, hi in runs(starts):
        own = starts[lo : hi + 1] - starts[lo]
        parse = _Parse(data[starts[lo] : starts[hi]], own, window)
        yield lo, own, parse, lambda at, own=own, lo=lo: n[lo + np.searchsorted(own, at, "right") - 1]


def _ask_phrases(window: int) -> Callable:
    def pieces(table, _):
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _lo, _own, parse, copies in _parses(table, window):
            hashes.append(parse.phrase_hashes())
            counts.append(copies(parse.at[parse.whole]))
        return np.concatenate(hashes), np.concatenate(counts)

    return pieces


class _Stretches:
    """Stretches of a block, each once and with whether the block has it more than once, by their part."""

    def __init__(self, parts: int):
        self.parts = parts
        self.places: list[dict[bytes, int]] = [{} for _ in range(parts)]
        self.sure: list[list[bool]] = [[] for _ in range(parts)]

    def add(self, parse: _Parse, again: np.ndarray, copies: Callable) -> list[tuple[int, int, int, int]]:
        """``(first, last, part, place)`` of the parse's stretches."""
        first, last, least = parse.stretches(again)
        # the smallest of some values is itself small: spread it before it is dealt
        part, many, raw, out = part_of(mix(least), self.parts), copies(first) > 1, parse.data.tobytes(), []
        for a, b, p, m in zip(first.tolist(), last.tolist(), part.tolist(), many.tolist()):
            place, new = self.places[p].setdefault(raw[a : b + parse.window], len(self.sure[p])), len(self.sure[p])
            if place == new:
                self.sure[p].append(m)
            else:
                self.sure[p][place] = True
            out.append((a, b, p, place))
        return out


def _ask_windows(window: int, parts: int) -> Callable:
    def asked(block, table, answers):
        known, held, phrases = repeated(answers), _Stretches(parts), [np.zeros(0, bool)]
        for _lo, _own, parse, copies in _parses(table, window):
            again = parse.whole.copy()
            again[parse.whole] = among(parse.phrase_hashes(), known)
            phrases.append(again)
            held.add(parse, again, copies)
        rows = [p for p in range(parts) if held.sure[p]]
        lengths = [pack(np.array([len(x) for x in held.places[p]], np.int32)) for p in rows]
        sure = [np.packbits(np.array(held.sure[p])).tobytes() for p in rows]
        data = [b"".join(held.places[p]) for p in rows]
        # the block's own phrases come back to it with the answers
        rows, data, lengths, sure = [*rows, block % parts], [*data, b""], [*lengths, b""], [*sure, b""]
        own = [None] * (len(rows) - 1) + [np.packbits(np.concatenate(phrases)).tobytes()]
        columns = ([block] * len(rows), data, lengths, sure, own)
        names, kinds = ("block", "stretches", "lengths", "sure", "phrases"), (pa.int32(), *[pa.binary()] * 4)
        return pa.table(
            {"part": pa.array(rows, pa.int32())} | {k: pa.array(c, t) for k, c, t in zip(names, columns, kinds)}
        )

    return asked


def _compare_windows(window: int) -> Callable:
    def answer(table):
        lengths = [joined([x], np.int32).astype(np.int64) for x in table.column("lengths").to_pylist()]
        every = np.concatenate([np.zeros(0, np.int64), *lengths])
        sure = [
            np.unpackbits(np.frombuffer(x, np.uint8))[: len(own)].astype(bool)
            for x, own in zip(table.column("sure").to_pylist(), lengths)
        ]
        counts = every - window + 1
        data = np.frombuffer(b"".join(table.column("stretches").to_pylist()), np.uint8)
        starts, hashes = np.append(0, np.cumsum(every)), [np.zeros((0, 2), np.uint64)]
        for lo, hi in runs(starts):
            symbols = byte_symbols(data[starts[lo] : starts[hi]], SALTS[0])
            n = counts[lo:hi]
            at = np.arange(n.sum()) + np.repeat(starts[lo:hi] - starts[lo] - (np.cumsum(n) - n), n)
            hashes.append(np.stack([span_hashes(symbols, at, at + window, s) for s in SALTS], axis=1))
        hashes = np.concatenate(hashes)
        flags = np.repeat(np.concatenate([np.zeros(0, bool), *sure]), counts)
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        hashes = hashes[order]
        same = (hashes[1:] == hashes[:-1]).all(axis=1)
        group = np.cumsum(np.append(True, ~same)[: len(order)]) - 1
        again = (np.bincount(group) > 1) | (np.bincount(group, flags[order]) > 0)
        flags[order] = again[group]
        cuts = np.append(0, np.cumsum([int((own - window + 1).sum()) for own in lengths]))
        bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return table.select(["block", "part"]).append_column("repeated", pa.array(bits, pa.binary())).append_column(
            "phrases", table.column("phrases")
        )

    return answer


def _removal(window: int, parts: int, derive: Callable, kept_type: pa.DataType) -> Callable:
    def result(_block, table, answers):
        phrases = b"".join(x for x in answers.column("phrases").to_pylist() if x)
        phrases, used = np.unpackbits(np.frombuffer(phrases, np.uint8)).astype(bool), 0
        held, done = _Stretches(parts), []
        for lo, own, parse, copies in _parses(table, window):
            again = phrases[used : used + len(parse.at)]
            used += len(parse.at)
            done.append((lo, own, parse.data, held.add(parse, again, copies)))
        bits = [np.zeros(0, bool)] * parts
        for p, blob in zip(answers.column("part").to_pylist(), answers.column("repeated").to_pylist()):
            if blob:
                bits[p] = np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool)
        before = [np.append(0, np.cumsum([len(x) - window + 1 for x in places])).tolist() for places in held.places]
        digests, out = table.column("digest").to_pylist(), []
        for lo, own, data, stretches in done:
            step = np.zeros(len(data) + 1, np.int32)
            for a, b, p, place in stretches:
                flags = bits[p][before[p][place] : before[p][place] + b - a + 1]
                step[a : b + 1] += flags
                step[a + window : b + 1 + window] -= flags
            gone = np.cumsum(step)[:-1] > 0
            for i in range(len(own) - 1):
                cut, bytes_ = gone[own[i] : own[i + 1]], data[own[i] : own[i + 1]]
                spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
                out.append((digests[lo + i], len(cut), int(cut.sum()), spans, derive(bytes_[~cut].tobytes())))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), kept_type)
        names = ("digest", "n_bytes", "n_removed", "n_spans", "kept")
        return pa.table({k: pa.array(list(c), t) for k, c, t in zip(names, columns, kinds)})

    return result


def kept_bytes(text: bytes) -> bytes:
    return text


def kept_digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def remove_repeated_bytes(
    docs: DataFrame, text: str = "text", window: int = 200, derive: Callable = kept_bytes, kept: str = "binary"
) -> DataFrame:
    """``docs`` and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``: the bytes no repeated window covers.

    A window is ``window`` consecutive bytes of one text in UTF-8; it is repeated if the
    same bytes also start anywhere else, in the same text or another, overlaps included.
    ``kept`` has the other bytes, in order, passed through ``derive`` (whose result has the
    SQL type ``kept``: binary, as a cut may fall inside a character, or string). Null and
    empty texts have no bytes. Copies of a row lose every window; texts shorter than a
    window stay whole. Columns of ``docs`` with the names of the results give way; other
    columns stay.
    """
    blocks = Blocks(docs, text)
    parts = blocks.parts
    asked = blocks.each(_ask_windows(window, parts), ASK, blocks.ask(_ask_phrases(window)))
    answers = blocks.gather(asked, _compare_windows(window), ANSWER)
    schema = f"digest binary, n_bytes long, n_removed long, n_spans long, kept {kept}"
    arrow = pa.binary() if kept == "binary" else pa.string()
    found = blocks.each(_removal(window, parts, derive, arrow), schema, answers)
    key = free_name(docs, "_digest")
    # the text itself may be named like a result
    plain = docs.withColumn(key, digest_column(text)).drop("n_bytes", "n_removed", "n_spans", "kept")
    return plain.join(found.withColumnRenamed("digest", key), key).drop(key)


def op3_prefix_free(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = remove_repeated_bytes(docs, window=200, derive=kept_digest, kept="string")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
