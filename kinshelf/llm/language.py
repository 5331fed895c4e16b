"""Languages of words by a linear-chain conditional random field.

A word's features are its affixes, its bigrams and trigrams of bytes and the word itself;
their weights and the transitions between languages are learned together on sequences
that switch language. Forward-backward gives every word a posterior, so a text may mix
languages; a document gets the language with the largest share of its words.

Features and recursions are arrays over all words of a run of texts. A text is cut into
chunks whose transfer matrices are chained, so its posteriors are those of the whole
text, and a long one takes as many steps as a chunk has words and as it has chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinshelf.llm.decontaminate import lowered
from kinshelf.llm.repeats import free_name
from kinshelf.llm.sampling import held_out, sample_by
from kinshelf.llm.textual import RUN_BYTES, mask_of, mix, runs, text_buffers, word_hashes, word_spans

#: Learned from at most about so many rows of each language, and so many words of each row.
SAMPLE_ROWS, SAMPLE_WORDS = 500, 240
#: Bits of the table that features are hashed into, words of a chunk and of a learning sequence.
BITS, CHUNK, SEQUENCE = 17, 64, 48
_WORD = mask_of((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
UNKNOWN = "und"


def _slot(codes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(codes + (np.uint64(kind) << np.uint64(56))) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, word by word, and where each word's begin.

    A word of n bytes has n + 1 bigrams and n trigrams with its borders, six affixes of up
    to four bytes and one feature for itself.
    """
    n = last - first
    total = int(n.sum())
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    b = data[at].astype(np.uint64)
    start, end = at == first[word], at + 1 == last[word]
    border = np.uint64(0x20)
    left = np.where(start, border, np.append(border, b[:-1]))
    right = np.where(end, border, np.append(b[1:], border))
    two, three = np.uint64(8), np.uint64(16)
    counts = 2 * n + 1 + 7
    where = np.append(0, np.cumsum(counts))
    out = np.empty(where[-1], np.int64)
    inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    base = where[:-1][word]
    out[base + inside] = _slot(left | b << two, 1)
    out[base + n[word] + inside] = _slot(left | b << two | right << three, 2)
    tail = where[:-1] + 2 * n
    out[tail] = _slot(data[last - 1].astype(np.uint64) | border << two, 1)
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.uint64)
    for k, size in enumerate((2, 3, 4)):
        head, foot = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        for j in range(size):
            shift = np.uint64(8 * j)
            head |= np.where(j < n, padded[first + j], 0).astype(np.uint64) << shift
            foot |= np.where(j < n, padded[np.maximum(last - 1 - j, 0)], 0).astype(np.uint64) << shift
        out[tail + 1 + 2 * k] = _slot(head, 3 + 2 * k)
        out[tail + 2 + 2 * k] = _slot(foot, 4 + 2 * k)
    out[tail + 7] = _slot(word_hashes(data, first, last), 9)
    return out, where


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros((0, len(self.languages)), np.float32)
        slots, where = word_features(data, first, last)
        return np.add.reduceat(self.weights[slots], where[:-1], axis=0)

    def posteriors(self, emissions: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Posterior of every word; ``of`` has the first word of each text, and one entry more."""
        k = len(self.languages)
        psi = np.exp((emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64))
        step = np.exp(self.transitions - self.transitions.max())
        # chunks, the longest first; chunk c has words at[c] to at[c] + size[c]
        per_text = -(-np.diff(of) // CHUNK)
        text = np.repeat(np.arange(len(per_text)), per_text)
        number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        at = of[text] + number * CHUNK
        size = np.minimum(CHUNK, of[text + 1] - at)
        by_size = np.argsort(-size, kind="stable")
        open_at = np.searchsorted(-size[by_size], -np.arange(CHUNK), "left")  # chunks longer than t
        transfer = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
        for t in range(CHUNK):
            live = by_size[: open_at[t]]
            if not len(live):
                break
            now = (transfer[live] @ step) * psi[at[live] + t][:, None, :]
            transfer[live] = now / now.max(axis=(1, 2), keepdims=True)
        # chained over the chunks of each text, all texts at once
        entry, exit_ = np.full((len(text), k), 1.0 / k), np.ones((len(text), k))
        first_chunk = np.cumsum(per_text) - per_text
        by_chunks = np.argsort(-per_text, kind="stable")
        longest = int(per_text.max(initial=0))
        texts_with = np.searchsorted(-per_text[by_chunks], -np.arange(longest + 1), "left")
        for j in range(longest - 1):
            own = first_chunk[by_chunks[: texts_with[j + 1]]] + j
            now = np.einsum("ni,nij->nj", entry[own], transfer[own])
            entry[own + 1] = now / now.sum(axis=1, keepdims=True)
        for j in range(longest - 2, -1, -1):
            own = first_chunk[by_chunks[: texts_with[j + 1]]] + j
            now = np.einsum("nij,nj->ni", transfer[own + 1], exit_[own + 1])
            exit_[own] = now / now.max(axis=1, keepdims=True)
        out = np.empty_like(psi)
        state = entry
        for t in range(CHUNK):
            live = by_size[: open_at[t]]
            if not len(live):
                break
            now = (state[live] @ step) * psi[at[live] + t]
            state[live] = out[at[live] + t] = now / now.sum(axis=1, keepdims=True)
        state = exit_
        for t in range(CHUNK):
            live = by_size[: open_at[t]]
            if not len(live):
                break
            word = at[live] + size[live] - 1 - t
            out[word] *= state[live]
            now = (psi[word] * state[live]) @ step.T
            state[live] = now / now.max(axis=1, keepdims=True)
        return out / out.sum(axis=1, keepdims=True)

    def word_posteriors(self, column: pa.Array):
        """For runs of rows: first row, words' starts and ends in the lower-case text, first word of each row, posteriors."""
        data, starts = text_buffers(lowered(column))
        for lo, hi in runs(starts, max(1 << 16, RUN_BYTES * 4 // max(4, len(self.languages)))):
            own = data[starts[lo] : starts[hi]]
            first, last, of = word_spans(own, starts[lo : hi + 1] - starts[lo], _WORD)
            yield lo, first, last, of, self.posteriors(self.emissions(own, first, last), of)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its share of the words of every text."""
        names, shares = [], []
        letters = pc.match_substring_regex(column.cast(pa.large_string()).fill_null(""), r"\p{L}").to_pylist()
        for lo, _first, _last, of, posterior in self.word_posteriors(column):
            sums = np.append(np.zeros((1, posterior.shape[1])), np.cumsum(posterior, axis=0), axis=0)
            count = np.diff(of)
            mean = (sums[of[1:]] - sums[of[:-1]]) / np.maximum(count, 1)[:, None]
            best = mean.argmax(axis=1)
            for i, (k, n) in enumerate(zip(best.tolist(), count.tolist())):
                known = n and letters[lo + i]
                names.append(self.languages[k] if known else UNKNOWN)
                shares.append(min(1.0, max(0.0, float(mean[i, k]))) if known else 0.0)
        return names, np.array(shares)


def _fit(slots: list[np.ndarray], labels: np.ndarray, languages: list[str], rounds: int = 3, batch: int = 256) -> LanguageModel:
    """Weights and transitions that make the labels of the sequences likely, by AdaGrad on the log-likelihood."""
    k, size = len(languages), 1 << BITS
    weights, seen = np.zeros((size, k)), np.full((size, k), 1e-3)
    moves, moved = np.zeros((k, k)), np.full((k, k), 1e-3)
    n = len(labels)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            own = order[lo : lo + batch]
            y = labels[own]
            flat = np.concatenate([slots[i][0] for i in own])
            counts = np.concatenate([slots[i][1] for i in own])
            begin = np.cumsum(counts) - counts
            e = np.add.reduceat(weights[flat], begin, axis=0).reshape(len(own), SEQUENCE, k)
            psi, step = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(moves - moves.max())
            ahead, back = np.empty_like(psi), np.empty_like(psi)
            state = np.full((len(own), k), 1.0 / k)
            for t in range(SEQUENCE):
                state = (state @ step) * psi[:, t]
                state = ahead[:, t] = state / state.sum(axis=1, keepdims=True)
            state = np.ones((len(own), k))
            for t in range(SEQUENCE - 1, -1, -1):
                back[:, t] = state
                state = (psi[:, t] * state) @ step.T
                state = state / state.max(axis=1, keepdims=True)
            p = ahead * back
            p /= p.sum(axis=2, keepdims=True)
            pair = ahead[:, :-1, :, None] * step * (psi * back)[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            wrong = p.reshape(-1, k)
            wrong[np.arange(y.size), y.ravel()] -= 1
            spread = np.repeat(np.arange(y.size), counts)
            grad = np.stack([np.bincount(flat, wrong[spread, j], size) for j in range(k)], axis=1) / len(own)
            hit = np.flatnonzero(grad.any(axis=1))
            seen[hit] += grad[hit] ** 2
            weights[hit] -= 0.1 * grad[hit] / np.sqrt(seen[hit])
            kept = np.zeros((k, k))
            np.add.at(kept, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            change = (pair.sum(axis=(0, 1)) - kept) / len(own)
            moved += change**2
            moves -= 0.1 * change / np.sqrt(moved)
    return LanguageModel(languages, weights.astype(np.float32), moves)


def _spans(most: int):
    """Words of each row to learn from: a stretch whose place depends on the text alone."""

    def each(batches):
        for batch in batches:
            data, starts = text_buffers(lowered(batch.column(0)))
            first, last, of = word_spans(data, starts, _WORD)
            out = []
            for i in range(len(starts) - 1):
                n = int(of[i + 1] - of[i])
                skip = int(starts[i + 1] - starts[i]) * 7919 % (n - most + 1) if n > most else 0
                a, b = int(of[i]) + skip, int(of[i]) + skip + min(n, most)
                out.append(b" ".join(data[first[j] : last[j]].tobytes() for j in range(a, b)).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string())], names=["lang", "words"])

    return each


def fit_language(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS
) -> LanguageModel:
    """A model of the languages that rows with a language, an id and a text name, unless they are held out."""
    rows = docs.where(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)
    )
    chosen = sample_by(rows.select(doc_id, text, F.col(lang).alias("lang")), "lang", doc_id, sample_rows)
    held = sorted(
        tuple(r) for r in chosen.select(text, "lang").mapInArrow(_spans(SAMPLE_WORDS), "lang string, words string").collect()
    )
    languages = sorted({r[0] for r in held})
    rng = np.random.default_rng(0)
    pieces = []  # stretches of one language, to be joined into sequences that switch
    for name, words in held:
        words = words.split(" ") if words else []
        while words:
            n = int(rng.integers(8, 3 * SEQUENCE))
            pieces.append((languages.index(name), words[:n]))
            words = words[n:]
    rng.shuffle(pieces)
    words = [w for _, own in pieces for w in own]
    labels = np.repeat([y for y, _ in pieces], [len(own) for _, own in pieces]).astype(np.int64)
    n = len(words) // SEQUENCE
    if not n:
        return LanguageModel(languages, np.zeros((1 << BITS, max(1, len(languages))), np.float32), np.zeros((max(1, len(languages)),) * 2))
    slots = []
    for i in range(n):
        data = np.frombuffer(" ".join(words[i * SEQUENCE : (i + 1) * SEQUENCE]).encode(), np.uint8)
        first, last, _ = word_spans(data, np.array([0, len(data)]), _WORD)
        flat, where = word_features(data, first, last)
        slots.append((flat, np.diff(where)))
    return _fit(slots, labels[: n * SEQUENCE].reshape(n, SEQUENCE), languages)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs``, ``lang_pred`` and ``score``: the language of most words of each whole text, and its share.

    A null text, or one without a letter, is ``und`` with score 0. So is every text if the
    model has seen no language. Columns of these names give way.
    """

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(column: pa.Array) -> pa.Array:
        if not model.languages:
            names, shares = [UNKNOWN] * len(column), np.zeros(len(column))
        else:
            names, shares = model.predict(column)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["lang", "score"])

    name = free_name(docs, "_language")
    found = docs.withColumn(name, predict(F.col(text)))
    return (
        found.withColumn("lang_pred", F.col(f"{name}.lang")).withColumn("score", F.col(f"{name}.score")).drop(name)
    )


def op2_random_field(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = with_language(docs, fit_language(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
