"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon, how often its
words stand near a second-person pronoun, capitals, punctuation and obfuscated words.
The lexicon holds words and word beginnings that labelled rows show to be toxic. It is
learned on one half of a bounded sample, the trees on most of the other half, and the
calibration on the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinshelf.llm.sampling import held_out, sample_by, uniform

#: Common insults, and pronouns that address the reader.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown "
    "dumb fool jerk imbecile cretin idiota imbécil estúpido basura asqueroso connard imbécile crétin "
    "ordure stupide débile dummkopf trottel abschaum widerlich blödmann".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself ur u tu toi te vous votre vos ton tes du dich dir dein deine ihr euch "
    "euer usted ustedes tú ti vosotros tus".split()
)
#: Learned from at most about so many rows of each label, and this many lexicon entries.
SAMPLE_ROWS, LEXICON = 10_000, 3_000
#: Rows that are scored at once.
ROWS = 500
#: Word beginnings of these lengths are lexicon candidates, and a hit counts as near within so many words.
BEGINNINGS, NEAR = (4, 5, 6), 5
_WORDS = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W\d_][0-9@$*#!%&+]+[^\W\d_]|[^\W\d_]{1,}[@$*#%&]{2,}")
_PUNCTUATION = re.compile(r"[^\w\s]")
NAMES = (
    "learned density", "learned hits", "learned weight", "strongest weight", "different hits", "fixed density",
    "near second person", "second person", "capital letters", "capital words", "exclamations", "punctuation",
    "obfuscated", "words",
)


def _entries(word: str):
    yield word
    for n in BEGINNINGS:
        if len(word) > n:
            yield word[:n] + "-"


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The values that ``NAMES`` lists; those of an empty text are all 0."""
    text = text or ""
    words = _WORDS.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    weight = dict.fromkeys(words, 0.0)
    for w in weight:
        weight[w] = max((lexicon.get(e, 0.0) for e in _entries(w)), default=0.0)
    found = [i for i, w in enumerate(words) if weight[w] or w in INSULTS]
    hits = [weight[words[i]] for i in found if weight[words[i]]]
    fixed = sum(words[i] in INSULTS for i in found)
    persons = sum(w in SECOND_PERSON for w in words)
    near = 0
    if found and persons:
        near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in found)
    letters = max(1, sum(map(len, words)))
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    return [
        100 * len(hits) / n, float(len(hits)), 100 * sum(hits) / n, max(hits, default=0.0),
        float(len({words[i] for i in found})), 100 * fixed / n, 100 * near / n, 100 * persons / n,
        capitals / letters, sum(w.isupper() and len(w) > 1 for w in text.split()) / n,
        100 * text.count("!") / n, len(_PUNCTUATION.findall(text)) / n, len(_MASKED.findall(text)) / n,
        float(np.log1p(n)),
    ]


@dataclass
class Trees:
    """Boosted trees of three levels for a logistic loss, split at quantiles of the features."""

    rounds: int = 80
    rate: float = 0.15
    bins: int = 48
    smooth: float = 2.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, levels, n = float(np.log(share / (1 - share))), 3, x.shape[1]
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(n)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(n)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            columns, cuts = np.zeros(2**levels - 1, np.int64), np.full(2**levels - 1, np.inf)
            for level in range(levels):
                width = 2**level
                best = np.full(width, 1e-9)
                for j in range(n):
                    size = len(edges[j]) + 1
                    at = node * size + binned[:, j]
                    g = np.bincount(at, slope, width * size).reshape(width, size).cumsum(axis=1)
                    h = np.bincount(at, curve, width * size).reshape(width, size).cumsum(axis=1)
                    gain = lambda a, b: a * a / (b + self.smooth)
                    total = gain(g[:, :-1], h[:, :-1]) + gain(g[:, -1:] - g[:, :-1], h[:, -1:] - h[:, :-1])
                    total = total - gain(g[:, -1:], h[:, -1:])
                    if size > 1:
                        top = total.argmax(axis=1)
                        for k in np.flatnonzero(total[np.arange(width), top] > best):
                            best[k] = total[k, top[k]]
                            columns[width - 1 + k], cuts[width - 1 + k] = j, edges[j][top[k]]
                here = width - 1 + node
                node = 2 * node + (x[np.arange(len(y)), columns[here]] > cuts[here])
            leaves = np.bincount(node, slope, 2**levels) / (np.bincount(node, curve, 2**levels) + self.smooth)
            self.trees.append((columns, cuts, self.rate * leaves))
            raw += self.rate * leaves[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for columns, cuts, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(3):
                here = 2**level - 1 + node
                node = 2 * node + (x[rows, columns[here]] > cuts[here])
            out += leaves[node]
        return out


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step function closest to ``y``, by pooling adjacent violators."""
    at, group = np.unique(scores, return_inverse=True)
    blocks: list[list[float]] = []
    for s, total, n in zip(at, np.bincount(group, y), np.bincount(group)):
        blocks.append([s, s, total, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return (
        np.array([x for b in blocks for x in b[:2]]),
        np.array([v for b in blocks for v in [b[2] / b[3]] * 2]),
    )


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees
    points: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in texts]))
        # the raw score orders what the calibration puts on one level
        calibrated = np.interp(raw, *self.points) if len(self.points[0]) else np.zeros(len(raw))
        return np.clip(0.998 * calibrated + 0.002 / (1 + np.exp(-raw)), 0, 1)


def _lexicon_counts(batches):
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {e for w in set(_WORDS.findall((text or "").lower())) for e in _entries(w)}
            (toxic if label else clean).update(own)
        names = list(toxic)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([0] * len(names), pa.int64())],
            names=["entry", "toxic", "clean"],
        )
        names = list(clean)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([clean[x] for x in names], pa.int64())],
            names=["entry", "toxic", "clean"],
        )


def _learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """The entries whose log odds of a toxic row are highest, with these."""
    n = {bool(r[0]): r[1] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return {}
    counts = (
        rows.select("text", "label")
        .mapInArrow(_lexicon_counts, "entry string, toxic long, clean long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    odds = F.log((F.col("toxic") + 0.5) / (n[True] + 1)) - F.log((F.col("clean") + 0.5) / (n[False] + 1))
    top = (
        counts.where(F.col("toxic") >= 5)
        .withColumn("odds", odds)
        .where("odds > 2")
        .orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "entry")
        .limit(LEXICON)
    )
    return {r["entry"]: float(r["odds"]) for r in top.collect()}


def _feature_rows(lexicon: dict[str, float]):
    def each(batches):
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                names=["features", "label", "part"],
            )

    return each


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """A model from labelled rows that are not held out, about ``sample_rows`` of each label at most.

    Rows without a label or an id teach nothing; of several labels of one id the highest
    counts. Without rows of both labels
    every score is close to the one label there is, or to 0.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(doc_id)
        .agg((F.max(label) > 0).cast("int").alias("label"))
    )
    chosen = sample_by(chosen, "label", doc_id, sample_rows)  # two labels, so a bounded table
    rows = (
        docs.select(doc_id, F.col(text).alias("text"))
        .join(F.broadcast(chosen), doc_id)
        .withColumn("part", (uniform(doc_id, 2) * 6).cast("int"))
        .drop(doc_id)
    )
    lexicon = _learn_lexicon(rows.where("part < 3"))
    held = (
        rows.where("part >= 3")
        .mapInArrow(_feature_rows(lexicon), "features array<double>, label int, part int")
        .toPandas()
    )
    x = np.array(held["features"].tolist(), float).reshape(len(held), len(NAMES))
    y, part = held["label"].to_numpy(float), held["part"].to_numpy()
    if len(set(y[part < 5])) < 2 or not (part == 5).any():
        seen = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(lexicon, Trees(), (np.array([0.0, 1.0]), np.array([seen, seen])))
    order = np.lexsort([*x.T, y])  # rows come in any order; sums should not depend on it
    x, y, part = x[order], y[order], part[order]
    trees = Trees().fit(x[part < 5], y[part < 5])
    return ToxicityModel(lexicon, trees, isotonic(trees.raw(x[part == 5]), y[part == 5]))


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), for every whole text; null counts as empty.

    Columns of these names give way.
    """

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        parts = [model.scores(column.slice(k, ROWS).to_pylist()) for k in range(0, len(column), ROWS)]
        return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    scored = docs.withColumn("score", score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_boosted_trees(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
