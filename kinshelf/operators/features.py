"""Documents to tokens, copies and vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinshelf.functions.fixed_values import NAMING_IGNORE
from kinshelf.functions.paths import name_stem
from kinshelf.functions.text import ASCII_WORD, naming_tokens
from kinshelf.operators.similarity import packed_units
from kinshelf.session import cut_lineage, number_rows, one_step, spread


def document_tokens(
    docs: DataFrame,
    text: str = "text",
    filename: str | None = None,
    ignore: list[str] = NAMING_IGNORE,
    word: str = ASCII_WORD,
) -> DataFrame:
    """``(doc_id, stem_tokens, tokens)`` of whole texts and filename stems.

    A document without text is named after its filename alone.
    """
    stem = name_stem(F.col(filename)) if filename else F.lit("")
    body = F.nullif(F.col(text), F.lit(""))
    if filename:
        body = F.coalesce(body, F.col(filename))
    read = {"doc_id", text} | ({filename} if filename else set())
    return spread(docs.select(*read)).select(
        "doc_id",
        naming_tokens(stem, ignore, word).alias("stem_tokens"),
        naming_tokens(body, ignore, word).alias("tokens"),
    )


def fold_copies(tokens: DataFrame) -> DataFrame:
    """``(doc_id, rep, n)``: documents with one bag of words share a representative.

    ``n`` counts the documents a representative stands for. Later steps work on
    representatives, so a text copied millions of times costs as much as one. A
    document without words is like no other and stands for itself.
    """
    bags = tokens.select(
        "doc_id",
        F.when(
            F.size("tokens") > 0, F.sha2(F.concat_ws(" ", F.array_sort("tokens")), 256)
        ).alias("bag"),
    )
    return represented(bags)


def represented(bags: DataFrame) -> DataFrame:
    """``(doc_id, rep, n)`` from ``(doc_id, bag)``; a NULL bag is like no other.

    The aggregate is a table of its own, so that both sides of the join are plain
    shuffles and Spark can split a bag that very many documents have.
    """
    reps = cut_lineage(
        bags.where(F.col("bag").isNotNull())
        .groupBy("bag")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    )
    return bags.join(reps, "bag", "left").select(
        "doc_id",
        F.coalesce("rep", "doc_id").alias("rep"),
        F.coalesce("n", F.lit(1)).alias("n"),
    )


def fold_equal_vectors(vectors: DataFrame) -> DataFrame:
    """``fold_copies`` for dense ``(doc_id, embedding)``: equal arrays are copies."""
    bags = vectors.select(
        "doc_id",
        F.when(
            F.exists("embedding", lambda x: x != 0), F.sha2(F.array_join("embedding", " "), 256)
        ).alias("bag"),
    )
    return represented(bags)


def representatives(copies: DataFrame) -> DataFrame:
    """``(doc_id, n)`` of the representatives alone."""
    return copies.where(F.col("doc_id") == F.col("rep")).select("doc_id", "n")


def _raw_weights(tokens: DataFrame, copies: DataFrame | None, number: bool) -> tuple[DataFrame, DataFrame]:
    """Weights ``(doc_id, term, raw)`` before they are brought to unit length, and the table of terms.

    With ``number``, weights have the ``number`` of the term, which the table of terms tells.
    """
    words = tokens.select("doc_id", "tokens")

    def with_copies(words: DataFrame) -> DataFrame:
        if copies is None:
            return words.withColumn("n", F.lit(1))
        return words.join(representatives(copies), "doc_id")

    weighted = with_copies(words)
    # Documents are dealt out before their words are listed: counting them then moves nothing.
    counts = (
        with_copies(words.repartition("doc_id"))
        .select("doc_id", F.explode("tokens").alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    total = tokens.agg(F.count(F.lit(1))).scalar()
    # from the documents, not from the counts, and as a table of its own: the join then
    # has two plain shuffles, and Spark can split a term that is everywhere
    idf = cut_lineage(
        weighted.select("n", F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.sum("n").alias("df"))
        .select("term", (F.ln((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    if number:
        idf = _numbered(idf)
    raw = counts.join(idf, "term").select(
        "doc_id", "number" if number else "term", ((1 + F.ln("tf")) * F.col("idf")).alias("raw")
    )
    return raw, idf


@one_step
def _numbered(idf: DataFrame) -> DataFrame:
    numbered = number_rows(idf, [], [F.asc("term")], "number")
    return numbered.withColumn("number", F.col("number").cast("int"))


def tfidf_vectors(tokens: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Unit-length TF-IDF vectors as ``(doc_id, term, w)``.

    Term frequency is damped as ``1 + ln tf``, document frequency smoothed as
    ``ln((1 + N) / (1 + df)) + 1``. With ``copies``, only representatives get a
    vector; frequencies still count every document.
    """
    raw, _ = _raw_weights(tokens, copies, False)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("raw") / length).alias("w"))


def packed_tfidf(tokens: DataFrame, copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``tfidf_vectors`` packed to a row each, ``(doc_id, terms, w)``, and ``(term, number)`` of the terms."""
    raw, idf = _raw_weights(tokens, copies, True)
    unit = packed_units(raw.where(F.col("doc_id").isNotNull()).withColumnRenamed("raw", "w"), ["doc_id"])
    return unit, idf.select("term", "number")


def hashed_vectors(tokens: DataFrame, dimensions: int = 1024) -> DataFrame:
    """Unit-length hashed TF-IDF vectors as ``(doc_id, embedding array<float>)``."""
    hashed = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dimensions).transform(
        tokens.select("doc_id", "tokens")
    )
    weighed = IDF(inputCol="tf", outputCol="tfidf").fit(hashed).transform(hashed)
    unit = Normalizer(inputCol="tfidf", outputCol="unit", p=2.0).transform(weighed)
    return unit.select("doc_id", vector_to_array("unit", "float32").alias("embedding"))


def hashed_terms(tokens: DataFrame, dimensions: int = 256) -> DataFrame:
    """Unit-length vectors of hashed word counts, ``(doc_id, embedding array<float>)``.

    A document's vector depends on its own words alone, so it stays when others change.
    """
    hashed = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dimensions).transform(
        tokens.select("doc_id", "tokens")
    )
    unit = Normalizer(inputCol="tf", outputCol="unit", p=2.0).transform(hashed)
    return unit.select("doc_id", vector_to_array("unit", "float32").alias("embedding"))


def encoded_vectors(
    docs: DataFrame, encode: Callable[[Column], Column], dimensions: int, text: str = "text"
) -> DataFrame:
    """Vectors from the caller's own encoder, such as a ``pandas_udf`` around a model.

    Blank texts are not sent to the encoder; their vector is zero.
    """
    blank = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")) == ""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return docs.select(
        "doc_id",
        F.when(blank, zero).otherwise(encode(F.col(text)).cast("array<float>")).alias("embedding"),
    )


#: Models that this worker has loaded, by name.
_MODELS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def model_vectors(
    docs: DataFrame,
    model: str,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    dimensions: int,
    text: str = "text",
    at_once: int = 64,
) -> DataFrame:
    """``(doc_id, embedding)`` from a model that every worker loads once.

    ``load()`` returns a function from a list of texts to a matrix with a row for each;
    ``model`` is its name, with its version. Texts go to it ``at_once`` by ``at_once``, those
    of like length together, so that a model that fills up to the longest does little for
    nothing. Blank texts are not sent; their vector is zero.
    """

    def each(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = sorted((i for i, t in enumerate(texts) if t.strip()), key=lambda i: len(texts[i]))
            if rows and model not in _MODELS:
                _MODELS[model] = load()
            found = np.zeros((len(texts), dimensions), np.float32)
            for at in range(0, len(rows), at_once):
                own = rows[at : at + at_once]
                found[own] = _MODELS[model]([texts[i] for i in own])
            vectors = pa.FixedSizeListArray.from_arrays(found.ravel(), dimensions).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["doc_id", "embedding"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(each, f"doc_id {kind}, embedding array<float>")


def vectors_by_content(
    files: DataFrame, renewed: DataFrame, vectorize: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``(file_path, embedding)`` of ``renewed(file_path, checksum, text)``, made once for equal content.

    What the catalog ``files`` has a vector for, under any path, is not made again.
    ``vectorize`` turns ``(doc_id, text)`` into ``(doc_id, embedding)``.
    """
    renewed = cut_lineage(renewed.select("file_path", "checksum", "text"))
    wanted = renewed.select("checksum").distinct()
    known = cut_lineage(
        files.where(F.col("embedding").isNotNull() & F.col("checksum").isNotNull())
        .join(wanted, "checksum", "left_semi")
        .groupBy("checksum")
        .agg(F.first("embedding").alias("embedding"))
    )
    new = renewed.join(known, "checksum", "left_anti").groupBy("checksum").agg(F.first("text").alias("text"))
    made = vectorize(cut_lineage(new.withColumnRenamed("checksum", "doc_id")))
    every = known.unionAll(made.select("doc_id", F.col("embedding").cast("array<float>")))
    return renewed.select("file_path", "checksum").join(cut_lineage(every), "checksum").select("file_path", "embedding")
