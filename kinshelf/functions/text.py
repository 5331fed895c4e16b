"""Token, n-gram and label expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from kinshelf.functions.fixed_values import (
    FORBIDDEN_IN_FOLDER_NAME,
    LABEL_EXTENSIONS,
    NAMING_IGNORE,
    STOP_WORDS,
)

ASCII_WORD = "[a-z]{3,}"
_CLOSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Words of any script with their marks; where words stand without spaces, two letters of one script are enough.
UNICODE_WORD = (
    r"[\p{IsHan}々]{2,}|\p{IsHiragana}{2,}|[\p{IsKatakana}ー]{2,}"
    r"|[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}&&[\p{L}\p{M}]]{2,}"
    rf"|[\p{{L}}\p{{M}}&&[^{_CLOSE}ー々]]{{3,}}"
)


def naming_tokens(
    text: Column, ignore: list[str] = NAMING_IGNORE, word: str = ASCII_WORD
) -> Column:
    """Lower-case words of three or more letters, in text order, minus ``ignore``.

    A run of letters is a word; anything else separates. The whole text is read.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(word), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(ignore))


def drop_words(tokens: Column, words: list[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(words))


def adjacent_pairs(tokens: Column) -> Column:
    """Every two neighbouring tokens as one two-word term."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), rest),
        F.slice(tokens, F.lit(2), rest),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def terms_1_2(tokens: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words and two-word terms, after the stop words have been taken out."""
    kept = drop_words(tokens, stop_words)
    return F.concat(kept, adjacent_pairs(kept))


def is_doubled(term: Column) -> Column:
    """A two-word term that says one word twice."""
    return F.substring_index(term, " ", 1).eqNullSafe(
        F.substring_index(term, " ", -1)
    ) & term.contains(" ")


def pick_label_terms(ranked: Column) -> Column:
    """The at most two terms that name a group, from its terms best first.

    A term adds nothing when all its words are in a chosen term. It takes the place
    of a chosen term whose words it all has, and otherwise joins the choice.
    """
    empty = F.array().cast("array<string>")

    def words(t: Column) -> Column:
        return F.split(t, " ")

    def covers(big: Column, small: Column) -> Column:
        return F.size(F.array_except(words(small), words(big))) == 0

    def step(chosen: Column, term: Column) -> Column:
        inside = F.exists(chosen, lambda c: covers(c, term))
        outgrown = F.filter(chosen, lambda c: covers(term, c))
        return (
            F.when((F.size(chosen) >= 2) | inside, chosen)
            .when(
                F.size(outgrown) > 0,
                F.transform(
                    chosen, lambda c: F.when(c == F.get(outgrown, F.lit(0)), term).otherwise(c)
                ),
            )
            .otherwise(F.concat(chosen, F.array(term)))
        )

    return F.aggregate(ranked, empty, step)


# A ranked list longer than this cannot change what pick_label_terms returns: the
# first term "a" can be outgrown once, by "a b"; after that only "a", "b" and "b a"
# are passed over before a second choice ends the search.
LABEL_TERMS_NEEDED = 6


def label_from_keywords(keywords: Column) -> Column:
    """Folder label of at most two words; "" for no keywords."""
    empty = F.array().cast("array<string>")
    suffix = r"(?i)(\.(" + "|".join(LABEL_EXTENSIONS) + "))+$"

    def titled(k: Column) -> Column:
        parts = F.filter(F.split(F.trim(k), r"\s+"), lambda p: p != "")
        word = F.array_join(
            F.transform(
                parts,
                lambda p: F.concat(
                    F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p)))
                ),
            ),
            "_",
        )
        return F.regexp_replace(F.regexp_replace(word, suffix, ""), "^[_ ]+|[_ ]+$", "")

    def merge(kept: Column, word: Column) -> Column:
        low = F.lower(word)
        inside = F.exists(kept, lambda e: F.contains(F.lower(e), low))
        shorter = F.filter(kept, lambda e: F.contains(low, F.lower(e)))
        return (
            F.when(inside, kept)
            .when(
                F.size(shorter) > 0,
                F.transform(
                    kept, lambda e: F.when(e == F.get(shorter, F.lit(0)), word).otherwise(e)
                ),
            )
            .otherwise(F.concat(kept, F.array(word)))
        )

    def n_words(word: Column) -> Column:
        return F.size(F.split(word, "_"))

    words = F.filter(F.transform(keywords, titled), lambda w: w != "")
    distinct = F.aggregate(words, empty, merge)
    distinct = F.aggregate(
        distinct,
        empty,
        lambda kept, w: F.when(
            F.exists(kept, lambda e: F.lower(e) == F.lower(w)), kept
        ).otherwise(F.concat(kept, F.array(w))),
    )
    first, second = F.get(distinct, F.lit(0)), F.get(distinct, F.lit(1))
    label = F.when(
        n_words(first) + n_words(second) <= 2, F.concat_ws("_", first, second)
    ).otherwise(F.coalesce(first, F.lit("")))
    label = F.regexp_replace(label, FORBIDDEN_IN_FOLDER_NAME, "")
    label = F.regexp_replace(F.regexp_replace(label, "_+", "_"), "^[_. ]+|[_. ]+$", "")
    return (
        F.when(F.size(keywords) == 0, "")
        .when(label == "", "Folder")
        .otherwise(label)
    )


def drop_parent_words(name: Column, parent_path: Column, split_levels: bool = True) -> Column:
    """``name`` without the words of its parent path, unless nothing would be left.

    ``split_levels=False`` keeps "/" as part of a word, so that of a nested parent
    only words away from a "/" are dropped.
    """
    pattern = "[/_ ]+" if split_levels else "[_ ]+"
    words, parents = F.split(name, "_"), F.split(F.lower(parent_path), pattern)
    left = _words_apart(words, F.split(F.lower(name), "_"), parents)
    return F.when(F.size(left) == 0, name).otherwise(F.array_join(left, "_"))


@F.arrow_udf(ArrayType(StringType()))
def _words_apart(words: pa.Array, lowered: pa.Array, parents: pa.Array) -> pa.Array:
    """Words that are not empty and whose lower-case form is no parent; null if an argument is null.

    A lambda would look through all parents for every word; a set takes one step a word.
    """
    rows = []
    for own, low, above in zip(words.to_pylist(), lowered.to_pylist(), parents.to_pylist()):
        known = None if own is None or above is None else {*above, ""}
        rows.append(None if known is None else [w for w, form in zip(own, low) if form not in known])
    return pa.array(rows, pa.list_(pa.string()))
