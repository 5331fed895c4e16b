import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kinshelf import Settings
from kinshelf.functions import paths
from kinshelf.functions.text import (
    drop_parent_words,
    label_from_keywords,
    naming_tokens,
    pick_label_terms,
    terms_1_2,
)
from kinshelf.functions.vectors import cosine_similarity


def column(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "keywords, label",
    [
        (["machine", "learning", "AI"], "Machine_Learning"),
        ([], ""),
        (["deep learning", "learning"], "Deep_Learning"),
        (["learning", "deep learning"], "Deep_Learning"),
        (["notes.txt"], "Notes"),
        (["a:b"], "Ab"),
        (["solar system mars"], "Solar_System_Mars"),
        (["???"], "Folder"),
        (["one", "two three"], "One"),
    ],
)
def test_labels(spark, keywords, label):
    assert column(spark, keywords, "array<string>", label_from_keywords) == label


@pytest.mark.parametrize(
    "ranked, chosen",
    [
        (["deep", "deep sea", "sea", "sea deep", "whale"], ["deep sea", "whale"]),
        (["red car", "car", "blue"], ["red car", "blue"]),
        (["one", "two", "two three"], ["one", "two"]),
        ([], []),
    ],
)
def test_pick_label_terms(spark, ranked, chosen):
    assert column(spark, ranked, "array<string>", pick_label_terms) == chosen


@pytest.mark.parametrize(
    "name, parent, left, split",
    [
        ("Learning_Rate", "Machine_Learning", "Rate", True),
        ("Machine_Learning", "Machine_Learning", "Machine_Learning", True),
        ("Rate_Cake", "Machine/Rate", "Cake", True),
        ("Rate_Cake", "Machine/Rate", "Rate_Cake", False),
    ],
)
def test_parent_words(spark, name, parent, left, split):
    made = column(spark, name, "string", lambda c: drop_parent_words(c, F.lit(parent), split))
    assert made == left


def test_parent_words_of_very_long_names(spark):
    words = [f"W{i}" for i in range(100_000)]
    made = column(spark, "_".join(words), "string", lambda c: drop_parent_words(c, F.lit("/".join(words[::2]))))
    assert made == "_".join(words[1::2])
    assert column(spark, None, "string", lambda c: drop_parent_words(c, F.lit("a"))) is None


@pytest.mark.parametrize(
    "path, ok",
    [(f"f.{e}", True) for e in ("pdf", "txt", "md", "rst", "log", "TXT")]
    + [(f"f.{e}", False) for e in ("jpg", "png", "exe", "zip", "docx", "xlsx", "py")]
    + [("txt", False), (".txt", False), ("dir.txt/file", False)],
)
def test_supported(spark, path, ok):
    assert column(spark, path, "string", paths.is_supported) is ok


def test_paths(spark):
    assert column(spark, "a/b/c.tar.gz", "string", lambda c: paths.name_stem(paths.file_name(c))) == "c.tar"
    assert column(spark, "a/b/c.txt", "string", paths.parent_folder) == "a/b"
    assert column(spark, "c.txt", "string", paths.parent_folder) == ""
    assert column(spark, "..a<b>/c .", "string", paths.clean_folder_name) == "ab c".replace(" ", "", 1)
    assert column(spark, "A:/. /B", "string", paths.clean_folder_path) == "A/Uncategorized/B"
    assert column(spark, "x/node_modules/y.txt", "string", paths.is_excluded) is True
    assert column(spark, "x/envy/y.txt", "string", paths.is_excluded) is False


def test_tokens_read_the_whole_text(spark):
    text = "The new über-Report of Cats\n" + "ab " * 5000 + "zebra"
    assert column(spark, text, "string", naming_tokens) == ["the", "ber", "cats", "zebra"]
    assert column(spark, text, "string", lambda c: terms_1_2(naming_tokens(c))) == [
        "ber", "cats", "zebra", "ber cats", "cats zebra",
    ]
    assert column(spark, None, "string", naming_tokens) == []


floats = st.lists(st.floats(-100, 100, width=32), min_size=4, max_size=4)


@settings(max_examples=15, deadline=None)
@given(a=floats, b=floats)
def test_cosine_is_symmetric(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(
        cosine_similarity(F.col("a"), F.col("b")).alias("ab"),
        cosine_similarity(F.col("b"), F.col("a")).alias("ba"),
        cosine_similarity(F.col("a"), F.col("a")).alias("aa"),
    ).first()
    assert row.ab == pytest.approx(row.ba)
    assert row.aa == pytest.approx(1.0) or row.aa == 0.0
    assert -1.000001 <= row.ab <= 1.000001


def test_settings():
    assert [round(Settings().threshold_at(d), 2) for d in range(5)] == [0.55, 0.65, 0.75, 0.85, 0.9]
    assert Settings().absorb_threshold_at(0) == pytest.approx(0.45)
    assert Settings().loose_threshold_at(0) == pytest.approx(0.40)
    with pytest.raises(ValueError):
        Settings(similarity_threshold=1.5)
