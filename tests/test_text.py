"""Text rules with values worked out by hand."""

import pytest
from spanloom.functions import text as X
from spanloom.operators import sequences as S


def test_tokens():
    assert X.tokens("I'm going, don't stop 42%") == ["i", "am", "going", "do", "not", "stop", "forty", "two", "percent"]
    assert X.tokens("Café naïve studies walked classes") == ["cafe", "naive", "study", "walk", "classe"]
    assert X.tokens("once 3.14 1,000") == ["one", "three", "point", "one", "four", "one", "zero"]
    assert X.tokens("it’s cant", {"cant": ["slope"]}) == ["it", "is", "slope"]
    assert X.tokens("Ёлка 21%", language="ru") == ["ёлка", "двадцать", "один", "процент"]
    with pytest.raises(ValueError):
        X.tokens("x", language="fr")


def test_numbers():
    assert X.spoken_integer(0) == ["zero"] and X.spoken_integer(115) == ["one", "hundred", "fifteen"]
    assert X.spoken_integer(-42) == ["minus", "forty", "two"] and X.spoken_integer(1_000_000) == ["1000000"]
    assert X.spoken_integer(900_010) == ["nine", "hundred", "thousand", "ten"]
    assert X.spoken_integer(21_000, "ru") == ["двадцать", "одна", "тысяча"] and X.spoken_integer(12_000, "ru") == ["двенадцать", "тысяч"]
    assert X.spoken_integer(2_305, "ru") == ["две", "тысячи", "триста", "пять"]


def test_stem_and_phonetic():
    assert [X.stem(w) for w in ("parties", "ties", "singing", "sing", "wanted", "red", "boxes", "this", "glass", "focus")] == ["party", "ties", "sing", "sing", "want", "red", "boxe", "this", "glass", "focus"]
    assert X.phonetic("phonetic") == "fntc" and X.phonetic("quick") == "kk"[:1] and X.phonetic("") == ""


def test_similarity():
    assert X.group_similarity(["to", "day"], ["today"]) == 1.0
    assert X.group_similarity(["ёж"], ["еж"], "ru") == 0.99 and X.group_similarity(["дом"], ["том"], "ru") is None
    assert X.group_similarity(["cat"], ["dog"]) is None
    assert X.fuzzy_score("the", "thy") == 0.0 and X.fuzzy_score("Hello!", "hello") == 1.0
    assert not X.fuzzy_accepted("abcd", "abxy", 0.7) and X.fuzzy_accepted("abcde", "abxde", 0.7)


def test_alignment():
    assert S.align_words(["a", "big", "house"], ["a", "big", "a", "big", "house"]) == [(0, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0)]
    assert S.align_words([], ["a"]) == []
    assert S.ground(["hello", "world"], ["hello", "bdfgbdfg", "world"]) == [(0, 1, 0, 1, 1.0), (1, 2, 2, 3, 1.0)]
    assert S.ground(["hello"], ["uh", "hello"]) is None and S.unsupported(["hello", "moon"], ["hello", "world"]) == "moon"
    long = [f"word{i}" for i in range(1500)]
    assert len(S.ground(long[:60], long[:60])) == 60


def test_insertions_and_relabel():
    w = lambda text, s: [{"word": x, "score": 0.9, "start": s + i, "end": s + i + 0.5} for i, x in enumerate(text.split())]
    heard = w("we will start the proj the project today", 0)
    found = S.insertions("we will start the project today".split(), heard)
    assert all(x["confidence"] >= 0.78 for x in found)
    out = S.relabel("alpha bravo charlie".split(), w("alpha xxxx charlie", 0))
    assert [x["word"] for x in out] == ["alpha", "bravo", "charlie"] and out[1]["source"] == "gap"


def test_json_and_language():
    assert X.last_json_object('thinking {"a": 1} then {"b": {"c": 2}} end') == '{"b": {"c": 2}}'
    assert X.last_json_object("{ no") is None and X.last_json_object(None) is None
    assert X.language_code(" EN ") == "en"
    with pytest.raises(ValueError):
        X.language_code("xx")


def test_columns_agree_with_python(spark):
    from pyspark.sql import functions as F

    words = ["parties", "singing", "wanted", "this", "boxes", "glass", "phonetic", "quick", "xylophone", "bookkeeper", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", X.stem_column(F.col("w")).alias("s"), X.phonetic_key(F.col("w")).alias("p")).collect():
        assert (r.s, r.p) == (X.stem(r.w), X.phonetic(r.w))


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [("Done.", "Chapter two begins", "section"), ("Well...", "yes", "continuation"), ("First,", "second", "continuation"), ("no end", "x", "continuation"), ("Half;", "x", "short"), ("Done.", "“However, no", "short"), ("Done.”", "A new one", "thought"), ("Done.", "Android phones", "thought")],
)
def test_pause_rules(spark, before, after, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(before, after)], "a string, b string")
    assert df.select(X.pause_type(F.col("a"), F.col("b")).alias("p")).first().p.pause_type == want
