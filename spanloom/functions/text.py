"""Text rules: tokens, anchors, phonetic keys, pause classes and similarity.

What SQL can say is a column expression. Unicode folding, spoken numbers and
Ratcliff/Obershelp similarity have no builtin and are Arrow-batched UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- spoken numbers --------------------------------------------------------------------

#: English number words.
EN_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Russian number words.
RU_SMALL = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
RU_TENS = "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU_HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()


def _below_hundred(n: int, small: list[str], tens: list[str]) -> list[str]:
    if n < 20:
        return [small[n]]
    return [tens[n // 10 - 2], *([small[n % 10]] if n % 10 else [])]


def _ru_below_thousand(n: int, female: bool = False) -> list[str]:
    out = [RU_HUNDREDS[n // 100 - 1]] if n >= 100 else []
    if n % 100 or not n:
        out += _below_hundred(n % 100, RU_SMALL, RU_TENS)
    if female:
        out[-1] = {"один": "одна", "два": "две"}.get(out[-1], out[-1])
    return out


def spoken_integer(n: int, language: str = "en") -> list[str]:
    """Cardinal of a number under a million; a larger one stays a literal."""
    if n < 0:
        return [{"en": "minus", "ru": "минус"}[language], *spoken_integer(-n, language)]
    if n >= 1_000_000:
        return [str(n)]
    high, low = divmod(n, 1000)
    if language == "ru":
        if not high:
            return _ru_below_thousand(low)
        tail = high % 10 if not 11 <= high % 100 <= 14 else 0
        noun = "тысяча" if tail == 1 else "тысячи" if 2 <= tail <= 4 else "тысяч"
        return [*_ru_below_thousand(high, True), noun, *(_ru_below_thousand(low) if low else [])]
    out = [*spoken_integer(high), "thousand"] if high else []
    if low >= 100:
        out += [EN_SMALL[low // 100], "hundred"]
    if low % 100 or not n:
        out += _below_hundred(low % 100, EN_SMALL, EN_TENS)
    return out


def spoken_number(token: str, language: str = "en") -> list[str]:
    """Words of a numeral; the digits after a point are spoken one by one."""
    whole, point, digits = token.partition(".")
    small, name = (RU_SMALL, "точка") if language == "ru" else (EN_SMALL, "point")
    return spoken_integer(int(whole or 0), language) + ([name, *(small[int(d)] for d in digits)] if point else [])


# --- tokens ----------------------------------------------------------------------------

#: Contractions written without their apostrophe, and what they stand for.
BARE_CONTRACTIONS = {
    "arent": "are not", "cant": "can not", "couldnt": "could not", "didnt": "did not", "doesnt": "does not", "dont": "do not", "hasnt": "has not",
    "havent": "have not", "isnt": "is not", "shouldnt": "should not", "wasnt": "was not", "werent": "were not", "wont": "will not", "wouldnt": "would not",
}
#: Contractions with an apostrophe.
CONTRACTIONS = {
    "aren't": "are not", "can't": "can not", "couldn't": "could not", "didn't": "did not", "doesn't": "does not", "don't": "do not", "hasn't": "has not",
    "haven't": "have not", "i'd": "i would", "i'll": "i will", "i'm": "i am", "i've": "i have", "isn't": "is not", "it's": "it is", "let's": "let us",
    "that's": "that is", "they're": "they are", "they've": "they have", "wasn't": "was not", "we'd": "we would", "we'll": "we will", "we're": "we are",
    "we've": "we have", "weren't": "were not", "what's": "what is", "won't": "will not", "wouldn't": "would not", "you're": "you are", "you've": "you have",
}
PERCENT = {"en": "percent", "ru": "процент"}
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+(?:'[^\W\d_]+)?")


def fold(text: str, language: str = "en") -> str:
    """Case and width folded; English also loses its accents, Russian keeps ё and й."""
    if language == "ru":
        return unicodedata.normalize("NFKC", text).casefold()
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))


def stem(token: str) -> str:
    """A light English stem of plain lower-case words over four letters; the first suffix that fits decides."""
    if len(token) < 5 or not re.fullmatch("[a-z]+", token):
        return token
    for suffix, least, put in (("ies", 6, "y"), ("ing", 7, ""), ("ed", 6, "")):
        if token.endswith(suffix) and len(token) >= least:
            return token[: -len(suffix)] + put
    return token[:-1] if re.search("(?<![isu])s$", token) else token


def tokens(text: str, aliases: dict[str, list[str]] | None = None, language: str = "en") -> list[str]:
    """Spoken tokens of a text: folded, contractions, aliases and numbers expanded, English stemmed."""
    if language not in PERCENT:
        raise ValueError(f"no token rules for language {language!r}")
    plain = fold(text, language).translate({0x2019: "'", 0x2013: "-", 0x2014: "-"}).replace("%", f" {PERCENT[language]} ")
    out: list[str] = []
    for found in _TOKEN.findall(plain):
        bare = found.replace("'", "")
        if language == "en" and found in CONTRACTIONS:
            parts = CONTRACTIONS[found].split()
        elif aliases and bare in aliases:
            parts = aliases[bare]
        elif language == "en" and bare in BARE_CONTRACTIONS:
            parts = BARE_CONTRACTIONS[bare].split()
        else:
            parts = spoken_number(bare, language) if bare[0].isdigit() else [bare]
        out += [stem("one" if p == "once" else p) if language == "en" else p for p in parts if p]
    return out


def tokens_udf(language: str = "en", aliases: dict[str, list[str]] | None = None):
    """Arrow UDF text -> array<string>; a null text has no tokens."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: tokens(t or "", aliases, language))

    return run


def ascii_words(text: Column) -> Column:
    """Lower-case ASCII words and numerals: the SQL twin of ``tokens`` without folding, expansion or stems."""
    return F.regexp_extract_all(F.lower(F.translate(text, "’", "'")), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)?"), 0)


def stem_column(token: Column) -> Column:
    """The SQL twin of ``stem``."""
    n = F.length(token)
    ends = lambda s: token.endswith(s)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    plain = token.rlike("^[a-z]+$") & (n > 4)
    return F.when(~plain, token).when(ends("ies") & (n > 5), F.concat(cut(3), F.lit("y"))).when(ends("ing") & (n > 6), cut(3)).when(ends("ed") & (n > 5), cut(2)).when(ends("s") & ~token.rlike("(is|ss|us)$"), cut(1)).otherwise(token)


def anchor(text: Column) -> Column:
    """Letters and digits of an ASCII text, lower-case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def anchors_match(actual: Column, expected: Column) -> Column:
    """Equal letters and digits, or, where neither has any, equal literal signs."""
    a, b = anchor(actual), anchor(expected)
    x, y = F.trim(F.lower(actual)), F.trim(F.lower(expected))
    return F.when((a != "") | (b != ""), (a != "") & (a == b)).otherwise((x != "") & (x == y))


def phonetic_key(text: Column) -> Column:
    """Consonant skeleton: ph f, ck k, qu k, x ks; the first letter stays, later vowels go, repeats collapse."""
    x = F.regexp_replace(text, r"[^\p{L}]", "")
    for a, b in (("ph", "f"), ("ck", "k"), ("qu", "k"), ("x", "ks")):
        x = F.replace(x, F.lit(a), F.lit(b))
    tail = F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), "[aeiouy]", "")
    return F.regexp_replace(F.concat(F.substring(x, F.lit(1), F.lit(1)), tail), r"(.)\1+", "$1")


def phonetic(text: str) -> str:
    """Python twin of ``phonetic_key``."""
    x = "".join(c for c in text if c.isalpha())
    for a, b in (("ph", "f"), ("ck", "k"), ("qu", "k"), ("x", "ks")):
        x = x.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", x[:1] + re.sub("[aeiouy]", "", x[1:]))


# --- labels and classes -------------------------------------------------------------------

#: Labels of silence in an aligner's output. ``spn`` is not one of them.
SILENCE = ["", "<eps>", "sil", "silence", "sp"]


def is_silence(label: Column) -> Column:
    """Whether a phone label means silence, also after its last ``_suffix`` is taken off."""
    x = F.lower(F.trim(label))
    return x.isin(SILENCE) | F.regexp_replace(x, "_[^_]*$", "").isin(SILENCE)


#: Openings that connect a sentence closely to the one before.
CONNECTIVES = ["also", "and", "as a result", "because", "but", "consequently", "for example", "however", "in other words", "instead", "meanwhile", "moreover", "nevertheless", "next", "or", "otherwise", "similarly", "so", "then", "therefore", "thus", "which", "yet"]
#: Openings of a new section.
_COUNT = r"([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)"
SECTION = rf"^(chapter|section|part)\s+{_COUNT}\b|^(in\s+)?the\s+next\s+(chapter|section|part)\b|^(now\s+)?(let('s|\s+us)\s+)?(move|turn)\s+(on|to)\b|^(moving|turning)\s+(on|to)\b"
OPENING, CLOSING = "[\\s\"'“”‘’(\\[{]+", "[\\s\"'“”‘’\\])}]+"
CONNECTED = "^(" + "|".join(re.sub(" ", r"\\s+", c) for c in CONNECTIVES) + r")([\s,]|$)"


def pause_type(previous: Column, following: Column) -> Column:
    """struct(pause_type, rule) of the transition between two thoughts; the first rule that holds decides."""
    after = F.lower(F.regexp_replace(following, "^" + OPENING, ""))
    before = F.regexp_replace(previous, CLOSING + "$", "")
    pair = lambda kind, rule: F.struct(F.lit(kind).alias("pause_type"), F.lit(rule).alias("rule"))
    return (
        F.when(after.rlike(SECTION), pair("section", "explicit_section_cue"))
        .when(before.rlike(r"(\.\.\.|…)$"), pair("continuation", "previous_ellipsis"))
        .when(before.rlike("[,:—–-]$"), pair("continuation", "previous_continuation_punctuation"))
        .when(~before.rlike("[.?!;]$"), pair("continuation", "previous_has_no_terminal_punctuation"))
        .when(before.rlike(";$"), pair("short", "previous_semicolon"))
        .when(after.rlike(CONNECTED), pair("short", "next_thought_connective"))
        .otherwise(pair("thought", "complete_sentence_default"))
    )


#: Language profiles.
PROFILES = {"en": "English", "ru": "Russian"}


def language_code(code: str) -> str:
    """The profile's key of a language code; an unknown one is an error."""
    key = code.strip().casefold()
    if key not in PROFILES:
        raise ValueError(f"unsupported language {code!r}")
    return key


def media_kind(path: Column) -> Column:
    """audio or video by a path's extension; null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("wav", "flac", "mp3", "m4a", "aac", "ogg", "opus", "aiff", "aif", "wma"), "audio").when(ext.isin("mp4", "mov", "m4v", "mkv", "webm", "avi"), "video")


def redacted_url(url: Column) -> Column:
    """An endpoint without user, query and fragment, and without a trailing slash."""
    host, path = F.parse_url(url, F.lit("HOST")), F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    port = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    return F.concat(F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(host), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path)


def last_json_object(text: str | None) -> str | None:
    """The last complete JSON object of a text that may hold other words before it."""
    import json

    out, decoder, at = None, json.JSONDecoder(), (text or "").find("{")
    while text and at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            out = json.dumps(value, ensure_ascii=False)
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    return out


def last_json_object_udf():
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(last_json_object)

    return run


# --- similarity ------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity."""
    return SequenceMatcher(None, a, b).ratio()


def spelled(text: str) -> list[str]:
    return re.findall("[a-z0-9]+(?:'[a-z0-9]+)?", text.lower().replace("’", "'"))


def fuzzy_score(expected: str, observed: str) -> float:
    """1 if equal, 0 if either has three letters or fewer, else their similarity."""
    a, b = "".join(spelled(expected)), "".join(spelled(observed))
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.0 if min(len(a), len(b)) <= 3 else ratio(a, b)


def fuzzy_accepted(expected: str, observed: str, score: float) -> bool:
    short = min(len(expected), len(observed))
    return score >= 1 or short >= 4 and score >= (0.75 if short == 4 else 0.68)


def group_similarity(canonical: list[str], source: list[str], language: str = "en") -> float | None:
    """Similarity of two short token groups spoken alike; null if they are not."""
    a, b = "".join(canonical), "".join(source)
    if not a or not b:
        return None
    if a == b:
        return 1.0
    if language == "ru":
        return 0.99 if a.replace("ё", "е") == b.replace("ё", "е") else None
    if a[0] != b[0]:
        return None
    plain = ratio(a, b)
    if plain >= 0.78:
        return plain
    x, y = phonetic(a), phonetic(b)
    alike = min(len(a), len(b)) >= 3 and x and y and ratio(x, y) >= 0.80
    return max(0.70, plain) if alike else None


def fuzzy_score_udf():
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fuzzy_score(x or "", y or "") for x, y in zip(a, b)])

    return run


def group_similarity_udf(language: str = "en"):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([group_similarity([*x], [*y], language) for x, y in zip(a, b)], dtype="float64")

    return run
