"""English stemming (Snowball, "Porter 2") as Spark expressions.

A word is a struct of its text and where its two regions begin. Every step is an expression over
the result of the step before it, bound by a one-element ``transform``, so nothing is worked out
twice. It is meant for distinct words (:func:`stemmed`), not for every row of a table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published word lists and suffix rules of the algorithm.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
LONG_PREFIXES = "gener|commun|arsen"
DERIVED_ENDINGS = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
FURTHER_ENDINGS = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
LAST_ENDINGS = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
]
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT_SYLLABLE = f"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _ending(word: Column, endings) -> Column:
    """The longest of the endings that the word has, else the empty text."""
    return F.regexp_extract(word, f"(?:{'|'.join(endings)})$", 0)


def _without(word: Column, ending: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(ending))


def _starts_by(word: Column, ending: Column, region: Column) -> Column:
    """Whether the ending lies in the region that begins at (0-based) ``region``."""
    return F.length(word) - F.length(ending) >= region


def _replaced(word: Column, ending: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(text) for pair in table.items() for text in pair])
    return F.concat(_without(word, ending), F.element_at(pairs, ending))


def _plurals(word: Column) -> Column:
    return (
        F.when(word.endswith("sses"), _without(word, F.lit("es")))
        .when(word.rlike("ie[ds]$"), F.concat(_without(word, F.lit("ied")), F.when(F.length(word) > 4, "i").otherwise("ie")))
        .when(word.rlike("(?:us|ss)$"), word)
        .when(word.rlike(f"{VOWEL}.+s$"), _without(word, F.lit("s")))
        .otherwise(word)
    )


def _past_and_participle(word: Column, r1: Column) -> Column:
    def cut(ending: Column) -> Column:
        def mended(rest: Column) -> Column:
            return (
                F.when(rest.rlike("(?:at|bl|iz)$"), F.concat(rest, F.lit("e")))
                .when(rest.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(rest, F.lit("x")))
                .when(rest.rlike(SHORT_SYLLABLE) & (F.length(rest) <= r1), F.concat(rest, F.lit("e")))
                .otherwise(rest)
            )

        rest = _without(word, ending)
        return (
            F.when(ending == "", word)
            .when(ending.isin("eed", "eedly"), F.when(_starts_by(word, ending, r1), F.concat(rest, F.lit("ee"))).otherwise(word))
            .when(rest.rlike(VOWEL), _let(rest, mended))
            .otherwise(word)
        )

    return _let(_ending(word, ["eedly", "eed", "ingly", "edly", "ing", "ed"]), cut)


def _derived(word: Column, r1: Column) -> Column:
    def cut(ending: Column) -> Column:
        fits = (
            F.when(ending == "li", word.rlike("[cdeghkmnrt]li$"))
            .when(ending == "ogi", word.endswith("logi"))
            .otherwise(ending != "")
        )
        return F.when(fits & _starts_by(word, ending, r1), _replaced(word, ending, DERIVED_ENDINGS)).otherwise(word)

    return _let(_ending(word, DERIVED_ENDINGS), cut)


def _further(word: Column, r1: Column, r2: Column) -> Column:
    def cut(ending: Column) -> Column:
        fits = (ending != "") & _starts_by(word, ending, r1) & ((ending != "ative") | _starts_by(word, ending, r2))
        return F.when(fits, _replaced(word, ending, FURTHER_ENDINGS)).otherwise(word)

    return _let(_ending(word, FURTHER_ENDINGS), cut)


def _last(word: Column, r2: Column) -> Column:
    def cut(ending: Column) -> Column:
        fits = (ending != "") & _starts_by(word, ending, r2) & ((ending != "ion") | word.rlike("[st]ion$"))
        return F.when(fits, _without(word, ending)).otherwise(word)

    return _let(_ending(word, LAST_ENDINGS), cut)


def _final_letter(word: Column, r1: Column, r2: Column) -> Column:
    rest, letter = _without(word, F.lit("e")), F.lit("e")
    silent = _starts_by(word, letter, r2) | (_starts_by(word, letter, r1) & ~rest.rlike(SHORT_SYLLABLE))
    return (
        F.when(word.endswith("e"), F.when(silent, rest).otherwise(word))
        .when(word.endswith("ll") & _starts_by(word, F.lit("l"), r2), rest)
        .otherwise(word)
    )


def english_stem(word: Column) -> Column:
    """The stem of one lower-case word; words of one or two characters stay."""
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")
    region = f"^.*?{VOWEL}{OTHER}"
    prefix = lambda text, pattern: F.length(F.regexp_extract(text, pattern, 0))

    def regions(text: Column) -> Column:
        first = F.when(text.rlike(f"^(?:{LONG_PREFIXES})"), prefix(text, f"^(?:{LONG_PREFIXES})")).otherwise(prefix(text, region))
        return F.struct(text.alias("text"), F.when(first > 0, first).otherwise(F.length(text)).alias("r1"))

    def both(parts: Column) -> Column:
        second = prefix(F.substring(parts["text"], parts["r1"] + 1, F.length(parts["text"])), region)
        r2 = F.when(second > 0, parts["r1"] + second).otherwise(F.length(parts["text"]))
        return F.struct(parts["text"].alias("text"), parts["r1"].alias("r1"), r2.alias("r2"))

    def steps(parts: Column) -> Column:
        r1, r2 = parts["r1"], parts["r2"]
        later: list[Callable[[Column], Column]] = [
            lambda text: _past_and_participle(text, r1),
            lambda text: F.when(text.rlike(f".{OTHER}[yY]$"), F.concat(_without(text, F.lit("y")), F.lit("i"))).otherwise(text),
            lambda text: _derived(text, r1),
            lambda text: _further(text, r1, r2),
            lambda text: _last(text, r2),
            lambda text: _final_letter(text, r1, r2),
        ]
        rest = lambda text: reduce(_let, later, text)
        return _let(_plurals(parts["text"]), lambda text: F.when(text.isin(KEPT_AFTER_PLURALS), text).otherwise(rest(text)))

    whole = F.create_map(*[F.lit(text) for pair in WHOLE_WORDS.items() for text in pair])
    stem = F.translate(_let(_let(_let(marked, regions), both), steps), "Y", "y")
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(F.try_element_at(whole, word), stem))


def stemmed(rows: DataFrame, text: str, tokens: Callable[[Column], Column], column: str) -> DataFrame:
    """``rows`` with the sorted distinct stems of the words of their ``text``.

    ``tokens`` splits a text into words. Every distinct text is split once and every distinct
    word is stemmed once; the stems are joined back by text. A null text has null stems.
    """
    kept = [name for name in rows.columns if name != column]
    texts = rows.select(F.col(text).alias("text to stem")).filter("`text to stem` IS NOT NULL").distinct()
    words = texts.select("text to stem", F.explode(tokens(F.col("text to stem"))).alias("word"))
    stems = words.select("word").distinct().select("word", english_stem(F.col("word")).alias("stem"))
    found = words.join(stems, "word").groupBy("text to stem").agg(F.sort_array(F.collect_set("stem")).alias("stems"))
    joined = rows.select(*kept).join(found, F.col(text) == F.col("text to stem"), "left")
    none = F.when(F.col(text).isNotNull(), F.array().cast("array<string>"))
    return joined.select(*kept, F.coalesce("stems", none).alias(column))
