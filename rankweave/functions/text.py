"""Text analysis as Spark columns.

``simple`` splits on anything that is not a letter or a digit and stays in the
JVM.  ``english`` folds accents, keeps runs of a-z, drops stop words and stems;
only the stemming leaves the JVM, as an Arrow batch per call.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIMPLE_TOKEN = r"[\p{L}\p{N}]+"
ENGLISH_TOKEN = r"[a-z]+"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, and the bare letter of each."""
    marked, bare = [], []
    for point in range(0xC0, 0x250):
        char = chr(point)
        base = unicodedata.normalize("NFD", char)[0]
        if char.islower() and base != char and base.isascii():
            marked.append(char)
            bare.append(base)
    return "".join(marked), "".join(bare)


def fold_accents(col: Column) -> Column:
    marked, bare = _accent_table()
    return F.translate(F.lower(col), marked, bare)


def default_stop_words() -> list[str]:
    """Spark ML's English list, without the contractions no token can equal."""
    from pyspark.ml.feature import StopWordsRemover

    return [w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalpha()]


@lru_cache(maxsize=200_000)
def porter_stem(word: str) -> str:
    """Porter (1980): five passes of suffix rules, guarded by the measure."""
    if len(word) <= 2:
        return word
    for one_pass in (_plural, _past, _terminal_y, _long_suffix, _short_suffix, _residual, _tidy):
        word = one_pass(word)
    return word


def _shape(stem: str) -> str:
    """The stem as a string of c and v; y is a vowel after a consonant."""
    out = ""
    for i, char in enumerate(stem):
        vowel = char in "aeiou" or (char == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double_consonant(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _swap(word: str, rules: dict[str, str], least: int) -> str:
    """Apply the longest matching suffix, if what is left is long enough."""
    for size in range(min(7, len(word)), 0, -1):
        ending = word[-size:]
        if ending in rules:
            stem = word[:-size]
            return stem + rules[ending] if _measure(stem) >= least else word
    return word


# The suffix rules of the published algorithm.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
LONG_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
SHORT_SUFFIXES = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
RESIDUAL_SUFFIXES = {
    "al": "", "ance": "", "ence": "", "er": "", "ic": "", "able": "", "ible": "",
    "ant": "", "ement": "", "ment": "", "ent": "", "ou": "", "ism": "", "ate": "",
    "iti": "", "ous": "", "ive": "", "ize": "",
}


def _plural(word: str) -> str:
    return _swap(word, PLURALS, 0)


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        stem = word.removesuffix(ending)
        if stem != word:
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return word


def _terminal_y(word: str) -> str:
    return word[:-1] + "i" if word.endswith("y") and "v" in _shape(word[:-1]) else word


def _long_suffix(word: str) -> str:
    return _swap(word, LONG_SUFFIXES, 1)


def _short_suffix(word: str) -> str:
    return _swap(word, SHORT_SUFFIXES, 1)


def _residual(word: str) -> str:
    if word.endswith("ion"):
        return word[:-3] if word[-4:-3] in ("s", "t") and _measure(word[:-3]) > 1 else word
    return _swap(word, RESIDUAL_SUFFIXES, 2)


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_all(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda row: None if row is None else [porter_stem(t) for t in row])


def tokenize(col: Column | str, analyzer: str = "simple", stop_words: Sequence[str] | None = None) -> Column:
    """Array of tokens, in text order, repeats kept; null text gives no tokens."""
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    if analyzer == "simple":
        return F.regexp_extract_all(F.lower(text), F.lit(SIMPLE_TOKEN), F.lit(0))
    if analyzer == "english":
        drop = list(default_stop_words() if stop_words is None else stop_words)
        words = F.regexp_extract_all(fold_accents(text), F.lit(ENGLISH_TOKEN), F.lit(0))
        return _stem_all(F.filter(words, lambda w: ~w.isin(drop)) if drop else words)
    raise ValueError(f"unknown analyzer: {analyzer!r}")


def query_terms(queries: DataFrame, analyzer: str = "simple", stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(query_id, term, qtf)``: each query as a bag of terms."""
    return (
        queries.select("query_id", F.explode(tokenize("query", analyzer, stop_words)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )
