"""English word stemming (Porter, 1980) for the search index.

``stem`` handles one word; ``stem_tokens`` is the Arrow-batched function over arrays of tokens.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these functions with the task and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The suffix rules of the published algorithm, in the order they are tried.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"),
         ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
         ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
         ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
         "iti", "ous", "ive", "ize"]

_VOWEL = "(?:[aeiou]|(?<=[^aeiou])y)"
_CONSONANT = "(?:[^aeiouy]|(?<=[aeiou])y|^y)"
_MEASURE = re.compile(f"{_VOWEL}+{_CONSONANT}+")
_HAS_VOWEL = re.compile(_VOWEL)
_CVC = re.compile(f"{_CONSONANT}{_VOWEL}(?![wxy]){_CONSONANT}$")
_DOUBLE = re.compile(r"([^aeiou])\1$")


def _measure(part: str) -> int:
    return len(_MEASURE.findall(part))


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    """Apply the rule of the longest suffix that fits, if something with a vowel and a consonant is left."""
    fits = [r for r in rules if word.endswith(r[0])]
    if not fits:
        return word
    suffix, new = max(fits, key=lambda r: len(r[0]))
    part = word[: len(word) - len(suffix)]
    return part + new if _measure(part) > 0 else word


def stem(word: str) -> str:
    if len(word) < 3 or len(word.encode()) > 64:
        return word
    # Plurals and past forms.
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            part = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and _HAS_VOWEL.search(part):
                word = part
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _DOUBLE.search(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _CVC.search(word):
                    word += "e"
                break
    if word.endswith("y") and _HAS_VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    # Longer suffixes.
    word = _swap(_swap(word, STEP2), STEP3)
    fits = [s for s in STEP4 if word.endswith(s)]
    if fits:
        suffix = max(fits, key=len)
        part = word[: len(word) - len(suffix)]
        if _measure(part) > 1 and (suffix != "ion" or part.endswith(("s", "t"))):
            word = part
    # A final e and a double l.
    if word.endswith("e"):
        part = word[:-1]
        if _measure(part) > 1 or (_measure(part) == 1 and not _CVC.search(part)):
            word = part
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Each distinct word of a batch is stemmed once; the words themselves stay in Arrow's buffers."""
    words = pc.dictionary_encode(tokens.flatten())
    stems = pa.array([None if w is None else stem(w) for w in words.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), stems.take(words.indices), mask=tokens.is_null())
