"""Word stems by suffix rules (M. F. Porter, "An algorithm for suffix stripping", Program 14, 1980).

Words are lower case; every letter or digit that is no vowel counts as a consonant. Words of up to
three characters stay as they are, as is usual for ROUGE.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions.lists import ends, flat, regroup

# The paper's suffixes and what takes their place, by step. Of those that fit, the longest holds.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_1B_AFTER = (("at", "ate"), ("bl", "ble"), ("iz", "ize"))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

SHORTEST = 4


class _Kinds(dict):
    def __missing__(self, letter: int) -> str:
        return "c"


_KINDS = _Kinds(dict.fromkeys(map(ord, "aeiou"), "v"))


def letter_kinds(word: str) -> str:
    """``v`` for a vowel, or a y after a consonant; ``c`` for all else."""
    if "y" not in word:
        return word.translate(_KINDS)
    kinds = ""
    for letter in word:
        kinds += "v" if letter in "aeiou" or (letter == "y" and kinds.endswith("c")) else "c"
    return kinds


def _measure(kinds: str) -> int:
    """How often consonants follow vowels."""
    return kinds.count("vc")


def _short_end(word: str, kinds: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return kinds.endswith("cvc") and word[-1] not in "wxy"


def _double(word: str, kinds: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and kinds[-1] == "c"


def _by_length(rules):
    """Longest first, by the suffix's last letter."""
    found: dict[str, list[tuple[str, str]]] = {}
    for rule in sorted(rules, key=lambda rule: -len(rule[0])):
        found.setdefault(rule[0][-1], []).append(rule)
    return found


def _replaced(word: str, rules, least: int) -> str:
    """The longest suffix that fits, replaced if what is before it measures more than ``least``."""
    for suffix, new in rules.get(word[-1:], ()):
        if word.endswith(suffix):
            before = word[: -len(suffix)]
            enough = _measure(letter_kinds(before)) > least and (suffix != "ion" or before[-1] in "st")
            return before + new if enough else word
    return word


_1A, _2, _3 = map(_by_length, (STEP_1A, STEP_2, STEP_3))
_4 = _by_length([(suffix, "") for suffix in STEP_4])


def _past_and_progressive(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(letter_kinds(word[:-3])) > 0 else word
    for suffix in ("ed", "ing"):
        if not word.endswith(suffix):
            continue
        before = word[: -len(suffix)]
        kinds = letter_kinds(before)
        if "v" in kinds:
            for end, new in STEP_1B_AFTER:
                if before.endswith(end):
                    return before[: -len(end)] + new
            if _double(before, kinds) and before[-1] not in "lsz":
                return before[:-1]
            return before + "e" if _measure(kinds) == 1 and _short_end(before, kinds) else before
    return word


def _last_letters(word: str) -> str:
    if word.endswith("e"):
        before = word[:-1]
        kinds = letter_kinds(before)
        if _measure(kinds) > 1 or (_measure(kinds) == 1 and not _short_end(before, kinds)):
            word = before
    return word[:-1] if word.endswith("ll") and _measure(letter_kinds(word)) > 1 else word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) < SHORTEST:
        return word
    word = _replaced(word, _1A, -1)
    word = _past_and_progressive(word)
    if word.endswith("y") and "v" in letter_kinds(word[:-1]):
        word = word[:-1] + "i"
    return _last_letters(_replaced(_replaced(_replaced(word, _2, 0), _3, 0), _4, 1))


def _stemmed(words: pa.Array) -> pa.Array:
    """Every different word of the batch is walked once."""
    coded = words.dictionary_encode()
    return pa.array(map(stem, coded.dictionary.to_pylist()), pa.string()).take(coded.indices)


@F.arrow_udf(T.StringType())
def stem_word(words: pa.Array) -> pa.Array:
    return _stemmed(words)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(rows: pa.Array) -> pa.Array:
    """Of token lists; a null list stays null."""
    return regroup(_stemmed(flat(rows)), ends(rows), rows.is_null() if rows.null_count else None)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def stem_sentences(rows: pa.Array) -> pa.Array:
    """Of lists of sentences, each a token list."""
    sentences = flat(rows)
    stemmed = regroup(_stemmed(flat(sentences)), ends(sentences))
    return regroup(stemmed, ends(rows), rows.is_null() if rows.null_count else None)
