"""String expressions: prompts, tokenizers, ROUGE normalisation, sentence split.

A tokenizer or normalizer is any ``Column -> Column`` callable, so a custom one
stays inside the JVM plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnFn = Callable[[Column], Column]

# Prompt pieces per model family, and the clues that select one.
T5_CLUES = ("t5", "ul2", "t0", "bart")
T5_PREFIX, T5_SUFFIX = "summarize: ", "\n"
GPT_PREFIX, GPT_SUFFIX = "", " TL;DR "
CHOICE_HEADER = "Context: "
CHOICE_QUESTION = "\n\nWhich of the following follow from the context?\n"

# Only ASCII classes, written out, so that every regex engine reads them alike.
SPACES = "[ \\t\\r\\n\\f]+"
SPACE_CHARS = " \t\r\n\f"
SENTENCE_END = "([.!?])[ \\t\\r\\n\\f]+"
_MARK = "\u0001"


def words(text: Column, pattern: str = SPACES) -> Column:
    """Split on a separator pattern and drop the empty pieces."""
    return F.filter(F.split(text, pattern), lambda t: t != "")


def prompt_style(name: Column, case_sensitive: bool = True) -> Column:
    """struct(style, prefix, suffix) chosen by a substring test on a tokenizer name."""
    probe = name if case_sensitive else F.lower(name)
    t5 = F.lit(False)
    for clue in T5_CLUES:
        t5 = t5 | probe.contains(clue)

    def row(style: str, prefix: str, suffix: str) -> Column:
        return F.struct(F.lit(style).alias("style"), F.lit(prefix).alias("prefix"), F.lit(suffix).alias("suffix"))

    return (
        F.when(probe.contains("mt5"), row("mt5", "", ""))
        .when(t5, row("t5", T5_PREFIX, T5_SUFFIX))
        .otherwise(row("gpt", GPT_PREFIX, GPT_SUFFIX))
    )


def wrap_prompt(text: Column, prefix: Column, suffix: Column) -> Column:
    return F.concat(prefix, text, suffix)


def titled_prompt(title: Column, text: Column, prefix: Column) -> Column:
    """Prefix, title and text joined by single spaces; a null title counts as empty."""
    return F.concat(prefix, F.lit(" "), F.coalesce(title, F.lit("")), F.lit(" "), text)


def choice_prompt(context: Column, endings: Column) -> Column:
    numbered = F.transform(endings, lambda e, i: F.concat(i.cast("string"), F.lit(": "), e, F.lit("\n")))
    return F.concat(F.lit(CHOICE_HEADER), context, F.lit(CHOICE_QUESTION), F.array_join(numbered, ""))


def rouge_normalize(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")


def rouge_tokens(text: Column, normalizer: ColumnFn | None = None, tokenizer: ColumnFn | None = None) -> Column:
    """Normalise, then tokenize; either half can be swapped for another expression."""
    clean = (normalizer or rouge_normalize)(text)
    if tokenizer is not None:
        return F.filter(tokenizer(clean), lambda t: t != "")
    return F.filter(F.split(clean, " "), lambda t: t != "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def clean_decoded(text: Column) -> Column:
    """Undo the spaces that joining tokens puts before punctuation and contractions."""
    out = F.regexp_replace(text, " ([.?!,])", "$1")
    out = F.replace(out, F.lit(" ' "), F.lit("'"))
    out = F.regexp_replace(out, " (n't|'m|'s|'ve|'re)", "$1")
    return strip(out)


def split_sentences(text: Column) -> Column:
    """Cut after ``. ! ?`` followed by space, and at line ends; drop blank pieces."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + _MARK)
    marked = F.regexp_replace(marked, "[\\r\\n]+", _MARK)
    return F.filter(F.split(marked, _MARK), lambda s: strip(s) != "")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    return F.substr(text, F.length(first_line(text)) + F.lit(2))
