"""Sentences cut by what the corpus itself shows of its abbreviations.

A word is an abbreviation where it is found with a period far more often than periods are found at
all, weighed by its length, its inner periods and its uses without one (T. Kiss and J. Strunk,
"Unsupervised multilingual sentence boundary detection", 2006, section 3). Counting is one grouped
sum over all words; cutting looks words up in the two tiers of :mod:`sheafwork.operators.encoding`.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.text import SPACES, strip, words
from sheafwork.operators import encoding
from sheafwork.sources.tables import shared_dir

# The paper's probability of a period after an abbreviation, and its least score.
PERIOD_AFTER_ABBREVIATION = 0.99
LEAST_SCORE = 0.3

EDGES = r"^[^\p{L}0-9]+|[^\p{L}0-9.]+$"
ABBREVIABLE = r"^\p{L}+(\.\p{L}+)*$"
#: A sentence's end at a line's end, and one within a line; a line's end without one.
END_OF_LINE, END_IN_LINE, NEW_LINE = r"([.!?])[ \t\f]*[\r\n][ \t\r\n\f]*", r"([.!?])[ \t\f]+", r"[\r\n]+"
LAST_WORD = r"[^ \t\r\n\f\x01\x02]+$"
_SOFT, _HARD = "\u0001", "\u0002"


def word_type(word: Column) -> Column:
    """Lower case without punctuation at the edges, and without one period at the end."""
    return F.regexp_replace(F.lower(F.regexp_replace(word, EDGES, "")), r"\.$", "")


def period_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(word, n_with, n_without): uses with and without a period; words without a letter or digit are left out.

    Words are counted as they stand first, so that each form is looked at once for each task.
    """
    pieces = F.concat(*[F.coalesce(words(F.col(c), SPACES), F.array().cast("array<string>")) for c in cols])
    forms = df.select(F.explode(pieces).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    dotted = F.regexp_replace("w", EDGES, "").endswith(".").cast("long")
    seen = forms.select(word_type(F.col("w")).alias("word"), dotted.alias("dotted"), "n").where("word <> ''")
    return seen.groupBy("word").agg(F.sum(F.col("n") * F.col("dotted")).alias("n_with"), F.sum(F.col("n") * (1 - F.col("dotted"))).alias("n_without"))


def abbreviations(df: DataFrame, cols: Sequence[str] = ("text",), least_score: float = LEAST_SCORE) -> DataFrame:
    """(word, n_with, n_without, score) of the words that the corpus uses as abbreviations.

    The counts are written once to the shared folder. A corpus without words or periods has none.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/periods-{uuid.uuid4().hex}"
    period_counts(df, cols).write.parquet(path)
    counts = spark.read.schema("word string, n_with bigint, n_without bigint").parquet(path)
    total = counts.agg(F.sum("n_with").alias("with"), F.sum("n_without").alias("without")).first()
    dotted, plain = total["with"] or 0, total["without"] or 0
    share = dotted / max(dotted + plain, 1)
    log_with = math.log(share) if dotted else 0.0
    log_without = math.log(1 - share) if plain else 0.0
    p = PERIOD_AFTER_ABBREVIATION
    ratio = 2 * (F.col("n_with") * (math.log(p) - log_with) + F.col("n_without") * (math.log(1 - p) - log_without))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    periods = F.length("word") - letters + 1
    score = ratio * F.exp(-letters) * periods * F.pow(letters.cast("double"), -F.col("n_without").cast("double"))
    able = F.col("word").rlike(ABBREVIABLE) & (F.lit(dotted) > 0)
    return counts.where(able).withColumn("score", score).where(F.col("score") >= least_score)


def as_codec(table: DataFrame) -> encoding.Codec:
    """The abbreviations in two tiers; numbers only deal them out, so the head keeps its bound for any corpus."""
    number = F.expr(f"pmod(xxhash64(word), {max(table.count(), 1)})")
    return encoding.load_codec(table.select(F.col("word").alias("token"), number.cast("int").alias("id")))


def split_trained(df: DataFrame, known: DataFrame | encoding.Codec, columns: dict[str, str]) -> DataFrame:
    """Add sentence arrays: ``columns`` maps text columns to output columns.

    As :func:`sheafwork.functions.text.split_sentences`, but a period after an abbreviation ends no
    sentence within a line. A null text gives null, an empty one no sentence.
    """
    codec = known if isinstance(known, encoding.Codec) else as_codec(known)
    mark = uuid.uuid4().hex[:8]
    chunks, ends = ({c: f"{kind}{n}_{mark}" for n, c in enumerate(columns)} for kind in ("chunks", "ends"))

    def marked(text: Column) -> Column:
        out = F.regexp_replace(text, END_OF_LINE, "$1" + _HARD)
        out = F.regexp_replace(out, END_IN_LINE, "$1" + _SOFT)
        return F.split(F.regexp_replace(out, NEW_LINE, _HARD), _SOFT)

    def last_type(chunk: Column) -> Column:
        return F.when(chunk.endswith("."), word_type(F.regexp_extract(chunk, LAST_WORD, 0))).otherwise("")

    rows = df.withColumns({chunks[c]: marked(F.col(c)) for c in columns})
    rows = rows.withColumns({ends[c]: F.transform(chunks[c], last_type) for c in columns})
    # Ids are not negative, so -1 says unknown.
    rows = encoding.encode(rows, codec, {ends[c]: f"{ends[c]}_ids" for c in columns}, unk=-1)

    def sentences(c: str) -> Column:
        goes_on = F.transform(f"{ends[c]}_ids", lambda i: F.when(i >= 0, F.lit(" ")).otherwise(_HARD))
        whole = F.array_join(F.zip_with(chunks[c], goes_on, lambda chunk, gap: F.concat(chunk, gap)), "")
        return F.filter(F.split(whole, _HARD), lambda s: strip(s) != "")

    out = rows.withColumns({name: sentences(c) for c, name in columns.items()})
    return out.drop(*chunks.values(), *ends.values(), *[f"{e}_ids" for e in ends.values()])
