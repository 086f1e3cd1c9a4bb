"""Feature tables: causal-LM, seq2seq, classification and multiple choice.

With a vocabulary of checked size a builder has no shuffle: every row is filtered,
tokenized, looked up, cut and padded where it was read. Tokens that truncation would
drop are cut before the lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import arrays
from sheafwork.functions.text import ColumnFn, choice_prompt, titled_prompt, words, wrap_prompt
from sheafwork.operators import choices, encoding, filters
from sheafwork.operators.encoding import Codec
from sheafwork.sources.catalog import TASK_LABELS, check_task

ID = "example_id"


def build_clm_table(
    df: DataFrame,
    vocab: DataFrame | Codec,
    max_input: int = 7296,
    max_target: int = 768,
    prefix: str = "",
    suffix: str = " TL;DR ",
    tokenizer: ColumnFn = words,
    side: str = "left",
    mask_pad: bool = False,
    mask_prompt: bool = False,
) -> DataFrame:
    """Title, text and suffix, then summary, as one row of ``max_input + max_target`` ids.

    The input part is cut and padded to ``max_input`` less the suffix, which follows the
    pads. Labels copy the ids; the two options turn pads or the whole prompt into ignored
    labels.
    """
    prompt = titled_prompt(F.col("title"), F.col("text"), F.lit(prefix))
    # the suffix tokens are a folded constant; encoding them with the row needs no extra job
    suffix_tokens = tokenizer(F.lit(suffix))
    room = F.lit(max_input) - F.size(suffix_tokens)
    cut = filters.drop_incomplete_pairs(df).select(
        ID,
        F.slice(tokenizer(prompt), F.lit(1), room).alias("input_tokens"),
        suffix_tokens.alias("suffix_tokens"),
        arrays.truncate(tokenizer(F.col("summary")), max_target).alias("target_tokens"),
    )
    parts = {"input_tokens": "input_part", "suffix_tokens": "suffix_part", "target_tokens": "target_part"}
    encoded = encoding.encode(cut, vocab, parts)
    source, suffix_ids, target = F.col("input_part"), F.col("suffix_part"), F.col("target_part")
    source_mask = arrays.extend_mask(arrays.attention_mask(F.size(source), room, side), F.size(suffix_ids))
    padded = arrays.append_suffix(arrays.pad_to(source, room, encoding.PAD, side), suffix_ids)
    joined = encoded.select(
        ID,
        arrays.join_sequences(padded, arrays.pad_to(target, max_target, encoding.PAD)).alias("input_ids"),
        arrays.join_sequences(source_mask, arrays.attention_mask(F.size(target), max_target)).alias("attention_mask"),
    )
    labels, mask = F.col("input_ids"), F.col("attention_mask")
    if mask_prompt:
        # only the target's labels are left to mask
        labels, mask = F.slice(labels, max_input + 1, max_target), F.slice(mask, max_input + 1, max_target)
    if mask_pad:
        labels = arrays.mask_labels_by_mask(labels, mask)
    if mask_prompt:
        labels = F.concat(F.array_repeat(F.lit(arrays.IGNORE), max_input), labels)
    return joined.withColumn("labels", labels)


def build_seq2seq_table(
    df: DataFrame,
    vocab: DataFrame | Codec,
    prefix: str = "",
    suffix: str = " TL;DR ",
    tokenizer: ColumnFn = words,
    batch: str | None = None,
    multiple: int = 128,
    mask_by: str = "value",
) -> DataFrame:
    """Untruncated prompt and summary; with ``batch`` both sides are padded to its longest.

    Label pads become ignored ids, by ``value`` as a rule, or by ``mask`` so that a real
    id equal to the pad id stays.
    """
    if mask_by not in ("value", "mask"):
        raise ValueError(f"mask_by must be 'value' or 'mask', not {mask_by!r}")
    keep = [ID] if batch is None else [ID, batch]
    tokens = filters.drop_incomplete_pairs(df).select(
        *keep,
        tokenizer(wrap_prompt(F.col("text"), F.lit(prefix), F.lit(suffix))).alias("input_tokens"),
        tokenizer(F.col("summary")).alias("target_tokens"),
    )
    encoded = encoding.encode(tokens, vocab, {"input_tokens": "input_ids", "target_tokens": "labels"})
    out = encoded.select(*keep, "input_ids", "labels")
    if batch is None:
        out = out.withColumn("attention_mask", arrays.repeat(1, F.size("input_ids")))
        label_mask = arrays.repeat(1, F.size("labels"))
    else:
        out = encoding.pad_to_longest(out, encoding.PAD, batch, "labels", multiple)
        out = out.withColumnsRenamed({"attention_mask": "__label_mask"}).drop("padded_length")
        out = encoding.pad_to_longest(out, encoding.PAD, batch, "input_ids", multiple).drop("padded_length")
        label_mask = F.col("__label_mask")
    if mask_by == "value":
        masked = arrays.mask_pad_labels(F.col("labels"), encoding.PAD)
    else:
        masked = arrays.mask_labels_by_mask(F.col("labels"), label_mask)
    return out.select(*keep, "input_ids", "attention_mask", masked.alias("labels"))


def build_classification_table(
    df: DataFrame, vocab: DataFrame | Codec, task: str, max_len: int = 512, tokenizer: ColumnFn = words
) -> DataFrame:
    """begin text end, cut and padded to ``max_len``, with a class id or a dense vector."""
    kind = check_task(task)
    if kind == "multiple_choice_qa":
        df = df.withColumn("text", choice_prompt(F.col("context"), F.col("endings")))
    if kind == "multi_label":
        df = filters.rename_labels(df)
        label = arrays.multi_hot(F.col("targets"), len(TASK_LABELS[task])).alias("labels")
        keep = "targets"
    else:
        label, keep = F.col("label"), "label"
    cut = df.select(ID, keep, arrays.truncate(tokenizer(F.col("text")), max_len, specials=2).alias("tokens"))
    ids = arrays.add_special_tokens(F.col("ids"), encoding.BOS, encoding.EOS)
    encoded = encoding.encode(cut, vocab, {"tokens": "ids"}).select(ID, keep, ids.alias("ids"))
    return encoded.select(
        ID,
        arrays.pad_to(F.col("ids"), max_len, encoding.PAD).alias("input_ids"),
        arrays.attention_mask(F.size("ids"), max_len).alias("attention_mask"),
        label,
    )


def build_multiple_choice_table(
    df: DataFrame, vocab: DataFrame | Codec, max_len: int = 512, tokenizer: ColumnFn = words, seps: int = 1
) -> DataFrame:
    """Nested features per example, arrays in choice order.

    The choices stay inside their row: all endings are looked up as one array and cut
    apart again, so nothing is exploded and regrouped.
    """
    # no side can keep more than the whole budget, so longer tails need no lookup
    budget = max_len - 2 - seps
    tokens = df.select(
        ID,
        "label",
        tokenizer(F.col("context")).alias("context_tokens"),
        F.transform("endings", lambda e: tokenizer(e)).alias("ending_tokens"),
    ).withColumns(
        {
            "context_tokens": F.slice("context_tokens", 1, budget),
            "ending_tokens": F.transform("ending_tokens", lambda e: F.slice(e, 1, budget)),
        }
    )
    sized = tokens.withColumns(
        {"sizes": F.transform("ending_tokens", F.size), "all_tokens": F.flatten("ending_tokens")}
    )
    encoded = encoding.encode(sized, vocab, {"context_tokens": "context_ids", "all_tokens": "all_ids"})
    starts = F.transform(
        "sizes", lambda n, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, x: a + x)
    )
    cuts = F.zip_with(
        starts,
        "sizes",
        lambda at, n: F.struct(at.alias("at"), arrays.pair_cuts(F.col("n_context"), n, budget).alias("keep")),
    )
    placed = encoded.withColumn("n_context", F.size("context_ids")).select(
        ID, "label", "context_ids", "all_ids", cuts.alias("cuts")
    )

    def pair(cut: Column) -> Column:
        a, b = cut["keep"]["a"], cut["keep"]["b"]
        context, ending = F.slice("context_ids", F.lit(1), a), F.slice("all_ids", cut["at"] + 1, b)
        return choices.pair_features(context, ending, a, b, max_len, seps)

    features = F.transform("cuts", pair)
    return placed.select(ID, features.alias("choices"), "label").select(
        ID, *[F.col("choices")[f].alias(f) for f in choices.FEATURES], "label"
    )


def build_features(df: DataFrame, vocab: DataFrame | Codec, task: str, max_len: int = 512) -> DataFrame:
    """The feature table that the task's example type calls for."""
    kind = check_task(task, summarization=True)
    if kind == "summarization":
        return build_seq2seq_table(df, vocab)
    if kind == "multiple_choice_qa":
        return build_multiple_choice_table(df, vocab, max_len)
    return build_classification_table(df, vocab, task, max_len)
