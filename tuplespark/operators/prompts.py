"""Prompt construction (PRJ-8, PRJ-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplespark import constants as K

MSG = "array<struct<role:string,content:string>>"


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(df: DataFrame, sentence: str = "s", shots: str = "none",
                   out: str = "messages") -> DataFrame:
    """PRJ-8: system turn, then (user, assistant) worked examples, then the
    user turn with the sentence (R4). ``shots``: ``none``, ``train``, ``test``."""
    examples = {"none": [], "train": K.FEW_SHOT_TRAIN, "test": K.FEW_SHOT_TEST}[shots]
    fixed = [_msg("system", F.lit(K.SYSTEM_INSTRUCTION))]
    for s, o in examples:
        fixed += [_msg("user", F.lit(K.USER_PREFIX + s)), _msg("assistant", F.lit(o))]
    user = _msg("user", F.concat(F.lit(K.USER_PREFIX), F.col(sentence)))
    return df.withColumn(out, F.array(*fixed, user))


def default_template(role: Column, content: Column) -> Column:
    """A plain chat layout (the subword model's own template is external)."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), content, F.lit("\n"))


def render_messages(messages: Column, template=default_template,
                    suffix: str = K.GENERATION_SUFFIX,
                    generation_header: str = "<|assistant|>\n") -> Column:
    """PRJ-9 on an in-row message array: turns in order, then the generation
    header and the suffix ``1. `` (the first item number is in the prompt)."""
    body = F.array_join(F.transform(messages, lambda m: template(m["role"], m["content"])), "")
    return F.concat(body, F.lit(generation_header + suffix))


def render_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", template=default_template,
                suffix: str = K.GENERATION_SUFFIX) -> DataFrame:
    """PRJ-9 over a turn table: one prompt per conversation, turns in order."""
    grouped = df.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"),
                                             F.col(text).alias("content")))).alias("__turns"),
        F.count(F.lit(1)).alias("n_turns"))
    return grouped.select(conv, F.col("n_turns").cast("bigint").alias("n_turns"),
                          render_messages(F.col("__turns"), template, suffix).alias("prompt"))
