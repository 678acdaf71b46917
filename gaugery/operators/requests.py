"""Requests: messages of a chat, their length, options of generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(prompt: Column, shots: Column | None = None) -> Column:
    """Messages of a request: exemplars, an array of (prompt, target), as turns of user and assistant, then the prompt."""
    last = F.array(message("user", prompt))
    if shots is None:
        return last
    turns = F.transform(shots, lambda s: F.array(message("user", s["prompt"]), message("assistant", s["target"])))
    return F.concat(F.flatten(F.coalesce(turns, F.array().cast("array<array<struct<role:string,content:string>>>"))), last)


def generation(prompt: Column | None = None, messages: Column | None = None, stops: tuple[str, ...] = (), max_new_tokens: int = 256, do_sample: bool = False, temperature: float = 0.0) -> Column:
    """A generation request with either a prompt or messages."""
    if (prompt is None) == (messages is None):
        raise ValueError("a request has a prompt or messages")
    none = F.lit(None)
    return F.struct(
        (none.cast("string") if prompt is None else prompt).alias("prompt"),
        (none.cast("array<struct<role:string,content:string>>") if messages is None else messages).alias("messages"),
        (F.array(*map(F.lit, stops)) if stops else F.array().cast("array<string>")).alias("stop"),
        F.lit(max_new_tokens).alias("max_new_tokens"), F.lit(1).alias("num_beams"), F.lit(do_sample).alias("do_sample"), F.lit(temperature).alias("temperature"),
    )


def length(input_ids: Column | None = None, rendered: Column | None = None, prompt: Column | None = None, messages: Column | None = None) -> Column:
    """By which requests are ordered: the first of ids, rendered prompt, prompt and messages that a row has."""
    told = F.aggregate(messages, F.lit(0), lambda s, m: s + F.length(F.coalesce(m["role"], F.lit(""))) + F.length(F.coalesce(m["content"], F.lit("")))) if messages is not None else None
    sizes = [F.when(input_ids.isNotNull(), F.size(input_ids)) if input_ids is not None else None, F.length(rendered) if rendered is not None else None, F.length(prompt) if prompt is not None else None, told]
    return F.coalesce(*[s for s in sizes if s is not None], F.lit(0))


def choices_length(prompt: Column, continuations: Column) -> Column:
    return F.length(prompt) + F.aggregate(continuations, F.lit(0), lambda s, c: s + F.length(c))
