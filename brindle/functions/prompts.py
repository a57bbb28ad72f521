"""Prompts, contexts and records put together from columns; limits on what comes in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer_key(docs: Column, most: int = 6, width: int = 350) -> Column:
    """The first documents (structs of doc_id and content) as lines of a reference, contents cut."""
    return F.array_join(F.transform(F.slice(docs, 1, most), lambda d: F.concat(F.lit("- "), d["doc_id"], F.lit(": "), F.substring(d["content"], 1, width))), "\n")


def grounded_prompt(persona: str, question: Column, context: Column) -> Column:
    """The persona, the context if there is one, and the question."""
    block = F.when(F.coalesce(F.trim(context), F.lit("")) != "", F.concat(F.lit("\n\nContext:\n"), context)).otherwise("")
    return F.concat(F.lit(persona), block, F.lit("\n\nQuestion: "), question)


def judge_prompt(question: Column, answer: Column, reference: Column, scale: tuple[str, ...]) -> Column:
    """Asks for JSON with a number from 0 to 1 for each name of the scale, and a verdict."""
    keys = ", ".join(f'"{k}": 0..1' for k in scale)
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer, F.lit("\nReference: "), F.coalesce(reference, F.lit("(none)")), F.lit('\nReply with JSON: {"scores": {' + keys + '}, "verdict": "pass" or "fail"}'))


def limited(text: Column, most: int) -> Column:
    """Cut to a length, without angle brackets."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), "[<>]", ""), 1, most)


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def specification_record(file: Column, title: Column, context: str, category: str) -> Column:
    """struct<doc_id, title, keywords> of an API specification: the file's stem names it."""
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    return F.struct(F.concat_ws(":", F.lit(context), stem).alias("doc_id"), F.concat_ws(" - ", stem, title).alias("title"), F.to_json(F.array(F.lit(context), F.lit(category), stem)).alias("keywords"))
