"""Scalar expressions of the pipeline, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CHECK_PROMPT, SERVICE_MODEL, TITLE_PROMPT


def missing_to_null(col: Column, sentinels: tuple[str, ...]) -> Column:
    return F.when(col.isin(*sentinels), None).otherwise(col)


def decodable(col: Column) -> Column:
    """Text from bytes of which some aren't UTF-8, as a string column holds them: those bytes go, and all characters
    stay, replacement characters that were there before too. They wait under a noncharacter meanwhile, which is
    escaped itself."""
    mark, gone = F.lit("\ufdd0"), F.lit("\ufffd")
    waiting = F.replace(F.replace(col, mark, F.lit("\ufdd0a")), gone, F.lit("\ufdd0b"))
    bare = F.replace(F.make_valid_utf8(waiting), gone, F.lit(""))
    return F.replace(F.replace(bare, F.lit("\ufdd0b"), gone), F.lit("\ufdd0a"), mark)


def month_key(date: Column) -> Column:
    return F.left(date, F.lit(7))


def extract_code(answer: Column) -> Column:
    """The first dd-dddd of an answer, or null."""
    return F.nullif(F.regexp_extract(answer, r"([0-9]{2}-[0-9]{4})", 1), F.lit(""))


def broad_code(code: Column) -> Column:
    """The broad occupation of a detailed code: its last character made 0."""
    return F.when(F.length(code) > 0, F.concat(F.left(code, F.length(code) - 1), F.lit("0"))).otherwise(code)


def without_dots(answer: Column) -> Column:
    return F.replace(answer, F.lit("."), F.lit(""))


def without_dashes(code: Column) -> Column:
    return F.replace(code, F.lit("-"), F.lit(""))


def truthy(col: Column) -> Column:
    """Null and empty are false, anything else is true."""
    return F.coalesce(col != "", F.lit(False))


def sample_weight(checked: Column, yes: float, no: float) -> Column:
    return F.when(checked, F.lit(yes)).otherwise(F.lit(no))


def as_text(col: Column) -> Column:
    """Text as it is read by the models: a missing one is the word nan."""
    return F.coalesce(col.cast("string"), F.lit("nan"))


def feature_text(title: Column, description: Column, repeats: int) -> Column:
    return F.concat(F.repeat(F.concat(as_text(title), F.lit(" ")), repeats), as_text(description))


def title_prompt(title: Column) -> Column:
    return F.format_string(TITLE_PROMPT, title)


def check_prompt(description: Column, code: Column) -> Column:
    return F.format_string(CHECK_PROMPT, description, code)


def request_body(prompt: Column, model: str = SERVICE_MODEL) -> Column:
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message).alias("messages")))


def answer_of(response: Column) -> Column:
    return F.get_json_object(response, "$.choices[0].message.content")


def error_of(response: Column) -> Column:
    return F.get_json_object(response, "$.error.message")


def argmax(scores: Column) -> Column:
    """The index of the largest score, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)) - 1


def hash_order(seed: int, *ids: Column) -> list[Column]:
    """An order that looks random and is the same whatever the partitions."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), *[F.coalesce(i.cast("string"), F.lit("")) for i in ids]).cast("binary")), *ids]
