"""Chat templates, records and streamed replies, as expressions over (system, user, assistant) texts."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import strip
from gristmill.settings import DEFAULT_SYSTEM, TEMPLATES


def _given(system: Column) -> Column:
    return F.coalesce(system, F.lit("")) != ""


def llama3(system: Column, user: Column, assistant: Column) -> Column:
    # The template's marks.
    head = lambda role: F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n")
    end = F.lit("<|eot_id|>")
    return F.concat(F.lit("<|begin_of_text|>"), head("system"), F.when(_given(system), system).otherwise(DEFAULT_SYSTEM), end, head("user"), user, end, head("assistant"), assistant, end)


def mistral(system: Column, user: Column, assistant: Column) -> Column:
    return F.concat(F.lit("<s>[INST] "), F.when(_given(system), F.concat(system, F.lit("\n\n"))).otherwise(""), user, F.lit(" [/INST]"), assistant, F.lit("</s>"))


def gemma(system: Column, user: Column, assistant: Column) -> Column:
    """The system text has no place in it."""
    turn = lambda role, x: F.concat(F.lit(f"<start_of_turn>{role}\n"), x, F.lit("<end_of_turn>"))
    return F.concat(turn("user", user), turn("model", assistant))


def qwen(system: Column, user: Column, assistant: Column) -> Column:
    """Kept with its doubled start mark (fixed value)."""
    return F.concat(F.lit("<|im_start|><|im_start|>user\n"), user, F.lit("<|im_end|><|im_start|>assistant\n"), assistant, F.lit("<|im_end|>"))


def alpaca(system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(user.alias("instruction"), F.lit("").alias("input"), assistant.alias("output"))


def messages(system: Column, user: Column, assistant: Column) -> Column:
    m = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    return F.struct(F.filter(F.array(m("system", F.coalesce(system, F.lit(""))), m("user", user), m("assistant", assistant)), lambda x: (x["role"] != "system") | (x["content"] != "")).alias("messages"))


def csv_field(x: Column) -> Column:
    """Quoted only where needed, quotes doubled."""
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_line(*fields: Column) -> Column:
    return F.concat_ws(",", *[csv_field(F.coalesce(x, F.lit(""))) for x in fields])


@F.pandas_udf(T.StringType())
def spaced_json(compact: pd.Series) -> pd.Series:
    """Compact JSON as Python's json module spells it: spaces after separators, \\uXXXX in lower case."""
    return compact.map(lambda x: None if x is None else json.dumps(json.loads(x)))


_TEXT: dict[str, Callable[[Column, Column, Column], Column]] = {"llama3": llama3, "mistral": mistral, "gemma": gemma}
_JSON = {"alpaca-jsonl": alpaca, "chatml-jsonl": messages}


def render(template: str, system: Column, user: Column, assistant: Column, exact: bool = False) -> Column:
    """One string for each conversation; ``exact`` spells JSON byte for byte as Python does (an Arrow UDF)."""
    if template == "csv":
        return csv_line(user, assistant)
    if template in _TEXT:
        return _TEXT[template](system, user, assistant)
    if template in _JSON:
        compact = F.to_json(_JSON[template](system, user, assistant), {"ignoreNullFields": "false"})
        return spaced_json(compact) if exact else compact
    raise ValueError(f"unknown template {template!r}; known: {', '.join(TEMPLATES)}")


def sse_text(stream: Column) -> Column:
    """The text of a streamed reply (an array of lines): contents of the first choice's deltas in order; null if blank."""
    data = F.transform(F.filter(stream, lambda x: x.startswith("data: ")), lambda x: strip(F.substring(x, 7, 1 << 30)))
    parts = F.transform(F.filter(data, lambda x: (x != "") & (x != "[DONE]")), lambda x: F.get_json_object(x, "$.choices[0].delta.content"))
    return F.nullif(strip(F.array_join(parts, "")), F.lit(""))


def model_ids(body: Column) -> Column:
    return F.transform(F.from_json(body, "struct<data:array<struct<id:string>>>")["data"], lambda x: x["id"])


def plain_prompt(chat: Column) -> Column:
    """A chat as text for models without a template of their own."""
    return F.array_join(F.transform(chat, lambda x: F.concat(F.initcap(x["role"]), F.lit(": "), x["content"])), "\n\n")
