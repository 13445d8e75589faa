"""Conversations from samples and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import chat

SAMPLE = ("dataset_source", "creation_date", "model_type_intended", "sample_quality_score", "is_multiturn")


def joined_turns(samples: DataFrame, turns: DataFrame) -> DataFrame:
    """Each turn with its sample's columns; samples without turns and turns without sample vanish."""
    return samples.join(turns, "sample_id")


def collect_conversations(rows: DataFrame, key: str = "sample_id", order: str = "turn_index", role: str = "role", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each conversation: kept columns, its turns in order, and one text for each role.

    One aggregation (one shuffle); all texts come from the same ordered array. User and assistant texts are joined by
    line feeds, of several system texts the last counts. Null contents are left out of joined texts.
    """
    g = rows.groupBy(key).agg(*[F.first(c).alias(c) for c in keep], F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("turns"))
    said = lambda r: F.transform(F.filter("turns", lambda x: x["role"] == r), lambda x: x["content"])
    return g.select(key, *keep, "turns", F.try_element_at(said("system"), F.lit(-1)).alias("system"), F.array_join(said("user"), "\n").alias("user"), F.array_join(said("assistant"), "\n").alias("assistant"))


def rendered(conversations: DataFrame, template: str, key: str = "sample_id", exact: bool = False) -> DataFrame:
    return conversations.select(key, chat.render(template, F.col("system"), F.col("user"), F.col("assistant"), exact).alias("line"))


def turns_of_pairs(pairs: DataFrame) -> DataFrame:
    """Two turns for each (sample_id, question, answer): 0 the user's, 1 the assistant's, which is the label."""
    t = lambda i, r, c, label: F.struct(F.lit(i).alias("turn_index"), F.lit(r).alias("role"), F.col(c).alias("content"), F.lit(label).alias("is_label"))
    return pairs.select("sample_id", F.explode(F.array(t(0, "user", "question", False), t(1, "assistant", "answer", True))).alias("t")).select("sample_id", "t.*", F.lit(None).cast("string").alias("metadata_json"))
