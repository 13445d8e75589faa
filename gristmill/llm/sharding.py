"""Sharding by sampled splitters.

Records are ordered by a key (60 bits of their text's MD5, so that equal texts are neighbours) and then doc_id. A sample
of keys, drawn by weight (size, plus the mean size for the row itself), gives quantiles; these are the boundaries of
ranges, ``RANGES`` for each shard or more. Keys that the sample shows to be heavy are ranges of their own. Weights of
ranges are then summed exactly, and overfull ranges are subdivided at the sampled keys within them, or by doc_id where
they are one key, as often as that cuts something.

Shards are unions of ranges. The ranges of a group of equal texts stay together unless it outweighs a shard; groups of
over ``HEAVY`` of a shard go first, each to the least laden shard; the other ranges fill up the shards in order of keys.
So shards differ from equal sizes by one range (under 4 / ``RANGES`` of a shard, or a single text).

Law: bytes. Nulls: a null text counts as empty (size 1); null doc_ids go first within their text. An empty table gives no
rows. Repeated rows get slots of their own; copies that share a doc_id too are never cut. Extra columns are ignored. Only
ids, keys and sizes are shuffled, never texts, however long. The driver holds the sample and a row for each range: they
grow with the shards, and with the rows over ``ROWS_PER_RANGE``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gristmill.llm.common import durable

#: Ranges for each shard at least, rows that a range should have at most, and sampled keys for each range.
RANGES, ROWS_PER_RANGE, OVERSAMPLE = 128, 500_000, 16
#: Part of a shard from which a group of equal texts is placed by itself.
HEAVY = 1 / 64
LOW = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """What is sharded; rows without a doc_id are told apart by numbers below."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW) + F.monotonically_increasing_id()).alias("rank_id"),
        F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long").alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
    )


def locate(cuts: np.ndarray):
    """A function (key, id) -> number of cuts at or before it; ``cuts`` has a row (key, id) for each, sorted."""
    cut_keys, cut_ids = cuts[:, 0].copy(), cuts[:, 1].copy()

    def find(key: np.ndarray, rid: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(cut_keys, key, "left"), np.searchsorted(cut_keys, key, "right")
        for k in np.unique(cut_keys[lo[hi > lo]]):
            at = key == k
            a, b = np.searchsorted(cut_keys, k, "left"), np.searchsorted(cut_keys, k, "right")
            hi[at] = a + np.searchsorted(cut_ids[a:b], rid[at], "right")
        return hi

    return find


def ranged(d: DataFrame, cuts: np.ndarray) -> DataFrame:
    """``d`` with the range of each row; the cuts go along with the function."""
    find = locate(cuts)

    @F.pandas_udf(T.LongType())
    def of(key: pd.Series, rid: pd.Series) -> pd.Series:
        return pd.Series(find(key.to_numpy(np.int64), rid.to_numpy(np.int64)))

    return d.withColumn("range", of("key", "rank_id"))


def splitters(drawn: pd.DataFrame, n_ranges: int) -> set[tuple[int, int]]:
    """Quantiles of the sampled keys, and both ends of keys with the samples of half a range."""
    keys = drawn["key"].to_numpy(np.int64)
    if not len(keys):
        return set()
    cuts = set(keys[np.linspace(0, len(keys) - 1, n_ranges + 1)[1:-1].astype(int)].tolist())
    often, n = np.unique(keys, return_counts=True)
    cuts |= {x for k in often[2 * n * n_ranges >= len(keys)].tolist() for x in (k, k + 1)}
    return {(k, LOW) for k in cuts}


def subdivided(cuts: set[tuple[int, int]], sums: pd.DataFrame, drawn: pd.DataFrame, most: float) -> set[tuple[int, int]]:
    """More cuts within ranges of over ``most``: at sampled keys, or at sampled ids where there is one key."""
    points = np.array(sorted(cuts), np.int64).reshape(-1, 2)
    at = locate(points)(drawn["key"].to_numpy(np.int64), drawn["rank_id"].to_numpy(np.int64))
    more = set(cuts)
    for r in sums[sums["weight"] > most].itertuples():
        inside = drawn[at == r.range]
        step = max(1, int(len(inside) * most / (2 * r.weight)))
        if r.low != r.high:
            more |= {(x, LOW) for k in inside["key"].tolist()[::step] for x in (k, k + 1)}
        else:
            more |= {(int(r.low), x) for x in inside["rank_id"].tolist()[::step]}
    return more


def shards_of(sums: pd.DataFrame, n_shards: int) -> np.ndarray:
    """The shard of each range (rows by range, with bytes ``b`` and keys ``low`` to ``high``)."""
    size, low, one = sums["b"].to_numpy(np.int64), sums["low"].to_numpy(), (sums["low"] == sums["high"]).to_numpy()
    quota, load = size.sum() / n_shards, np.zeros(n_shards)
    # Units: ranges of one key together, if that fits a shard.
    again = np.concatenate([[False], one[1:] & one[:-1] & (low[1:] == low[:-1])])[: len(size)]
    whole = np.bincount(np.cumsum(~again) - 1, size)[np.cumsum(~again) - 1]
    unit = np.cumsum(~again | (whole > quota)) - 1
    size, single = np.bincount(unit, size), (one & (whole <= quota))[np.unique(unit, return_index=True)[1]]
    shard = np.full(len(size), -1)
    for i in np.argsort(-size, kind="stable").tolist():
        if single[i] and size[i] > HEAVY * quota:
            shard[i] = load.argmin()
            load[shard[i]] += size[i]
    rest, room = np.flatnonzero(shard < 0), np.maximum(quota - load, 0)
    if len(rest):
        ends = np.cumsum(room) * (size[rest].sum() / max(room.sum(), 1e-9))
        shard[rest] = np.minimum(np.searchsorted(ends, np.cumsum(size[rest]) - size[rest] / 2, "right"), n_shards - 1)
    return shard[unit]


def assign(docs: DataFrame, n_shards: int = 16, ranges: int = RANGES, rows_per_range: int = ROWS_PER_RANGE, oversample: int = OVERSAMPLE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each record."""
    spark = docs.sparkSession
    d = durable(keyed(docs))
    rows, total = d.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(ranges * n_shards, -(-rows // rows_per_range))
    # A record is drawn with a chance of its weight's share of the samples; hashes decide, so a rerun task draws the same.
    mean = total / max(rows, 1)
    luck = F.shiftrightunsigned(F.xxhash64("key", "rank_id"), 1) / float(1 << 63)
    drawn = d.where(luck < (F.col("size") + mean) * (n_ranges * oversample / max(2 * total, 1))).select("key", "rank_id").toPandas().sort_values(["key", "rank_id"])
    cuts, most = splitters(drawn, n_ranges), 4 * total / n_ranges
    while True:
        r = ranged(d, np.array(sorted(cuts), np.int64).reshape(-1, 2))
        sums = r.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).toPandas().sort_values("range", ignore_index=True)
        sums["weight"] = sums["b"] + mean * sums["n"]
        more = subdivided(cuts, sums, drawn, most)
        if more == cuts:
            break
        cuts = more
    # Slots: what earlier ranges put into the shard, then the place within the range.
    sums["shard"] = shards_of(sums, n_shards)
    sums["base"] = sums.groupby("shard")["n"].cumsum() - sums["n"]
    base = spark.createDataFrame([tuple(map(int, x)) for x in sums[["range", "shard", "base"]].itertuples(index=False)], "range long, shard int, base long")
    place = F.row_number().over(W.partitionBy("range").orderBy("key", "rank_id", "size", "text_crc32"))
    return r.withColumn("place", place).join(F.broadcast(base), "range").select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place") - 1).alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    a = assign(docs)
    return a.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
