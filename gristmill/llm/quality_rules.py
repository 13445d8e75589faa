"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each (language, source) gets mergeable quantile sketches of a few measures. A sketch is a histogram over log-linear
integer bins (64 exact bins, then 32 per octave: values are known to about 3 %); merging is adding counts, so a hot
source is pre-aggregated in each task, and the outcome depends neither on partitioning nor on order. A document fails
when a measure lies beyond its group's upper fence ``q75 + max(slack, spread * (q75 - q25))``, or, for the length of words,
under the lower one ``q25 - max(slack, spread * (q75 - q25))``. Groups of fewer than ``min_group`` documents take the fences
of the merged sketches of their language, and then of all.

Nulls: a null text has no words (base_failed); null languages and sources are groups of their own; a null doc_id is
returned as it is. Empty table: no rows. Repeated rows are measured and returned each. Extra columns pass through
``rule_filter`` untouched, whatever their names: a row's own columns are packed into one. Texts are measured whole, one row
at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gristmill.llm.common import durable, join_small, let, packed

#: Measure -> least distance of the fence from q75 (per mille of the characters in words, of lines, of words; tenths of a
#: character), and from q25 for those with a lower fence.
SLACK = {"m_symbols": 60, "m_upper": 120, "m_exclaim": 60, "m_length": 25, "m_dup_lines": 250, "m_repeats": 200}
LOW = {"m_length": 15}
SPREAD = 5
MIN_GROUP = 50
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more: sort the windows, keep those with an equal neighbour, add up what they cover."""
    windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    twice = lambda s: F.filter(s, lambda x, k: F.coalesce(x["g"] == F.get(s, k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, k + 1)["g"], F.lit(False)))
    covered = F.aggregate(
        let(F.sort_array(windows), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return F.when(F.size(w) >= 4, covered).otherwise(0)


def lines_of(text: Column) -> Column:
    """The lines with a word: how many, and how many of them equal an earlier one."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))


def measures(text: Column) -> Column:
    """The counts that all else is made of, as one struct."""
    t = F.coalesce(text, F.lit(""))
    return let(
        words_of(text),
        lambda w: F.struct(
            lines_of(text).alias("lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            (F.char_length(t) - F.char_length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
        ),
    )


def rates(m: Column) -> dict[str, Column]:
    per = lambda x, unit, base: F.floor(unit * x / F.greatest(base, F.lit(1))).cast("long")
    return {
        "m_symbols": per(m["n_symbols"], 1000, m["word_chars"]), "m_upper": per(m["n_upper"], 1000, m["word_chars"]), "m_exclaim": per(m["n_exclaim"], 1000, m["word_chars"]),
        "m_length": per(m["word_chars"], 10, m["n_words"]), "m_dup_lines": per(m["lines"]["again"], 1000, m["lines"]["n"]), "m_repeats": per(m["n_repeat_words"], 1000, m["n_words"]),
    }


def to_bin(v: Column) -> Column:
    """Log-linear bin of a whole number of 0 or more: 0 to 63 exactly, then the top six bits and the octave."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(shift * 32 + F.call_function("shiftright", v, shift)).cast("long")


def from_bin(b: Column) -> Column:
    """Least value of a bin."""
    shift = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - shift * 32, shift)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, b, n): the histogram of each group's measures ``m``, over documents of 50 words or more."""
    m = measured.where("m.n_words >= 50")
    long = m.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"m.{k}").alias("v")) for k in SLACK])).alias("x")).select("lang", "source", "x.measure", F.col("x.v").alias("v"))
    return long.select("lang", "source", "measure", to_bin(F.col("v")).alias("b")).groupBy("lang", "source", "measure", "b").agg(F.count("*").alias("n"))


def fences(sk: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """(lang, source, f_<measure>..., low_<measure>...): one row for each group of the sketches."""

    def level(*keys: str) -> DataFrame:
        h = sk.groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))
        w = W.partitionBy(*keys, "measure")
        h = h.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("total", F.sum("n").over(w))
        q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, from_bin(F.col("b"))))
        slack = lambda of: F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("measure"))
        h = h.groupBy(*keys, "measure").agg(F.max("total").alias("total"), q(75).alias("q75"), q(25).alias("q25"))
        far = spread * (F.col("q75") - F.col("q25"))
        low = F.when(slack(LOW).isNotNull(), F.col("q25") - F.greatest(slack(LOW), far))
        return h.select(*keys, "measure", "total", F.struct((F.col("q75") + F.greatest(slack(SLACK), far)).alias("high"), low.alias("low")).alias("fence"))

    a, b, c = level("lang", "source").alias("a"), level("lang").alias("b"), level().alias("c")
    own = F.when(F.col("a.total") >= min_group, F.col("a.fence"))
    lang = F.when(F.col("b.total") >= min_group, F.col("b.fence"))
    j = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure"))).join(c, F.col("a.measure") == F.col("c.measure"))
    j = j.select("a.lang", "a.source", "a.measure", F.coalesce(own, lang, F.col("c.fence")).alias("fence"))
    at = lambda k, end: F.max(F.when(F.col("measure") == k, F.col(f"fence.{end}")))
    return j.groupBy("lang", "source").agg(*[at(k, "high").alias(f"f_{k}") for k in SLACK], *[at(k, "low").alias(f"low_{k}") for k in LOW])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(text: Column) -> Column:
    """The base measures and rates of a text, as one struct."""
    return let(measures(text), lambda m: F.struct(*[(m["lines"]["again"] if k == "n_dup_lines" else m[k]).alias(k) for k in BASE], *[v.alias(k) for k, v in rates(m).items()]))


def verdicts(d: DataFrame, f: DataFrame) -> DataFrame:
    """(row, v) of ``d(row, m)`` by the fences ``f`` (durable): v has the base measures, base_failed, kept, and which measures lie beyond."""
    f = f.select(F.struct("*").alias("f"))
    d = join_small(d, f, d["row.lang"].eqNullSafe(f["f.lang"]) & d["row.source"].eqNullSafe(f["f.source"]), "left")
    m, g = F.col("m"), F.col("f")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    over, under = [F.when(m[k] > g[f"f_{k}"], F.lit(k)) for k in SLACK], [F.when(m[k] < g[f"low_{k}"], F.lit(f"{k}_low")) for k in LOW]
    beyond = F.filter(F.array(*over, *under), lambda x: x.isNotNull())
    d = d.select("row", F.struct(*[m[k].alias(k) for k in BASE], failed.alias("base_failed"), beyond.alias("beyond")).alias("m"))
    # One predicate over both sides: a filter on it can't be split and pushed below the join, where it would measure again.
    kept = F.size(F.concat(F.when(m["base_failed"], F.array(F.lit("base"))).otherwise(F.array().cast("array<string>")), m["beyond"])) == 0
    return d.select("row", F.struct(*[m[k].alias(k) for k in (*BASE, "base_failed")], kept.alias("kept"), m["beyond"].alias("beyond")).alias("v"))


def judged(docs: DataFrame, min_group: int, spread: int) -> DataFrame:
    """(row, v) of all rows. Two passes over the texts: sketches, then measures and verdicts; the texts are never shuffled as
    long as the (language, source) fences are small enough to broadcast."""
    sk = sketches(docs.select("lang", "source", measured(F.col("text")).alias("m")))
    return verdicts(packed(docs).select("row", measured(F.col("row.text")).alias("m")), durable(fences(sk, min_group, spread)))


def judge(docs: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD, name: str = "rules") -> DataFrame:
    """``docs`` with one more struct column ``name``: base measures, base_failed, kept and beyond (measures past a fence).

    A column of ``docs`` that has that name already gives way.
    """
    return judged(docs.drop(name), min_group, spread).select("row.*", F.col("v").alias(name))


def rule_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs, MIN_GROUP, SPREAD).where("v.kept").select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """Measures and verdict of each row: the texts are read once, their measures (some numbers a row) settled and used twice."""
    d = durable(docs.select(F.struct("doc_id", "lang", "source").alias("row"), measured(F.col("text")).alias("m")))
    return verdicts(d, durable(fences(sketches(d.select("row.lang", "row.source", "m")), MIN_GROUP, SPREAD))).select("row.doc_id", "v.*")
