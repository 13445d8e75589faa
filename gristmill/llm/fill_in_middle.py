"""Fill-in-middle transformation over an index of distinct texts.

1. Identical texts are one entry of the index. Rows meet by the SHA-256 of their text, and an entry's texts are compared
   with each other: two different ones under one digest end the job, so no entry ever stands for two contents.
2. Documents are joined back to their entry as (digest, members), one row for each entry.
3. An entry's line ends are found once and kept as an Elias-Fano list (the low bits of each end packed, the high bits in
   unary), about ``2 + log2(mean line length)`` bits a line. Each member's two seeded cuts are selected from this list; the
   pieces and the output are then made by built-in functions.

A text goes through one shuffle, and only once from each task that has it, however many copies there are. A text with
over ``GROUP`` documents is split into entries of about that many, so no task has an unbounded group.

Cuts: h1 to h4 are the first four 8-digit groups of the hex SHA-256 of ``<seed>:<doc_id>``. Of n lines, the prefix has the
smaller of h1 % (n + 1) and h2 % (n + 1), prefix and middle together the larger. Plain stay: empty texts, texts with one of
the marks, and documents with h3 % 100 >= ``rate``; of the others, h4 % 100 < ``spm`` gives the order suffix-prefix-middle.

A null text counts as empty; a null doc_id as empty in the seed, and is returned. Repeated rows are worked out once and
returned each. A text without a line feed is one line, however long. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import durable, join_small, let

SEED, RATE, SPM = 7, 100, 50
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Documents of one text that share an entry of the index.
GROUP = 1000
LIST = T.StructType().add("n", T.LongType()).add("low_bits", T.IntegerType()).add("low", T.BinaryType()).add("high", T.BinaryType())
CUTS = T.ArrayType(T.StructType().add("p", T.LongType()).add("q", T.LongType()))


# --- Elias-Fano lists ----------------------------------------------------------------------------------------------


def line_ends(data: bytes) -> np.ndarray:
    """Where each line ``[^\\n]*\\n|[^\\n]+`` of a UTF-8 text ends, in code points."""
    a = np.frombuffer(data, np.uint8)
    upto = np.cumsum((a & 0xC0) != 0x80)
    ends = upto[a == 10]
    return ends if not len(a) or a[-1] == 10 else np.append(ends, upto[-1])


def elias_fano(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """(n, low bits, packed low bits, unary high bits) of increasing whole numbers."""
    n = len(values)
    if not n:
        return 0, 0, b"", b""
    v = values.astype(np.uint64)
    low = max(0, int(values[-1] // n).bit_length() - 1)
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    high = np.zeros((int(values[-1]) >> low) + n, np.uint8)
    high[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    return n, low, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def select(low_bits: int, low: bytes, high: bytes, i: int) -> int:
    """The i-th value (from 0) of a list: its high part from the place of the i-th set bit, found by counts of bytes."""
    h = np.frombuffer(high, np.uint8)
    counts = np.cumsum(np.bitwise_count(h), dtype=np.int64)
    byte = int(np.searchsorted(counts, i + 1))
    within = i - (int(counts[byte - 1]) if byte else 0)
    place = 8 * byte + int(np.flatnonzero(np.unpackbits(h[byte : byte + 1], bitorder="little"))[within])
    begin = i * low_bits
    part = int.from_bytes(low[begin // 8 : (begin + low_bits + 7) // 8], "little") >> (begin % 8)
    return (place - i) << low_bits | part & ((1 << low_bits) - 1)


@F.arrow_udf(LIST)
def boundaries(texts: pa.Array) -> pa.Array:
    """The list of a text's line ends."""
    lists = [elias_fano(line_ends(t.as_buffer().to_pybytes())) for t in texts]
    n, low_bits, low, high = ([x[k] for x in lists] for k in range(4))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(low_bits, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], names=["n", "low_bits", "low", "high"])


@F.arrow_udf(CUTS)
def cuts(lists: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """For each member, the code points before its cuts, from the numbers of lines before them."""
    out = []
    for x, one, two in zip(lists.to_pylist(), first.to_pylist(), last.to_pylist()):
        at = lambda k, x=x: select(x["low_bits"], x["low"], x["high"], k - 1) if k else 0
        out.append([{"p": at(a), "q": at(b)} for a, b in zip(one, two)])
    return pa.array(out, pa.list_(pa.struct([("p", pa.int64()), ("q", pa.int64())])))


# --- the operator --------------------------------------------------------------------------------------------------


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def draws(doc_id: Column, seed: int) -> Column:
    """h1 to h4 as an array."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return let(h, lambda x: F.array(*[F.conv(F.substring(x, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]))


def text_index(docs: DataFrame, heavy: DataFrame, key=digest) -> DataFrame:
    """(key, part, text): each distinct text once in each of its parts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key(F.col("text")))
    rows = join_small(rows, heavy, "key", "left").select("key", part_of().alias("part"), "text")
    same = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("different texts have the same digest")).cast("string"))
    return rows.groupBy("key", "part").agg(F.collect_set("text").alias("texts")).select("key", "part", same.alias("text"))


def part_of() -> Column:
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS, group: int = GROUP, key=digest) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars (null if plain), output and text for each row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key(F.coalesce("text", F.lit(""))).alias("key"))
    own = durable(own.groupBy("doc_id", "key").agg(F.count("*").alias("copies")))  # ids and digests only
    heavy = durable(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key", F.ceil(F.col("n") / group).alias("parts")))
    members = join_small(own, heavy, "key", "left").select("key", part_of().alias("part"), F.struct("doc_id", "copies", draws(F.col("doc_id"), seed).alias("h")).alias("member"))
    members = members.groupBy("key", "part").agg(F.collect_list("member").alias("members"))  # about ``group`` at most
    # One row for each entry meets one of members. The lists come after this join, as Spark forgets a partitioning at Python
    # functions and would move the texts again.
    x = members.join(text_index(docs, heavy, key), ["key", "part"]).withColumn("lines", boundaries("text"))

    n = F.col("lines")["n"]
    lines = lambda pick: F.transform("members", lambda m: pick(F.pmod(m["h"][0], n + 1), F.pmod(m["h"][1], n + 1)))
    x = x.withColumn("cuts", cuts("lines", lines(F.least), lines(F.greatest)))
    has_mark = F.lit(False)
    for m in marks:
        has_mark = has_mark | F.contains(F.col("text"), F.lit(m))
    x = x.withColumn("stays", (F.col("text") == "") | has_mark)
    x = x.select("text", "stays", n.alias("n"), F.explode(F.arrays_zip("members", "cuts")).alias("x")).select("text", "stays", "n", "x.members.*", "x.cuts.*")
    form = F.when(F.col("stays") | (F.col("h")[2] % 100 >= rate), "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm")
    x = x.withColumn("form", form).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    piece = lambda at, size=None: F.substring("text", at + 1, size if size is not None else F.char_length("text"))
    p, s, m = F.concat(F.lit(marks[0]), piece(F.lit(0), F.col("p"))), F.concat(F.lit(marks[1]), piece(F.col("q"))), F.concat(F.lit(marks[2]), piece(F.col("p"), F.col("q") - F.col("p")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    cut = F.col("form") != "plain"
    return x.select("doc_id", "n", "form", F.when(cut, F.col("p")).alias("prefix_chars"), F.when(cut, F.col("q") - F.col("p")).alias("middle_chars"), output.alias("output"), "text")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from an output and its form alone: no piece holds a mark, so the first place of each is the mark itself."""
    size = [len(m) for m in marks]
    at = lambda k: F.locate(marks[k], output)
    between = lambda begin, end: F.substring(output, begin, end - begin)
    middle = between(at(2) + size[2], F.char_length(output) + 1)
    psm = F.concat(between(F.lit(size[0] + 1), at(1)), middle, between(at(1) + size[1], at(2)))
    spm = F.concat(between(at(0) + size[0], at(2)), middle, between(F.lit(size[1] + 1), at(0)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(docs: DataFrame) -> DataFrame:
    """The digests of outputs, and of the texts that are restored from them."""
    x = transform(docs)
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
