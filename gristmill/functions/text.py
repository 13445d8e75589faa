"""Text columns. Everything here is a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.settings import SOURCE_TAG, TRUNCATE_KEEP, TRUNCATE_MARK, TRUNCATE_OVER

#: White space as Python's str.strip sees it: Java's Unicode class plus U+001C to U+001F.
_WHITE = r"[\s\x1c-\x1f]"


def strip(x: Column) -> Column:
    """Without white space (Unicode's, not just spaces) at both ends."""
    return F.regexp_replace(x, rf"(?U)^{_WHITE}+|{_WHITE}+\z", "")


def is_blank(x: Column) -> Column:
    return strip(x) == ""


def sha256(x: Column) -> Column:
    """Hex SHA-256 of a string's UTF-8 bytes, or of bytes."""
    return F.sha2(x, 256)


def memo_key(prompt: Column, temperature: Column, max_tokens: Column) -> Column:
    """MD5 that names a generation: prompt, temperature and length joined by underscores."""
    return F.md5(F.concat_ws("_", prompt, temperature.cast("string"), max_tokens.cast("string")))


def source_tag(path: Column) -> Column:
    return F.concat(F.lit(SOURCE_TAG), path)


def source_path(tag: Column) -> Column:
    """The path in a source tag; null for other sources."""
    return F.when(tag.startswith(SOURCE_TAG), F.substring(tag, len(SOURCE_TAG) + 1, 1 << 30))


def source_like(tag: Column, path: Column) -> Column:
    """``tag LIKE 'repo_file:' || path || '%'`` with ASCII case folded, taking the path literally (no wildcards in it)."""
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.startswith(fold(tag), fold(source_tag(path)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def lines(x: Column) -> Column:
    """Split at line feeds; empty lines stay."""
    return F.split(x, "\n", -1)


def fold_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def truncate_context(x: Column, over: int = TRUNCATE_OVER, keep: int = TRUNCATE_KEEP, mark: str = TRUNCATE_MARK) -> Column:
    """Head and tail of texts over the limit, with a mark between."""
    return F.when(F.char_length(x) > over, F.concat(F.substring(x, 1, keep), F.lit(mark), F.right(x, F.lit(keep)))).otherwise(x)


def human_size(n: Column) -> Column:
    """Bytes as B to TB, steps of 1024, one decimal."""
    units = ("B", "KB", "MB", "GB", "TB")
    x = n.cast("double")
    out = F.format_string("%.1f TB", x / 1024.0**4)
    for i in reversed(range(4)):
        out = F.when(x < 1024.0 ** (i + 1), F.format_string(f"%.1f {units[i]}", x / 1024.0**i)).otherwise(out)
    return out


def cache_dir_model(name: Column) -> Column:
    """``models--a--b`` to ``a/b``."""
    return F.replace(F.replace(name, F.lit("models--"), F.lit("")), F.lit("--"), F.lit("/"))


def model_cache_dir(model: Column) -> Column:
    return F.concat(F.lit("models--"), F.replace(model, F.lit("/"), F.lit("--")))


def batch_count(n: Column, size: int) -> Column:
    return F.ceil(n / F.lit(size)).cast("long")


def log_name(ts: Column, prefix: str = "pipeline_log") -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".log"))


def percent_of(x: Column) -> Column:
    """The digits before the first percent sign."""
    return F.nullif(F.regexp_extract(x, r"(\d+)%", 1), F.lit("")).cast("int")
