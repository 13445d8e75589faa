"""Repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.settings import CODE_HOST


def netloc(url: Column) -> Column:
    """Host with user and port, as it stands between // and the path; empty if there is none."""
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.array_remove(F.split(url_path(url), "/"), "")


def url_kind(url: Column, host: str = CODE_HOST) -> Column:
    """org_page (one segment at the code host), direct_repo (two or more), direct_unclear (none), or direct (elsewhere)."""
    n = F.size(segments(url))
    return F.when(~F.contains(netloc(url), F.lit(host)), "direct").when(n == 1, "org_page").when(n >= 2, "direct_repo").otherwise("direct_unclear")


def clone_path(url: Column, root: str = "repos", host: str = CODE_HOST) -> Column:
    """Where a repository goes: root/owner/name at the code host, else root/name; ``.git`` is taken out wherever it stands."""
    bare = lambda x: F.replace(x, F.lit(".git"), F.lit(""))
    s = segments(url)
    return F.when(F.contains(netloc(url), F.lit(host)) & (F.size(s) >= 2), F.concat_ws("/", F.lit(root), F.get(s, F.lit(0)), bare(F.get(s, F.lit(1))))).otherwise(F.concat_ws("/", F.lit(root), bare(F.substring_index(url, "/", -1))))


def absolute_link(href: Column, host: str = CODE_HOST) -> Column:
    """A link within the code host in full; null for others."""
    return F.when(href.startswith("/"), F.concat(F.lit(f"https://{host}"), href))
