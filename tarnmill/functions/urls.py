"""Addresses: normal form, comparison, and the priority of a page's links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, authority, path, query of an address (the last segment's ;params and the fragment are left out).
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
#: Suffixes of addresses that are not pages (fixed values).
NOT_PAGES = "pdf zip xls xlsx csv json jpg jpeg png gif svg webp doc docx ppt pptx xml mp3 mp4 avi mov".split()


def part(url: Column, number: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), PARTS, number)


def path_of(url: Column) -> Column:
    return F.regexp_replace(part(url, 3), r";[^/]*$", "")


def normalise(url: Column) -> Column:
    """Lower-case scheme and authority, `/` for no path, one trailing slash dropped, query kept, fragment dropped."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    query = F.when(part(url, 4) == "", "").otherwise(F.concat(F.lit("?"), part(url, 4)))
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, query)


def domain(url: Column) -> Column:
    return F.lower(part(url, 2))


def same_domain(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def is_page(url: Column) -> Column:
    return ~F.lower(F.coalesce(url, F.lit(""))).rlike(r"\.(" + "|".join(NOT_PAGES) + ")$")


def segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda x: x != "")


def prefix(url: Column) -> Column:
    """The path's folder: all of it up to two segments, else without its last one."""
    parts = segments(url)
    n = F.size(parts)
    kept = F.when(n <= 2, parts).otherwise(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def nearness(current: Column, root: Column) -> Column:
    """What child_priority() takes of a page: its folder and its site's, and the folder that its path lies in (null for no path)."""
    here = F.lower(path_of(current))
    folder = F.when((here != "") & (here != "/"), F.regexp_replace(here, "/[^/]*$", ""))
    return F.struct(F.lower(prefix(current)).alias("page"), F.lower(prefix(root)).alias("site"), folder.alias("folder"))


def child_priority(url: Column, current: Column, root: Column, wanted: Sequence[str] = (), unwanted: Sequence[str] = ()) -> Column:
    """How soon a crawl takes a link: keywords, closeness to the current and the root folder, depth and suffix."""
    return priority_near(url, nearness(current, root), wanted, unwanted)


def priority_near(url: Column, near: Column, wanted: Sequence[str] = (), unwanted: Sequence[str] = ()) -> Column:
    """child_priority() where nearness() is known already: it is the page's, so it need not be found again for each of its links."""
    u = F.lower(F.coalesce(url, F.lit("")))
    score = F.lit(0)
    for words, points in ((wanted, 100), (unwanted, -120)):
        for w in words:
            if w:
                score = score + F.when(u.contains(w), points).otherwise(0)
    for folder, points in ((near["page"], 60), (near["site"], 25)):
        score = score + F.when((folder != "/") & u.contains(folder), points).otherwise(0)
    score = score + F.when(path_of(u).startswith(near["folder"]), 18).otherwise(0)
    score = score + F.least(F.size(segments(u)), F.lit(12)) * 4
    return score + F.when(u.endswith(".html") | u.endswith(".htm"), 8).otherwise(0) - F.when(u.contains("index.html"), 3).otherwise(0)
