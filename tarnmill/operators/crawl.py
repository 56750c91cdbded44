"""Crawls of many sites at once over stored pages: depth-first order under a budget of pages, found in rounds.

A site's crawl is a walk of at most max_pages pages, so its state is small; what is large is the number of sites and the
table of links. A round walks every open site as far as its links are known, taking pages whose links are not yet known as
pages without links, and then fetches the links of all pages so met with one join. A walk that meets no such page is right
and its site is done. The first unknown page of a walk is known a round later, so there are at most max_pages rounds, and
about max_depth where sites are broad. A round is a table in the shared folder, so lost executors cost one round's tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.functions import html, urls
from tarnmill.operators import staging

WALKED = "root string, place int, url string, parent_url string, depth int, child_count int, asked boolean, open boolean"
KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]


def walk(root: str, known: Mapping[str, list[str]], include_root: bool, max_pages: int, max_depth: int) -> list[tuple]:
    """(url, parent, depth, child count, whether its links are asked for) of a site's pages, in the order of the crawl.

    `known` has the links of pages, best first. A link counts as seen once a page before has it, whether or not the budget
    lets it wait. Children wait last to first, as long as pages taken and waiting are fewer than the budget, so where it
    is short the best of them are cut. The links of the root all wait, and its children have no parent.
    """
    first = list(dict.fromkeys(known.get(root, [])))
    seen, waiting = set(first), [(u, None, 1) for u in reversed(first)]
    out = [(root, None, 0, len(first), root not in known)] if include_root or root not in known else []
    while waiting and len(out) < max_pages:
        url, parent, depth = waiting.pop()
        deeper = depth < max_depth
        new = [u for u in dict.fromkeys(known.get(url, [])) if u not in seen] if deeper else []
        seen.update(new)
        room = max(max_pages - len(out) - len(waiting), 0)
        waiting += [(u, url, depth + 1) for u in list(reversed(new))[:room]]
        out.append((url, parent, depth, len(new), deeper and url not in known))
    return out


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(url, at, link) of pages(key, url, html), addresses in normal form."""
    named = pages.select(key, urls.normalise(F.col("url")).alias("url"))
    return html.links(pages, key).join(named, key).select("url", "at", "link")


def crawl(roots: DataFrame, links: DataFrame, pages: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    """(root, place, url, parent_url, depth, child_count, status) of the crawls of roots(root), by place from 1.

    links(url, at, link) are the links of stored pages in their order, pages(url) the pages that can be fetched; others are
    fetch_error and have no children. Null roots are left out, repeated ones count once; a repeated page has the links of
    all its rows. The rule is one of plans.page_scoring.checked_crawl.
    """
    spark = roots.sparkSession
    include_root, most, deepest = rule.get("include_root_page", True), rule["max_pages"], rule["max_depth"]
    folder = f"{staging.stage_dir(spark)}/crawl-{uuid.uuid4().hex}"

    def step(found: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in WALKED.split(", ")]
        root = found.column("root")[0].as_py()
        known = dict(zip(found.column("url").to_pylist(), found.column("links").to_pylist(), strict=True))
        rows = walk(root, known, include_root, most, deepest)
        unknown = any(r[4] for r in rows)
        columns = zip(*((root, n, *r, unknown) for n, r in enumerate(rows, 1)), strict=True) if rows else [[]] * len(names)
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, KINDS, strict=True)], names)

    def fetched(asked: DataFrame) -> DataFrame:
        """Asked pages with their usable links, best first; an empty list where there is none.

        What a link is compared with is found once for each asked page, before its links are joined.
        """
        near = asked.select("root", "url", urls.nearness(F.col("url"), F.col("root")).alias("near"), urls.domain(F.col("root")).alias("domain"))
        each = near.join(links.select("url", "at", "link"), "url", "left")
        fit = (F.col("link") != F.col("url")) & (F.col("link") != F.col("root")) & urls.is_page(F.col("link"))
        if rule.get("same_domain_only", True):
            fit = fit & (urls.domain(F.col("link")) == F.col("domain"))
        priority = urls.priority_near(F.col("link"), F.col("near"), rule.get("priority_keywords", ()), rule.get("deprioritize_keywords", ()))
        # A column of its own: within collect_list() the expression would be interpreted for each row, not compiled.
        each = each.select("root", "url", F.when(fit, F.struct((-priority).alias("p"), "at", "link")).alias("found"))
        return each.groupBy("root", "url").agg(F.sort_array(F.collect_list("found"))["link"].alias("links"))

    asked = roots.select("root").filter("root is not null").distinct().withColumn("url", F.col("root"))
    number = 0
    while number == 0 or not asked.isEmpty():
        fetched(asked).write.parquet(f"{folder}/known/round={number}")
        known = spark.read.parquet(f"{folder}/known")
        if number:
            known = known.join(walked.filter("open").select("root").distinct(), "root", "left_semi")
        path = f"{folder}/walked/round={number}"
        known.select("root", "url", "links").groupBy("root").applyInArrow(step, WALKED).write.parquet(path)
        walked = spark.read.schema(WALKED).parquet(path)
        asked = walked.filter("asked").select("root", "url")
        number += 1
    done = spark.read.schema(WALKED).parquet(*[f"{folder}/walked/round={n}" for n in range(number)]).filter("not open").drop("asked", "open")
    there = pages.select("url").distinct().withColumn("status", F.lit("new"))
    return done.join(there, "url", "left").withColumn("status", F.coalesce("status", F.lit("fetch_error"))).select("root", "place", "url", "parent_url", "depth", "child_count", "status")
