"""Crawls in rounds against a walk that fetches one page at a time."""

from __future__ import annotations

import random

import pytest

from tarnmill.functions import urls
from tarnmill.operators import crawl
from tarnmill.plans import page_scoring
from pyspark.sql import functions as F


def plain(links, root, include_root, most, deepest):
    """The walk written out page by page; links are in the order in which they are taken."""
    children = lambda url: [x for x in dict.fromkeys(links.get(url, [])) if x not in (url, root)]
    seen, done = set(), []
    top = children(root)
    seen |= set(top)
    stack = [(x, None, 1) for x in top[::-1]]
    if include_root:
        done.append((root, None, 0, len(top)))
    while stack and len(done) < most:
        url, parent, depth = stack.pop()
        mine = [x for x in children(url) if x not in seen] if depth < deepest else []
        seen |= set(mine)
        for x in mine[::-1]:
            if len(done) + len(stack) >= most:
                break
            stack.append((x, url, depth + 1))
        done.append((url, parent, depth, len(mine)))
    return done


@pytest.mark.parametrize(("include_root", "most", "deepest", "seed"), [(True, 12, 3, 1), (False, 30, 5, 2), (True, 1, 1, 3), (False, 7, 2, 4)])
def test_rounds_equal_a_walk(spark, include_root, most, deepest, seed):
    rng = random.Random(seed)
    names = [f"http://a.org/p{n:02}" for n in range(60)]  # none in another, so that all links are equally near
    links = {u: [rng.choice(names) for _ in range(rng.randrange(6))] for u in names}
    rows = [(u, n, x) for u, ls in links.items() for n, x in enumerate(ls)]
    roots = [names[0], names[1], names[0], None, *names[5:15]]
    rule = page_scoring.checked_crawl({"include_root_page": include_root, "max_depth": deepest, "max_pages": most})
    found = crawl.crawl(
        spark.createDataFrame([(r, 1) for r in roots], "root string, url int"), spark.createDataFrame(rows, "url string, at int, link string").withColumn("root", F.lit("x")),
        spark.createDataFrame([(u,) for u in names[:50]], "url string"), rule,
    ).collect()
    for root in {r for r in roots if r}:
        got = sorted((r for r in found if r.root == root), key=lambda r: r.place)
        assert [(r.url, r.parent_url, r.depth, r.child_count) for r in got] == plain(links, root, include_root, most, deepest)
        assert [r.place for r in got] == list(range(1, len(got) + 1))
        assert all(r.status == ("new" if r.url in names[:50] else "fetch_error") for r in got)


def test_the_budget_cuts_the_best_children(spark):
    known = {"r": ["a", "b"], "a": ["c", "d"]}
    assert [r[0] for r in crawl.walk("r", known | {"b": [], "d": []}, True, 3, 3)] == ["r", "a", "d"]


def test_order_domains_and_kinds(spark):
    rows = [("http://a.org/x/", 0, "http://b.org/y"), ("http://a.org/x/", 1, "http://a.org/f.pdf"), ("http://a.org/x/", 2, "http://a.org/p"), ("http://a.org/x/", 3, "http://a.org/new/q"), ("http://a.org/x/", 4, None)]
    links = spark.createDataFrame(rows, "url string, at int, link string")
    roots, pages = spark.createDataFrame([("http://a.org/x/",)], "root string"), links.select("url")
    rule = {"max_depth": 1, "max_pages": 9, "priority_keywords": ["NEW"]}
    take = lambda **more: [r.url.removeprefix("http://a.") for r in crawl.crawl(roots, links, pages, page_scoring.checked_crawl(rule | more)).orderBy("place").collect()]
    assert take() == ["org/x/", "org/new/q", "org/p"]
    assert len(take(same_domain_only=False)) == 4
    assert crawl.crawl(roots.limit(0), links, pages, rule | {"priority_keywords": []}).count() == 0
    assert crawl.crawl(roots, links.limit(0), pages.limit(0), rule | {"priority_keywords": []}).first().status == "fetch_error"


def test_pages_of_html(spark):
    page = lambda *to: "".join(f'<article><p>a</p><a href="{x}">link</a></article>' for x in to)
    pages = spark.createDataFrame([(1, "http://A.org/", page("/b", "c.html#x")), (2, "http://a.org/b", page("/d/e", "/b")), (3, "http://a.org/c.html", None), (4, "http://a.org/d/e", page("/deep"))], "page_id int, url string, html string")
    found = pages.select(urls.normalise(F.col("url")).alias("url"))
    rule = page_scoring.checked_crawl({"max_depth": 2, "max_pages": 10})
    got = crawl.crawl(found.filter("url like '%org/'").select(F.col("url").alias("root")), crawl.page_links(pages), found, rule).orderBy("place").collect()
    assert [(r.url, r.depth, r.child_count, r.status) for r in got] == [("http://a.org/", 0, 2, "new"), ("http://a.org/c.html", 1, 0, "new"), ("http://a.org/b", 1, 1, "new"), ("http://a.org/d/e", 2, 0, "new")]


def test_what_a_page_is_compared_with_is_found_before_its_links_are_joined(spark, tmp_path, monkeypatch):
    """Its folders and its domain were found anew for every link of it."""
    seen, pages = [], [("http://a.org/x/y/z.html", "http://A.org/x/"), ("http://a.org/", "http://a.org"), (None, ""), ("http://a.org/x?q#f", "http://b.org/x/y/index.html")]
    near = urls.nearness
    monkeypatch.setattr(urls, "nearness", lambda current, root: seen.append((str(current), str(root))) or near(current, root))
    rows = spark.createDataFrame([(u, r, n, x) for u, r in pages for n, (x, _) in enumerate(pages)], "url string, root string, at int, link string")
    each = rows.withColumn("near", urls.nearness(F.col("url"), F.col("root")))
    both = each.select(urls.priority_near(F.col("link"), F.col("near"), ["x"], ["y"]).alias("a"), urls.child_priority(F.col("link"), F.col("url"), F.col("root"), ["x"], ["y"]).alias("b")).collect()
    assert all(r.a == r.b for r in both) and len({r.a for r in both}) > 3
    seen.clear()
    crawl.crawl(rows.select("root"), rows, rows.select("url"), page_scoring.checked_crawl({"max_depth": 1, "max_pages": 3})).count()
    assert seen and set(seen) == {(str(F.col("url")), str(F.col("root")))}
