"""Connected groups of similar items from candidate buckets, in DataFrame operations only.

A bucket may hold a third of all items, so its pairs are never all written out. Each bucket's smallest id, found by a
map-side minimum, is first compared with all its members. The links found, with those of the members' other buckets, join
most of a large bucket into one component; what is left of it is then compared with the members of its other components,
which is all that can still add a link between components. So the components are those of all pairs within buckets, at a
cost near the bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import drop_staged, maybe_in, staged


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for the ids of edges(a, b): comp is the smallest id of an id's connected component.

    Large-star and small-star rounds over (larger end, smaller end) until nothing changes. Minima are taken map-side and
    the joins split skewed keys; each round's edges are staged, so a lost executor costs one round. Edges with a null or
    with equal ends are ignored.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    while True:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = edges.join(low, "b").select("a", F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(small.unionByName(lowest.withColumnRenamed("m", "b")).distinct(), "edges")
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop_staged(edges)
        edges = after
        if now == state:
            roots = edges.select(F.col("b").alias("id")).distinct()
            return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots.withColumn("comp", F.col("id")))
        state = now


def bucket_components(items: DataFrame, verify: Callable[[DataFrame], DataFrame], grid: Callable[[DataFrame], DataFrame] | None = None, small: int = 16) -> DataFrame:
    """(id, comp) for the ids of items(bucket, id) that some verified pair within a bucket links to another id.

    verify takes pairs(a, b), each once with a < b, and returns those that are links. With `grid`, what is left of buckets
    of more than `small` members goes there as rows (bucket, id, comp, main, n, m) and comes back as links: main is the
    bucket's largest component, n the size of the bucket and m the number of its members outside main.
    """
    many = items.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    many = staged(many, "buckets")
    live = staged(maybe_in(items, "bucket", many).join(many, "bucket", "left_semi"), "live")
    chosen = live.groupBy("bucket").agg(F.min("id").alias("other"))
    ordered = [F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")]
    first = staged(live.join(chosen, "bucket").filter("id <> other").select(*ordered).distinct(), "pairs")
    found = components(verify(first))
    named = live.join(found, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
    sizes = named.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    largest = F.max(F.struct("k", "comp"))
    main = sizes.groupBy("bucket").agg(largest["comp"].alias("main"), F.sum("k").alias("n"), (F.sum("k") - largest["k"]).alias("m")).filter("m > 0")
    apart = staged(named.join(main, "bucket"), "apart")
    few = apart.filter(F.col("n") <= small) if grid else apart
    others = few.select("bucket", F.col("id").alias("other"), F.col("comp").alias("other_comp"))
    second = few.filter("comp <> main").join(others, "bucket").filter("comp <> other_comp and (other_comp = main or id < other)")
    second = staged(second.select(*ordered).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = [verify(second)] if not second.isEmpty() else []
    if grid and not (large := apart.filter(F.col("n") > small)).isEmpty():
        more.append(grid(large))
    if more:
        edges = found.select(F.col("id").alias("a"), F.col("comp").alias("b"))
        for links in more:
            edges = edges.unionByName(links)
        found = components(edges)
    drop_staged(many, live, first, apart, second)
    return found
