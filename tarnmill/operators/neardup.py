"""Near-duplicate clusters of knowledge items by cosine similarity, their representatives and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.functions import text as T
from tarnmill.functions import vectors as V
from tarnmill.operators import metric
from tarnmill.operators.staging import numbered, stage, stage_dir  # noqa: F401

#: Least similarities of duplicate questions and of duplicate plain items (fixed values).
THRESHOLDS = {"qa": 0.85, "plain": 0.95}


def similar_pairs(items: DataFrame, threshold: float, block_rows: int = metric.PART) -> DataFrame:
    """All pairs (a, b, score) of items(id, vector) with a < b and cosine of `threshold` or more.

    Exact: vectors meet in the cells that the threshold lets them reach, and there as blocks that are multiplied as
    matrices. Null, empty and zero vectors match nothing; vectors of other lengths are other spaces.
    """
    return metric.pairs(metric.partition(items, "id", "vector", threshold=threshold), threshold, block_rows)[0]


def connected(pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each id's connected component of pairs(a, b)."""
    both = stage(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("root", "near").alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = stage(step.join(jump, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "labels")
        if after.join(labels.withColumnRenamed("root", "old"), "id").filter("root <> old").isEmpty():
            return after
        labels = after


def linked(items: DataFrame, threshold: float) -> DataFrame:
    """(id, root): the components of items(id, vector) under similar_pairs; items that are alone may be absent.

    Equal vectors are folded first, as one id stands for them all, so a group of copies is never paired with itself.
    """
    held = metric.valid(items, "id", "vector")
    copies = stage(held.groupBy("vector").agg(F.min("id").alias("first")), "distinct")
    roots = connected(similar_pairs(copies.select(F.col("first").alias("id"), "vector"), threshold))
    of_copies = copies.join(roots.withColumnRenamed("id", "first"), "first", "left").select("vector", F.coalesce("root", "first").alias("root"))
    return held.join(of_copies, "vector").select("id", "root")


def clusters(items: DataFrame, thresholds: dict[str, float] | None = None, job_id: str = "job") -> DataFrame:
    """Marks on items(knowledge_id, knowledge_type, question, answer, content, sort_no, vector).

    Adds dedup_group_id, representative_id, is_representative, is_duplicate and dedup_score. Of a group, an item with an
    answer stays, then the longest, then the smallest sort_no, then the largest id. Group numbers run through the qa
    groups and then the plain ones, by their first member; single items have none.
    """
    limits, roots = thresholds or THRESHOLDS, None
    for kind, limit in limits.items():
        part = items.filter(F.col("knowledge_type") == kind).select(F.col("knowledge_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        found = linked(part, limit)
        roots = found if roots is None else roots.unionByName(found)
    length = sum((F.length(T.collapse(F.col(c))) for c in ("question", "answer", "content")), F.lit(0))
    rank = F.struct((T.collapse(F.col("answer")) != "").cast("int").alias("answered"), length.alias("total"), (-F.coalesce("sort_no", F.lit(0))).alias("early"), F.col("knowledge_id").alias("id"))
    named = items.join(roots.withColumnRenamed("id", "knowledge_id"), "knowledge_id", "left").withColumn("root", F.coalesce("root", "knowledge_id"))
    groups = named.groupBy("knowledge_type", "root").agg(F.max(rank)["id"].alias("representative_id"), F.count("*").alias("size"), F.min(F.struct(F.coalesce("sort_no", F.lit(0)).alias("s"), "knowledge_id")).alias("first"))
    several = numbered(groups.filter("size > 1"), [F.when(F.col("knowledge_type") == "qa", 0).otherwise(1), F.col("first")])
    prefix = F.when(F.col("knowledge_type") == "qa", "QG").otherwise("PG")
    several = several.select("knowledge_type", "root", F.format_string("%s_%s_%04d", F.lit(job_id), prefix, "number").alias("dedup_group_id"))
    chosen = groups.select("knowledge_type", "root", "representative_id", "size")
    marked = named.join(chosen, ["knowledge_type", "root"]).join(several, ["knowledge_type", "root"], "left")
    best = items.select(F.col("knowledge_id").alias("representative_id"), F.col("vector").alias("best_vector"))
    marked = marked.join(best, "representative_id")
    own = F.col("knowledge_id") == F.col("representative_id")
    score = V.cosine(F.col("vector"), F.col("best_vector"))
    marked = marked.withColumns({"is_representative": own.cast("int"), "is_duplicate": (~own).cast("int"), "dedup_score": F.when(score >= 0, score).when(own, 1.0)})
    return marked.drop("best_vector", "root", "size")


def summary(marked: DataFrame) -> DataFrame:
    """Counts of a marked job: items, groups, representatives, duplicates, and what is kept of each kind."""
    kept = F.col("is_duplicate") == 0
    return marked.agg(
        F.count("*").alias("items"), F.countDistinct("dedup_group_id").alias("groups"), F.count_if(F.col("is_representative") == 1).alias("representatives"),
        F.count_if(~kept).alias("duplicates"), F.count_if(kept & (F.col("knowledge_type") == "qa")).alias("qa_kept"), F.count_if(kept & (F.col("knowledge_type") == "plain")).alias("plain_kept"),
    )
