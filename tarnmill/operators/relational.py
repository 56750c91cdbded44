"""Table upkeep on immutable files: upserts, replacements, sticky states, pages of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that df lacks."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = (), order: Sequence[Column] = ()) -> DataFrame:
    """old with new's rows in place of those with the same key; columns in `keep` hold on to old's value.

    Of new rows that share a key the last by `order` wins. Null keys equal each other.
    """
    if order:
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        new = new.withColumn("__n", place).withColumn("__last", F.max("__n").over(Window.partitionBy(*key))).filter("__n = __last").drop("__n", "__last")
    both = old.withColumn("__in", F.lit(1)).alias("o").join(new.withColumn("__in", F.lit(1)).alias("n"), on=[F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], how="full")
    fresh, known = F.col("n.__in").isNotNull(), F.col("o.__in").isNotNull()
    pick = lambda c: F.when(known & fresh, F.col(f"o.{c}") if c in keep else F.col(f"n.{c}")).when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def sticky_status(old: DataFrame, new: DataFrame, key: str, status: str = "status", final: str = "done") -> DataFrame:
    """upsert() in which a row whose old status is final stays so."""
    done = old.filter(F.col(status) == final).select(key, F.lit(True).alias("__done"))
    return upsert(old, new, [key]).join(done, key, "left").withColumn(status, F.when(F.col("__done"), final).otherwise(F.col(status))).drop("__done").select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those rows of new whose key it lacks, one row a key."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").dropDuplicates([key]).select(*old.columns))


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new, or ValueError if new has a key that old has, or has one twice."""
    clash = new.join(old.select(key), key, "left_semi").select(key).unionByName(new.groupBy(key).count().filter("count > 1").select(key))
    if not clash.isEmpty():
        raise ValueError(f"{key} is taken")
    return old.unionByName(new.select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """old without the parents that new names, with new's rows instead; new rows that lack a required text are skipped.

    The second result counts inserted and skipped rows of each parent.
    """
    complete = F.lit(True)
    for c in required:
        complete = complete & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    rest = old.join(new.select(parent).distinct(), parent, "left_anti")
    counts = new.groupBy(parent).agg(F.count_if(complete).alias("inserted"), F.count_if(~complete).alias("skipped"))
    return rest.unionByName(new.filter(complete).select(*old.columns)), counts


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows (1 to 100) in the given order."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page is 1 or more, size 1 to 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def latest_with_children(parents: DataFrame, children: DataFrame, key: str, newest: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The children of the newest parent row, in order."""
    return children.join(parents.orderBy(*newest).limit(1).select(key), key).orderBy(*order)


def merge_status(status: Column, updates: Column, dropped_prefix: str = "refine_") -> Column:
    """A status map without its legacy keys, overlaid by the updates."""
    kept = F.map_filter(status, lambda k, _: ~k.startswith(dropped_prefix) & ~F.map_contains_key(updates, k))
    return F.map_concat(kept, updates)


def transition(rows: DataFrame, chosen: Column, status: str, now: Column) -> DataFrame:
    """rows with the chosen ones in a new status: started_at is kept where it is set, finished_at is now, the error goes.

    Columns that rows lack are left out, as is a null choice.
    """
    hit = F.coalesce(chosen, F.lit(False))
    values = {"status": F.lit(status), "started_at": F.coalesce("started_at", now) if "started_at" in rows.columns else None, "finished_at": now, "error_message": F.lit(None)}
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)).cast(rows.schema[k].dataType) for k, v in values.items() if k in rows.columns})


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first by `order`; found with partial aggregates, so no key's rows meet in one task.

    Orders compare upwards: give a descending number negated, or an instant as its negated microseconds.
    """
    found = rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row"))
    return found.select("__row.*")


def usable_contents(pages: DataFrame, contents: DataFrame, key: str, usable: Column, body: str) -> DataFrame:
    """pages with their contents on `key`: usable pages whose body is not blank."""
    return pages.filter(usable).join(contents.filter(F.coalesce(F.trim(body), F.lit("")) != ""), key)


def with_parent(rows: DataFrame, address: str, parent_address: str, key: str, name: str = "parent_id") -> DataFrame:
    """rows with the key of the row whose address is their parent's; null for a root or an unknown parent."""
    parents = rows.groupBy(F.col(address).alias(parent_address)).agg(F.min(key).alias(name))
    return rows.join(parents, parent_address, "left")


def with_existence(rows: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """rows with whether `other` has their key."""
    return rows.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def counters(rows: DataFrame, version: str) -> DataFrame:
    """One row: the version after the highest one, and how many rows there are."""
    return rows.agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"), F.count("*").alias("n"))


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return rows.filter(F.col(key) == value).limit(1)


def replace_content(contents: DataFrame, fresh: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One content a page: the last fresh one by `order` in place of all old ones, old ones of other pages as they were."""
    last = newest(fresh, [key], order).select(*contents.columns)
    return contents.join(last.select(key), key, "left_anti").select(*contents.columns).unionByName(last)
