"""A stored full-text index: postings in blocks by document range, appended by delta, read with block maxima.

An index is a folder of segments. A segment numbers its documents and holds three tables: documents (number, key, kind),
terms (term, df) and blocks, sorted by term in each file: the postings of a term in one range of documents, with the greatest
term frequency and the least document length among them. A segment counts once its stats are there, which are written last; a
segment of a name that counts is not written again, so a delta that is sent twice, or broke off, does no harm.

A search reads the blocks' maxima first, which bound what a document of a range can score for a query. The most promising
ranges are scored in full, the k-th best of their scores is the threshold, and only ranges whose bound reaches it are read
then. Nothing is lost: a skipped document's score is below the k-th best by more than `slack`.

Blocks are moved once for all queries: those of SPAN ranges meet the queries in one task, which adds scores up in arrays and
gives each query's k best on, so neither a posting nor a score of a document travels once a query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.operators import retrieval
from tarnmill.operators.staging import exists, stage, written

RANGE = 64  # documents of a block at most
SPAN = 32  # ranges that meet the queries in one task
SEEDS = 4  # ranges of a query that are scored before the threshold is known


@dataclass
class Index:
    """The counted segments of a stored index; segment is a column of each table but stats, which has one row."""

    documents: DataFrame
    terms: DataFrame
    blocks: DataFrame
    stats: DataFrame

    def postings(self) -> DataFrame:
        """(term, key, dl, tf), the index written out, as retrieval.build_index gives it."""
        each = self.blocks.select("segment", "term", "block", F.explode("postings").alias("p")).select("segment", "term", F.col("p.doc").alias("doc"), F.col("p.dl").alias("dl"), F.col("p.tf").cast("long").alias("tf"))
        return each.join(self.documents, ["segment", "doc"]).select("term", "key", "dl", "tf")


def segments(spark: SparkSession, path: str) -> list[str]:
    """Names of the segments that count; a segment is a batch of entries, so they are as many as the batches were."""
    if not exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName().removeprefix("segment=") for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(name for name in names if exists(spark, f"{path}/segment={name}/stats/_SUCCESS"))


def posted(rows: pa.Table) -> pa.Table:
    """The blocks of one range of documents, rows(block, doc, tokens)."""
    rows = rows.sort_by("doc")
    held = rows.column("tokens").combine_chunks()
    lengths = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    words = held.flatten().dictionary_encode()
    both, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(lengths) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    term, row = both // len(lengths), both % len(lengths)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    dl, least, most = lengths[row], np.minimum.reduceat, np.maximum.reduceat
    posting = pa.StructArray.from_arrays([pa.array(rows.column("doc").to_numpy()[row]), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())], ["doc", "tf", "dl"])
    ends = np.append(first, len(both))
    shape = [most(tf, first), least(dl, first)] if len(first) else [first, first]
    return pa.table({"term": words.dictionary, "block": np.full(len(first), rows.column("block")[0].as_py()), "n": pa.array(np.diff(ends), pa.int32()), "max_tf": pa.array(shape[0], pa.int32()), "min_dl": pa.array(shape[1], pa.int32()), "postings": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), posting)})


def append(entries: DataFrame, path: str, segment: str, key: str, column: str, kind: str | None = None, range_docs: int = RANGE) -> bool:
    """Adds entries(key, column[, kind]) to the index at path as a segment; False if that segment is there already.

    Null texts have no terms and count as documents. Keys are kept as text.
    """
    spark = entries.sparkSession
    if segment in segments(spark, path):
        return False
    to = f"{path}/segment={segment}"
    rows = entries.select(F.col(key).alias("key"), (F.col(kind) if kind else F.lit(None)).cast("string").alias("kind"), retrieval.tokens(F.col(column)).alias("tokens"))
    listed = written(rows, "doc").withColumns({"dl": F.size("tokens"), "block": F.floor(F.col("doc") / range_docs)})
    listed.select("doc", "key", "kind", "block").write.mode("overwrite").parquet(f"{to}/documents")
    blocks = listed.select("block", "doc", "tokens").groupBy("block").applyInArrow(posted, "term string, block long, n int, max_tf int, min_dl int, postings array<struct<doc:long,tf:int,dl:int>>")
    blocks.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{to}/blocks")
    stored = spark.read.parquet(f"{to}/blocks")
    stored.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{to}/terms")
    listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total")).write.mode("overwrite").parquet(f"{to}/stats")
    return True


def open_index(spark: SparkSession, path: str) -> Index:
    found = segments(spark, path)
    if not found:
        raise ValueError(f"no index at {path}")

    def table(name: str) -> DataFrame:
        parts = [spark.read.parquet(f"{path}/segment={s}/{name}").withColumn("segment", F.lit(s)) for s in found]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    totals = table("stats").agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("avgdl"))
    documents = table("documents")
    if "block" not in documents.columns:  # of an index that was stored before they had it
        documents = documents.withColumn("block", F.floor(F.col("doc") / RANGE))
    return Index(documents, table("terms"), table("blocks"), totals)


def weight(tf: Column, dl: Column) -> Column:
    """A term's share in a score but for its idf: it grows with tf and falls with dl, so maxima of one and minima of the other bound it."""
    k, b = retrieval.K1, retrieval.B
    return tf * (k + 1) / (tf + k * (1 - b + b * dl / F.col("avgdl")))


def weighed(index: Index, terms: DataFrame) -> DataFrame:
    """terms(query_id, term) with idf and avgdl; what is in no document goes."""
    wanted = terms.select("query_id", "term").distinct()
    chosen = wanted.select("term").distinct()
    df = index.terms.join(F.broadcast(chosen) if retrieval.small(chosen) else chosen, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return wanted.join(df, "term").crossJoin(F.broadcast(index.stats)).select("query_id", "term", idf.alias("idf"), "avgdl")  # stats is one row


def wanted(index: Index, asked: DataFrame) -> DataFrame:
    """The blocks of the terms that are asked for."""
    chosen = asked.select("term").distinct()
    return index.blocks.join(F.broadcast(chosen) if retrieval.small(chosen) else chosen, "term", "left_semi").withColumn("span", F.floor(F.col("block") / SPAN))


def together(asked: DataFrame) -> DataFrame:
    """A row a query: query_id, avgdl and its terms with their idf."""
    return asked.groupBy("query_id", "avgdl").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("asked"))


def by_term(x: pa.Table, counts: np.ndarray) -> tuple[dict[str, slice], np.ndarray]:
    """Where each term's postings lie once they are put in the order that is given as well; a row of x has counts postings."""
    codes = pc.dictionary_encode(x.column("term").combine_chunks())
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    of = np.repeat(codes.indices.to_numpy(), counts)
    ends = np.cumsum(np.bincount(of, minlength=len(codes.dictionary)))
    return {t: slice(int(e - n), int(e)) for t, e, n in zip(codes.dictionary.to_pylist(), ends, np.diff(ends, prepend=0), strict=True)}, np.argsort(of, kind="stable")


def sums(asked: list[dict], lies: dict[str, slice], at: np.ndarray, shares: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What a query's terms add up to at each of `size` places, and how many terms each place has."""
    total, n = np.zeros(size), np.zeros(size, np.int64)
    for one in asked:
        part = lies.get(one["term"])
        if part is not None:  # a term has a place once
            total[at[part]] += one["idf"] * shares[part]
            n[at[part]] += 1
    return total, n


def share(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """weight, of arrays."""
    k, b = retrieval.K1, retrieval.B
    return tf * (k + 1) / (tf + k * (1 - b + b * dl / avgdl))


def bounds(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, segment, block, bound, blocks): what a document of a range scores at most, and how many blocks that is."""
    meta = wanted(index, asked).select("segment", "span", "term", "block", "max_tf", "min_dl")
    queries = meta.select(F.col("segment").alias("of"), F.col("span").alias("at")).distinct().crossJoin(together(asked))

    def bound(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if x.num_rows and y.num_rows:
            lies, order = by_term(x, np.ones(x.num_rows, np.int64))
            blocks, at = np.unique(x.column("block").to_numpy()[order], return_inverse=True)
            shares = share(x.column("max_tf").to_numpy()[order], x.column("min_dl").to_numpy()[order], y.column("avgdl")[0].as_py())
            for i, terms in enumerate(y.column("asked").to_pylist()):
                total, n = sums(terms, lies, at, shares, len(blocks))
                met = np.flatnonzero(n)
                found.append((np.full(len(met), i), blocks[met], total[met], n[met]))
        rows, block, most, n = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        return pa.table({"query_id": y.column("query_id").take(pa.array(rows, pa.int64())), "segment": pa.array([key[0].as_py()] * len(rows), pa.string()), "block": pa.array(block, pa.int64()), "bound": pa.array(most, pa.float64()), "blocks": pa.array(n, pa.int64())})

    kind = asked.schema["query_id"].dataType.simpleString()
    return meta.groupBy("segment", "span").cogroup(queries.groupBy("of", "at")).applyInArrow(bound, f"query_id {kind}, segment string, block long, bound double, blocks long")


def scored(index: Index, asked: DataFrame, ranges: DataFrame, kind: str | None, k: int, kth: DataFrame | None = None, slack: float = 1e-6) -> DataFrame:
    """(query_id, key, score) that hold the k best, ties included, of the documents of ranges(query_id, segment, block); lower is better.

    kth(query_id, threshold) says what the k-th best has at least, where that is known.
    """
    named = index.documents if kind is None else index.documents.filter(F.col("kind") == kind)
    places = ranges.select("segment", "block").distinct()
    near = (lambda rows: rows.join(F.broadcast(places), ["segment", "block"], "left_semi")) if retrieval.small(places) else (lambda rows: rows)  # noqa: E731  else nearly all are read
    held = near(wanted(index, asked)).select("segment", "span", "term", "block", "postings")
    if kind is not None:  # the documents that may be hits, as blocks without a term
        post = index.blocks.schema["postings"].dataType.elementType
        own = near(named).groupBy("segment", "block").agg(F.collect_list(F.struct("doc", *[F.lit(0).cast(post[c].dataType).alias(c) for c in ("tf", "dl")])).alias("postings"))
        held = held.unionByName(own.select("segment", F.floor(F.col("block") / SPAN).alias("span"), F.lit(None).cast("string").alias("term"), "block", "postings"))
    spans = ranges.groupBy(F.col("segment").alias("of"), F.floor(F.col("block") / SPAN).alias("at"), "query_id").agg(F.collect_list("block").alias("blocks"))
    queries = spans.join(together(asked), "query_id")
    queries = queries.join(kth, "query_id", "left") if kth is not None else queries.withColumn("threshold", F.lit(None).cast("double"))

    def score(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        found: list[tuple] = []
        named_here = x.filter(pc.is_null(x.column("term")))
        x = x.filter(pc.is_valid(x.column("term")))
        if x.num_rows and y.num_rows:
            lists = x.column("postings").combine_chunks()
            flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            lies, order = by_term(x, counts)
            field = lambda name: flat.field(name).to_numpy(zero_copy_only=False)[order]
            docs, first, at = np.unique(field("doc"), return_index=True, return_inverse=True)
            block = np.repeat(x.column("block").to_numpy(), counts)[order][first]
            shares = share(field("tf"), field("dl"), y.column("avgdl")[0].as_py())
            free = np.ones(len(docs), bool) if kind is None else np.isin(docs, named_here.column("postings").combine_chunks().flatten().field("doc").to_numpy(zero_copy_only=False)) if named_here.num_rows else np.zeros(len(docs), bool)
            for i, (terms, blocks, least) in enumerate(zip(*(y.column(c).to_pylist() for c in ("asked", "blocks", "threshold")), strict=True)):
                total, n = sums(terms, lies, at, shares, len(docs))
                met = np.flatnonzero((n > 0) & free & np.isin(block, blocks) & (total >= (-np.inf if least is None else least - slack)))
                if len(met) > k:
                    met = met[total[met] >= np.partition(total[met], -k)[-k] - slack]
                found.append((np.full(len(met), i), docs[met], -total[met]))
        rows, doc, low = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": y.column("query_id").take(pa.array(rows, pa.int64())), "segment": pa.array([key[0].as_py()] * len(rows), pa.string()), "doc": pa.array(doc, pa.int64()), "score": pa.array(low, pa.float64())})

    of = asked.schema["query_id"].dataType.simpleString()
    hits = held.groupBy("segment", "span").cogroup(queries.groupBy("of", "at")).applyInArrow(score, f"query_id {of}, segment string, doc long, score double")
    return hits.join(named, ["segment", "doc"]).select("query_id", "key", "score")


def search(index: Index, terms: DataFrame, k: int, kind: str | None = None, seeds: int = SEEDS, slack: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, key, score) that hold each query's k best, ties included, and its report (query_id, blocks, skipped).

    Hits may hold some that are worse; the caller orders and cuts. With `kind`, only documents of that kind are hits, and
    all of them count for the frequencies.
    """
    asked = stage(weighed(index, terms), "asked")
    ranges = stage(bounds(index, asked), "bounds")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment", "block"))
    first = stage(ranges.withColumn("place", place).filter(F.col("place") <= seeds), "first")
    found = scored(index, asked, first, kind, k, slack=slack)
    kth = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("score"))).filter(F.col("place") == k).select("query_id", (-F.col("score")).alias("threshold"))
    kth = stage(kth, "thresholds")
    judged = ranges.join(kth, "query_id", "left").withColumn("read", F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - slack))
    report = judged.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("read"), 0).otherwise(F.col("blocks"))).alias("skipped"))
    return stage(scored(index, asked, judged.filter("read"), kind, k, kth, slack), "hits"), report
