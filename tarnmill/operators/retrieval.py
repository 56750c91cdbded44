"""Full-text ranking, vector search, tiers and hybrid results over knowledge entries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tarnmill.functions import text as T
from tarnmill.functions import vectors as V

K1, B = 1.2, 0.75
QUERY_BLOCK = 20_000  # queries of a vector search that are broadcast at once: some 20 MB at 128 dimensions
TOKEN = r"[\p{L}\p{N}]+"


def tokens(c: Column, shortest: int = 1) -> Column:
    """Runs of letters and digits, lower-cased; the index takes those of two characters or more."""
    found = F.regexp_extract_all(F.lower(T.text(c)), F.lit(TOKEN), F.lit(0))
    return found if shortest <= 1 else F.filter(found, lambda x: F.length(x) >= shortest)


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, line by line; a line without a token is a term itself."""
    import re

    out: dict[str, None] = {}
    for line in filter(None, (x.strip() for x in query.splitlines())):
        for term in re.findall(r"[^\W_]+", line.lower()) or [line.lower()]:
            out.setdefault(term)
    if not out:
        raise ValueError("query is required")
    return list(out)


#: Parts of speech that a query drops, that a query keeps as one letter, and that an index also takes in base form (fixed values).
DROPPED, SINGLE, INFLECTED = ("助詞", "助動詞", "記号"), ("名詞",), ("動詞", "形容詞")
MARKS = ("。", "、", ",", ".", "!", "?", "！", "？", "「", "」", "（", "）", "(", ")")
ANALYSED = "array<struct<surface:string,base:string,pos:string>>"


def analysed(rows: DataFrame, column: str, tokenize: Callable[[str], Sequence[tuple[str, str | None, str]]], name: str = "tokens") -> DataFrame:
    """rows with the tokens (surface, base form, part of speech) that a tokenizer finds in a text column; none in blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("surface", "base", "pos"), t, strict=True)) for t in tokenize(x)] if x and x.strip() else [] for x in batch.column(column).to_pylist()]
            kind = pa.list_(pa.struct([(k, pa.string()) for k in ("surface", "base", "pos")]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, name])

    return rows.mapInArrow(run, S.StructType([*rows.schema.fields, S.StructField(name, S.DataType.fromDDL(ANALYSED))]))


def _base(t: Column) -> Column:
    found = T.strip(t["base"])
    return F.when((found == "") | (found == "*"), T.strip(t["surface"])).otherwise(found)


def index_terms(tokens: Column) -> Column:
    """The distinct terms that an index takes of analysed tokens: surfaces of two letters or more, and the base forms of verbs and adjectives."""

    def terms(t: Column) -> Column:
        surface, base = T.strip(t["surface"]), _base(t)
        first = F.when((F.length(surface) >= 2) & ~surface.isin(*MARKS), surface)
        second = F.when(t["pos"].isin(*INFLECTED) & (F.length(base) >= 2) & (base != surface) & (surface != ""), base)
        return F.array_compact(F.array(first, second))

    return F.array_distinct(F.flatten(F.transform(tokens, terms)))


def asked_terms(tokens: Column) -> Column:
    """The distinct terms that a query asks for: base forms without particles, auxiliaries and symbols; of single letters only digits and nouns."""
    kept = F.filter(tokens, lambda t: (T.strip(t["surface"]) != "") & ~F.coalesce(t["pos"].isin(*DROPPED), F.lit(False)))
    kept = F.filter(kept, lambda t: (F.length(_base(t)) > 1) | _base(t).rlike(r"(?U)^\d$") | F.coalesce(t["pos"].isin(*SINGLE), F.lit(False)))
    return F.array_distinct(F.transform(kept, _base))


def search_text(*fields: Column) -> Column:
    """The distinct collapsed fields, then each field's distinct index tokens."""
    parts = F.array_distinct(F.filter(F.array(*[T.collapse(f) for f in fields]), lambda x: x != ""))
    found = F.flatten(F.array(*[F.array_distinct(tokens(T.collapse(f), 2)) for f in fields]))
    return F.array_join(F.concat(parts, found), " ")


#: Rows of a small table that a broadcast may hold; larger ones are shuffled or taken in blocks.
SMALL = 1 << 18


def small(df: DataFrame, most: int = SMALL) -> bool:
    return df.limit(most + 1).count() <= most


def build_index(entries: DataFrame, key: str, column: str, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """postings(term, key, tf, dl) and stats(n, avgdl) over all rows of entries.

    With terms(term), for an index that only serves some queries, other tokens are dropped before anything is summed.
    """
    listed = entries.select(key, tokens(F.col(column)).alias("terms")).withColumn("dl", F.size("terms"))
    each = listed.select(key, "dl", F.explode("terms").alias("term"))
    if terms is not None:
        wanted = terms.select("term").distinct()
        each = each.join(F.broadcast(wanted) if small(wanted) else wanted, "term", "left_semi")
    postings = each.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    return postings, listed.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(postings: DataFrame, stats: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) for terms(query_id, term): lower is better, as a rank column is sorted upwards.

    Document frequencies count once a term. Terms with their frequencies are as many as the queries have: where they are
    few they go to the postings, so a common term's postings stay where they are and are summed there first.
    """
    wanted = terms.distinct()
    few = small(wanted)
    chosen = wanted.select("term").distinct()
    found = postings.join(F.broadcast(chosen) if few else chosen, "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighed = wanted.join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    hits = found.join(F.broadcast(weighed) if few else weighed, "term")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", key).agg((-F.sum(idf * weight)).alias("score"))


def top(hits: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by `order`, numbered in rank."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def tiered(hits: DataFrame, by: list[str], strong: Column, weak: Column, order: list[Column], limit: int) -> DataFrame:
    """A group's strong rows if it has any, else its weak ones; never both. At most `limit` of them."""
    graded = hits.withColumn("tier", F.when(strong, 1).when(weak, 2)).filter("tier is not null")
    best = graded.withColumn("best", F.min("tier").over(Window.partitionBy(*by))).filter("tier = best").drop("best")
    return top(best.drop("rank"), by, order, limit)


def vector_hits(queries: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score): cosine of every entry's embedding with each of queries(query_id, vector); invalid pairs are left out.

    Queries are taken in blocks of about QUERY_BLOCK, each broadcast over the entries, so what is broadcast is bounded
    whatever their number.
    """
    asked = queries.select("query_id", "vector")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(blocks))
    parts = [entries.select(key, "embedding").crossJoin(F.broadcast(asked.filter(block == b))) for b in range(blocks)]
    pairs = reduce(DataFrame.unionByName, parts)
    return pairs.select("query_id", key, V.cosine(F.col("vector"), F.col("embedding")).alias("score")).filter("score >= 0")


DEFAULTS: dict[str, dict[str, float]] = {
    "qa_similarity": {"strong_threshold": 0.8, "weak_threshold": 0.4, "top_k": 5},
    "fts": {"strong_bm25_max": -4.5, "weak_bm25_max": -2.0, "top_k": 10},
    "hybrid": {"qa_top_k": 5, "fts_top_k": 5, "top_k": 10},
}


def search_config(override: Mapping[str, Any] | None = None) -> dict[str, dict[str, float]]:
    """The defaults with an override laid over them; non-numbers fall back, and thresholds out of order are swapped."""
    out = {}
    for section, values in DEFAULTS.items():
        given = (override or {}).get(section) or {}
        out[section] = {}
        for name, value in values.items():
            try:
                out[section][name] = type(value)(given.get(name, value))
            except (TypeError, ValueError):
                out[section][name] = value
            if name == "top_k" or name.endswith("_top_k"):
                out[section][name] = max(0, out[section][name])
    qa, fts = out["qa_similarity"], out["fts"]
    qa["weak_threshold"], qa["strong_threshold"] = sorted((qa["weak_threshold"], qa["strong_threshold"]))
    fts["strong_bm25_max"], fts["weak_bm25_max"] = sorted((fts["strong_bm25_max"], fts["weak_bm25_max"]))
    return out


def search_plain(entries: DataFrame, index: Any, terms: DataFrame, config: dict, limit: int | None = None) -> DataFrame:
    """Plain entries that match a query, best tier only. index is a stored one, or (postings, stats)."""
    fts = config["fts"]
    most = max(fts["top_k"], config["hybrid"]["fts_top_k"])
    if isinstance(index, tuple):
        scores = bm25(*index, terms, "entry_id")
    else:
        from tarnmill.operators import search_index  # which builds on this module

        scores = search_index.search(index, terms, most, "plain")[0].withColumnRenamed("key", "entry_id")
    found = scores.join(entries.filter("knowledge_type = 'plain'"), "entry_id")
    order = [F.col("score"), F.col("sort_no"), F.col("created_at").desc(), F.col("entry_id")]
    hits = top(found, ["query_id"], order, most)
    return tiered(hits, ["query_id"], F.col("score") <= fts["strong_bm25_max"], F.col("score") <= fts["weak_bm25_max"], order, limit or fts["top_k"]).withColumn("result_kind", F.lit("plain"))


def search_qa(entries: DataFrame, queries: DataFrame, config: dict, limit: int | None = None, vectors: Any = None) -> DataFrame:
    """Question and answer entries near a query, best tier only. vectors: the cells (metric) of their embeddings, if there are any."""
    qa = config["qa_similarity"]
    held = entries.filter("knowledge_type = 'qa'")
    most = max(qa["top_k"], config["hybrid"]["qa_top_k"], 10)
    if vectors is None:
        near = vector_hits(queries, held.filter("embedding is not null"), "entry_id")
    else:
        from tarnmill.operators import metric

        near = metric.search(vectors, queries, most)[0].withColumnRenamed("id", "entry_id")
    found = near.join(held, "entry_id")
    order = [F.col("score").desc(), F.col("entry_id")]
    hits = top(found, ["query_id"], order, most)
    return tiered(hits, ["query_id"], F.col("score") >= qa["strong_threshold"], F.col("score") >= qa["weak_threshold"], order, limit or qa["top_k"]).withColumn("result_kind", F.lit("qa"))


def hybrid(qa: DataFrame, plain: DataFrame, k: int) -> DataFrame:
    """qa results, then plain ones, cut to k for each query (0: all); scores are not mixed."""
    both = qa.unionByName(plain, allowMissingColumns=True)
    order = [F.when(F.col("result_kind") == "qa", 0).otherwise(1), F.col("rank")]
    placed = both.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return placed.filter(F.col("position") <= k) if k > 0 else placed


def context(results: DataFrame, most_items: int = 8, most_chars: int = 1200) -> DataFrame:
    """(query_id, context): numbered, labelled blocks of a query's results for a prompt."""
    body = F.substring(T.first_text([T.strip(F.col("answer")), T.strip(F.col("content"))], ""), 1, most_chars)
    label = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    source = F.concat_ws(" / ", T.text(F.col("source_type")), T.text(F.col("source_label")))
    score = F.when(F.col("result_kind") == "qa", F.format_string("類似度: %.4f", F.col("score"))).otherwise(F.format_string("bm25: %.6f", F.col("score")))
    lines = [F.format_string("[候補%d]", F.col("position")), label("種別", F.col("result_kind")), label("質問", T.strip(F.col("question"))), label("本文", body), F.when(source != " / ", F.concat(F.lit("情報源: "), source)), score]
    blocks = results.filter(F.col("position") <= most_items).select("query_id", F.struct("position", F.concat_ws("\n", *lines).alias("block")).alias("b"))
    return blocks.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("b"))["block"], "\n\n").alias("context"))


NOTHING_FOUND = "No result was found to answer from."


def search(spark: SparkSession, entries: DataFrame, query: str, mode: str, config: Mapping[str, Any] | None = None, embed: Callable[[str], list[float]] | None = None, answer: Callable[[str, str], str] | None = None, index: Any = None) -> DataFrame:
    """One query in the mode plain_fts, qa, hybrid, hybrid_ai or ai_answer.

    index is a stored full-text index of the entries; without one, the query's own terms are indexed as it runs. embed gives a query's vector, answer a reply to (query, context); neither is needed by plain_fts.
    """
    settings = search_config(config)
    if mode == "ai_answer":
        return spark.createDataFrame([("q", answer(query, "") if answer else NOTHING_FOUND)], "query_id string, answer string")
    terms = spark.createDataFrame([("q", t) for t in query_terms(query)], "query_id string, term string")
    index = index or build_index(entries, "entry_id", "search_text", terms)
    if mode == "plain_fts":
        return search_plain(entries, index, terms, settings)
    if embed is None:
        raise ValueError(f"mode {mode} needs an embedder")
    vector = spark.createDataFrame([("q", [float(x) for x in embed(query)])], "query_id string, vector array<double>")
    if mode == "qa":
        return search_qa(entries, vector, settings)
    if mode not in ("hybrid", "hybrid_ai"):
        raise ValueError(f"unknown mode: {mode}")
    merged = hybrid(search_qa(entries, vector, settings, settings["hybrid"]["qa_top_k"]), search_plain(entries, index, terms, settings, settings["hybrid"]["fts_top_k"]), settings["hybrid"]["top_k"])
    if mode == "hybrid":
        return merged
    found = context(merged).first()
    reply = NOTHING_FOUND if found is None or answer is None else answer(query, found.context)
    return spark.createDataFrame([("q", reply)], "query_id string, answer string")
