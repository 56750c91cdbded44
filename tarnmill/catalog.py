"""Queries of the library's operators over the synthetic tables, each with its SQL twin.

Stand-ins: documents are contents and plain entries (source is the job item, doc_id the order), conversations are speech
and question and answer pairs, benchmark texts are search queries, pages are crawled pages, orders and lineitem are
parents and children, events are chunk states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.functions import html, scoring, urls
from tarnmill.functions import text as T
from tarnmill.functions import vectors as V
from tarnmill.operators import chunking, jobs, metric, neardup, refine, relational, retrieval, search_index, splitting, staging
from tarnmill.plans import page_scoring
from tarnmill.registry import QUERIES, SQL, query, t  # noqa: F401
from tarnmill.sources import readers, sinks
from tarnmill.streaming import progress

W = T.WS_RE2


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r02_bm25(spark, sf_dir)


# Text

def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


CLEAN = sql_strip(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(65279), ''), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\d{20,}', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)


@query(f"""
SELECT doc_id, md5(trim(regexp_replace(text, '{W}+', ' ', 'g'))) AS collapsed,
  md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {sql_strip("x")}), lambda x: x <> ''), chr(10))) AS lines,
  md5({sql_strip("text")}) AS stripped, md5({CLEAN}) AS cleaned,
  md5({sql_strip(r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(65279), ''), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+', ' ', 'g')")}) AS cell
FROM documents""")
def c01_c05_text_cleaning(spark, sf_dir):
    c = F.col("text")
    forms = {"collapsed": T.collapse(c), "lines": T.trim_lines(c), "stripped": T.strip(c), "cleaned": T.clean_text(c), "cell": T.clean_cell(c)}
    return t(spark, sf_dir, "documents").select("doc_id", *[F.md5(v).alias(k) for k, v in forms.items()])


@query(f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip("x")}), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*\\d+[\\.\\)]\\s+'))) AS INTEGER) AS numbered,
  CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(?i)^\\s*(q|question|問い|質問|a|answer|回答|答え)[:：]\\s*'))) AS INTEGER) AS marked,
  CAST(len(ls) AS INTEGER) AS line_count FROM l""")
def c10_c14_markers_and_lines(spark, sf_dir):
    numbered, marked = T.marker_counts(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", numbered.alias("numbered"), marked.alias("marked"), T.line_count(F.col("text")).alias("line_count"))


@query(f"""
WITH c AS (SELECT doc_id, {CLEAN} AS x FROM documents), p AS (SELECT doc_id, unnest(string_split_regex(x, '\\n\\s*\\n')) AS p, generate_subscripts(string_split_regex(x, '\\n\\s*\\n'), 1) AS i FROM c),
  k AS (SELECT doc_id, i, {sql_strip("p")} AS body FROM p WHERE {sql_strip("p")} <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS index, substr({sql_strip("string_split(body, chr(10))[1]")}, 1, 80) AS title, md5(body) AS body, CAST(length(body) AS INTEGER) AS char_count FROM k""")
def c13_s11_paragraph_records(spark, sf_dir):
    """Every document of the tables is plain paragraphs; the other splitters have golden tests."""
    found = splitting.split_paragraphs(t(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text")), "doc_id")
    return found.select("doc_id", "index", "title", F.md5("text").alias("body"), "char_count")


@query("""
SELECT conv_id, md5('Q: ' || string_agg(CASE WHEN role = 'user' THEN replace(text, chr(10), ' ') END, chr(10) || 'Q: ' ORDER BY turn)) AS questions, count(*) FILTER (role = 'user') AS n
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0""")
def c12_question_blocks(spark, sf_dir):
    """Conversations written out as marked lines, split back into question and answer records."""
    turns = t(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")
    line = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), F.replace("text", F.lit("\n"), F.lit(" ")))
    texts = turns.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))["line"], "\n").alias("text"))
    found = splitting.split_qa(texts, "conv_id").filter("question <> ''")
    blocks = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("index", "question"))).alias("qs"))
    return blocks.select("conv_id", F.md5(F.array_join(F.transform("qs", lambda q: F.concat(F.lit("Q: "), q["question"])), "\n")).alias("questions"), F.size("qs").cast("long").alias("n"))


@query(f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT doc_id, list_transform(ls, lambda x: {sql_strip("regexp_replace(" + sql_strip("x") + ", '^\\[\\d+\\]\\s*', '')")}) AS ls FROM l)
SELECT doc_id, CAST(len(list_filter(ls, lambda x: x = '' OR regexp_matches(x, '^\\d{{1,4}}$') OR regexp_matches(x, '(?i)^[ivxlcdm]+$') OR regexp_matches(x, '(?i)\\.indd'))) AS INTEGER) AS noise FROM n""")
def c06_f11_noise_lines(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), T.pdf_line)
    return t(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, T.is_noise_line)).alias("noise"))


@query(f"""
SELECT doc_id, ({sql_strip("text")} = '' OR (length({sql_strip("text")}) <= 20 AND regexp_matches({sql_strip("text")}, '^[\\p{{L}}\\p{{N}}_・。．、，\\-\\s]+$')) OR regexp_matches(text, '[\\.．・]{{4,}}|…{{2,}}')) AS skipped,
  md5({sql_strip("regexp_replace(" + sql_strip("regexp_replace(" + sql_strip("text") + ", '^\\[\\d+\\]\\s*', '')") + ", '\\s{2,}', ' ', 'g')")}) AS chunk_input
FROM documents""")
def c08_f10_chunk_input(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", T.is_front_matter(F.col("text")).alias("skipped"), F.md5(T.chunk_input(F.col("text"))).alias("chunk_input"))


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment <> '' THEN c_mktsegment || ' / ' || c_name ELSE c_name END AS logical_name,
  'name: ' || c_name || ' | segment: ' || c_mktsegment AS cells, substr(trim(c_name), 1, 120) AS title, 'Speaker: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment AS speech
FROM customer""")
def c09_c19_c20_c23_names_and_labels(spark, sf_dir):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    cells = T.pairs_text(F.create_map(F.lit("name"), name, F.lit("segment"), segment))
    return t(spark, sf_dir, "customer").select("c_custkey", T.logical_name(segment, name, F.col("c_custkey")).alias("logical_name"), cells.alias("cells"), T.title_of(F.lit(None), name).alias("title"), T.labelled([("Speaker", name), ("Segment", segment)]).alias("speech"))


# Addresses and pages

NORM = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)', 2))"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"


@query(rf"""
WITH u AS (SELECT page_id, url, {NORM} AS head, {PATH} AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, head || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/$', '') END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS normal,
  NOT regexp_matches(lower(url), '\.({"|".join(urls.NOT_PAGES)})$') AS is_page, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext,
  string_split(path, '/')[-1] AS base_name,
  '/' || array_to_string((CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 2 THEN list_filter(string_split(path, '/'), lambda x: x <> '') ELSE list_filter(string_split(path, '/'), lambda x: x <> '')[:-2] END), '/') AS prefix
FROM u""")
def h01_h03_h12_c16_c17_addresses(spark, sf_dir):
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", urls.normalise(u).alias("normal"), urls.is_page(u).alias("is_page"), T.extension(u).alias("ext"), T.base_name(u).alias("base_name"), urls.prefix(u).alias("prefix"))


@query()
def h04_h09_page_features(spark, sf_dir):
    found = html.features(html.blocks(t(spark, sf_dir, "pages"), "page_id"), "page_id")
    return found.select("page_id", "title", F.md5("text").alias("text_md5"), "text_length", "link_count", "short_line_ratio", "heading_count", "paragraph_count", "block_count", "link_only_block_ratio", "nav_like_block_ratio")


@query()
def h02_h10_h13_h14_o06_child_links(spark, sf_dir):
    """Links of each page on its own domain, in the order in which a crawl takes them."""
    pages = t(spark, sf_dir, "pages")
    found = html.links(pages, "page_id").join(pages.select("page_id", urls.normalise(F.col("url")).alias("current")), "page_id")
    found = found.filter(urls.same_domain(F.col("link"), F.col("current")) & (F.col("link") != F.col("current")) & urls.is_page(F.col("link")))
    scored = found.withColumn("priority", urls.child_priority(F.col("link"), F.col("current"), F.col("current"), ["article"], ["login"]))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("priority").desc(), "at"))).select("page_id", "link", "priority", "rank")


SCORING = page_scoring.checked_scoring(
    {
        "base_score": 20, "keyword_cap": 30, "filter_mode": "score_only", "default_decision": "reject",
        "rules": {"title_keywords": {"the": 10}, "body_keywords": {"license": 15, "und": 10, "that": 10}, "url_keywords": {"src1": 5}},
        "thresholds": {"min_text_length": {"lt": 200, "score": -20}, "text_length_bonus": [{"gte": 1000, "score": 15}, {"gte": 5000, "score": 10}], "short_line_ratio": [{"gte": 0.5, "score": -10}]},
        "structure_rules": {"paragraph_count": [{"gte": 5, "score": 10}], "text_density": [{"gte": 3000, "score": 5}]},
        "decisions": {"pass": {"gte": 60}, "review": {"gte": 40, "lt": 60}, "reject": {"lt": 40}},
    }
)


@query("""
WITH l AS (SELECT doc_id, source, text, list_filter(list_transform(string_split_regex(text, '[。\\n\\r]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS ls, string_split(text, chr(10))[1] AS title FROM documents),
f AS (SELECT doc_id, source, text, title, length(text) AS n, len(string_split(text, chr(10))) AS paras, CASE WHEN len(ls) > 0 THEN round(len(list_filter(ls, lambda x: length(x) <= 20)) / len(ls), 4) ELSE 0.0 END AS short FROM l),
s AS (SELECT doc_id, short, 20 + least(30, CASE WHEN contains(lower(title), 'the') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 15 ELSE 0 END + CASE WHEN contains(lower(text), 'und') THEN 10 ELSE 0 END
  + CASE WHEN contains(lower(text), 'that') THEN 10 ELSE 0 END + CASE WHEN contains(lower(source), 'src1') THEN 5 ELSE 0 END)
  + CASE WHEN n < 200 THEN -20 ELSE 0 END + CASE WHEN n >= 1000 THEN 15 ELSE 0 END + CASE WHEN n >= 5000 THEN 10 ELSE 0 END + CASE WHEN short >= 0.5 THEN -10 ELSE 0 END + CASE WHEN paras >= 5 THEN 10 ELSE 0 END + CASE WHEN n >= 3000 THEN 5 ELSE 0 END AS raw FROM f)
SELECT doc_id, short AS short_line_ratio, CAST(greatest(0, least(100, raw)) AS INTEGER) AS score, CASE WHEN raw >= 60 THEN 'pass' WHEN raw >= 40 THEN 'review' ELSE 'reject' END AS decision, CASE WHEN raw >= 40 THEN 1 ELSE 0 END AS is_usable FROM s""")
def h11_h15_h19_page_scoring(spark, sf_dir):
    short = scoring.short_line_ratio(F.col("text"))
    zero = F.lit(0.0)
    features = {"text_length": F.length("text"), "link_count": F.lit(0), "short_line_ratio": F.col("short_line_ratio"), "heading_count": F.lit(0), "paragraph_count": F.size(F.split("text", "\n")), "link_only_block_ratio": zero, "nav_like_block_ratio": zero}
    docs = t(spark, sf_dir, "documents").withColumn("short_line_ratio", short)
    found = scoring.judge(SCORING, url=F.col("source"), title=F.substring_index("text", "\n", 1), text=F.col("text"), features=features)
    return docs.select("doc_id", "short_line_ratio", *[v.alias(k) for k, v in found.items()])


# Vectors

COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


VECTORS: dict[tuple[str, str], str] = {}


def vector_index(spark: SparkSession, sf_dir: str) -> metric.Cells:
    """The stored cells of all embeddings, built by the first search that asks for them."""
    held = (spark.sparkContext.applicationId, sf_dir)
    if held not in VECTORS or not staging.exists(spark, f"{VECTORS[held]}/rows/_SUCCESS"):
        path = f"{neardup.stage_dir(spark)}/vectors-{uuid.uuid4().hex}"
        metric.write_index(metric.partition(t(spark, sf_dir, "embeddings"), "vec_id", "embedding"), path)
        VECTORS[held] = path
    return metric.open_index(spark, VECTORS[held])


@query(f"WITH {VEC} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS INTEGER) AS rank FROM v a, v b WHERE a.vec_id % 50 = 0 AND {COS} >= 0) WHERE rank <= 10")
def r04_c29_j06_o03_vector_search(spark, sf_dir):
    """Every fiftieth vector as a query against all vectors."""
    vectors = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near, _ = metric.search(vector_index(spark, sf_dir), queries, 10)
    hits = retrieval.top(near.withColumnRenamed("id", "vec_id"), ["query_id"], [F.col("score").desc(), F.col("vec_id")], 10)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {VEC}, h AS (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
g AS (SELECT *, CASE WHEN score >= 0.4 THEN 1 WHEN score >= 0.3 THEN 2 END AS tier FROM h), k AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM g WHERE tier IS NOT NULL)
SELECT query_id, vec_id, CAST(tier AS INTEGER) AS tier, round(score, 6) AS score FROM k WHERE tier = best""")
def r05_f13_similarity_tiers(spark, sf_dir):
    vectors = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near, _ = metric.search(vector_index(spark, sf_dir), queries, least=0.3)
    hits = near.withColumnRenamed("id", "vec_id").filter("query_id <> vec_id")
    found = retrieval.tiered(hits, ["query_id"], F.col("score") >= 0.4, F.col("score") >= 0.3, [F.col("score").desc(), F.col("vec_id")], 1 << 30)
    return found.select("query_id", "vec_id", "tier", F.round("score", 6).alias("score"))


@query("WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM e GROUP BY label, i")
def a10_mean_vectors(spark, sf_dir):
    means = V.group_mean(t(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", F.round("x", 6).alias("mean"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def c28_vector_text(spark, sf_dir):
    """Vectors written as JSON text and parsed back."""
    parsed = V.parse(F.to_json("embedding"))
    total = F.aggregate(parsed, F.lit(0.0), lambda s, x: s + x)
    return t(spark, sf_dir, "embeddings").select("vec_id", F.size(parsed).alias("dims"), F.round(total, 4).alias("total"))


# Full text

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BM25 = f"""
tok AS (SELECT doc_id, {TOKENS} AS ts FROM documents), d AS (SELECT doc_id, len(ts) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.item_id AS query_id, p.doc_id, -sum(greatest(ln((st.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * d.dl / st.avgdl))) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN d ON d.doc_id = p.doc_id CROSS JOIN st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), doc_id) AS rank FROM s)"""


#: Where the documents' index of a session and a folder of tables lies, so that all searches share one build.
INDEXES: dict[tuple[str, str], str] = {}


def document_index(spark: SparkSession, sf_dir: str) -> search_index.Index:
    """The stored full-text index of all documents, built by the first search that asks for it."""
    held = (spark.sparkContext.applicationId, sf_dir)
    if held not in INDEXES or not search_index.segments(spark, INDEXES[held]):
        path = f"{neardup.stage_dir(spark)}/documents-index-{uuid.uuid4().hex}"
        search_index.append(t(spark, sf_dir, "documents"), path, "all", "doc_id", "text", "lang")
        INDEXES[held] = path
    return search_index.open_index(spark, INDEXES[held])


def item_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(retrieval.tokens(F.col("text"))).alias("term"))


def bm25_scores(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, doc_id, score) that hold the k best documents of each benchmark text, from the stored index."""
    hits, _ = search_index.search(document_index(spark, sf_dir), item_terms(spark, sf_dir), k)
    return hits.select("query_id", F.col("key").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def r02_bm25(spark, sf_dir):
    """The ten best documents for each benchmark text: R01, R02, C27, J04, O02."""
    return retrieval.top(bm25_scores(spark, sf_dir, 10), ["query_id"], [F.col("score"), F.col("doc_id")], 10)


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, true AS some_skipped FROM r WHERE rank <= 3")
def r01_k11_index_by_deltas(spark, sf_dir):
    """The index appended in three deltas, one of them sent twice; whether the block maxima let blocks be skipped."""
    path, docs = f"{neardup.stage_dir(spark)}/delta-index-{uuid.uuid4().hex}", t(spark, sf_dir, "documents")
    for delta in (0, 1, 2, 1):
        search_index.append(docs.filter(F.pmod(F.hash("doc_id"), F.lit(3)) == delta), path, f"delta-{delta}", "doc_id", "text")
    hits, report = search_index.search(search_index.open_index(spark, path), item_terms(spark, sf_dir), 3)
    best = retrieval.top(hits.withColumns({"doc_id": F.col("key").cast("long"), "score": F.round("score", 6)}), ["query_id"], [F.col("score"), F.col("doc_id")], 3)
    skipped = report.agg((F.sum("skipped") > 0).alias("some_skipped"))
    return best.select("query_id", "doc_id", "score", "rank").crossJoin(F.broadcast(skipped))  # one row


@query(f"""WITH {BM25}, g AS (SELECT *, CASE WHEN round(score, 6) <= -60 THEN 1 WHEN round(score, 6) <= -20 THEN 2 END AS tier FROM r WHERE rank <= 10), k AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM g WHERE tier IS NOT NULL)
SELECT query_id, doc_id, CAST(tier AS INTEGER) AS tier, round(score, 6) AS score FROM k WHERE tier = best""")
def r03_rank_tiers(spark, sf_dir):
    order = [F.col("score"), F.col("doc_id")]
    hits = retrieval.top(bm25_scores(spark, sf_dir, 10), ["query_id"], order, 10)
    return retrieval.tiered(hits, ["query_id"], F.col("score") <= -60, F.col("score") <= -20, order, 10).select("query_id", "doc_id", "tier", "score")


@query(f"""WITH {BM25}, {VEC},
h AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS rank FROM v a, v b WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND {COS} >= 0.3),
u AS (SELECT query_id, id, 'qa' AS result_kind, 0 AS o, rank, round(score, 6) AS score FROM h WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 'plain', 1, rank, round(score, 6) FROM r WHERE rank <= 5),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, rank) AS position FROM u)
SELECT query_id, id, result_kind, score, CAST(position AS INTEGER) AS position FROM z WHERE position <= 8""")
def r06_hybrid(spark, sf_dir):
    """Vector results (a benchmark item's vector is the one of its number), then full-text ones."""
    vectors = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    items = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    queries = vectors.join(items, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    near = metric.search(vector_index(spark, sf_dir), queries, 5, 0.3)[0].withColumn("score", F.round("score", 6))
    qa = retrieval.top(near, ["query_id"], [F.col("score").desc(), F.col("id")], 5).withColumn("result_kind", F.lit("qa"))
    plain = retrieval.top(bm25_scores(spark, sf_dir, 5).withColumnRenamed("doc_id", "id"), ["query_id"], [F.col("score"), F.col("id")], 5).withColumn("result_kind", F.lit("plain"))
    return retrieval.hybrid(qa, plain, 8).select("query_id", "id", "result_kind", "score", "position")


@query(f"""WITH {BM25}, k AS (SELECT r.query_id, r.rank, '[候補' || r.rank || ']' || chr(10) || '種別: plain' || chr(10) || '本文: ' || substr({sql_strip("d2.text")}, 1, 1200) || chr(10) || '情報源: doc / ' || d2.source || chr(10) || 'bm25: ' || printf('%.6f', round(r.score, 6)) AS block
  FROM r JOIN documents d2 ON d2.doc_id = r.doc_id WHERE rank <= 8)
SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS context FROM k GROUP BY query_id""")
def r07_context(spark, sf_dir):
    hits = retrieval.top(bm25_scores(spark, sf_dir, 8), ["query_id"], [F.col("score"), F.col("doc_id")], 8)
    docs = t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("source_label"))
    named = hits.join(docs, "doc_id").withColumns({"position": F.col("rank"), "result_kind": F.lit("plain"), "question": F.lit(""), "answer": F.lit(""), "source_type": F.lit("doc")})
    return retrieval.context(named).select("query_id", F.md5("context").alias("context"))


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body, source FROM documents)
SELECT doc_id, md5(source || ' ' || body || CASE WHEN len(list_filter(regexp_extract_all(lower(source), '[\p{L}\p{N}]+'), lambda z: length(z) >= 2)) > 0 THEN ' ' || source ELSE '' END) AS head,
  CAST(len(list_distinct(list_filter(regexp_extract_all(lower(body), '[\p{L}\p{N}]+'), lambda z: length(z) >= 2))) AS INTEGER) AS n_tokens FROM x""")
def c24_c25_search_text(spark, sf_dir):
    body = T.collapse(F.col("text"))
    head = F.array_join(F.array(F.col("source"), body, F.array_join(retrieval.tokens(F.col("source"), 2), " ")), " ")
    tokens = F.array_distinct(retrieval.tokens(body, 2))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(head).alias("head"), F.size(tokens).alias("n_tokens"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def o01_r11_page_of_results(spark, sf_dir):
    return relational.page(t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 2, 20)


# Near duplicates and refinement

PAIRS = f"{VEC}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id < b.vec_id AND {COS} >= 0.4)"


@query(f"WITH {VEC} SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS score FROM v a, v b WHERE a.vec_id < b.vec_id AND {COS} >= 0.4")
def j05_similar_pairs(spark, sf_dir):
    items = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return neardup.similar_pairs(items, 0.4).withColumn("score", F.round("score", 6))


MARKED = f"""RECURSIVE {PAIRS}, link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.id),
c AS (SELECT id, min(r) AS root FROM reach GROUP BY id), n AS (SELECT root, count(*) AS size, max(id) FILTER (true) AS last FROM c GROUP BY root),
g AS (SELECT c.id, c.root, n.size, min(c.id) OVER (PARTITION BY c.root) AS rep FROM c JOIN n USING (root)), k AS (SELECT root, row_number() OVER (ORDER BY root) AS number FROM n WHERE size > 1)"""


def marked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as plain items of equal length, so the smallest sort_no is the representative."""
    items = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("knowledge_id"), F.lit("plain").alias("knowledge_type"), F.lit("").alias("question"), F.lit("").alias("answer"), F.lit("x").alias("content"), F.col("vec_id").alias("sort_no"), F.col("embedding").cast("array<double>").alias("vector"))
    return neardup.clusters(items, {"plain": 0.4})


@query(f"""WITH {MARKED} SELECT g.id AS knowledge_id, CASE WHEN size > 1 THEN 'job_PG_' || lpad(CAST(number AS VARCHAR), 4, '0') END AS dedup_group_id, rep AS representative_id, CASE WHEN g.id = rep THEN 1 ELSE 0 END AS is_representative, CASE WHEN g.id = rep THEN 0 ELSE 1 END AS is_duplicate,
  round(CASE WHEN {COS} >= 0 THEN {COS} WHEN g.id = rep THEN 1.0 END, 6) AS dedup_score FROM g LEFT JOIN k ON k.root = g.root JOIN v a ON a.vec_id = g.id JOIN v b ON b.vec_id = g.rep""")
def n04_n07_o05_clusters(spark, sf_dir):
    return marked_items(spark, sf_dir).select("knowledge_id", "dedup_group_id", "representative_id", "is_representative", "is_duplicate", F.round("dedup_score", 6).alias("dedup_score"))


@query(f"WITH {MARKED} SELECT count(*) AS items, count(DISTINCT CASE WHEN size > 1 THEN root END) AS groups, count(*) FILTER (id = rep) AS representatives, count(*) FILTER (id <> rep) AS duplicates, CAST(0 AS BIGINT) AS qa_kept, count(*) FILTER (id = rep) AS plain_kept FROM g")
def a09_dedup_summary(spark, sf_dir):
    return neardup.summary(marked_items(spark, sf_dir))


@query(f"SELECT doc_id, nullif(md5(trim(regexp_replace(text, '{W}+', ' ', 'g'))), md5('')) AS content FROM documents")
def n01_cleanse(spark, sf_dir):
    items = t(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("question"), F.lit("").alias("answer"), F.col("text").alias("content"))
    return refine.cleanse(items).select("doc_id", F.md5("content_normalize").alias("content"))


# Chunks

LIMITS = chunking.ChunkLimits(6000, 8)


@query(rf"""WITH RECURSIVE c AS (SELECT source AS job, doc_id, trim(regexp_replace(text, '{W}+', ' ', 'g')) AS x FROM documents),
cut AS (SELECT job, doc_id, 0 AS part, '' AS head, x AS rest FROM c WHERE x <> ''
  UNION ALL SELECT job, doc_id, part + 1, trim(substr(rest, 1, stop)), trim(substr(rest, stop + 1)) FROM (
    SELECT *, CASE WHEN length(rest) <= 6000 THEN length(rest) WHEN mark > 0 THEN mark WHEN clause > 0 THEN clause WHEN blank > 1 THEN blank - 1 ELSE 6000 END AS stop FROM (
      SELECT *, length(regexp_extract(substr(rest, 1, 6000), '(?s)^.*[。．！？!?]\s*')) AS mark, length(regexp_extract(substr(rest, 1, 6000), '(?s)^.*[、，,；;:]\s*')) AS clause, length(regexp_extract(substr(rest, 1, 6000), '(?s)^.* ')) AS blank FROM cut WHERE rest <> ''))),
items AS (SELECT job, head, length(head) AS len, row_number() OVER (PARTITION BY job ORDER BY doc_id, part) AS i FROM cut WHERE head <> ''),
pack AS (SELECT job, i, 1 AS chunk_no, 1 AS n, len AS chars FROM items WHERE i = 1
  UNION ALL SELECT p.job, t.i, p.chunk_no + CASE WHEN p.n < 8 AND p.chars + 2 + t.len <= 6000 THEN 0 ELSE 1 END, CASE WHEN p.n < 8 AND p.chars + 2 + t.len <= 6000 THEN p.n + 1 ELSE 1 END, CASE WHEN p.n < 8 AND p.chars + 2 + t.len <= 6000 THEN p.chars + 2 + t.len ELSE t.len END
  FROM pack p JOIN items t ON t.job = p.job AND t.i = p.i + 1)
SELECT p.job AS job_item_id, chunk_no, CAST(min(p.i) - 1 AS INTEGER) AS start_index, CAST(max(p.i) - 1 AS INTEGER) AS end_index, CAST(count(*) AS INTEGER) AS item_count, CAST(sum(len) AS INTEGER) AS char_count,
  md5(string_agg(head, chr(10) || chr(10) ORDER BY p.i)) AS chunk_md5 FROM pack p JOIN items t ON t.job = p.job AND t.i = p.i GROUP BY p.job, chunk_no""")
def p01_p04_chunks(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("source").alias("job_item_id"), F.col("doc_id").alias("sort_no"), F.col("doc_id").alias("item_id"), "text")
    found = chunking.build_chunks(docs, LIMITS)
    return found.select("job_item_id", "chunk_no", "start_index", "end_index", "item_count", "char_count", F.md5("chunk_text").alias("chunk_md5"))


NUMBERED = "q AS (SELECT DISTINCT l_orderkey, 'qa' AS prompt_type, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'N'), p AS (SELECT DISTINCT l_orderkey, 'plain', l_linenumber FROM lineitem WHERE l_returnflag <> 'N'), u AS (SELECT * FROM q UNION ALL SELECT * FROM p)"


@query(f"WITH {NUMBERED} SELECT l_orderkey AS job_item_id, prompt_type, n, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE prompt_type WHEN 'qa' THEN 0 ELSE 1 END, n) AS INTEGER) AS chunk_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY n, CASE prompt_type WHEN 'qa' THEN 0 ELSE 1 END) AS INTEGER) AS by_turns FROM u")
def p11_o07_o08_j09_numbering(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_item_id"), F.col("l_linenumber").alias("chunk_no"), F.col("l_linenumber").alias("n"), "l_returnflag")
    qa, plain = (lines.filter(test).drop("l_returnflag").distinct() for test in ("l_returnflag = 'N'", "l_returnflag <> 'N'"))
    turns = chunking.interleave(qa, plain).select("job_item_id", "prompt_type", "n", F.col("chunk_no").alias("by_turns"))
    return chunking.continue_numbers(qa, plain).join(turns, ["job_item_id", "prompt_type", "n"]).select("job_item_id", "prompt_type", "n", "chunk_no", "by_turns")


# Jobs

STATE = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'done' ELSE 'queued' END"
PROGRESS = f"c AS (SELECT user_id AS job_id, event_id AS chunk_no, {STATE} AS status, 'e' || event_id AS msg FROM events), a AS (SELECT job_id, count(*) AS total_chunks, count(*) FILTER (status = 'done') AS done_chunks, count(*) FILTER (status = 'error') AS error_chunks, arg_max(msg, chunk_no) FILTER (status = 'error') AS last_error FROM c GROUP BY job_id), s AS (SELECT *, CASE WHEN total_chunks - done_chunks - error_chunks > 0 THEN CASE WHEN done_chunks + error_chunks = 0 THEN 'new' ELSE 'running' END WHEN error_chunks > 0 THEN 'partial_error' ELSE 'done' END AS status FROM a)"


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = t(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("chunk_no"), F.expr(STATE).alias("status"), F.concat(F.lit("e"), "event_id").alias("error_message"))
    return jobs.progress(chunks)


@query(f"WITH {PROGRESS} SELECT job_id, total_chunks, done_chunks, error_chunks, last_error, status, CASE status WHEN 'new' THEN 'queued' WHEN 'running' THEN 'generating' ELSE 'generated' END AS phase FROM s")
def a02_a04_job_progress(spark, sf_dir):
    return job_progress(spark, sf_dir)


@query(f"WITH {PROGRESS} SELECT job_id, status FROM s WHERE status IN ('running', 'error') OR (status = 'done' AND error_chunks = 0)")
def f08_monitored_and_completed(spark, sf_dir):
    found = job_progress(spark, sf_dir)
    return jobs.monitored(found).unionByName(jobs.completed(found)).select("job_id", "status")


@query("SELECT n.n_nationkey AS root_id, count(c.c_custkey) AS page_count, count(*) FILTER (c.c_acctbal > 0) AS done_count, CASE WHEN count(c.c_custkey) = 0 OR count(*) FILTER (c.c_acctbal > 0) = 0 THEN 'new' WHEN count(*) FILTER (c.c_acctbal > 0) >= count(c.c_custkey) THEN 'done' ELSE 'running' END AS status FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey")
def a01_j03_root_status(spark, sf_dir):
    roots = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("root_id"))
    pages = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("root_id"), F.when(F.col("c_acctbal") > 0, "done").otherwise("new").alias("status"))
    return jobs.root_status(roots, pages)


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_version, count(*) AS n FROM orders")
def a05_a06_counters(spark, sf_dir):
    return relational.counters(t(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT source AS uid, count(*) AS files FROM documents GROUP BY source ORDER BY uid")
def a07_files_by_user(spark, sf_dir):
    """Documents as files under users/<source>/."""
    paths = t(spark, sf_dir, "documents").select(F.concat(F.lit("users/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))
    return paths.filter(T.is_object_path(F.col("path"))).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("uid")).agg(F.count("*").alias("files")).orderBy("uid")


@query("SELECT count(*) AS entries, count(*) FILTER (lang = 'en') AS qa_entries, count(*) FILTER (lang <> 'en') AS plain_entries FROM documents")
def a08_build_counts(spark, sf_dir):
    return sinks.build_counts(t(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "qa").otherwise("plain").alias("knowledge_type")))


# Tables

@query("SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' AND l.l_returnflag <> ''")
def j01_f12_parents_with_children(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return relational.usable_contents(orders, lines, "o_orderkey", F.col("o_orderstatus") == "F", "l_returnflag").select("o_orderkey", "l_linenumber", "l_quantity")


@query("WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) SELECT n_name, c_custkey FROM r JOIN nation ON n_nationkey = c_nationkey WHERE n = 1")
def j02_newest_match(spark, sf_dir):
    best = relational.newest(t(spark, sf_dir, "customer"), ["c_nationkey"], [-F.col("c_acctbal"), F.col("c_custkey")])
    return best.join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey")


@query("WITH n AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN n ON n.o_orderkey = l.l_orderkey")
def f03_f16_latest_parent_children(spark, sf_dir):
    newest = relational.newest(t(spark, sf_dir, "orders"), ["o_custkey"], [-F.unix_micros(F.col("o_orderdate").cast("timestamp")), -F.col("o_orderkey")])
    return t(spark, sf_dir, "lineitem").join(newest.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)")
def f03_f16_children_of_the_newest(spark, sf_dir):
    """The lines of the newest order of all, in order."""
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return relational.latest_with_children(orders, lines, "l_orderkey", [F.col("o_orderdate").desc(), F.col("l_orderkey").desc()], [F.col("l_linenumber")])


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def j08_existence(spark, sf_dir):
    customers, orders = t(spark, sf_dir, "customer").select("c_custkey"), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.with_existence(customers, orders, "c_custkey", "has_orders")


@query("SELECT a.n_nationkey, b.n_name AS parent FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_regionkey")
def j07_parent_lookup(spark, sf_dir):
    return relational.with_parent(t(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", "n_name", "parent").select("n_nationkey", "parent")


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 5000 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, 'NEW' FROM customer WHERE c_acctbal < 0")
def k01_k04_upsert(spark, sf_dir):
    old = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    changed = old.filter("c_acctbal > 5000").withColumns({"c_mktsegment": F.lit("VIP"), "c_name": F.lit("renamed")})
    added = old.filter("c_acctbal < 0").withColumns({"c_custkey": F.col("c_custkey") + 1000000, "c_mktsegment": F.lit("NEW")})
    return relational.upsert(old.drop("c_acctbal"), changed.unionByName(added).drop("c_acctbal"), ["c_custkey"], keep=["c_name"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'X' END AS o_orderstatus FROM orders")
def k06_sticky_status(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return relational.sticky_status(orders, orders.withColumn("o_orderstatus", F.lit("X")), "o_orderkey", "o_orderstatus", "F")


@query("SELECT n_nationkey FROM nation UNION ALL SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)")
def k07_insert_absent(spark, sf_dir):
    old = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return relational.insert_absent(old, t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n_nationkey")), "n_nationkey")


@query("WITH n AS (SELECT * FROM lineitem WHERE l_quantity > 25) SELECT l_orderkey, l_linenumber, l_returnflag FROM n WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n)")
def k03_replaced_rows(spark, sf_dir):
    """The table after the replacement: named parents have the complete new rows, other parents what they had."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    new = rows.filter("l_quantity > 25").withColumn("l_returnflag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
    return relational.replace_children(rows, new, "l_orderkey", ["l_returnflag"])[0].drop("l_quantity")


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS inserted, count(*) FILTER (l_returnflag = 'R') AS skipped FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey")
def k03_replace_children(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("l_returnflag"), "l_quantity")
    return relational.replace_children(rows, rows.filter("l_quantity > 25"), "l_orderkey", ["l_returnflag"])[1]


@query("SELECT n_nationkey, 'done' AS status, n_name AS name, NULL AS refine_old FROM nation")
def k12_merge_status(spark, sf_dir):
    status = F.create_map(F.lit("status"), F.lit("new"), F.lit("refine_old"), F.lit("x"), F.lit("name"), F.col("n_name"))
    merged = relational.merge_status(status, F.create_map(F.lit("status"), F.lit("done")))
    return t(spark, sf_dir, "nation").withColumn("m", merged).select("n_nationkey", F.col("m")["status"].alias("status"), F.col("m")["name"].alias("name"), F.col("m")["refine_old"].alias("refine_old"))


@query("SELECT s_suppkey, s_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS file_no FROM supplier WHERE trim(s_name) <> '' AND coalesce(s_acctbal, 0) > 0")
def k05_f05_f06_o07_numbered_files(spark, sf_dir):
    good = t(spark, sf_dir, "supplier").filter((F.trim("s_name") != "") & (F.coalesce("s_acctbal", F.lit(0)) > 0))
    return readers.number_children(good, "s_nationkey", ["s_suppkey"]).select("s_suppkey", "s_name", "file_no")


@query("SELECT s_nationkey, count(*) AS resources, count(*) FILTER (s_acctbal > 5000) AS allowed, arg_min(s_name, s_suppkey) FILTER (s_acctbal > 5000) AS first_url FROM supplier GROUP BY s_nationkey")
def f04_f18_dataset_summary(spark, sf_dir):
    """Suppliers as the resources of a nation's dataset; rich ones have an allowed format."""
    resource = F.struct("s_suppkey", F.when(F.col("s_acctbal") > 5000, "csv").otherwise("exe").alias("format"), F.col("s_name").alias("url"))
    sets = t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(resource)).alias("resources"))
    allowed = F.filter("resources", lambda r: readers.resource_allowed(r["format"], r["url"], ["csv", "pdf"]))
    return sets.select("s_nationkey", F.size("resources").cast("long").alias("resources"), F.size(allowed).cast("long").alias("allowed"), F.try_element_at(allowed, F.lit(1))["url"].alias("first_url"))


@query("SELECT o_orderkey AS source_id, o_orderstatus AS title, o_orderdate AS created_at, 'opendata' AS source_type, NULL AS note FROM orders ORDER BY created_at DESC, source_id")
def f01_f07_f14_listing(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderdate").alias("created_at"))
    filled = relational.with_defaults(relational.require_columns(orders, ["source_id", "title"]), {"source_type": F.lit("opendata"), "note": F.lit(None).cast("string")})
    return filled.orderBy(F.col("created_at").desc(), "source_id")


@query("SELECT window_start, job_id, events, done, errors FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, user_id AS job_id, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL)")
def streaming_progress(spark, sf_dir):
    """The event files as a stream, taken to its end."""
    found = progress.follow(spark, f"{sf_dir}/events.parquet*", t(spark, sf_dir, "events").schema)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
