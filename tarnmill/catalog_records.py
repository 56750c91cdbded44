"""More queries with SQL twins: jobs, uploads, datasets, pages of results, model replies and search entries.

Stand-ins as in catalog.py; orders are jobs, lineitem their items, customers uploaded files, parts datasets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tarnmill.functions import text as T
from tarnmill.functions import urls
from tarnmill.functions import vectors as V
from tarnmill.operators import crawl, jobs, neardup, refine, relational, retrieval, splitting, staging
from tarnmill.plans import page_scoring
from tarnmill.registry import query, t
from tarnmill.sources import readers, rest, sinks, versions
from tarnmill.streaming import job_states

NOW = "TIMESTAMP '2025-01-01 00:00:00'"


# Tables and jobs


@query("SELECT CASE WHEN n.r_regionkey IS NULL THEN r.r_name ELSE 'new' || r.r_regionkey END AS meta_value, r.r_regionkey AS meta_key FROM region r LEFT JOIN (SELECT r_regionkey FROM region WHERE r_regionkey > 2) n USING (r_regionkey)")
def k02_upsert_meta(spark, sf_dir):
    old = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("meta_key"), F.col("r_name").alias("meta_value"))
    new = old.filter("meta_key > 2").withColumn("meta_value", F.concat(F.lit("new"), "meta_key"))
    return relational.upsert(old, new, ["meta_key"])


@query("SELECT c_nationkey AS page_id, c_name AS content FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS n FROM customer WHERE c_nationkey < 10) WHERE n = 1 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 10)")
def k08_replace_content(spark, sf_dir):
    old = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id"), F.col("n_name").alias("content"))
    fresh = t(spark, sf_dir, "customer").filter("c_nationkey < 10").select(F.col("c_nationkey").alias("page_id"), F.col("c_name").alias("content"), "c_custkey")
    return relational.replace_content(old, fresh, "page_id", [-F.col("c_custkey")])


@query("SELECT c_name AS file_name FROM customer UNION ALL SELECT 'copy ' || c_name FROM customer WHERE c_acctbal < 0")
def k09_register_uploads(spark, sf_dir):
    files = t(spark, sf_dir, "customer").select(F.col("c_name").alias("file_name"), "c_acctbal")
    new = files.filter("c_acctbal < 0").select(F.concat(F.lit("copy "), "file_name").alias("file_name"))
    return relational.append_new(files.select("file_name"), new, "file_name")


@query("""WITH one AS (SELECT c_custkey, c_mktsegment FROM customer), two AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_acctbal > 9000)
SELECT 1 AS version, * FROM one UNION ALL SELECT 2, * FROM two UNION ALL SELECT 3, * FROM two WHERE c_mktsegment <> 'DEBT'""")
def k01_a05_versions_of_a_table(spark, sf_dir):
    """Customers as parents: created, then upserted by key, then replaced by a filter of themselves; all three versions are read."""
    people = t(spark, sf_dir, "customer")
    table = versions.Table(spark, f"{staging.stage_dir(spark)}/customers-{uuid.uuid4().hex}", "c_custkey", 32)
    table.replace(people.select("c_custkey", "c_mktsegment"))
    fresh = people.filter("c_acctbal > 9000").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    new = people.filter("c_acctbal < 0").select("c_custkey", F.lit("DEBT").alias("c_mktsegment")).unionByName(fresh)
    table.update(new, lambda old, rows: relational.upsert(old, rows, ["c_custkey"]))
    table.replace(table.read().filter("c_mktsegment <> 'DEBT'"))
    first, second, third = (table.read(n).select(F.lit(n).alias("version"), "*") for n in (1, 2, 3))
    return first.unionByName(second).unionByName(third)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'R'")
def k03_k05_versions_of_children(spark, sf_dir):
    """Items of orders, bucketed by their order: the orders that are sent again get new items, in the buckets that they fall into."""
    items = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    table = versions.Table(spark, f"{staging.stage_dir(spark)}/items-{uuid.uuid4().hex}", "l_orderkey", 32)
    table.replace(items.drop("l_quantity"))
    sent = items.filter("l_quantity > 45").withColumn("l_returnflag", F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag")))
    table.update(sent, lambda old, rows: relational.replace_children(old, rows, "l_orderkey", ["l_returnflag"])[0])
    return table.read()


@query(f"SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'new' END AS status, o_custkey AS selected_count, 0 AS qa_count, 0 AS plain_count, 0 AS error_count, CAST({NOW} AS VARCHAR) AS requested, CAST(NULL AS VARCHAR) AS started FROM orders")
def k10_job_records(spark, sf_dir):
    requests = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("upload").alias("source_type"), F.lit("files").alias("source_name"), F.lit("qa").alias("request_type"), F.col("o_custkey").alias("selected_count"), (F.col("o_orderstatus") == "F").alias("preview_only"))
    found = jobs.job_records(requests, F.expr(NOW))
    return found.select("job_id", "status", "selected_count", "qa_count", "plain_count", "error_count", F.col("requested_at").cast("string").alias("requested"), F.col("started_at").cast("string").alias("started"))


@query("SELECT l_orderkey || ':' || l_linenumber AS chunk_id, 'new' AS status, NULL AS error_message FROM lineitem")
def k10_chunk_records(spark, sf_dir):
    chunks = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_item_id"), F.col("l_linenumber").alias("chunk_no"))
    return jobs.chunk_records(chunks).select("chunk_id", "status", "error_message")


@query(f"SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS status, CAST(CASE WHEN o_custkey % 3 = 0 THEN coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, {NOW}) WHEN o_orderstatus = 'F' THEN o_orderdate END AS DATE)::VARCHAR AS started_at, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'e' END AS error_message FROM orders")
def k13_transitions(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("started_at"), F.lit("e").alias("error_message"), "o_custkey")
    found = relational.transition(rows, F.col("o_custkey") % 3 == 0, "done", F.expr(NOW))
    return found.select("job_id", "status", F.to_date("started_at").cast("string").alias("started_at"), "error_message")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/csv; charset=utf-8' WHEN 2 THEN 'text/plain; charset=utf-8' ELSE 'application/octet-stream' END AS upload_type, CASE s_suppkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/csv; charset=utf-8' ELSE 'application/octet-stream' END AS dataset_type FROM supplier")
def k14_media_types(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("PDF", "csv", "txt", "zip"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t(spark, sf_dir, "supplier").select("s_suppkey", T.media_type(ext, "upload").alias("upload_type"), T.media_type(ext, "opendata").alias("dataset_type"))


# Lookups and listings


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def f02_lookup(spark, sf_dir):
    return relational.lookup(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 7)


@query("SELECT l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) ORDER BY l_linenumber")
def f15_children_in_order(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem")
    first = lines.agg(F.min("l_orderkey")).first()[0]
    return readers.ordered_rows(lines, "l_orderkey", first, "l_linenumber").select("l_linenumber", "l_partkey")


@query("SELECT c_custkey AS file_id, c_name AS title, CAST(o.size AS BIGINT) AS file_size FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS size FROM orders GROUP BY ALL) o ON o_custkey = c_custkey")
def f17_uploads_with_sizes(spark, sf_dir):
    """Customers as uploads, their orders as the size of the stored object: null for customers without one."""
    files = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("file_name"), F.col("c_custkey").alias("path"), F.col("c_acctbal").alias("created_at"))
    objects = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("file_size"))
    return readers.uploads(files, objects).select("file_id", "title", "file_size")


@query("SELECT n_name AS source_key, n_name || ' label' AS label, 'http://n/' || n_nationkey AS url FROM nation")
def f19_configured_sources(spark, sf_dir):
    source = F.struct(F.concat(F.lit(" "), "n_name").alias("source_key"), F.concat("n_name", F.lit(" label　")).alias("label"), F.concat(F.lit("http://n/"), "n_nationkey").alias("url"))
    return readers.configured_sources(t(spark, sf_dir, "nation").agg(F.array_append(F.collect_list(source), F.lit(None)).alias("sources")))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def s17_details_of_a_listing(spark, sf_dir):
    """Open orders are listed, twice each; their lines come from the second endpoint."""
    listing = t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return readers.read_details(listing.unionByName(listing), t(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


def served(records, scan, order, size):
    """A fetcher over replies that Spark writes from records: pages of `size` records a scan, each in a folder of its own."""
    spark = records.sparkSession
    named = [c for c in records.columns if c != scan]
    placed = staging.numbered(records, [F.col(scan), F.col(order)])
    firsts = placed.groupBy(scan).agg(F.min("number").alias("first"), F.count("*").alias("total"))
    at = placed.join(firsts, scan).withColumn("at", F.expr(f"floor((number - first) / {size}) * {size}"))
    pages = at.groupBy(F.col(scan).alias("scan"), "at", "total").agg(F.sort_array(F.collect_list(F.struct("number", *named))).alias("rows"))
    folder = f"{staging.stage_dir(spark)}/replies-{uuid.uuid4().hex}"
    pages.select("scan", "at", "total", F.to_json("rows").alias("reply")).repartition("scan", "at").write.partitionBy("scan", "at").parquet(folder)

    def page(scan, at):
        import pyarrow.dataset as ds

        try:
            row = ds.dataset(f"{folder}/scan={scan}/at={at}", format="parquet").to_table().to_pylist()[0]
        except FileNotFoundError:
            return 0, []
        return row["total"], json.loads(row["reply"])

    return page


@query("SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n <= 250")
def s02_paged_speeches(spark, sf_dir):
    """Customers as speeches, a query a nation: cursors of pages of 100 are followed, up to 250 records a query."""
    people = t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    page = served(people, "c_nationkey", "c_custkey", 100)

    def fetch(endpoint, params):
        at = params["startRecord"]
        total, records = page(params["nation"], at - 1)
        return {"speechRecord": records, "nextRecordPosition": at + 100 if at + 99 < total else None}

    queries = [{"nation": n} for n in range(25)]
    found = rest.read_speeches(spark, fetch, "speech", "speech", queries, "c_custkey long, c_name string", 250, 500)
    return found.select(F.col("scan").alias("c_nationkey"), "record.c_custkey", "record.c_name")


@query("SELECT p_partkey, n AS number FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM part WHERE p_size % 3 <> 1) WHERE n <= 1000000")
def s03_paged_datasets(spark, sf_dir):
    """Parts as datasets of a catalog, 200 a page; a third of them have no resource of an allowed format, the cap is a million."""
    kind = F.expr("CASE p_size % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'exe' ELSE '' END")
    resource = F.struct(kind.alias("format"), F.when(F.col("p_size") % 3 == 2, "http://p/x.csv").otherwise("http://p/x").alias("url"))
    sets = t(spark, sf_dir, "part").select(F.lit(0).alias("scan_no"), "p_partkey", F.array(resource).alias("resources"))
    page = served(sets, "scan_no", "p_partkey", 200)

    def fetch(endpoint, params):
        total, records = page(0, params["start"])
        return {"success": True, "result": {"count": total, "results": records}}

    kind = "struct<p_partkey:bigint,resources:array<struct<format:string,url:string>>>"
    return rest.read_catalog(spark, fetch, "search", {"rows": 200, "start": 0}, kind, ["csv"], 1_000_000).select("record.p_partkey", "number")


SHOP = "'http://shop.example.org/"
CRAWL = page_scoring.checked_crawl({"include_root_page": True, "same_domain_only": True, "max_depth": 3, "max_pages": 40, "priority_keywords": ["7.html"], "deprioritize_keywords": ["3.html"]})


@query(f"""WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), there AS (SELECT p_partkey AS p FROM part WHERE p_size <= 45),
  e AS (SELECT {SHOP}s/' || s || '.html' AS url, {SHOP}p/' || p || '.html' AS link, p AS num FROM l UNION ALL SELECT {SHOP}p/' || p || '.html', {SHOP}s/' || s || '.html', s FROM l JOIN there USING (p)),
  k AS (SELECT url, list(link ORDER BY 100 * CAST(contains(link, '7.html') AS INTEGER) - 120 * CAST(contains(link, '3.html') AS INTEGER) DESC, num) AS links FROM e GROUP BY url),
  w AS (SELECT {SHOP}s/' || s_suppkey || '.html' AS root, 1 AS place, {SHOP}s/' || s_suppkey || '.html' AS url, CAST(NULL AS VARCHAR) AS parent_url, 0 AS depth, coalesce(links, []) AS kids,
      list_transform(list_reverse(coalesce(links, [])), lambda x: {{'url': x, 'parent': CAST(NULL AS VARCHAR), 'depth': 1}}) AS waiting, coalesce(links, []) AS seen
      FROM supplier LEFT JOIN k ON k.url = {SHOP}s/' || s_suppkey || '.html'
    UNION ALL SELECT root, place + 1, page.url, page.parent, page.depth, new,
      list_concat(rest, list_transform(list_reverse(new)[1:greatest(40 - place - len(rest), 0)], lambda x: {{'url': x, 'parent': page.url, 'depth': page.depth + 1}})), list_concat(seen, new)
      FROM (SELECT v.*, CASE WHEN page.depth < 3 THEN list_filter(coalesce(k.links, []), lambda x: x <> root AND NOT list_contains(seen, x)) ELSE [] END AS new
        FROM (SELECT root, place, seen, waiting[len(waiting)] AS page, waiting[1:len(waiting) - 1] AS rest FROM w WHERE len(waiting) > 0 AND place < 40) v LEFT JOIN k ON k.url = page.url))
SELECT root, CAST(place AS INTEGER) AS place, w.url, parent_url, CAST(depth AS INTEGER) AS depth, CAST(len(kids) AS INTEGER) AS child_count, CASE WHEN w.url LIKE '%/p/%' AND t.p IS NULL THEN 'fetch_error' ELSE 'new' END AS status
FROM w LEFT JOIN there t ON w.url = {SHOP}p/' || t.p || '.html'""")
def s07_crawls_of_many_sites(spark, sf_dir):
    """A crawl from each supplier's page: it links to the parts that it ships, and those to their suppliers; some parts have no page."""
    address = lambda kind, key: F.concat(F.lit(f"http://shop.example.org/{kind}/"), F.col(key).cast("string"), F.lit(".html"))
    there = t(spark, sf_dir, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"))
    shipped = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    supplier, part = address("s", "l_suppkey"), address("p", "l_partkey")
    links = shipped.select(supplier.alias("url"), F.col("l_partkey").alias("at"), part.alias("link")).unionByName(shipped.join(there, "l_partkey").select(part.alias("url"), F.col("l_suppkey").alias("at"), supplier.alias("link")))
    roots = t(spark, sf_dir, "supplier").select(address("s", "s_suppkey").alias("root"))
    return crawl.crawl(roots, staging.stage(links, "links"), roots.select(F.col("root").alias("url")).unionByName(there.select(part.alias("url"))), CRAWL)


@query()
def s07_h10_crawls_of_pages(spark, sf_dir):
    """A crawl from each page, over the links in the pages' HTML; addresses that the table lacks are fetch errors."""
    pages = t(spark, sf_dir, "pages")
    found = pages.select(urls.normalise(F.col("url")).alias("url"))
    return crawl.crawl(found.select(F.col("url").alias("root")), staging.stage(crawl.page_links(pages), "links"), found, CRAWL)


EVENT_STATUS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' ELSE 'queued' END"


@query(f"""WITH e AS (SELECT user_id AS job_id, event_id % 20 AS chunk_no, event_id, ts, {EVENT_STATUS} AS status FROM events),
c AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job_id, chunk_no ORDER BY ts DESC, event_id DESC) = 1),
s AS (SELECT job_id, count(*) AS total_chunks, count(*) FILTER (status = 'done') AS done_chunks, count(*) FILTER (status = 'error') AS error_chunks, arg_max('e' || event_id, chunk_no) FILTER (status = 'error') AS last_error, max(ts) AS last FROM c GROUP BY job_id),
f AS (SELECT job_id, min(ts) AS started_at FROM e WHERE status <> 'queued' GROUP BY job_id),
j AS (SELECT *, total_chunks - done_chunks - error_chunks AS rest FROM s LEFT JOIN f USING (job_id)),
k AS (SELECT *, CASE WHEN rest = total_chunks THEN 'new' WHEN rest > 0 THEN 'running' WHEN error_chunks > 0 THEN 'partial_error' ELSE 'done' END AS status FROM j)
SELECT job_id, total_chunks, done_chunks, error_chunks, last_error, status, CASE status WHEN 'new' THEN 'queued' WHEN 'running' THEN 'generating' ELSE 'generated' END AS phase, started_at, CASE WHEN rest = 0 THEN last END AS finished_at FROM k""")
def a02_k13_streamed_job_states(spark, sf_dir):
    """The event files as a stream, taken to its end: users as jobs, each with up to 20 chunks whose states change."""
    def prepare(events):
        return events.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 20).alias("chunk_no"), "event_id", "ts", F.expr(EVENT_STATUS).alias("status"), F.concat(F.lit("e"), "event_id").alias("message"))

    found = job_states.follow(spark, f"{sf_dir}/events.parquet*", t(spark, sf_dir, "events").schema, prepare)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "finished_at")})


# Text


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'P' || p_partkey ELSE p_name END AS dataset_id, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN p_name ELSE 'オープンデータ' END AS title,
  CASE p_size % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' ELSE '' END AS ext, CASE p_size % 3 WHEN 0 THEN 'txt' ELSE 'md' END AS upload_ext FROM part""")
def c39_c40_dataset_names(spark, sf_dir):
    size, name = F.col("p_size"), F.col("p_name")
    id_ = F.when(size % 2 == 0, F.concat(F.lit("P"), "p_partkey"))
    title = T.dataset_title(F.when(size % 3 == 0, F.col("p_type")), F.when(size % 3 == 1, name), F.lit(None))
    ext = T.resource_extension(F.when(size % 3 == 0, " CSV "), F.when(size % 3 == 1, "http://a/b/x.PDF?q=1").otherwise("http://a/b"))
    return t(spark, sf_dir, "part").select("p_partkey", T.dataset_id(id_, name).alias("dataset_id"), title.alias("title"), ext.alias("ext"), T.upload_extension(F.when(size % 3 == 0, " Text").otherwise("MD")).alias("upload_ext"))


@query("""WITH l AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS x FROM conversations WHERE trim(text) <> '' AND NOT regexp_matches(replace(text, chr(10), ' '), '^\\s*\\d+[.)]\\s'))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS index, CAST(turn + 1 AS VARCHAR) AS question_no, md5((turn + 1) || '. ' || trim(x)) AS body FROM l""")
def c11_numbered_questions(spark, sf_dir):
    """Conversations written out as numbered lines, split back into one record a turn."""
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    turns = t(spark, sf_dir, "conversations").withColumn("line", line).filter((F.trim("text") != "") & ~F.col("line").rlike(r"^\s*\d+[.)]\s"))
    each = F.struct("turn", F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.trim("line")).alias("line"))
    texts = turns.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(each))["line"], "\n").alias("text"))
    return splitting.split_quiz(texts, "conv_id").select("conv_id", "index", "question_no", F.md5("text").alias("body"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' WHEN 2 THEN 'json' WHEN 3 THEN 'html' ELSE 'text' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'B' || s_suppkey END AS issue_id,
  s_suppkey % 3 = 0 AS object_path, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -1 END AS whole FROM supplier""")
def c15_c18_c21_c41_detection(spark, sf_dir):
    k = F.col("s_suppkey")
    hint = F.element_at(F.array(*map(F.lit, ("text/csv; header", "application/pdf+csx", "application/json", "text/html", "plain TEXT"))), (k % 5 + 1).cast("int"))
    record = F.create_map(F.lit("issueID"), F.when(k % 2 == 0, F.col("s_name")).otherwise(""), F.lit("issue_id"), F.concat(F.lit("B"), k.cast("string")))
    path = F.when(k % 3 == 0, F.concat(F.lit("users/"), "s_name")).when(k % 3 == 1, "a/b.txt").otherwise("a/b/c")
    whole = F.when(k % 2 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise("1.5")
    found = t(spark, sf_dir, "supplier").withColumn("record", record)
    return found.select("s_suppkey", T.content_kind(hint).alias("kind"), readers.first_alias("record", ["issueID", "issueId", "issue_id"]).alias("issue_id"), T.is_object_path(path).alias("object_path"), T.as_int(whole, -1).alias("whole"))


@query("SELECT doc_id, md5(substr(CASE WHEN doc_id % 3 = 0 THEN source ELSE text END, 1, 300)) AS preview FROM documents")
def c30_preview(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(T.preview(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(""), F.col("text"))).alias("preview"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'size: ' || p_size || ' | brand: ' || p_brand ELSE p_name END AS body FROM part")
def c37_record_text(spark, sf_dir):
    cells = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return t(spark, sf_dir, "part").select("p_partkey", T.record_text(F.when(F.col("p_size") % 2 == 0, "csv").otherwise("text"), cells, F.col("p_name")).alias("body"))


# Model replies and entries


@query("""SELECT p_partkey AS chunk_id, CAST(n AS INTEGER) AS sort_no, p_name || n AS question, p_brand AS answer, CASE p_partkey % 3 WHEN 0 THEN 'qa_list' WHEN 1 THEN 'items' ELSE 'data' END AS source
FROM part, (SELECT unnest([1, 2]) AS n) WHERE p_partkey % 4 <> 3""")
def c31_c32_p14_model_replies(spark, sf_dir):
    """Parts as replies: fenced, with trailing commas and bare keys, under three names of the list; every fourth is no JSON."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(F.lit("qa_list"), F.lit("items"), F.lit("data")), (k % 3 + 1).cast("int"))
    item = lambda n: F.concat(F.lit('{question: "'), "p_name", F.lit(f'{n}", "answer": "'), "p_brand", F.lit(f'", content: "'), name, F.lit('",}'))  # noqa: E731, F541
    reply = F.concat(F.lit("```json\n{plain_list: [], "), name, F.lit(": ["), item(1), F.lit(", "), item(2), F.lit(",],}\n```"))
    replies = t(spark, sf_dir, "part").select(k.alias("chunk_id"), F.when(k % 4 == 3, "I cannot answer that.").otherwise(reply).alias("response"))
    return refine.items_of(replies).select("chunk_id", "sort_no", "question", "answer", F.col("content").alias("source"))


NOTE = ", see: [page 3,] {a: 1,} \\"

@query(f"SELECT doc_id AS chunk_id, CAST(1 AS INTEGER) AS sort_no, md5(text) AS question, md5(text || '{NOTE}') AS answer, md5(source) AS content FROM documents")
def c31_p14_replies_of_whole_texts(spark, sf_dir):
    """Documents as items of replies with bare keys and trailing commas, whose strings hold commas, colons, brackets, quotes and line ends."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text", "source")
    item = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    reply = F.concat(F.lit("Here it is:\n{qa_list : [{question: "), item(F.col("text")), F.lit(', "answer":'), item(F.concat("text", F.lit(NOTE))), F.lit(" , content: "), item(F.col("source")), F.lit(",\n}, ] ,}"))
    found = refine.items_of(docs.select(F.col("doc_id").alias("chunk_id"), reply.alias("response")))
    return found.select("chunk_id", "sort_no", *[F.md5(c).alias(c) for c in ("question", "answer", "content")])


@query("""WITH q AS (SELECT c_custkey AS id, 'name ' || c_name AS question, 'in ' || c_mktsegment AS answer, CASE WHEN c_custkey % 2 = 0 THEN 'qa' ELSE 'plain' END AS kind FROM customer)
SELECT id, CASE WHEN kind = 'qa' THEN (length(question) + length(answer)) / 2.0 ELSE length(question || ' ' || answer) END AS x, CASE WHEN kind = 'qa' THEN (length(replace(question, 'a', '')) + length(replace(answer, 'a', ''))) / 2.0 ELSE length(replace(question || ' ' || answer, 'a', '')) END AS y FROM q""")
def n02_n03_item_vectors(spark, sf_dir):
    """Vectors by an embedder of two numbers: a text's length, and its length without a's."""
    qa = F.col("c_custkey") % 2 == 0
    question, answer = F.concat(F.lit("name "), "c_name"), F.concat(F.lit("in "), "c_mktsegment")
    items = t(spark, sf_dir, "customer").select("c_custkey", F.when(qa, "qa").otherwise("plain").alias("kind"), F.when(qa, question).alias("question"), F.when(qa, answer).alias("answer"), F.when(~qa, F.concat_ws(" ", question, answer)).alias("content"))
    found = refine.vectorize(refine.cleanse(items), lambda texts: [[len(x), len(x.replace("a", ""))] for x in texts])
    v = refine.item_vector(F.col("kind"), F.col("question_vector"), F.col("answer_vector"), F.col("content_vector"))
    return found.select(F.col("c_custkey").alias("id"), v[0].alias("x"), v[1].alias("y"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda z: length(z) >= 2)) AS w, generate_subscripts(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda z: length(z) >= 2), 1) AS i FROM documents WHERE doc_id > 0),
f AS (SELECT doc_id, w, min(i) AS i FROM t GROUP BY ALL), g AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS ws FROM f GROUP BY doc_id)
SELECT 'e_' || doc_id AS entry_id, source AS title, md5(source || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' || source || ' ' || ws) AS search_text FROM documents JOIN g USING (doc_id)""")
def n08_entries(spark, sf_dir):
    """Documents that have a token as plain items; duplicates, of which item 0 is one, make no entry."""
    docs = t(spark, sf_dir, "documents")
    items = docs.select(F.col("doc_id").alias("knowledge_id"), F.lit("plain").alias("knowledge_type"), F.col("source").alias("title"), F.lit("").alias("question"), F.lit("").alias("answer"), F.col("text").alias("content"), F.lit(None).cast("array<double>").alias("vector"), F.col("source").alias("source_item_id"), F.col("doc_id").alias("sort_no"), F.when(F.col("doc_id") == 0, 1).alias("is_duplicate"))
    return refine.build_entries(items).filter(F.size(retrieval.tokens(F.col("content"), 2)) > 0).select("entry_id", "title", F.md5("search_text").alias("search_text"))


# Search


@query("""SELECT c_custkey, ['name', c_name, 'run'] AS index_terms, CASE WHEN c_custkey % 2 = 0 THEN ['name', 'run', '7'] ELSE ['name', 'run'] END AS asked_terms FROM customer""")
def c25_c26_terms(spark, sf_dir):
    """A tokenizer that tells parts of speech: index and query take different terms of the same tokens."""
    def tokenize(text):
        name, digit = text.split("|")
        return [("name", "*", "名詞"), ("は", "は", "助詞"), (name, None, "記号"), ("run", "run", "動詞"), (digit, digit, "数"), ("x", "x", "副詞"), ("run", "run", "動詞")]

    texts = t(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("|"), F.when(F.col("c_custkey") % 2 == 0, "7").otherwise("y")).alias("text"))
    found = retrieval.analysed(texts, "text", tokenize)
    return found.select("c_custkey", retrieval.index_terms(F.col("tokens")).alias("index_terms"), retrieval.asked_terms(F.col("tokens")).alias("asked_terms"))


@query(r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) WHERE term IN ('the', 'license', 'und') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT doc_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN df USING (term) CROSS JOIN st GROUP BY doc_id)
SELECT 'e_' || doc_id AS entry_id, round(score, 6) AS score FROM s WHERE round(score, 6) < 0 ORDER BY round(score, 6), doc_id LIMIT 10""")
def r09_plain_search(spark, sf_dir):
    """The facade's full-text mode over a stored search database, with tiers wide enough for every hit."""
    docs = t(spark, sf_dir, "documents")
    entries = docs.select(F.concat(F.lit("e_"), "doc_id").alias("entry_id"), F.lit("plain").alias("knowledge_type"), F.col("text").alias("search_text"), F.col("doc_id").alias("sort_no"), F.lit("").alias("created_at"))
    folder, name = neardup.stage_dir(spark), f"documents-{uuid.uuid4().hex}"
    sinks.build_search_db(entries, folder, name, "documents")
    stored, _ = sinks.open_search_db(spark, folder, name)
    index = sinks.open_search_index(spark, folder, name)
    found = retrieval.search(spark, stored, "the license\nund", "plain_fts", {"fts": {"strong_bm25_max": 0, "weak_bm25_max": 0, "top_k": 10}}, index=index)
    return found.select("entry_id", F.round("score", 6).alias("score"))


@query("SELECT label, label % 2 <> 0 AS ok FROM (SELECT DISTINCT label FROM embeddings)")
def a10_mean_of_mixed_lengths(spark, sf_dir):
    """Groups with a vector of another length have no mean; null vectors are passed over."""
    rows = t(spark, sf_dir, "embeddings").select("label", "embedding")
    odd = rows.select("label").distinct().withColumn("embedding", F.when(F.col("label") % 2 == 0, F.array(F.lit(1.0))).cast("array<float>"))
    return V.group_mean(rows.unionByName(odd), "label", "embedding").select("label", F.col("mean").isNotNull().alias("ok"))
