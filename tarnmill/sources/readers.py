"""Readers of the library's inputs: tables, REST dumps, files of several kinds, and status documents."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.functions import text as T
from tarnmill.operators import splitting

#: Encodings tried in order before bad bytes are left out (fixed values).
ENCODINGS = ("utf-8", "shift_jis", "cp932")
#: Records a page of the parliament's endpoints may have (fixed values).
PAGE_CAPS = {"speech": 100, "list": 100}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_pages(spark: SparkSession, path: str, record_key: str, schema: str, most: int | None = None) -> DataFrame:
    """Records of saved REST pages (JSON files with an array under `record_key`), in page order, at most `most` of them."""
    pages = spark.read.schema(f"{record_key} array<{schema}>").option("multiLine", True).json(path).withColumn("page", F.input_file_name())
    rows = pages.select("page", F.posexplode(record_key).alias("at", "record")).select("page", "at", "record.*")
    return rows.orderBy("page", "at").limit(most).drop("page", "at") if most else rows.drop("page", "at")


def read_datasets(spark: SparkSession, path: str, schema: str, allowed: Sequence[str], most: int | None = None) -> DataFrame:
    """Datasets of saved catalog searches that have a resource of an allowed format; a reply that reports no success fails."""
    replies = spark.read.schema(f"success boolean, result struct<results:array<{schema}>>").option("multiLine", True).json(path)
    checked = replies.withColumn("ok", F.when(F.col("success") & F.col("result").isNotNull(), True).otherwise(F.raise_error(F.lit("the catalog reported no success"))))
    sets = checked.filter("ok").select(F.explode("result.results").alias("d")).select("d.*")
    found = sets.filter(F.exists("resources", lambda r: resource_allowed(r["format"], r["url"], allowed)))
    return found.limit(most) if most else found


def resource_allowed(kind, url, allowed: Sequence[str]):
    """Whether a declared format or an address's suffix is allowed."""
    wanted = [a.lower() for a in allowed]
    return F.lower(T.text(kind)).isin(wanted) | T.extension(url).isin(wanted)


def decode(binary: bytes | None) -> str:
    for encoding in ENCODINGS:
        try:
            return (binary or b"").decode(encoding)
        except UnicodeDecodeError:
            continue
    return (binary or b"").decode("utf-8", "ignore")


def _mapped(files: DataFrame, key: str, read: Callable[[bytes], object], kind: pa.DataType, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([read(b) for b in batch.column("content").to_pylist()], kind)], [key, "found"])

    return files.select(key, "content").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, found {schema}")


def decoded(files: DataFrame, key: str) -> DataFrame:
    """(key, text) of files(key, content): UTF-8 in the JVM; only other files go through the Japanese code pages."""
    plain = files.filter(F.is_valid_utf8(F.col("content").cast("string"))).select(key, F.col("content").cast("string").alias("text"))
    other = files.filter(~F.is_valid_utf8(F.col("content").cast("string")))
    return plain.unionByName(_mapped(other, key, decode, pa.string(), "string").withColumnRenamed("found", "text"))


def read_csv_records(files: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """(key, index, record) of files(key, content): a map of header to cleaned cell for each row, the first `most` of a file.

    Rows with too few cells have empty ones; cells beyond the header are dropped.
    """
    import csv

    def read(content: bytes) -> list[list[tuple[str, str]]]:
        rows = csv.DictReader(io.StringIO(decode(content).lstrip("\ufeff"), newline=""))
        return [[(k, v or "") for k, v in r.items() if k is not None] for _, r in zip(range(most), rows)]

    found = _mapped(files, key, read, pa.list_(pa.map_(pa.string(), pa.string())), "array<map<string,string>>")
    cells = found.select(key, F.posexplode("found").alias("index", "record"))
    return cells.withColumn("record", F.transform_values("record", lambda _, v: T.clean_cell(v)))


def read_text_records(files: DataFrame, key: str, most: int = 2000) -> DataFrame:
    return splitting.split_texts(decoded(files, key), key, most)


def read_json_records(files: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """JSON files as indented text, then as text records; what is no JSON is taken as it is."""

    def pretty(content: bytes) -> str:
        raw = decode(content)
        try:
            return json.dumps(json.loads(raw), ensure_ascii=False, indent=2)
        except ValueError:
            return raw

    return splitting.split_texts(_mapped(files, key, pretty, pa.string(), "string").withColumnRenamed("found", "text"), key, most)


def read_pdf_records(files: DataFrame, key: str, extract: Callable[[bytes], Sequence[str | None]], most: int = 2000) -> DataFrame:
    """(key, page, text, char_count) of files(key, content), by an extractor that gives the text of each page; failures are empty."""

    def read(content: bytes) -> list[str]:
        try:
            return [p or "" for p in extract(content)][:most]
        except Exception:  # any fault of the extractor leaves the file empty
            return []

    found = _mapped(files, key, read, pa.list_(pa.string()), "array<string>")
    return splitting.split_pages(found.select(key, F.posexplode("found").alias("page", "text")).withColumn("page", F.col("page") + 1), key)


def read_records(files: DataFrame, key: str, extract: Callable[[bytes], Sequence[str | None]] | None = None, json_as_text: bool = False) -> DataFrame:
    """(key, kind, index, text) of files(key, path, content): each file by the kind that its path names."""
    named = files.withColumn("kind", T.content_kind(T.extension(F.col("path"))))
    of = lambda *kinds: named.filter(F.col("kind").isin(*kinds))
    plain = [*["json"] * json_as_text, "text", "html", ""]
    parts = [
        read_csv_records(of("csv"), key).select(key, F.lit("csv").alias("kind"), "index", T.pairs_text(F.col("record")).alias("text")),
        read_text_records(of(*plain), key).select(key, F.lit("text").alias("kind"), "index", "text"),
    ]
    if not json_as_text:
        parts.append(read_json_records(of("json"), key).select(key, F.lit("json").alias("kind"), "index", "text"))
    if extract:
        parts.append(read_pdf_records(of("pdf"), key, extract).select(key, F.lit("pdf").alias("kind"), F.col("page").alias("index"), "text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_status(spark: SparkSession, path: str, schema: str = "job_id string, status string, phase string, updated_at string, error_chunks int") -> DataFrame:
    """Status documents (one JSON object a file), newest first; those without a time come last."""
    return spark.read.schema(schema).option("multiLine", True).json(path).orderBy(F.coalesce("updated_at", F.lit("")).desc())


def ordered_rows(rows: DataFrame, parent: str, value, *order: str) -> DataFrame:
    """A parent's rows in order (nulls first)."""
    return rows.filter(F.col(parent) == value).orderBy(*[F.col(c).asc_nulls_first() for c in order])


def first_alias(record: str, names: Sequence[str]):
    """The first of several spellings of a field that has a text, in a map column (struct fields ignore case)."""
    return T.first_text([F.try_element_at(F.col(record), F.lit(n)) for n in names])


def number_children(rows: DataFrame, parent: str, order: Sequence[str], name: str = "file_no") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def read_details(listing: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """The detail records of the listed keys, each once, whatever the listing repeats; details come from a second endpoint.

    Both are read_pages(); a listing or a detail table without the key is refused.
    """
    for df in (listing, details):
        if key not in df.columns:
            raise ValueError(f"no {key} in {df.columns}")
    wanted = listing.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(key).distinct()
    return details.join(wanted, key, "left_semi")


def stored_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_size) of the files under a folder; their bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("file_size"))


def uploads(files: DataFrame, objects: DataFrame, path: str = "path") -> DataFrame:
    """Upload rows, newest first, with the size of their object; null where it is missing."""
    return files.join(objects, path, "left").withColumn("title", F.col("file_name")).orderBy(F.col("created_at").desc(), "file_id")


def configured_sources(found: DataFrame) -> DataFrame:
    """(source_key, label, url) of a configuration's sources array, trimmed; null entries are left out."""
    each = found.select(F.explode("sources").alias("s")).filter("s is not null")
    return each.select(*[T.strip(F.col(f"s.{c}")).alias(c) for c in ("source_key", "label", "url")])


def upload_limits(found: Mapping | None, ext: str | None, prompt_type: str) -> Mapping:
    """The chunk settings of an upload's suffix and prompt type, or the older ones of the prompt type alone.

    Raises ValueError where neither is there.
    """
    suffix = (ext or "").strip().lower()
    suffix = "txt" if suffix == "text" else suffix
    section = (found or {}).get("upload") or {}
    own = section.get(suffix)
    settings = (own.get(prompt_type) if isinstance(own, Mapping) else None) or section.get(prompt_type)
    if not settings:
        raise ValueError(f"no chunk settings for upload.{suffix}.{prompt_type}")
    return settings


#: Source types that a request may name, and kinds of knowledge (fixed values).
SOURCE_TYPES = ("kokkai", "opendata", "public_url", "upload")
KNOWLEDGE_TYPES = ("qa", "plain")


def checked_request(source_type: str, knowledge_type: str | None = None, db_name: str | None = None) -> tuple[str, str | None, str | None]:
    """A request's names as they are used, or ValueError: known types, and a database name that is no path."""
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"unsupported source_type: {source_type}")
    kind = knowledge_type.strip().lower() if knowledge_type is not None else None
    if kind is not None and kind not in KNOWLEDGE_TYPES:
        raise ValueError("knowledge_type is qa or plain")
    name = db_name.strip() if db_name is not None else None
    if name is not None and (not name or "/" in name or "\\" in name or not name.endswith(".sqlite")):
        raise ValueError(f"no database name: {db_name!r}")
    return source_type, kind, name


def config(found: Mapping | None, fallback: Mapping) -> dict:
    """A configuration, or the fallback where there is none."""
    return dict(found) if found else dict(fallback)
