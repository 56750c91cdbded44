"""Token counts (9): rollups of documents and tokens by source, language and tokenizer version, kept up by deltas.

A change is a signed image of a document: +1 for what came, -1 for what went; a revision is both. A batch's images are
tokenized in their own partitions, folded there into sums, and added up into the batch's delta, a few rows a group. An
attempt writes its delta to a folder of its own and counts once a commit under the batch's id names it; a commit is never
replaced. So a batch that ran twice, that two writers bring at once, or that an attempt left half written leaves the totals
as if it had run once. Totals are the sums of the committed deltas; compact() folds deltas into one table and publishes
that by a manifest, so a crash at any point leaves the totals as they were, and batch ids are kept for good.

Null source or language is a group of its own. Null text counts as empty (a document of no tokens). Repeated rows count
each time. An empty batch commits an empty delta. Extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm.common import slices
from tarnmill.llm.packing import default_vocabulary, encoder

DELTA = "source string, lang string, tokenizer string, documents long, tokens long"
KEYS = ["source", "lang", "tokenizer"]


def images(docs: DataFrame, sign: int) -> DataFrame:
    """docs(source, lang, text) as inserts (sign 1) or deletes (sign -1)."""
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.lit(sign).cast("long").alias("sign"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The changes that turn the documents `before` into `after`."""
    return images(before, -1).unionByName(images(after, 1))


def delta(changes: DataFrame, tokenizers: dict[str, str] | None = None, most_keys: int = 50_000) -> DataFrame:
    """The sums of changes(source, lang, text, sign) under each tokenizer version {name: vocabulary file}."""
    versions = tokenizers or {"byte_bpe_50k": default_vocabulary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [*KEYS, "documents", "tokens"])

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("source", "lang", "text", "sign")]
            for name, path in versions.items():
                lengths = [len(x) for x in encoder(path)([t or "" for t in columns[2]])]
                for source, lang, sign, n in zip(columns[0], columns[1], columns[3], lengths, strict=True):
                    total = sums.setdefault((source, lang, name), [0, 0])
                    total[0] += sign
                    total[1] += sign * n
            if len(sums) >= most_keys:
                yield out()
        yield out()

    return changes.mapInArrow(run, DELTA).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Store:
    """The small files of a rollup's folder, through Hadoop's file systems.

    deltas/<batch id>/<attempt> holds one attempt's sums, commits/<batch id> names the attempt that counts, and
    manifests/<n> names the folded table and the batch ids in it; the highest n holds. A commit or a manifest is written
    elsewhere and renamed to its name, which fails if another writer was first.
    """

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}" if name else self.state)

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, content: str) -> bool:
        """Writes a file that must not be there yet, whole or not at all; False if it is there."""
        draft = f"drafts/{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft))
        stream.write(bytearray(content.encode()))
        stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(draft), self.path(name), options)
        except Py4JJavaError as error:
            self.fs.delete(self.path(draft), False)
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def manifest(self) -> tuple[int, str | None, list[str]]:
        """(n, folded table, batch ids in it) of the manifest that holds; 0 if there is none."""
        found = self.names("manifests")
        if not found:
            return 0, None, []
        held = json.loads(self.read(f"manifests/{found[-1]}"))
        return int(found[-1]), held["folded"], held["batches"]


def commit_batch(state: str, batch_id: str, changes: DataFrame, tokenizers: dict[str, str] | None = None) -> bool:
    """Adds a batch of changes to the totals in the folder `state`; False if that batch had been committed before.

    Of writers that bring the same batch at once, one commits; what the others wrote is removed.
    """
    store, name = Store(changes.sparkSession, state), quote(batch_id, safe="")
    if store.fs.exists(store.path(f"commits/{name}")):
        return False
    attempt = f"deltas/{name}/{uuid.uuid4().hex}"
    delta(changes, tokenizers).write.parquet(f"{store.state}/{attempt}")
    if store.publish(f"commits/{name}", attempt):
        return True
    store.remove(attempt)
    return False


def totals(spark: SparkSession, state: str) -> DataFrame:
    """source, lang, tokenizer, documents, tokens: the sums of all committed deltas; groups that came to nothing are left out."""
    return _totals(spark, Store(spark, state))[0]


def _totals(spark: SparkSession, store: Store) -> tuple[DataFrame, int, list[str], list[str]]:
    """The totals, the manifest's number, and the batch ids in its table and since."""
    n, folded, batches = store.manifest()
    later = sorted(set(store.names("commits")) - set(batches))
    paths = [f"{store.state}/{p}" for p in [*([folded] if folded else []), *(store.read(f"commits/{b}") for b in later)]]
    rows = spark.read.schema(DELTA).parquet(*paths) if paths else spark.createDataFrame([], DELTA)
    summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return summed.filter("documents <> 0 or tokens <> 0"), n, batches, later


def compact(spark: SparkSession, state: str) -> bool:
    """Folds every committed delta into one table; False if nothing is new or another compaction was first.

    The totals stay as they are and so do the batch ids: a batch that comes again after this still counts once. Old files
    stay for those who read them, until clean().
    """
    store = Store(spark, state)
    summed, n, batches, later = _totals(spark, store)
    if not later:
        return False
    folded = f"folded/{uuid.uuid4().hex}"
    summed.write.parquet(f"{store.state}/{folded}")
    if store.publish(f"manifests/{n + 1:012d}", json.dumps({"folded": folded, "batches": batches + later})):
        return True
    store.remove(folded)
    return False


def clean(spark: SparkSession, state: str) -> None:
    """Removes what no total needs any more; to be run when nothing else reads or writes `state`."""
    store = Store(spark, state)
    _, folded, batches = store.manifest()
    for name in store.names("manifests")[:-1]:
        store.remove(f"manifests/{name}")
    for name in store.names("folded"):
        if f"folded/{name}" != folded:
            store.remove(f"folded/{name}")
    for name in store.names("deltas"):
        wanted = None if name in batches or not store.fs.exists(store.path(f"commits/{name}")) else store.read(f"commits/{name}")
        for attempt in store.names(f"deltas/{name}"):
            if f"deltas/{name}/{attempt}" != wanted:
                store.remove(f"deltas/{name}/{attempt}")
    store.remove("drafts")
