"""Packing (6): power-of-two decomposition of documents into sequences that never cross a document.

A document's token ids, closed by an end id, are cut into full pieces of `max_length` and then into the binary digits
of what is left, longest first. Each piece is a sequence of its own whose length is a power of two, so nothing is
padded; batches are then drawn from one length bucket at a time.

Null text counts as empty and gives one piece with the end id alone. Null or repeated doc_ids are carried through; every
input row is packed by itself. An empty table gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tarnmill.llm.common import slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Token ids as the `tokenizers` library gives them for the vocabulary file at `path`.

    A vocabulary that also lies there as byte ranks (.tiktoken) is run by the faster library, which gives the same ids;
    texts that hold one of the vocabulary's special strings are always left to `tokenizers`.
    """
    import base64
    import os

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    plain = lambda text: np.asarray(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda texts: [plain(t) for t in texts]
    import public_tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [plain(t) if any(s in t for s in special) else np.asarray(quick.encode_ordinary(t), np.uint32) for t in texts]

    return encode


def piece_lengths(n: int, max_length: int) -> list[int]:
    """n as full pieces of max_length, then the binary digits of the rest, longest first."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(max_length.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, max_length: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text); with_ids adds token_ids, the piece itself.

    sequence_id is unique: the task's number and a count within it. `bucket` is the binary logarithm of the length.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    path = vocabulary or default_vocabulary()
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.asarray([end_id], np.uint32)
        sequence = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in [*names, *["token_ids"] * with_ids]}
            docs_in, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc, ids in zip(docs_in, encode([t or "" for t in texts]), strict=True):
                ids, start = np.concatenate([ids, end]), 0
                for length in piece_lengths(len(ids), max_length):
                    piece = ids[start : start + length]
                    row = (doc, start, length, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, 0, length.bit_length() - 1)
                    for k, v in zip(names, row, strict=True):
                        out[k].append(v)
                    if with_ids:
                        out["token_ids"].append(piece.astype(np.int32))
                    start += length
                    sequence += 1
            columns = [pa.array(out[k], pa.int32() if k == "bucket" else pa.int64()) for k in names]
            if with_ids:
                columns.append(pa.array(out["token_ids"], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, list(out))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES + (", token_ids array<int>" if with_ids else ""))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes packed pieces (with ids) in one folder per length, so that a batch is read from equal lengths."""
    pieces.write.partitionBy("bucket").mode("overwrite").parquet(path)
