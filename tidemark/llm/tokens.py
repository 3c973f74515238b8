"""Operators 1 and 7: token counts, and BPE encoding and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import base, bpe

BYTE_BPE = "byte_bpe_50k.json"


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs(doc_id, text).

    Counts come from merging alone: symbols at the start less merges made. A null text counts as empty
    (0 bytes, 0 tokens); a row with a null or repeated doc_id is counted like any other; other columns are
    ignored; an empty table gives an empty result. A text of any length is taken whole: a word of n bytes
    costs n log n, not n^2. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.worker(bpe.Counter, path)
        for batch in batches:
            whole = batch.column("text").to_pylist()
            n = np.fromiter(map(coder.count, whole), np.int64, len(whole))
            size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in whole), np.int64, len(whole))
            yield pa.record_batch([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return base.texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (text from the ids) of each row of docs.

    Null text: empty, no ids. Nulls and repeats in doc_id are carried through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.worker(bpe.Merger, path)
        for doc, ids, text in _coded(batches, coder):
            yield pa.record_batch([doc, pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return base.texts(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded(), digested where it is made, so that
    ids and texts don't leave the Python worker. Same treatment of nulls as encoded()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.worker(bpe.Merger, path)
        for doc, ids, text in _coded(batches, coder):
            cols = [doc, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256(x).hexdigest() for x in ids]), pa.array([sha256(x.encode()).hexdigest() for x in text])]
            yield pa.record_batch(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return base.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _coded(batches: Iterator[pa.RecordBatch], coder: bpe.Merger, rows: int = 512) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids = list(map(coder.encode, part.column("text").to_pylist()))
            yield part.column("doc_id"), ids, [coder.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(base.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(base.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
