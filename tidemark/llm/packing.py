"""Operator 2: harmonic packing of documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import base, library

WORD_BPE = "word_bpe_49k.json"
CAPACITY = 2048
#: A bin of a class may stay empty up to this share of its capacity; a document that would leave more is cut.
SLACK = 1 / 64

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, at long"


def cuts(n: int, capacity: int, slack: float) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order. Class k holds pieces of over
    capacity / (k + 1) and at most capacity / k ids, k of them in a bin. While k pieces of the rest would
    leave too much of their bin empty, a piece that fits class k + 1 exactly is cut off its front."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if capacity - k * n > slack * capacity:
            out.append(capacity // (k + 1))
            n -= out[-1]
        else:
            out.append(n)
            break
    return out


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, slack: float) -> DataFrame:
    """Tokenised documents, cut; class, and place among the pieces of this class in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, end = library.worker(path, False), TaskContext.get().partitionId(), np.uint32(end_id).tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in base.sliced(batch):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                    ids += end
                    start = 0
                    for n in cuts(len(ids) // 4, capacity, slack):
                        k = capacity // n
                        rows.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, k, task, seen[k]))
                        seen[k] += 1
                        start += n
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "at"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    return base.texts(docs).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece.

    Each task classes and numbers its own pieces; the tasks' counts (one row a task and class) give every piece
    its number in its class, and bin = number div k without moving a text. What doesn't fill a last bin, under
    k pieces of each class k and so under 10,000 in all for capacity 2048 whatever the input, is packed by first
    fit in one task. sequence_id is bin * (2 * capacity) + k, with k = 0 for those last ones.

    Null text: empty, one piece of the end id alone. Null or repeated doc_id: packed like any other row. Other
    columns are ignored. An empty table gives an empty result. A document of any length is cut, never truncated.
    """
    cut = base.saved(pieces(docs, path, end_id, capacity, slack), "pieces")
    tasks = cut.groupBy("task", "class").count()
    order = Window.partitionBy("class").orderBy("task")
    tasks = tasks.select("task", "class", (F.sum("count").over(order) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy("class")).alias("all"))
    k = F.col("class").cast("long")
    placed = cut.join(base.saved(tasks, "tasks"), ["task", "class"]).withColumn("number", F.col("before") + F.col("at"))
    in_bin = F.col("number") < F.col("all") - F.col("all") % k
    rows = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    filled = placed.filter(in_bin).withColumn("sequence_id", F.expr("number div class") * (2 * capacity) + k)
    inside = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.select(*rows, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long")).alias("offset"))

    def first_fit(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "class", "number"], ascending=[False, True, True], kind="stable")
        used: list[int] = []
        place, offset = [], []
        for n in rest["length"]:
            b = next((i for i, u in enumerate(used) if u + n <= capacity), len(used))
            if b == len(used):
                used.append(0)
            place.append(b * 2 * capacity)
            offset.append(used[b])
            used[b] += n
        return rest.assign(sequence_id=place, offset=offset)[[*rows, "sequence_id", "offset"]]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    last = placed.filter(~in_bin).select(*rows, "class", "number").groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: first_fit(pdf), schema)
    return filled.unionByName(last)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(base.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
