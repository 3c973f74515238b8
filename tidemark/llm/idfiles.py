"""Operator 9: token ids in patched frame-of-reference files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import base, library

BLOCK = 256
#: Share of a block's values that fit its width; the others are exceptions.
FITTING = 0.9
#: Ids after which a task begins a new file image.
IMAGE_IDS = 2_000_000
MAGIC = b"PFR1"
_IMAGES = "task int, image int, n_ids long, docs array<long>, lengths binary, ids binary"

_HEAD = np.dtype([("magic", "S4"), ("values", "<u8"), ("blocks", "<u4")])
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def _cell(width: int) -> int:
    """Bits of the machine integer that holds a width."""
    return 16 if width <= 16 else 32


def _bits(rows: np.ndarray, width: int) -> np.ndarray:
    """The low bits of rows of values, most significant first, packed row by row."""
    cell = _cell(width)
    raw = rows.astype(f">u{cell // 8}").view(np.uint8)
    if width == cell:
        return raw
    each = np.unpackbits(raw, axis=1).reshape(len(rows), BLOCK, cell)[:, :, cell - width :]
    return np.packbits(each.reshape(len(rows), -1), axis=1)


def _values(rows: np.ndarray, width: int) -> np.ndarray:
    """What _bits() packed."""
    cell = _cell(width)
    if width != cell:
        whole = np.zeros((len(rows), BLOCK, cell), np.uint8)
        whole[:, :, cell - width :] = np.unpackbits(rows, axis=1).reshape(len(rows), BLOCK, width)
        rows = np.packbits(whole.reshape(len(rows), -1), axis=1)
    return np.ascontiguousarray(rows).view(f">u{cell // 8}")


def packed(values: np.ndarray) -> bytes:
    """A stream of unsigned 32-bit integers as: head, start of each block, blocks.

    A block has its minimum, a width in bits that FITTING of the differences to it fit, the number of
    exceptions, the low bits of all differences, then places and high bits of the exceptions."""
    values = np.ascontiguousarray(values, np.uint32)
    n = -(-len(values) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(values)] = values
    full[len(values) :] = values[-1] if len(values) else 0
    rows = full.reshape(n, BLOCK)
    low = rows.min(axis=1) if n else np.empty(0, np.uint32)
    diff = rows - low[:, None]
    chosen = np.partition(diff, int(BLOCK * FITTING), axis=1)[:, int(BLOCK * FITTING)] if n else low
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    high = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    bits: list[bytes] = [b""] * n
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        lines, size = _bits(diff[of], int(w)).tobytes(), BLOCK * int(w) // 8
        for k, i in enumerate(of.tolist()):
            bits[i] = lines[k * size : (k + 1) * size]
    heads = np.zeros(n, _BLOCK_HEAD)
    heads["low"], heads["width"], heads["exceptions"] = low, width, np.count_nonzero(high, axis=1)
    of, places = np.nonzero(high)
    places, rests, front = places.astype(np.uint8).tobytes(), high[of, places].astype("<u4").tobytes(), heads.tobytes()
    ends, size, blocks = np.cumsum(heads["exceptions"], dtype=np.int64).tolist(), _BLOCK_HEAD.itemsize, []
    for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
        blocks.append(front[size * i : size * i + size] + bits[i] + places[a:b] + rests[4 * a : 4 * b])
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    return np.array((MAGIC, len(values), n), _HEAD).tobytes() + starts.tobytes() + b"".join(blocks)


def unpacked(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks first to last (without it) of a stream; all of them by default."""
    head = np.frombuffer(data, _HEAD, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a patched frame-of-reference stream")
    n = int(head["blocks"])
    last = n if last is None else min(last, n)
    begin = _HEAD.itemsize + 8 * n
    starts = np.frombuffer(data, "<u8", n, _HEAD.itemsize)[first:last].astype(np.int64) + begin
    out = np.zeros((max(0, last - first), BLOCK), np.uint32)
    if not len(out):
        return out.reshape(-1)
    raw = np.frombuffer(data, np.uint8)
    heads = np.frombuffer(raw[starts[:, None] + np.arange(_BLOCK_HEAD.itemsize)].tobytes(), _BLOCK_HEAD)
    for w in np.unique(heads["width"]):
        of = np.flatnonzero(heads["width"] == w)
        size = BLOCK * int(w) // 8
        out[of] = _values(raw[(starts[of] + _BLOCK_HEAD.itemsize)[:, None] + np.arange(size)], int(w))
    count, width = heads["exceptions"].astype(np.int64), heads["width"].astype(np.int64)
    row = np.repeat(np.arange(len(out)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (starts + _BLOCK_HEAD.itemsize + BLOCK * width // 8)[row]
    rest = np.ascontiguousarray(raw[(at + count[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    out[row, raw[at + nth]] |= rest.astype(np.uint32) << width[row].astype(np.uint32)
    out += heads["low"][:, None]
    return out.reshape(-1)[: int(head["values"]) - first * BLOCK]


def write_ids(docs: DataFrame, path: str, keeps_blank: bool, end_id: int, folder: str) -> None:
    """Ids of each text and end_id after it, in ascending doc_id order, as file images in folder.

    One row of the Parquet container is one image: task and image number (their order is that of the
    documents), doc ids, and two streams: lengths and ids. Executors need nothing but Spark's writer, so the
    folder may be in any store. Null text: empty; null doc_ids come first; rows of one doc_id stand in the order
    of a hash of their text, which deals them over tasks too. Rows equal in both land in one task. Other columns are
    ignored; an empty table gives an empty folder. The ids of one document must fit a Parquet cell (2 GB packed,
    about 2 GB of text); a longer text fails, it is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, end, image = library.worker(path, keeps_blank), TaskContext.get().partitionId(), np.uint32(end_id).tobytes(), 0
        docs, ids, held = [], [], 0

        def made() -> pa.RecordBatch:
            lengths = np.fromiter((len(x) // 4 for x in ids), np.uint32, len(ids))
            cols = [pa.array([task], pa.int32()), pa.array([image], pa.int32()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([packed(lengths)], pa.binary()), pa.array([packed(np.frombuffer(b"".join(ids), "<u4"))], pa.binary())]
            return pa.record_batch(cols, ["task", "image", "n_ids", "docs", "lengths", "ids"])

        for batch in batches:
            for part in base.sliced(batch):
                docs += part.column("doc_id").to_pylist()
                new = [x + end for x in encoder.encode(part.column("text"))]
                ids += new
                held += sum(map(len, new)) // 4
                if held >= IMAGE_IDS:
                    yield made()
                    docs, ids, held, image = [], [], 0, image + 1
        if docs:
            yield made()

    order = ["doc_id", F.xxhash64("text")]
    ordered = base.texts(docs).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    images = ordered.mapInArrow(run, _IMAGES)
    images.write.option("compression", "none").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from the files that write_ids made."""
    return _read(spark, folder, "ids binary", lambda x: (x, pa.binary()))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: read_ids(), digested where the files are decoded."""
    return _read(spark, folder, "ids_crc32 long", lambda x: (zlib.crc32(x), pa.int64()))


def _starts(images: DataFrame) -> DataFrame:
    """task, image, first: the place of each image's first id among all ids. Sums of whole tasks are added up first, one
    row a task; images of a task follow beside each other."""
    each = images.select("task", "image", "n_ids")
    up_to = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    tasks = each.groupBy("task").agg(F.sum("n_ids").alias("n_ids")).select("task", up_to(Window.orderBy("task")).alias("before"))
    inside = each.select("task", "image", up_to(Window.partitionBy("task").orderBy("image")).alias("inside"))
    return inside.join(tasks, "task").select("task", "image", (F.col("before") + F.col("inside")).alias("first"))


def ids_between(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """start, ids (little-endian unsigned 32-bit) of the places first to last (without it) among all ids, one row an
    image that has some of them: other images are left out before their streams are read, and of a stream only the
    blocks that the index gives are decoded."""
    images = spark.read.schema(_IMAGES).parquet(folder)
    there = base.saved(_starts(images), "starts").join(images.select("task", "image", "n_ids"), ["task", "image"])
    there = there.filter((F.col("first") < last) & (F.col("first") + F.col("n_ids") > first)).select("task", "image", F.col("first").alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(0, first - row["begin"]), last - row["begin"]
                at = a // BLOCK
                part = unpacked(row["ids"], at, -(-b // BLOCK))[a - at * BLOCK : b - at * BLOCK]
                yield pa.record_batch([pa.array([row["begin"] + a], pa.int64()), pa.array([part.astype("<u4").tobytes()], pa.binary())], ["start", "ids"])

    found = images.select("task", "image", "ids").join(there, ["task", "image"])
    return found.select("ids", "begin").mapInArrow(run, "start long, ids binary")


def _read(spark: SparkSession, folder: str, last: str, digest) -> DataFrame:
    images = spark.read.schema(_IMAGES).parquet(folder)
    starts = base.saved(_starts(images), "starts")  # one row an image; the images needn't be shuffled to meet it
    kind, name = digest(b"")[1], last.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = unpacked(row["lengths"]).astype(np.int64)
                ids, ends = unpacked(row["ids"]).astype("<u4"), np.cumsum(n)
                each = [digest(ids[a:b].tobytes())[0] for a, b in zip(ends - n, ends, strict=True)]
                yield pa.record_batch([pa.array(row["docs"], pa.int64()), pa.array(ends - n + row["first"]), pa.array(n), pa.array(each, kind)], ["doc_id", "start", "n_tokens", name])

    whole = images.select("task", "image", "docs", "lengths", "ids").join(starts, ["task", "image"])
    return whole.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = base.scratch(spark, "ids")
    write_ids(base.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), True, 2, folder)
    return read_digests(spark, folder)
