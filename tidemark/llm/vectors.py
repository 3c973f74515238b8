"""Operator 4: near-duplicate vectors by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import base
from tidemark.llm.components import components

#: Rows of a group that meet in one task at once: larger groups are cut into tiles of about this many.
TILE = 1024


def collision(distance: float, width: float) -> float:
    """Chance that a quantised Gaussian projection puts two points of this distance in one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Tables:
    """cosine: least similarity of a link. width: of a projection's cells, for unit vectors. usual: other vectors
    that an unrelated vector should meet in a bucket at most, on average; it sets the projections of a
    table. miss: chance that a pair just at the threshold shares no bucket; it sets the number of tables."""

    cosine: float = 0.9
    width: float = 2.0
    usual: int = 32
    miss: float = 0.01
    seed: int = 5

    def shape(self, rows: int) -> tuple[int, int]:
        """Tables and projections in each, for this many vectors."""
        near, far = collision(math.sqrt(2 - 2 * self.cosine), self.width), collision(math.sqrt(2), self.width)
        each = max(8, math.ceil(math.log(max(rows, 1) / self.usual) / -math.log(far))) if rows else 8
        return math.ceil(math.log(self.miss) / math.log1p(-(near**each))), each

    def buckets(self, vectors: np.ndarray, tables: int, each: int) -> np.ndarray:
        """A 64-bit bucket of each vector (row) in each table (column)."""
        rng = np.random.default_rng([self.seed, vectors.shape[1]])
        cells = np.floor((vectors @ rng.normal(size=(vectors.shape[1], tables * each)) + rng.uniform(0, self.width, tables * each)) / self.width)
        out = np.zeros((len(vectors), tables), np.uint64)
        with np.errstate(over="ignore"):
            for k, column in enumerate(cells.astype(np.int64).view(np.uint64).reshape(len(vectors), tables, each).transpose(2, 0, 1)):
                out = base.mixed(out + column * np.uint64(2 * k + 1) + np.uint64(0x9E3779B97F4A7C15))
        return out


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of vectors of one length and kind."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small numbers leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tiled(df: DataFrame, key: list[str], size: str) -> DataFrame:
    """Rows of df with a column tile: groups of over TILE rows are cut into parts, by a hash of vec_id, and each
    pair of parts meets in a tile; home says which of the tile's two parts the row is of, own that both are one."""
    parts = F.ceil(F.col(size) / F.lit(TILE)).cast("int")
    mine = F.pmod(F.xxhash64("vec_id", F.lit(99)), F.col("parts")).cast("int")
    other = F.expr("explode(sequence(0, parts - 1))")
    out = df.withColumn("parts", parts).withColumn("mine", mine).withColumn("other", other)
    tile = F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")
    return out.withColumn("tile", F.when(F.col("parts") > 1, tile).otherwise(F.lit(0).cast("long"))).withColumn("home", F.col("mine")).withColumn("own", F.col("mine") == F.col("other")).drop("parts", "mine", "other", size)


def _by_group(df: DataFrame, key: list[str], result: list[tuple[str, pa.DataType]], each: Callable[[dict[str, list]], list[list]], over: Callable[[tuple, dict[str, list]], list[list]] | None = None) -> DataFrame:
    """each(rows) of every group of rows with an equal key, as columns of result: partitions are sorted by the key
    and read as a stream, so that small groups cost little and a task holds one group. With over, a group of more
    than TILE rows isn't held: over(key, rows) takes its rows as they come."""
    names = [c for c in df.columns if c not in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, large, found = None, {n: [] for n in names}, False, []

        def done() -> None:
            if large:
                found.append(over(last, held))
            elif len(held[names[0]]) > 1:
                found.append(each(held))

        def out() -> Iterator[pa.RecordBatch]:
            if any(x[0] for x in found):
                yield pa.record_batch([pa.array([v for x in found for v in x[i]], t) for i, (_, t) in enumerate(result)], [n for n, _ in result])
            found.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            cols = {n: batch.column(n).to_pylist() for n in names}
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != last:
                    done()
                    last, held, large = keys[a], {n: [] for n in names}, False
                for n in names:
                    held[n] += cols[n][a:b]
                if over and len(held[names[0]]) > TILE:
                    large = True
                if large:
                    found.append(over(last, held))
                    held = {n: [] for n in names}
            yield from out()
        done()
        yield from out()

    spread = df.repartition(*key).sortWithinPartitions(*key)
    return spread.mapInArrow(run, ", ".join(f"{n} {'int' if t == pa.int32() else 'long'}" for n, t in result))


def near_vectors(rows: DataFrame, tables: Tables | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of rows(vec_id, embedding).

    Two vectors link when the cosine of them in double precision is the threshold or more. Equal vectors form
    a class, whose smallest vec_id stands for it. Buckets of all tables, cut into tiles where large, give
    a spanning forest of the links in each, checked exactly; its components, cut into tiles likewise, are then
    compared in full, so that every link within a component counts, shared bucket or not.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, are their own
    component and are kept; vectors of unequal lengths never link. Rows with a null vec_id link with nothing and
    aren't kept. Equal vec_ids are rows of their own that share a component if their vectors do. Other
    columns are ignored; an empty table gives an empty result.
    """
    tables = tables or Tables()
    # What moves between tasks is as wide as the input's numbers; arithmetic is in doubles.
    kind = "<f4" if rows.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    doubles = F.col("embedding").cast("array<double>")
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0)
    usable = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    # + 0.0 makes -0.0 and 0.0 one value
    vectors = rows.select("vec_id", F.when(usable, F.transform(doubles, lambda x: x + F.lit(0.0))).alias("vector"))
    keyed = base.saved(vectors.withColumn("key", F.xxhash64("vector")), "vectors")
    valid = keyed.filter("vector IS NOT NULL")
    classes = base.saved(valid.groupBy("key", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    many, each = tables.shape(classes.count())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            raw = [np.asarray(v, kind) for v in batch.column("vector").to_pylist()]
            for n in {len(x) for x in raw}:
                of = [i for i, x in enumerate(raw) if len(x) == n]
                data = [raw[i].tobytes() for i in of]
                bucket = tables.buckets(_matrix(data, kind), many, each)
                t = np.tile(np.arange(many), len(of))
                again = np.repeat(np.arange(len(of)), many)
                reps = pa.array([batch.column("rep")[i].as_py() for i in of], pa.int64())
                cols = [reps.take(pa.array(again)), pa.array(data, pa.binary()).take(pa.array(again)), pa.array(t, pa.int32()), pa.array(bucket.reshape(-1).view(np.int64) ^ n)]
                yield pa.record_batch(cols, ["vec_id", "data", "place", "bucket"])

    placed = classes.select("rep", "vector").mapInArrow(hashed, "vec_id long, data binary, place int, bucket long")

    def forest(held: dict[str, list]) -> list[list]:
        x, ids = _matrix(held["data"], kind), held["vec_id"]
        linked = x @ x.T >= tables.cosine
        np.fill_diagonal(linked, False)
        u, v, left = [], [], np.ones(len(ids), bool)
        for root in np.flatnonzero(linked.any(axis=1)).tolist():
            if not left[root]:
                continue
            left[root], front = False, [root]
            while front:
                i = front.pop()
                for j in np.flatnonzero(linked[i] & left).tolist():
                    left[j] = False
                    front.append(j)
                    u.append(ids[root])
                    v.append(ids[j])
        return [u, v, [None] * len(u), [None] * len(u)]

    def over(key: tuple, held: dict[str, list]) -> list[list]:
        n = len(held["vec_id"])
        return [held["vec_id"], [None] * n, [key[0]] * n, [key[1]] * n]

    pair = [("u", pa.int64()), ("v", pa.int64()), ("place", pa.int32()), ("bucket", pa.int64())]
    met = base.saved(_by_group(placed, ["place", "bucket"], pair, forest, over), "met")
    large = met.filter("v IS NULL").select(F.col("u").alias("vec_id"), "place", "bucket")
    large = large.join(large.groupBy("place", "bucket").count(), ["place", "bucket"]).join(classes.select(F.col("rep").alias("vec_id"), "vector"), "vec_id")
    tiles = _tiled(large, ["place", "bucket"], "count")

    def forest_of_arrays(held: dict[str, list]) -> list[list]:
        out = []
        for size in {len(x) for x in held["vector"]}:
            of = [i for i, x in enumerate(held["vector"]) if len(x) == size]
            out.append(forest({"vec_id": [held["vec_id"][i] for i in of], "data": [np.asarray(held["vector"][i], kind).tobytes() for i in of]}))
        return [[v for x in out for v in x[i]] for i in range(4)]

    links = met.filter("v IS NOT NULL").select("u", "v").union(_by_group(tiles, ["place", "bucket", "tile"], pair, forest_of_arrays).select("u", "v"))
    found = base.saved(components(base.saved(links.distinct(), "links")), "components")

    members = found.groupBy("component").count()
    raw = classes.select(F.col("rep").alias("vec_id"), "vector", "copies")
    grouped = raw.join(found.withColumnRenamed("node", "vec_id"), "vec_id").join(members, "component")

    def counts(held: dict[str, list]) -> list[list]:
        copies, home = np.asarray(held["copies"], np.int64), np.asarray(held["home"])
        lengths = np.asarray([len(v) for v in held["vector"]])
        n = np.zeros(len(copies), np.int64)
        for size in np.unique(lengths):
            of = np.flatnonzero(lengths == size)
            x = _matrix([np.asarray(held["vector"][i], kind).tobytes() for i in of], kind)
            linked = x @ x.T >= tables.cosine
            np.fill_diagonal(linked, False)
            if not held["own"][0]:  # pairs within a part are counted in the tile of that part alone
                linked &= home[of][:, None] != home[of][None, :]
            n[of] = linked @ copies[of]
        return [held["vec_id"], n.tolist()]

    tiles = _tiled(grouped, ["component"], "count")
    linked = _by_group(tiles, ["component", "tile"], [("vec_id", pa.int64()), ("links", pa.int64())], counts).groupBy("vec_id").agg(F.sum("links").alias("links"))

    about = classes.join(linked.withColumnRenamed("vec_id", "rep"), "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    about = about.select("key", "vector", "copies", F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("component", "rep"))
    about = base.saved(about.toDF("key", "same", "copies", "n_links", "component_id"), "about")
    out = base.looked_up(valid, about, "key", "copies", keyed.count()).filter(F.col("vector") == F.col("same"))
    rest = keyed.filter("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", "n_links", "component_id").unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(base.table(spark, sf_dir, "embeddings"))
