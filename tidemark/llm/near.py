"""Operator 8: near-duplicates by an LSH forest of MinHash signatures, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.components import components
from tidemark.llm.vectors import _by_group

#: Shingles (and 256 a document) in a part of a dense region, about: two parts meet in a task at once.
PART = 1 << 18


@dataclass(frozen=True)
class Forest:
    """words: in a shingle. percent: least Jaccard similarity, in hundredths. trees: sorted orders. depth: hashes
    in a tree's label. shallow: least common prefix of a candidate pair. reach: neighbours on each side of a
    document in each order; regions of more than reach + 1 documents are then compared in full. miss: chance that a
    pair of neighbours of enough similarity isn't confirmed, whatever the sizes of the sets."""

    words: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 12
    shallow: int = 4
    reach: int = 4
    miss: float = 1e-6

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles: A-Z lower-cased, words cut at ASCII white space."""
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        return np.unique(base.windows(base.word_hashes(words), min(self.words, len(words))))

    def signature(self, shingles: np.ndarray) -> bytes:
        """One-permutation MinHash: the least hash in each of trees * depth equal ranges, 16 bits of it; an empty
        range takes that of the next range that has one, and the distance to it. Big-endian, so that
        the order of bytes is that of hashes. A bit a range follows: whether it isn't empty."""
        n = self.trees * self.depth
        bounds = (np.arange(n + 1, dtype=object) * (1 << 64) // n)[:-1].astype(np.uint64)
        at = np.searchsorted(shingles, bounds)
        full = at < np.append(at[1:], len(shingles))
        where = np.flatnonzero(full)
        source = where[np.searchsorted(where, np.arange(n)) % len(where)]
        away = (source - np.arange(n)) % n
        value = base.mixed(shingles[at[source]]) + away.astype(np.uint64) * np.uint64(40503)
        return (value & np.uint64(0xFFFF)).astype(">u2").tobytes() + np.packbits(full).tobytes()

    def sketches(self, rows: DataFrame) -> DataFrame:
        """row, doc_id, n_shingles, key (digest of the set; null if empty), signature of rows(row, doc_id, text)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = list(map(self.shingles, batch.column("text").to_pylist()))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                signed = [self.signature(s) if len(s) else None for s in sets]
                cols = [batch.column("row"), batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())]
                yield pa.record_batch(cols, ["row", "doc_id", "n_shingles", "key", "signature"])

        return rows.mapInArrow(run, "row long, doc_id long, n_shingles long, key binary, signature binary")

    def candidates(self, signed: DataFrame) -> DataFrame:
        """a < b: neighbours in a tree's sorted order with a common prefix of shallow hashes at least.

        All orders are one range-partitioned sort of (tree, label, doc_id), so a region of any density is spread
        over tasks evenly; where a region is dense, neighbours share prefixes as long as its labels allow.
        The first and last rows of each partition meet those of the next one in a second, small sort."""
        width, reach, prefix = 2 * self.depth, self.reach, 2 * self.shallow
        label = f"transform(sequence(0, {self.trees - 1}), t -> struct(t AS tree, substring(signature, t * {width} + 1, {width}) AS label))"
        rows = signed.select("rep", F.expr(f"inline({label})"))
        order = ["tree", "label", "rep"]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, seen, head, tail = TaskContext.get().partitionId(), 0, [], []

            def out(a, b, place, keys) -> pa.RecordBatch:
                n = len(a)
                cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([task] * n, pa.int32()), pa.array(place, pa.int64()), pa.array(keys, pa.binary())]
                return pa.record_batch(cols, ["a", "b", "task", "place", "region"])

            for batch in batches:
                tree, reps = batch.column("tree").to_pylist(), batch.column("rep").to_pylist()
                new = [(t.to_bytes(2, "big") + s[:prefix], r) for t, s, r in zip(tree, batch.column("label").to_pylist(), reps, strict=True)]
                if len(head) < reach:
                    head += new[: reach - len(head)]
                rows, old = tail + new, len(tail)
                a, b = [], []
                for j in range(1, reach + 1):
                    for i in range(max(0, old - j), len(rows) - j):
                        if rows[i][0] == rows[i + j][0]:
                            a.append(rows[i][1])
                            b.append(rows[i + j][1])
                seen += len(new)
                tail = rows[-reach:]
                yield out(a, b, [None] * len(a), [None] * len(a))
            # Rows at the ends, by place; in a partition of few rows one may be at both.
            ends = {i: x for i, x in enumerate(head)} | {seen - len(tail) + i: x for i, x in enumerate(tail)}
            yield out([r for _, r in ends.values()], [None] * len(ends), list(ends), [k for k, _ in ends.values()])

        found = base.saved(rows.mapInArrow(run, "a long, b long, task int, place long, region binary"), "neighbours")
        across = Window.orderBy("region", "task", "place")  # 2 * reach rows a task
        ends = found.filter("place IS NOT NULL")
        links = F.array(*(F.when(F.lead("region", j).over(across) == F.col("region"), F.lead("a", j).over(across)) for j in range(1, reach + 1)))
        ends = ends.select("a", links.alias("others")).select("a", F.explode("others").alias("b"))
        pairs = found.filter("place IS NULL").select("a", "b").union(ends.filter("b IS NOT NULL"))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()

    def dense(self, signed: DataFrame) -> DataFrame:
        """rep, n_shingles, region: the documents of each region (a prefix of shallow hashes in a tree) that has more
        than reach + 1; in one of fewer, every pair is of neighbours."""
        region = f"transform(sequence(0, {self.trees - 1}), t -> xxhash64(t, substring(signature, t * {2 * self.depth} + 1, {2 * self.shallow})))"
        rows = signed.select("rep", "n_shingles", F.explode(F.expr(region)).alias("region"))
        sizes = base.saved(rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > self.reach + 1), "regions")
        return base.looked_up(rows, sizes, "region", "size", signed.count() * self.trees).select("rep", "n_shingles", "region")

    def across(self, dense: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
        """u, v: links that join the components of found (node, component) within the regions of dense, so that no
        two documents of a region that are similar enough stay apart.

        Each pair of unlike components has a document outside the region's heaviest one. Those outside are cut
        into parts by a hash, which meet each other and the parts of the heaviest; documents of that never meet."""
        rows = dense.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        rows = base.saved(rows, "dense")
        each = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n_shingles") + 256).alias("weight"))
        most = F.max(F.struct("weight", "component"))
        regions = each.groupBy("region").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), most.alias("most"), F.count(F.lit(1)).alias("n"))
        cut = lambda weight: F.ceil(weight / F.lit(PART)).cast("int")
        regions = regions.filter("n > 1").select("region", "size", F.col("most.component").alias("heaviest"), cut(F.col("weight") - F.col("most.weight")).alias("few"), cut(F.col("most.weight")).alias("many"))
        placed = base.looked_up(rows, base.saved(regions, "regions"), "region", "size", rows.count())
        at = F.xxhash64("rep", F.lit(77))
        home = F.when(F.col("component") == F.col("heaviest"), F.col("few") + F.pmod(at, "many")).otherwise(F.pmod(at, "few")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("home") < F.col("few"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1)))
        placed = placed.withColumn("home", home).withColumn("other", other)
        tile = F.least("home", "other").cast("long") * (1 << 31) + F.greatest("home", "other")
        tiles = placed.select("region", tile.alias("tile"), "home", "component", "rep").join(sets.hint("merge"), "rep")
        return _by_group(tiles, ["region", "tile"], [("u", pa.int64()), ("v", pa.int64())], self.joined).distinct()

    def joined(self, held: dict[str, list]) -> list[list]:
        """u, v of links that join unlike components in a tile, found on whole sets: of one part, all pairs; of two,
        those across."""
        order = np.argsort(held["home"], kind="stable")
        home, rep = (np.asarray(held[c])[order] for c in ("home", "rep"))
        group = np.unique(held["component"], return_inverse=True)[1][order]
        sets = [np.frombuffer(held["shingles"][i], np.uint64) for i in order]
        size = np.asarray(list(map(len, sets)))
        end = np.cumsum(size)
        start = end - size
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        mine = np.zeros(len(flat), bool)
        one = home[0] == home[-1]
        second = len(home) if one else int(np.searchsorted(home, home[-1]))
        u, v = [], []
        for i in range(second):
            least = i + 1 if one else second
            may = (group[least:] != group[i]) & (100 * np.minimum(size[least:], size[i]) >= self.percent * np.maximum(size[least:], size[i]))
            of = least + np.flatnonzero(may)
            if not len(of):
                continue
            a, b = of[0], of[-1] + 1
            mine[flat[start[i] : end[i]]] = True
            same = np.add.reduceat(mine[flat[start[a] : end[b - 1]]], start[a:b] - start[a], dtype=np.int64)[of - a]
            mine[flat[start[i] : end[i]]] = False
            of = of[100 * same >= self.percent * (size[i] + size[of] - same)]
            others, first = np.unique(group[of], return_index=True)
            u += [int(rep[i])] * len(first)
            v += rep[of[first]].tolist()
            group[np.isin(group, others)] = group[i]
        return [u, v]

    def promising(self, pairs: DataFrame, signed: DataFrame) -> DataFrame:
        """a, b, match: pairs whose sizes and signatures allow the similarity.

        Among the ranges in which either set has a hash, the share with equal least hashes has the similarity as its
        mean; a share of m ranges falls t below it with a chance of exp(-2 m t^2) at most (Hoeffding, which
        holds for draws without replacement too), so the least share asked for follows from m and miss."""
        one = signed.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
        two = signed.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
        both = pairs.join(one, "a").join(two, "b")
        both = both.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        n = self.trees * self.depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                raw = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("s_a", "s_b")]
                s_a, s_b = (np.ascontiguousarray(x[:, : 2 * n]).view(">u2") for x in raw)
                f_a, f_b = (np.unpackbits(x[:, 2 * n :], axis=1, count=n).astype(bool) for x in raw)
                m = (f_a | f_b).sum(axis=1)
                match = ((s_a == s_b) & f_a & f_b).sum(axis=1) / m
                ok = match >= self.percent / 100 - np.sqrt(np.log(1 / self.miss) / (2 * m))
                yield pa.record_batch([c.filter(pa.array(ok)) for c in (batch.column("a"), batch.column("b"), pa.array(match))], ["a", "b", "match"])

        return both.mapInArrow(run, "a long, b long, match double")

    def sets(self, rows: DataFrame, reps: DataFrame) -> DataFrame:
        """rep, shingles (64-bit hashes, ascending) of the rows in reps(rep)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [self.shingles(t).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.record_batch([batch.column("rep"), pa.array(made, pa.binary())], ["rep", "shingles"])

        whole = rows.select(F.col("row").alias("rep"), "text").join(reps.hint("merge"), "rep")
        return whole.mapInArrow(run, "rep long, shingles binary")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """u, v: the pairs whose whole sets are similar enough."""
        one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a"))
        two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for a, b in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                    a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                    both = np.sort(np.concatenate([a, b]), kind="stable")
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok.append(100 * same >= self.percent * (len(a) + len(b) - same))
                yield pa.record_batch([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["u", "v"])

        return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(run, "u long, v long")


def _classes(rows: DataFrame, sketch: DataFrame, forest: Forest) -> DataFrame:
    """key, size, component_id, first (the row that stays) of each class of equal sets."""
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    classes = sketch.filter("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("rep"), first_row, F.count(F.lit(1)).alias("size"))
    classes = base.saved(classes, "classes")
    able = sketch.withColumnRenamed("row", "rep").filter(100 * F.col("n_shingles") >= forest.percent * (F.col("n_shingles") + 1))
    signed = base.saved(able.join(classes.select("rep"), "rep").select("rep", "n_shingles", "signature"), "signed")
    pairs = base.saved(forest.promising(forest.candidates(signed), signed), "pairs")
    dense = base.saved(forest.dense(signed), "dense")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).union(dense.select("rep")).distinct()
    sets = base.saved(forest.sets(rows, wanted), "sets")
    base.release(rows.sparkSession)

    sides = pairs.union(pairs.select("b", "a", "match"))
    best = Window.partitionBy("a").orderBy(F.desc("match"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")))
    first = sides.withColumn("rank", F.row_number().over(best)).filter("rank <= 2")
    first = base.saved(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
    links = base.saved(forest.confirmed(first, sets), "links")
    found = base.saved(components(links), "components")

    def of(column: str) -> DataFrame:
        return found.select(F.col("node").alias(column), F.col("component").alias(f"of_{column}"))

    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    more = base.saved(forest.confirmed(rest, sets), "links")
    if not more.isEmpty():
        links = links.union(more)
        found = base.saved(components(links), "components")
    more = base.saved(forest.across(dense, found, sets), "links")
    base.forget(sets)
    if not more.isEmpty():
        found = base.saved(components(links.union(more)), "components")

    classes = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = base.saved(classes.select("key", "size", "component", "least"), "classes")
    whole = classes.groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = base.looked_up(classes.drop("least"), base.saved(whole, "whole"), "component", "n", classes.count())
    return classes.select("key", "size", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first"))


def near_rows(rows: DataFrame, forest: Forest) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept, stays of rows(row, doc_id, text), which are read twice.

    stays holds for one row of each component: that of the smallest doc_id (null ones last), of equal ones that of the
    smallest row; and for rows without shingles."""
    sketch = base.saved(forest.sketches(rows), "sketches")
    classes = base.settled(rows.sparkSession, lambda: _classes(rows, sketch, forest), "classes")
    sketch = sketch.select("key", "row", "doc_id", "n_shingles")
    out = base.looked_up(sketch.filter("key IS NOT NULL").select("key", "row", "doc_id", "n_shingles"), classes, "key", "size", sketch.count())
    out = out.select("row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("first")).alias("stays"))
    none = sketch.filter("key IS NULL").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_dedup(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs(doc_id, text); shingles are of five words unless
    the forest says otherwise.

    Rows with equal sets of shingles form a class, which one of them stands for.
    Pairs of neighbours in the forest are confirmed in two rounds: first the two best of each class, then
    those that would join different components. Regions that have more classes than neighbours cover, and that
    are still of several components, are then compared in full. Every pair with a common prefix of shallow
    hashes in a tree is so either compared or known to lie within one component, whatever the size of its region.
    Sets too small to be similar enough to any but an equal one take no part in this.

    Null text, empty texts and texts of white space have no shingles: they link with nothing and are kept.
    Every row is a document of its own: rows that share a doc_id may lie in different components (component_id then
    differs, and kept is true for each whose component has that id as its smallest). Rows with a null doc_id link like
    others but aren't kept, and a component of such rows alone has a null id. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows, row = base.numbered(docs, ["doc_id", "text"])
    return near_rows(base.row_texts(rows, row), forest or Forest()).select("doc_id", "n_shingles", "component_id", "kept")


def without_near(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """The rows of docs, with all columns, that stay: one of each component (see near_rows()), and all rows without
    shingles; no column of docs can clash."""
    rows, row = base.numbered(docs)
    stays = base.settled(docs.sparkSession, lambda: near_rows(base.row_texts(rows, row), forest or Forest()).filter("stays").select(F.col("row").alias(row)), "stays")
    return rows.join(stays, row, "left_semi").select(docs.columns)


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(base.table(spark, sf_dir, "documents"), Forest(words=4))
