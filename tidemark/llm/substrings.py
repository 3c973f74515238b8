"""Operator 5: repeated passages, by De Bruijn compaction over windows of words.

An edge is a window of k consecutive words. Consecutive windows of a row that share their least m-word hash (their
minimizer) are compacted into one path. Paths of all rows are joined by minimizer:

* one path content in the documents that have the minimizer: it doesn't branch, and the whole path repeats
  wherever it isn't in the smallest document;
* several contents: it branches. Equal contents still settle as wholes; one copy of each is taken apart into
  its edges, which are joined by window.

What a join finds is a span (first window, number of windows) of a row with the row and place that it repeats. Hashes
only propose it: the words at the source's coordinates are read and digested, and a span counts where its own words
have that digest. What repeats within the texts that a worker holds together is compared word by word there.

Minimizers that many documents have are found on a sample of rows and taken to branch: that changes no result, and
their paths needn't meet in one task. No size of a text or group is limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b, sha256
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import base

_SECOND = 0xD6E8FEB86659FD93
_STEP = np.uint64(0xA0761D6478BD642F)
_FOUND = "place long, r long, doc long, row long, first long, n long, key long"
#: What becomes of a span: it counts, its words are to be compared, it is to be taken apart, its minimizer is hot.
SETTLED, CLAIMED, APART, HOT = range(4)
#: Bytes of text that a worker looks at together.
_TOGETHER = 4_000_000
#: Rows that hot minimizers are looked for in, and the share (and number) of them from which one is hot.
_SAMPLE, _HOT_SHARE, _HOT_ROWS = 20_000, 1 / 400, 20


@dataclass
class _Rows:
    """Rows of _FOUND in the making: place is the task's key. r null: settled here, to take apart (n < 0), or a minimizer
    that branches here (no doc). key: the minimizer of a hot path, whose place is its own."""

    parts: list = field(default_factory=list)

    def add(self, place, r, doc, row, first, n, key=None) -> None:
        size = len(place)
        cols = [pa.nulls(size, pa.int64()) if c is None else pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (place, r, doc, row, first, n, key)]
        self.parts.append(pa.record_batch(cols, ["place", "r", "doc", "row", "first", "n", "key"]))

    def batches(self) -> Iterator[pa.RecordBatch]:
        yield from (p for p in self.parts if p.num_rows)


def _sorted_groups(*keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order by keys, and for each number of leading keys where its groups begin (as flags)."""
    order = np.lexsort(keys[::-1])
    new, flags = np.zeros(len(order), bool), []
    new[:1] = True
    for key in keys:
        k = key[order]
        new = new.copy()
        new[1:] |= k[1:] != k[:-1]
        flags.append(new)
    return order, flags


class _Chunk:
    """Windows of some rows: their words as exact codes and as hashes."""

    def __init__(self, rows: pa.Array, docs: pa.Array, texts: pa.Array, k: int):
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        codes, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()
        if b"" in words:  # before and behind white space at a text's ends
            full = codes != words.index(b"")
            ends = np.append(0, np.cumsum(full))[ends]
            codes = codes[full]
        sizes = np.diff(ends).astype(np.int64)
        self.k, self.codes, self.words = k, codes, base.word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
        self.ids, self.docs = np.asarray(rows, np.int64), np.asarray(docs, np.int64)
        count = np.maximum(sizes - k + 1, 0)
        #: of each window: its row (as a place in ids), its first word in that row and in this chunk
        self.of = np.repeat(np.arange(len(sizes)), count)
        self.first = np.cumsum(count) - count
        self.pos = np.arange(count.sum()) - np.repeat(self.first, count)
        self.at = self.pos + ends[:-1].astype(np.int64)[self.of]
        self.one = base.windows(self.words, k)[self.at] if len(self.at) else self.words[:0]

    def seconds(self, which: np.ndarray) -> np.ndarray:
        """Another hash of some windows."""
        return base.windows(self.words, self.k, _SECOND)[self.at[which]] if len(which) else self.words[:0]

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n windows from each of a have the words of those from b."""
        size = n + self.k - 1
        begin = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(begin, size)
        same = self.codes[np.repeat(self.at[a], size) + step] == self.codes[np.repeat(self.at[b], size) + step]
        return np.logical_and.reduceat(same, begin) if len(a) else np.empty(0, bool)

    def settled(self, rows: _Rows, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Spans of windows (places in this chunk) that repeat a smaller document here: joined where they touch."""
        if not len(starts):
            return
        order = np.argsort(starts, kind="stable")
        a, b, of = starts[order], (starts + lengths)[order], self.of[starts[order]]
        reach = np.maximum.accumulate(b)
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] > reach[:-1]) | (of[1:] != of[:-1])
        cut = np.flatnonzero(new)
        a, b, of = a[cut], np.append(reach[cut[1:] - 1], reach[-1]), of[cut]
        rows.add(self._apart(self.ids[of], self.pos[a]), None, self.docs[of], self.ids[of], self.pos[a], b - a)

    def edges(self, rows: _Rows, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows for single windows; returns those that repeat a smaller document of this chunk."""
        two = self.seconds(which)
        order, (_, same, _) = _sorted_groups(self.one[which], two, self.docs[self.of[which]])
        which, two = which[order], two[order]
        begin = np.flatnonzero(same)
        source = np.repeat(which[begin], np.diff(np.append(begin, len(which))))
        late = self._late(which, source, np.ones(len(which), np.int64))
        rest = which[~late]
        of = self.of[rest]
        rows.add(self.one[rest], two[~late], self.docs[of], self.ids[of], self.pos[rest], np.ones(len(rest), np.int64))
        return which[late], np.ones(late.sum(), np.int64)

    def _late(self, which: np.ndarray, source: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Those of a larger document than their source's, with the source's words."""
        late = self.docs[self.of[which]] > self.docs[self.of[source]]
        at = np.flatnonzero(late)
        late[at] = self.equal(which[at], source[at], n[at])
        return late

    def runs(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Compacted paths: minimizer, first window (place in this chunk) and number of windows."""
        if not len(self.at):
            return self.words[:0], np.empty(0, np.int64), np.empty(0, np.int64)
        grams, width = base.windows(self.words, m), self.k - m + 1
        bits = np.uint64(max(20, len(self.words).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        x = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        done = 1
        while 2 * done <= width:
            x, done = np.minimum(x[:-done], x[done:]), 2 * done
        if done < width:
            x = np.minimum(x[: len(x) - (width - done)], x[width - done :])
        least = (x[self.at] & low).astype(np.int64)
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (self.of[1:] != self.of[:-1])
        start = np.flatnonzero(new)
        return grams[least[start]], start, np.diff(np.append(start, len(least)))

    def paths(self, rows: _Rows, m: int, hot: np.ndarray) -> None:
        """Rows for compacted paths; those that branch in this chunk are to be taken apart."""
        key, start, length = self.runs(m)
        if not len(key):
            return
        with np.errstate(over="ignore"):
            nth = (np.arange(len(self.at)) - np.repeat(start, length)).astype(np.uint64)
            content = np.add.reduceat(base.mixed(self.one + nth * _STEP), start)
        order, (by_key, by_content, _) = _sorted_groups(key, content, self.docs[self.of[start]])
        key, content, start, length = key[order], content[order], start[order], length[order]
        of = self.of[start]
        doc, row, pos = self.docs[of], self.ids[of], self.pos[start]
        begin = np.flatnonzero(by_content)
        size = np.diff(np.append(begin, len(key)))
        late = self._late(start, np.repeat(start[begin], size), length)
        groups = np.flatnonzero(by_key)
        sizes = np.diff(np.append(groups, len(key)))
        often = np.isin(key[groups], hot, kind="sort") if len(hot) else np.zeros(len(groups), bool)
        branches = ~often & (np.add.reduceat(by_content, groups, dtype=np.int64) > 1) & (np.minimum.reduceat(doc, groups) < np.maximum.reduceat(doc, groups))
        apart, known = np.repeat(branches, sizes), np.repeat(often, sizes)
        plain, spread = ~late & ~apart & ~known, ~late & known
        rows.add(key[plain], content[plain], doc[plain], row[plain], pos[plain], length[plain])
        rows.add(self._apart(row[spread], pos[spread]), content[spread], doc[spread], row[spread], pos[spread], length[spread], key[spread])
        rows.add(key[groups[branches]], None, None, None, None, None)
        split = ~late & apart
        rows.add(self._apart(row[split], pos[split]), None, doc[split], row[split], pos[split], -length[split])
        self.settled(rows, start[late], length[late])

    @staticmethod
    def _apart(row: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """A key for a row that needs no other: evenly spread."""
        with np.errstate(over="ignore"):
            return base.mixed(row.view(np.uint64) * _STEP + pos.astype(np.uint64))


def _hot(whole: DataFrame, k: int, m: int) -> np.ndarray:
    """Minimizers (sorted) that more than _HOT_SHARE of about _SAMPLE rows have. Only where paths meet depends on them."""
    rows = whole.count()
    share = min(1.0, _SAMPLE / max(rows, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in base.sliced(batch, _TOGETHER):
                chunk = _Chunk(part.column("row"), part.column("doc_id"), part.column("text"), k)
                key, start, _ = chunk.runs(m)
                each = np.unique(np.stack([key.view(np.int64), chunk.of[start]]), axis=1)[0] if len(key) else np.empty(0, np.int64)
                yield pa.record_batch([pa.array(each)], ["key"])

    found = whole.sample(share, seed=3).mapInArrow(run, "key long").groupBy("key").count()
    often = found.filter(F.col("count") > max(_HOT_ROWS, _HOT_SHARE * share * rows)).orderBy(F.desc("count"), "key").limit(1 << 16)
    return np.sort(np.array([r.key for r in often.select("key").collect()], np.int64).view(np.uint64))


def _met(rows: DataFrame) -> DataFrame:
    """kind, row, first, n, source_row, source_first of spans that mean something after all paths met; of hot ones
    key, r and doc too."""
    same, all_ = Window.partitionBy("place", "r"), Window.partitionBy("place")
    # Sorted once, by (place, r). A worker sends one row for a content and chunk, and hot keys are spread.
    out = rows.repartition("place").withColumn("least", F.min("doc").over(same))
    out = out.withColumn("source_row", F.min_by("row", "doc").over(same)).withColumn("source_first", F.min_by("first", "doc").over(same))
    out = out.withColumn("branch", (F.min("doc").over(all_) < F.max("doc").over(all_)) & (F.min("r").over(all_) < F.max("r").over(all_)))
    out = out.withColumn("signal", F.max(F.col("doc").isNull()).over(all_)).filter("doc IS NOT NULL")
    kind = F.when(F.col("key").isNotNull(), HOT).when(F.col("r").isNull(), F.when(F.col("n") > 0, SETTLED).otherwise(APART))
    kind = kind.when(F.col("doc") > F.col("least"), CLAIMED).when(F.col("signal") | F.col("branch"), APART)
    out = out.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("n", F.abs("n"))
    only = lambda kind, *names: [F.when(F.col("kind") == kind, F.col(c)).alias(c) for c in names]
    return out.select("kind", "row", "first", "n", *only(CLAIMED, "source_row", "source_first"), *only(HOT, "key", "r", "doc"))


_SPAN = ["row", "first", "n", "source_row", "source_first"]


def _joined(rows: DataFrame) -> DataFrame:
    """Of rows(key, r, doc, row, first, n): spans of _SPAN that repeat a smaller document's with the same (key, r).
    Minima are combined before the shuffle, hot keys looked up apart."""
    least = rows.groupBy("key", "r").agg(F.min(F.struct("doc", "row", "first")).alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("size"))
    least = base.saved(least.filter(F.col("most") > F.col("least.doc")).select("key", "r", "least", "size"), "least")
    base.release(rows.sparkSession)
    met = base.looked_up(rows, least, ["key", "r"], "size", rows.count())
    late = met.filter(F.col("doc") > F.col("least.doc"))
    return late.select("row", "first", "n", F.col("least.row").alias("source_row"), F.col("least.first").alias("source_first"))


def repeated_spans(rows: DataFrame, k: int = 13, m: int = 4) -> DataFrame:
    """row, spans of rows(row, doc_id, text): windows of k words of a row that also start in a row with a smaller doc_id,
    as (n, digest, firsts): the first windows of all spans of n windows whose source's words have that digest (null:
    compared already). Spans may overlap.

    Rows with a null doc_id neither repeat nor are repeated; rows of one doc_id don't repeat each other."""
    spark, whole = rows.sparkSession, rows.filter("doc_id IS NOT NULL")
    hot = spark.sparkContext.broadcast(_hot(whole, k, m))  # 65,536 numbers at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in base.sliced(batch, _TOGETHER):
                found = _Rows()
                _Chunk(part.column("row"), part.column("doc_id"), part.column("text"), k).paths(found, m, hot.value)
                yield from found.batches()

    met = base.saved(_met(whole.mapInArrow(scan, _FOUND)), "met")
    base.release(spark)
    often = met.filter(F.col("kind") == HOT).select("key", "r", "doc", "row", "first", "n")
    # A hot path that repeats one of a smaller document is settled as a whole; any other is taken apart.
    claimed = base.saved(_joined(often), "claimed")
    rest = often.select("row", "first", "n").join(claimed.select("row", "first"), ["row", "first"], "left_anti")
    apart = met.filter(F.col("kind") == APART).select("row", "first", "n").unionByName(rest)
    apart = apart.groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("spans"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in base.sliced(batch, _TOGETHER):
                found, chunk = _Rows(), _Chunk(part.column("row"), part.column("doc_id"), part.column("text"), k)
                spans = part.column("spans")
                flat = spans.flatten()
                of = np.repeat(np.arange(part.num_rows), np.asarray(spans.value_lengths()))
                n = np.asarray(flat.field("n"))
                a = chunk.first[of] + np.asarray(flat.field("first"))
                which = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                chunk.settled(found, *chunk.edges(found, which))
                yield from found.batches()

    single = base.saved(whole.join(apart.hint("merge"), "row").mapInArrow(edges, _FOUND), "edges")
    more = _joined(single.filter("r IS NOT NULL").select(F.col("place").alias("key"), "r", "doc", "row", "first", "n"))
    to_check = met.filter(F.col("kind") == CLAIMED).select(*_SPAN).unionByName(claimed).unionByName(more)
    to_check = base.saved(to_check, "claims")
    sure = met.filter(F.col("kind") == SETTLED).select("row", "first", "n").unionByName(single.filter("r IS NULL").select("row", "first", "n"))
    sure = base.saved(sure, "sure")
    base.forget(met, single, claimed)
    base.release(spark)

    place = ["source_row", "source_first", "n"]
    asked = to_check.groupBy(*place).agg(F.count(F.lit(1)).alias("size"))
    asked = asked.groupBy("source_row").agg(F.collect_list(F.struct("source_first", "n", "size")).alias("spans")).withColumnRenamed("source_row", "row")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in base.sliced(batch, _TOGETHER):
                flat, digests = part.column("spans").flatten(), []
                sizes = np.asarray(part.column("spans").value_lengths())
                of = iter(zip(flat.field("source_first").to_pylist(), flat.field("n").to_pylist(), strict=True))
                for text, size in zip(part.column("text").to_pylist(), sizes.tolist(), strict=True):
                    words = text.encode().split()
                    digests += [_digest(words, first, n, k) for first, n in islice(of, size)]
                rows = part.column("row").take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                yield pa.record_batch([rows, flat.field("source_first"), flat.field("n"), flat.field("size"), pa.array(digests, pa.binary())], [*place, "size", "digest"])

    read_there = whole.join(asked.hint("merge"), "row").mapInArrow(read, "source_row long, source_first long, n long, size long, digest binary")
    checked = base.looked_up(to_check, base.saved(read_there, "sources"), place, "size", to_check.count())
    spans = checked.select("row", "first", "n", "digest").unionByName(sure.withColumn("digest", F.lit(None).cast("binary")))
    # Moved once, by row; a passage that a row repeats over and over costs one number each time.
    alike = spans.repartition("row").groupBy("row", "n", "digest").agg(F.collect_list("first").alias("firsts"))
    return alike.groupBy("row").agg(F.collect_list(F.struct("n", "digest", "firsts")).alias("spans"))


def _digest(words: list[bytes], first: int, n: int, k: int) -> bytes:
    return blake2b(b" ".join(words[first : first + n + k - 1]), digest_size=16).digest()


def _kept(words: list[bytes], spans: list[tuple[int, int, bytes | None]], k: int) -> list[bytes]:
    """Words that no span (first, n, digest) covers; spans whose words aren't those of their source don't count."""
    if not spans:
        return words
    edge = [0] * (len(words) + 1)
    for first, n, digest in spans:
        if digest is None or digest == _digest(words, first, n, k):
            edge[first] += 1
            edge[first + n + k - 1] -= 1
    return [w for w, covered in zip(words, accumulate(edge), strict=False) if not covered]


def _spans_of(column: pa.ListArray) -> Iterator[list[tuple[int, int, bytes | None]]]:
    """Spans of each row, one row after another, as tuples (first, n, digest)."""
    flat = column.flatten()
    alike = zip(flat.field("n").to_pylist(), flat.field("digest").to_pylist(), np.asarray(flat.field("firsts").value_lengths()).tolist(), strict=True)
    firsts = iter(flat.field("firsts").flatten().to_numpy())
    for size in pc.fill_null(column.value_lengths(), 0).to_pylist():
        yield [(first, n, digest) for n, digest, times in islice(alike, size) for first in map(int, islice(firsts, times))]


def _with_spans(docs: DataFrame, k: int, columns: list[str] | None) -> tuple[DataFrame, str]:
    """Rows of docs with a column of the spans to remove (null: none), and the name of that column."""
    rows, row = base.numbered(docs, columns, bucketed=True)
    base.release(docs.sparkSession)
    found = repeated_spans(base.row_texts(rows, row), k)
    names = {c.lower() for c in rows.columns}
    spans = next(n for n in (f"spans{'_' * i}" for i in range(len(names) + 1)) if n not in names)
    return rows.join(found.hint("merge").select(F.col("row").alias(row), F.col("spans").alias(spans)), row, "left"), spans


def _removed(docs: DataFrame, k: int, result: str, make) -> DataFrame:
    whole, spans = _with_spans(docs, k, ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in result.split(", ")]
        for batch in batches:
            for part in base.sliced(batch, _TOGETHER):
                out = []
                for text, found in zip(part.column("text").to_pylist(), _spans_of(part.column(spans)), strict=True):
                    words = text.encode().split()
                    keep = _kept(words, found, k)
                    out.append((len(words), len(words) - len(keep), make(text, words, keep)))
                kinds = [pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), spans).mapInArrow(run, result)


def substring_dedup(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, text: each row of docs(doc_id, text) without the words that a repeated window covers.

    Words are cut at ASCII white space. A window of k words repeats when its words also start in a row with a
    smaller doc_id; windows are judged on the input. Where words go, the others are joined by one blank; other
    texts stay as they are. Null text: empty. Rows with a null doc_id stay as they are and are no source; rows
    that share a doc_id are judged one by one, each against smaller ids alone. Texts under k words have no
    window; long ones have no limit. Other columns are ignored; an empty table gives an empty result.
    """
    return _removed(docs, k, "doc_id long, n_words long, n_removed long, text string", lambda text, words, keep: text if len(words) == len(keep) else b" ".join(keep).decode())


def without_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """docs with all its columns, its texts as substring_dedup() leaves them, and n_chars (if there) to match; no
    column of docs can clash. Rows whose text is null keep it null."""
    whole, spans = _with_spans(docs, k, None)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in base.sliced(batch, _TOGETHER):
                texts = part.column("text").to_pylist()
                for i, found in enumerate(_spans_of(part.column(spans))):
                    if found:
                        words = texts[i].encode().split()
                        keep = _kept(words, found, k)
                        texts[i] = texts[i] if len(keep) == len(words) else b" ".join(keep).decode()
                cols = {n: part.column(n) for n in schema.names} | {"text": pa.array(texts, pa.string())}
                yield pa.record_batch([cols[n] for n in schema.names], schema.names)

    out = whole.select(*docs.columns, spans).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out


def kept_digests(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: substring_dedup(), with a digest of the words that stay, joined by one
    blank, in place of the text."""
    return _removed(docs, k, "doc_id long, n_words long, n_removed long, kept_sha256 string", lambda text, words, keep: sha256(b" ".join(keep)).hexdigest())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digests(base.table(spark, sf_dir, "documents"))
