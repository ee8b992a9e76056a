r"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z in
lower case; only keys of ``MIN_CHARS`` code points or more take part. The
digests of lines arrive in batches, in falling order of doc_id. A batch
becomes a run: one row per key, with the number of documents that hold it
and the one that keeps it. Runs are written in the same number of buckets by
key, each sorted by key, so that neither a merge of a batch with the runs so
far nor a compaction moves a run again: keys that no run holds are new and
name their keeper, the others only add their counts. ``FANOUT`` runs of one
level are compacted into one run of the next. A key held by ``MIN_DOCS``
documents or more loses its lines everywhere but in its keeper, the largest
doc_id. The keys that very many documents hold are few, by their counts, and
are joined by a broadcast, so no task gets all digests of a common line.

Edge cases: null and empty text is one empty line and is kept; rows of a
null doc_id keep all lines and do not count; rows that repeat a doc_id
count once each and keep or lose their lines together; a text of any length
is split whole; no row is dropped, and an empty table gives none; columns
called n_lines or n_dropped are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import BROADCAST_ROWS, Scratch, kept_by, with_fields

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
#: Digests for each bucket of the runs.
PER_BUCKET = 1_000_000

_BLANK = b" \t\n\r\x0b\x0c"


def _keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The 128-bit key hash of each line; None for short lines."""
    found: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(_BLANK).lower()
        n = len(key)
        if n >= min_chars and not key.isascii():
            n = len(key.decode())
        found.append(xxhash.xxh3_128_digest(key) if n >= min_chars else None)
    return found


def _digests(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("linededup")
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is not None and text:
                    own = {k for k in _keys(text, min_chars) if k is not None}
                    ids += [doc] * len(own)
                    keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return run


class LineRuns:
    """Levelled sorted runs (key, n_docs, keeper) in the shared folder, all in the same buckets by key."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT, buckets: int = 8):
        self.scratch, self.fanout, self.buckets = scratch, fanout, buckets
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> None:
        self.made += 1
        name = f"run-{level}-{self.made}"
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, self.scratch.write_buckets(run, name, self.buckets, "key")))

    def runs(self) -> list[DataFrame]:
        return [df for level in self.levels for _, df in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One row per key of all runs, by full joins of equal buckets."""
        out = runs[0]
        for df in runs[1:]:
            other = df.select(F.col("key").alias("k"), F.col("n_docs").alias("n"), F.col("keeper").alias("of"))
            out = out.hint("merge").join(other, F.col("key") == F.col("k"), "full").select(
                F.coalesce("key", "k").alias("key"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("keeper", "of").alias("keeper"))
        return out

    def add(self, digests: DataFrame) -> None:
        """Join one batch's keys with the runs so far and add its own run."""
        counted = digests.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        own = counted.repartition(self.buckets, "key")  # after the counts are combined where the digests are, so a common key is a few rows
        for run in self.runs():
            known = run.select(F.col("key").alias("known"))
            own = own.hint("merge").join(known, F.col("key") == F.col("known"), "left").select(
                "key", "n_docs", F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper"))
        self._write(own, 0)
        for level in range(len(self.levels) + 1):
            if level < len(self.levels) and len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                self._write(self._merged([df for _, df in old]), level + 1)
                self.levels[level] = []
                for name, _ in old:
                    self.scratch.drop(name)

    def frequent(self, min_docs: int) -> DataFrame:
        return self._merged(self.runs()).filter(F.col("n_docs") >= min_docs)


def _lost(digests: DataFrame, frequent: DataFrame, n: int) -> DataFrame:
    """(doc_id, key) of the lines to cut, ``n`` being the number of digests: common keys by a broadcast, the others by a shuffle if they are many."""
    if frequent.count() <= BROADCAST_ROWS:
        return digests.join(F.broadcast(frequent), "key").filter(F.col("doc_id") != F.col("keeper")).select("doc_id", "key")
    most = max(1000, -(-n // BROADCAST_ROWS))
    common = frequent.filter(F.col("n_docs") >= most).select(F.col("key").alias("common"), F.col("keeper").alias("of"))  # n / most rows at most
    marked = digests.join(F.broadcast(common), F.col("key") == F.col("common"), "left")
    at_once = marked.filter(F.col("common").isNotNull() & (F.col("doc_id") != F.col("of"))).select("doc_id", "key")
    rest = marked.filter(F.col("common").isNull()).select("doc_id", "key").join(frequent.filter(F.col("n_docs") < most), "key")
    return at_once.unionByName(rest.filter(F.col("doc_id") != F.col("keeper")).select("doc_id", "key"))


def _cutter(schema_names: list[str], text_at: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, cut in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                n, out = (text or "").count("\n") + 1, text
                gone = 0
                if cut:
                    cut = set(cut)
                    own = (text or "").split("\n")
                    kept = [line for line, key in zip(own, _keys(text, min_chars), strict=True) if key not in cut]
                    gone, out = len(own) - len(kept), "\n".join(kept)
                texts.append(out)
                lines.append(n)
                dropped.append(gone)
            arrays = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema_names)

    return run


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines (before), n_dropped added (or replaced).

    Needs doc_id and text. Texts move only in the last join, by doc_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    pair = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    digests = scratch.write(pair.mapInArrow(_digests(min_chars), "doc_id bigint, key binary"), "digests")
    n, bounds = digests.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", F.array(*[F.lit(i / batches) for i in range(1, batches)]) if batches > 1 else F.array(F.lit(1.0)))).first()
    runs = LineRuns(scratch, fanout, max(8, -(-n // PER_BUCKET)))
    cuts = [None, *sorted(set(bounds or []), reverse=True), None] if batches > 1 else [None, None]
    for top, floor in zip(cuts[:-1], cuts[1:], strict=True):
        upper = F.lit(True) if top is None else F.col("doc_id") <= top
        runs.add(digests.filter(upper & (F.lit(True) if floor is None else F.col("doc_id") > floor)))
    frequent = scratch.write(runs.frequent(min_docs), "frequent")
    lost = _lost(digests, frequent, n).groupBy("doc_id").agg(F.collect_set("key").alias("__cut")).withColumnRenamed("doc_id", "__id")
    scratch.drop_but("digests", "frequent")
    whole = docs.drop("n_lines", "n_dropped", "__cut", "__id")
    marked = whole.join(lost, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    names = [*whole.columns, "n_lines", "n_dropped"]
    return marked.mapInArrow(_cutter(names, whole.columns.index("text"), min_chars), with_fields(whole.schema, n_lines=LongType(), n_dropped=LongType()))


def digest(deduped: DataFrame) -> DataFrame:
    """The contract's columns."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
