r"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are runs of digits, letters a-z (A-Z lowered) and non-ASCII
characters. The windows of an item are its 13-word runs, or all its words
where it has fewer. A document's words are hashed; only runs of words that
the benchmark has, as long as a window, are looked up, and a hash that is in
the set is verified against the window's words. Every word inside an
occurrence of a window is hit.

The set is a few arrays: the items' words as one run of bytes, where each
starts, and per window a hash and a place; a worker adds a dictionary of the
different words. It is broadcast in blocks of at most ``BLOCK_BYTES`` of all
this, held against while items stream in, so neither the driver nor a worker
holds more; an item larger than a block is
cut into parts that overlap by a window less a word. A larger benchmark
makes more blocks: each is one more pass over the documents, written to the
shared folder in between, and its broadcast is given up after it.

Edge cases: null and empty texts, and items without words, hold no words
and are never contaminated; items of null item_id are one item whose id is
written as an empty string; very long texts are scanned whole; repeated rows
each get a result, and repeated items are one; an empty benchmark leaves all
documents clean, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType

from .common import Scratch, kept_by, small_batches, unwrapped, with_fields, wrapped

WIDTH = 13
BLOCK_BYTES = 128 << 20
#: Bytes for each word, besides its own: hash, place, and those of the window that starts there; and for each different word, once looked up.
PER_WORD, PER_NEW_WORD = 32, 140
#: A document is contaminated from one hit word in so many.
ONE_IN = 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


def _hashed(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at ``at``."""
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total = (total + words[at + j]) * _STEP
        total ^= total >> np.uint64(29)
    return total


class NgramSet:
    """Windows of a block of items, as arrays: by length, sorted hashes and the places of the words behind them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int = WIDTH):
        items = [(item, words) for item, words in items if words]
        self.items = [item for item, _ in items]
        sizes = np.array([len(words) for _, words in items], np.int64)
        #: Place of each item's first word, and of each word's first byte in ``text``.
        self.first = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        self.text = b" ".join([b" ".join(words) for _, words in items])
        lengths = np.fromiter((len(w) + 1 for _, words in items for w in words), np.int64, int(sizes.sum()))
        self.starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        hashes = np.fromiter((_hash(w) for _, words in items for w in words), np.uint64, int(sizes.sum()))
        self.vocabulary: dict[bytes, int] | None = None
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(sizes, width)).tolist():
            of = np.flatnonzero(np.minimum(sizes, width) == n)
            counts = sizes[of] - n + 1
            ends = np.cumsum(counts)
            at = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(self.first[of], counts)
            keys = _hashed(hashes, at, n)
            order = np.argsort(keys, kind="stable")
            self.windows[n] = keys[order], at[order]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Marks of the hit words, and the items whose windows occur."""
        marks, items = np.zeros(len(words), bool), set()
        if not self.windows or not words:
            return marks, items
        if self.vocabulary is None:  # made where it is used, since it is larger than the words
            self.vocabulary = {w: _hash(w) for w in set(self.text.split(b" "))}
        get = self.vocabulary.get
        hashes = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = np.concatenate(([0], np.cumsum(hashes > 0)))
        for n, (keys, at) in self.windows.items():
            here = np.flatnonzero(known[n:] - known[:-n] == n) if len(words) >= n else ()
            if not len(here):
                continue
            sought = _hashed(hashes, here, n)
            low = np.searchsorted(keys, sought)
            found = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == sought)
            high = np.searchsorted(keys, sought[found], "right")
            for i, lo, hi in zip(here[found].tolist(), low[found].tolist(), high.tolist(), strict=True):
                run = b" ".join(words[i:i + n])
                for p in at[lo:hi].tolist():
                    if self.text[self.starts[p]:self.starts[p + n] - 1] == run:
                        marks[i:i + n] = True
                        items.add(self.items[int(np.searchsorted(self.first, p, "right")) - 1])
        return marks, items


def _parts(words: list[bytes], width: int, block_bytes: int) -> Iterator[list[bytes]]:
    """An item's words, cut into parts that overlap by a window less a word where they would fill a block."""
    at = 0
    while True:
        size, end = 0, at
        while end < len(words) and (size < block_bytes or end - at < width):
            size += len(words[end]) + PER_WORD
            end += 1
        yield words[at:end]
        if end >= len(words):
            return
        at = end - width + 1


def blocks_of(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items and their words in blocks of bounded size; one block is on the driver at a time, as are the rows of one partition."""
    block: list[tuple[str, list[bytes]]] = []
    seen: set[bytes] = set()
    size = 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        for part in _parts(words_of(text), width, block_bytes):
            if part:
                block.append((item, part))
                new = len(seen)
                seen.update(part)
                size += sum(map(len, part)) + PER_WORD * len(part) + PER_NEW_WORD * (len(seen) - new)
            if size >= block_bytes:
                yield block
                block, seen, size = [], set(), 0
    if block:
        yield block


_ADDED = ("n_words", "n_hit", "hit_marks", "items")


def _scanner(shared, text_at: int, own: int, first: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("decontam")
        ngrams = shared.value
        for batch in batches:
            total, hit, marks, items = [], [], [], []
            old_marks = [None] * batch.num_rows if first else batch.column(own + 2).to_pylist()
            old_items = [None] * batch.num_rows if first else batch.column(own + 3).to_pylist()
            for text, m0, i0 in zip(batch.column(text_at).to_pylist(), old_marks, old_items, strict=True):
                words = words_of(text)
                m, found = ngrams.hits(words)
                if m0:
                    m |= np.unpackbits(np.frombuffer(m0, np.uint8), count=len(words)).astype(bool)
                total.append(len(words))
                hit.append(int(m.sum()))
                marks.append(np.packbits(m).tobytes() if hit[-1] else None)
                items.append(sorted(found | set(i0 or ())))
            added = [pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(own)] + added, names)

    return run


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, hit_marks (packed bits, null if none) and items to every row; no shuffle. Columns so named are replaced."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    out = docs.drop(*_ADDED)
    own = out.columns
    schema = with_fields(out.schema, n_words=LongType(), n_hit=LongType(), hit_marks=BinaryType(), items=ArrayType(StringType()))
    scratch = before = None
    for n, block in enumerate(blocks_of(benchmark, width, block_bytes)):
        if before is not None:
            scratch = scratch or Scratch(spark, "decontam")
            out = scratch.write(out, f"pass-{n}")
            before.destroy()
            if n > 1:
                scratch.drop(f"pass-{n - 1}")
        before = spark.sparkContext.broadcast(NgramSet(block, width))
        out = out.mapInArrow(_scanner(before, own.index("text"), len(own), n == 0, [*own, *_ADDED]), schema)
    if before is None:
        before = spark.sparkContext.broadcast(NgramSet([], width))
        out = out.mapInArrow(_scanner(before, own.index("text"), len(own), True, [*own, *_ADDED]), schema)
    return out


def judged(scanned: DataFrame) -> DataFrame:
    """Add contaminated."""
    return scanned.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))


def remove_spans(text: str | None, marks: bytes | None) -> str | None:
    """The text without its hit words and what lies between neighbouring ones."""
    if not text or not marks:
        return text
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    hit = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(places))
    out, at, i = [], 0, 0
    while i < len(places):
        if hit[i]:
            j = i
            while j + 1 < len(places) and hit[j + 1]:
                j += 1
            out.append(raw[at:places[i][0]])
            at, i = places[j][1], j
        i += 1
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH) -> DataFrame:
    """``docs`` without contaminated documents, or, with remove="spans", with the hit spans cut from all texts."""
    scanned = scan(wrapped(docs, "text"), benchmark, width)
    if remove == "documents":
        return unwrapped(judged(scanned).filter(~F.col("contaminated")), docs.columns)
    if remove != "spans":
        raise ValueError("remove must be documents or spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [remove_spans(t, m) for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.string())], ["__row", "text"])

    slim = scanned.select("__row", "text", "hit_marks")
    return unwrapped(slim.mapInArrow(run, slim.drop("hit_marks").schema), docs.columns, text=F.col("text"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged(scanned).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
