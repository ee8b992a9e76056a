r"""N-gram Jaccard join over a token-group matrix.

Documents are sets of hashed ``WORDS``-word shingles; two link when their
sets' Jaccard similarity is at least ``NUM / DEN``. The result is exact up to
64-bit hash collisions; it loses no link that joins two components.

1. Sets. One pass over the texts gives each document's set size, a 128-bit
   key of its set and three min-hashes, and adds all its tokens to a
   fixed-size count sketch. Documents of equal sets are one set from here on.
2. Groups. Sets that share a min-hash are compared with the first of their
   bucket and, where that fails, with up to ``LEADERS`` others that failed
   before them; verified links make groups of similar sets, which are
   components already. A group is stored in cells of about ``CELL`` sets.
   Buckets are dealt by size, so a bucket with a third of all sets is many
   small tasks.
3. Token-group matrix. All tokens have one order: rarer by the sketch first,
   then by hash. With need = max(1, n // NEED), the first tokens of a set of
   n are n - ceil(n * NUM / DEN) + need, and its index tokens the first
   n - ceil(n * 2 * NUM / (NUM + DEN)) + need of those. The smaller of two
   sets that link has at least the smaller need of its index tokens among
   the other's first tokens. The matrix holds, for each token, the cells
   whose union of first tokens has it, and whether as an index token.
4. Bounds. Cells of different groups are counted over their common tokens
   that are an index token of either. A pair of cells qualifies if the count
   reaches the smaller need and the sizes of their sets allow a link. A
   token that more than ``HOT`` cells have is not paired up; each set
   counts such tokens instead, and the need of a pair of cells falls by the
   smaller of their largest counts. Sets whose own count alone could meet a need
   (a known, usually small part) go through steps 3 and 4 once more among
   themselves, with all their tokens ordered by exact frequency there. Their
   rows carry all first tokens, so that the smallest common index token
   alone yields a pair, counted in full and held against its need and its
   sizes at once.
5. Opening. Only for qualifying pairs are whole sets read: each set of one
   cell is bounded by its overlap with the other cell's token union, and
   compared with that cell's sets if the bound allows. One link ties two
   groups, so the pair is left at the first.

The sketch only orders tokens: a poor estimate costs time, not results.

Members of a bucket are dealt out, and a task holds at most ``LEADERS`` sets
of its deal and about ``GATHER`` rows of the matrix, however common a token
is. In the second pass it holds two blocks of about ``RUN`` sets, or those
of a part, whose number follows from the sets' lengths.

Edge cases: null and empty texts, and those of white space alone, have an
empty set, link with nothing and are their own component; rows that repeat
a doc_id are one document; a null doc_id has a null component; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept_by, let, small, tidy
from .components import components

WORDS = 5
NUM, DEN = 75, 100
CELL = 64
NEED = 20
#: Cells of the count sketch (a power of two), and of each row that it travels in.
SKETCH_BITS, BLOCK_BITS = 21, 15
#: Tokens that are added to the sketch at once.
COUNTED = 500_000
#: Members of a min-hash bucket that one task compares with the bucket's smallest set.
DEAL = 256
LEADERS = 64
#: Cells of a token up to which they are paired up at once.
HOT = 8
#: Sets that are compared with each other at once.
BLOCK = 512
#: Sets of a token in the second pass up to which they meet in one task, and the bytes of a part of the tokens there.
RUN, PART_BYTES = 1024, 64 << 20
#: Rows of the matrix that a task holds and looks at together.
GATHER = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SALTS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The set's tokens, sorted."""
    own = text.encode().lower().split() if text else []  # bytes split at ASCII white space alone
    n = len(own)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, n)  # quicker than a dictionary of them
    width = min(k, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += h[j:n - width + 1 + j]
        total *= _STEP
        total ^= total >> np.uint64(32)
    return distinct(total)


def distinct(tokens: np.ndarray) -> np.ndarray:
    """The values in order; quicker than np.unique."""
    tokens = np.sort(tokens)
    new = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
    return tokens[new]


def least_overlap(n: int) -> int:
    """Tokens of a set of n that any set linked to it must share."""
    return -(-n * NUM // DEN)


def least_overlap_of_smaller(n: int) -> int:
    """Tokens of a set of n that a linked set of n or more must share."""
    return -(-n * 2 * NUM // (NUM + DEN))


def needed(n: int) -> int:
    return max(1, n // NEED)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if NUM * max(len(a), len(b)) > DEN * min(len(a), len(b)) or not len(a):
        return False
    both = common(a, b)
    return DEN * both >= NUM * (len(a) + len(b) - both)


def common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _cells(tokens: np.ndarray) -> np.ndarray:
    return ((tokens * _MIX) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


_FIRST = "doc_id bigint, n int, key binary, mins array<bigint>, block int, counts binary"
_FIRST_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary())


def _rows(columns, kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _count(sketch: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        sketch += np.bincount(_cells(np.concatenate(sets)), minlength=len(sketch)).astype(np.uint32)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end the task's part of the sketch in blocks."""
    kept_by("jaccard")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    waiting, n_waiting = [], 0
    names = [c.split()[0] for c in _FIRST.split(", ")]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = shingles(text)
            key, mins = None, None
            if len(tokens):
                waiting.append(tokens)
                n_waiting += len(tokens)
                if n_waiting >= COUNTED:
                    _count(sketch, waiting)
                    waiting, n_waiting = [], 0
                key = xxhash.xxh3_128_digest(tokens.tobytes())
                mins = [int(((tokens ^ salt) * salt).min().astype(np.int64)) for salt in _SALTS]
            for column, value in zip(out, (doc, len(tokens), key, mins), strict=True):
                column.append(value)
        none = [None] * batch.num_rows
        yield _rows([*out, none, none], _FIRST_KINDS, names)
    _count(sketch, waiting)
    for block, counts in enumerate(sketch.reshape(-1, 1 << BLOCK_BITS)):
        if counts.any():
            yield _rows([[None], [None], [None], [None], [block], [zlib.compress(counts.astype("<u4").tobytes(), 1)]], _FIRST_KINDS, names)
    tidy()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the sketch's parts by block and keep the order of magnitude (powers of two) of each count."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(counts.as_py()), "<u4")
            total[block] = total[block] + part if block in total else part.astype(np.uint64)
    yield _rows(
        [list(total), [np.floor(np.log2(x + 1)).astype(np.uint8).tobytes() for x in total.values()]], (pa.int32(), pa.binary()), ["block", "ranks"])


def _ranks(first: DataFrame) -> np.ndarray:
    parts = first.filter(F.col("block").isNotNull()).select("block", "counts").repartition(F.col("block"))
    rows = parts.mapInArrow(_summed, "block int, ranks binary").collect()  # the sketch's fixed size
    ranks = np.zeros(1 << SKETCH_BITS, np.uint8)
    for block, part in rows:
        ranks[block << BLOCK_BITS:(block + 1) << BLOCK_BITS] = np.frombuffer(part, np.uint8)
    return ranks


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the first column, text, by the set's tokens."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            tokens = [shingles(t).tobytes() for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), *part.columns[1:]], ["tokens", *part.schema.names[1:]])
    tidy()


def _against_leaders(most: int):
    """Rows sorted by leader and deal, the leader's own first: links of members with it or with members that it didn't link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        now = None
        for batch in batches:
            a, b = [], []
            for of, deal, doc, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = np.frombuffer(tokens, np.uint64)
                if now != (of, deal):
                    held, now = [], (of, deal)
                found = next((x for x, other in held if linked(other, own)), None)
                if found is None:
                    if len(held) < most:
                        held.append((doc, own))
                elif found != doc:
                    a.append(found)
                    b.append(doc)
            yield _rows([a, b], (pa.int64(), pa.int64()), ["a", "b"])

    return run


def _stars(sets: DataFrame) -> DataFrame:
    """(rep, leader, deal): sets to compare with the smallest set of a min-hash bucket; the leader itself is in every deal."""
    hashes = sets.select("rep", F.posexplode("mins").alias("i", "m"))
    buckets = hashes.groupBy("i", "m").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    leaders = buckets.groupBy("leader").agg(F.ceil(F.max("size") / DEAL).cast("bigint").alias("deals"))
    members = hashes.join(buckets.join(leaders, "leader"), ["i", "m"]).filter("rep <> leader").groupBy("rep", "leader").agg(F.first("deals").alias("deals"))
    dealt = members.select("rep", "leader", F.pmod(F.xxhash64("rep"), F.col("deals")).alias("deal"))
    own = leaders.select(F.col("leader").alias("rep"), "leader", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)).alias("deal"))
    return dealt.unionByName(own)


def _first_tokens(shared):
    """Rows (text, doc's key, cell, grp, rep) to a row for each first token of the text's set; info is 1 for an index token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                held: list[tuple] = []
                for text, key, cell, group, rep in zip(*(c[at:at + 500].to_pylist() for c in batch.columns), strict=True):
                    tokens = shingles(text)
                    if xxhash.xxh3_128_digest(tokens.tobytes()) != key:
                        continue  # another text under the same doc_id
                    n = len(tokens)
                    own = tokens[np.argsort(ranks[_cells(tokens)], kind="stable")[:n - least_overlap(n) + needed(n)]]
                    index = np.arange(len(own)) < n - least_overlap_of_smaller(n) + needed(n)
                    held.append((own.view(np.int64), np.full(len(own), cell), np.full(len(own), group), index.astype(np.int64), np.full(len(own), rep)))
                if held:
                    yield _rows([np.concatenate(c) for c in zip(*held, strict=True)], (pa.int64(),) * 5, ["token", "cell", "grp", "info", "rep"])
        tidy()

    return run


def _pairs_of(groups: np.ndarray, index: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different groups within each run, an index token of either; by runs of equal size."""
    for size in np.unique(sizes).tolist():
        if size < 2:
            continue
        at = starts[sizes == size]
        for i in range(size - 1):
            rest = np.arange(i + 1, size)
            step = max(1, 500_000 // len(rest))
            for lo in range(0, len(at), step):
                left = np.repeat(at[lo:lo + step] + i, len(rest))
                right = (at[lo:lo + step, None] + rest).ravel()
                apart = (groups[left] != groups[right]) & (index[left] | index[right])
                if apart.any():
                    yield left[apart], right[apart]


class _Long:
    """A long run of one token: its sets are let go as soon as the token is known to matter, that is to be in two groups and an index token."""

    def __init__(self, token: int):
        self.token, self.low, self.high, self.index = token, None, None, False
        self.sets: list[np.ndarray] = []

    def add(self, rows: np.ndarray) -> np.ndarray:
        """Take in rows of the token; returns the sets to let go."""
        if not rows.shape[1]:
            return rows[4]
        low, high = int(rows[2].min()), int(rows[2].max())
        self.low, self.high = (low, high) if self.low is None else (min(low, self.low), max(high, self.high))
        self.index = self.index or bool(rows[3].any())
        self.sets.append(rows[4])
        if self.low == self.high or not self.index:
            return rows[4, :0]
        out, self.sets = np.concatenate(self.sets), []
        return out


def _common_tokens(limit: int, gather: int):
    """Rows sorted by token, then cell: pairs of cells with how many tokens of this batch they share.

    A token of more than ``limit`` cells yields its sets alone, with a null
    partner. A task holds about ``gather`` rows, and of a longer run no more
    than eight bytes a set, while all sets so far are of one group.
    """
    kinds, names = (pa.int64(),) * 3, ["ca", "cb", "n"]

    def tallied(held, cell: np.ndarray) -> pa.RecordBatch:
        a, b = (cell[np.concatenate(x)] for x in zip(*held, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return _rows([a[first], b[first], np.diff(np.append(first, len(a)))], kinds, names)

    def counted(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        new = np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))
        token, cell, group, info = rows[:4, new]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        runs = np.diff(np.append(starts, len(token)))
        if (runs > limit).any():
            mixed = np.maximum.reduceat(group, starts) != np.minimum.reduceat(group, starts)
            useful = mixed & np.maximum.reduceat(info, starts).astype(bool)
            many = token[starts[(runs > limit) & useful]]
            place = np.minimum(np.searchsorted(many, rows[0]), max(len(many) - 1, 0))
            hot, n = np.unique(rows[4, many[place] == rows[0]] if len(many) else rows[4, :0], return_counts=True)
            yield _rows([hot, [None] * len(hot), n], kinds, names)
            starts, runs = starts[runs <= limit], runs[runs <= limit]
        held, n = [], 0
        for pair in _pairs_of(group, info.astype(bool), starts, runs):
            held.append(pair)
            n += len(pair[0])
            if n > 1_000_000:
                yield tallied(held, cell)
                held, n = [], 0
        if held:
            yield tallied(held, cell)

    def alone(sets: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(sets):
            hot, n = np.unique(sets, return_counts=True)
            yield _rows([hot, [None] * len(hot), n], kinds, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.empty((5, 0), np.int64)], 0
        long: _Long | None = None
        for batch in batches:
            rows = np.array([batch.column(i).to_numpy() for i in range(5)])
            if long:
                own = int(np.searchsorted(rows[0], long.token, "right"))
                yield from alone(long.add(rows[:, :own]))
                rows = rows[:, own:]
                if not rows.shape[1]:
                    continue
                long = None
            held.append(rows)
            n += rows.shape[1]
            if n > gather:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last token's run may go on
                yield from counted(rows[:, :cut])
                rows = rows[:, cut:]
                if 2 * rows.shape[1] > gather:
                    if len(np.unique(rows[1])) > limit:
                        long = _Long(int(rows[0, 0]))
                        yield from alone(long.add(rows))
                        rows = rows[:, :0]
                    else:  # rows that repeat a document
                        rows = rows[:, np.sort(np.unique(rows[[1, 4]], axis=1, return_index=True)[1])]
                held, n = [rows], rows.shape[1]
        yield from counted(np.concatenate(held, axis=1))
        held = []
        tidy()

    return run


def _counted_pairs(postings: DataFrame, limit: int) -> DataFrame:
    """(ca, cb, n): pairs of cells and their common tokens; with a null cb, a set's tokens beyond the limit."""
    dealt = postings.repartition(F.col("token")).sortWithinPartitions("token", "cell", F.col("info").desc())
    return dealt.mapInArrow(_common_tokens(limit, GATHER), "ca bigint, cb bigint, n bigint").groupBy("ca", "cb").agg(F.sum("n").alias("n"))


def _qualified(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """The pairs whose count reaches the need that is left after unpaired tokens, and whose sizes allow a link."""
    sa, sb = (stats.select(*[F.col(c).alias(f"{c}_{x}") for c in stats.columns]) for x in "ab")
    both = pairs.join(sa, F.col("ca") == F.col("cell_a")).join(sb, F.col("cb") == F.col("cell_b"))
    need = F.greatest(F.least("need_a", "need_b") - F.least("hot_a", "hot_b"), F.lit(1))
    return both.filter(
        (F.col("n") >= need) & (F.col("high_a") * DEN >= F.col("low_b") * NUM) & (F.col("high_b") * DEN >= F.col("low_a") * NUM)
    ).select("ca", "cb", "grp_a", "grp_b")


def _by_frequency(sets: DataFrame) -> DataFrame:
    """(rep, cell, grp, n, tokens, n_index, n_run, often) of ``sets`` (rep, cell, grp, n, tokens): first tokens in the exact order by frequency among them.

    Tokens of a single set are left out again once the others have their
    places; n_index counts what is left of the index tokens, n_run the tokens
    of at most RUN sets, which come first; often are the counts.
    """
    rows = sets.select("tokens", "cell", "grp", "rep", "n").mapInArrow(_all_tokens, "token bigint, cell bigint, grp bigint, rep bigint, n bigint")
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    ordered = rows.join(often, "token").groupBy("rep", "cell", "grp", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("all"))
    n, need = F.col("n"), F.greatest(F.lit(1), F.floor(F.col("n") / NEED))
    first = (n - F.ceil(n * NUM / DEN) + need).cast("int")
    index = (n - F.ceil(n * 2 * NUM / (NUM + DEN)) + need).cast("int")
    shared = lambda length: F.filter(F.slice("all", F.lit(1), length), lambda x: x["often"] > 1)
    return ordered.select("rep", "cell", "grp", "n", shared(first).alias("firsts"), F.size(shared(index)).alias("n_index")).select(
        "rep", "cell", "grp", "n", F.transform("firsts", lambda x: x["token"]).alias("tokens"), "n_index",
        F.size(F.filter("firsts", lambda x: x["often"] <= RUN)).alias("n_run"), F.transform("firsts", lambda x: x["often"]).alias("often"))


def _near(ordered: DataFrame) -> DataFrame:
    """Pairs of cells of the second pass that qualify; ``ordered`` is a stored table of ``_by_frequency``."""
    size = ordered.agg(F.sum(F.pow(F.size("tokens").cast("double"), 2)) * 8).first()[0] or 0
    parts = 1 << min(20, max(6, int(size // PART_BYTES).bit_length()))
    light = F.transform(
        F.array_distinct(F.transform(F.slice("tokens", F.lit(1), F.col("n_run")), lambda t: t.bitwiseAND(F.lit(parts - 1).cast("bigint")))),
        lambda p: F.struct(p.alias("part"), F.lit(None).cast("bigint").alias("token"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("mine")))
    frequent = F.arrays_zip(F.col("tokens").alias("t"), F.col("often").alias("k"))

    def dealt(x: Column) -> Column:
        blocks = F.ceil(x["k"] / RUN)
        return let(F.pmod(F.xxhash64("rep", x["t"]), blocks).cast("bigint"), lambda mine: F.transform(F.sequence(F.lit(0).cast("bigint"), (blocks - 1).cast("bigint")), lambda o: F.struct(
            F.xxhash64(x["t"], F.least(mine, o), F.greatest(mine, o)).alias("part"), x["t"].alias("token"), F.least(mine, o).alias("a"), F.greatest(mine, o).alias("b"), mine.alias("mine"))))

    heavy = F.flatten(F.transform(F.filter(frequent, lambda x: x["k"] > RUN), dealt))
    keyed = ordered.withColumn("key", F.explode(F.concat(light, heavy))).select("key.*", "cell", "grp", "n", "tokens", "n_index", "n_run")
    near = keyed.repartition(F.col("part")).sortWithinPartitions("part", "token", "a", "b", "mine", "cell")
    return near.mapInArrow(_near_pairs(BLOCK, parts), "ca bigint, cb bigint, grp_a bigint, grp_b bigint")


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [np.frombuffer(x, np.int64) for x in part.column(0).to_pylist()]
            sizes = [len(x) for x in sets]
            columns = [np.concatenate(sets) if sets else np.empty(0, np.int64)] + [np.repeat(part.column(i).to_numpy(), sizes) for i in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "cell", "grp", "rep", "n"])


class _Run:
    """Sets that have one token among their first tokens, as columns, compared a block of sets at a time."""

    def __init__(self, token: int, rows: list[tuple]):
        self.token = token
        self.cell, self.group, self.n = (np.array([r[i] for r in rows]) for i in range(3))
        self.firsts = [np.asarray(r[3], np.int64) for r in rows]
        self.n_index = [r[4] for r in rows]

    def _matrix(self, places: range, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, index = (np.zeros((len(places), len(tokens)), np.float32) for _ in range(2))
        for row, i in enumerate(places):
            at = np.searchsorted(tokens, self.firsts[i])
            at[at == len(tokens)] = 0
            ok = tokens[at] == self.firsts[i]
            first[row, at[ok]] = 1
            index[row, at[:self.n_index[i]][ok[:self.n_index[i]]]] = 1
        return first, index

    def pairs(self, block: int, split: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs whose smallest common index token this is, and whose common ones reach the need; with ``split``, of one before and one after it."""
        k = len(self.cell)
        need = np.maximum(1, self.n // NEED)
        rest = -(-self.n * NUM // DEN) - need
        for a in range(0, k if split is None else split, block):
            for b in range(a if split is None else split, k, block):
                left, right = range(a, min(a + block, k if split is None else split)), range(b, min(b + block, k))
                if split is None and a == b and len(left) == 1:
                    continue  # one set has no partner here
                tokens, often = np.unique(np.concatenate([self.firsts[i] for i in {*left, *right}]), return_counts=True)
                tokens = tokens[often > 1]
                (fa, ia), (fb, ib) = self._matrix(left, tokens), self._matrix(right, tokens)

                def common_of(cut: slice) -> np.ndarray:
                    return fa[:, cut] @ ib[:, cut].T + ia[:, cut] @ fb[:, cut].T - ia[:, cut] @ ib[:, cut].T

                here = int(np.searchsorted(tokens, self.token))
                na, nb = self.n[a:left.stop, None], self.n[None, b:right.stop]
                ok = (self.group[a:left.stop, None] != self.group[None, b:right.stop]) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb))
                ok &= (common_of(slice(here, here + 1)) > 0) & (common_of(slice(0, here)) == 0)
                ok &= common_of(slice(None)) >= np.minimum(need[a:left.stop, None], need[None, b:right.stop])
                # All common first tokens, and as many as lie beyond the first ones of either set, must make up the least overlap.
                beyond = np.maximum(rest[a:left.stop, None], rest[None, b:right.stop])
                ok &= fa @ fb.T + beyond >= -(-NUM * (na + nb) // (NUM + DEN))
                if split is None and a == b:
                    ok = np.triu(ok, 1)
                i, j = np.nonzero(ok)
                yield i + a, j + b


def _runs_of(part: int, parts: int, sets: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """(token, its sets) for the part's tokens that sets of two groups have, and one as an index token."""
    own = [np.flatnonzero((s[3][:s[5]] & (parts - 1)) == part) for s in sets]
    tokens = np.concatenate([s[3][at] for s, at in zip(sets, own, strict=True)])
    owner = np.repeat(np.arange(len(sets)), [len(at) for at in own])
    index = np.concatenate([at < s[4] for s, at in zip(sets, own, strict=True)])
    order = np.argsort(tokens, kind="stable")
    tokens, owner, index = tokens[order], owner[order], index[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
    group = np.array([s[1] for s in sets])[owner]
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(tokens)], strict=True):
        if hi - lo > 1 and index[lo:hi].any() and group[lo:hi].min() != group[lo:hi].max():
            yield int(tokens[lo]), [sets[i] for i in owner[lo:hi].tolist()]


def _near_pairs(block: int, parts: int):
    """Rows (part, token, a, b, mine, cell, grp, n, tokens, n_index, n_run) in order of their key: pairs of cells that qualify.

    A null token stands for all tokens of the part; otherwise the rows are
    the sets of two blocks (or one) of that token.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def found(sets: _Run, split: int | None = None) -> Iterator[pa.RecordBatch]:
            for i, j in sets.pairs(block, split):
                if len(i):
                    pairs = np.unique(np.stack([sets.cell[i], sets.cell[j], sets.group[i], sets.group[j]]), axis=1)
                    yield _rows(list(pairs), (pa.int64(),) * 4, ["ca", "cb", "grp_a", "grp_b"])

        def done() -> Iterator[pa.RecordBatch]:
            if len({r[1] for r in held}) < 2:
                return
            part, token, a, b = key
            if token is not None:
                yield from found(_Run(token, held), None if a == b else sum(r[6] == a for r in held))
                return
            for each, sets in _runs_of(part, parts, held):
                yield from found(_Run(each, sets))

        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True))
            mine, cell, group, n = (c.to_pylist() for c in batch.columns[4:8])
            ends, values = batch.column(8).offsets.to_numpy(), batch.column(8).values.to_numpy()
            n_index, n_run = (c.to_pylist() for c in batch.columns[9:11])
            for i, now in enumerate(keys):
                if now != key:
                    if key is not None:
                        yield from done()
                    held, key = [], now
                held.append((cell[i], group[i], n[i], values[ends[i]:ends[i + 1]].copy(), n_index[i], n_run[i], mine[i]))
        if key is not None:
            yield from done()
        held = []
        tidy()

    return run


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of cells with their sets: the groups that a link ties."""
    for batch in batches:
        a, b = [], []
        for ga, gb, sa, sb in zip(*(batch.column(i) for i in range(4)), strict=True):
            left = [np.frombuffer(x.as_py(), np.uint64) for x in sa]
            right = [np.frombuffer(x.as_py(), np.uint64) for x in sb]
            union = distinct(np.concatenate(right)) if len(right) > 1 else right[0]
            if any(common(x, union) >= least_overlap(len(x)) and any(linked(x, y) for y in right) for x in left):
                a.append(ga.as_py())
                b.append(gb.as_py())
        yield _rows([a, b], (pa.int64(), pa.int64()), ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. Needs doc_id and text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    pair = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    first = scratch.write(pair.mapInArrow(_sets, _FIRST), "first")
    ids = first.filter(F.col("block").isNull()).select("doc_id", "n", "key", "mins")
    by_key = ids.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    sets = scratch.write(by_key, "sets")

    # Groups of similar sets, by verified links with the leaders of buckets.
    stars = scratch.write(_stars(sets), "stars")
    n_stars = stars.count()
    chosen = pair.join(small(stars, n_stars), pair["doc_id"] == stars["rep"]).select("text", "leader", "deal", "rep")
    spread = chosen.mapInArrow(_to_sets, "tokens binary, leader bigint, deal bigint, rep bigint").select("leader", "deal", "rep", "tokens")
    sorted_ = spread.repartition(F.col("leader"), F.col("deal")).withColumn("other", F.col("rep") != F.col("leader")).sortWithinPartitions("leader", "deal", "other", "rep")
    star_links = scratch.write(sorted_.drop("other").mapInArrow(_against_leaders(LEADERS), "a bigint, b bigint"), "star-links")
    groups = components(star_links, scratch, "groups")
    grouped = sets.join(groups, sets["rep"] == groups["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("grp"))
    sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    cell = F.when(F.col("size") == 1, F.col("rep")).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / CELL)).cast("bigint")))
    members = scratch.write(grouped.join(sizes, "grp").select("key", "rep", "n", "grp", cell.alias("cell")), "members")
    n_members = members.count()

    # The token-group matrix over first tokens, and the bounds that it gives.
    ranks = spark.sparkContext.broadcast(_ranks(first).tobytes())
    placed = pair.join(small(members.select("key", "rep", "cell", "grp"), n_members), pair["doc_id"] == members["rep"]).select("text", "key", "cell", "grp", "rep")
    postings = placed.mapInArrow(_first_tokens(ranks), "token bigint, cell bigint, grp bigint, info bigint, rep bigint")
    counts = scratch.write(_counted_pairs(postings, HOT), "counts")
    hot = counts.filter(F.col("cb").isNull()).select(F.col("ca").alias("of"), F.col("n").alias("hot"))
    judged = scratch.write(members.join(hot, F.col("rep") == F.col("of"), "left").select("key", "rep", "cell", "grp", F.col("n").cast("bigint").alias("n"), F.coalesce("hot", F.lit(0)).alias("hot")), "judged")
    need = F.min(F.greatest(F.lit(1), F.floor(F.col("n") / NEED)))
    stats = judged.groupBy("cell").agg(F.first("grp").alias("grp"), need.alias("need"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("hot").alias("hot"))
    found = _qualified(counts.filter(F.col("cb").isNotNull()), stats)
    # A linked set may be a quarter smaller, and so may its need.
    rest = judged.filter(F.col("hot") >= F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * NUM / DEN) / NEED))).select("key", "rep", "cell", "grp", "n")
    n_rest = rest.count()
    if n_rest:
        texts = pair.join(small(rest, n_rest), pair["doc_id"] == rest["rep"]).select("text", "key", "rep", "cell", "grp", "n")
        whole_sets = texts.mapInArrow(_to_sets, "tokens binary, key binary, rep bigint, cell bigint, grp bigint, n bigint").dropDuplicates(["rep"])
        ordered = scratch.write(_by_frequency(scratch.write(whole_sets, "rest-sets")), "rest-ordered")
        found = found.unionByName(_near(ordered)).distinct()
    qualified = scratch.write(found, "qualified")

    # Whole sets of qualifying cells only.
    wanted = scratch.write(
        members.join(qualified.select(F.explode(F.array("ca", "cb")).alias("cell")).distinct(), "cell").select("key", "rep", "cell"), "wanted")
    n_wanted = wanted.count()
    texts = pair.join(small(wanted, n_wanted), pair["doc_id"] == wanted["rep"]).select("text", "cell", "key")
    keyed = texts.mapInArrow(_to_sets, "tokens binary, cell bigint, key binary").groupBy("cell").agg(F.collect_set("tokens").alias("sets"))
    opened = qualified.join(keyed.select(F.col("cell").alias("ca"), F.col("sets").alias("sets_a")), "ca").join(
        keyed.select(F.col("cell").alias("cb"), F.col("sets").alias("sets_b")), "cb").select("grp_a", "grp_b", "sets_a", "sets_b")
    ties = scratch.write(opened.mapInArrow(_open, "a bigint, b bigint"), "ties")
    whole = components(ties, scratch, "whole")
    scratch.drop_but("first", "members", "whole")

    final = members.join(whole, F.col("grp") == F.col("node"), "left").select(F.col("key").alias("of"), F.coalesce("component", "grp").alias("found"))
    return ids.join(final, F.col("key") == F.col("of"), "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component."""
    found = near_duplicates(docs)
    lost = found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, F.col("doc_id") == F.col("__lost"), "left_anti")
