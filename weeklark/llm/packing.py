r"""Best-fit packing by a grouping genetic algorithm on islands.

A document's ids are those of a public tokenizer, then ``END_ID``. Longer
documents than a sequence are cut into full pieces and a rest. Pieces are
dealt to shards of about ``SHARD`` pieces by a stored random number; a shard
is a packing problem of its own. The worst filled bin of each shard is taken
apart again, and the pieces of all of those are packed anew in the same way,
until one shard is left; so the split wastes no more than one bin.

For each shard some islands each evolve a population of packings: best fit
by falling length, and weaker ones that best-fit a disturbed order. A
packing says for every piece which bin holds it. Crossover injects whole
well-filled bins of one parent into the other, takes the bins out that share
a piece with them, and best-fits the displaced pieces, longest first. A
packing is better with fewer bins, then with a larger sum of squared fills.
After each epoch the best packings of an island migrate to the next one. An
island stops early only if no better packing can exist: as few bins as the
tokens need, all of them full but one.

Edge cases: a null or empty text is one piece that holds END_ID alone; a
null doc_id stays null, and ids are never turned into another type; repeated
rows are packed as pieces of their own; a text of any length is encoded
whole; an empty table gives no rows; other columns, whatever their names,
are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept_by, tidy

CAPACITY = 2048
END_ID = 0
SHARD = 8192
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
OFFSPRING = 4
#: Encoded chunks that a worker keeps of late (twice as many at most, older ones included), and the longest chunk that is kept.
CACHE, CACHE_BYTES = 250_000, 64

#: Signs that may end a chunk and encode apart from the letters before them: all of ASCII but those that contractions or special tokens use.
_SIGNS = b".,;:!?$%&#*()[]{}@~^_+-/\\\"`"


#: Words of a-z and of the lower-case Latin letters with a composed mark.
_LOWER = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The first bytes of all characters from U+0300 on, where combining marks begin.
_MARKS = re.compile(rb"[\xcc-\xff]")


def _byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


_BYTE_SIGNS = _byte_signs()


class _Chunks(dict):
    """Encoded ids, little-endian 32-bit, of white-space separated chunks: those of late, and the generation before."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            core = _letters_of(chunk)
            if core:
                found = self[core] + self[chunk[len(core):]]
            elif _LOWER.fullmatch(chunk):
                # Letters that are lower case and composed already are one word to the tokenizer: its model takes them as they are.
                word = chunk.decode("ascii") if chunk.isascii() else "".join([_BYTE_SIGNS[x] for x in chunk])
                found = np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
            else:
                found = np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= CACHE_BYTES:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found


def _letters_of(chunk: bytes) -> bytes:
    """What comes before the signs at a chunk's end, if a letter ends it: the tokenizer splits there, so both parts encode alone as together."""
    core = chunk.rstrip(_SIGNS)
    return core if core and core != chunk and (core[-1:].isalpha() or _latin_end(core)) else b""


def _latin_end(core: bytes) -> bool:
    """Ends in a Latin letter of two bytes that is a letter alone in lower case, too (a dotted capital I leaves a mark behind)."""
    last = core[-2:]
    return len(last) == 2 and 0xC3 <= last[0] <= 0xC9 and 0x80 <= last[1] <= 0xBF and last not in (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")


def chunks_of(path: str) -> _Chunks:
    """One cache for each tokenizer file and Python worker; it outlives tasks."""
    kept = kept_by("packing")
    found = kept.get(path)
    if found is None:
        from tokenizers import Tokenizer

        found = kept[path] = _Chunks(Tokenizer.from_file(path))
    return found


def encode(text: str | None, chunks: _Chunks) -> bytes:
    """Ids of a whole text and END_ID, as bytes.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its chunks. It composes marks, then lowers letters:
    chunks without marks are lowered at once, so that fewer differ; others
    go to it as they are, since some letters compose in one case only. A
    text that holds the start of a special token's name is encoded whole.
    """
    if not text:
        return b"\0\0\0\0"
    raw = text.encode()
    if b"<|" in raw:
        ids = np.array(chunks.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    elif _MARKS.search(raw):
        ids = b"".join([chunks[c if _MARKS.search(c) else c.lower()] for c in raw.split()])
    else:
        ids = b"".join([chunks[c] for c in raw.lower().split()])
    return ids + b"\0\0\0\0"


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint"


def _tokenized(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_of(path)
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], [], []]
            for n, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids = encode(text, chunks)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    crc = zlib.crc32(part)
                    for column, value in zip(rows, (doc, piece, at // 4, len(part) // 4, crc, zlib.crc32(b"%d %d" % (n, piece), crc)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "deal"])
        tidy()

    return run


class _Residuals:
    """Bins by free space; the tightest that fits is found by one shift of a bit set."""

    def __init__(self):
        self.by_space: dict[int, list[int]] = {}
        self.mask = 0

    def put(self, bin_: int, space: int) -> None:
        if space > 0:
            self.by_space.setdefault(space, []).append(bin_)
            self.mask |= 1 << space

    def take(self, length: int) -> tuple[int, int] | None:
        fits = self.mask >> length
        if not fits:
            return None
        space = length + (fits & -fits).bit_length() - 1
        bins = self.by_space[space]
        bin_ = bins.pop()
        if not bins:
            self.mask ^= 1 << space
        return bin_, space


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, capacity: int, residuals: _Residuals, made: int) -> int:
    """Place the pieces of ``order`` in turn; returns the number of bins made so far."""
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = residuals.take(length)
        bin_, space = found if found else (made, capacity)
        made += found is None
        bins[i] = bin_
        residuals.put(bin_, space - length)
    return made


def _fresh(lengths: np.ndarray, capacity: int, noise: float, rng: np.random.Generator) -> np.ndarray:
    order = np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    bins = np.empty(len(lengths), np.int32)
    best_fit(lengths, order, bins, capacity, _Residuals(), 0)
    return bins


def score(lengths: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """To be minimised."""
    fills = np.bincount(bins, weights=lengths)
    fills = fills[fills > 0]
    return len(fills), -float((fills**2).sum())


def cross(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject whole well-filled bins of ``b`` into ``a`` and best-fit what that displaces."""
    fills = np.bincount(b, weights=lengths)
    good = fills >= np.quantile(fills[fills > 0], 0.5)
    injected = (good & (rng.random(len(fills)) < 0.5))[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    displaced = broken[a] & ~injected
    child = np.full(len(a), -1, np.int32)
    kept = ~broken[a] & ~injected
    names_a, ia = np.unique(a[kept], return_inverse=True)
    names_b, ib = np.unique(b[injected], return_inverse=True)
    child[kept] = ia
    child[injected] = ib + len(names_a)
    made = len(names_a) + len(names_b)
    residuals = _Residuals()
    placed = child >= 0
    for bin_, space in enumerate((capacity - np.bincount(child[placed], weights=lengths[placed], minlength=made)).astype(int).tolist()):
        residuals.put(bin_, space)
    loose = np.flatnonzero(displaced)
    best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], child, capacity, residuals, made)
    return child


def ideal(lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """The score of which there is no better: as few bins as the tokens need, all full but one."""
    total = int(lengths.sum())
    bins, rest = -(-total // capacity), total % capacity
    return bins, -float((total // capacity) * capacity**2 + rest**2)


def evolve(
    lengths: np.ndarray, found: list[np.ndarray], capacity: int, seed: int, population: int = POPULATION, offspring: int = OFFSPRING,
) -> tuple[list[np.ndarray], int]:
    """One epoch of one island: the population, best first, and the crossovers made."""
    rng = np.random.default_rng(seed)
    best = ideal(lengths, capacity)
    pool = found or [_fresh(lengths, capacity, 0.0, rng), *(_fresh(lengths, capacity, 0.3, rng) for _ in range(population - 1))]
    ranked = sorted(((score(lengths, p), n, p) for n, p in enumerate(pool)), key=lambda x: x[:2])[:population]
    made = 0
    while made < offspring and ranked[0][0] > best and len(ranked) > 1:
        i, j = rng.choice(len(ranked), 2, replace=False).tolist()
        child = cross(lengths, ranked[i][2], ranked[j][2], capacity, rng)
        made += 1
        scored = score(lengths, child)
        if all(scored != other for other, _, _ in ranked):  # packings of one score are mostly the same one
            ranked = sorted([*ranked, (scored, len(pool) + made, child)], key=lambda x: x[:2])[:population]
    return [p for _, _, p in ranked], made


_STATE = "shard bigint, island int, lengths binary, packings array<binary>, generations bigint"
_STATE_ARROW = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("packings", pa.list_(pa.binary())), ("generations", pa.int64())])


def _epoch(capacity: int, epoch: int, population: int, offspring: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i4")
                found = [np.frombuffer(p, "<i4") for p in row["packings"]]
                best, made = evolve(lengths, found, capacity, row["shard"] * 1009 + row["island"] * 31 + epoch, population, offspring)
                row |= {"packings": [p.astype("<i4").tobytes() for p in best], "generations": row["generations"] + made}
                yield pa.RecordBatch.from_pylist([row], _STATE_ARROW)
        tidy()

    return run


def _problem(rows: pa.Table) -> pa.Table:
    lengths = np.sort(rows.column("length").to_numpy()).astype("<i4").tobytes()
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "lengths": pa.array([lengths], pa.binary())})


_PLACED = f"{_PIECES}, sequence_id bigint, offset bigint, generations bigint, loose boolean"
_OWN = [c.split()[0] for c in _PIECES.split(", ")]


def _place(level: int):
    """Rows of a shard and its islands' packings: each row's place in the best packing; loose are those of the worst filled bin."""
    def run(rows: pa.Table, won: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "deal", "start", "ids_crc32")])
        lengths = rows.column("length").to_numpy()
        packings = [np.frombuffer(p, "<i4") for p in won.column("packings")[0].as_py()]
        bins = min(packings, key=lambda p: (score(lengths, p), p.tobytes()))
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[by_bin])
        starts = ends - lengths[by_bin]
        first = np.flatnonzero(np.diff(bins[by_bin], prepend=-1))
        offset = np.empty(len(bins), np.int64)
        offset[by_bin] = starts - np.repeat(starts[first], np.diff(np.append(first, len(bins))))
        fills = np.bincount(bins, weights=lengths)
        worst = int(np.where(fills > 0, fills, np.inf).argmin())
        added = {
            "sequence_id": (level << 56) + (rows.column("shard").to_numpy() << 24) + bins, "offset": offset,
            "generations": np.full(len(bins), won.column("generations")[0].as_py()), "loose": bins == worst,
        }
        return pa.table({**{c: rows.column(c) for c in _OWN}, **{c: pa.array(v) for c, v in added.items()}})

    return run


def _packed(dealt: DataFrame, level: int, capacity: int, islands: int, epochs: int, population: int, offspring: int) -> DataFrame:
    """Pieces and their shard, each shard packed by its islands."""
    problems = dealt.select("shard", "length").groupBy("shard").applyInArrow(_problem, "shard bigint, lengths binary")
    state = problems.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("packings"),
        F.lit(0).cast("bigint").alias("generations"))
    for epoch in range(epochs):
        evolved = state.repartition(F.col("shard"), F.col("island")).mapInArrow(_epoch(capacity, epoch, population, offspring), _STATE)
        if epoch < epochs - 1:
            # An island goes on with its own packings and the best one of the island before it.
            ring = evolved.groupBy("shard").agg(F.first("lengths").alias("lengths"), F.array_sort(F.collect_list(F.struct("island", "packings", "generations"))).alias("all"))
            state = ring.select("shard", "lengths", "all", F.posexplode("all").alias("at", "own")).select(
                "shard", F.col("own.island").alias("island"), "lengths",
                F.concat(F.col("own.packings"), F.slice(F.element_at("all", F.pmod(F.col("at") - 1, F.size("all")).cast("int") + 1)["packings"], 1, 1)).alias("packings"),
                F.col("own.generations").alias("generations"),
            )
        else:
            state = evolved
    winners = state.groupBy("shard").agg(F.flatten(F.collect_list("packings")).alias("packings"), F.sum("generations").alias("generations"))
    return dealt.groupBy("shard").cogroup(winners.groupBy("shard")).applyInArrow(_place(level), _PLACED)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_size: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS,
    population: int = POPULATION, offspring: int = OFFSPRING,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; generations are the crossovers of its shard. Needs doc_id and text."""
    scratch = Scratch(docs.sparkSession, "packing")
    pair = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = scratch.write(pair.mapInArrow(_tokenized(tokenizer_path, capacity), _PIECES), "pieces")
    out = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        # Its own sequence: negative numbers from the row's place in the table.
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(0).cast("bigint").alias("generations"),
    )
    left, level = pieces.filter(F.col("length") < capacity), 0
    while True:
        shards = max(1, -(-left.count() // shard_size))
        dealt = left.select(*_OWN, F.pmod(F.xxhash64("doc_id", "piece", "deal", F.lit(level)), F.lit(shards)).cast("bigint").alias("shard"))
        placed = _packed(dealt, level, capacity, islands, epochs, population, offspring)
        if shards == 1:
            return out.unionByName(placed.select(*out.columns))
        placed = scratch.write(placed, f"level-{level}")
        out = out.unionByName(placed.filter(~F.col("loose")).select(*out.columns))
        left, level = placed.filter("loose"), level + 1
