"""Boosted regression trees over all rows of a table, with the rules of Spark's ``GBTRegressor`` for squared error.

The first tree fits the label, each later one twice the residual, times the
step. Candidates for splits are the quantiles of a feature over all rows, in
64 bins; a node looks at a random share of the features and a tree at a
random share of the rows, and each tree is added up over all rows.

A row is packed into a byte a feature. One barrier stage keeps the rows in
its workers for the whole fit, about 60 bytes each, so trees cost neither jobs
nor scans. By level, the workers send histograms to the first of them, which
answers with the splits; of two children only the smaller one is counted.
"""

from __future__ import annotations

import os
import pickle
import secrets
import socket
from collections.abc import Iterator, Sequence
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..schema import ensure_importable

# Bins of a feature (6 bits), points and rows of a quantile summary, rows counted at a time, least rows that are worth a worker.
BINS = 64
POINTS, CHUNK = 512, 200_000
BLOCK = 1 << 16
WORKER_ROWS = 50_000
#: A split has to explain more than this share of a tree's sum of squares; less is rounding.
NOTHING = 1e-12


def _condensed(values: np.ndarray, counts: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their counts; beyond ``points`` of them, the upper ends of groups of like weight."""
    values, place = np.unique(values, return_inverse=True)
    counts = np.bincount(place, counts, minlength=len(values))
    if len(values) <= points:
        return values, counts
    upto = np.cumsum(counts)
    ends = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, points + 1) / points).clip(max=len(values) - 1))
    return values[ends], np.diff(upto[ends], prepend=0)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each feature of the partition, which are the columns but the last: values and counts."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = []
    chunk: list[pa.RecordBatch] = []

    def add() -> None:
        for k in range(chunk[0].num_columns - 1):
            x = np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in chunk])
            if not np.isfinite(x).all():
                raise ValueError("a feature of the boosted trees is null or not finite")
            if k == len(held):
                held.append([])
            held[k].append(_condensed(x, np.ones(len(x)), POINTS))
        chunk.clear()

    for batch in batches:
        if batch.num_rows:
            chunk.append(batch)
        if sum(b.num_rows for b in chunk) >= CHUNK:
            add()
    if chunk:
        add()
    for k, parts in enumerate(held):
        values, counts = _condensed(*(np.concatenate(x) for x in zip(*parts, strict=True)), POINTS)
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([values], pa.list_(pa.float64())), pa.array([counts], pa.list_(pa.float64()))], ["k", "v", "c"])


def _edges(parts: Sequence, width: int) -> tuple[list[np.ndarray], int]:
    """The thresholds of each feature, midway between a value and the next, and the number of rows."""
    out, rows = [], 0
    for k in range(width):
        own = [p for p in parts if p["k"] == k]
        values, counts = _condensed(np.concatenate([p["v"] for p in own]), np.concatenate([p["c"] for p in own]), np.iinfo(int).max)
        rows = round(counts.sum())
        upto = np.cumsum(counts)
        last = np.arange(len(values) - 1) if len(values) <= BINS else np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS))
        last = last[last < len(values) - 1]
        out.append((values[last] + values[last + 1]) / 2)
    return out, rows


def _packed(edges: list[np.ndarray]):
    """Arrow batches to blobs: two features of 6 bits a number, and the labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = np.zeros(((len(edges) + 1) // 2, batch.num_rows), np.uint16)
            for k, e in enumerate(edges):
                pairs[k // 2] += (np.searchsorted(e, batch.column(k).to_numpy(zero_copy_only=False)) << (0 if k % 2 else 6)).astype(np.uint16)
            y = batch.column(len(edges)).to_numpy(zero_copy_only=False)
            if not np.isfinite(y).all():
                raise ValueError("a label of the boosted trees is null or not finite")
            yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(y, float).tobytes()], pa.binary())], ["x", "y"])

    return run


def _prompt(link: Connection) -> Connection:
    """Send at once: small messages that wait for an acknowledgement would cost 40 ms a level."""
    with socket.socket(fileno=os.dup(link.fileno())) as s:
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return link


class _Links:
    """Connections between the first worker and the others; without others, nothing is sent."""

    def __init__(self, workers: int, key: bytes) -> None:
        self.rank, self.others, self.first = 0, [], None
        if workers == 1:
            return
        context = BarrierTaskContext.get()
        self.rank = context.partitionId()
        host = context.getTaskInfos()[self.rank].address.rpartition(":")[0].strip("[]")
        if self.rank:
            at = pickle.loads(bytes.fromhex(context.allGather("")[0]))
            self.first = _prompt(Client(at, authkey=key))
            self.first.send(self.rank)
            return
        with Listener((host, 0), backlog=workers, authkey=key) as listener:
            context.allGather(pickle.dumps(listener.address).hex())
            found: dict[int, Connection] = {}
            for _ in range(workers - 1):
                link = _prompt(listener.accept())
                found[link.recv()] = link
        self.others = [found[k] for k in sorted(found)]

    def total(self, own: np.ndarray) -> np.ndarray:
        """The sum over all workers at the first one; of no use elsewhere."""
        if self.first is not None:
            self.first.send_bytes(own.tobytes())
        for link in self.others:
            own = own + np.frombuffer(link.recv_bytes()).reshape(own.shape)
        return own

    def told(self, answer=None):
        """What the first worker says."""
        if self.first is not None:
            return pickle.loads(self.first.recv_bytes())
        blob = pickle.dumps(answer)
        for link in self.others:
            link.send_bytes(blob)
        return answer


def _histogram(pairs: np.ndarray, r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(2, features, bins): sums and counts of the rows, by blocks that a core's cache holds."""
    found = np.zeros((2, len(pairs), BINS * BINS))
    for at in range(0, len(rows), BLOCK):
        block = rows[at:at + BLOCK]
        own = r.take(block)
        for k, pair in enumerate(pairs):
            q = pair.take(block).astype(np.intp)
            found[0, k] += np.bincount(q, own, BINS * BINS)
            found[1, k] += np.bincount(q, minlength=BINS * BINS)
    square = found.reshape(2, len(pairs), BINS, BINS)
    return np.stack([square.sum(axis=3), square.sum(axis=2)], axis=2).reshape(2, -1, BINS)


def _best_split(h: np.ndarray, allowed: np.ndarray, least: int, above: float) -> tuple[int, int] | None:
    """(feature, last bin to the left) of the largest drop of the squared error, the first of equal ones."""
    s, n = np.cumsum(h, axis=2)[:, allowed]
    all_s, all_n = s[:, -1:], n[:, -1:]
    fits = (n >= least) & (all_n - n >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, s * s / n + (all_s - s) ** 2 / (all_n - n) - all_s * all_s / all_n, -np.inf)
    k, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(allowed[k]), int(b)) if gain[k, b] > above else None


class _Tree:
    """The first worker's side of a tree: nodes, and the histograms of those that may be split."""

    def __init__(self, edges: list[np.ndarray], depth: int, least: int, looked_at: int, rng: np.random.Generator) -> None:
        self.edges, self.depth, self.least, self.looked_at, self.rng = edges, depth, least, looked_at, rng
        self.nodes: list[list] = []
        self.open: list[tuple[int, np.ndarray]] = []
        self.above = 0.0

    def _node(self, s: float, n: float) -> int:
        self.nodes.append([-1, 0.0, -1, -1, s / n if n else 0.0])
        return len(self.nodes) - 1

    def level(self, counted: np.ndarray, asked: list, level: int) -> list[tuple]:
        """From the counted children (at first: the root) to a tuple for each open node: (value,) or (feature, bin, values, open, smaller)."""
        if not level:
            s, n = counted[0][:, 0].sum(axis=1)
            self.open = [(self._node(s, n), counted[0])]
        else:
            self.open = []
            for small, (parent, left, right, may, smaller) in zip(counted, asked, strict=True):
                both = (small, parent - small) if smaller == 0 else (parent - small, small)
                self.open += [(me, h) for me, h, m in zip((left, right), both, may, strict=True) if m]
        out, asked[:] = [], []
        for me, h in self.open:
            allowed = np.sort(self.rng.permutation(len(self.edges))[: self.looked_at])
            found = _best_split(h, allowed, self.least, self.above) if self.depth > level else None
            if found is None:
                out.append((self.nodes[me][4],))
                continue
            f, b = found
            (ls, ln), (s, n) = h[:, f, : b + 1].sum(axis=1), h[:, f].sum(axis=1)
            left, right = self._node(ls, ln), self._node(s - ls, n - ln)
            self.nodes[me][:4] = f, float(self.edges[f][b]), left, right
            may = tuple(level + 1 < self.depth and k >= 2 * self.least for k in (ln, n - ln))
            smaller = int(ln > n - ln)
            out.append((f, b, (self.nodes[left][4], self.nodes[right][4]), may, smaller))
            if any(may):
                asked.append((h, left, right, may, smaller))
        return out


def _fit(pairs: np.ndarray, y: np.ndarray, edges: list[np.ndarray], links: _Links, trees: int, depth: int, step: float, least: int, rate: float, looked_at: int, seed: int):
    """At the first worker: the nodes of each tree. All keep to the same steps."""
    rng = np.random.default_rng((seed, links.rank))
    choice = np.random.default_rng((seed, 0, 1))
    guess = np.zeros(len(y))
    found = []
    for k in range(trees):
        weight = step if k else 1.0
        r = 2 * (y - guess) if k else y
        taken = rng.random(len(y), dtype=np.float32) < rate
        parts = [(np.flatnonzero(taken), np.flatnonzero(~taken))]
        tree = _Tree(edges, depth, least, looked_at, choice)
        squares = links.total(np.array([np.square(r[taken]).sum()]))
        tree.above = NOTHING * squares[0]
        counted, asked, level = links.total(_histogram(pairs, r, parts[0][0])[None]), [], 0
        while parts:
            told = links.told(tree.level(counted, asked, level) if not links.rank else None)
            below, own = [], []
            for rows, (first, *more) in zip(parts, told, strict=True):
                if not more:
                    for part in rows:
                        guess[part] += weight * first
                    continue
                b, values, may, smaller = more
                left, right = [], []
                for part in rows:
                    code = pairs[first // 2].take(part)
                    goes_left = ((code & 63) if first % 2 else (code >> 6)) <= b
                    left.append(part.compress(goes_left))
                    right.append(part.compress(~goes_left))
                for side, value, opened in zip((left, right), values, may, strict=True):
                    if opened:
                        below.append(tuple(side))
                    else:
                        for part in side:
                            guess[part] += weight * value
                if any(may):
                    own.append(_histogram(pairs, r, (left, right)[smaller][0]))
            parts, level = below, level + 1
            if own:
                counted = links.total(np.stack(own))
        found.append((weight, tree.nodes))
    return found


def _slots(spark: SparkSession) -> int:
    """Tasks that run at a time, which a barrier stage may have; 1 where there can be no such stage."""
    context = spark.sparkContext._jsc.sc()
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def fit(rows: DataFrame, trees: int, depth: int, step: float, least: int, rate: float, share: float, seed: int, workers: int | None = None) -> list[tuple[float, list]]:
    """(weight, nodes) of each tree, a node being [feature or -1, threshold, left, right, value]; empty without rows.

    The last column of ``rows`` is the label, the others are the features.
    """
    ensure_importable()
    width = len(rows.columns) - 1
    held = rows.persist(StorageLevel.DISK_ONLY)
    try:
        parts = held.mapInArrow(_summaries, "k long, v array<double>, c array<double>").collect()  # size: partitions x features x POINTS
        if not parts:
            return []
        edges, n = _edges(parts, width)
        workers = workers or max(1, min(_slots(rows.sparkSession), n // WORKER_ROWS))
        key = secrets.token_bytes(16)
        looked_at = int(np.ceil(share * width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blobs = sorted((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows))
            wide = (width + 1) // 2
            pairs = np.concatenate([np.zeros((wide, 0), np.uint16), *(np.frombuffer(x, np.uint16).reshape(wide, -1) for x, _ in blobs)], axis=1)
            y = np.concatenate([np.zeros(0), *(np.frombuffer(v) for _, v in blobs)])
            del blobs
            links = _Links(workers, key)
            found = _fit(pairs, y, edges, links, trees, depth, step, least, rate, looked_at, seed)
            if not links.rank:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["found"])

        dealt = held.mapInArrow(_packed(edges), "x binary, y binary").repartition(workers)
        return pickle.loads(dealt.mapInArrow(run, "found binary", barrier=workers > 1).collect()[0][0])
    finally:
        held.unpersist()
