"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encoder, public_tokenizer, vocabulary

#: The schedule repeats after so many windows (more where a period has under 4 tokens a queue), and shares are multiples of 1 / (window * PERIOD).
PERIOD = 1024
#: Rows of (partition, queue) offsets that a broadcast may hold; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
END = 0


class Segment:
    """`windows` windows from `first` on: window g takes what row g % length of the table takes. A row is (queues, tokens of each); the table is kept
    by queue without zeros, so its size depends on its rows' tokens and not on the number of queues."""

    def __init__(self, first: int, windows: int, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.first, self.windows, self.length = first, windows, len(rows)
        queue, take = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        inner = np.concatenate([np.cumsum(t) - t for _, t in rows])
        row = np.repeat(np.arange(len(rows)), [len(q) for q, _ in rows])
        order = np.argsort(queue, kind="stable")
        self.row, self.take, self.inner = (x[order].astype(np.int32) for x in (row, take, inner))
        self.queues, at = np.unique(queue[order], return_index=True)
        self.at = np.append(at, len(order))
        # tokens of the queue in earlier rows
        cum = np.cumsum(self.take, dtype=np.int64) - self.take
        self.cum = cum - np.repeat(cum[at], np.diff(self.at))
        whole, part = divmod(windows, self.length)
        #: Tokens of each of self.queues in all windows.
        self.served = np.add.reduceat(self.take * (whole + (self.row < part)), at)

    def pieces(self, queue: int, lo: int, hi: int) -> np.ndarray:
        """Rows (begin, length, sequence, offset) of the queue's tokens [lo, hi) in this segment."""
        k = int(np.searchsorted(self.queues, queue))
        part = slice(int(self.at[k]), int(self.at[k + 1]))
        cum, take = self.cum[part], self.take[part]
        n, per = len(cum), int(cum[-1] + take[-1])
        j0, j1 = (x // per * n + int(np.searchsorted(cum, x % per, "right")) - 1 for x in (lo, hi - 1))
        turn, j = np.divmod(np.arange(j0, j1 + 1), n)
        bound = turn * per + cum[j]
        a, b = np.maximum(bound, lo), np.minimum(bound + take[j], hi)
        return np.stack([a, b - a, self.first + turn * self.length + self.row[part][j], self.inner[part][j] + a - bound], 1)


def quotas(weights: np.ndarray, active: np.ndarray, total: int) -> np.ndarray:
    """Integer shares of total by largest remainder, at least 1 for an active queue."""
    share = np.where(active, weights, 0.0)
    exact = share / share.sum() * total
    out = np.where(active, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    rest = total - int(out.sum())
    order = np.argsort(-(exact - np.floor(exact)) - active, kind="stable")[: int(active.sum())]
    while rest > 0:
        step = order[:rest]
        out[step] += 1
        rest -= len(step)
    while rest < 0:
        top = int(np.argmax(out))
        cut = min(-rest, int(out[top]) - 1)
        out[top] -= cut
        rest += cut
    return out


def round_robin(quantum: np.ndarray, window: int, period: int) -> Iterator[np.ndarray]:
    """Tokens that each of period windows takes from each queue. A queue earns quantum / period tokens a window; what it has
    earned and not been served is its deficit, carried to the next window. Room left by fractions goes to the largest deficits."""
    deficit = np.zeros(len(quantum), np.int64)
    for _ in range(period):
        deficit += quantum
        take = np.maximum(deficit // period, 0)
        rest = deficit - take * period
        room = window - int(take.sum())
        if room > 0:
            take[np.argsort(-rest, kind="stable")[:room]] += 1
        while room < 0:
            able = np.flatnonzero(take > 0)
            worst = able[np.argsort(rest[able], kind="stable")[:-room]]
            take[worst] -= 1
            room += len(worst)
        deficit -= take * period
        yield take


def _row(take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    queues = np.flatnonzero(take)
    return queues, take[queues]


def _fitting(rows: Iterable[np.ndarray | tuple[np.ndarray, np.ndarray]], left: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray | None]:
    """The first rows that the queues last for, what is left then, and the row that they don't last for."""
    out, left = [], left.copy()
    for take in rows:
        queues, n = take if isinstance(take, tuple) else _row(take)
        if (n > left[queues]).any():
            short = np.zeros(len(left), np.int64)
            short[queues] = n
            return out, left, short
        left[queues] -= n
        out.append((queues, n))
    return out, left, None


def schedule(totals: list[int], weights: list[float], window: int = 1024) -> tuple[list[Segment], list[int], int]:
    """Segments that serve queues of `totals` tokens, the tail's tokens by queue (under one window), and the number of full windows.

    While all queues last, one period's table repeats, so the work here grows with the number of queues and not with the tokens. When
    a queue runs out, the window at hand is filled up from the others by their weights, and these share anew.
    """
    left = np.array(totals, np.int64)
    wanted = np.array(weights, float)
    period = max(PERIOD, -(-4 * len(left) // window))
    out: list[Segment] = []
    first = 0
    while left.sum() >= window:
        active = left > 0
        if wanted[active].sum() <= 0:
            wanted = np.where(active, 1.0, 0.0)
        active_weights = np.where(active & (wanted > 0), wanted, 0.0)
        active = active_weights > 0
        rows, rest, short = _fitting(round_robin(quotas(active_weights, active, window * period), window, period), left)
        windows = len(rows)
        if short is None:  # the queues last for a period
            used = left - rest
            whole = int((left[used > 0] // used[used > 0]).min())
            part, rest, short = _fitting(rows, left - whole * used)
            windows = whole * period + len(part)
        if windows:
            out.append(Segment(first, windows, rows))
            left, first = rest, first + windows
        if left.sum() < window:
            break
        # a queue runs out in this window
        take = np.minimum(short, left)
        while (room := window - int(take.sum())) > 0:
            can = left - take
            share = np.where(can > 0, np.maximum(wanted, 1e-12), 0.0)
            more = np.minimum(np.floor(share / share.sum() * room).astype(np.int64), can)
            if not more.any():
                more[np.argmax(np.where(can > 0, share, -1.0))] = 1
            take += more
        out.append(Segment(first, 1, [_row(take)]))
        left, first = left - take, first + 1
    return out, [int(x) for x in left], first


def tail_sizes(n: int) -> list[int]:
    """Powers of two that add up to n, largest first: such sequences need no padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Plan:
    """Where the tokens [begin, begin + n) of a queue go."""

    def __init__(self, totals: list[int], weights: list[float], window: int):
        self.segments, tail, self.full = schedule(totals, weights, window)
        self.window = window
        self.tail_begin = np.array(totals, np.int64) - np.array(tail, np.int64)
        self.tail_inner = np.cumsum([0, *tail])[:-1]
        self.tail_cuts = np.cumsum([0, *tail_sizes(sum(tail))])
        # by queue: its segments, and its tokens before each and after the last
        queue, served = (np.concatenate([np.zeros(0, np.int64), *[getattr(s, k) for s in self.segments]]) for k in ("queues", "served"))
        segment = np.repeat(np.arange(len(self.segments)), [len(s.queues) for s in self.segments])
        order = np.argsort(queue, kind="stable")
        self.of = np.searchsorted(queue[order], np.arange(len(totals) + 1))
        self.segment_of = segment[order]
        ends = np.cumsum(served[order])
        self.ends = ends - np.repeat(np.append(0, ends)[self.of[:-1]], np.diff(self.of))

    def pieces(self, queue: int, begin: int, n: int) -> np.ndarray:
        """Rows (start in the document, length, sequence, offset)."""
        found, end = [], begin + n
        own, ends = self.segment_of[self.of[queue] : self.of[queue + 1]], self.ends[self.of[queue] : self.of[queue + 1]]
        for k in range(int(np.searchsorted(ends, begin, "right")), len(own)):
            before = int(ends[k - 1]) if k else 0
            if before >= end:
                break
            rows = self.segments[own[k]].pieces(queue, max(0, begin - before), min(end, int(ends[k])) - before)
            rows[:, 0] += before - begin
            found.append(rows)
        if end > self.tail_begin[queue]:
            a = max(begin, int(self.tail_begin[queue]))
            at = int(self.tail_inner[queue]) + a - int(self.tail_begin[queue])
            cuts = self.tail_cuts
            edges = np.unique(np.concatenate([[at, at + end - a], cuts[(cuts > at) & (cuts < at + end - a)]]))
            k = np.searchsorted(cuts, edges[:-1], "right") - 1
            found.append(np.stack([edges[:-1] - at + a - begin, np.diff(edges), self.full + k, edges[:-1] - cuts[k]], 1))
        return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


TOKENS = "part int, queue int, doc_id long, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


#: The queue of rows without a source.
NULL = "\0null"


def _tokenise(path: str, queue_of, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), {}
        code = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                ids, queues = code.encode([x or "" for x in rows["text"].to_pylist()]), list(map(queue_of.value.__getitem__, rows["source"].to_pylist()))
                end = np.array([END], "<u4").tobytes()
                ids = [x + end for x in ids]
                n = [len(x) // 4 for x in ids]
                at = []
                for q, size in zip(queues, n, strict=True):
                    at.append(before.get(q, 0))
                    before[q] = at[-1] + size
                short = ids if width == "<u4" else [np.frombuffer(x, "<u4").astype(width).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), pa.array(queues, pa.int32()), rows["doc_id"], pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(short, pa.binary())],
                    names=["part", "queue", "doc_id", "before", "n", "ids"],
                )

    return run


def _place(plan, queue_of, width: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = plan.value
        sources = pa.array([None if x == NULL else x for x in queue_of.value], pa.string())
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                cols = [rows[c].to_pylist() for c in ("queue", "begin", "n", "ids")]
                found, crcs, ids, repeat = [], [], [], []
                for queue, begin, n, short in zip(*cols, strict=True):
                    at = ready.pieces(queue, begin, n)
                    raw = memoryview(np.frombuffer(short, width).astype("<u4").tobytes())
                    found.append(at)
                    repeat.append(len(at))
                    cut = [raw[4 * a : 4 * (a + m)] for a, m in at[:, :2].tolist()]
                    crcs += [zlib.crc32(x) for x in cut]
                    if with_ids:
                        ids += [np.frombuffer(x, "<i4") for x in cut]
                at = np.concatenate(found)
                take = pa.array(np.repeat(np.arange(len(repeat)), repeat))
                out = [rows["doc_id"].take(take), *[pa.array(at[:, c]) for c in (0, 1)], pa.array(crcs, pa.int64()), rows["n"].take(take), *[pa.array(at[:, c]) for c in (2, 3)], sources.take(rows["queue"].take(take))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def pack(
    docs: DataFrame, window: int = 1024, mixture: dict[str, float] | None = None, tokenizer: str | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id", with_ids: bool = True
) -> DataFrame:
    """Packs the tokens of docs into sequences of `window` tokens, each with the mixture's share of every source.

    A document is its ids and then END. Each source is a queue in table order; a window takes its quota from each queue and
    carries the deficit, under one token, to the next window, also over partitions and periods. mixture: weights by source
    (default: the sources' tokens, so all queues end together); sources that it doesn't name follow when the others have run out. All
    sequences are full but for the last few, whose sizes are powers of two. Returns a row for each piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, source and, with_ids, the ids.

    Null and empty texts are END alone. Null sources are one queue; any number of sources has a queue each. Repeated rows and null ids are packed as they stand. An empty table
    gives no rows. Texts of any length are encoded whole. Other columns of docs, whatever their names, are ignored. Ids are kept in 16 bits where the vocabulary has up to
    65,536 of them, else in 32. Only (partition, queue) totals leave the token table, which is written once to the shared folder.
    """
    spark = docs.sparkSession
    path = tokenizer or public_tokenizer()
    width = "<u2" if vocabulary(path) <= 1 << 16 else "<u4"
    name = F.coalesce(F.col(source).cast("string"), F.lit(NULL))
    names = sorted(r[0] for r in docs.select(name.alias("q")).distinct().collect())
    queue_of = spark.sparkContext.broadcast({x: k for k, x in enumerate(names)})
    ready = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), name.alias("source"))
    tokens = materialise(ready.mapInArrow(_tokenise(path, queue_of, width), TOKENS), "pack-tokens")
    totals = tokens.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(totals.withColumn("base", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))), "pack-base")
    sums = {r["queue"]: r["tokens"] for r in base.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    have = [sums.get(k, 0) for k in range(len(names))]
    plan = spark.sparkContext.broadcast(Plan(have, [float(x) for x in have] if mixture is None else [mixture.get(x, 0.0) for x in names], window))
    base = base.select("queue", "part", "base")
    small = base.count() <= BROADCAST_ROWS
    placed = tokens.join(F.broadcast(base) if small else base, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("begin"), "n", "ids")
    return placed.mapInArrow(_place(plan, queue_of, width, with_ids), PIECES + (", ids array<int>" if with_ids else ""))
