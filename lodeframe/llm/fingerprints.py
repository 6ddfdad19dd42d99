"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_partitions, mix

#: Names of a sketch, levels of phrases that feed it, and rounds of coin tossing a level.
SKETCH, LEVELS, ROUNDS = 64, 5, 3
#: Levels from this one on are sketched where a text has phrases there.
FROM_LEVEL = 2
#: The place of null ids, after all others.
LAST = -(2**63) + 1
#: Code points that are parsed at a time; whole texts are never cut.
BATCH_CHARS = 500_000
#: Ranges of text hashes, as a power of two, that the rows of one id are cut into where they are more than a range should have.
CUT_BITS = 6
STEP = np.uint64(0x9E3779B97F4A7C15)


def _places(differ: np.ndarray) -> np.ndarray:
    """The place of the lowest set bit, 64 where there is none."""
    low = (differ & (~differ + differ.dtype.type(1))).astype(np.float64)
    place = (low.view(np.uint64) >> np.uint64(52)).astype(np.int16) - np.int16(1023)
    return np.where(place < 0, 64, place).astype(np.uint8)


def _table() -> np.ndarray:
    """Labels of two neighbouring labels (own * 256 + left)."""
    own, left = np.meshgrid(np.arange(256, dtype=np.uint32), np.arange(256, dtype=np.uint32), indexing="ij")
    place = _places(own ^ left)
    return ((place << 1) | ((own >> np.minimum(place, 31)) & 1)).astype(np.uint8).ravel()


TABLE = _table()


def _coin(names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Small labels by deterministic coin tossing: each symbol and its left neighbour differ first in some bit; the label is the
    bit's place and value, so neighbours that differ keep different labels. A text's first symbol is held against its complement."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[begins] = ~names[begins]
    place = _places(names ^ left)
    now = (place << 1) | ((names >> np.minimum(place, names.dtype.itemsize * 8 - 1).astype(names.dtype)) & names.dtype.type(1)).astype(np.uint8)
    for _ in range(ROUNDS - 1):
        pair = now.astype(np.uint16) << 8
        pair[1:] |= now[:-1]
        pair[begins] = now[begins].astype(np.uint16) << 8 | ~now[begins]
        now = TABLE[pair]
    return now


def _phrases(names: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases that `names` is cut into, and the text of each. A phrase begins at a local minimum of the labels."""
    n = len(names)
    first = np.ones(n, bool)
    first[1:] = text_of[1:] != text_of[:-1]
    # runs of one symbol become a symbol first, so neighbours differ
    run = first.copy()
    run[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(run)
    length = np.diff(np.append(at, n)).astype(np.uint64)
    base = names[at]
    text_of, first = text_of[at], first[at]
    if names.dtype == np.uint64:
        names = np.where(length > 1, mix(base * STEP + length), base)
    else:  # code points: a run's length goes above them, into bits that no code point has; names of longer runs are of 64 bits
        names = base.astype(np.uint32) | (np.minimum(length, 2047).astype(np.uint32) - np.uint32(1)) << np.uint32(21)
        if (length > 2047).any():
            names = np.where(length > 2047, mix(base.astype(np.uint64) * STEP + length), names.astype(np.uint64))
    n = len(names)
    label = _coin(names, np.flatnonzero(first))
    cut = first.copy()
    inner = np.zeros(n, bool)
    inner[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] <= label[2:]) & ~first[1:-1] & ~first[2:]
    # two cuts never touch: after a start the next cut is two symbols on
    inner[1:] &= ~first[:-1]
    cut |= inner
    starts = np.flatnonzero(cut)
    size = np.diff(np.append(starts, n))
    place = np.arange(n, dtype=np.int32) - np.repeat(starts.astype(np.int32), size)
    powers = np.cumprod(np.full(int(size.max()) + 1 if n else 1, STEP, np.uint64))
    parts = mix(names.astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(parts, starts) + size.astype(np.uint64)), text_of[starts]


def _sketches(names: list[np.ndarray], owners: list[np.ndarray], texts: int) -> list[np.ndarray]:
    """The SKETCH smallest different names of each text."""
    name, owner = np.concatenate(names), np.concatenate(owners)
    order = np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    keep = np.ones(len(name), bool)
    keep[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    name, owner = name[keep], owner[keep]
    begin = np.searchsorted(owner, np.arange(texts + 1))
    return [name[begin[k] : min(begin[k] + SKETCH, begin[k + 1])] for k in range(texts)]


def sketch(texts: list[str]) -> list[np.ndarray]:
    """Sorted 64-bit phrase names for each text; none for an empty text. Texts are parsed side by side and don't touch."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
            chars += len(texts[end])
            end += 1
        out += _sketch_batch(texts[at:end])
        at = end
    return out


def _sketch_batch(texts: list[str]) -> list[np.ndarray]:
    lengths = np.array([len(x) for x in texts])
    if not lengths.sum():
        return [np.zeros(0, np.uint64) for _ in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    names, owner = points, np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    found, owners = [], []
    for level in range(1, LEVELS + 1):
        names, owner = _phrases(names, owner)
        if level >= FROM_LEVEL:
            found.append(mix(names + np.uint64(level)))
            owners.append(owner)
    return _sketches(found, owners, len(texts))


def as_text(names: np.ndarray) -> str:
    return names.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two texts' phrases, from the smallest names of both; 1 for two empty texts."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:SKETCH]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).sum() / len(both))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of `following` (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint: hexadecimal phrase names. Equal texts have equal fingerprints; null and empty texts have an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketch([x or "" for x in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([as_text(x) for x in found])], names=["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(slim: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """(id, cut, least hash) of the rows where ranges begin, in order (ids fall, hashes rise). Ranges begin at ids of the table; an id with more rows than a range should have
    begins one for each part of its texts' hashes that has rows. The list's length depends on `parts` alone."""
    found = slim.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] + [1.0], 10_000).alias("q"), F.count("*").alias("n")).first()
    if not found["n"]:
        return []
    heads = slim.filter(F.col("k").isin(sorted({int(x) for x in found["q"]})))
    heavy = [r["k"] for r in heads.groupBy("k").count().filter(F.col("count") > found["n"] / parts).collect()]
    cut = F.when(F.col("k").isin(heavy), F.shiftright("tie", 64 - CUT_BITS)).otherwise(F.lit(-(1 << CUT_BITS)).cast("long"))
    rows = heads.groupBy("k", cut.cast("int").alias("cut")).agg(F.min("tie").alias("tie")).collect()
    return sorted(((r["k"], r["cut"], r["tie"]) for r in rows), key=lambda r: (-r[0], r[1]))


def _names(spark, count: int) -> list[int]:
    """Numbers whose hash deals them to partitions 0, 1, ... of `count`: with them each range has a task of its own."""
    numbers = spark.range(64 * count + 64).select(F.col("id").cast("int").alias("i"))
    first = {r["p"]: r["i"] for r in numbers.groupBy(F.pmod(F.hash("i"), F.lit(count)).alias("p")).agg(F.min("i").alias("i")).collect()}
    return [first.get(p, p) for p in range(count)]


def _deal(bounds: list[tuple[int, int, int]], names: list[int]):
    """Rows with the range that they belong to, and a guest's copy of each range's first for the range before. Texts are packed by zstandard, to
    about half of what the shuffle's own codec makes of them."""
    whole = -(1 << CUT_BITS)
    place = {(k, cut): r for r, (k, cut, _) in enumerate(bounds)}
    last = {k: r for r, (k, _, _) in enumerate(bounds)}
    first = {(k, tie): r for r, (k, _, tie) in enumerate(bounds)}
    keys = sorted(last, reverse=True)
    falling = -np.array(keys, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, sent = zstandard.ZstdCompressor(level=6, write_checksum=False), set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                rows = batch.slice(begin, 1024)
                k = rows["k"].to_pylist()
                # a range holds ids from its own down to, but without, the next one's
                near = np.maximum(np.searchsorted(falling, -rows["k"].to_numpy(), "right") - 1, 0).tolist()
                at, where, guest = list(range(len(k))), [], [0] * len(k)
                for i, (x, tie, r) in enumerate(zip(k, rows["tie"].to_pylist(), near, strict=True)):
                    head = keys[r]
                    where.append(last[head] if x != head else place[x, whole] if (x, whole) in place else place[x, tie >> (64 - CUT_BITS)])
                    if (x, tie) in first and (x, tie) not in sent:  # one copy of a task's equal rows is enough
                        sent.add((x, tie))
                        at.append(i)
                        guest.append(1)
                where += [(first[k[i], rows["tie"][i].as_py()] - 1) % len(bounds) for i in at[len(k) :]]
                packed = pa.array([pack.compress(x.encode("utf-8", "surrogatepass")) for x in rows["text"].to_pylist()], pa.binary())
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].take(take), rows["k"].take(take), rows["tie"].take(take), pa.array([names[x] for x in where], pa.int32()), pa.array(where, pa.int32()), pa.array(guest, pa.int32()), packed.take(take)],
                    names=["doc_id", "k", "tie", "name", "range", "guest", "packed"],
                )

    return run


def compare_neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each document, of its text edited with the next one's, and their likeness.

    The next document is the one with the next smaller id (equal ids: by the text's hash; null ids are last); after the last comes the first. One
    shuffle deals the texts out by ranges of ids, and the rows of an id that fills a range by the hash of their texts too; each range is a task of its own. The first document of each range also goes to the range before, so every
    task has the next document of its last. Runs of one code point are named by their length, however long. Null texts are empty; repeated rows follow one another. An empty table gives no rows; a single document follows itself.
    Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(value).alias("tie"), value.alias("text"))
    bounds = _ranges(rows.select("k", "tie"), max(input_partitions(spark), 2))
    names = _names(spark, max(len(bounds), 1))
    # one task a range: rows of a range stand together, its own first
    dealt = rows.mapInArrow(_deal(bounds, names), "doc_id long, k long, tie long, name int, range int, guest int, packed binary")
    dealt = dealt.repartition(len(names), "name").sortWithinPartitions("range", "guest", F.col("k").desc(), "tie", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        unpack = zstandard.ZstdDecompressor()
        pending: list[tuple[int | None, str, str]] = []
        done = None

        def flush():
            if not pending:
                return None
            texts, nexts = [p[1] for p in pending], [p[2] for p in pending]
            changed = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
            own = sketch([*texts, nexts[-1]])
            altered = sketch(changed)
            after = [own[k + 1] if k + 1 < len(pending) and pending[k + 1][1] == nexts[k] else sketch([nexts[k]])[0] for k in range(len(pending))]
            own = own[:-1]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pending], pa.int64()),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in changed]),
                    pa.array([as_text(x) for x in own]),
                    pa.array([as_text(x) for x in altered]),
                    pa.array([likeness(a, b) for a, b in zip(own, altered, strict=True)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            pending.clear()
            return out

        chars = 0
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("range", "guest", "doc_id", "packed")]
            for r, guest, key, packed in zip(*cols, strict=True):
                if done == r:  # guests after the first: repeated ids
                    continue
                value = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                if held is not None:
                    if held[0] == r:
                        pending.append((held[1], held[2], value))
                        chars += len(held[2])
                    else:
                        raise RuntimeError("a range without its guest")
                if guest:
                    held, done = None, r
                else:
                    held = (r, key, value)
                if chars > BATCH_CHARS:
                    chars = 0
                    yield flush()
        if held is not None:
            raise RuntimeError("a range without its guest")
        if (last := flush()) is not None:
            yield last

    return dealt.mapInArrow(run, OUT)
