"""What the training-data operators share: tables, durable intermediates, word hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, materialise, shared_dir

__all__ = ["Scratch", "materialise", "shared_dir"]

#: A word is a run of characters other than blank and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where a lambda uses it for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def input_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class WordHashes(dict):
    """64-bit hashes of words, kept in a dictionary that is emptied when it is full; words beyond LONGEST bytes are hashed anew each time."""

    LONGEST = 64

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= self.LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, found: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly (fixed multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words are hashed as sums of byte values times powers of an odd number (a fixed multiplier), from running sums over a buffer of texts.
BASE = np.uint64(0xD1342543DE82EF95)
#: Bytes hashed at a time, and the longest word that the sums are used for; a longer one has a hash of its own.
BUFFER, LONG_WORD = 1 << 18, 512


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(BUFFER + 1, BASE, np.uint64), np.full(BUFFER + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


POWERS, INVERSES = _powers()
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a buffer."""
    raw = np.frombuffer(data, np.uint8)
    blank = BLANK[raw]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    sums = np.zeros(len(raw) + 1, np.uint64)
    short = len(raw) <= BUFFER
    if short:
        np.cumsum(np.where(blank, np.uint64(0), BYTES[raw] * POWERS[: len(raw)]), out=sums[1:])
        out = mix((sums[end] - sums[start]) * INVERSES[start] + (end - start).astype(np.uint64) * BASE)
    else:
        out = np.zeros(len(start), np.uint64)
    for k in np.flatnonzero(end - start > LONG_WORD) if short else range(len(start)):
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]], 3) if end[k] - start[k] > LONG_WORD else _hashed(data[start[k] : end[k]])[0][0]
    return out, start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs other than blanks) of some texts, one after the other, and where each text's begin, with the end at last.

    Equal words have equal hashes in every call. Buffers are cut at blanks only.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    held: list[bytes] = []
    size = first = 0

    def flush(upto: int) -> None:
        nonlocal held, size, first
        if held:
            found, start = _hashed(b" ".join(held))
            hashes.append(found)
            bounds = np.cumsum([0, *(len(x) + 1 for x in held)])
            counts[first + 1 : upto + 1] += np.diff(np.searchsorted(start, bounds))
        held, size, first = [], 0, upto

    for k, text in enumerate(texts):
        if size + len(text) + 1 > BUFFER:
            flush(k)
        if len(text) >= BUFFER:  # a long text goes by itself, in parts that end at blanks
            at = 0
            while at < len(text):
                end = at + BUFFER
                if end < len(text):
                    cut = max(text.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                    if cut <= at:  # one word, or its end, fills the buffer
                        cut = min((x for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(b, end)) >= 0), default=len(text))
                    end = cut
                found, _ = _hashed(text[at:end])
                hashes.append(found)
                counts[k + 1] += len(found)
                at = end
            first = k + 1
            continue
        held.append(text)
        size += len(text) + 1
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)
