"""N-gram Jaccard join by vertical partitioning of a global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, mix, word_hashes

NGRAM = 5
#: N-grams that stand last in the global order: the most frequent ones, at most so many (12 bytes each in a broadcast).
FREQUENT = 1 << 20
#: Frequencies are counted among so many n-grams at a time; what is found twice there is reported.
COUNTED = 2_000_000
#: Fragments after the first that the order is cut into for whole overlaps.
FRAGMENTS = 4
#: Tasks that a frequent n-gram's rows are spread over: where they are dealt, and where they are joined with a row for each n-gram.
SPREAD, JOIN_SPREAD = 64, 16
#: Comparisons are made with leaders of each group, in each round with so many times as many, until comparing the rest costs at most so many pairs a row.
MORE_LEADERS, PAIRS_A_ROW = 16, 8
#: Ids of documents that go which a broadcast may hold (16 bytes each); beyond it the documents are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Bits of the filter that picks the documents whose n-grams are needed whole, 16 for each; where it would need more, documents are picked by a join.
FILTER_BITS = 1 << 27
#: Texts that a worker holds at a time, and names of sets that it remembers.
SLICE, SEEN = 256, 1_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
HOT = np.uint64(1)
#: Sides of a pair that a set is on, and the columns of its fragments.
A, B = 1, 2
CUT = "key long, side int, fragment int, grams array<long>"


class Shingles:
    """Sorted different 63-bit n-gram hashes of some texts, one text's after the other; the lowest bit stays free. Text k's are grams[at[k] : at[k + 1]]."""

    def __init__(self, texts: list[str | None]):
        w, at = word_hashes([(x or "").encode("utf-8", "replace").lower() for x in texts])
        n = np.diff(at)
        size = np.where(n >= NGRAM, n - NGRAM + 1, np.minimum(n, 1))
        h = np.zeros(len(w), np.uint64)
        if len(w) >= NGRAM:
            h[: len(w) - NGRAM + 1] = w[: len(w) - NGRAM + 1]
            for i in range(1, NGRAM):
                h[: len(w) - NGRAM + 1] = h[: len(w) - NGRAM + 1] * STEP + w[i : len(w) - NGRAM + 1 + i]
        h += np.uint64(NGRAM)
        # a shorter text is one n-gram of its own kind
        for k in np.flatnonzero((n > 0) & (n < NGRAM)):
            value = w[at[k] : at[k] + 1].copy()
            for x in w[at[k] + 1 : at[k + 1]]:
                value = value * STEP + x
            h[at[k]] = value[0] + np.uint64(n[k])
        ends = np.cumsum(size)
        own = mix(h[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[:-1] - (ends - size), size)]) & ~HOT
        bounds = np.append(0, ends)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own[a:b].sort()
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        new[bounds[:-1][size > 0]] = True
        self.grams = own[new]
        self.at = np.append(0, np.cumsum(new))[bounds]
        self.sizes = np.diff(self.at)

    def of(self, k: int) -> np.ndarray:
        return self.grams[self.at[k] : self.at[k + 1]]

    def keys(self) -> np.ndarray:
        """A signed 64-bit name of each set; equal sets have equal names, and the empty set's is 0."""
        sums = np.append(np.uint64(0), np.cumsum(mix(self.grams + STEP)))
        total = sums[self.at[1:]] - sums[self.at[:-1]]
        value = mix(total ^ (self.sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        return np.where(self.sizes == 0, np.uint64(0), np.maximum(value, np.uint64(1))).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Shingles]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            part = batch.slice(begin, SLICE)
            yield part, Shingles(part["text"].to_pylist())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: (doc_id, set key, n). kind 1: (null, n-gram, documents that have it), where two or more of those counted together do."""
    held, size = [], 0

    def frequent() -> pa.RecordBatch:
        gram = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
        n = np.diff(np.append(first, len(gram)))
        gram, n = gram[first[n > 1]], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.nulls(len(gram), pa.int64()), _signed(gram), pa.array(n), pa.array(np.ones(len(gram), np.int32))], names=["doc_id", "key", "n", "kind"])

    for part, sets in _slices(batches):
        held.append(sets.grams)
        size += len(sets.grams)
        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sets.keys()), pa.array(sets.sizes), pa.array(np.zeros(part.num_rows, np.int32))], names=["doc_id", "key", "n", "kind"])
        if size >= COUNTED:
            yield frequent()
            held, size = [], 0
    if held:
        yield frequent()


def _prefixes(frequent):
    """(n-gram, set key, set size) of each different set's prefix: its first n // 4 + 1 n-grams in the global order. Two sets of a similarity
    of 3/4 or more share one of these. The lowest bit of an n-gram says that it is frequent. A set that a task meets again is passed
    over while its memory of SEEN names lasts; what comes twice is told apart later anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = frequent.value
        # most n-grams are told to be rare by their first bits
        maybe = np.zeros(1 << 22, bool)
        maybe[known >> np.uint64(42)] = True
        seen: set[int] = set()
        for _, sets in _slices(batches):
            keys, sizes, found = [], [], []
            hot = maybe[sets.grams >> np.uint64(42)]
            where = np.flatnonzero(hot)
            at = np.minimum(np.searchsorted(known, sets.grams[where]), max(len(known) - 1, 0))
            if len(where):
                same = known[at] == sets.grams[where]
                hot[where[~same]] = False
                where, at = where[same], at[same]
            bounds = np.searchsorted(where, sets.at)
            for k, key in enumerate(sets.keys().tolist()):
                if not sets.sizes[k] or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                take = int(sets.sizes[k]) // 4 + 1
                own = sets.of(k)[~hot[sets.at[k] : sets.at[k + 1]]][:take]
                if len(own) < take:
                    late = at[bounds[k] : bounds[k + 1]]
                    late = late[np.argsort(rank[late], kind="stable")][: take - len(own)]
                    own = np.concatenate([own, known[late] | HOT])
                keys.append(key)
                sizes.append(sets.sizes[k])
                found.append(own)
            if found:
                times = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), pa.array(np.repeat(np.array(keys, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int32), times))], names=["gram", "key", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (gram, key, n) sorted by (gram, key): different ones, of n-grams that are frequent or that another set has whose size lets the two link."""
    held = np.zeros((3, 0), np.int64)

    def told(rows: np.ndarray) -> pa.RecordBatch | None:
        if not rows.shape[1]:
            return None
        new = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(0))
        rows = rows[:, new]
        # by size within an n-gram, the next smaller and the next larger set are the likeliest partners
        rows = rows[:, np.lexsort((rows[2], rows[0]))]
        near = (rows[0, 1:] == rows[0, :-1]) & (4 * rows[2, :-1] >= 3 * rows[2, 1:])
        rows = rows[:, np.append(near, False) | np.append(False, near) | (rows[0] & 1 == 1)]
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], names=["gram", "key", "n"]) if rows.shape[1] else None

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.hstack([held, np.stack([batch["gram"].to_numpy(), batch["key"].to_numpy(), batch["n"].to_numpy().astype(np.int64)])])
        # the last n-gram may go on in the next batch; a frequent one needs no counting
        end = rows.shape[1] if rows[0, -1] & 1 else int(np.searchsorted(rows[0], rows[0, -1], "left"))
        held = rows[:, end:]
        if (out := told(rows[:, :end])) is not None:
            yield out
    if (out := told(held)) is not None:
        yield out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, side, fragment, n-grams) of (text, side), the n-grams cut by ranges of their hash."""
    ranges = np.array([((f + 1) << 64) // FRAGMENTS for f in range(FRAGMENTS - 1)], np.uint64)
    for part, sets in _slices(batches):
        keys, sides, fragments, grams = [], [], [], []
        names, side = sets.keys().tolist(), part["side"].to_pylist()
        for k in np.flatnonzero(sets.sizes).tolist():
            own = sets.of(k)
            keys += [names[k]] * FRAGMENTS
            sides += [side[k]] * FRAGMENTS
            fragments += range(FRAGMENTS)
            grams += [x.view(np.int64) for x in np.split(own, np.searchsorted(own, ranges))]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sides, pa.int32()), pa.array(fragments, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["key", "side", "fragment", "grams"])


def _picked(wanted):
    """_cut() of the documents in one of two filters, one for each side of a pair; those without an id are all in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch["slot"].to_numpy(zero_copy_only=False)
                there = np.isnan(slot) if slot.dtype.kind == "f" else np.zeros(len(slot), bool)
                at = np.where(there, 0, slot).astype(np.int64)
                first, second = ((x[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1 for x in bits)
                side = (A * (there | first) + B * (there | second)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["text"], pa.array(side)], names=["text", "side"]).take(pa.array(np.flatnonzero(side)))

        yield from _cut(chosen())

    return run


def _components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of an edge table (u, v): every node takes its smallest neighbour's name, edges follow, until none is left.

    Names are hashes, so a round removes a fixed part of the nodes whatever the graph's shape. A hub's edges are summed in parts before they meet, and its
    side of a join is one that Spark splits, as the other has a row for each node.
    """
    roots = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "component-step")
        if roots is None:
            roots = step.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            names = step.select(F.col("u").alias("root"), F.col("p").alias("next"))
            roots = scratch.keep(roots.join(names, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "component-roots")
        moved = edges.join(step.select("u", F.col("p").alias("pu")), "u").join(step.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        edges = scratch.keep(moved.filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "component-edges")
        if edges.isEmpty():
            return roots


def _needed(na: Column, nb: Column) -> Column:
    """Shared n-grams from which two sets link."""
    return F.ceil(F.lit(3) * (na + nb) / F.lit(7))


def _wanting(na: Column, nb: Column) -> Column:
    """What of these the prefixes have to share at least, if all that they leave is shared."""
    return _needed(na, nb) - F.greatest(na - F.floor(na / 4) - 1, nb - F.floor(nb / 4) - 1)


def _with_gram(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (gram, key, ...) joined with table (gram, ...) on the n-gram; a frequent n-gram's rows are dealt over JOIN_SPREAD tasks, to each of which its row of the table goes."""
    hot = F.col("gram").bitwiseAND(F.lit(1)) == 1
    left = rows.withColumn("part", F.when(hot, F.pmod("key", F.lit(JOIN_SPREAD))).otherwise(F.lit(0)).cast("int"))
    right = table.withColumn("part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(JOIN_SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, ["gram", "part"]).drop("part")


def _viable(rows: DataFrame) -> DataFrame:
    """Of rows (gram, key, n) those that can be part of a link: with the sizes that its group has, a set must share enough of its prefix with any others at all.

    What is wanting is least for the smallest and for the largest partner; two are allowed for rounding. A link's own rows always stay. A set's rows, at most a
    quarter of its n-grams, meet in one task to be counted; an n-gram's don't.
    """
    counted = rows.withColumn("c", F.count("*").over(Window.partitionBy("key")))
    size = rows.groupBy("gram").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k")).filter("k > 1")
    n = F.col("n")
    least = F.least(_wanting(n, F.greatest("lo", F.ceil(n * 3 / 4))), _wanting(n, F.least("hi", F.floor(n * 4 / 3))))
    return _with_gram(counted, size).filter(F.col("c") + 2 >= least).select("gram", "key", "n")


def _linked(pairs: DataFrame, first: DataFrame, fragments_of, scratch: Scratch) -> DataFrame:
    """The pairs (a, b, na, nb) with a similarity of 3/4 or more.

    The order's first fragment of a pair is the two prefixes (first: key, 16-bit marks of the n-grams, how many were merged by that): where these share c n-grams, the sets share at most c plus what
    the prefixes leave. Pairs that can still link have their overlaps counted in each further fragment and summed;
    fragments_of(keys) gives the fragments of the sets in such pairs, and of no others (a filter's errors aside), with the sides that each set is on: only there is it joined.
    """
    need = _needed(F.col("na"), F.col("nb"))
    a = first.select(F.col("key").alias("a"), F.col("marks").alias("ga"), F.col("merged").alias("ea"))
    b = first.select(F.col("key").alias("b"), F.col("marks").alias("gb"), F.col("merged").alias("eb"))
    # n-grams that share a mark count as one: as many as either set has merged are allowed for
    shared = F.size(F.array_intersect("ga", "gb")) + F.least("ea", "eb")
    hopeful = pairs.join(a, "a").join(b, "b").filter(shared >= _wanting(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb")
    hopeful = scratch.keep(hopeful, "join-hopeful")
    sides = hopeful.select(F.col("a").alias("key"), F.lit(A).alias("side")).union(hopeful.select("b", F.lit(B)))
    fragments = fragments_of(sides.groupBy("key").agg(F.bit_or("side").alias("side")))
    fa = fragments.filter(F.col("side").bitwiseAND(F.lit(A)) > 0).select(F.col("key").alias("a"), "fragment", F.col("grams").alias("ga"))
    fb = fragments.filter(F.col("side").bitwiseAND(F.lit(B)) > 0).select(F.col("key").alias("b"), "fragment", F.col("grams").alias("gb"))
    counts = hopeful.join(fa, "a").join(fb, ["b", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("n"))
    counts = counts.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("n").alias("n")).groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= need).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _classified(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, key, n_shingles, component, component_id) of each row: the name of its set, and of its component by a set's name and by its smallest id. Written to the shared folder; all other tables of the job are removed."""
    spark, scratch = docs.sparkSession, Scratch()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    survey = scratch.keep(rows.mapInArrow(_survey, "doc_id long, key long, n long, kind int"), "join-survey")
    members = survey.filter("kind = 0").select("doc_id", "key", "n")
    counts = survey.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    gram, n = counts["key"].to_numpy().astype(np.int64).view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(gram)
    rank = np.empty(len(gram), np.uint32)
    rank[np.lexsort((gram, n))] = np.arange(len(gram), dtype=np.uint32)
    frequent = spark.sparkContext.broadcast((gram[order], rank[order]))

    spread = F.when(F.col("gram").bitwiseAND(F.lit(1)) == 1, F.pmod("key", F.lit(SPREAD))).otherwise(F.lit(0))
    prefixes = rows.select("text").mapInArrow(_prefixes(frequent), "gram long, key long, n int")
    dealt = prefixes.repartition(int(parts), "gram", spread).sortWithinPartitions("gram", "key")
    early = Scratch()
    shared = early.keep(dealt.mapInArrow(_shared, "gram long, key long, n int"), "join-shared")
    frequent.destroy()

    classes = members.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"))
    groups = early.keep(_viable(_viable(shared)), "join-groups")
    # the cleanest set has the largest part of its prefix in common with others
    clean = (F.col("c") * 1_000_000 / (F.floor(F.col("n") / 4) + 1)).cast("long")
    mark = F.collect_set((F.pmod(F.shiftright("gram", 16), F.lit(1 << 16)) - F.lit(1 << 15)).cast("short"))
    involved = groups.groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("n"), mark.alias("marks")).join(classes.select("key", "id"), "key")
    involved = scratch.keep(involved.select("key", "id", "n", "c", clean.alias("clean"), "marks", (F.col("c") - F.size("marks")).alias("merged")), "join-involved")
    first = involved.select("key", "marks", "merged")

    def fragments_of(keys: DataFrame, own: Scratch) -> DataFrame:
        """One pass over the documents, in which a bit filter of a fixed size for each side of a pair picks those whose n-grams are needed whole; too many for it are joined by their ids."""
        ids = involved.select("key", "id").join(keys, "key").groupBy("id").agg(F.bit_or("side").alias("side"))
        ids = own.keep(ids, "join-wanted")
        on_a, on_b = (F.col("side").bitwiseAND(F.lit(x)) > 0 for x in (A, B))
        counted = ids.agg(F.count("*").alias("all"), F.count("id").alias("named")).first()
        wanted_rows = rows if counted["named"] < counted["all"] else rows.filter("doc_id is not null")
        if 16 * counted["all"] > FILTER_BITS:
            same = wanted_rows["doc_id"].eqNullSafe(ids["id"])
            return own.keep(wanted_rows.join(ids, same).select("text", "side").mapInArrow(_cut, CUT), "join-fragments")
        bits = 1 << max(10, (16 * counted["all"]).bit_length())
        slot = F.pmod(F.xxhash64("id"), F.lit(bits))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
        words = ids.filter("id is not null").select((slot / 64).cast("long").alias("w"), F.when(on_a, bit).otherwise(F.lit(0)).alias("a"), F.when(on_b, bit).otherwise(F.lit(0)).alias("b"))
        words = words.groupBy("w").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b")).toArrow()
        bitmap = np.zeros((2, bits // 64), np.uint64)
        for own_bits, side in zip(bitmap, ("a", "b"), strict=True):
            own_bits[words["w"].to_numpy()] = words[side].to_numpy().astype(np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(bitmap)
        picked = wanted_rows.select("text", F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64(F.col("doc_id")), F.lit(bits))).alias("slot"))
        out = own.keep(picked.mapInArrow(_picked(wanted), CUT), "join-fragments")
        wanted.destroy()
        return out

    groups = scratch.keep(groups.select("gram", "key").join(involved.select("key", "n", "c", "clean"), "key"), "join-rows")
    early.clear()
    labels = involved.select("key", F.col("key").alias("component"))
    total = groups.count()
    leaders = 1
    while True:
        own = Scratch()
        if leaders == 1:  # every class is a component of its own, so an n-gram's rows need no grouping by component
            now = groups.withColumn("component", F.col("key"))
            split = groups.groupBy("gram").agg(F.count("*").alias("all"), F.lit(1).cast("long").alias("most"), F.max("key").alias("big"), F.max(F.struct("clean", "key", "n", "c")).alias("lead")).filter("all > 1")
        else:
            now = groups.join(labels, "key")
            split = now.groupBy("gram", "component").agg(F.count("*").alias("size")).groupBy("gram")
            split = split.agg(F.sum("size").alias("all"), F.count("*").alias("k"), F.max(F.struct("size", "component")).alias("big")).filter("k > 1")
            split = split.select("gram", "all", F.col("big.size").alias("most"), F.col("big.component").alias("big"))
        split = own.keep(split, "join-split")
        work = split.agg(F.sum((F.col("all") - F.col("most")) * F.col("all")).alias("w")).first()["w"]
        if work is None:
            own.clear()
            break
        exact = work <= PAIRS_A_ROW * total
        outside = _with_gram(now, split.select("gram", "big")).filter("component <> big")
        if exact:
            lead = outside
        elif leaders == 1:
            lead = split.select("gram", "lead.key", "lead.n", "lead.c", F.col("lead.key").alias("component"))
        else:  # the cleanest outside the largest component, one of each of as many parts
            dealt = F.pmod(F.xxhash64("key", F.lit(leaders)), F.lit(leaders))
            lead = outside.groupBy("gram", dealt.alias("dealt")).agg(F.max(F.struct("clean", "key", "n", "c", "component")).alias("lead"))
            lead = own.keep(lead.select("gram", "lead.key", "lead.n", "lead.c", "lead.component"), "join-leaders")
        lead = lead.select("gram", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("c").alias("sx"), F.col("component").alias("cx"))
        pairs = (now.join(lead, "gram") if exact else _with_gram(now, lead)).filter("cx <> component")
        pairs = pairs.filter("4 * least(n, nx) >= 3 * greatest(n, nx)").filter(F.least("c", "sx") >= _wanting(F.col("n"), F.col("nx")))
        lower = F.col("key") < F.col("x")
        pairs = pairs.select(F.least("key", "x").alias("a"), F.greatest("key", "x").alias("b"), F.when(lower, F.col("n")).otherwise(F.col("nx")).alias("na"), F.when(lower, F.col("nx")).otherwise(F.col("n")).alias("nb")).distinct()
        links = own.keep(_linked(pairs, first, lambda keys, own=own: fragments_of(keys, own), own), "join-links")
        if not links.isEmpty():
            u = labels.select(F.col("key").alias("u"), F.col("component").alias("cu"))
            v = labels.select(F.col("key").alias("v"), F.col("component").alias("cv"))
            edges = links.join(u, "u").join(v, "v").filter("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
            roots = _components(own.keep(edges, "join-edges"), own)
            labels = scratch.keep(labels.join(roots, labels["component"] == roots["node"], "left").select("key", F.coalesce("root", "component").alias("component")), "join-labels")
        if exact:
            own.clear()
            break
        # leaders are done with their groups, and so are groups within one component or of two
        rest = own.keep(groups.join(split.filter("all > 2").select("gram"), "gram", "left_semi").join(lead.select("gram", F.col("x").alias("key")), ["gram", "key"], "left_anti").drop("c"), "join-rest")
        able = own.keep(_viable(rest.select("gram", "key", "n")).select("gram", "key"), "join-able")
        # what a set shares is counted anew: the n-grams that an uncompared pair shares are all in open groups
        counts = able.groupBy("key").agg(F.count("*").alias("c"))
        groups = scratch.keep(rest.join(able, ["gram", "key"]).join(counts, "key"), "join-rows")
        own.clear()
        leaders *= MORE_LEADERS

    named = involved.select("key", "id").join(labels, "key")
    smallest = named.groupBy("component").agg(F.min("id").alias("smallest"))
    of_key = named.join(smallest, "component").select("key", "component", "smallest")
    every = classes.select("key", "id").join(of_key, "key", "left").select("key", F.coalesce("component", "key").alias("component"), F.coalesce("smallest", "id").alias("smallest"))
    out = members.join(every, "key", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))
    out = materialise(out, "join-result")
    scratch.clear()
    return out


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_shingles and component_id, the smallest id reachable by links.

    Two documents link when the sets of their different word 5-grams have a Jaccard similarity of 3/4 or more; a text of
    fewer words is one n-gram, and a text without words (null, empty) links with nothing and is its own component. Words are runs other than blanks
    and ASCII controls from tab to carriage return, with A-Z in lower case. Null ids take part and get their component's smallest id (null if none).
    Repeated rows link. Texts of any length count whole. An empty table gives no rows. Other columns, whatever their names, are ignored.

    Documents with equal sets are one class from the start, named by a 64-bit hash of the set. The global order has rare n-grams
    first: by hash, then the most frequent ones by count (any order is exact; this one keeps groups small). Each
    class sends its prefix, sorted by n-gram in one shuffle. Groups of classes that share an n-gram are then not paired off: a round compares all with
    a few leaders of each group, links contract classes to components, and only classes outside a group's largest component
    are compared with the rest. A pair inside one component needs no comparison, so no link between components is lost.
    """
    return _classified(docs, text, doc_id).select("doc_id", "n_shingles", "component_id")


def _names(texts: pd.Series) -> pd.Series:
    return pd.Series(Shingles(texts.tolist()).keys())


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose component has a smaller id: one row of each component stays, and all texts without words (null, empty).

    Of rows of one component that share its smallest id the one with the least text stays; rows that share an id but no component are held apart by their
    texts. Rows without an id can't be told apart and stay. All columns stay, whatever their names. An empty table gives no rows.
    """
    found, columns = _classified(docs, text, doc_id), docs.columns
    repeated = materialise(found.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "near-repeated")
    gone = found.filter("doc_id <> component_id and n_shingles > 0").select("doc_id").distinct()
    gone = materialise(gone.join(repeated, "doc_id", "left_anti"), "near-gone")

    def held(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return rows.join(few, rows[doc_id].cast("long") == few["doc_id"], how)

    kept = held(docs, gone, "left_anti")
    if repeated.isEmpty():
        return kept
    # an id that rows share is no name of a row: these are told apart by the names of their sets
    twice = held(kept, repeated, "left_semi").toDF(*[f"c{k}" for k in range(len(columns))])
    row, value = F.struct(*twice.columns).alias("row"), f"c{columns.index(text)}"
    twice = twice.select(row, F.coalesce(F.col(value), F.lit("")).alias("text"), F.col(f"c{columns.index(doc_id)}").cast("long").alias("doc_id"), F.pandas_udf(_names, "long")(F.col(value)).alias("key"))
    of_set = found.select("doc_id", "key", "n_shingles", "component", "component_id").distinct()
    twice = twice.join(of_set, ["doc_id", "key"])
    ones = twice.filter("n_shingles > 0 and doc_id = component_id").groupBy("doc_id", "component").agg(F.min_by("row", "text").alias("row")).select("row")
    ones = ones.union(twice.filter("n_shingles = 0").select("row"))
    return held(kept, repeated, "left_anti").union(ones.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(columns)]))
