"""N-gram Jaccard join by T-occurrence search with DivideSkip (Li, Lu and Lu, 2008).

Plan: texts with equal shingle sets collapse to one class.  Every shingle's corpus frequency is
counted; among its rarest shingles (as many as any partner must share one of) a class is met only
through those that another class has too.  Classes that meet form candidate blocks, found by stars
and distributed components.  A link can only lie inside a block.  Each block runs the T-occurrence
search over its own inverted lists: a query needs T of its shingles in any larger partner, so some of
its longest lists are set aside, the short ones are merged on a heap that skips what cannot reach the
remaining threshold, and each candidate is probed in the long lists by binary search.  Lists whose
documents are already one component are skipped, so a large group of near copies costs one pass and
never all pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, with_least
from .counts import answered, counts_of, deal, grain
from .runtime import Scratch, cut, split_batch
from .words import U64, mix, shingle_sets

#: Bits of a shingle by which its frequency is counted. Two shingles that fall together only look more
#: frequent than they are, which can add candidates and lose none.
RARITY_BITS = 44
SHIFT = U64(64 - RARITY_BITS)
#: A block of more shingles is dealt to cells, one for each pair of its parts, so that a task's memory is bounded.
BLOCK_SHINGLES = 2_000_000
#: Chunks of texts to a bucket of counts, so that chunks spread evenly.
CHUNKS = 3
#: The published cost ratio of a probe to a step of the merge, by which lists are called long.
MU = 0.0085
#: Unions after which lists are tested anew for documents of other components.
STALE = 256


def need(n, pct: int):
    """Least overlap of a set of n shingles with any partner."""
    return (pct * n + 99) // 100


def class_hash(s: np.ndarray, salt: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix(s ^ U64(salt)).sum(dtype=U64).astype(np.int64))


class Forest:
    """Union of small sets into large ones, with labels that can be read as an array."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def union(self, a: int, b: int) -> None:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(document, count) of each document that at least ``least`` of the sorted lists hold, in order.

    The lists' fronts lie on a heap.  If the smallest document is in too few of them, ``least - 1``
    fronts are popped and their lists jump to the document that is then smallest: what they skip is in
    fewer than ``least`` lists.
    """
    at = [0] * len(lists)
    heap = [(own[0], k) for k, own in enumerate(lists) if own]
    heapify(heap)
    while len(heap) >= least:
        doc = heap[0][0]
        popped = []
        while heap and heap[0][0] == doc:
            popped.append(heappop(heap)[1])
        if len(popped) >= least:
            yield doc, len(popped)
            wanted = doc + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return
            wanted = heap[0][0]
        for k in popped:
            own = lists[k]
            at[k] = bisect_left(own, wanted, at[k])
            if at[k] < len(own):
                heappush(heap, (own[at[k]], k))


def divide_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(document, count) of each document that at least ``least`` of the sorted lists hold.

    The longest lists, fewer than ``least``, are set aside; the rest is merged for the threshold that
    is left, and the candidates are probed in the long lists.
    """
    if len(lists) < least:
        return
    lists = sorted(lists, key=len, reverse=True)
    aside = min(least - 1, int(least / (MU * log2(max(len(lists[0]), 2)) + 1)))
    for doc, count in merge_skip(lists[aside:], least - aside):
        for own in lists[:aside]:
            i = bisect_left(own, doc)
            count += i < len(own) and own[i] == doc
        if count >= least:
            yield doc, count


def link_sets(sets: list[np.ndarray], pct: int) -> np.ndarray:
    """Component label of each set, sets linked when 100 * intersection >= pct * union.

    Sets are numbered by size, so that a query only looks for partners of its own size or more; these
    share at least 2 * pct / (100 + pct) of its shingles.  A first pass tries each set against the
    first one of each of its rarest lists, which joins large groups of near copies at once.
    """
    n = len(sets)
    forest = Forest(n)
    by_size = np.argsort([len(s) for s in sets], kind="stable") if n else np.zeros(0, np.int64)
    sets = [sets[i] for i in by_size]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    tokens = np.concatenate(sets) if n else np.zeros(0, U64)
    if not len(tokens):
        return forest.label
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(tokens, kind="stable").astype(np.int32)
    tokens = tokens[order]
    fresh = np.append(True, tokens[1:] != tokens[:-1])
    del tokens
    head = np.flatnonzero(fresh)
    length = np.diff(np.append(head, len(order)))
    group = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = group
    posting = doc[order]
    del doc, order, fresh
    keys = group.astype(np.int64) * n + posting
    del group
    start = np.cumsum(size) - size

    def lists(x: int) -> np.ndarray:
        own = rank[start[x] : start[x] + size[x]].astype(np.int64)
        return own[np.argsort(length[own], kind="stable")]

    def overlaps(own: np.ndarray, others: np.ndarray) -> np.ndarray:
        probe = (own[:, None] * n + others[None, :]).ravel()
        at = np.searchsorted(keys, probe)
        at[at == len(keys)] = 0
        return (keys[at] == probe).reshape(len(own), -1).sum(axis=0)

    for x in range(n):  # stars: the first document of each rare list
        if size[x]:
            own = lists(x)
            firsts = np.unique(posting[head[own[: size[x] - need(size[x], pct) + 1]]])
            firsts = firsts[(100 * size[firsts] >= pct * size[x]) & (forest.label[firsts] != forest.label[x])]
            for y in firsts.tolist():
                if forest.label[y] != forest.label[x]:
                    shared = int(overlaps(own, np.array([y]))[0])
                    if 100 * shared >= pct * (size[x] + size[y] - shared):
                        forest.union(x, y)

    def open_lists() -> np.ndarray:
        label = forest.label[posting]
        return np.minimum.reduceat(label, head) != np.maximum.reduceat(label, head)

    mixed, unions = open_lists(), 0
    for x in range(n):  # all others, in lists that still hold more than one component
        if not size[x]:
            continue
        own = lists(x)
        own = own[mixed[own]]
        least = -(-2 * pct * int(size[x]) // (100 + pct))
        if len(own) < least:
            continue
        most = np.searchsorted(size, 100 * size[x] // pct, side="right")
        found = []
        for t in own.tolist():
            docs = posting[head[t] : head[t] + length[t]]
            docs = docs[(docs > x) & (docs < most)]
            docs = docs[forest.label[docs] != forest.label[x]]
            if len(docs):
                found.append(docs.tolist())
        for y, shared in divide_skip(found, least):
            if 100 * shared >= pct * (size[x] + size[y] - shared) and forest.label[x] != forest.label[y]:
                forest.union(x, y)
                unions += 1
        if unions >= STALE:
            mixed, unions = open_lists(), 0
    label = np.empty(n, dtype=np.int64)
    label[by_size] = by_size[forest.label]
    return label


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id.

    Sets are distinct shingles of ``words`` lower-cased (A-Z) words; a shorter text is one shingle,
    a null or empty one has none and links with nothing.  Two sets link when
    100 * intersection >= percent * union; component_id is the smallest id reachable by links.
    Rows with a null id have component_id null and link with nothing; repeated rows each keep their
    row, rows that share an id but not a text are joined through that id.  An empty table stays empty.
    Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, ["text"]):
                sets = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([class_hash(s, k) for s in sets], pa.int64()) for k in (1, 2))],
                    names=["id", "n", "s1", "s2"],
                )

    meta = cut(docs.mapInArrow(describe, "id long, n long, s1 long, s2 long"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One text of each class in this task, so that copies do not travel."""
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in split_batch(batch, ["text"]):
                cls, rows = [], []
                for row, (s, i) in enumerate(zip(shingle_sets(part.column(1), words), part.column(0).is_valid().to_pylist(), strict=True)):
                    if i and len(s) and (h := (class_hash(s, 1), class_hash(s, 2))) not in seen:
                        seen.add(h)
                        cls.append(h[0])
                        rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), part.column(1).take(pa.array(rows, pa.int64()))], names=["s1", "text"])

    parts = grain(docs)
    texts = docs.mapInArrow(distinct, "s1 long, text string").withColumn("chunk", F.pmod("s1", F.lit(CHUNKS * parts)))
    texts = deal(texts.select("chunk", "text"))
    answers = answered(texts, lambda t: (*tally(chunk_sets(t, words)[0]), 0), RARITY_BITS, parts)

    def rarest(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        """Classes that share one of their rarest shingles with another, with those shingles."""
        sets, s1, s2, rows = chunk_sets(table, words)
        known, _ = tally(sets)
        count = counts_of(told)
        keep, prefix = [], []
        for j, s in enumerate(sets):
            f = count[np.searchsorted(known, s >> SHIFT)]
            first = np.lexsort((s, f))[: len(s) - need(len(s), percent) + 1]
            first = first[f[first] > 1]
            if len(first):
                keep.append(j)
                prefix.append(s[first].astype(np.int64))
        at = [rows[j] for j in keep]
        return pa.table(
            {
                "s1": pa.array([s1[j] for j in keep], pa.int64()),
                "s2": pa.array([s2[j] for j in keep], pa.int64()),
                "tokens": pa.array(prefix, pa.list_(pa.int64())),
                "text": table.column("text").take(pa.array(at, pa.int64())),
            }
        )

    cogroups = texts.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    met = cut(cogroups.applyInArrow(rarest, "s1 long, s2 long, tokens array<long>, text string"))

    # star of each shingle: every class with the smallest class that shares it
    shared = met.select(F.explode("tokens").alias("u"), F.col("s1").alias("v"))
    rows = met.agg(F.sum(F.size("tokens"))).first()[0] or 0
    stars = with_least(shared, rows, Scratch(docs.sparkSession)).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    blocks = cut(connected_components(stars).withColumnRenamed("node", "s1").withColumnRenamed("component", "block"))

    named = meta.where("id is not null and n > 0")
    classes = named.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    placed = cut(classes.join(blocks, "s1"))
    parts = placed.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    own = F.pmod(F.xxhash64("s2"), F.col("parts"))
    members = (
        placed.join(parts, "block")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("block", (F.least(own, "other") * F.col("parts") + F.greatest(own, "other")).alias("part"), "rep", "s1", "s2")
        .join(met.select("s1", "s2", "text"), ["s1", "s2"])
    )

    def search(table: pa.Table) -> pa.Table:
        sets, _, _, rows = chunk_sets(table, words)
        rep = table.column("rep").to_pylist()
        reps = [rep[r] for r in rows]
        label = link_sets(sets, percent)
        pairs = [(reps[i], reps[int(r)]) for i, r in enumerate(label) if int(r) != i]
        return pa.table({"u": pa.array([a for a, _ in pairs], pa.int64()), "v": pa.array([b for _, b in pairs], pa.int64())})

    links = members.groupBy("block", "part").applyInArrow(search, "u long, v long")
    # an id with several texts ties their classes together
    ties = named.groupBy("id").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b").select("id")
    tied = named.join(ties, "id", "left_semi").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select(F.col("id").alias("u"), F.col("rep").alias("v"))
    comps = connected_components(links.unionByName(tied))
    final = classes.join(comps, classes["rep"] == comps["node"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("c"))
    out = meta.join(final, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("c")), F.col("id"))).alias("component_id"))


def chunk_sets(table: pa.Table, words: int) -> tuple[list[np.ndarray], list[int], list[int], list[int]]:
    """The distinct shingle sets of a group's texts, their class hashes and the rows that they come from."""
    sets, one, two, rows, seen = [], [], [], [], set()
    for piece, lo in _slices(table.column("text")):
        for j, s in enumerate(shingle_sets(piece, words), lo):
            h = (class_hash(s, 1), class_hash(s, 2))
            if h not in seen:
                seen.add(h)
                sets.append(s)
                one.append(h[0])
                two.append(h[1])
                rows.append(j)
    return sets, one, two, rows


def tally(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shortened shingles and in how many sets each is."""
    return np.unique(np.concatenate(sets) >> SHIFT, return_counts=True) if sets else (np.zeros(0, U64), np.zeros(0, np.int64))


def _slices(col: pa.ChunkedArray) -> Iterator[tuple[pa.Array, int]]:
    batch = pa.RecordBatch.from_arrays([col.combine_chunks()], names=["text"])
    at = 0
    for part in split_batch(batch, ["text"]):
        yield part.column(0), at
        at += part.num_rows
