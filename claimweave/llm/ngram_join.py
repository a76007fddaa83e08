"""Similarity join on sets of word shingles by T-occurrence search.

Two documents link when their sets overlap in 80 % of the union. The larger of two linked sets
has n shingles, so they share at least T = ceil(0.8 n). The join is exact:

1. Each text becomes its set of shingle hashes; documents with equal sets are one class.
2. All shingles have one order, common ones last. By the prefix principle linked sets share at
   least l shingles among their first n - T + l. These shingles are dealt by hash as inverted
   lists. Classes that meet in at least l short lists are candidates of each other; of a long list
   those classes that are in at least l long ones are all put into one candidate group.
3. Within a candidate group, cut into blocks, a T-occurrence search (DivideSkip) over the whole
   sets finds the links: short lists are merged with a heap, long ones are probed by binary
   search. Every pair of blocks whose sizes allow a link meets once, so all links are found and
   counted. Where components alone are asked for, what is in one already is not compared again.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import components, release_memory, small, text_fold
from claimweave.session import cut_lineage

WORDS = 5
#: Percent of the union that linked sets share.
PERCENT = 80
#: One document of so many tells which shingles are common. The order only decides how short the
#: lists are, any order gives the same links.
SAMPLE = 16
#: A shingle is common if so many documents of the sample have it.
COMMON = 3
#: Cells of the table of common shingles that tasks keep, one byte each.
CELLS = 1 << 22
#: Lists of more classes are long.
LONG = 64
#: Classes of a block, and of them those that go to every block of a large group.
BLOCK, PIVOTS = 512, 16
#: Shingles of a block where all links are counted; a longer set has a block of its own.
BLOCK_SHINGLES = 1 << 19

_R = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_INVERSE = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base & _M64)
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """Hashes of the distinct shingles of a text, in ascending order.

    The words, joined by single blanks, are hashed as a polynomial over their bytes modulo 2^64,
    from prefix sums, so that a shingle's hash depends on its own bytes alone.
    """

    def __init__(self, words: int = WORDS):
        self.words, self.up, self.down = words, _powers(_R, 1024), _powers(_INVERSE, 1024)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change
        if not words:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        if len(raw) > len(self.up):
            self.up, self.down = _powers(_R, 2 * len(raw)), _powers(_INVERSE, 2 * len(raw))
        ends = np.flatnonzero(raw == 32) + 1
        starts = np.r_[0, ends[:-1]]
        k = min(self.words, len(ends))
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self.down[starts]
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(33)
        return np.unique(h)


def needed(n: int, percent: int = PERCENT) -> int:
    """T: shingles that a set of n shares at least with a linked one."""
    return -(-percent * n // 100)


def prefix(shingles: np.ndarray, common: np.ndarray | None, percent: int = PERCENT) -> np.ndarray:
    """The first n - T + l shingles in the common-last order, l as in :func:`least_shared`."""
    n = len(shingles)
    keep = n - needed(n, percent) + least_shared(n, percent)
    if common is not None:
        level = common[(shingles & np.uint64(len(common) - 1)).astype(np.int64)]
        if level.any():
            return shingles[np.argsort(level, kind="stable")][:keep]
    return shingles[:keep]


def least_shared(n: int, percent: int = PERCENT) -> int:
    """l: short and long lists together in which two linked sets of about n meet at least."""
    return min(max(1, needed(n, percent)), 1 + n // 25)


def links_enough(shared: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def divide_skip(lists: list[list[int]], threshold: int, wanted: Callable[[int], bool] = lambda _: True) -> Iterator[tuple[int, int]]:
    """Ids that occur in at least ``threshold`` of the ascending lists, with their counts.

    The L longest lists are set aside. The others are merged with a heap; an id that occurs
    there less than threshold - L times can't reach the threshold, and while the heap's first ids
    are too few, its lists skip ahead by binary search. What is left is probed in the long lists,
    for as long as it can still reach the threshold and is ``wanted``.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < threshold:
        return
    longest = len(lists[-1])
    aside = min(threshold - 1, int(threshold / (0.0085 * np.log2(longest + 1) + 1)))
    short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least = threshold - aside
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= least:
        first, popped = heap[0][0], []
        while heap and heap[0][0] == first:
            popped.append(heapq.heappop(heap))
        target = first + 1
        if len(popped) >= least:
            count = len(popped) if wanted(first) else -len(lists)
            for j, x in enumerate(long_):
                if count + len(long_) - j < threshold:
                    break
                at = bisect_left(x, first)
                count += at < len(x) and x[at] == first
            if count >= threshold:
                yield first, count
        else:  # the next id that can be in `least` lists is not before the heap's then first one
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(target, heap[0][0])
        for _, i, at in popped:
            at = bisect_left(short[i], target, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles of more than one set; the others join nothing."""
    values, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
    return values[counts > 1]


def _keys(shingles: np.ndarray, shared: np.ndarray) -> list[int]:
    """Places of a set's shingles among the shared ones."""
    at = np.searchsorted(shared, shingles)
    at = at[at < len(shared)] if len(at) and at[-1] >= len(shared) else at
    return at[shared[at] == shingles[: len(at)]].tolist()


def linked_sets(sets: list[np.ndarray], side: list[int] | None = None, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """All links between sets, as pairs of places; with ``side`` (0 or 1 for each set) only those
    between the sides. Every set is searched among the smaller ones."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    shared = _shared(sets)
    index: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
    for place, i in enumerate(order):
        n, threshold, keys = len(sets[i]), needed(len(sets[i]), percent), _keys(sets[i], shared)
        own, other = (0, 0) if side is None else (side[i], 1 - side[i])
        if n and len(keys) >= threshold:
            for found, count in divide_skip([index[other].get(k, []) for k in keys], threshold):
                j = order[found]
                if links_enough(count, n, len(sets[j]), percent):
                    yield i, j
        for k in keys:
            index[own].setdefault(k, []).append(place)


def search_block(sets: list[np.ndarray], query: list[bool], component: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets of a block, as pairs of places that join components.

    Every set marked ``query`` is searched among the smaller ones before it, and the marked ones
    before it are found from the other side. ``component`` says what is joined already; of one
    component only the best candidates up to the first link are compared.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    names: dict[int, int] = {}
    parent = [names.setdefault(c, i) for i, c in enumerate(component)]
    lists: dict[int, list[int]] = {}  # of all sets so far, as places in the order
    queried: dict[int, list[int]] = {}  # of the queries so far
    shared = _shared(sets)
    out = []
    for place, i in enumerate(order):
        n, threshold = len(sets[i]), needed(len(sets[i]), percent)
        keys = _keys(sets[i], shared)

        def apart(other: int, i=i) -> bool:
            return _root(parent, i) != _root(parent, order[other])

        if n and len(keys) >= threshold:
            # All smaller sets if this is a query, else the queries among them.
            index = lists if query[i] else queried
            for other, count in divide_skip([index.get(k, []) for k in keys], threshold, apart):
                j = order[other]
                if links_enough(count, n, len(sets[j]), percent):
                    a, b = _root(parent, i), _root(parent, j)
                    parent[max(a, b)] = min(a, b)
                    out.append((i, j))
        for k in keys:
            lists.setdefault(k, []).append(place)
            if query[i]:
                queried.setdefault(k, []).append(place)
    return out


def shingle_sets(docs: DataFrame, common: np.ndarray | None, words: int, percent: int) -> DataFrame:
    """``doc_id, n, sig, prefix`` of every row; ``sig`` is a 128-bit hash of the set."""
    handle = docs.sparkSession.sparkContext.broadcast(common) if common is not None else None

    def describe(batches):
        import pyarrow as pa
        import xxhash

        shingler, table = Shingler(words), handle.value if handle else None
        for batch in batches:
            sizes, signs, heads = [], [], []
            for text in batch.column(1):
                s = shingler(text.as_py())
                sizes.append(len(s))
                signs.append(xxhash.xxh3_128_digest(s.tobytes()))
                heads.append(prefix(s, table, percent).view(np.int64))
            offsets = np.r_[0, np.cumsum([len(h) for h in heads])].astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "prefix"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, n long, sig binary, prefix array<long>")


def common_shingles(docs: DataFrame, words: int, sample: int = SAMPLE, least: int = COMMON, cells: int = CELLS) -> np.ndarray:
    """Level of each cell of shingles: 0, or the higher the more documents of a sample have one.

    The table has a fixed size. Shingles that share a cell share its level, which costs order and
    never a link."""

    def spell(batches):
        import pyarrow as pa

        shingler = Shingler(words)
        for batch in batches:
            found = [shingler(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64))], names=["h"])
        release_memory()

    part = docs.where(text_fold("doc_id", sample) == 0).select("text")
    counts = part.mapInArrow(spell, "h long").groupBy("h").count().where(F.col("count") >= least)
    level = F.least(F.lit(250), F.floor(4 * F.log2(F.col("count").cast("double")))).cast("int")
    rows = counts.groupBy(F.col("h").bitwiseAND(F.lit(cells - 1)).alias("cell")).agg(F.max(level).alias("level"))
    table = np.zeros(cells, np.uint8)
    for batch in rows.toLocalIterator():  # at most one row a cell
        table[batch[0]] = batch[1]
    return table


def _meet(long_: int):
    """Reads inverted lists (``s, doc, n``, sorted) and emits what meets in them: pairs of short
    lists, counted, and for a long list each class with the list's shingle, marked by no count."""

    def meet(batches):
        import pyarrow as pa

        def table(a, b, c):
            kinds = (pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((a, b, c), kinds)], names=["a", "b", "c"])

        def pairs(s, doc, n, percent=PERCENT):
            """All pairs of short lists in whole arrays, by distance within a list."""
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[first, len(s)])
            left = np.repeat(first + size, size) - np.arange(len(s)) - 1  # rows after this one in its list
            rows = np.flatnonzero((left > 0) & (np.repeat(size, size) <= long_))
            a, b, step = [], [], 1
            while len(rows):
                # Sizes ascend within a list: once too large, the rest of the list is as well.
                rows = rows[(left[rows] >= step)]
                rows = rows[100 * n[rows] >= percent * n[rows + step]] if len(rows) else rows
                a.append(doc[rows])
                b.append(doc[rows + step])
                step += 1
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            if not len(a):
                return
            both = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            new = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(1)])
            counts = np.diff(np.r_[new, len(both)])
            for i in range(0, len(new), 50_000):
                x = slice(i, i + 50_000)
                yield table(both[new[x], 0], both[new[x], 1], counts[x])

        s, doc, n = (np.zeros(0, np.int64) for _ in range(3))
        hub = None  # shingle of a long list that goes on
        for batch in batches:
            s, doc, n = (np.r_[x, batch.column(i).to_numpy()] for i, x in enumerate((s, doc, n)))
            again = np.r_[False, (s[1:] == s[:-1]) & (doc[1:] == doc[:-1])]  # repeated rows
            s, doc, n = s[~again], doc[~again], n[~again]
            if hub is not None:
                go = int(np.searchsorted(s != hub, True)) if (s != hub).any() else len(s)
                yield table(doc[:go], s[:go], np.zeros(go, np.int32))
                s, doc, n = s[go:], doc[go:], n[go:]
                if not len(s):
                    continue
                hub = None
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[first, len(s)])
            for f, k in zip(first[size > long_], size[size > long_]):
                yield table(doc[f : f + k], s[f : f + k], np.zeros(k, np.int32))
            last = first[-1]
            yield from pairs(s[:last], doc[:last], n[:last])
            if size[-1] > long_:
                hub = s[-1]
                last = len(s)
            s, doc, n = s[last:], doc[last:], n[last:]
        if len(s):
            yield from pairs(s, doc, n)
        release_memory()

    return meet


def candidate_groups(classes: DataFrame, percent: int = PERCENT, long_: int = LONG) -> DataFrame:
    """``node, component, n``: classes that may have a link, with a group that holds all theirs.

    ``classes``: ``node, n, prefix``. Two sets that share l shingles of their prefixes either meet
    often enough in short lists, or share a long list, which puts them into one group.
    """
    postings = classes.select(F.explode("prefix").alias("s"), "node", "n")
    ordered = postings.repartition("s").sortWithinPartitions("s", "n", "node")
    met = cut_lineage(ordered.mapInArrow(_meet(long_), "a long, b long, c int"))
    # The lists of a class that are long can't be counted for a pair. Pairs within short lists need what is
    # left of l.
    n_long = met.where("c = 0").groupBy("a").agg(F.count(F.lit(1)).alias("many"))
    sizes = cut_lineage(classes.select("node", "n"))
    counted = met.where("c > 0").groupBy("a", "b").agg(F.sum("c").alias("c"))
    known = sizes.join(n_long, sizes.node == n_long.a, "left").select("node", F.col("n"), F.coalesce("many", F.lit(0)).alias("many"))
    la, lb = known.toDF("a", "na", "ma"), known.toDF("b", "nb", "mb")
    needs = lambda n: F.greatest(F.lit(1), F.ceil(n * percent / 100))
    least = lambda n: F.least(needs(n), 1 + F.floor(n / 25))
    enough = F.col("c") + F.least("ma", "mb") >= F.least(least(F.col("na")), least(F.col("nb")))
    pairs = counted.join(la, "a").join(lb, "b").where(enough).select("a", "b")
    # Linked classes that meet in no short list, or in too few, are both in as many long lists as l asks of the smallest
    # set that links with them. Only such classes go into a group with others of a long list: one long list
    # in common says little of two large sets, and would chain unrelated ones to groups that grow with the table.
    many = cut_lineage(known.where(F.col("many") >= least(needs(F.col("n")))).select("node"))
    # Shingles stand for their lists; one that is the name of a class as well makes a group larger and no link less.
    stars = met.where("c = 0").join(many, F.col("a") == F.col("node"), "left_semi").select("a", "b")
    groups = components(pairs.union(stars)).join(sizes, "node")
    alone = groups.groupBy("component").agg(F.count(F.lit(1)).alias("_size")).where("_size = 1").select("component")
    return groups.join(alone, "component", "left_anti").select("node", "component", "n")


def _search(words: int, percent: int, paired: bool):
    """Texts of one or more blocks to links; sets are built here, so that only texts travel."""

    def search(table):
        import pyarrow as pa

        shingler = Shingler(words)
        blocks: dict[tuple, dict] = {}
        names = ("grp", "block", "node", "query", "now") if paired else ("grp", "block", "node")
        for *key, text in zip(*(table.column(n).to_pylist() for n in names), table.column("text").to_pylist()):
            held = blocks.setdefault(tuple(key[:2]), {})
            old = held.get(key[2])
            query = not paired or key[3] or (old is not None and old[1])
            held[key[2]] = (text if old is None else min(old[0], text), query, key[4] if paired else key[2])
        a, b = [], []
        for held in blocks.values():
            nodes = list(held)
            found = search_block([shingler(held[x][0]) for x in nodes], [held[x][1] for x in nodes], [held[x][2] for x in nodes], percent)
            a += [nodes[i] for i, _ in found]
            b += [nodes[j] for _, j in found]
        blocks.clear()
        release_memory()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def _count(words: int, percent: int):
    """Texts of one or more pairs of blocks to ``a, b, links``: with ``a = b`` the documents that
    class a links with in its pair of blocks, else a link that joins two classes."""

    def search(table):
        import pyarrow as pa

        shingler = Shingler(words)
        cells: dict[tuple, dict] = {}
        names = ("grp", "band", "block", "band2", "block2", "node", "side", "weight", "text")
        for *key, node, side, weight, text in zip(*(table.column(n).to_pylist() for n in names)):
            cells.setdefault(tuple(key), {})[node] = (side, weight, text)  # rows of one node have one text
        out = []
        for (_, *first, band, block), held in cells.items():
            nodes, (side, weight, texts) = list(held), zip(*held.values())
            links, parent = [0] * len(nodes), list(range(len(nodes)))
            for i, j in linked_sets([shingler(t) for t in texts], None if first == [band, block] else side, percent):
                links[i] += weight[j]
                links[j] += weight[i]
                a, b = _root(parent, i), _root(parent, j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((nodes[i], nodes[j], 0))
            out += [(x, x, n) for x, n in zip(nodes, links) if n]
        cells.clear()
        release_memory()
        columns = zip(*out) if out else ([], [], [])
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("a", "b", "links"), columns)})

    return search


def similar_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, long_: int = LONG, links: bool = False
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row, by its whole text.

    With ``links`` also ``n_links``, the number of other documents that it links with, copies
    included. All links are searched for it; otherwise only those that join components.

    Words are runs of characters that are not ASCII white space, A-Z in lower case. A text of
    fewer words than a shingle is one shingle; null texts and texts without words have none and
    link with nothing. ``component_id`` is the smallest doc_id reachable by links. Repeated rows
    give repeated results; rows with one id but several texts have their own sizes and links, and are
    one component together, each text counted as a document in ``n_links``; a null id has a null component
    and links with nothing. Extra columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text_hash = F.xxhash64("text")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(text_hash).alias("a"), F.max(text_hash).alias("b"))
    several = cut_lineage(several.where("a <> b").select(F.col("doc_id").alias("_own")))
    same = None
    if not several.isEmpty():
        # Each text of such an id is a node of its own, below zero, tied to the id's other ones.
        own = rows.join(small(several), F.col("doc_id") == F.col("_own"), "left")
        node = F.when(F.col("_own").isNotNull(), -1 - F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))).otherwise(F.col("doc_id"))
        rows = own.select(node.alias("doc_id"), "text")
        same = cut_lineage(own.where("_own is not null").select(node.alias("_rid"), "_own").distinct())
    found = _row_components(rows, words, percent, block, long_, same, links)
    if same is None:
        return found
    ids = found.join(same, F.col("doc_id") == F.col("_rid"), "left").withColumn("doc_id", F.coalesce("_own", "doc_id"))
    ids = cut_lineage(ids.withColumnRenamed("component_id", "_c").select(*["_c" if c == "component_id" else c for c in found.columns]))
    names = ids.groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    return ids.join(names, "_c", "left").select(*found.columns)


def _row_components(rows: DataFrame, words: int, percent: int, block: int, long_: int, same: DataFrame | None, count: bool) -> DataFrame:
    """:func:`similar_components` of rows whose ids have one text each; ``same(_rid, _own)`` ties ids together."""
    common = common_shingles(rows, words)
    sets = cut_lineage(shingle_sets(rows, common, words, percent))
    # Classes of equal sets; a class is named by its smallest id.
    named = sets.where("n > 0 and doc_id is not null")
    reps = cut_lineage(named.groupBy("sig").agg(F.min("doc_id").alias("node")))
    members = cut_lineage(named.select("doc_id", "sig").join(reps, "sig").select("doc_id", "node").where("doc_id <> node").distinct())
    classes = named.join(reps, "sig").where("doc_id = node").select("node", "n", "prefix")
    groups = cut_lineage(candidate_groups(classes, percent, long_))
    counted = None
    if count:
        others = cut_lineage(members.groupBy("node").agg(F.count(F.lit(1)).alias("others")))
        found = all_links(rows, groups, others, words, percent, block)
        links = found.where("a <> b").select("a", "b")
        both = found.where("a = b").select(F.col("a").alias("node"), "links").union(others)
        classes = cut_lineage(both.groupBy("node").agg(F.sum("links").alias("n_links")))
        each = members.join(small(classes), "node").select("doc_id", "n_links")
        counted = cut_lineage(classes.select(F.col("node").alias("doc_id"), "n_links").union(each).toDF("_of", "n_links"))
    else:
        links = block_links(rows, groups, words, percent, block)
    links = members.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).union(links)
    if same is not None:
        least = same.groupBy(F.col("_own").alias("o")).agg(F.min("_rid").alias("b"))
        links = links.union(same.join(least, F.col("_own") == F.col("o")).select(F.col("_rid").alias("a"), "b").where("a <> b"))
    joined = components(links)
    joined = cut_lineage(joined.select(F.col("node").alias("_node"), "component"))
    found = sets.select("doc_id", F.col("n").alias("n_shingles")).join(joined, F.col("doc_id") == F.col("_node"), "left")
    columns = ["doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")]
    if counted is not None:
        found = found.join(counted, F.col("doc_id") == F.col("_of"), "left")
        has = F.col("n_shingles") > 0  # a repeated id may have a row without words
        columns.append(F.when(has, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    return found.select(*columns)


def all_links(rows: DataFrame, groups: DataFrame, others: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """``a, b, links`` as of :func:`_count`, over all pairs of classes of a group.

    ``others``: ``node, others``, the documents of a class besides the one it is named by. A group of more than
    one block is cut into bands of set sizes, so that links reach from a band into the next one at most, and each
    band into blocks by a hash. A pair of blocks is one unit of work, whatever the size of its group.
    """
    classes = groups.join(others, "node", "left").select("node", F.col("component").alias("grp"), "n", (F.coalesce("others", F.lit(0)) + 1).alias("weight"))
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    whole = cut_lineage(classes.groupBy("grp").agg(n_blocks.alias("whole")))
    # A little wider than the largest ratio of linked sizes, for rounding.
    band = F.when(F.col("whole") > 1, F.floor(F.log("n") / math.log(101 / percent))).otherwise(0)
    banded = cut_lineage(classes.join(small(whole), "grp").withColumn("band", band).drop("whole"))
    cells = cut_lineage(banded.groupBy("grp", "band").agg(n_blocks.alias("blocks")))
    above = cells.select("grp", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = cells.select("grp", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    around = cut_lineage(cells.join(above, ["grp", "band"], "left").join(below, ["grp", "band"], "left").na.fill(0, ["above", "below"]))
    own = banded.join(small(around), ["grp", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def meets(count: str, there, names: tuple[str, ...]):
        each = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col(count), F.lit(1))), lambda i: F.struct(*[x.cast("long").alias(y) for x, y in zip(there(i - 1), names)]))
        return F.when(F.col(count) > 0, each).otherwise(F.slice(each, 1, 0))

    here, mine, names = F.col("band"), F.col("own"), ("band", "block", "band2", "block2", "side")
    pairs = F.concat(
        meets("blocks", lambda j: (here, F.least(mine, j), here, F.greatest(mine, j), mine > j), names),
        meets("above", lambda j: (here, mine, here + 1, j, F.lit(0)), names),
        meets("below", lambda j: (here - 1, j, here, mine, F.lit(1)), names),
    )
    placed = cut_lineage(own.select("node", "grp", "n", "weight", F.explode(pairs).alias("p")).select("node", "grp", "n", "weight", "p.*"))
    total = placed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tasks = max(1, -(-total["rows"] // (2 * block)), -(-total["n"] // BLOCK_SHINGLES))
    placed = placed.withColumn("task", F.pmod(F.xxhash64("grp", "band", "block", "band2", "block2"), F.lit(tasks)))
    texts = rows.join(small(placed), F.col("doc_id") == F.col("node")).select("task", "grp", "weight", "node", *names, "text")
    return cut_lineage(texts.groupBy("task").applyInArrow(_count(words, percent), "a long, b long, links long"))


def block_links(rows: DataFrame, groups: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """``a, b``: links that join all classes of each group that links join."""
    counts = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = groups.join(counts, "component")
    # A group's classes go to blocks by a hash; some classes go to every block of their group.
    n_blocks = F.ceil(F.col("size") / block)
    order = F.xxhash64("node")
    sized = sized.withColumn("blocks", n_blocks).withColumn("block", F.pmod(order, F.col("blocks")))
    pivot = F.pmod(F.shiftright(order, 20), F.col("size")) < PIVOTS
    every = F.when(pivot & (F.col("blocks") > 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    total = groups.count()
    tasks = F.lit(-(-total // (2 * block)) or 1)
    placed = cut_lineage(sized.select("node", F.col("component").alias("grp"), "blocks", "block", every.alias("every")))
    # Small blocks share a task by a hash.
    first = placed.select("node", "grp", F.explode("every").alias("block")).withColumn("task", F.pmod(F.xxhash64("grp", "block"), tasks))
    first = rows.join(small(cut_lineage(first)), F.col("doc_id") == F.col("node")).select("task", "grp", "block", "node", "text")
    found = cut_lineage(first.groupBy("task").applyInArrow(_search(words, percent, False), "a long, b long"))
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return found
    # Blocks of large groups: what isn't in a group's largest component yet meets all its blocks.
    known = components(found).select(F.col("node").alias("k"), F.col("component").alias("now"))
    now = large.join(known, F.col("node") == F.col("k"), "left").select("node", "grp", "block", F.coalesce("now", "node").alias("now"))
    mains = now.groupBy("grp", "now").count().groupBy("grp").agg(F.max_by("now", F.struct("count", "now")).alias("main"))
    now = cut_lineage(now.join(mains, "grp").withColumn("query", F.col("now") != F.col("main")).drop("main"))
    loose = now.where("query").groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    wide = cut_lineage(now.join(loose, "grp"))
    if wide.isEmpty():
        return found
    queries = wide.where("query").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))).drop("block")
    left = queries.join(wide.select("grp", "block").distinct(), "grp")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    right = wide.withColumn("part", parts).withColumn("query", F.lit(False))
    columns = ["grp", "part", "block", "node", "query", "now"]
    pairs = cut_lineage(left.select(*columns).union(right.select(*columns)))
    texts = rows.join(small(pairs), F.col("doc_id") == F.col("node")).select(*columns, "text")
    more = texts.groupBy("grp", "part", "block").applyInArrow(_search(words, percent, True), "a long, b long")
    return found.union(cut_lineage(more))


def drop_similar(docs: DataFrame, **how) -> DataFrame:
    """One document of each component of :func:`similar_components` stays, that with the smallest
    id, with all its columns; of rows with one id all stay, and those with a null id."""
    found = similar_components(docs, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("_copy"))
    copies = cut_lineage(found.distinct())
    return docs.join(small(copies), F.col("doc_id").cast("long") == F.col("_copy"), "left_anti")
