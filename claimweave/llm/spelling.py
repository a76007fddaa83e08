"""Spelling variants of one edit by dynamic programming over a sorted vocabulary.

Runs of neighbours in the sorted list share a prefix, as their LCPs tell. A row of the edit matrix,
three cells wide for one edit, is computed once for each run, reused for all longer prefixes in it,
and a run whose row exceeds one edit is skipped whole."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import running_starts
from claimweave.session import cut_lineage

#: Shortest word; each pair of words of one edit then shares its first or its last three letters.
LEAST = 7
#: A longest run of letters; shorter ones cannot become a word.
RUN = rf"[A-Za-zÀ-ÿ]{{{LEAST},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of one slice of the sorted list, the unit of work of a task.
SLICE = 256 * 1024
#: Queries that are moved through a slice at once.
QUERIES = 1024
#: Prefixes are followed up to this depth; what is left of longer words is compared directly.
DEPTH = 1024
#: First letters of a slice's ends that its directory keeps.
ENDS = 64
LAST = "\U0010ffff"


def damaged_words(docs: DataFrame) -> DataFrame:
    """``word``: one row for each run of letters of each text, lower-cased in A-Z alone, with one
    letter deleted where 31 divides the crc32 of ``<doc_id>:<run>``; shorter results are left out.
    Null texts hold no run; a null id counts as empty text."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")
    )
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", low.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST)


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """``word, n``: words of at least ``least`` occurrences, counted with a partial aggregate."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def shared(word_letters: int) -> int:
    """Letters at the side away from the edit that a word shares with any near word."""
    return (word_letters - 1) // 2


def start_level(word: str) -> int:
    """Letters that a query and a run must share before the matrix begins."""
    return min(shared(len(word)), DEPTH - 1)


def _step(rows: tuple, ch, before, here, after, room) -> tuple:
    """The next row of the banded matrix: ``rows`` are the distances of the prefix so far to the
    query's prefixes one shorter, as long, and one longer; ``ch`` is the prefix's next letter,
    the next three are the query's letters around it, ``room`` how many it has left from here."""
    a = np.minimum(rows[0] + (before != ch), rows[1] + 1)
    b = np.minimum(np.minimum(rows[1] + (here != ch), rows[2] + 1), a + 1)
    a[room < 0], b[room < 1] = 2, 2
    c = np.minimum(rows[2] + (after != ch), b + 1)
    c[room < 2] = 2
    return a, b, c


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters in one array, where each word begins in it, and its length."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return np.r_[flat, np.zeros(1, np.uint32)], np.r_[0, np.cumsum(length)[:-1]].astype(np.int64), length


class SortedSlice:
    """Sorted distinct words as levels of runs: the runs of level d share d letters, and each
    splits into runs of d + 1 letters and, first, the word that ends there (letter 0)."""

    def __init__(self, words: list[str], wanted: list[tuple[int, int]]):
        """``wanted``: pairs of a word's place and a level; ``self.start`` has the run of each."""
        flat, begin, length = _letters(words)
        self.words, self.count, self.first, self.letter, self.low, self.high = words, [], [], [], [], []
        self.start = np.full(len(wanted), -1)
        place, level = np.array([w[0] for w in wanted], np.int64), np.array([w[1] for w in wanted], np.int64)
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(DEPTH + 2))
        alive, run, runs = np.arange(len(words)), np.zeros(len(words), np.int64), 1
        for d in range(min(DEPTH, int(length.max(initial=0)) + 1)):
            inside = d < length[alive]
            ch = np.where(inside, flat[np.where(inside, begin[alive] + d, 0)], 0)
            new = np.r_[True, (run[1:] != run[:-1]) | (ch[1:] != ch[:-1])]
            self.count.append(np.bincount(run[new], minlength=runs))
            self.first.append(np.r_[0, np.cumsum(self.count[-1])[:-1]])
            self.letter.append(ch[new])
            self.low.append(alive[new])
            self.high.append(np.r_[alive[np.nonzero(new)[0][1:] - 1], alive[-1]] + 1)
            run, runs = np.cumsum(new) - 1, int(new.sum())
            asked = by_level[bounds[d + 1] : bounds[d + 2]]
            self.start[asked] = run[np.searchsorted(alive, place[asked])]
            alive, run = alive[ch != 0], run[ch != 0]
            if not len(alive):
                break

    def near(self, queries: list[str], starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (query, word) places with exactly one edit behind the shared letters."""
        flat, begin, length = _letters(queries)
        level = np.array([start_level(q) for q in queries], np.int64)
        who, run, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), tuple(np.zeros(0, np.int8) for _ in range(3))
        for d in range(int(level.min()), len(self.count)):
            fresh = np.nonzero(level == d)[0]
            who, run = np.r_[who, fresh], np.r_[run, starts[fresh]]
            ones, zeros = np.ones(len(fresh), np.int8), np.zeros(len(fresh), np.int8)
            rows = np.r_[rows[0], ones], np.r_[rows[1], zeros], np.r_[rows[2], ones]
            if not len(who):
                if d > level.max():
                    return
                continue
            n = self.count[d][run]
            turn = np.repeat(np.arange(len(who)), n)
            child = np.arange(len(turn)) - np.repeat(np.cumsum(n) - n, n) + self.first[d][run][turn]
            who, ch = who[turn], self.letter[d][child]
            rows = tuple(r[turn] for r in rows)
            over = length[who] - d
            ends = ch == 0
            if ends.any():
                cell = np.select([over[ends] == k for k in (-1, 0, 1)], [r[ends] for r in rows], 2)
                yield who[ends][cell == 1], self.low[d][child[ends]][cell == 1]
            letter = begin[who] + d
            around = [np.where(over > k, flat[np.clip(letter + k, 0, len(flat) - 1)], 0xFFFFFFFF) for k in (-1, 0, 1)]
            rows = _step(rows, ch, *around, over)
            on = ~ends & (np.minimum(np.minimum(rows[0], rows[1]), rows[2]) <= 1)
            who, run, rows = who[on], child[on], tuple(r[on] for r in rows)
        for q, r in zip(who.tolist(), run.tolist()):
            rest = range(self.low[-1][r], self.high[-1][r])
            found = [k for k in rest if one_edit(queries[q], self.words[k])]
            yield np.full(len(found), q), np.array(found, np.int64)


def one_edit(x: str, y: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    low, high = 0, len(x)
    while low < high:  # the longest common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid - 1)
    return x[low + (len(x) == len(y)) :] == y[low + 1 :]


def slice_stats(rows: pd.DataFrame) -> pd.DataFrame:
    """``word, near, best, form`` for the queries of one slice: how many near words it holds for
    them and the most frequent of these. Rows: ``way`` (1: spelt backwards), ``key, n, visits``."""
    rows = rows.sort_values("key")
    members, visitors = rows[~rows.visits], rows[rows.visits]
    words, counts, back = members.key.tolist(), members.n.to_numpy(), bool(rows.way.iloc[0])
    queries = words + visitors.key.tolist()
    level = [start_level(q) for q in queries]
    at = list(range(len(words)))
    for q in queries[len(words) :]:
        prefix = q[: start_level(q)]
        k = bisect_left(words, prefix)
        at.append(k if k < len(words) and words[k].startswith(prefix) else -1)
    taken = [i for i, k in enumerate(at) if k >= 0]
    slice_ = SortedSlice(words, [(at[i], level[i]) for i in taken])
    true = [w[::-1] for w in words] if back else words
    rank = np.argsort(np.argsort(np.array(true, object)))
    out = []
    for i in range(0, len(taken), QUERIES):
        part = taken[i : i + QUERIES]
        asked = [queries[k] for k in part]
        found = list(slice_.near(asked, slice_.start[i : i + QUERIES]))
        who, what = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        # A pair is counted at the side of its longer common end: ahead if its first halves agree.
        if back and len(who):
            half = [min(len(asked[q]), len(words[k])) // 2 for q, k in zip(who.tolist(), what.tolist())]
            apart = np.array([asked[q][-h:] != words[k][-h:] for q, k, h in zip(who.tolist(), what.tolist(), half)])
            who, what = who[apart], what[apart]
        elif len(who):
            half = [min(len(asked[q]), len(words[k])) // 2 for q, k in zip(who.tolist(), what.tolist())]
            same = np.array([asked[q][:h] == words[k][:h] for q, k, h in zip(who.tolist(), what.tolist(), half)])
            who, what = who[same], what[same]
        order = np.lexsort((rank[what], -counts[what], who))
        who, what = who[order], what[order]
        first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
        near = np.bincount(who, minlength=len(asked))
        for q, k in zip(who[first].tolist(), what[first].tolist()):
            out.append((asked[q][::-1] if back else asked[q], int(near[q]), int(counts[k]), true[k]))
    return pd.DataFrame(out, columns=["word", "near", "best", "form"])


def _common(a: str, b: str) -> str:
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:k]


def _dead(query: str, prefix: str) -> int:
    """Letters of ``prefix`` after which no continuation is within one edit of the query; 0 if
    there is one."""
    d = min(shared(len(query)), len(prefix))
    rows = tuple(np.array([v], np.int8) for v in (1, 0, 1))
    for d in range(d, len(prefix)):
        around = [np.array([ord(query[d + k]) if d + k < len(query) else -1]) for k in (-1, 0, 1)]
        rows = _step(rows, ord(prefix[d]), *around, np.array([len(query) - d]))
        if min(int(r[0]) for r in rows) > 1:
            return d + 1
    return 0


def other_slices(key: str, own: int, slices: list[tuple[str, str, int]], lows: list[str], highs: list[str]) -> list[int]:
    """Slices, besides its own, that may hold a word near ``key`` sharing its first letters."""
    p = key[: min(shared(len(key)), ENDS)]
    k, stop = bisect_left(highs, p), bisect_right(lows, p + LAST)
    found = []
    while k < stop:
        low, high, name = slices[k]
        prefix = _common(low, high)
        dead = _dead(key, prefix) if name != own and stop - k > 1 else 0
        if dead:
            k = max(k + 1, bisect_right(lows, prefix[:dead] + LAST))
            continue
        if name != own:
            found.append(name)
        k += 1
    return found


def near_words(spark: SparkSession, words: DataFrame, slice_letters: int = SLICE) -> DataFrame:
    """``word, n_near, best, form`` of each word of ``words`` (``word`` distinct, at least seven
    letters, and ``n``) that has a near word: their number, the largest ``n`` and who has it.

    One edit leaves the first or the last half of a pair alike. So the list is sorted twice, as
    written and backwards, and cut into slices of ``slice_letters`` letters; a word is looked up in its own
    slice and in the few others that its shared letters reach into, by a directory of one row a
    slice. Work in a slice follows its runs and not the pairs of its words.
    """
    both = words.select(F.lit(0).alias("way"), F.col("word").alias("key"), "n").union(words.select(F.lit(1), F.reverse("word"), "n"))
    both = both.withColumn("letters", F.length("key").cast("long"))
    placed = running_starts(both, ["way", "key"], {"letters": "before"})
    slot = F.floor(F.col("before") / slice_letters) * 2 + F.col("way")
    placed = cut_lineage(placed.select(slot.alias("slice"), "way", "key", "n"))
    ends = placed.groupBy("slice").agg(F.substring(F.min("key"), 1, ENDS).alias("low"), F.substring(F.max("key"), 1, ENDS).alias("high"))
    directory: dict[int, list] = {0: [], 1: []}
    for r in ends.collect():  # one row for each slice_letters letters of the vocabulary
        directory[r["slice"] % 2].append((r.low, r.high + LAST if len(r.high) == ENDS else r.high, r["slice"]))
    shared_out = {}
    for way, found in directory.items():
        found.sort(key=lambda s: s[2])
        shared_out[way] = (found, [s[0] for s in found], [s[1] for s in found])
    held = spark.sparkContext.broadcast(shared_out)

    def elsewhere(key: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([other_slices(k, s, *held.value[s % 2]) for k, s in zip(key, own)])

    to = F.pandas_udf(elsewhere, "array<bigint>")(F.col("key"), F.col("slice"))
    visits = placed.select(F.explode(to).alias("slice"), "way", "key", "n", F.lit(True).alias("visits"))
    rows = placed.select("*", F.lit(False).alias("visits")).union(visits)
    stats = rows.groupBy("slice").applyInPandas(lambda rows: slice_stats(rows), "word string, near long, best long, form string")
    best = F.min(F.struct((-F.col("best")).alias("less"), "form"))
    merged = stats.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", (-F.col("b.less")).alias("best"), F.col("b.form").alias("form"))


def variant_forms(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``vocab`` (``word`` distinct, ``n``).

    ``form`` is the near word of largest ``n``, ties by code point, if that is at least ``ratio``
    times the word's own; else it is null. ``root`` is where following forms ends, the word
    itself without one. Counts grow by ``ratio`` a step, so the rounds follow the logarithm
    of the largest count. An empty vocabulary gives an empty table.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    vocab = cut_lineage(vocab.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(vocab.sparkSession, vocab)
    good = F.col("best") >= ratio * F.col("n")
    forms = cut_lineage(
        vocab.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, F.col("form")).alias("form"), F.when(good, F.col("best")).alias("form_n"),
        )
    )
    steps = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # Each round replaces a root by that root's root, so a chain is halved.
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = cut_lineage(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    rooted = forms.join(steps, "word", "left")
    return rooted.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
