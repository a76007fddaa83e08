"""Repair of conversation structure at least cost by an auction shortest-path algorithm.

A conversation is a lattice of nodes (row, what the repaired turns so far end with); arcs are edits.
Node prices are raised while one path is extended and contracted; when it reaches the end, the
prices are dual to the path lengths, so arcs that are tight under them and lead to the end are
exactly those of cheapest repairs, among which the first in ASCII order is followed.

Long conversations are cut into segments. A segment's table of costs from state to state takes no
notice of the rest, so segments are many tasks; tables are joined by doubling, not in a row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import running_starts
from claimweave.session import cut_lineage

#: Conversations of at most this many rows are one segment; longer ones are cut at SEGMENT rows.
WHOLE = 256
SEGMENT = 128
#: Rows of short conversations that a task takes at once.
PACK = 1024
#: A cost that no repair reaches.
NEVER = 1 << 40
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cost of each edit; REROLE and KEEP of a truncated row cost TRUNCATED more.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: Kinds of rows.
SOUND, CUT, MUST_GO = range(3)

MARKS = "[.!?]"
SEEN = r"[^\x20\x09-\x0D]"


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` modulo 20 names:
    0 drops the row, 1 empties its text, 2 removes its end marks, 3 repeats it, 4 makes it a user's.
    Nulls of role and text become one space, and in the hashed key too."""
    space = F.lit(" ")
    t = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    t = t.withColumn("d", F.crc32(key) % 20).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", MARKS, "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faulty(turns: DataFrame) -> DataFrame:
    """The rows in order with ``pos`` (over all conversations), ``first`` and ``rows`` of their
    conversation, ``initial`` of the role and ``fault``: blank, duplicate, truncated or null.

    ``turns``: ``conv_id, turn, role, text``. Null turns come first, equal turns follow role and text,
    null roles and texts are empty, rows without ``conv_id`` are one conversation, other columns are not read.
    """
    t = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("one")
    ).withColumn("known", F.col("turn").isNotNull())
    t = running_starts(t, ["conv_id", "known", "turn", "role", "text"], {"one": "pos"})
    spans = t.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("rows"))
    t = t.join(spans.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c", "one", "known")
    # A row is the first of its role and text if its position is the least one of them; that
    # is looked up by position, which is unique, and not by the text, which may be a third of all rows.
    same = F.sha2(F.concat_ws("\x1f", F.col("first").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    t = cut_lineage(t.withColumn("same", same))
    leads = t.groupBy("same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("leads"))
    marked = t.join(leads, "pos", "left")
    end = F.regexp_extract("text", rf"({SEEN})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(SEEN), "blank").when(F.col("leads").isNull(), "duplicate").when(~end.rlike(MARKS), "truncated")
    return marked.select("conv_id", "turn", "pos", "first", "rows", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


# One lattice.


def arcs_of(state: int, initial: str, kind: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in a state: letter, cost and the state after it."""
    yield "D", DELETE, state
    if kind != MUST_GO:
        extra = TRUNCATED if kind == CUT else 0
        role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
        if role == NEXT[state] or (role == SYSTEM and state == NONE):
            yield "K", KEEP + extra, role
        yield "R", REROLE + extra, NEXT[state]


class Lattice:
    """Nodes ``4 * row + state`` and one last node; arcs ``(to, cost, letter)`` that can lead to it.

    ``exits``: cost from each state behind the last row to the end; ``closing``: whether turns
    may be inserted there, as nothing follows.
    """

    def __init__(self, rows: list[tuple[str, int]], exits: list[int], closing: bool):
        n = len(rows)
        self.end, self.rows = 4 * n + 4, rows
        self.arcs: list[list[tuple[int, int, str]]] = [[] for _ in range(self.end)]
        # Prices never above a node's distance: what each row costs at least, and the nearest exit.
        self.price = [0] * (self.end + 1)
        floor, leads = min(exits), [False] * self.end + [True]
        for i in range(n, -1, -1):
            if i < n:
                floor += 2 if rows[i][1] else 0
            for s in range(4):
                found = [(self.end, exits[s], "")] if i == n and exits[s] < NEVER else []
                if i < n:
                    found = [(4 * i + 4 + to, cost, letter) for letter, cost, to in arcs_of(s, *rows[i])]
                self.arcs[4 * i + s] = [a for a in found if leads[a[0]]]
                leads[4 * i + s] = bool(self.arcs[4 * i + s])
                self.price[4 * i + s] = floor
            if i < n or closing:
                # Insertions stay at the row, so their ends are known only now; two suffice.
                for _ in range(2):
                    for s in range(4):
                        arc = (4 * i + NEXT[s], INSERT, "I")
                        if leads[arc[0]] and arc not in self.arcs[4 * i + s]:
                            self.arcs[4 * i + s].append(arc)
                            leads[4 * i + s] = True

    def cost_from(self, origin: int) -> int:
        """The auction: length of the shortest path from ``origin`` to the end. Prices stay valid
        for the next origin."""
        if not self.arcs[origin]:
            return NEVER
        price, path = self.price, [origin]
        while path[-1] != self.end:
            node = path[-1]
            best, to = min((cost + price[to], to) for to, cost, _ in self.arcs[node])
            if price[node] < best:
                price[node] = best
                if node != origin:
                    path.pop()
            else:
                path.append(to)
        return price[origin]

    def edits_from(self, state: int) -> list[tuple[int, str, int]]:
        """``row, letter, state after it`` of the cheapest repair whose letters come first in ASCII order.

        Tight arcs form no cycle, as insertions cost; only those that lead to the end count.
        A letter leads from a state to one state only, so the smallest letter decides each step.
        """
        self.cost_from(state)
        price = self.price
        tight = [[a for a in self.arcs[v] if price[v] == a[1] + price[a[0]]] for v in range(self.end)]
        leads = [False] * self.end + [True]
        for i in range(len(self.rows), -1, -1):
            for _ in range(3):
                for v in range(4 * i, 4 * i + 4):
                    leads[v] = any(leads[a[0]] for a in tight[v])
        node, edits = state, []
        while node != self.end:
            to, _, letter = min((a for a in tight[node] if leads[a[0]]), key=lambda a: a[2])
            if letter:
                edits.append((node // 4, letter, to % 4))
            node = to
        return edits


FINAL = [0, NEVER, NEVER, 0]


def costs_between(rows: list[tuple[str, int]], closing: bool) -> list[int]:
    """Cost from each state before the rows (4) to each behind them (4), row by row."""
    table = [NEVER] * 16
    for e in range(4):
        lattice = Lattice(rows, [0 if s == e else NEVER for s in range(4)], closing)
        for s in range(4):
            table[4 * s + e] = lattice.cost_from(s)
    return table


KINDS = {"blank": MUST_GO, "duplicate": MUST_GO, "truncated": CUT, None: SOUND}


def _segments(rows: pd.DataFrame) -> Iterator[tuple[int, int, bool, int, int, list[tuple[str, int]]]]:
    """The segments of a chunk, whose rows are sorted in place: ``first`` and number of each, whether it ends
    its conversation, where its rows begin and end, and their initials and kinds."""
    rows.sort_values("pos", inplace=True, ignore_index=True)
    firsts, segs, poses, sizes = (rows[c].tolist() for c in ("first", "seg", "pos", "rows"))
    kinds = list(zip(rows["initial"].tolist(), map(KINDS.get, rows["fault"].where(rows["fault"].notna(), None).tolist())))
    begin = 0
    for end in range(1, len(firsts) + 1):
        if end == len(firsts) or firsts[end] != firsts[begin] or segs[end] != segs[begin]:
            yield firsts[begin], segs[begin], poses[end - 1] + 1 == firsts[begin] + sizes[begin], begin, end, kinds[begin:end]
            begin = end


def _tables(rows: pd.DataFrame) -> pd.DataFrame:
    out = [(first, seg, costs_between(kinds, closing)) for first, seg, closing, _, _, kinds in _segments(rows)]
    return pd.DataFrame(out, columns=["first", "seg", "m"])


def _passages(rows: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """The state behind each segment for each state before it, on the path that is followed."""
    exits = {(f, s): list(v) for f, s, v in zip(bounds["first"], bounds["seg"], bounds["exits"])}
    out = []
    for first, seg, closing, _, _, kinds in _segments(rows):
        lattice, to = Lattice(kinds, exits[first, seg], closing), []
        for s in range(4):
            edits = lattice.edits_from(s) if lattice.arcs[s] else []
            to.append(edits[-1][2] if edits else s)
        out.append((first, seg, to))
    return pd.DataFrame(out, columns=["first", "seg", "m"])


EDITS = "conv_id string, first long, pos long, step int, edit string, cost int, role string, text string"


def _repaired(rows: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """Edits of a chunk: conversations that are whole, or segments with their bounds."""
    known = {(f, s): (list(v), int(e)) for f, s, v, e in zip(bounds["first"], bounds["seg"], bounds["exits"], bounds["entry"])}
    segments = list(_segments(rows))
    ids, poses, roles, texts = (rows[c].tolist() for c in ("conv_id", "pos", "role", "text"))
    out = []
    for first, seg, closing, begin, end, kinds in segments:
        exits, entry = known.get((first, seg), (FINAL, NONE))
        for step, (i, letter, state) in enumerate(Lattice(kinds, exits, closing).edits_from(entry)):
            # Turns inserted behind the last row stand at that row, after it.
            at = min(begin + i, end - 1)
            if letter == "I":
                made = INSERT, ROLE[state], ""
            elif letter == "D":
                made = DELETE, None, None
            else:
                cost = TRUNCATED if kinds[i][1] == CUT else 0
                made = (cost + REROLE, ROLE[state], texts[at]) if letter == "R" else (cost + KEEP, roles[at], texts[at])
            out.append((ids[at], first, poses[at], step, letter, *made))
    return pd.DataFrame(out, columns=["conv_id", "first", "pos", "step", "edit", "cost", "role", "text"])


# Segments of long conversations.


def _doubled(parts: DataFrame, join, ahead: bool) -> DataFrame:
    """Each segment's table joined with those of all segments behind it (``ahead``) or before it.

    Round r joins tables of 2^r segments, so the rounds follow the logarithm of the longest conversation.
    """
    longest, step = parts.agg(F.max("seg")).first()[0], 1
    while step <= longest:
        shift = -step if ahead else step
        other = parts.select("first", (F.col("seg") + shift).alias("seg"), F.col("m").alias("m2"))
        m = F.when(F.col("m2").isNull(), F.col("m")).otherwise(join("m", "m2"))
        parts = cut_lineage(parts.join(other, ["first", "seg"], "left").select("first", "seg", m.alias("m")))
        step *= 2
    return parts


def _add(a: str, b: str) -> Column:
    """The least cost over the state between two tables, the segment of ``a`` before that of ``b``."""
    cell = f"array_min(transform(sequence(0, 3), j -> {a}[int(k div 4) * 4 + j] + {b}[j * 4 + k % 4]))"
    return F.expr(f"transform(sequence(0, 15), k -> least({NEVER}L, {cell}))")


def _follow(a: str, b: str) -> Column:
    """``b``, then ``a``: the passage of an earlier run of segments goes first."""
    return F.expr(f"transform({b}, s -> {a}[s])")


def _long_bounds(rows: DataFrame) -> DataFrame:
    """``first, seg, chunk, exits, entry`` of the segments of long conversations: the cost behind each
    and the state before it."""
    tables = cut_lineage(rows.groupBy("chunk").applyInPandas(lambda rows: _tables(rows), "first long, seg long, m array<long>"))
    ahead = _doubled(tables, _add, ahead=True)
    to_end = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.least(F.get("m", s * 4), F.get("m", s * 4 + 3)))
    behind = ahead.select("first", (F.col("seg") - 1).alias("seg"), to_end.alias("exits"))
    final = F.array(*[F.lit(v).cast("long") for v in FINAL])
    chunks = rows.select("first", "seg", "chunk").distinct()
    bounds = cut_lineage(chunks.join(behind, ["first", "seg"], "left").withColumn("exits", F.coalesce("exits", final)))
    passages = rows.groupBy("chunk").cogroup(bounds.groupBy("chunk")).applyInPandas(
        lambda rows, bounds: _passages(rows, bounds), "first long, seg long, m array<int>"
    )
    through = _doubled(cut_lineage(passages), _follow, ahead=False)
    entries = through.select("first", (F.col("seg") + 1).alias("seg"), F.get("m", F.lit(NONE)).alias("entry"))
    return cut_lineage(bounds.join(entries, ["first", "seg"], "left").withColumn("entry", F.coalesce("entry", F.lit(NONE))))


def repaired_turns(faults: DataFrame, whole: int = WHOLE, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, first, pos, step, edit, cost, role, text``: the cheapest repair of each conversation of
    :func:`faulty`, edit by edit in the order of ``pos, step``; of several the one whose initials (K keep,
    R rerole, D delete, I insert) come first. Deleted rows have null role and text, so the repaired
    conversation is the rest. Conversations of more than ``whole`` rows are cut every ``segment`` rows,
    with the same result."""
    long_ = F.col("rows") > whole
    # Short conversations are packed by where they begin, segments of long ones stand alone.
    seg = F.when(long_, F.floor((F.col("pos") - F.col("first")) / segment)).otherwise(0).cast("long")
    chunk = F.when(long_, 2 * (F.col("first") + F.col("seg") * segment) + 1).otherwise(2 * F.floor(F.col("first") / PACK))
    rows = faults.drop("turn").withColumns({"seg": seg, "conv_id": F.col("conv_id").cast("string")})
    rows = cut_lineage(rows.withColumn("chunk", chunk))
    narrow = rows.where(long_).drop("text", "role")
    if narrow.isEmpty():
        bounds = faults.sparkSession.createDataFrame([], "first long, seg long, chunk long, exits array<long>, entry int")
    else:
        bounds = _long_bounds(narrow)
    edits = rows.groupBy("chunk").cogroup(bounds.groupBy("chunk")).applyInPandas(lambda rows, bounds: _repaired(rows, bounds), EDITS)
    return edits.withColumn("conv_id", F.col("conv_id").cast(faults.schema["conv_id"].dataType))


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit, cost and digest of conversations that come one after the other, in order."""
    names = ["first", "audit", "cost", "repaired_sha256"]
    first, audit, cost, sha, turns = None, [], 0, hashlib.sha256(), 0
    for batch in batches:
        done = []
        for f, edit, c, role, text in zip(*(batch[k].tolist() for k in ("first", "edit", "cost", "role", "text"))):
            if f != first:
                if first is not None:
                    done.append((first, "".join(audit), cost, sha.hexdigest()))
                first, audit, cost, sha, turns = f, [], 0, hashlib.sha256(), 0
            audit.append(edit)
            cost += c
            if edit != "D":
                sha.update(f"{chr(10) if turns else ''}{role}:{text}".encode())
                turns += 1
        if done:
            yield pd.DataFrame(done, columns=names)
    if first is not None:
        yield pd.DataFrame([(first, "".join(audit), cost, sha.hexdigest())], columns=names)


def conversation_repairs(original: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``original``: what is wrong with its rows in ``turns`` and the cheapest repair.

    ``gaps`` (turn numbers missing between the least and the largest), ``blank, duplicate, truncated`` (rows by first
    fault), ``illegal`` (neighbours whose initials are not su, ua or au), ``cost``, ``audit`` and ``repaired_sha256``
    of the repaired ``role:text`` lines. A conversation without rows has zeros, an empty audit and the hash of nothing.

    The digest runs over a conversation's text row by row, so one task holds no more than a batch of it.
    """
    faults = cut_lineage(faulty(turns))
    ahead = faults.select((F.col("pos") - 1).alias("pos"), F.col("first").alias("f2"), F.col("initial").alias("then"))
    pair = F.concat("initial", "then")
    pairs = faults.select("pos", "first", "initial").join(ahead, "pos").where("first = f2").withColumn("pair", pair)
    illegal = pairs.where(~F.col("pair").isin("su", "ua", "au")).groupBy("first").agg(F.count(F.lit(1)).alias("illegal"))
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    kinds = [F.count_if(F.coalesce(F.col("fault") == k, F.lit(False))).alias(k) for k in ("blank", "duplicate", "truncated")]
    counts = faults.groupBy("first").agg(F.first("conv_id").alias("c"), F.coalesce(missing, F.lit(0)).alias("gaps"), *kinds)
    edits = repaired_turns(faults).drop("conv_id")
    ordered = edits.repartition("first").sortWithinPartitions("first", "pos", "step")
    digests = ordered.mapInPandas(_digested, "first long, audit string, cost long, repaired_sha256 string")
    found = counts.join(illegal, "first", "left").join(digests, "first", "left")
    ids = original.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = {k: F.coalesce(k, F.lit(0)).cast("long") for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.withColumns(zero).select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
