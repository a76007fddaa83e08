"""Chat formatting into budgeted windows: turn-aligned spans by prefix sums, the system turn kept
in each, a limited history repeated, and no target under the loss mask twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import running_starts, word_count
from claimweave.session import cut_lineage

START, STOP = "<|im_start|>", "<|im_end|>"
#: Words of new turns in a window, and words of earlier turns repeated before them.
SPAN = 512
HISTORY = 128
#: A task packs turns of about so many spans, and no more turns than words, into windows.
STRETCH = 64


def escape(text: Column) -> Column:
    """Doubles backslashes and breaks up ``<|``, so that no control string is left; reversible."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`, and without line breaks, which end the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def format_windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, text, repeated, targets``: formatted windows of every conversation.

    ``turns``: ``conv_id, turn, role, text``; null roles and texts are empty, turns with equal
    numbers follow role and text, null turn numbers come last, null ids are one conversation,
    repeated rows are turns of their own, other columns are not read. A turn is formatted as
    ``<|im_start|>role\\n`` text ``<|im_end|>\\n`` with both parts escaped.

    Prefix sums say how many words stand before a turn; from the first turn of a window the jump
    goes to the first that ends more than ``span`` words later, which opens the next. So the new
    turns of a window have at most ``span`` words and no turn is cut; one that is longer than
    ``span`` has a window of its own. Every ``STRETCH`` spans a window is opened as well, so that
    stretches of a conversation are packed apart. ``window`` is the position of its
    first turn. Before the new turns stand the last turns that fit into ``history`` words, and a system turn that opens the conversation.
    ``repeated`` counts these; they are not targets again. ``targets`` holds first character (from 1)
    and length of the escaped text of each new assistant turn.
    """
    if history > span:
        raise ValueError("history must not exceed the span")
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    t = t.withColumns({"words": word_count(F.col("text")), "one": F.lit(1).cast("long")})
    # Sums over slices of all turns, so that a conversation of any length is many tasks.
    t = running_starts(t, ["conv_id", "turn", "role", "text"], {"words": "begin", "one": "pos"})
    opens = t.groupBy("conv_id").agg(F.min("begin").alias("b0"), F.min("pos").alias("p0"))
    t = t.join(opens.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    t = t.withColumns({"begin": F.col("begin") - F.col("b0"), "pos": F.col("pos") - F.col("p0")})
    t = t.withColumns({"end": F.col("begin") + F.col("words"), "stretch": F.floor((F.col("begin") + F.col("pos")) / (span * STRETCH))})
    t = cut_lineage(t.select("conv_id", "stretch", "pos", "begin", "end", F.struct("pos", "role", "text").alias("body")))
    opens = window_starts(t, span)
    t = t.join(opens, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")))
    window = F.array_max(F.filter("starts", lambda p: p <= F.col("pos")))
    t = cut_lineage(t.select("conv_id", "begin", "end", window.alias("window"), "body"))
    starts = t.groupBy("conv_id", "window").agg(F.min("begin").alias("first"))
    starts = starts.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), "first", F.floor(F.col("first") / span).alias("at"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    new = t.select("conv_id", "window", "body", F.lit(True).alias("new"))
    # History: the window starts at the end of the turn or later, at most `history` words after its
    # begin; these are at most two whole numbers of spans, so the join has equal keys.
    low, high = F.floor(F.col("end") / span), F.floor((F.col("begin") + history) / span)
    near = t.where(low <= high).withColumn("to", F.explode(F.sequence(low, high)))
    again = near.join(starts, same & (F.col("to") == F.col("at"))).where(f"w > window and end <= first and begin + {history} >= first")
    system = t.where("body.pos = 0 and body.role = 'system'").join(starts, same).where("w > window")
    repeats = again.select("conv_id", "w", "body").union(system.select("conv_id", "w", "body")).distinct()
    rows = new.union(repeats.withColumn("new", F.lit(False))).select("conv_id", "window", "new", "body.*")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumns({"head": F.length(head), "inner": F.length(escape(F.col("text")))})
    rows = rows.withColumn("piece", F.concat(head, escape(F.col("text")), F.lit(STOP + "\n")))
    earlier = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0)) + F.col("head") + 1
    masked = F.col("new") & (F.col("role") == "assistant")
    target = F.when(masked, F.struct(F.col("at").cast("int").alias("at"), F.col("inner").alias("len")))
    pieces = F.array_sort(F.collect_list(F.struct("pos", "piece", "target")))
    shown = rows.withColumn("at", at).withColumn("target", target).groupBy("conv_id", "window").agg(
        pieces.alias("p"), F.count_if(~F.col("new")).cast("int").alias("repeated")
    )
    targets = F.filter(F.transform("p", lambda s: s.target), lambda x: x.isNotNull())
    text = F.array_join(F.transform("p", lambda s: s.piece), "")
    return shown.select("conv_id", "window", text.alias("text"), "repeated", targets.alias("targets"))


def window_starts(turns: DataFrame, span: int) -> DataFrame:
    """``c, s, starts``: positions of the turns that open a window, of each stretch ``s`` of a conversation ``c``.

    A stretch has at most ``span * STRETCH`` turns, of which this sees three numbers each."""
    sums = F.array_sort(F.collect_list(F.struct("pos", "begin", "end")))
    none = F.struct(F.lit(None).cast("long").alias("first"), F.array().cast("array<long>").alias("starts"))

    def jump(at: Column, turn: Column) -> Column:
        opened = F.struct(turn.begin.alias("first"), F.concat(at.starts, F.array(turn.pos)).alias("starts"))
        return F.when(at.first.isNull() | (turn.end - at.first > span), opened).otherwise(at)

    packed = turns.groupBy(F.col("conv_id").alias("c"), F.col("stretch").alias("s")).agg(sums.alias("sums"))
    return packed.select("c", "s", F.aggregate("sums", none, jump, lambda at: at.starts).alias("starts"))


def read_windows(formatted: DataFrame) -> DataFrame:
    """Parses formatted windows: ``conv_id, window, turns, targets, chars``, where ``turns`` are the new turns'
    ``role, text`` and ``targets`` the texts under the mask, both unescaped and in order."""
    pieces = F.slice(F.split("text", r"<\|im_start\|>"), 2, F.greatest(F.lit(1), F.length("text")))
    fresh = F.filter(pieces, lambda s, i: i >= F.col("repeated"))

    def parsed(piece: Column) -> Column:
        cells = F.split(F.substr(piece, F.lit(1), F.length(piece) - len(STOP + "\n")), "\n", 2)
        return F.struct(unescape_role(cells[0]).alias("role"), unescape(cells[1]).alias("text"))

    under = F.transform("targets", lambda s: unescape(F.substr(F.col("text"), s.at, s.len)))
    return formatted.select(
        "conv_id", "window", F.transform(fresh, parsed).alias("turns"), under.alias("targets"), F.length("text").cast("long").alias("chars")
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: number and digest of all turns, characters
    and digest of the texts under the loss mask, characters of all windows.

    A digest needs the conversation's whole text in one value; that is all that is gathered.
    """
    read = read_windows(formatted)
    said = F.array_join(F.transform("turns", lambda s: F.concat(s.role, F.lit("\n"), s.text, F.lit("\n"))), "")
    per = read.select("conv_id", "window", F.size("turns").cast("long").alias("n"), said.alias("said"), F.array_join("targets", "").alias("loss"), "chars")
    whole = per.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    said = F.array_join(F.transform("w", lambda s: s.said), "")
    loss = F.array_join(F.transform("w", lambda s: s.loss), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
