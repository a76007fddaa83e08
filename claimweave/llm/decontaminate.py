"""Benchmark decontamination by template windows: numbers, names and units become typed slots,
windows of the templates meet in a hash join, and the slot values must agree with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import small
from claimweave.session import cut_lineage

#: Words of a template window, and how many of them must not be slots.
WINDOW = 8
LITERALS = 5
#: An item is in a document if so large a share of its windows is there.
COVERAGE = 0.5
#: Words of a text in which windows begin that travel together for the comparison of slots.
PIECE = 256

# Slots, by characters of the private use area.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
MARKS = "\ue000" + NUMBER + NAME + UNIT  # the first stands for a separator inside a number
#: Words that are units after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons ml l liter liters "
    "litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years percent cent cents dollar dollars euro euros pound pounds usd eur mph kmh degree degrees"
).split()
# A capitalised word inside a sentence; a number with its separators; a unit after a number.
_NAME = r"(?=\p{Lu})(?<=[\p{Ll},;] )\p{Lu}\p{Ll}[\p{L}\p{M}]*"
_NUMBER = r"\p{Nd}+(?:[.,:]\p{Nd}+)*"
_UNIT = rf"(?<=\p{{Nd}}) ?(?i:({'|'.join(UNITS)}))(?![\p{{L}}\p{{M}}])"
_BETWEEN = rf"[^\p{{L}}\p{{M}}\p{{Nd}}{MARKS}]+"


def _marked_text(text: Column) -> Column:
    """The text in lower case, each slot set apart as the mark of its kind and the value."""
    t = F.translate(F.coalesce(text, F.lit("")), MARKS, " " * len(MARKS))
    t = F.regexp_replace(t, _NAME, f" {NAME}$0 ")
    t = F.regexp_replace(t, _UNIT, f" {UNIT}$1 ")
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER}$0 ")
    return F.lower(F.regexp_replace(t, r"(?<=\p{Nd})[.,:](?=\p{Nd})", MARKS[0]))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, _BETWEEN), lambda w: w != "")


def _is_slot(word: Column) -> Column:
    return F.left(word, F.lit(1)).isin(NUMBER, NAME, UNIT)


def _template(marked: Column) -> Column:
    return F.transform(marked, lambda w: F.when(_is_slot(w), F.left(w, F.lit(1))).otherwise(w))


def _exact(marked: Column) -> Column:
    return F.transform(marked, lambda w: F.translate(w, NAME, ""))


def marked_words(text: Column) -> Column:
    """Words in lower case; a slot's word is the mark of its kind and the value."""
    return _split(_marked_text(text))


def template_words(text: Column) -> Column:
    """The same words with only its kind for each slot: as many, in the same places."""
    return _template(marked_words(text))


def _hashed(words: Column) -> Column:
    """Each word hashed once; windows are hashed from these numbers."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(words: str, size: int) -> Column:
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(words), i, F.lit(size))))


def _both_windows(size: int) -> Column:
    """Template windows of the hashed words ``w``, then in the same places the exact windows of ``e``, null where
    they have no slot and are the same."""
    hashes = F.array(F.struct(_windows("w", size).alias("t"), _windows("e", size).alias("e")))

    def joined(h: Column) -> Column:  # a variable of its own, so that windows are hashed once
        exact = F.zip_with(h["t"], h["e"], lambda t, e: F.when(t != e, e))
        return F.concat(h["t"], F.coalesce(exact, F.array().cast("array<bigint>")))

    return F.transform(hashes, joined)[0]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """``h, item_id, ipos, size, n_windows, k, literal, exact``: all windows of each item; an item
    of fewer words is one window of its own size.

    ``literal`` windows have enough words that are no slots (in shorter items, two slots at least
    must be outnumbered by words) and one row for their template. A window with slots has an
    ``exact`` row for its words and values. ``k`` tells an item's windows apart, by template if
    literal, else by values; ``n_windows`` counts them all."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), marked_words(F.col("text")).alias("m"))
    items = items.select("item_id", _template(F.col("m")).alias("w"), _exact(F.col("m")).alias("e"))
    items = items.where(F.size("w") > 0).withColumn("size", F.least(F.lit(window), F.size("w")))
    rows = items.withColumn("ipos", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
    part = F.slice("w", F.col("ipos") + 1, F.col("size"))
    plain = F.size(F.filter(part, lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    enough = plain * window >= F.col("size") * literals
    whole = F.xxhash64(_hashed(F.slice("e", F.col("ipos") + 1, F.col("size"))))
    rows = cut_lineage(rows.select("item_id", "ipos", "size", enough.alias("literal"), F.xxhash64(_hashed(part)).alias("t"), whole.alias("e")))
    rows = rows.withColumn("k", F.when(F.col("literal"), F.col("t")).otherwise(F.col("e")))
    counts = rows.groupBy("item_id").agg(F.countDistinct("literal", "k").alias("n_windows"))
    by_template = rows.where("literal").withColumn("h", F.col("t")).withColumn("exact", F.lit(False))
    by_words = rows.where("not literal or t <> e").withColumn("h", F.col("e")).withColumn("exact", F.lit(True))
    columns = ["h", "item_id", "ipos", "size", "k", "literal", "exact"]
    return by_template.select(*columns).union(by_words.select(*columns)).join(counts, "item_id")


def hit_pieces(docs: DataFrame, hits: DataFrame, window: int = WINDOW) -> DataFrame:
    """``d, p, dw``: the marked words from place ``p * PIECE`` on, for windows of ``hits(doc_id, dpos)`` that begin
    in that piece of a text. Only pieces with a hit travel, each a row of bounded size, however long its text."""
    pieces = hits.select("doc_id", F.floor(F.col("dpos") / PIECE).cast("int").alias("piece")).distinct()
    ids = cut_lineage(pieces.groupBy("doc_id").agg(F.collect_set("piece").alias("pieces")))
    found = docs.select(F.col("doc_id").cast("long").alias("d"), "text").join(small(ids), F.col("d").eqNullSafe(F.col("doc_id")))
    said = found.select("d", F.explode("pieces").alias("p"), marked_words(F.col("text")).alias("dw"))
    return said.select("d", "p", F.slice("dw", F.col("p") * PIECE + 1, F.lit(PIECE + window - 1)).alias("dw")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, windows, item_windows, changed``: items that documents contain.

    An item is in a document if at least ``coverage`` of its distinct windows are there, counted
    over places where document and item run in parallel and the slots agree: one value of the
    item always stands for one value of the document. Elsewhere only windows with the item's own
    values count, in any capitals. Windows of nearly nothing but slots are found by their values,
    and by their kinds where another window of the item is in its place beside them. ``changed``
    says that some slot has another value than in the item.

    Null and empty texts and items contain nothing; null item ids are left out; repeated rows
    and rows with one id count as one document, null ids as one too. Extra columns are not read.
    """
    grams = cut_lineage(benchmark_windows(benchmark, window, literals))
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # 1 to `window`
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _marked_text(F.col("text")).alias("m"))
    rows = rows.select("doc_id", _split(F.col("m")).alias("m"), F.col("m").rlike(f"[{NUMBER}{NAME}{UNIT}]").alias("slotted"))
    exact = F.when(F.col("slotted"), _exact(F.col("m")))  # without slots, template and words are the same
    template = F.when(F.col("slotted"), _template(F.col("m"))).otherwise(F.col("m"))
    rows = rows.select("doc_id", _hashed(template).alias("w"), _hashed(exact).alias("e"))
    columns = ["doc_id", "item_id", "ipos", "dpos", "size", "n_windows", "k", "literal", "exact"]
    spark = docs.sparkSession
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, windows long, item_windows long, changed boolean")
    if len(sizes) == 1:
        grams_of = rows.select("doc_id", F.lit(sizes[0]).alias("size"), F.size("w").alias("n"), F.posexplode(_both_windows(sizes[0])).alias("at", "h"))
    else:
        lists = F.array(*[F.struct(F.lit(s).alias("size"), _both_windows(s).alias("hs")) for s in sizes])
        per_size = rows.select("doc_id", F.size("w").alias("n"), F.explode(lists).alias("l"))
        grams_of = per_size.select("doc_id", "n", F.col("l.size").alias("size"), F.posexplode("l.hs").alias("at", "h"))
    grams_of = grams_of.where("h is not null").select("doc_id", "size", "h", F.expr("at % (n - size + 1)").alias("dpos"))
    hits = cut_lineage(grams_of.join(small(grams), ["h", "size"]).select(*columns))
    # Beside what is there, windows of too many slots are compared by their kinds as well.
    slots_only = cut_lineage(grams.where("not literal").drop("h"))
    beside = hits.join(small(cut_lineage(slots_only.select("item_id").distinct())), "item_id", "left_semi")
    beside = beside.select("doc_id", "item_id", (F.col("dpos") - F.col("ipos")).alias("shift")).distinct()
    beside = beside.join(small(slots_only), "item_id").withColumn("dpos", F.col("shift") + F.col("ipos")).withColumn("exact", F.lit(False))
    hits = cut_lineage(hits.union(beside.where("dpos >= 0").select(*columns)))
    # Rows that share an id: slots are compared in the text that has the window.
    said = hit_pieces(docs, hits, window)
    piece = F.floor(F.col("dpos") / PIECE).cast("int")
    item = benchmark.select(F.col("item_id").cast("long").alias("i"), marked_words(F.col("text")).alias("iw"))
    both = hits.join(said, F.col("doc_id").eqNullSafe(F.col("d")) & (piece == F.col("p"))).join(item, F.col("item_id") == F.col("i"))
    cut = lambda c, at: F.slice(c, at + 1, F.col("size"))
    both = both.select("doc_id", "item_id", "ipos", (F.col("dpos") - F.col("ipos")).alias("shift"), "n_windows", "k", "literal", "exact", cut("dw", F.col("dpos") % PIECE).alias("dv"), cut("iw", F.col("ipos")).alias("iv"))
    both = both.withColumns({"dt": _template(F.col("dv")), "it": _template(F.col("iv"))})
    both = both.withColumn("same", _exact(F.col("iv")) == _exact(F.col("dv")))
    # What is found by its template is not counted a second time by its words.
    both = both.where("(dt = it and not exact) or (same and not (dt = it and literal and exact))")
    pairs = F.filter(F.arrays_zip("iv", "dv"), lambda p: _is_slot(p.iv))
    pairs = F.transform(pairs, lambda p: F.struct(p.iv.alias("iv"), F.translate(p.dv, NAME, "").alias("dv")))
    place = ["doc_id", "item_id", "shift"]
    matches = cut_lineage(both.select(*place, "ipos", "n_windows", "literal", "k", pairs.alias("slots"), "same"))
    slots = matches.select(*place, F.explode("slots").alias("s")).groupBy(*place, "s.iv").agg((F.min("s.dv") != F.max("s.dv")).alias("bad"))
    broken = slots.groupBy(*place).agg(F.max("bad").alias("broken")).where("broken")
    broken = broken.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"), F.col("shift").alias("sh"), "broken")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("item_id") == F.col("i")) & (F.col("shift") == F.col("sh"))
    kept = matches.join(broken, on, "left").where("broken is null or same")
    per = kept.groupBy("doc_id", "item_id").agg(F.countDistinct("literal", "k").alias("windows"), F.max("n_windows").alias("item_windows"), F.max(~F.col("same")).alias("changed"))
    return per.where(F.col("windows") >= F.lit(coverage) * F.col("item_windows"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns. Each row is judged by its own
    text, so of rows that share an id, or have none, those that contain an item go."""
    row = F.xxhash64(F.col("doc_id").cast("string"), "text")
    ids = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("_contaminated"))
    return docs.join(small(cut_lineage(ids.distinct())), row == F.col("_contaminated"), "left_anti")
