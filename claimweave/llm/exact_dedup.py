"""Exact duplicates by two-pass Bloom filtering: the first pass counts the cells of a Bloom filter,
the second sends only rows whose cells were all hit more than once to a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
#: Cells of one filter block: the fixed width of Spark's bitmap functions (4 KB).
BLOCK = 32_768
#: Cells of the filter for each row; two of them are set, so about 1.4 % of single rows pass.
CELLS_PER_ROW = 16
#: A filter of more bytes is not broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Groups with the most rows, a fixed number, whose rows are not shuffled by group.
LARGEST = 10_000


def digest(text: Column) -> Column:
    """SHA-256, 32 bytes, of the text with each run of white space as one space; null as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def _cells(rows: DataFrame, blocks: int) -> DataFrame:
    """Adds the filter block of each row and its two cells in the block."""
    h = F.xxhash64("sha")
    first, second = F.pmod(F.shiftright(h, 15), F.lit(BLOCK)), F.pmod(h, F.lit(BLOCK))
    return rows.withColumns({"block": F.pmod(F.xxhash64(F.lit(1), "sha"), F.lit(blocks)), "first": first, "second": second})


def repeated_cells(rows: DataFrame, blocks: int) -> DataFrame:
    """First pass: ``block, bits``, a bitmap of the cells that more than one row hits.

    Cells are counted with a partial aggregate, so a hash with a third of all rows sends one
    number per task; texts and ids stay where they are.
    """
    hit = _cells(rows.select("sha"), blocks).select("block", F.explode(F.array_distinct(F.array("first", "second"))).alias("cell"))
    twice = hit.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("cell")).alias("bits"))


def _is_set(cell: str) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col(cell) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (F.col(cell) % 8).cast("int")) == 1


def mark_copies(rows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, cells_per_row: int = CELLS_PER_ROW) -> DataFrame:
    """``rows`` (``doc_id, sha`` and one more column at most, ``doc``) with ``keep_id, group_size, kept``.

    Second pass: a row of which one cell is not in the bitmap has no equal and passes straight
    through. The others, true repeats and a few per cent of strays, are written, counted by
    digest and given their group's numbers; an exact count decides, so strays cost time only.
    The filter has ``cells_per_row`` bits a row and is broadcast up to ``broadcast_bytes``;
    beyond that it is joined by block, which moves the rows of this table but gives the same.
    """
    blocks = max(1, -(-rows.count() * cells_per_row // BLOCK))
    bits = cut_lineage(repeated_cells(rows, blocks))
    if blocks * BLOCK // 8 <= broadcast_bytes:
        bits = F.broadcast(bits)
    tested = _cells(rows, blocks).join(bits, "block", "left")
    again = F.coalesce(_is_set("first") & _is_set("second"), F.lit(False))
    tested = tested.withColumn("again", again).select(*rows.columns, "again")
    single = tested.where(~F.col("again")).withColumns(
        {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    )
    flagged = cut_lineage(tested.where("again").withColumn("at", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("least")
    groups = cut_lineage(flagged.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), least))
    # Rows of the largest groups stay where they are; of any other group, at most one row in
    # LARGEST of the table meets in a task.
    largest = F.broadcast(groups.orderBy(F.desc("group_size"), "sha").limit(LARGEST))
    near = flagged.join(largest, "sha")
    keys = F.broadcast(groups.orderBy(F.desc("group_size"), "sha").limit(LARGEST).select("sha"))
    rest = flagged.join(keys, "sha", "left_anti").join(groups.join(keys, "sha", "left_anti"), "sha")
    joined = near.unionByName(rest).withColumns({"keep_id": F.col("least.doc_id"), "kept": F.col("at") == F.col("least.at")})
    out = [*rows.columns, "keep_id", "group_size", "kept"]
    return single.select(out).union(joined.select(out))


def copy_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Of the rows with equal text (runs of white space as one space, none cut at the ends) the one
    with the smallest ``doc_id`` is kept, null ids last; of rows that repeat text and id one is kept.
    Null texts are empty and equal each other. Only ``doc_id`` and ``text`` are read.
    """
    # Texts are read once; what is written and tested twice is the id and 32 bytes.
    rows = cut_lineage(docs.select("doc_id", digest(F.col("text")).alias("sha")))
    return mark_copies(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`copy_groups` keeps, with all their columns. Rows without a
    possible copy are not shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    marked = mark_copies(docs.select("doc_id", digest(F.col("text")).alias("sha"), row))
    return marked.where("kept").select(*[F.col(f"doc.`{c}`") for c in docs.columns])
