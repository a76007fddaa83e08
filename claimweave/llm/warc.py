"""WARC archives: written as plain WARC/1.1 files, read back in splits with a verified chain.

Reading does not trust the magic line: a payload may hold it too. Tasks cut their split at each
magic and emit every place as a candidate with the offset of its successor, as its
Content-Length says. Within a split chains are followed to the first offset beyond it; pointer
jumping over the splits then starts at the beginning of the file and keeps only the candidates
that the chain reaches.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import small
from claimweave.session import cut_lineage

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Equal payloads of fewer bytes are not deduplicated.
LEAST_BYTES = 100
#: Archives are closed after so many records.
FILE_RECORDS = 50_000
DATE = "2024-01-01T00:00:00Z"
CHUNKS = (
    "file string, split long, seq long, at long, size long, succ long, page_id long, type string, refers_to long, "
    "bytes long, digest string, whole boolean"
)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_records: int = FILE_RECORDS) -> None:
    """One record per row: ``response`` with the html as payload, or ``revisit`` without one.

    Of equal payloads of at least ``least_bytes`` bytes the rows with the smallest ``page_id``
    are responses, the others revisits that refer to it; null ids are larger than any (if
    all are null, all are responses). Null html is an empty payload, a null url an empty
    one, line breaks in urls are percent-encoded. An empty table writes an empty archive.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("n"), F.unhex(F.sha2(html, 256)).alias("digest"),
    )
    equal = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # Only digests that occur twice; the payloads move only if these are too many to broadcast.
    equal = cut_lineage(equal.where("copies > 1 and first is not null").select("digest", "first"))
    rows = rows.join(small(equal), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.lower(F.hex("digest")),
        F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string")),
        F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    # A line end of two line breaks after each record is what WARC asks for.
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def _field(head: str, name: str) -> str | None:
    found = re.search(rf"(?:^|\r\n){name}: *([^\r\n]*)", head)
    return found and found[1]


def _number(value: str | None) -> int | None:
    found = re.fullmatch(r"(?:<urn:page:)?(-?\d{1,19})>?", value or "")
    return found and int(found[1])


def _parse(chunk: str) -> dict | None:
    """What stands after a magic line: header fields, and the digest of the payload if all of it
    is here; nothing if it can't be a header."""
    head, end, rest = chunk.partition(END)
    length = _number(_field(head, "Content-Length"))
    if not end or length is None or length < 0:
        return None
    kind = _field(head, "WARC-Type")
    start = len(head.encode()) + len(END)
    block = rest.encode()
    revisit = kind == "revisit"
    whole = revisit or len(block) >= length
    return {
        "length": start + length + len(END), "type": kind, "page_id": _number(_field(head, "WARC-Record-ID")),
        "refers_to": _number(_field(head, "WARC-Refers-To")), "whole": whole,
        "bytes": _number(_field(head, "X-Payload-Length")) if revisit else length,
        "digest": (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha256:") if revisit else hashlib.sha256(block[:length]).hexdigest() if whole else None,
    }


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _scan(batches):
    """One row per chunk between magic lines; ``at`` is its offset after the first byte that its
    split reads, ``succ`` that of the record after it, null if it is no candidate."""
    import pyarrow as pa

    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    now, seq, at = None, 0, 0
    for batch in batches:
        rows = []
        for value, file, split in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (file, split) != now:
                now, seq, at = (file, split), 0, 0
            value = value.as_py()
            size = len(value.encode()) + len(MAGIC)
            # The chunk before the first magic of a file follows no magic line.
            found = None if split == 0 and seq == 0 else _parse(value)
            succ = at + found["length"] if found else None
            get = (found or {}).get
            rows.append((file, split, seq, at, size, succ, get("page_id"), get("type"), get("refers_to"), get("bytes"), get("digest"), get("whole")))
            at, seq = at + size, seq + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _exits(group):
    """Where the chain from each candidate of a split leaves it, from the last to the first."""
    g = group.sort_values("start")
    starts, succ = g["start"].to_numpy(), g["succ"].to_numpy()
    out, last = succ.copy(), starts[-1]
    at = np.searchsorted(starts, succ)
    for i in range(len(starts) - 1, -1, -1):
        if succ[i] <= last:  # inside: go on from there, or the chain breaks off
            out[i] = out[at[i]] if at[i] < len(starts) and starts[at[i]] == succ[i] else -1
    return g.assign(exit=out)[["file", "split", "start", "exit"]]


def _follow(group):
    """The candidates of a split that the chain from its entry reaches."""
    g = group.sort_values("start")
    starts, succ, entry = g["start"].to_numpy(), g["succ"].to_numpy(), int(g["entry"].iloc[0])
    kept, at = [], entry
    while True:
        i = np.searchsorted(starts, at)
        if i == len(starts) or starts[i] != at:
            break
        kept.append(i)
        at = succ[i]
    return g.iloc[kept][["file", "start"]]


def reachable_records(candidates: DataFrame) -> DataFrame:
    """``file, start`` of the records that the chain from offset 0 of each file reaches.

    ``candidates``: ``file, split, start, succ``. Each split's chains are followed to their exit
    first; then reached entries and jumps double until no entry is new, so the rounds are the
    logarithm of a file's number of splits.
    """
    c = candidates.select("file", "split", "start", "succ")
    jumps = cut_lineage(c.groupBy("file", "split").applyInPandas(_exits, "file string, split long, start long, exit long"))
    entries = cut_lineage(jumps.where("start = 0").select("file", "start"))
    hop, found = jumps.where("exit >= 0").select("file", "start", "exit"), entries.count()
    while True:
        entries = cut_lineage(entries.union(entries.join(hop, ["file", "start"]).select("file", F.col("exit").alias("start"))).distinct())
        reached = entries.count()
        if reached == found:
            break
        found = reached
        further = hop.select("file", F.col("start").alias("exit"), F.col("exit").alias("exit2"))
        hop = cut_lineage(hop.join(further, ["file", "exit"]).select("file", "start", F.col("exit2").alias("exit")))
    at = jumps.join(entries, ["file", "start"], "left_semi").select("file", "split", F.col("start").alias("entry"))
    inside = c.join(at, ["file", "split"])
    return inside.groupBy("file", "split").applyInPandas(_follow, "file string, start long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    Size and digest of a response are those of the bytes read; a revisit has those of its header.
    Records whose payload holds the magic line are put together from their chunks.
    """
    lines = _lines(spark, path)
    chunks = cut_lineage(lines.mapInArrow(_scan, CHUNKS))
    # A split's offsets follow from the sizes of the splits before it in its file.
    sizes = chunks.groupBy("file", "split").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = chunks.join(bases, ["file", "split"])
    # A record starts with the magic line, which stands before its chunk.
    start, body = F.col("base") + F.col("at") - len(MAGIC), F.col("base") + F.col("at")
    candidates = placed.where("succ is not null").withColumn("start", start).withColumn("succ", F.col("base") + F.col("succ"))
    kept = cut_lineage(candidates.join(reachable_records(candidates), ["file", "start"], "left_semi"))
    whole = kept.where("whole").select("page_id", "bytes", "digest", "type", "refers_to")
    parts = kept.where("not whole").select("file", "start", "succ", "page_id", "type")
    if not parts.isEmpty():
        # Chunks between a record's start and its successor, found by the last start before them.
        marks = parts.select("file", F.col("start").alias("place"), F.struct("start", "succ").alias("own"), F.lit(None).cast("struct<split:long,seq:long>").alias("chunk"))
        all_ = placed.select("file", start.alias("place"), F.lit(None).cast("struct<start:long,succ:long>").alias("own"), F.struct("split", "seq").alias("chunk"))
        last = F.last("own", True).over(Window.partitionBy("file").orderBy("place", F.col("chunk").isNotNull()))
        owned = marks.union(all_).withColumn("own", last).where("chunk is not null and place < own.succ")
        owned = cut_lineage(owned.select("file", "chunk.split", "chunk.seq", "own.start"))
        number = "file string, split long, seq long, value string"
        texts = lines.mapInArrow(_numbered, number).join(small(owned), ["file", "split", "seq"])
        joined = texts.groupBy("file", "start").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "seq", "value"))), lambda s: s.value), MAGIC).alias("value")
        )
        cells = F.split("value", END, 2)
        length = F.regexp_extract(cells[0], r"Content-Length: *(\d+)", 1).cast("int")
        block = F.substr(F.encode(cells[1], "UTF-8"), F.lit(1), length)
        rebuilt = joined.select("file", "start", F.octet_length(block).cast("long").alias("bytes"), F.sha2(block, 256).alias("digest"))
        rest = parts.join(rebuilt, ["file", "start"]).select("page_id", "bytes", "digest", "type", F.lit(None).cast("long").alias("refers_to"))
        whole = whole.union(rest)
    return whole.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


def _numbered(batches):
    import pyarrow as pa

    now, seq = None, 0
    for batch in batches:
        numbers = []
        for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            now, seq = (key, 0) if key != now else (now, seq + 1)
            numbers.append(seq)
        columns = [batch.column(1), batch.column(2), pa.array(numbers, pa.int64()), batch.column(0)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "split", "seq", "value"])
