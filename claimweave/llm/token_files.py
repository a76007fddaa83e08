"""Token ids in binary shards, compressed by a Re-Pair grammar of their own.

A shard holds consecutive documents in ascending id order. Frequent pairs of neighbouring ids
are replaced by nonterminals, round after round; a pair never spans two documents. The shard
keeps the rules with their expansion lengths, so any id range can be decoded alone.

Layout of a shard, little endian: magic, five u32 (documents, rules, symbols, first
nonterminal, bytes per symbol), u64 number of ids, then doc ids (i64), a null mark per doc id
(u8), ids before each document (u64, one more than documents), symbols before each document
(u32, one more), rules (2 u32 each), expansion lengths (u32), symbols (u16 or u32).
Shards are the binary cells of a Parquet table, so Spark's own writer commits them and any
store that Spark reads will do.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import release_memory, text_batches

MAGIC = b"RPAIRv1\n"
#: A shard is closed when it holds this many ids, which bounds a task's memory.
SHARD_IDS = 1_000_000
#: A pair becomes a rule if it occurs so often in its shard.
MIN_COUNT = 6
#: Rounds of replacement and new rules of one round.
ROUNDS = 5
RULES_A_ROUND = 4096
#: Distinct words whose ids a Python worker keeps, about 30 bytes each.
CACHE_WORDS = 200_000
#: Texts are cut into words in chunks of about so many characters, of one batch or several.
CHUNK_CHARS = 1 << 21
#: Rows of a batch on its way to the encoder; its buffers are held on both sides.
BATCH_ROWS = 500
SHARD_SCHEMA = "part long, seq long, n_docs long, n_ids long, n_symbols long, payload binary"
DOC_SCHEMA = "part long, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of words, and of texts by their words. The words of a chunk of texts are looked up once each; when the
    room is full, the words of the last chunk alone stay.

    The tokenizer's own steps are: normal form, lower case, cut at white space, which is dropped,
    and between letters, digits and other characters; then each piece is encoded for itself.
    So the ids of a text are those of its pieces one after the other, wherever it is cut at
    blanks and at full stops and commas that stand alone, and pieces of Latin words can go
    straight to the tokenizer's model.
    """

    #: A full stop or comma next to another such character, or a special token's start; and the
    #: separators that are white space for this expression and not for the tokenizer.
    ODD = re.compile(r"[.,](?:[^\w\s]|_|(?<=[^\w\s].)|(?<=_.))|<\||[\x1c-\x1f]")
    #: The tokenizer's pieces of a lower-case Latin-1 word, and what only the tokenizer cuts:
    #: contractions, special tokens, control characters and white space.
    PIECES = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^0-9a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u00b2\u00b3\u00b9\u00bc-\u00be]+")
    WHOLE = re.compile("'|<\\||[\x00-\x20\x7f-\xa0]")

    def __init__(self, path: str, room: int = CACHE_WORDS):
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.model = self.tokenizer.model
        # Byte-level alphabet: the tokenizer's character for each byte.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        of_byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.alphabet = "".join(of_byte[b] for b in range(256))
        # The words held, and where in the table the ids of each begin and how many they are.
        self.words = pa.array([], pa.large_string())
        self.starts, self.lengths, self.table = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def prepared(self, text: str) -> str:
        """The text, where its words may be cut at single blanks."""
        text = text.replace("\n", " ")
        if not self._latin(text) or self.ODD.search(text):
            return text
        return text.lower().replace(",", " ,").replace(".", " .")

    def new_ids(self, w: str) -> list[int]:
        if w.isascii() and w.isalpha() and w.islower():
            return [t.id for t in self.model.tokenize(w)]
        if not self._latin(w) or self.WHOLE.search(w):
            return self.tokenizer.encode(w, add_special_tokens=False).ids
        pieces = self.PIECES.findall(w.lower())
        return [t.id for p in pieces for t in self.model.tokenize(charmap_decode(p.encode(), "strict", self.alphabet)[0])]

    @staticmethod
    def _latin(w: str) -> bool:
        try:
            return w.isascii() or bool(w.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def _look_up(self, words) -> np.ndarray:
        """The place of each of some distinct words, new ones at the end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(words, value_set=self.words)
        new = at.is_null()
        missing = words.filter(new)
        found, lengths = array("I"), array("i")
        for w in missing.to_numpy(zero_copy_only=False):
            ids = self.new_ids(w)
            found.extend(ids)
            lengths.append(len(ids))
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(lengths))
        ends = len(self.table) + np.cumsum(lengths, dtype=np.int64)
        self.starts = np.r_[self.starts, (ends - np.asarray(lengths)).astype(np.int32)]
        self.lengths = np.r_[self.lengths, np.asarray(lengths)]
        self.table = np.r_[self.table, np.asarray(found, "<u4")]
        self.words = pa.concat_arrays([self.words, missing])
        return at

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array([self.prepared(t) for t in texts], pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        at = self._look_up(words.dictionary)
        starts, lengths = self.starts[at], self.lengths[at]
        place = words.indices.to_numpy()
        n = lengths[place]
        ends = np.r_[0, np.cumsum(n, dtype=np.int64)]
        ids = self.table[_runs(starts[place], n)]
        if len(self.words) > self.room:
            self.table = self.table[_runs(starts, lengths)]
            self.starts = (np.cumsum(lengths, dtype=np.int64) - lengths).astype(np.int32)
            self.words, self.lengths = words.dictionary, lengths
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that lie somewhere in a table, one run after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    at += np.repeat(starts - (ends - lengths).astype(np.int32), lengths)
    return at


_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table per Python worker and vocabulary, so that tasks profit from earlier ones."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def repair(
    ids: np.ndarray, doc_starts: np.ndarray, base: int, rounds: int = ROUNDS, rules_a_round: int = RULES_A_ROUND, min_count: int = MIN_COUNT
):
    """``symbols, rules, starts``: the ids with frequent pairs replaced, the rules as pairs of
    symbols, and the first symbol of each document (one more than documents).

    One round takes the most frequent pairs at once. Of overlapping occurrences the one of the
    more frequent pair is replaced, among equals a pseudo-random one; the others wait for
    the next round.
    """
    seq = ids.astype(np.uint32)
    starts = np.asarray(doc_starts, np.int64)
    rules: list[np.ndarray] = []
    top, limit = base, 65536 if base < 60000 else 2**31
    wide = np.uint64 if limit > 65536 else np.uint32
    shift = wide(32 if limit > 65536 else 16)
    for _ in range(rounds):
        if len(seq) < 2 or top >= limit:
            break
        keys = (seq[:-1].astype(wide) << shift) | seq[1:]
        # Documents are never empty (each ends with the end id), so every one has a first symbol.
        ordered = np.sort(np.delete(keys, starts[1:] - 1))
        if not len(ordered):
            break
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        counts = np.diff(np.r_[first, len(ordered)])
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        best = often[np.argsort(-counts[often], kind="stable")][: min(rules_a_round, limit - top)]
        pairs, weight = ordered[first[best]], np.minimum(counts[best], 2**31 - 1).astype(np.int64)
        # A table by hash finds the pairs; of two with one place the more frequent stays. Empty places name the
        # first pair, so the key decides in any case.
        kind = np.uint16 if len(pairs) <= 65536 else np.uint32
        table = np.zeros(1 << 18, kind)
        table[_place(pairs)[::-1]] = np.arange(len(pairs), dtype=kind)[::-1]
        at = table[_place(keys)]
        same = pairs[at] == keys
        same[starts[1:] - 1] = False
        where = np.flatnonzero(same)
        at = at[where]
        noise = (where.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        rank = (weight[at] << 24) + noise.astype(np.int64) + 1
        beside = where[1:] == where[:-1] + 1
        chosen = np.ones(len(where), bool)
        chosen[1:] &= ~beside | (rank[1:] > rank[:-1])
        chosen[:-1] &= ~beside | (rank[:-1] >= rank[1:])
        taken, at = where[chosen], at[chosen]
        if len(taken) * 100 < len(seq):  # a round that saves less than a hundredth is the last
            break
        uses = np.bincount(at, minlength=len(pairs)) > 0
        number = np.cumsum(uses) - 1
        rules.append(np.stack([pairs[uses] >> shift, pairs[uses] & wide(limit - 1 if limit == 65536 else 0xFFFFFFFF)], 1).astype(np.int64))
        seq[taken] = (top + number[at]).astype(np.uint32)
        top += int(uses.sum())
        seq = np.delete(seq, taken + 1)
        starts = starts - np.searchsorted(taken, starts)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), np.r_[starts, len(seq)]


def _place(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(14)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids that each rule expands to; a rule refers to ids and earlier rules."""
    lengths = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (lengths[a - base] if a >= base else 1) + (lengths[b - base] if b >= base else 1)
    return lengths


def pack(doc_ids: list, arrays: list[np.ndarray], base: int, **grammar) -> tuple[bytes, int]:
    """A shard and its number of symbols."""
    ids = np.concatenate(arrays) if arrays else np.zeros(0, "<u4")
    before = np.r_[0, np.cumsum([len(a) for a in arrays])].astype("<u8")
    base = max(base, int(ids.max(initial=0)) + 1)
    symbols, rules, starts = repair(ids, before[:-1].astype(np.int64), base, **grammar)
    width = 2 if base + len(rules) <= 65536 else 4
    head = struct.pack("<5IQ", len(doc_ids), len(rules), len(symbols), base, width, len(ids))
    nulls = np.array([d is None for d in doc_ids], "u1")
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [numbers, nulls, before, starts.astype("<u4"), rules.astype("<u4"), rule_lengths(rules, base).astype("<u4")]
    return MAGIC + head + b"".join(p.tobytes() for p in parts) + symbols.astype(f"<u{width}").tobytes(), len(symbols)


class Shard:
    """Reads a shard; :meth:`ids` decodes any range of its ids."""

    def __init__(self, payload: bytes):
        if payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        at = len(MAGIC)
        docs, rules, symbols, self.base, width, self.n_ids = struct.unpack_from("<5IQ", payload, at)
        at += struct.calcsize("<5IQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        numbers, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(numbers, nulls)]
        self.before, self.starts = take("<u8", docs + 1).astype(np.int64), take("<u4", docs + 1).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols).astype(np.int64)
        if at != len(payload):
            raise ValueError("a token shard is cut off")

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    @cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids that the rules expand to, one rule after the other, and where each begins."""
        symbols = self.base + np.arange(len(self.rules))
        while (rule := symbols >= self.base).any():
            out = np.repeat(symbols, 1 + rule)
            left = np.cumsum(1 + rule)[rule] - 2
            out[left], out[left + 1] = self.rules[symbols[rule] - self.base].T
            symbols = out
        return symbols.astype("<u4"), np.cumsum(self.lengths) - self.lengths

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        ids, begins = self.expansions
        n = self._sizes(symbols)
        out = np.repeat(symbols.astype("<u4"), n)
        rule = np.flatnonzero(symbols >= self.base)
        length, before = n[rule], (np.cumsum(n) - n)[rule]
        out[_runs(before.astype(np.int32), length)] = ids[_runs(begins[symbols[rule] - self.base].astype(np.int32), length)]
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard: expansion lengths say which symbols hold them."""
        doc = max(0, int(np.searchsorted(self.before, start, "right")) - 1)
        last = min(len(self.starts) - 1, int(np.searchsorted(self.before, stop, "left")))
        symbols = self.symbols[self.starts[doc] : self.starts[last]]
        ends = self.before[doc] + np.cumsum(self._sizes(symbols))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        first = ends[a - 1] if a else self.before[doc]
        return self._expand(symbols[a:b])[start - first : stop - first]

    def documents(self) -> Iterator[tuple]:
        """Doc id, ids before it in the shard, and its ids, decoding all symbols once."""
        ids = self._expand(self.symbols)
        for doc, a, b in zip(self.doc_ids, self.before[:-1], self.before[1:]):
            yield doc, int(a), ids[a:b]


def encoded(words: WordIds, batches, chars: int = CHUNK_CHARS) -> Iterator[tuple]:
    """Doc id and ids of each text, chunk by chunk."""

    def chunk():
        found = words.encode_all(texts)
        texts.clear()
        release_memory()  # else Arrow and numpy each keep room for the largest chunk while a shard is packed
        return zip(docs, found)

    docs, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs.append(doc)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= chars:
                yield from chunk()
                docs, size = [], 0
    if docs:
        yield from chunk()


def _encoder(path: str, end_id: int, shard_ids: int, **grammar):
    def encode(batches):
        import pyarrow as pa

        words = word_ids(path)
        base = words.tokenizer.get_vocab_size()
        part, seq = TaskContext.get().partitionId(), 0
        docs: list = []
        arrays: list = []
        held = 0

        def close():
            payload, symbols = pack(docs, arrays, base, **grammar)
            rows = [[part], [seq], [len(docs)], [held], [symbols], [payload]]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            names = ["part", "seq", "n_docs", "n_ids", "n_symbols", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=names)

        for doc, found in encoded(words, batches):
            ids = np.append(found, np.uint32(end_id)).astype("<u4")
            docs.append(doc)
            arrays.append(ids)
            held += len(ids)
            if held >= shard_ids:
                yield close()
                docs, arrays, held, seq = [], [], 0, seq + 1
        if docs:
            yield close()
        docs, arrays = [], []
        release_memory()

    return encode


def write_token_shards(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS,
    rounds: int = ROUNDS, rules_a_round: int = RULES_A_ROUND, min_count: int = MIN_COUNT,
) -> None:
    """Encode every whole text, append ``end_id``, and write shards in ascending ``doc_id`` order.

    Null texts are empty and give the end id alone. Null ids come first; rows with the same id
    follow the hash of their texts, and repeated rows are written once each. An empty
    table writes an empty table of shards. Other columns are not read.

    Each shard's grammar grows for ``rounds`` rounds of at most ``rules_a_round`` pairs that occur
    ``min_count`` times; more of either gives smaller shards for more time, the ids stay the same.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    encode = _encoder(tokenizer or tokenizer_path(), end_id, shard_ids, rounds=rounds, rules_a_round=rules_a_round, min_count=min_count)
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    with text_batches(docs.sparkSession, BATCH_ROWS):
        ordered.mapInArrow(encode, SHARD_SCHEMA).write.parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shards.

    ``start`` counts the ids of all documents before it: within a shard from the shard,
    over shards by sums of their id counts per part.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def decode(batches):
        import pyarrow as pa

        kinds = {n: pa.int64() for n in ("part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32")}
        for batch in batches:
            for part, seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows = [(part, seq, d, a, len(x), zlib.crc32(x.tobytes())) for d, a, x in Shard(payload.as_py()).documents()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))
        release_memory()

    found = shards.select("part", "seq", "payload").mapInArrow(decode, DOC_SCHEMA)
    counts = shards.select("part", "seq", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_parts"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    offsets = offsets.select("part", "seq", (F.col("_parts") + F.col("_inside")).alias("_offset"))
    return found.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("_offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
