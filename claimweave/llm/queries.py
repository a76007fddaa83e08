"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import chat, decontaminate, exact_dedup, langid, mixing, ngram_join, quality, repair, spelling, token_files, topk, toxicity, warc
from claimweave.llm.common import text_fold
from claimweave.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the fold that is held out."""
    return table(spark, sf_dir, "labels").where(text_fold("doc_id", 5) != 0)


def held_out(folds: int, fold: int):
    """Whether an id is in the held-out fold; null ids are never learned from."""
    return F.coalesce(text_fold("doc_id", folds) == fold, F.lit(True)).alias("held_out")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir))
    return found.select("doc_id", held_out(5, 0), "score", "predicted")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_folder(spark, "token-shards")
    token_files.write_token_shards(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_shards(spark, path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify_languages(docs, docs.where(text_fold("doc_id", 3) != 1))
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), links=True)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    return chat.conversation_digests(chat.format_windows(turns.union(extra)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rank_quality(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir))
    return found.select("doc_id", held_out(5, 0), "score", "predicted")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors.where("vec_id % 20 = 0"), vectors)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.damaged_words(table(spark, sf_dir, "documents"))
    return spelling.variant_forms(spelling.vocabulary(words)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.conversation_repairs(turns, repair.damaged(turns))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_toxicity, op3_token_files, op4_warc, op5_language, op6_jaccard_join, op7_decontaminate,
        op8_chat, op9_quality, op10_top_k, op11_spelling_variants, op12_repair_conversations, op13_exact_dedup,
    )
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

#: crc32 over the list ``bytes``, with the table ``t`` of the byte remainders.
_CRC_TABLE = """tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i))"""
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _best(*choices: str) -> str:
    """The least of (cost, letters, lines)."""
    return f"list_min([{', '.join(choices)}])"


def _edit(cost: str, letter: str, line: str, rest: str) -> str:
    return f"struct_pack(c := {cost} + {rest}.c, a := '{letter}' || {rest}.a, r := {line} || {rest}.r)"


def _row_edits(state: int) -> str:
    """Edits of a row in a state, as SQL over the best repairs v0 to v3 of the rows after it."""
    then, role = (3, "assistant") if state == 2 else (2, "user")
    never = "struct_pack(c := 1000000000, a := '', r := '')"
    keep = [f"WHEN ini = '{role[0]}' THEN {_edit('extra', 'K', 'line', f'v{then}')}"]
    if state == 0:
        keep.append(f"WHEN ini = 's' THEN {_edit('extra', 'K', 'line', 'v1')}")
    rerole = _edit("1 + extra", "R", f"(chr(10) || '{role}:' || text)", f"v{then}")
    may = f"CASE WHEN gone THEN {never} {' '.join(keep)} ELSE {never} END"
    return _best(_edit("2", "D", "''", f"v{state}"), may, f"CASE WHEN gone THEN {never} ELSE {rerole} END")


def _insert(state: int, rest: str) -> str:
    role = "assistant" if state == 2 else "user"
    return _edit("5", "I", f"(chr(10) || '{role}:')", rest)


ORACLES = {
    "op1_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, COALESCE(len({_WORDS}), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, 3 * source_size AS cap,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
t AS (SELECT SUM(source_size)::BIGINT AS total, SUM(w)::BIGINT AS weights FROM r),
c AS (SELECT r.*, (total - COALESCE(SUM(cap) OVER o, 0))::DOUBLE / NULLIF(weights - COALESCE(SUM(w) OVER o, 0), 0)::DOUBLE AS level
    FROM r, t WINDOW o AS (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM c WHERE level * w <= cap ORDER BY cap / w::DOUBLE, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, LEAST(COALESCE((SELECT level FROM l), 0) * w, cap::DOUBLE) AS target FROM r),
x AS (SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix' || chr(31) || COALESCE(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size)::BIGINT AS taken FROM x
""",
    "op4_warc": """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN MIN(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM h)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN keeper IS NULL OR page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN keeper IS NULL OR page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to FROM k
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, GREATEST(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, MIN(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, COUNT(*) AS n_links FROM e GROUP BY a)
SELECT w.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, COALESCE(m.component_id, w.doc_id)::BIGINT AS component_id,
    COALESCE(k.n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id LEFT JOIN k ON k.a = w.doc_id
""",
    "op8_chat": rf"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
t AS (SELECT *, len({_WORDS}) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
    12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>')) + 1
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11 AS piece FROM c),
u AS (SELECT *, COALESCE(SUM(words) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM t),
k AS (SELECT *, (b + pos) // {chat.SPAN * chat.STRETCH} AS k FROM u),
o AS (SELECT conv_id, k, list_reduce(list(struct_pack(b := b, e := b + words, p := [pos]) ORDER BY pos), lambda x, y:
    CASE WHEN y.e - x.b > {chat.SPAN} THEN struct_pack(b := y.b, e := y.e, p := list_concat(x.p, y.p)) ELSE x END).p AS opens FROM k GROUP BY conv_id, k),
v AS (SELECT k.*, list_max(list_filter(opens, lambda p: p <= pos)) AS w FROM k JOIN o ON k.conv_id IS NOT DISTINCT FROM o.conv_id AND k.k = o.k),
h AS (SELECT conv_id, w, MIN(b) AS first FROM v GROUP BY conv_id, w),
rep AS (SELECT v.conv_id, SUM(piece) AS piece FROM v JOIN h ON v.conv_id IS NOT DISTINCT FROM h.conv_id AND h.w > v.w
    WHERE (v.b + v.words <= h.first AND v.b + {chat.HISTORY} >= h.first) OR (pos = 0 AND role = 'system') GROUP BY v.conv_id),
g AS (SELECT conv_id, COUNT(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
    COALESCE(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss, SUM(piece) AS piece FROM v GROUP BY conv_id)
SELECT g.conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
    sha256(loss) AS loss_sha256, (g.piece + COALESCE(rep.piece, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN rep ON g.conv_id IS NOT DISTINCT FROM rep.conv_id
""",
    "op10_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id::BIGINT AS query_id, rank::INT AS rank, vec_id::BIGINT AS vec_id, score FROM r WHERE rank <= 20
""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
u AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents),
b AS (SELECT run, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64]::BIGINT[] END)) AS bytes FROM u WHERE length(run) >= 7),
h AS (SELECT run, {_CRC} AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, COUNT(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING COUNT(*) >= 2),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS del FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
x AS (SELECT d.word AS a, v.word AS b FROM d JOIN v ON d.del = v.word),
p AS (SELECT a, b FROM x UNION SELECT b, a FROM x UNION SELECT d.word, e.word FROM d JOIN d e ON d.i = e.i AND d.del = e.del AND d.word <> e.word),
k AS (SELECT a, COUNT(*) AS n_near, arg_min(b, (-v.n, b)) AS form, MAX(v.n) AS form_n FROM p JOIN v ON v.word = b GROUP BY a),
f AS (SELECT word, n, COALESCE(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
    FROM v LEFT JOIN k ON a = word),
g AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT g.word, f.form, k + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, k) FROM g WHERE g.word = f.word) AS root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f
""",
    "op12_repair_conversations": rf"""
WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
    list_transform(string_split(COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT) AS bytes FROM conversations),
d AS (SELECT *, {_CRC} % 20 AS d FROM c, tab),
e AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) FROM d WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, COUNT(*) OVER (PARTITION BY conv_id) AS n,
    left(role, 1) AS ini, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS ini2 FROM o),
f AS (SELECT *, chr(10) || role || ':' || text AS line, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM q),
z AS (SELECT *, COALESCE(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM f),
r AS (SELECT conv_id, MAX(n) AS i, struct_pack(c := 0, a := '', r := '') AS v0,
        struct_pack(c := 10, a := 'II', r := chr(10) || 'user:' || chr(10) || 'assistant:') AS v1,
        struct_pack(c := 5, a := 'I', r := chr(10) || 'assistant:') AS v2, struct_pack(c := 0, a := '', r := '') AS v3 FROM z GROUP BY conv_id
    UNION ALL
    SELECT conv_id, i, {_best("w0", _insert(0, "x2"))}, {_best("w1", _insert(1, "x2"))}, x2, {_best("w3", _insert(3, "w2"))} FROM
        (SELECT *, {_best("w2", _insert(2, "w3"))} AS x2 FROM
        (SELECT r.conv_id, z.i - 1 AS i, {", ".join(f"{_row_edits(s)} AS w{s}" for s in range(4))}
        FROM r JOIN z ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.i = z.i))),
s AS (SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank,
    COUNT(*) FILTER (fault = 'duplicate') AS duplicate, COUNT(*) FILTER (fault = 'truncated') AS truncated,
    COUNT(*) FILTER (i < n AND ini || ini2 NOT IN ('su', 'ua', 'au')) AS illegal FROM z GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0)::BIGINT AS blank, COALESCE(duplicate, 0)::BIGINT AS duplicate,
    COALESCE(truncated, 0)::BIGINT AS truncated, COALESCE(illegal, 0)::BIGINT AS illegal, COALESCE(v0.c, 0)::BIGINT AS cost, COALESCE(v0.a, '') AS audit,
    sha256(COALESCE(substr(v0.r, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN s ON ids.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN r ON ids.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = 0
""",
    "op13_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, MIN(doc_id) OVER (PARTITION BY h) AS keep_id, COUNT(*) OVER (PARTITION BY h) AS group_size,
    row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256 FROM d
""",
}
