"""Text cleaning, search, keywords, summaries, translation, annotation, models, streams."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.functions.claims import LINK_THRESHOLD, VERDICT_IDS, verdict_id
from claimweave.operators import annotation, attempts, filters, linking, models, terms, translate
from claimweave.operators.annotation import LANGUAGES
from claimweave.plans.registry import query, score
from claimweave.plans.views import Views
from claimweave.session import cut_lineage, shared_dir
from claimweave.streaming.incremental import stream_table, upsert_stream

_TRIM = "trim({}, E' \\n\\t\\r')"


def _fold(column: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return column


# Cleaning.

_CLEAN_POST = _TRIM.format(
    "lower("
    + _fold("text", ("@[a-zA-Z0-9]*", " "), (r"(http[a-zA-Z0-9./?&:]*|www[a-zA-Z0-9./?&:]\]*)", " "), ("#", " "), ("-+", "-"), (" +", " "))
    + ")"
)


@query(
    "clean_post_text",
    f"SELECT 'd' || doc_id AS id, {_CLEAN_POST} AS text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, {_CLEAN_POST} FROM conversations",
)
def _(v: Views):
    docs = v.texts("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = v.texts("conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return docs.union(turns).select("id", text.clean_post(F.col("text")).alias("text"))


@query("clean_claim_text", f"SELECT item_id, {_TRIM.format('lower(text)')} AS text FROM benchmark")
def _(v: Views):
    return v.table("benchmark").select("item_id", text.clean_plain(F.col("text")).alias("text"))


_SEARCH_TEXT = """regexp_replace(text, '[,.“"0-9]', '', 'g')"""


@query("clean_search_text", f"SELECT doc_id, {_SEARCH_TEXT} AS text FROM documents")
def _(v: Views):
    return v.texts("documents").select("doc_id", text.clean_search_text(F.col("text")).alias("text"))


@query(
    "search_folder_names",
    "SELECT c_custkey, 'desk-' || replace(replace('#' || c_name || ' ' || c_mktsegment, '#', 'hashtag_'), ' ', '_') AS folder FROM customer",
)
def _(v: Views):
    name = F.concat(F.lit("#"), "c_name", F.lit(" "), "c_mktsegment")
    return v.table("customer").select("c_custkey", text.folder_name(name, "desk").alias("folder"))


@query(
    "query_terms",
    "SELECT lower(p_name) AS term FROM part UNION SELECT lower('#' || p_brand) FROM part",
)
def _(v: Views):
    part = v.table("part")
    return annotation.query_terms(part.select("p_name"), part.select("p_brand"))


@query(
    "embed_worklist",
    """SELECT doc_id FROM documents d WHERE NOT contains(text, '&') AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)""",
)
def _(v: Views):
    vectors = v.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = v.texts("documents").withColumn("not_translatable", F.contains("text", F.lit("&"))).join(vectors, "doc_id", "left")
    return filters.worklist(docs, ["text"], "embedding", "not_translatable").select("doc_id")


# Search, keywords, summaries.


@query(
    "search_posts",
    """SELECT post_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, lang FROM dated_documents
       WHERE created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-20' AND lang = 'en'
         AND contains(lower(text), 'the') AND contains(lower(text), 'of') AND n_chars > 200 AND source <> 'src3'""",
    ("dated_documents",),
)
def _(v: Views):
    posts = v.dated_documents.selectExpr(
        "*", "cast(NULL AS bigint) AS conversation_id", "n_chars <= 200 AS is_reply", "n_chars > 100 AS shares_content", "source = 'src3' AS is_ad"
    )
    hits = filters.search_posts(
        posts, "The of", from_date=dt.datetime(2024, 1, 3), to_date=dt.datetime(2024, 1, 20), is_reply=False,
        shares_content=True, language="en", now=dt.datetime(2030, 1, 1),
    )
    return hits.select("post_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "lang")


_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _grams(source: str, key: str) -> str:
    return f"""
        SELECT {key} AS id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
        FROM (SELECT *, {_WORDS.format(_SEARCH_TEXT)} AS w FROM {source})"""


def _top_terms(source: str, key: str) -> str:
    return f"""
    , tf AS (SELECT id, term, count(*) AS tf FROM ({_grams(source, key)}) GROUP BY ALL),
    df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
    scored AS (
        SELECT id, tf.term, round(tf * ln((CAST((SELECT count(*) FROM {source}) AS DOUBLE) + 1) / (n + 1)), 9) AS score
        FROM tf JOIN df ON df.term = tf.term),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS n FROM scored) WHERE n <= 5)
    """


@query("keywords_top5", _top_terms("documents", "doc_id") + "SELECT id AS doc_id, term, round(score, 6) AS score FROM best", ("sizes",))
def _(v: Views):
    return terms.keywords(v.texts("documents"), "doc_id", "text").select("doc_id", "term", score("score"))


def _claim_terms(v: Views):
    return terms.keywords(v.dated_passages, "claim_id", "text")


@query(
    "claim_window_search",
    _top_terms("dated_passages", "claim_id")
    + f""", held AS (
        SELECT DISTINCT g.id AS post_id, d.created_at, g.term
        FROM ({_grams('dated_documents', 'post_id')}) g JOIN dated_documents d ON d.post_id = g.id WHERE d.n_chars > 100)
    SELECT DISTINCT p.reviewer, b.term, h.post_id
    FROM best b JOIN dated_passages p ON p.claim_id = b.id
    JOIN held h ON h.term = b.term AND h.created_at >= p.date - INTERVAL 3 DAYS AND h.created_at < p.date + INTERVAL 1 DAY""",
    ("dated_passages", "dated_documents"),
)
def _(v: Views):
    posts = v.dated_documents.withColumn("shares_content", F.col("n_chars") > 100)
    return terms.search_by_keywords(v.dated_passages, _claim_terms(v), posts, is_reply=None)


@query(
    "summarise_articles",
    f"""WITH lines AS (
        SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence
        FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda x: {_TRIM.format('x')}),
                                         lambda x: x <> '') AS s FROM documents)),
    words AS (SELECT doc_id, pos, unnest({_WORDS.format('sentence')}) AS term FROM lines),
    df AS (SELECT term, ln((CAST((SELECT count(*) FROM documents) AS DOUBLE) + 1) / (count(DISTINCT doc_id) + 1)) AS idf FROM words GROUP BY term),
    scored AS (SELECT doc_id, pos, count(*) AS n, round(sum(idf) / count(*), 9) AS score FROM words JOIN df ON df.term = words.term GROUP BY ALL),
    ranked AS (
        SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS upto,
               row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM scored)
    SELECT r.doc_id, string_agg(l.sentence, ' ' ORDER BY r.pos) AS summary
    FROM ranked r JOIN lines l ON l.doc_id = r.doc_id AND l.pos = r.pos
    WHERE r.upto <= 512 OR r.rn = 1 GROUP BY r.doc_id""",
)
def _(v: Views):
    return terms.summaries(v.texts("documents"), "doc_id", "text")


# Translation through a memory that the tables themselves fill.

MEMORY_LANGUAGES = ("de", "en", "es", "fr")


@query(
    "translate_memory",
    """WITH memory AS (
        SELECT DISTINCT source AS text, lang AS target, lang || ':' || source AS translated FROM documents d
        JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1)
    SELECT doc_id, source, lang, m.translated FROM documents d LEFT JOIN memory m ON m.text = d.source AND m.target = d.lang""",
)
def _(v: Views):
    docs = v.texts("documents")
    good = v.table("labels").filter("quality = 1").select("doc_id")
    memory = docs.join(good, "doc_id", "left_semi").selectExpr(
        "source AS text", "lang AS target", "concat(lang, ':', source) AS translated"
    ).distinct()
    done = translate.translate(docs.select("doc_id", "source", "lang"), "source", "lang", memory, "translated")
    return done.select("doc_id", "source", "lang", "translated")


@query(
    "translate_lines",
    """WITH lines AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, E'\\n') AS p FROM documents))
    SELECT doc_id, CASE WHEN NOT bool_or(contains(line, '&')) THEN string_agg(CASE WHEN line = '' THEN '' ELSE 'en:' || line END, E'\\n' ORDER BY pos) END AS text_en,
           bool_or(contains(line, '&')) AS not_translatable
    FROM lines GROUP BY doc_id""",
)
def _(v: Views):
    docs = v.texts("documents")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("text")).filter("text <> '' AND NOT contains(text, '&')").distinct()
    memory = lines.select("text", F.lit("en").alias("target"), F.concat(F.lit("en:"), "text").alias("translated"))
    return translate.translate_lines(docs, "doc_id", "text", memory, "text_en")


@query(
    "review_verdicts",
    """SELECT claim, language, CASE WHEN language = 'en' THEN raw_verdict ELSE 'en:' || raw_verdict END AS raw_verdict_en
       FROM (SELECT claim, language, reviewer || ' ' || verdict AS raw_verdict FROM reviewed_texts)""",
    ("reviewed_texts",),
)
def _(v: Views):
    rows = _annotations(v)
    memory = rows.select(F.col("raw_verdict").alias("text")).distinct().select(
        "text", F.lit("en").alias("target"), F.concat(F.lit("en:"), "text").alias("translated")
    )
    return translate.review_verdicts(rows, memory).select("claim", "language", "raw_verdict_en")


def _annotations(v: Views):
    return v.reviewed_texts.select(
        "claim", "language", F.concat_ws(" ", "reviewer", "verdict").alias("raw_verdict"), "verdict"
    )


_LANGS = "(SELECT unnest([" + ", ".join(f"'{x}'" for x in LANGUAGES) + "]) AS target)"


@query(
    "expand_languages",
    f""", ann AS (SELECT claim, language, reviewer || ' ' || verdict AS raw_verdict, verdict FROM reviewed_texts)
    SELECT * FROM ann
    UNION ALL
    SELECT claim, target, CASE WHEN target IN {MEMORY_LANGUAGES} THEN target || ':' || raw_verdict END, verdict
    FROM ann, {_LANGS} WHERE target <> language""",
    ("reviewed_texts",),
)
def _(v: Views):
    rows = _annotations(v)
    return annotation.expand_annotations(rows, _memory(v, rows.select("raw_verdict")))


def _memory(v: Views, texts):
    """Every text in four of the languages."""
    target = F.explode(F.array(*[F.lit(x) for x in MEMORY_LANGUAGES]))
    wide = texts.toDF("text").distinct().select("text", target.alias("target"))
    return wide.select("text", "target", F.concat_ws(":", "target", "text").alias("translated"))


@query(
    "expand_keywords",
    f"""WITH terms AS (SELECT DISTINCT lower(p_name) AS term FROM part)
    SELECT term FROM terms UNION SELECT lower(lang || ':' || term) FROM terms, (SELECT unnest({list(MEMORY_LANGUAGES)}) AS lang)""",
)
def _(v: Views):
    words = v.table("part").select("p_name")
    return annotation.expand_keywords(words, _memory(v, words.select(F.lower("p_name"))))


# Annotation.


def _predicted(v: Views):
    return v.reviewed_texts.selectExpr(
        "*", "verdict AS predicted_verdict", "if(language = 'de', NULL, cast(length(raw_verdict) AS double) / 100000) AS predicted_verdict_confidence"
    )


@query(
    "annotation_worklist",
    """, rows AS (SELECT *, CASE WHEN language <> 'de' THEN CAST(length(raw_verdict) AS DOUBLE) / 100000 END AS confidence FROM reviewed_texts),
    done AS (SELECT raw_verdict_en FROM reviewed_texts WHERE verdict = 'misinformation' UNION SELECT text FROM benchmark)
    SELECT claim, reviewer, raw_verdict_en, confidence AS old_predicted_verdict_confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY raw_verdict_en ORDER BY confidence NULLS LAST, claim, reviewer, date) AS n
        FROM rows WHERE raw_verdict_en NOT IN (SELECT raw_verdict_en FROM done)) WHERE n = 1""",
    ("reviewed_texts",),
)
def _(v: Views):
    rows = _predicted(v)
    first = rows.filter("verdict = 'misinformation'")
    second = v.table("benchmark").select(F.col("text").alias("raw_verdict_en"))
    todo = annotation.annotation_worklist(rows, first, second)
    return todo.select("claim", "reviewer", "raw_verdict_en", "old_predicted_verdict_confidence")


_FIELDS = "claim, date, source, reviewer, language, raw_verdict, raw_verdict_en, verdict"


def _records(v: Views):
    data = F.struct("claim", "date", "source", "reviewer", "language", "raw_verdict", "raw_verdict_en")
    return v.reviewed_texts.select(data.alias("claim_data"), (F.col("verdict") != "other").alias("changed"), "verdict")


@query("changed_annotations", f"SELECT {_FIELDS} FROM reviewed_texts WHERE verdict <> 'other'", ("reviewed_texts",))
def _(v: Views):
    return annotation.changed_annotations(_records(v))


@query(
    "merge_annotations",
    """, both_rows AS (
        SELECT 'old ' || claim AS claim, raw_verdict_en, verdict, 0 AS age FROM reviewed_texts WHERE language = 'en'
        UNION ALL SELECT claim, raw_verdict_en, verdict, 1 FROM reviewed_texts WHERE verdict <> 'other')
    SELECT claim, raw_verdict_en, verdict FROM (
        SELECT *, row_number() OVER (PARTITION BY raw_verdict_en ORDER BY age, claim) AS n FROM both_rows) WHERE n = 1""",
    ("reviewed_texts",),
)
def _(v: Views):
    old = v.reviewed_texts.filter("language = 'en'").select(
        F.concat(F.lit("old "), "claim").alias("claim"), "raw_verdict_en", "verdict"
    )
    new = annotation.changed_annotations(_records(v)).select("claim", "raw_verdict_en", "verdict")
    return annotation.merge_annotations(old, new, ["claim"])


_UPPER = "upper(replace({}, 'ß', 'ss'))"
_CAP = "upper(replace(substr({0}, 1, 1), 'ß', 'ss')) || lower(substr({0}, 2))"


@query(
    "case_variants",
    f"""SELECT doc_id, verdict, 'lower' AS "case", md5(lower(raw_verdict)) AS form FROM reviewed_texts
    UNION ALL SELECT doc_id, verdict, 'upper', md5({_UPPER.format('raw_verdict')}) FROM reviewed_texts
    UNION ALL SELECT doc_id, verdict, 'capitalize', md5({_CAP.format('raw_verdict')}) FROM reviewed_texts
    UNION ALL SELECT doc_id, verdict, 'title', md5(array_to_string(list_transform(
        regexp_extract_all(raw_verdict, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'), lambda x: {_CAP.format('x')}), '')) FROM reviewed_texts""",
    ("reviewed_texts",),
)
def _(v: Views):
    rows = annotation.case_variants(v.reviewed_texts.select("doc_id", "verdict", "raw_verdict"))
    return rows.select("doc_id", "verdict", "case", F.md5("raw_verdict").alias("form"))


_VERDICT_ID = "CASE {} " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in VERDICT_IDS.items()) + " END"


@query(
    "label_encode",
    f"SELECT doc_id, CAST({_VERDICT_ID.format('verdict')} AS BIGINT) AS label FROM reviewed_texts",
    ("reviewed_texts",),
)
def _(v: Views):
    rows = annotation.numbered_labels(v.reviewed_texts)
    return rows.select("doc_id", F.col("label").cast("bigint").alias("label"))


@query(
    "annotation_shuffle",
    "SELECT claim, verdict FROM reviewed_texts WHERE claim NOT IN (SELECT claim FROM reviewed_texts WHERE verdict = 'misinformation')",
    ("reviewed_texts",),
)
def _(v: Views):
    rows = v.reviewed_texts
    todo = annotation.annotation_worklist(rows, rows.filter("verdict = 'misinformation'"), include_duplicates=True)
    return todo.select("claim", "verdict")


# Models.


_MASK = 4294967295


def _vectors_sql(dimensions: int) -> str:
    """Hashed tf-idf of the cleaned documents: ``vectors(post_id, v)`` with the dimensions in order. A word's
    dimension is its 32-bit murmur3 hash with seed 42, which both engines can compute, modulo a power of two."""
    each = "list_transform({}, lambda k: {})".format
    turn = f"((k << {{0}}) | (k >> {{1}})) & {_MASK}".format

    def mixed(blocks: str) -> str:
        return each(each(each(blocks, f"(k * 3432918353) & {_MASK}"), turn(15, 17)), f"(k * 461845907) & {_MASK}")

    byte = "(b[{0} + 1] | (b[{0} + 2] << 8) | (b[{0} + 3] << 16) | (b[{0} + 4] << 24))".format("4 * i")
    tail = "list_reduce(list_prepend(0::UBIGINT, list_transform(range(4 * (n // 4), n), lambda i: b[i + 1] << (8 * (i % 4)))), lambda x, y: x | y)"
    step = f"(((((xor(h, k) << 13) | (xor(h, k) >> 19)) & {_MASK}) * 5 + 3864292196) & {_MASK})"
    return f""", words AS (SELECT post_id, unnest({_WORDS.format(_CLEAN_POST)}) AS word FROM dated_documents),
    b AS (SELECT word, n, list_transform(range(n), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::UBIGINT) AS b
        FROM (SELECT word, hex(word) AS hx, (length(hex(word)) // 2)::BIGINT AS n FROM (SELECT DISTINCT word FROM words))),
    h1 AS (SELECT word, n, list_reduce(list_prepend(42::UBIGINT, {mixed(f"list_transform(range(n // 4), lambda i: {byte})")}), lambda h, k: {step}) AS h,
        {mixed(f"[{tail}]")}[1] AS t FROM b),
    h2 AS (SELECT word, xor(xor(h, t), n::UBIGINT) AS h FROM h1),
    h3 AS (SELECT word, (xor(h, h >> 16) * 2246822507) & {_MASK} AS h FROM h2),
    h4 AS (SELECT word, (xor(h, h >> 13) * 3266489909) & {_MASK} AS h FROM h3),
    dims AS (SELECT word, (xor(h, h >> 16) % {dimensions})::BIGINT AS i FROM h4),
    tf AS (SELECT post_id, i, count(*) AS tf FROM words JOIN dims ON dims.word = words.word GROUP BY ALL),
    idf AS (SELECT i, ln((CAST((SELECT count(*) FROM dated_documents WHERE text IS NOT NULL) AS DOUBLE) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY i),
    w AS (SELECT post_id, tf.i, tf * idf AS w FROM tf JOIN idf ON idf.i = tf.i),
    unit AS (SELECT post_id, i, w / sqrt(sum(w * w) OVER (PARTITION BY post_id)) AS w FROM w),
    cells AS (SELECT post_id, i FROM (SELECT post_id FROM dated_documents WHERE text IS NOT NULL), range({dimensions}) r(i)),
    vectors AS (SELECT c.post_id, list(coalesce(w, 0.0) ORDER BY c.i) AS v FROM cells c LEFT JOIN unit u ON u.post_id = c.post_id AND u.i = c.i GROUP BY c.post_id)
    """


@query(
    "embed_text",
    _vectors_sql(256) + "SELECT post_id, array_to_string(list_transform(v, lambda x: CAST(round(x * 1000000) AS BIGINT)), ' ') AS embedding FROM vectors",
    ("dated_documents",),
)
def _(v: Views):
    """Unit vectors, in millionths."""
    docs = v.dated_documents.select("post_id", "text")
    millionths = F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string"))
    return models.embed(docs, "text", text.clean_post, 256).select("post_id", F.array_join(millionths, " ").alias("embedding"))


@query(
    "link_embedded_texts",
    _vectors_sql(512)
    + f""", dated AS (SELECT d.post_id, created_at, v FROM vectors JOIN dated_documents d ON d.post_id = vectors.post_id WHERE list_max(v) > 0),
    s AS (SELECT p.post_id, c.post_id AS claim_id, list_inner_product(p.v, c.v) AS s
        FROM dated p JOIN dated c ON p.created_at BETWEEN c.created_at - INTERVAL 3 DAYS AND c.created_at)
    SELECT post_id, claim_id, round(s, 6) AS score FROM s WHERE s > {LINK_THRESHOLD}""",
    ("dated_documents",),
)
def _(v: Views):
    """Documents as claims against documents as posts, at the real threshold: copies and
    near copies that are not younger than the claim."""
    texts = v.dated_documents.select("post_id", "created_at", "text")
    weights = models.term_weights(models.count_terms(texts.select(text.clean_post(F.col("text")).alias("_doc")), "_doc", 512))
    docs = models.embed(texts, "text", text.clean_post, 512, weights=weights, counts="counts")
    # The counts travel, and become vectors in the tasks that score them.
    docs = cut_lineage(docs.select("post_id", "created_at", F.col("counts").alias("embedding")))
    c = docs.select(F.col("post_id").alias("claim_id"), F.col("created_at").alias("date"), "embedding")
    return linking.link_by_cosine(c, docs.withColumnRenamed("post_id", "item_id"), weights=weights).select(
        F.col("item_id").alias("post_id"), "claim_id", score("score")
    )


@query("predict_verdict")
def _(v: Views):
    model = models.train_verdict_classifier(v.reviewed_texts)
    out = models.predict_verdicts(model, v.reviewed_texts.select("doc_id", "raw_verdict"), "raw_verdict")
    return out.select("doc_id", "predicted_verdict", F.round("predicted_verdict_confidence", 3).alias("confidence"))


def _metrics_sql() -> str:
    cells = []
    for name, i in VERDICT_IDS.items():
        hit, said, real = (f"CAST(count(*) FILTER ({c}) AS DOUBLE)" for c in (f"label = {i} AND prediction = {i}", f"prediction = {i}", f"label = {i}"))
        cells.append(f"coalesce(2 * {hit} / nullif({said} + {real}, 0), 0.0) AS f1_{name}")
        cells.append(f"coalesce({hit} / nullif({said}, 0), 0.0) AS prec_{name}")
    names = list(VERDICT_IDS)
    out = [f"round({m}_{n}, 6) AS {m}_{n}" for n in names for m in ("f1", "prec")]
    out += [f"round(({' + '.join(f'{m}_{n}' for n in names)}) / 3, 6) AS {m}_macro" for m in ("f1", "prec")]
    return f""", p AS (SELECT {_VERDICT_ID.format('verdict')} AS label, CASE WHEN raw_verdict LIKE '%&%' THEN 1 WHEN language = 'en' THEN 0 ELSE 2 END AS prediction
        FROM reviewed_texts) SELECT {', '.join(out)} FROM (SELECT {', '.join(cells)} FROM p)"""


@query("classifier_metrics", _metrics_sql(), ("reviewed_texts",))
def _(v: Views):
    rows = v.reviewed_texts.select(
        verdict_id(F.col("verdict")).alias("label"),
        F.when(F.contains("raw_verdict", F.lit("&")), 1).when(F.col("language") == "en", 0).otherwise(2).alias("prediction"),
    )
    out = models.classifier_metrics(rows)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# Failures.

_PASS = """SELECT key, count(error) AS tries, max(error) AS error, bool_or(error IS NULL) AS ok FROM (
    SELECT user_id || '-' || event_id % 40 AS key, CASE WHEN event_type = 'error' THEN 'error ' || event_id % 7 END AS error
    FROM events WHERE event_id % 2 = {}) GROUP BY key"""


@query(
    "attempt_ledger",
    f"""WITH one AS (SELECT * FROM ({_PASS.format(0)}) WHERE NOT ok), two AS ({_PASS.format(1)})
    SELECT 'sync' AS job, coalesce(one.key, two.key) AS key, CAST(coalesce(one.tries, 0) + coalesce(two.tries, 0) AS BIGINT) AS tries,
           coalesce(two.error, one.error) AS error, coalesce(one.tries, 0) + coalesce(two.tries, 0) >= 2 AS given_up
    FROM one FULL JOIN two ON one.key = two.key WHERE NOT coalesce(two.ok, false)""",
)
def _(v: Views):
    """Two passes over the events; those of kind error failed."""
    events = v.table("events").select(
        "event_id", F.lit("sync").alias("job"), F.concat("user_id", F.lit("-"), F.col("event_id") % 40).alias("key"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("event_id") % 7)).alias("error"),
    )
    ledger = v.spark.createDataFrame([], attempts.LEDGER)
    for half in (0, 1):
        ledger = attempts.fold(ledger, events.filter(F.col("event_id") % 2 == half).drop("event_id"))
    return ledger.select("job", "key", "tries", "error", (F.col("tries") >= 2).alias("given_up"))


# Streams.


@query(
    "stream_upsert_posts",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, arg_min(event_type, (ts, event_id)) AS event_type
       FROM events GROUP BY user_id""",
)
def _(v: Views):
    """The events file as a stream; the first event of a user sets its row."""
    root = f"{shared_dir(v.spark)}/streams/{uuid.uuid4().hex}"
    schema = v.table("events").schema
    source = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.dir)
    upsert_stream(source, f"{root}/table", f"{root}/checkpoint", ["user_id"], ["ts", "event_id"]).awaitTermination()
    rows = stream_table(v.spark, f"{root}/table")
    return rows.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "event_type")
