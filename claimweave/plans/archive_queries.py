"""Node and edge builds from the landed archive, API pages and claim rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import claims as claim_fn
from claimweave.functions import lists, text
from claimweave.functions.claims import box_center
from claimweave.operators import filters, keyed, nodes
from claimweave.plans.registry import query, stamp
from claimweave.plans.views import Views
from claimweave.schemas import ARCHIVE
from claimweave.sources import pages as page_tables

# Nodes.


@query("node_posts", "SELECT * FROM node_post", ("node_post",))
def _(v: Views):
    return nodes.post_nodes(v.raw_tweets, v.raw_replies)


@query("node_users", "SELECT * FROM node_user", ("node_user",))
def _(v: Views):
    return nodes.user_nodes(v.raw_authors).drop("created_at")


@query(
    "node_hashtags",
    """SELECT lower('Part' || l_partkey) AS name FROM raw_posts UNION SELECT lower(l_returnflag) FROM raw_posts
       UNION SELECT lower(c_mktsegment) FROM raw_authors""",
    ("raw_posts", "raw_authors"),
)
def _(v: Views):
    return nodes.hashtag_nodes(v.raw_tweets, v.raw_authors)


_POST_URLS = """
    SELECT l_orderkey AS src, 'http://shop.example/part/' || l_partkey || '?ref=' || l_returnflag AS tgt FROM raw_posts
    UNION SELECT l_orderkey, 'https://t.co/s' || l_suppkey FROM raw_posts"""
_USER_URLS = """
    SELECT c_custkey AS src, 'http://c' || c_custkey || '.example/' AS tgt FROM raw_authors
    UNION SELECT c_custkey, 'https://img.example/n' || c_nationkey || '.jpg' FROM raw_authors"""
_MEDIA_URLS = """
    SELECT 'https://img.example/p' || p_partkey || '.jpg' AS src, '3_' || p_partkey AS tgt FROM part
    UNION SELECT 'https://img.example/size' || p_size || '.jpg', '3_' || p_partkey FROM part"""


@query(
    "node_urls",
    f"SELECT tgt AS name FROM ({_POST_URLS}) UNION SELECT tgt FROM ({_USER_URLS}) UNION SELECT src FROM ({_MEDIA_URLS})",
    ("raw_posts", "raw_authors"),
)
def _(v: Views):
    return nodes.url_nodes(v.raw_tweets, v.raw_authors, v.raw_media)


@query(
    "node_media",
    """SELECT '3_' || p_partkey AS media_id, p_type AS type, CAST(p_size AS BIGINT) AS height, CAST(p_size * 2 AS BIGINT) AS width,
              CASE WHEN p_size <= 25 THEN CAST(p_size * 1000 AS BIGINT) END AS duration_ms,
              CAST(floor(p_retailprice) AS BIGINT) AS view_count FROM part""",
)
def _(v: Views):
    return nodes.media_nodes(v.raw_media)


@query(
    "node_places",
    """SELECT CAST(n_nationkey AS VARCHAR) AS place_id, n_name AS name, substr(r_name, 1, 2) AS country_code, r_name AS country,
              n_name || ', ' || r_name AS full_name, 'country' AS place_type,
              (n_nationkey + n_nationkey + 2.5) / 2 AS lat, (CAST('-' || n_nationkey || '.5' AS DOUBLE) + n_regionkey) / 2 AS lng
       FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def _(v: Views):
    return nodes.place_nodes(v.raw_places).drop("bounding_box")


@query(
    "bbox_center",
    """SELECT CAST(n_nationkey AS VARCHAR) AS id, (CAST('-' || n_nationkey || '.5' AS DOUBLE) + n_regionkey) / 2 AS lat,
              (n_nationkey + n_nationkey + 2.5) / 2 AS lng FROM nation""",
)
def _(v: Views):
    lat, lng = box_center(lists.doubles(F.col("`geo.bbox`")), "lonlat")
    return v.raw_places.select("id", lat.alias("lat"), lng.alias("lng"))


@query(
    "node_polls",
    """SELECT CAST(s_suppkey AS VARCHAR) AS poll_id, CAST(s_nationkey * 60 AS BIGINT) AS duration_minutes,
              CAST(NULL AS VARCHAR) AS end_datetime, CASE WHEN s_acctbal > 0 THEN 'open' ELSE 'closed' END AS voting_status,
              s_name AS options FROM supplier""",
)
def _(v: Views):
    return nodes.poll_nodes(v.raw_polls)


@query("node_conversations", "SELECT DISTINCT l_suppkey AS conversation_id FROM raw_posts", ("raw_posts",))
def _(v: Views):
    return nodes.conversation_nodes(v.raw_tweets)


# Edges. Both ends of an edge must exist.

_EDGES = {
    "edge_posted": ("user_posted_post", """
        SELECT DISTINCT o_custkey AS src, l_orderkey AS tgt FROM raw_posts WHERE o_custkey IN (SELECT user_id FROM node_user)"""),
    "edge_hashtag": ("post_has_hashtag", """
        SELECT l_orderkey AS src, lower('Part' || l_partkey) AS tgt FROM raw_posts UNION SELECT l_orderkey, lower(l_returnflag) FROM raw_posts"""),
    "edge_user_hashtag": ("user_has_hashtag", "SELECT DISTINCT c_custkey AS src, lower(c_mktsegment) AS tgt FROM raw_authors"),
    "edge_mentions": ("post_mentions_user", """
        SELECT DISTINCT p.l_orderkey AS src, u.user_id AS tgt FROM raw_posts p
        JOIN node_user u ON u.user_name = 'customer#' || lpad(CAST(p.l_suppkey AS VARCHAR), 9, '0')"""),
    "edge_user_mentions": ("user_mentions_user", """
        SELECT DISTINCT a.c_custkey AS src, u.user_id AS tgt FROM raw_authors a
        JOIN node_user u ON u.user_name = 'customer#' || lpad(CAST(a.c_nationkey AS VARCHAR), 9, '0')"""),
    "edge_links": ("post_links_to_url", _POST_URLS),
    "edge_user_links": ("user_links_to_url", _USER_URLS),
    "edge_profile_picture": ("user_has_profile_picture_url", """
        SELECT DISTINCT c_custkey AS src, 'https://img.example/n' || c_nationkey || '.jpg' AS tgt FROM raw_authors"""),
    "edge_media": ("post_has_media", """
        SELECT DISTINCT l_orderkey AS src, '3_' || l_partkey AS tgt FROM raw_posts WHERE l_partkey IN (SELECT p_partkey FROM part)"""),
    "edge_url_media": ("url_is_media", _MEDIA_URLS),
    "edge_poll": ("post_has_poll", """
        SELECT DISTINCT l_orderkey AS src, CAST(l_suppkey AS VARCHAR) AS tgt FROM raw_posts
        WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)"""),
    "edge_conversation": ("post_is_part_of_conversation", "SELECT DISTINCT l_orderkey AS src, l_suppkey AS tgt FROM raw_posts"),
    "edge_place": ("post_located_in_place", """
        SELECT DISTINCT l_orderkey AS src, CAST(l_partkey % 25 AS VARCHAR) AS tgt FROM raw_posts
        WHERE l_partkey % 25 IN (SELECT n_nationkey FROM nation)"""),
    "edge_references": ("post_references_post", """
        SELECT DISTINCT l_orderkey AS src, l_partkey AS tgt FROM raw_posts WHERE l_partkey IN (SELECT post_id FROM node_post)"""),
}


def _edge(name: str, table: str, sql: str) -> None:
    query(name, sql, ("raw_posts", "raw_authors", "node_user", "node_post"))(lambda v: v.edge(table))


for _name, (_table, _sql) in _EDGES.items():
    _edge(_name, _table, _sql)

# Filters on the landed tables.


@query(
    "popular_posts",
    """SELECT CAST(l_orderkey AS VARCHAR) AS id, 'search-' || l_linenumber AS query, row_no, retweet_count
       FROM raw_posts WHERE retweet_count >= 5""",
    ("raw_posts",),
)
def _(v: Views):
    kept = filters.popular_posts(v.raw_tweets)
    return kept.select("id", "query", "row_no", F.col(filters.RETWEETS).try_cast("bigint").alias("retweet_count"))


_POPULAR = "popular AS (SELECT * FROM raw_posts WHERE retweet_count >= 5)"


def _referenced_sql():
    from claimweave.plans.registry import ORACLES
    from claimweave.plans.views import with_views

    ORACLES["referenced_entities"] = with_views(
        f""", {_POPULAR}
        SELECT 'tweets' AS kind, CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n FROM popular GROUP BY ALL
        UNION ALL
        SELECT 'authors', CAST(c_custkey AS VARCHAR), count(*) FROM raw_authors
        WHERE c_custkey IN (SELECT o_custkey FROM popular) OR c_custkey IN (SELECT l_suppkey FROM popular) GROUP BY ALL
        UNION ALL
        SELECT 'media', '3_' || p_partkey, count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM popular) GROUP BY ALL
        UNION ALL
        SELECT 'places', CAST(n_nationkey AS VARCHAR), count(*) FROM nation WHERE n_nationkey IN (SELECT l_partkey % 25 FROM popular) GROUP BY ALL
        UNION ALL
        SELECT 'polls', CAST(s_suppkey AS VARCHAR), count(*) FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM popular) GROUP BY ALL
        UNION ALL
        SELECT 'replies', CAST(conv_id * 10 + turn AS VARCHAR), count(*) FROM conversations
        WHERE conv_id IN (SELECT l_suppkey FROM popular) GROUP BY ALL""",
        "raw_posts", "raw_authors",
    )


@query("referenced_entities")
def _(v: Views):
    out = None
    for name, df in v.popular_archive.items():
        key = "media_key" if name == "media" else "id"
        counted = df.groupBy(F.lit(name).alias("kind"), F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


_referenced_sql()


@query(
    "nonnull_keys",
    "SELECT CAST(l_orderkey AS VARCHAR) AS id, retweet_count FROM raw_posts WHERE retweet_count IS NOT NULL",
    ("raw_posts",),
)
def _(v: Views):
    rows = v.raw_tweets.select("id", F.col(filters.RETWEETS).try_cast("bigint").alias("retweet_count"))
    return filters.with_keys(rows, "id", "retweet_count")


@query(
    "unique_violations",
    "SELECT lower(c_mktsegment) AS user_name, count(*) AS n_rows FROM customer GROUP BY ALL HAVING count(*) > 1",
)
def _(v: Views):
    return nodes.user_name_violations(v.table("customer").select(F.lower("c_mktsegment").alias("user_name")))


# List cells.


@query("extract_urls", _POST_URLS, ("raw_posts",))
def _(v: Views):
    return nodes.post_urls(v.raw_tweets).distinct()


@query(
    "parse_entity_lists",
    """SELECT CAST(l_orderkey AS VARCHAR) AS id, 'search-' || l_linenumber AS query, row_no,
              'Part' || l_partkey || '|' || l_returnflag AS tags,
              'Customer#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS names, '3_' || l_partkey AS media, l_partkey AS reference
       FROM raw_posts""",
    ("raw_posts",),
)
def _(v: Views):
    return v.raw_tweets.select(
        "id",
        "query",
        "row_no",
        F.array_join(lists.field(F.col("`entities.hashtags`"), "tag"), "|").alias("tags"),
        F.array_join(lists.field(F.col("`entities.mentions`"), "username"), "|").alias("names"),
        F.array_join(lists.strings(F.col("`attachments.media_keys`")), "|").alias("media"),
        F.get(lists.reference_ids(F.col("referenced_tweets")), F.lit(0)).alias("reference"),
    )


# API pages, built as JSON from the tables.


def _pages(v: Views):
    rows = v.texts("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    post = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("author_id"),
        F.col("o_orderpriority").alias("text"),
        F.struct(F.floor("o_totalprice").alias("retweet_count")).alias("public_metrics"),
        F.struct(F.array(F.struct(F.col("o_orderstatus").alias("tag"))).alias("hashtags")).alias("entities"),
    )
    user = F.struct(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("username"),
        F.struct(F.col("c_nationkey").alias("followers_count")).alias("public_metrics"),
    )
    media = F.struct(F.concat(F.lit("3_"), "o_orderkey").alias("media_key"), F.col("c_mktsegment").alias("type"))
    page = F.struct(
        F.array(post).alias("data"),
        F.struct(F.array(user).alias("users"), F.array(media).alias("media")).alias("includes"),
        F.struct(F.lit(1).alias("result_count"), F.col("o_orderkey").cast("string").alias("newest_id")).alias("meta"),
    )
    error = F.lit('{"errors": [{"detail": "User has been suspended: [1]."}]}')
    return rows.select(
        F.concat(F.lit("search-"), "o_orderpriority").alias("query"),
        F.col("o_orderkey").alias("page_no"),
        F.when(F.col("o_orderstatus") == "P", error).otherwise(F.to_json(page)).alias("page"),
    )


@query(
    "flatten_api_page",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS author_id, o_orderpriority AS text,
              CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS retweets, o_orderstatus AS tag,
              'search-' || o_orderpriority AS query, o_orderkey * 1000000 AS row_no
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(v: Views):
    posts = page_tables.flatten_api_pages(_pages(v))["tweets"]
    return posts.select(
        "id",
        "author_id",
        "text",
        F.col("`public_metrics.retweet_count`").alias("retweets"),
        F.get(lists.field(F.col("`entities.hashtags`"), "tag"), F.lit(0)).alias("tag"),
        "query",
        "row_no",
    )


@query(
    "flatten_api_includes",
    """SELECT 'authors' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, count(*) AS n
       FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL
       UNION ALL
       SELECT 'media', '3_' || o_orderkey, c_mktsegment, count(*)
       FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL
       UNION ALL
       SELECT 'metadata', CAST(o_orderkey AS VARCHAR), 'search-' || o_orderpriority, count(*) FROM orders
       WHERE o_orderstatus <> 'P' GROUP BY ALL""",
)
def _(v: Views):
    tables = page_tables.flatten_api_pages(_pages(v))
    parts = [
        tables["authors"].select(F.lit("authors").alias("kind"), "id", F.col("username").alias("name")),
        tables["media"].select(F.lit("media").alias("kind"), F.col("media_key").alias("id"), F.col("type").alias("name")),
        tables["metadata"].select(F.lit("metadata").alias("kind"), F.col("newest_id").alias("id"), F.col("query").alias("name")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("kind", "id", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flatten_id_page",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS text, o_custkey AS author FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(v: Views):
    pages = _pages(v).join(v.posts.select(F.col("post_id").alias("page_no"), F.col("user_id").alias("requested_id")), "page_no")
    return page_tables.flatten_id_pages(pages, ARCHIVE["tweets"], "author").select("id", "text", "author")


def _responses(v: Views):
    docs = v.texts("documents")
    day = F.date_format(F.expr("timestamp'2024-01-01' + make_dt_interval(int(doc_id % 30))"), "yyyy-MM-dd")
    review = F.struct(
        F.struct(F.col("source").alias("site")).alias("publisher"),
        F.col("lang").alias("languageCode"),
        F.concat(F.lit("rated "), "n_chars").alias("textualRating"),
        F.when(F.col("lang") == "fr", day).alias("reviewDate"),
        F.concat(F.lit("http://x/"), F.when(F.col("lang") != "de", day).otherwise("none"), F.lit("/y")).alias("url"),
    )
    claim = F.struct(
        F.col("text"),
        F.when(F.col("lang") == "en", day).alias("claimDate"),
        F.concat(F.lit("claimant "), "doc_id").alias("claimant"),
        F.array(review, review).alias("claimReview"),
    )
    return docs.select(F.to_json(F.struct(F.array(claim).alias("claims"))).alias("response"))


_RESPONSE_ROWS = """
    SELECT text AS claim,
           CASE WHEN lang IN ('en', 'fr') THEN day WHEN lang <> 'de' THEN day || 'T00:00:00Z' END AS date,
           'claimant ' || doc_id AS source, source AS reviewer, lang AS language, 'rated ' || n_chars AS raw_verdict
    FROM (SELECT *, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INT)), '%Y-%m-%d') AS day FROM documents)"""


@query("flatten_claim_search", _RESPONSE_ROWS)
def _(v: Views):
    return page_tables.flatten_claim_search(_responses(v))


@query(
    "claim_date_fallback",
    f"SELECT source, date FROM ({_RESPONSE_ROWS})",
)
def _(v: Views):
    return page_tables.flatten_claim_search(_responses(v)).select("source", "date")


@query(
    "date_quality_gate",
    f"""SELECT reviewer, count(*) AS n_claims, count(*) FILTER (date IS NULL) AS n_null,
               round(avg(CASE WHEN date IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share FROM ({_RESPONSE_ROWS}) GROUP BY ALL""",
)
def _(v: Views):
    shares = filters.null_date_shares(page_tables.flatten_claim_search(_responses(v)))
    return shares.withColumn("null_share", F.round("null_share", 6))


@query(
    "parsed_dates",
    """SELECT 'claimant ' || doc_id AS source,
              strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INT)), '%Y-%m-%d %H:%M:%S') AS date
       FROM documents WHERE lang <> 'de'""",
)
def _(v: Views):
    rows = page_tables.flatten_claim_search(_responses(v)).withColumn("date", claim_fn.parse_date(F.col("date")))
    return rows.filter("date IS NOT NULL").select("source", stamp("date"))


# Claim rows.


def _claim_rows(v: Views):
    """Claim texts that several reviewers share: one per (language, verdict) pair of words."""
    return v.reviewed_texts.select(
        F.concat(F.lit("claim "), F.col("doc_id") % 97).alias("claim"),
        "date",
        "source",
        "language",
        "reviewer",
        F.concat(F.lit("v"), "doc_id").alias("raw_verdict"),
        F.concat(F.lit("e"), "doc_id").alias("raw_verdict_en"),
        F.col("verdict").alias("predicted_verdict"),
        F.concat(F.lit("src"), F.col("doc_id") % 7).alias("file_reviewer"),
        F.col("doc_id").alias("row_no"),
    )


_CLAIM_ROWS = """, claim_rows AS (
    SELECT 'claim ' || (doc_id % 97) AS claim, date, source, language, reviewer, 'v' || doc_id AS raw_verdict,
           'e' || doc_id AS raw_verdict_en, verdict AS predicted_verdict, 'src' || (doc_id % 7) AS file_reviewer, doc_id AS row_no
    FROM reviewed_texts) """


@query(
    "claims_reviews",
    _CLAIM_ROWS + """
    SELECT * EXCLUDE (n) FROM (
        SELECT claim, reviewer, raw_verdict, raw_verdict_en, predicted_verdict,
               row_number() OVER (PARTITION BY claim, reviewer ORDER BY file_reviewer DESC, row_no DESC) AS n
        FROM claim_rows) WHERE n = 1 AND reviewer IN (SELECT file_reviewer FROM claim_rows)""",
    ("reviewed_texts",),
)
def _(v: Views):
    return nodes.claim_tables(_claim_rows(v))["has_reviewed"]


@query(
    "node_claims",
    _CLAIM_ROWS + """
    SELECT * EXCLUDE (n) FROM (
        SELECT claim, source, date, language, row_number() OVER (PARTITION BY claim ORDER BY file_reviewer DESC, row_no DESC) AS n
        FROM claim_rows) WHERE n = 1""",
    ("reviewed_texts",),
)
def _(v: Views):
    return nodes.claim_tables(_claim_rows(v))["claim"]


@query("node_reviewers", _CLAIM_ROWS + "SELECT DISTINCT file_reviewer AS url FROM claim_rows", ("reviewed_texts",))
def _(v: Views):
    return nodes.claim_tables(_claim_rows(v))["reviewer"]


@query(
    "claim_clusters",
    """SELECT d.doc_id AS claim_id, 'w' || e.vec_id AS keywords,
              CASE WHEN e.label = 0 THEN '' ELSE 'c' || e.label END AS cluster_keywords, e.label - 1 AS cluster
       FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id // 2""",
)
def _(v: Views):
    claims = v.texts("documents").selectExpr("doc_id AS claim_id", "concat('text ', doc_id div 2) AS claim_en")
    clusters = v.table("embeddings").selectExpr(
        "concat('text ', vec_id) AS claim", "concat('c', label) AS label", "concat('w', vec_id) AS label_single",
        "label - 1 AS cluster", "vec_id AS row_no",
    )
    return nodes.attach_clusters(claims, clusters).select("claim_id", "keywords", "cluster_keywords", "cluster")


# Pages.


@query(
    "strip_urls",
    "SELECT page_id, regexp_replace(regexp_replace(url, '\\?.*', ''), '/$', '') AS url FROM pages",
)
def _(v: Views):
    return v.texts("pages").select("page_id", text.strip_url(F.col("url")).alias("url"))


@query(
    "article_url_filter",
    "SELECT page_id, url FROM pages WHERE NOT regexp_full_match(url, '" + "|".join(filters.NOT_ARTICLE) + "')",
)
def _(v: Views):
    return v.texts("pages").filter(filters.maybe_article(F.col("url"))).select("page_id", "url")


_ARTICLES = """
    , cut AS (
        SELECT url, regexp_replace(regexp_replace(url, '\\?.*', ''), '/$', '') AS article_url,
               regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw_title,
               regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
                   '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g'),
                   '(?s)<nav.*?</nav>', '', 'g'), '(?s)<footer.*?</footer>', '', 'g') AS body
        FROM pages),
    parts AS (
        SELECT url, article_url, raw_title,
               list_transform(
                   string_split_regex(regexp_replace(regexp_replace(regexp_replace(body, '(?s)^.*?<p>', '<p>'), '(?s)</article>.*', ''),
                       '</p>', '<p>', 'g'), '<p>'),
                   lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS lines
        FROM cut),
    plain AS (
        SELECT url, article_url, raw_title,
               array_to_string(list_filter(list_transform(lines, lambda x: trim(x, E' \\n\\t')), lambda x: x <> ''), E'\\n') AS content
        FROM parts),
    tidy AS (
        SELECT url, article_url, TITLE AS title, CONTENT AS content FROM plain)
"""


def _tidy(column: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "),
                       ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        column = f"replace({column}, '{name}', '{char}')"
    return f"trim(regexp_replace(regexp_replace({column}, '\\n+', E'\\n', 'g'), ' +', ' ', 'g'), E' \\n\\t')"


_ARTICLES = _ARTICLES.replace("TITLE AS title", f"{_tidy('raw_title')} AS title").replace("CONTENT AS content", f"{_tidy('content')} AS content")


@query(
    "article_extract",
    _ARTICLES + """
    SELECT article_url AS url, title, content FROM (
        SELECT *, row_number() OVER (PARTITION BY article_url ORDER BY url) AS n FROM tidy WHERE title <> '' AND content <> '') WHERE n = 1""",
    ("sizes",),
)
def _(v: Views):
    return nodes.article_tables(v.texts("pages"))["article"].select("url", "title", "content")


@query(
    "url_is_article",
    _ARTICLES + "SELECT DISTINCT url AS src, article_url AS tgt FROM tidy WHERE title <> '' AND content <> ''",
    ("sizes",),
)
def _(v: Views):
    return nodes.article_tables(v.texts("pages"))["url_is_article"]


@query(
    "title_content_concat",
    _ARTICLES + "SELECT url, title || E'\\n' || content AS doc FROM tidy WHERE title <> '' AND content <> ''",
    ("sizes",),
)
def _(v: Views):
    tables = nodes.article_tables(v.texts("pages"))
    named = tables["article"].join(tables["url_is_article"].select("src", F.col("tgt").alias("url")), "url")
    return named.select(F.col("src").alias("url"), text.join_title(F.col("title"), F.col("content")).alias("doc"))


@query(
    "upsert_first_writer",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, arg_min(event_type, (ts, event_id)) AS event_type
       FROM events GROUP BY user_id""",
)
def _(v: Views):
    rows = v.table("events").select("user_id", "ts", "event_id", "event_type")
    return keyed.upsert_first(rows, ["user_id"], ["ts", "event_id"]).select(
        "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "event_type"
    )



