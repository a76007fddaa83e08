"""Views of the given tables in the shapes the operators take.

Each view exists twice: as a DataFrame here and as SQL text in :data:`SQL`. All views take
whole tables. An embedded text serves both as a claim and as a post, with dates derived
from its id; reviews come from ``labels``, the social graph from ``orders``, ``lineitem``
and ``events``, the landed archive from ``lineitem``, ``orders``, ``customer``, ``part``,
``nation``, ``supplier`` and ``conversations``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators import ego
from claimweave.operators import labels as lab
from claimweave.operators import linking
from claimweave.operators.filters import referenced
from claimweave.operators.nodes import archive_edge, archive_ends
from claimweave.session import cut_lineage, widen

# The test vectors are almost orthogonal, so the three sizes get lower thresholds here.
SIZES = {"small": 0.25, "medium": 0.20, "large": 0.15}
TAU = SIZES["large"]
# Ego networks: links this strong, and so many top clusters of the nine.
EGO_TAU = SIZES["small"]
TOP = 5


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A table whose cells are parsed at length."""
        return widen(self.table(name))

    # Claims, posts and reviews.

    @property
    def claims(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "cast(vec_id AS bigint) AS claim_id",
            "cast(label AS bigint) - 1 AS cluster",
            "timestamp'2024-01-01' + make_dt_interval(int(vec_id % 30)) AS date",
            "embedding",
        )

    @property
    def posts_vec(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "cast(vec_id AS bigint) AS post_id",
            "timestamp'2024-01-01' + make_dt_interval(int(vec_id * 7 % 30), int(vec_id * 37 % 24)) AS created_at",
            "embedding",
        )

    @property
    def articles(self) -> DataFrame:
        pages = self.table("pages").select(F.col("page_id").alias("post_id"), text.strip_url(F.col("url")).alias("url"))
        return self.posts_vec.join(pages, "post_id").select(
            F.col("post_id").alias("article_id"),
            "url",
            F.date_trunc("day", "created_at").alias("created_at"),
            "embedding",
        )

    @property
    def has_reviewed(self) -> DataFrame:
        rows = self.table("labels").selectExpr(
            "doc_id AS claim_id",
            "inline(array("
            "named_struct('reviewer', 'quality-desk', 'predicted_verdict', if(quality = 1, 'factual', 'misinformation')),"
            "named_struct('reviewer', 'toxicity-desk', 'predicted_verdict', if(toxic = 1, 'misinformation', 'other'))))",
        )
        return rows.join(self.claims.select("claim_id"), "claim_id", "left_semi")

    def scored_posts(self, threshold: float = TAU) -> linking.Scored:
        """Links to posts, scored when asked for: written they would grow with the square of the vectors."""
        return linking.Scored(self.claims, self.posts_vec.withColumnRenamed("post_id", "item_id"), threshold)

    def scored_articles(self, threshold: float = TAU) -> linking.Scored:
        """Links to all articles, see :meth:`scored_posts`."""
        return linking.Scored(self.claims, self.articles.withColumnRenamed("article_id", "item_id"), threshold, "article_id")

    def similar_posts(self, threshold: float = TAU) -> DataFrame:
        return self.scored_posts(threshold).rows()

    def similar_articles(self, threshold: float = TAU, among: DataFrame | None = None) -> DataFrame:
        """Links to all articles, or to those ``among(article_id)``."""
        return self.scored_articles(threshold).among(items=among).rows()

    @property
    def similar_edge(self) -> DataFrame:
        return self.similar_posts()

    @property
    def article_links(self) -> DataFrame:
        return self.similar_articles()

    @property
    def links_to(self) -> DataFrame:
        views = self._events("view").select(F.col("user_id").alias("post_id"), F.col("k").alias("page_id"))
        return views.join(self.table("pages").select("page_id", "url"), "page_id").select("post_id", "url").distinct()

    @property
    def is_article(self) -> DataFrame:
        urls = self.table("pages").select("url", text.strip_url(F.col("url")).alias("_stripped"))
        return urls.join(
            self.articles.select("article_id", F.col("url").alias("_stripped")), "_stripped"
        ).select("url", "article_id").distinct()

    @cached_property
    def via(self) -> linking.Via:
        """Links through articles, in two tables: their pairs are far more rows than both. Only articles that
        some post links to are scored here."""
        post_article = cut_lineage(linking.post_articles(self.links_to, self.is_article))
        links = self.similar_articles(among=post_article.select("article_id"))
        return linking.Via(post_article, cut_lineage(linking.read_articles(post_article, links).article_links))

    @property
    def via_article(self) -> DataFrame:
        return linking.best_via(self.via)

    @property
    def links(self) -> linking.Linked:
        return linking.Linked(self.scored_posts(), self.via)

    def seeds(self) -> DataFrame:
        both = self.scored_posts().best("claim_id").union(self.scored_articles().best("claim_id"))
        return lab.label_seeds(both, self.has_reviewed, SIZES)

    def propagate(self) -> tuple[DataFrame, DataFrame]:
        return lab.propagate_labels(self.scored_posts(), self.seeds(), SIZES, via=self.via)

    @cached_property
    def labelled(self) -> tuple[DataFrame, DataFrame]:
        labels, has_label = self.propagate()
        return cut_lineage(labels), cut_lineage(has_label)

    @property
    def labels(self) -> DataFrame:
        return self.labelled[0]

    @property
    def has_label(self) -> DataFrame:
        return self.labelled[1]

    @cached_property
    def linked(self) -> DataFrame:
        return cut_lineage(linking.linked_posts(self.scored_posts(), self.has_label, TAU, self.via))

    def cluster_scores(self) -> DataFrame:
        direct = self.scored_posts(EGO_TAU)
        return ego.cluster_scores(
            self.claims, self.has_reviewed, direct, self.posted, self.post_mentions, self.user_mentions, EGO_TAU, self.via
        )

    def find_spreaders(self) -> DataFrame:
        direct = self.scored_posts(EGO_TAU)
        top = cut_lineage(ego.top_clusters(self.cluster_scores(), TOP))
        return ego.spreaders(top, self.claims, self.labels, self.has_label, direct, self.posted, EGO_TAU, self.via)

    @cached_property
    def spreaders(self) -> DataFrame:
        """Written once: the ego queries each use it several times."""
        return cut_lineage(self.find_spreaders())

    # The social graph.

    def _events(self, kind: str) -> DataFrame:
        return self.table("events").filter(F.col("event_type") == kind).select(
            "event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")
        )

    @property
    def users(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS user_id",
            "lower(c_name) AS user_name",
            "cast(c_nationkey AS bigint) AS following_count",
            "cast(floor(abs(c_acctbal)) AS bigint) AS followers_count",
            "cast(length(c_mktsegment) AS bigint) AS tweet_count",
        )

    @property
    def posts(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS post_id",
            "o_custkey AS user_id",
            "o_orderdate AS created_at",
            "o_orderpriority AS text",
            "o_orderstatus AS lang",
            "cast(floor(o_totalprice / 50000) AS bigint) AS retweet_count",
            "cast(floor(o_totalprice / 20000) AS bigint) % 4 AS reply_count",
            "cast(floor(o_totalprice / 30000) AS bigint) % 3 AS quote_count",
        )

    @property
    def posted(self) -> DataFrame:
        return self.posts.select("user_id", "post_id")

    @property
    def has_hashtag(self) -> DataFrame:
        return self.table("lineitem").selectExpr("l_orderkey AS post_id", "l_partkey AS name").distinct()

    @cached_property
    def post_mentions(self) -> DataFrame:
        """Written once: the ego queries each use it several times."""
        return cut_lineage(self.table("lineitem").selectExpr("l_orderkey AS post_id", "l_partkey AS user_id").distinct())

    def _pairs(self, kind: str) -> DataFrame:
        return self._events(kind).filter("user_id <> k").select(F.col("user_id").alias("src"), F.col("k").alias("tgt")).distinct()

    @property
    def user_mentions(self) -> DataFrame:
        return self._pairs("view")

    @property
    def follows(self) -> DataFrame:
        return self._pairs("signup")

    @property
    def retweeted(self) -> DataFrame:
        return self._events("click").select("user_id", F.col("k").alias("post_id")).distinct()

    def _replies(self, kind: str) -> DataFrame:
        return self._events(kind).select(F.col("event_id").alias("reply_id"), "user_id", F.col("k").alias("post_id"))

    @property
    def reply_to(self) -> DataFrame:
        return self._replies("purchase")

    @property
    def quote_of(self) -> DataFrame:
        return self._replies("error")

    @property
    def replies(self) -> DataFrame:
        return self.reply_to.union(self.quote_of)

    # The landed archive: text cells as a search writes them.

    @property
    def raw_tweets(self) -> DataFrame:
        rows = self.texts("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.selectExpr(
            "cast(l_orderkey AS string) AS id",
            "cast(o_custkey AS string) AS author_id",
            "cast(l_suppkey AS string) AS conversation_id",
            "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS created_at",
            "concat('post ', o_orderpriority, ' ', l_returnflag) AS text",
            "l_linestatus AS lang",
            "l_returnflag AS source",
            "if(l_tax = 0, 'n/a', cast(cast(l_quantity AS bigint) AS string)) AS `public_metrics.retweet_count`",
            "cast(cast(round(l_discount * 100) AS bigint) AS string) AS `public_metrics.reply_count`",
            "cast(cast(floor(l_extendedprice / 1000) AS bigint) AS string) AS `public_metrics.like_count`",
            "cast(cast(round(l_tax * 100) AS bigint) AS string) AS `public_metrics.quote_count`",
            "concat(\"[{'start': 1, 'url': 'https://t.co/s\", l_suppkey, \"', 'expanded_url': 'http://shop.example/part/\","
            " l_partkey, '?ref=', l_returnflag, \"'}, {'url': 'https://t.co/s\", l_suppkey,"
            " \"'}, {'url': 'https://t.co/x', 'expanded_url': None}]\") AS `entities.urls`",
            "concat(\"[{'start': 0, 'end': 4, 'tag': 'Part\", l_partkey, \"'}, {'start': 5, 'end': 6, 'tag': '\","
            " l_returnflag, \"'}]\") AS `entities.hashtags`",
            "concat(\"[{'start': 0, 'username': 'Customer#\", lpad(l_suppkey, 9, '0'), \"', 'id': '\", l_suppkey, \"'}]\")"
            " AS `entities.mentions`",
            "concat(\"['3_\", l_partkey, \"']\") AS `attachments.media_keys`",
            "concat(\"['\", l_suppkey, \"']\") AS `attachments.poll_ids`",
            "cast(l_partkey % 25 AS string) AS `geo.place_id`",
            "concat(\"[{'type': 'quoted', 'id': '\", l_partkey, \"'}]\") AS referenced_tweets",
            "concat('search-', l_linenumber) AS query",
            "l_partkey * 100000000 + cast(round(l_extendedprice * 100) AS bigint) AS row_no",
        )

    @property
    def raw_authors(self) -> DataFrame:
        rows = self.texts("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.selectExpr(
            "cast(c_custkey AS string) AS id",
            "c_name AS username",
            "c_name AS name",
            "c_mktsegment AS description",
            "cast(NULL AS string) AS created_at",
            "concat('https://img.example/n', c_nationkey, '.jpg') AS profile_image_url",
            "if(c_acctbal > 0, 'True', 'False') AS verified",
            "cast(cast(floor(abs(c_acctbal)) AS bigint) AS string) AS `public_metrics.followers_count`",
            "cast(c_nationkey AS string) AS `public_metrics.following_count`",
            "cast(cast(floor(o_totalprice) AS bigint) AS string) AS `public_metrics.tweet_count`",
            "concat(\"[{'url': 'https://t.co/u', 'expanded_url': 'http://c\", c_custkey, \".example/'}]\") AS `entities.url.urls`",
            "cast(NULL AS string) AS `entities.description.urls`",
            "concat(\"[{'tag': '\", c_mktsegment, \"'}]\") AS `entities.description.hashtags`",
            "concat(\"[{'username': 'Customer#\", lpad(c_nationkey, 9, '0'), \"'}]\") AS `entities.description.mentions`",
            "concat('search-', o_orderpriority) AS query",
            "o_orderkey AS row_no",
        )

    @property
    def raw_media(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('3_', p_partkey) AS media_key",
            "p_type AS type",
            "concat('https://img.example/p', p_partkey, '.jpg') AS url",
            "concat('https://img.example/size', p_size, '.jpg') AS preview_image_url",
            "cast(p_size AS string) AS height",
            "cast(p_size * 2 AS string) AS width",
            "if(p_size > 25, 'long', cast(p_size * 1000 AS string)) AS duration_ms",
            "cast(cast(floor(p_retailprice) AS bigint) AS string) AS `public_metrics.view_count`",
            "'search-1' AS query",
            "p_partkey AS row_no",
        )

    @property
    def raw_places(self) -> DataFrame:
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
            "cast(n_nationkey AS string) AS id",
            "n_name AS name",
            "concat(n_name, ', ', r_name) AS full_name",
            "r_name AS country",
            "substr(r_name, 1, 2) AS country_code",
            "'country' AS place_type",
            "concat('[', n_nationkey, ', -', n_nationkey, '.5, ', n_nationkey + 2, '.5, ', n_regionkey, ']') AS `geo.bbox`",
            "'search-1' AS query",
            "cast(n_nationkey AS bigint) AS row_no",
        )

    @property
    def raw_polls(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "cast(s_suppkey AS string) AS id",
            "cast(NULL AS string) AS end_datetime",
            "if(s_acctbal > 0, 'open', 'closed') AS voting_status",
            "s_name AS options",
            "cast(s_nationkey * 60 AS string) AS duration_minutes",
            "'search-1' AS query",
            "s_suppkey AS row_no",
        )

    @property
    def raw_replies(self) -> DataFrame:
        from claimweave.schemas import POST_COLUMNS, conform

        rows = self.texts("conversations").selectExpr(
            "cast(conv_id * 10 + turn AS string) AS id",
            "cast(conv_id AS string) AS conversation_id",
            "text",
            "role AS source",
            "'search-1' AS query",
            "conv_id * 10 + turn AS row_no",
        )
        return conform(rows, POST_COLUMNS, ("query", "row_no"))

    @property
    def archive(self) -> dict[str, DataFrame]:
        return {
            "tweets": self.raw_tweets,
            "replies": self.raw_replies,
            "authors": self.raw_authors,
            "media": self.raw_media,
            "places": self.raw_places,
            "polls": self.raw_polls,
        }

    @property
    def popular_archive(self) -> dict[str, DataFrame]:
        return referenced(self.archive)

    @cached_property
    def ends(self) -> Mapping[str, DataFrame]:
        """What edges look at in the node tables, each written once, when the first edge asks for it."""
        return _Ends(self.archive)

    def edge(self, name: str) -> DataFrame:
        return archive_edge(self.archive, self.ends, name)

    # Reviewed texts and dated documents.

    @property
    def reviewed_texts(self) -> DataFrame:
        """Labelled documents as claim rows; the verdict text is the document text."""
        return self.texts("documents").join(self.table("labels"), "doc_id").selectExpr(
            "concat('claim ', doc_id) AS claim",
            "date_format(timestamp'2024-01-01' + make_dt_interval(int(doc_id % 30)), 'yyyy-MM-dd') AS date",
            "source AS source",
            "source AS reviewer",
            "lang AS language",
            "text AS raw_verdict",
            "if(lang = 'en', text, concat(source, ' ', quality)) AS raw_verdict_en",
            "CASE WHEN toxic = 1 THEN 'misinformation' WHEN quality = 1 THEN 'factual' ELSE 'other' END AS verdict",
            "doc_id",
        )

    @property
    def dated_documents(self) -> DataFrame:
        return self.texts("documents").selectExpr(
            "doc_id AS post_id",
            "timestamp'2024-01-01' + make_dt_interval(int(doc_id % 30), int(doc_id % 24)) AS created_at",
            "text",
            "lang",
            "source",
            "n_chars",
        )

    @property
    def dated_passages(self) -> DataFrame:
        return self.table("benchmark").selectExpr(
            "item_id AS claim_id",
            "concat('desk-', item_id % 3) AS reviewer",
            "timestamp'2024-01-03' + make_dt_interval(int(item_id % 30)) AS date",
            "text",
        )


class _Ends(dict):
    def __init__(self, archive: dict[str, DataFrame]):
        self.archive = archive

    def __missing__(self, name: str) -> DataFrame:
        self[name] = cut_lineage(archive_ends(self.archive, name))
        return self[name]


_OPEN: dict[tuple[str, str], Views] = {}


def views(spark: SparkSession, sf_dir: str) -> Views:
    """One object per application and folder, so the links and labels are computed once."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Views(spark, sf_dir)
    return _OPEN[key]


def _events_sql(kind: str, select: str, where: str = "") -> str:
    return f"SELECT {select} FROM events WHERE event_type = '{kind}' {where}"


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

# name -> (views it uses, text)
SQL: dict[str, tuple[list[str], str]] = {
    "claims": ([], """
        SELECT CAST(vec_id AS BIGINT) AS claim_id, CAST(label AS BIGINT) - 1 AS cluster,
               TIMESTAMP '2024-01-01' + to_days(CAST(vec_id % 30 AS INT)) AS date, embedding
        FROM embeddings"""),
    "posts_vec": ([], """
        SELECT CAST(vec_id AS BIGINT) AS post_id,
               TIMESTAMP '2024-01-01' + to_days(CAST(vec_id * 7 % 30 AS INT)) + to_hours(CAST(vec_id * 37 % 24 AS INT)) AS created_at,
               embedding
        FROM embeddings"""),
    "articles": (["posts_vec"], """
        SELECT p.post_id AS article_id, regexp_replace(regexp_replace(g.url, '\\?.*', ''), '/$', '') AS url,
               date_trunc('day', p.created_at) AS created_at, p.embedding
        FROM posts_vec p JOIN pages g ON g.page_id = p.post_id"""),
    "has_reviewed": (["claims"], """
        SELECT doc_id AS claim_id, 'quality-desk' AS reviewer,
               CASE WHEN quality = 1 THEN 'factual' ELSE 'misinformation' END AS predicted_verdict
        FROM labels WHERE doc_id IN (SELECT claim_id FROM claims)
        UNION ALL
        SELECT doc_id, 'toxicity-desk', CASE WHEN toxic = 1 THEN 'misinformation' ELSE 'other' END
        FROM labels WHERE doc_id IN (SELECT claim_id FROM claims)"""),
    "similar_edge": (["claims", "posts_vec"], f"""
        SELECT * FROM (
            SELECT p.post_id, c.claim_id,
                   list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
            FROM claims c JOIN posts_vec p ON p.created_at BETWEEN c.date - INTERVAL 3 DAYS AND c.date)
        WHERE score > {TAU}"""),
    "article_links": (["claims", "articles"], f"""
        SELECT * FROM (
            SELECT p.article_id, c.claim_id,
                   list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
            FROM claims c JOIN articles p ON p.created_at BETWEEN c.date - INTERVAL 3 DAYS AND c.date)
        WHERE score > {TAU}"""),
    "links_to": ([], _events_sql("view", f"DISTINCT user_id AS post_id, g.url").replace(
        "FROM events", f"FROM events JOIN pages g ON g.page_id = {_K}")),
    "is_article": (["articles"], """
        SELECT DISTINCT g.url, a.article_id FROM pages g
        JOIN articles a ON a.url = regexp_replace(regexp_replace(g.url, '\\?.*', ''), '/$', '')"""),
    "via_article": (["links_to", "is_article", "article_links"], """
        SELECT l.post_id, s.claim_id, max(s.score) AS score
        FROM links_to l JOIN is_article i ON i.url = l.url JOIN article_links s ON s.article_id = i.article_id
        GROUP BY ALL"""),
    "links": (["similar_edge", "via_article"], """
        SELECT post_id, claim_id, max(score) AS score
        FROM (SELECT post_id, claim_id, score FROM similar_edge UNION ALL SELECT post_id, claim_id, score FROM via_article)
        GROUP BY ALL"""),
    "sizes": ([], "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t})" for n, t in SIZES.items()) + ") AS t(size, threshold)"),
    "agreed": (["has_reviewed"], """
        SELECT claim_id, min(predicted_verdict) AS verdict FROM has_reviewed
        WHERE predicted_verdict IN ('misinformation', 'factual')
        GROUP BY claim_id HAVING count(DISTINCT predicted_verdict) = 1"""),
    "seed": (["sizes", "agreed", "similar_edge", "article_links"], """
        SELECT DISTINCT s.size, a.claim_id, a.verdict
        FROM sizes s
        JOIN (SELECT claim_id, score FROM similar_edge UNION ALL SELECT claim_id, score FROM article_links) l
          ON l.score > s.threshold
        JOIN agreed a ON a.claim_id = l.claim_id"""),
    "adjacent": (["sizes", "links"], """
        SELECT DISTINCT s.size, a.claim_id AS a, b.claim_id AS b
        FROM sizes s
        JOIN links a ON a.score > s.threshold
        JOIN links b ON b.post_id = a.post_id AND b.score > s.threshold AND b.claim_id <> a.claim_id"""),
    "numbered": (["seed", "adjacent"], """
        SELECT s.size, s.claim_id, row_number() OVER (PARTITION BY s.size ORDER BY s.claim_id) AS rn,
               coalesce((SELECT list(x.b) FROM adjacent x WHERE x.size = s.size AND x.a = s.claim_id AND x.b < s.claim_id), []) AS lower
        FROM seed s"""),
    "walk": (["sizes", "numbered"], """
        SELECT size, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS founded FROM sizes
        UNION ALL
        SELECT w.size, n.rn,
               CASE WHEN list_has_any(n.lower, w.founded) THEN w.founded ELSE list_append(w.founded, n.claim_id) END
        FROM walk w JOIN numbered n ON n.size = w.size AND n.rn = w.rn + 1"""),
    "founders": (["walk"], "SELECT size, unnest(max_by(founded, rn)) AS claim_id FROM walk GROUP BY size"),
    "has_label": (["founders", "adjacent"], """
        SELECT claim_id, claim_id AS label_id, size FROM founders
        UNION ALL
        SELECT x.a, min(x.b), x.size FROM adjacent x
        JOIN founders f ON f.size = x.size AND f.claim_id = x.b
        WHERE NOT EXISTS (SELECT 1 FROM founders g WHERE g.size = x.size AND g.claim_id = x.a)
        GROUP BY x.size, x.a"""),
    "label": (["founders", "seed"], """
        SELECT f.claim_id AS label_id, f.size, s.verdict
        FROM founders f JOIN seed s ON s.size = f.size AND s.claim_id = f.claim_id"""),
    "linked": (["links", "has_label"], f"""
        SELECT post_id, max(score) AS relevance FROM links
        WHERE score > {TAU} AND claim_id IN (SELECT claim_id FROM has_label) GROUP BY post_id"""),
    "users": ([], """
        SELECT c_custkey AS user_id, lower(c_name) AS user_name, CAST(c_nationkey AS BIGINT) AS following_count,
               CAST(floor(abs(c_acctbal)) AS BIGINT) AS followers_count, CAST(length(c_mktsegment) AS BIGINT) AS tweet_count
        FROM customer"""),
    "posts": ([], """
        SELECT o_orderkey AS post_id, o_custkey AS user_id, o_orderdate AS created_at, o_orderpriority AS text,
               o_orderstatus AS lang, CAST(floor(o_totalprice / 50000) AS BIGINT) AS retweet_count,
               CAST(floor(o_totalprice / 20000) AS BIGINT) % 4 AS reply_count,
               CAST(floor(o_totalprice / 30000) AS BIGINT) % 3 AS quote_count
        FROM orders"""),
    "posted": ([], "SELECT o_custkey AS user_id, o_orderkey AS post_id FROM orders"),
    "has_hashtag": ([], "SELECT DISTINCT l_orderkey AS post_id, l_partkey AS name FROM lineitem"),
    "post_mentions": ([], "SELECT DISTINCT l_orderkey AS post_id, l_partkey AS user_id FROM lineitem"),
    "user_mentions": ([], _events_sql("view", f"DISTINCT user_id AS src, {_K} AS tgt", f"AND user_id <> {_K}")),
    "follows": ([], _events_sql("signup", f"DISTINCT user_id AS src, {_K} AS tgt", f"AND user_id <> {_K}")),
    "retweeted": ([], _events_sql("click", f"DISTINCT user_id, {_K} AS post_id")),
    "reply_to": ([], _events_sql("purchase", f"event_id AS reply_id, user_id, {_K} AS post_id")),
    "quote_of": ([], _events_sql("error", f"event_id AS reply_id, user_id, {_K} AS post_id")),
    "replies": (["reply_to", "quote_of"], "SELECT * FROM reply_to UNION ALL SELECT * FROM quote_of"),
    "raw_posts": ([], """
        SELECT *, l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS row_no,
               CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS retweet_count
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""),
    "raw_authors": ([], "SELECT * FROM orders JOIN customer ON c_custkey = o_custkey"),
    "node_post": (["raw_posts"], """
        SELECT * EXCLUDE (n) FROM (
            SELECT l_orderkey AS post_id, 'post ' || o_orderpriority || ' ' || l_returnflag AS text,
                   l_returnflag AS source, l_linestatus AS lang, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
                   CAST(floor(l_extendedprice / 1000) AS BIGINT) AS like_count, retweet_count,
                   CAST(round(l_discount * 100) AS BIGINT) AS reply_count, CAST(round(l_tax * 100) AS BIGINT) AS quote_count,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY 'search-' || l_linenumber, row_no) AS n
            FROM raw_posts) WHERE n = 1
        UNION ALL
        SELECT conv_id * 10 + turn, text, role, NULL, NULL, NULL, NULL, NULL, NULL FROM conversations
        WHERE conv_id * 10 + turn NOT IN (SELECT l_orderkey FROM raw_posts)"""),
    "node_user": (["raw_authors"], """
        SELECT * EXCLUDE (n) FROM (
            SELECT c_custkey AS user_id, lower(c_name) AS user_name, c_acctbal > 0 AS verified, c_mktsegment AS description,
                   c_name AS name, CAST(floor(abs(c_acctbal)) AS BIGINT) AS followers_count,
                   CAST(c_nationkey AS BIGINT) AS following_count, CAST(floor(o_totalprice) AS BIGINT) AS tweet_count,
                   row_number() OVER (PARTITION BY c_custkey ORDER BY 'search-' || o_orderpriority, o_orderkey) AS n
            FROM raw_authors) WHERE n = 1"""),
    "reviewed_texts": ([], """
        SELECT 'claim ' || d.doc_id AS claim,
               strftime(TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 30 AS INT)), '%Y-%m-%d') AS date,
               d.source AS source, d.source AS reviewer, d.lang AS language, d.text AS raw_verdict,
               CASE WHEN d.lang = 'en' THEN d.text ELSE d.source || ' ' || l.quality END AS raw_verdict_en,
               CASE WHEN l.toxic = 1 THEN 'misinformation' WHEN l.quality = 1 THEN 'factual' ELSE 'other' END AS verdict,
               d.doc_id
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""),
    "dated_documents": ([], """
        SELECT doc_id AS post_id,
               TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INT)) + to_hours(CAST(doc_id % 24 AS INT)) AS created_at,
               text, lang, source, n_chars
        FROM documents"""),
    "dated_passages": ([], """
        SELECT item_id AS claim_id, 'desk-' || (item_id % 3) AS reviewer,
               TIMESTAMP '2024-01-03' + to_days(CAST(item_id % 30 AS INT)) AS date, text
        FROM benchmark"""),
}


def with_views(body: str, *names: str) -> str:
    """``body`` behind a WITH clause of the named views and all they use. Views that are
    used more than once are computed once."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in SQL[name][0]:
                visit(other)
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    parts = ", ".join(f"{n} AS {'' if n == 'walk' else 'MATERIALIZED '}({SQL[n][1]})" for n in order)
    return f"WITH RECURSIVE {parts} {body}"
