"""The steps of a run, from landed files to the release. Each takes the graph tables, does
one set-based job and can be run again: finished work is skipped unless
``start_from_scratch``.

Posts, users and articles carry the ids and keys of :mod:`claimweave.operators.nodes`;
claims and articles get ``claim_id`` / ``article_id`` as a hash of their key.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.functions.claims import LINK_THRESHOLD, SIZES, parse_date
from claimweave.operators import annotation, attempts, ego, expansion, filters, frontier, labels, linking, models, nodes, terms
from claimweave.operators import translate as tr
from claimweave.operators.keyed import broken_keys
from claimweave.session import cut_lineage
from claimweave.sources import archive, pages, release
from claimweave.tables import Tables

NODE_KEYS = {
    "post": ["post_id"], "user": ["user_id"], "hashtag": ["name"], "url": ["name"], "media": ["media_id"],
    "place": ["place_id"], "poll": ["poll_id"], "conversation": ["conversation_id"],
}
#: Table and column of each key that must be unique. Accounts that share a name are kept and only reported.
UNIQUE = {
    "post": ("post", "post_id"), "user_id": ("user", "user_id"), "user_name": ("user", "user_name"), "hashtag": ("hashtag", "name"),
    "url": ("url", "name"), "media": ("media", "media_id"), "place": ("place", "place_id"), "poll": ("poll", "poll_id"),
    "conversation": ("conversation", "conversation_id"), "claim": ("claim", "claim"), "reviewer": ("reviewer", "url"), "article": ("article", "url"),
}
REPORTED = ("user_name",)
#: Counts behind the word weights, one row per pass over posts, claims or articles.
_COUNTS = "embedding_counts"
_COUNT = "version bigint, source string, n_docs bigint, n_with array<bigint>"
#: Tables with embeddings and their keys.
EMBEDDED = {"post": "post_id", "claim": "claim_id", "article": "article_id"}
_EDGE = "src bigint, tgt bigint"
_LINK = "post_id bigint, claim_id bigint, score double"
_ARTICLE_LINK = "article_id bigint, claim_id bigint, score double"
_REPLY = "reply_id bigint, user_id bigint, post_id bigint"


# Claims and posts from landed responses.


def fetch_facts(responses: DataFrame, path: str, memory: DataFrame | None = None, backend=None) -> DataFrame:
    """Claim search responses -> claim files per reviewer, new reviewers only. Reviewers
    with too many undated claims are an error."""
    claims = filters.dated_claims(pages.flatten_claim_search(responses))
    if memory is not None:
        claims = tr.review_verdicts(claims, memory, backend)
    return release.append_new_reviewers(claims, path)


def build_reviewer_list(responses: DataFrame) -> DataFrame:
    """Distinct reviewers over many searches."""
    return pages.flatten_claim_search(responses).select("reviewer").dropna().distinct()


def fetch_posts(api_pages: DataFrame, root: str, prefix: str = "") -> int:
    """API pages -> archive tables with one folder per search; finished searches are skipped.
    Returns the number of searches written.

    A search is finished once the table ``done`` names it, which is written last. Each table
    overwrites the folders of the searches at hand, so a run that failed half way is repaired
    by the next one and nothing is there twice. A search with a page of an unexpected error is noted in
    the table ``attempts`` and is not finished until it was tried :data:`attempts.MOST` times.
    """
    spark = api_pages.sparkSession
    done = Tables(spark, root)
    named = api_pages.withColumn("query", text.folder_name(F.lower("query"), prefix))
    if done.exists("done"):
        named = named.join(done.read("done"), "query", "left_anti")
    named = cut_lineage(named)
    for name, df in pages.flatten_api_pages(named).items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("query").parquet(f"{root}/{name}")
    said = pages.page_errors(named).groupBy("query").agg(F.max("detail").alias("error"))
    tried = cut_lineage(named.select("query").distinct().join(said, "query", "left"))
    record(done, "fetch_posts", tried, "query")
    failing = done.read("attempts").filter("job = 'fetch_posts'").join(attempts.given_up(done.read("attempts")), ["job", "key"], "left_anti")
    searches = cut_lineage(tried.join(failing.select(F.col("key").alias("query")), "query", "left_anti").select("query"))
    done.insert("done", searches, ["query"])
    return searches.count()


# Failures.


def record(t: Tables, job: str, results: DataFrame, key: str) -> None:
    """Note the ``results(key, error)`` of a pass in the table ``attempts``."""
    noted = cut_lineage(results.select(F.lit(job).alias("job"), F.col(key).cast("string").alias("key"), "error"))
    t.rewrite("attempts", lambda ledger: attempts.fold(ledger, noted), attempts.LEDGER)


def rejects(t: Tables, most: int = attempts.MOST) -> DataFrame:
    """``(job, key, tries, error)`` of what is not tried any more."""
    return attempts.given_up(t.get("attempts", attempts.LEDGER), most)


def _open(t: Tables, job: str, rest: DataFrame, key: str) -> DataFrame:
    return attempts.open_work(rest, key, t.get("attempts", attempts.LEDGER), job)


def fetch_posts_for_claims(claims: DataFrame, posts: DataFrame, top_n: int = 5) -> DataFrame:
    """Posts that match a keyword of a claim in its window, per reviewer and keyword."""
    words = terms.keywords(claims, "claim_id", "text", top_n)
    return terms.search_by_keywords(claims, cut_lineage(words), posts)


# Graph load.


def audit_keys(t: Tables) -> DataFrame:
    """``(key, n_keys, n_rows, example)`` of every unique key that is broken in the tables that are there."""
    stacked = {k: t.read(name).select(column) for k, (name, column) in UNIQUE.items() if t.exists(name) and column in t.read(name).columns}
    return broken_keys(t.spark, stacked)


def check_keys(t: Tables) -> None:
    """The broken keys go to the table ``broken_keys``; any but a reported one is an error that names all."""
    found = t.replace("broken_keys", audit_keys(t)).orderBy("key").collect()  # at most one row a key
    wrong = [f"{r.key}: {r.n_keys}, for instance {r.example!r}" for r in found if r.key not in REPORTED]
    if wrong:
        raise ValueError("keys that are not unique: " + "; ".join(wrong))


def populate(t: Tables, archive_root: str, start_from_scratch: bool = False, min_retweets: int = 5, queries: list[str] | None = None) -> None:
    """Archive folders (also those of :func:`fetch_posts`) -> node and edge tables; ids that are
    there already win. Each landed
    file is parsed once. Rows with more cells than their header go to ``rejected_<table>``."""
    landed = {name: cut_lineage(archive.read_cells(t.spark, archive_root, name)) for name in archive.LOADED}
    for name, df in landed.items():
        t.replace(f"rejected_{name}", archive.rejected(df))
    load(t, {name: archive.accepted(df) for name, df in landed.items()}, start_from_scratch, min_retweets, queries)


def load(t: Tables, dfs: dict[str, DataFrame], start_from_scratch: bool = False, min_retweets: int = 5, queries: list[str] | None = None) -> None:
    if queries is not None:
        dfs = {n: df.filter(F.col("query").isin(queries)) for n, df in dfs.items()}
    dfs = {n: cut_lineage(df) for n, df in filters.referenced(dfs, min_retweets).items()}
    fresh = nodes.archive_nodes(dfs)
    if start_from_scratch:
        t.drop(*fresh)
    stored = {name: t.insert(name, df, NODE_KEYS[name]) for name, df in fresh.items()}
    for name, df in nodes.archive_edges(dfs, stored).items():
        if start_from_scratch:
            t.drop(name)
        t.insert(name, df, ["src", "tgt"])
    check_keys(t)


def create_claims(t: Tables, folder: str, start_from_scratch: bool = False) -> None:
    """Claim files (also those of :func:`fetch_facts`) -> claims, reviewers and reviews; the last row wins. A claim that is there
    already gets the landed columns and keeps its others (translation, cluster, embedding)."""
    if start_from_scratch:
        t.drop("claim", "reviewer", "has_reviewed")
    made = nodes.claim_tables(archive.read_claims(t.spark, folder))
    claims = made["claim"].withColumn("claim_id", F.xxhash64("claim")).withColumn("date", parse_date(F.col("date")))
    reviews = made["has_reviewed"].withColumn("claim_id", F.xxhash64("claim"))
    for name, df, keys in (
        ("claim", claims, ["claim"]), ("reviewer", made["reviewer"], ["url"]), ("has_reviewed", reviews, ["reviewer", "claim"])
    ):
        t.update(name, df.dropna(subset=keys), keys)
    check_keys(t)


def add_claim_clusters(t: Tables, path: str) -> None:
    clusters = archive.read_claim_clusters(t.spark, path)

    def attach(claims: DataFrame) -> DataFrame:
        claims = claims.drop("keywords", "cluster_keywords", "cluster")
        if "claim_en" not in claims.columns:
            claims = claims.withColumn("claim_en", F.col("claim"))
        return nodes.attach_clusters(claims, clusters)

    t.rewrite("claim", attach)


def create_articles(t: Tables, landed: DataFrame, start_from_scratch: bool = False, skip_preparse: bool = False) -> None:
    """Landed pages of known URLs -> articles and their edges."""
    if start_from_scratch:
        t.drop("article", "url_is_article", "article_has_top_image")
    made = nodes.article_tables(landed, t.read("url"), skip_preparse)
    articles = made["article"].withColumn("article_id", F.xxhash64("url"))
    t.insert("article", articles, ["url"])
    t.insert("url_is_article", made["url_is_article"], ["src", "tgt"])
    t.insert("article_has_top_image", made["article_has_top_image"], ["src", "tgt"])
    t.insert("url", made["url"], ["name"])
    check_keys(t)


# Text jobs. A row that has its output already is left alone.


def _rest(t: Tables, name: str, needs: list[str], out: str, start_from_scratch: bool, flag: str | None = None) -> DataFrame:
    df = t.read(name)
    if start_from_scratch and out in df.columns:
        df = t.rewrite(name, lambda stored: stored.drop(out))
    if out not in df.columns:
        df = df.withColumn(out, F.lit(None).cast("string"))
    if flag and flag not in df.columns:
        flag = None
    return filters.worklist(df, needs, out, flag)


def add_embedding_counts(t: Tables, counts: DataFrame, source: str) -> int:
    """Add the counts of a pass (:func:`models.count_terms`) as a new version of the word weights; returns
    its number. Passes at the same time get versions of their own."""
    pass_id = uuid.uuid4().hex
    tagged = cut_lineage(counts.select(F.concat_ws("/", F.lit(source), F.lit(pass_id)).alias("source"), "n_docs", "n_with"))

    def add(stored: DataFrame) -> DataFrame:
        last = stored.agg(F.max("version")).first()[0] or 0
        return stored.unionByName(tagged.withColumn("version", F.lit(last + 1).cast("long")))

    rows = t.rewrite(_COUNTS, add, _COUNT)
    return rows.filter(F.endswith("source", F.lit(pass_id))).first().version


def _forget_counts(t: Tables, source: str) -> None:
    """Take the counts of a table's earlier passes back, before all its texts are counted anew."""
    mine = t.get(_COUNTS, _COUNT).filter(F.substring_index("source", "/", 1) == source)
    past = models.add_counts(mine)
    if not mine.isEmpty():
        add_embedding_counts(t, past.select((-F.col("n_docs")).alias("n_docs"), F.transform("n_with", lambda n: -n).alias("n_with")), source)


def embedding_weights(t: Tables) -> DataFrame:
    """``(version, weights)`` of every version: its counts are those of all passes up to it."""
    cells = t.read(_COUNTS).select("version", "n_docs", F.posexplode("n_with").alias("at", "n"))
    upto = Window.partitionBy("at").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    weight = models.weight(F.sum("n_docs").over(upto), F.sum("n").over(upto))
    found = cells.select("version", F.struct("at", weight.alias("w")).alias("cell")).groupBy("version").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return found.select("version", F.transform("cells", lambda c: c["w"]).alias("weights"))


def refresh_embeddings(t: Tables) -> int:
    """Bring the vectors of posts, claims and articles that were made under earlier word weights to the
    newest ones, so that all of them compare; returns how many were moved. Vectors of a model of one's own have no
    version and stay."""
    if not t.exists(_COUNTS):
        return 0
    weights = cut_lineage(embedding_weights(t))
    newest, moved = weights.agg(F.max("version")).first()[0], 0
    for name in EMBEDDED:
        if t.exists(name) and "embedding_version" in t.read(name).columns:
            stale = t.read(name).filter(F.col("embedding").isNotNull() & (F.col("embedding_version") < newest)).count()
            if stale:
                t.rewrite(name, lambda stored: models.reweigh(stored, weights, newest))
            moved += stale
    return moved


def _embed(t: Tables, name: str, source: str, clean, start_from_scratch: bool, dimensions: int = 512, **options) -> int:
    """New vectors of a table. Each pass adds the word counts of its texts; with ``encoder`` or
    ``load_encoder`` the vectors are that model's and no counts are kept."""
    key = EMBEDDED[name]
    if start_from_scratch:
        _forget_counts(t, name)
    rest = _open(t, f"embed_{name}", _rest(t, name, [source], "embedding", start_from_scratch), key)
    rest = cut_lineage(rest.select(key, F.col(source).alias("doc")))
    n, version = rest.count(), F.lit(None).cast("long")
    if n:
        if not options.keys() & {"encoder", "load_encoder"}:
            counts = models.count_terms(rest.select(clean(F.col("doc")).alias("doc")), "doc", dimensions)
            number = add_embedding_counts(t, counts, name)
            options = {"weights": models.term_weights(t.read(_COUNTS).filter(F.col("version") <= number))}
            version = F.lit(number).cast("long")
        else:
            options["error"] = "error"
        made = models.embed(rest, "doc", clean, **options)
        if "error" in options:
            made = cut_lineage(made)
            record(t, f"embed_{name}", made, key)
        vectors = made.select(key, "embedding", version.alias("embedding_version"))
        stored = t.read(name)
        if start_from_scratch and "embedding_version" in stored.columns:
            t.rewrite(name, lambda stored: stored.drop("embedding_version"))
        t.fill_property(name, vectors, key)
    return n


def embed_posts(t: Tables, start_from_scratch: bool = False, column: str = "text_en", **options) -> int:
    return _embed(t, "post", column, text.clean_post, start_from_scratch, **options)


def embed_claims(t: Tables, start_from_scratch: bool = False, column: str = "claim_en", **options) -> int:
    return _embed(t, "claim", column, text.clean_plain, start_from_scratch, **options)


def embed_articles(t: Tables, start_from_scratch: bool = False, column: str = "summary", **options) -> int:
    return _embed(t, "article", column, text.clean_plain, start_from_scratch, **options)


def _translate(t: Tables, name: str, key: str, source: str, out: str, memory: DataFrame, backend) -> None:
    """Texts that the backend fails on are noted, tried again in later passes, and then left."""
    job = f"translate_{name}_{source}"
    rest = _open(t, job, _rest(t, name, [source], out, False), key).select(key, source)
    done = cut_lineage(tr.translate_to(rest, source, memory, out, "en", backend, "error").select(key, out, "error"))
    t.fill_property(name, done.select(key, out), key)
    if backend is not None:
        record(t, job, done, key)


def translate_posts(t: Tables, memory: DataFrame, backend=None) -> None:
    _translate(t, "post", "post_id", "text", "text_en", memory, backend)


def translate_claims(t: Tables, memory: DataFrame, backend=None) -> None:
    _translate(t, "claim", "claim_id", "claim", "claim_en", memory, backend)


def translate_articles(t: Tables, memory: DataFrame, backend=None) -> None:
    """Titles at once, contents line by line; contents with an untranslatable line are
    flagged and not tried again. Those that the backend failed on are among the :func:`rejects` at once."""
    _translate(t, "article", "article_id", "title", "title_en", memory, backend)
    rest = _rest(t, "article", ["content"], "content_en", False, "not_translatable").select("article_id", "content")
    done = cut_lineage(tr.translate_lines(rest, "article_id", "content", memory, "content_en", "en", backend, "error"))
    t.fill_property("article", done.drop("error"), "article_id")
    if backend is not None:
        for _ in range(attempts.MOST):
            record(t, "translate_article_content", done, "article_id")


def summarise_articles(t: Tables, start_from_scratch: bool = False, max_tokens: int = 512) -> int:
    rest = _rest(t, "article", ["title_en", "content_en"], "summary", start_from_scratch)
    docs = cut_lineage(rest.select("article_id", text.join_title(F.col("title_en"), F.col("content_en")).alias("doc")))
    n = docs.count()
    if n:
        t.fill_property("article", terms.summaries(docs, "article_id", "doc", max_tokens), "article_id")
    return n


def train(annotations: DataFrame) -> PipelineModel:
    return models.train_verdict_classifier(annotations)


def expand_verdicts(annotations: DataFrame, memory: DataFrame, backend=None) -> DataFrame:
    return annotation.expand_annotations(annotations, memory, backend=backend)


def add_predicted_verdicts(t: Tables, model: PipelineModel) -> None:
    old = ("predicted_verdict", "predicted_verdict_confidence")
    t.rewrite("has_reviewed", lambda reviews: models.predict_verdicts(model, reviews.drop(*old)))


# Links, labels, split.


def link_nodes(t: Tables, node_type: str = "post", start_from_scratch: bool = False, threshold: float = LINK_THRESHOLD) -> int:
    """Links of all claims that have none of the kind yet; returns the number of links. Vectors of
    earlier passes are brought to the newest word weights first."""
    if node_type not in ("post", "article"):
        raise ValueError(f"unknown node type {node_type!r}")
    key, name = f"{node_type}_id", f"{node_type}_similar_claim"
    if start_from_scratch:
        t.drop(name)
    refresh_embeddings(t)
    claims = t.read("claim")
    if t.exists(name):
        claims = linking.unlinked_claims(claims, t.read(name), threshold)
    items = t.read(node_type)
    when = parse_date(F.col("created_at" if node_type == "post" else "publish_date"))
    if "not_parseable" in items.columns:
        items = items.filter("not_parseable IS NULL")
    items = items.select(F.col(key).alias("item_id"), when.alias("created_at"), "embedding")
    links = linking.link_by_cosine(claims, items, threshold).withColumnRenamed("item_id", key)
    return t.insert(name, links, [key, "claim_id"]).count()


def link_via_articles(t: Tables) -> None:
    """Post -> claim links through the articles that posts link to."""
    links_to = t.read("post_links_to_url").select(F.col("src").alias("post_id"), F.col("tgt").alias("url"))
    ids = t.read("article").select(F.col("url").alias("tgt"), "article_id")
    is_article = t.read("url_is_article").join(ids, "tgt").select(F.col("src").alias("url"), "article_id")
    found = linking.links_via_articles(links_to, is_article, t.get("article_similar_claim", _ARTICLE_LINK))
    t.replace("post_similar_claim_via_article", found)


def all_links(t: Tables) -> DataFrame:
    return linking.best_links(t.get("post_similar_claim", _LINK), t.get("post_similar_claim_via_article", _LINK))


def add_label_nodes(t: Tables, sizes: dict[str, float] = SIZES, priority: str = "id") -> None:
    direct = t.get("post_similar_claim", _LINK).select("claim_id", "score").unionByName(
        t.get("article_similar_claim", _ARTICLE_LINK).select("claim_id", "score")
    )
    seeds = labels.label_seeds(direct, t.read("has_reviewed"), sizes)
    labs, has_label = labels.propagate_labels(cut_lineage(all_links(t)), seeds, sizes, priority)
    t.replace("label", labs)
    t.replace("has_label", has_label)


def train_val_test_split(t: Tables) -> None:
    has_label, claims = t.read("has_label"), t.read("claim")
    t.rewrite("label", lambda labs: labels.split_labels(labs.drop("train_mask", "val_mask", "test_mask"), has_label, claims))


# Neighbourhoods.


def _posted(t: Tables) -> DataFrame:
    return t.read("user_posted_post").select(F.col("src").alias("user_id"), F.col("tgt").alias("post_id"))


def _retweeted(t: Tables) -> DataFrame:
    return t.get("user_retweeted_post", _EDGE).select(F.col("src").alias("user_id"), F.col("tgt").alias("post_id"))


def _replies(t: Tables) -> DataFrame:
    return t.get("reply_to", _REPLY).unionByName(t.get("quote_of", _REPLY))


def _follows(t: Tables) -> DataFrame:
    return t.get("user_follows_user", _EDGE)


def follow_worklist(t: Tables) -> DataFrame:
    return frontier.follow_frontier(frontier.posts_above(all_links(t)), _posted(t), _follows(t))


def reply_worklist(t: Tables) -> DataFrame:
    return frontier.reply_frontier(frontier.posts_above(all_links(t)), t.read("post"), _replies(t))


def retweet_worklist(t: Tables) -> DataFrame:
    return frontier.retweet_frontier(frontier.posts_above(all_links(t)), t.read("post"), _retweeted(t))


def timeline_worklist(t: Tables) -> DataFrame:
    linked = linking.linked_posts(all_links(t), t.read("has_label")).select("post_id")
    return frontier.timelines(linked, _posted(t), _retweeted(t), _replies(t), _follows(t))


def populate_follows(t: Tables, landed: DataFrame) -> None:
    """``landed(src, tgt, anchor)`` from follower and followee pages."""
    users, edges = frontier.insert_follows(t.read("user").select("user_id"), _follows(t), landed)
    _add(t, users, edges, "user_follows_user", ["src", "tgt"])


def populate_retweets(t: Tables, landed: DataFrame) -> None:
    users, edges = frontier.insert_retweets(t.read("post"), t.read("user").select("user_id"), _retweeted(t), landed)
    _add(t, users, edges.select(F.col("user_id").alias("src"), F.col("post_id").alias("tgt")), "user_retweeted_post", ["src", "tgt"])


def populate_replies(t: Tables, landed: DataFrame, kind: str = "reply_to") -> None:
    if kind not in ("reply_to", "quote_of"):
        raise ValueError(f"unknown kind {kind!r}")
    users, edges = frontier.insert_replies(t.read("post"), t.read("user").select("user_id"), t.get(kind, _REPLY), landed)
    _add(t, users, edges, kind, ["reply_id", "user_id", "post_id"])


def populate_timelines(t: Tables, landed: DataFrame) -> None:
    posts, edges = frontier.insert_timelines(t.read("post").select("post_id"), t.read("user"), _posted(t), landed)
    posts, edges = cut_lineage(posts), cut_lineage(edges.select(F.col("user_id").alias("src"), F.col("post_id").alias("tgt")))
    t.insert("post", posts, ["post_id"])
    t.insert("user_posted_post", edges, ["src", "tgt"])


def _add(t: Tables, users: DataFrame, edges: DataFrame, name: str, keys: list[str]) -> None:
    users, edges = cut_lineage(users), cut_lineage(edges)
    t.insert("user", users, ["user_id"])
    t.insert(name, edges, keys)


# Release.


def dump_database(t: Tables, path: str, overwrite: bool = False, dump_nodes: bool = True, dump_relations: bool = True, threshold: float = LINK_THRESHOLD) -> list[str]:
    """Write the five node and six relation tables of the release."""
    links, has_label = cut_lineage(all_links(t)), t.read("has_label")
    linked = cut_lineage(linking.linked_posts(links, has_label, threshold))
    posted, retweeted, follows, replies = _posted(t), _retweeted(t), _follows(t), _replies(t)
    tags = t.get("post_has_hashtag", "src bigint, tgt string").select(F.col("src").alias("post_id"), F.col("tgt").alias("name"))
    article_links = t.get("article_similar_claim", _ARTICLE_LINK)
    claims = expansion.claim_release(t.read("claim"), t.read("has_reviewed"), t.read("label"), has_label)
    masks = {c: "boolean" for c in claims.columns if c.endswith("_mask")}
    nodes_out = {
        "post": ([
            expansion.posts_by_hashtag(linked, tags),
            expansion.posts_by_coposter(linked, posted, retweeted),
            expansion.posts_by_followee(linked, posted, follows),
            expansion.posts_by_follower(linked, posted, follows),
            expansion.posts_by_replier(linked, posted, replies),
        ], ["post_id"], {"post_id": "bigint"}),
        "claim": ([claims], ["claim_id"], {"cluster": "string", "date": "timestamp", **masks}),
        "reply": ([expansion.reply_nodes(linked, replies, retweeted)], ["post_id"], {"post_id": "bigint"}),
        "user": ([expansion.retweeters(linked, retweeted), expansion.follow_neighbours(linked, posted, follows)], ["user_id"], {"user_id": "bigint"}),
        "article": (
            [expansion.release_articles(t.get("article", "article_id bigint, url string"), article_links, has_label, threshold)],
            ["id", "url"], {"id": "bigint"},
        ),
    }
    relations = {
        "user_follows_user": [expansion.rel_follows(linked, posted, follows)],
        "user_retweeted_post": [expansion.rel_retweeted(linked, retweeted)],
        "reply_reply_to_post": [expansion.rel_replies(linked, t.get("reply_to", _REPLY), retweeted)],
        "reply_quote_of_post": [expansion.rel_replies(linked, t.get("quote_of", _REPLY), retweeted)],
        "post_discusses_claim": [expansion.post_claims(links, has_label, threshold)],
        "article_discusses_claim": [expansion.article_claims(article_links, has_label, threshold)],
    }
    return release.dump_release(path, nodes_out, relations, overwrite, dump_nodes, dump_relations)


def dump_cosine_similarities(t: Tables, path: str) -> None:
    release.dump_similarities(all_links(t), path)


def dump_claim_embeddings(t: Tables, path: str) -> None:
    release.dump_claim_embeddings(t.read("claim"), all_links(t), path)


def cache_post_embeddings(t: Tables, path: str, overwrite: bool = False) -> None:
    t.rewrite("post", lambda posts: release.cache_embeddings(posts, path, overwrite))


def dump_ego_networks(t: Tables, path: str, top: int = 10, threshold: float = LINK_THRESHOLD) -> None:
    """Mention graphs around the spreaders of the top clusters, and the unrelated rest."""
    posted = _posted(t)
    post_mentions = t.read("post_mentions_user").select(F.col("src").alias("post_id"), F.col("tgt").alias("user_id"))
    user_mentions = t.read("user_mentions_user")
    direct = t.get("post_similar_claim", _LINK).unionByName(t.get("post_similar_claim_via_article", _LINK))
    claims, has_label = t.read("claim"), t.read("has_label")
    scores = ego.cluster_scores(claims, t.read("has_reviewed"), direct, posted, post_mentions, user_mentions, threshold)
    users = cut_lineage(
        ego.spreaders(ego.top_clusters(scores, top), claims, t.read("label"), has_label, direct, posted, threshold)
    )
    edges = cut_lineage(ego.ego_edges(users, posted, post_mentions, user_mentions))
    features = cut_lineage(ego.ego_features(edges, t.read("user")))
    texts = t.read("post").filter("text IS NOT NULL")
    others = cut_lineage(ego.unrelated_edges(texts, posted, post_mentions, user_mentions, features.select("user_id")))
    release.dump_ego_bundles(
        features, edges, users, {"graph": others, "feature": ego.ego_features(others, t.read("user"))}, path
    )
