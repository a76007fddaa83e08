"""One small run from landed tables to the release."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimweave import jobs
from claimweave.sources import archive, pages
from claimweave.tables import Tables


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: [(x is None, x) for x in r])


def page(posts, users):
    return json.dumps({"data": posts, "includes": {"users": users}, "meta": {"result_count": len(posts)}})


def post(i, author, text, day, **more):
    return {"id": str(i), "author_id": str(author), "text": text, "created_at": f"2021-01-{day:02d}T10:00:00Z",
            "public_metrics": {"retweet_count": 9, "reply_count": 2, "quote_count": 1}, "conversation_id": str(i), **more}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    link = {"entities": {"urls": [{"url": "s", "expanded_url": "http://news/a?x=1"}], "hashtags": [{"tag": "Moon"}], "mentions": [{"username": "cy", "id": "3"}]}}
    posts = [
        post(1, 1, "the moon is made of green cheese", 4, **link),
        post(2, 2, "moon made of green cheese says the king", 5, **{"entities": {"hashtags": [{"tag": "moon"}]}}),
        post(4, 3, "nothing to see", 4, **{"entities": {"hashtags": [{"tag": "MOON"}]}}),
    ]
    users = [{"id": str(i), "username": n} for i, n in ((1, "Ann"), (2, "bob"), (3, "Cy"))]
    landed = spark.createDataFrame([("moon cheese", 0, page(posts, users))], "query string, page_no bigint, page string")
    archive = f"{root}/archive"
    assert jobs.fetch_posts(landed, archive, "desk") == 1
    assert jobs.fetch_posts(landed, archive, "desk") == 0

    t = Tables(spark, f"{root}/graph")
    jobs.populate(t, archive)
    jobs.populate(t, archive)

    folder = root / "claims"
    folder.mkdir()
    claim = lambda text, day, verdict: {"claim": text, "date": f"2021-01-{day:02d}T00:00:00Z", "source": "s", "reviewer": "desk.org",
                                        "language": "en", "raw_verdict": "x", "raw_verdict_en": "x", "predicted_verdict": verdict}
    pd.DataFrame([claim("The moon is made of green cheese", 6, "misinformation"), claim("Moon made of green cheese says the king", 7, "misinformation"),
                  claim("Water is wet", 6, "factual")]).to_csv(folder / "desk.org.csv", index=False)
    jobs.create_claims(t, str(folder))
    pd.DataFrame([{"claim": "The moon is made of green cheese", "label": "moon", "label_single": "m", "cluster": 1}]).to_csv(root / "clusters.csv", index=False)
    jobs.add_claim_clusters(t, str(root / "clusters.csv"))

    html = "<html><head><title>Moon</title><meta name='date' content='2021-01-05'></head><p>The moon is made of green cheese</p></html>"
    jobs.create_articles(t, spark.createDataFrame([("http://news/a?x=1", html), ("http://unknown/", html)], "url string, html string"))
    return t, root


def test_the_whole_run(spark, graph):
    t, root = graph
    assert rows(t.read("post"), "post_id") == [(1,), (2,), (4,)]
    assert rows(t.read("post_has_hashtag"), "src", "tgt") == [(1, "moon"), (2, "moon"), (4, "moon")]
    assert rows(t.read("url_is_article"), "src", "tgt") == [("http://news/a?x=1", "http://news/a")]
    assert rows(t.read("claim"), "claim", "cluster") == [
        ("Moon made of green cheese says the king", None), ("The moon is made of green cheese", 1), ("Water is wet", None)]

    none = spark.createDataFrame([], "text string, target string, translated string")

    def backend(texts, target):
        return list(texts)

    jobs.translate_posts(t, none, backend)
    jobs.translate_claims(t, none, backend)
    jobs.translate_articles(t, none, backend)
    assert jobs.summarise_articles(t) == 1 and jobs.summarise_articles(t) == 0
    words = ["moon", "green", "king", "water", "wet", "nothing"]

    def encode(texts):
        return [[float(w in x) for w in words] for x in texts]

    assert jobs.embed_posts(t, encoder=encode) == 3 and jobs.embed_posts(t, encoder=encode) == 0
    assert jobs.embed_claims(t, encoder=encode) == 3 and jobs.embed_articles(t, encoder=encode) == 1

    assert jobs.link_nodes(t) == 4
    assert jobs.link_nodes(t) == 4
    assert jobs.link_nodes(t, "article") == 2
    with pytest.raises(ValueError):
        jobs.link_nodes(t, "image")
    jobs.link_via_articles(t)
    jobs.add_label_nodes(t)
    jobs.train_val_test_split(t)
    # At 0.8 and 0.75 no post links both claims, so each founds its label.
    assert rows(t.read("label").groupBy("size").count(), "size", "count")[-1][0] == "small"

    jobs.populate_follows(t, spark.createDataFrame([(9, 1, 1)], "src bigint, tgt bigint, anchor bigint"))
    jobs.populate_retweets(t, spark.createDataFrame([(8, 1)], "user_id bigint, post_id bigint"))
    jobs.populate_replies(t, spark.createDataFrame([(70, 8, 1), (71, 7, 1)], "reply_id bigint, user_id bigint, post_id bigint"))
    jobs.populate_replies(t, spark.createDataFrame([(72, 7, 2)], "reply_id bigint, user_id bigint, post_id bigint"), "quote_of")
    assert rows(jobs.timeline_worklist(t), "user_id", "kind") == [(7, 2), (8, 1), (9, 3)]
    jobs.populate_timelines(t, spark.createDataFrame([(30, 9), (31, 7)], "post_id bigint, user_id bigint"))
    assert rows(jobs.timeline_worklist(t), "user_id", "kind") == [(8, 1)]
    assert rows(jobs.follow_worklist(t), "user_id") == [(2,)]
    assert jobs.reply_worklist(t).count() == 0
    assert rows(jobs.retweet_worklist(t), "post_id") == [(2,)]

    out = f"{root}/release"
    written = jobs.dump_database(t, out)
    assert len(written) == 11
    read = lambda n: spark.read.parquet(f"{out}/{n}")
    assert rows(read("post"), "post_id") == [(1,), (2,), (4,), (30,), (31,)]
    assert rows(read("reply"), "post_id") == [(71,), (72,)]
    assert rows(read("user"), "user_id") == [(8,), (9,)]
    assert rows(read("reply_reply_to_post"), "src", "tgt") == [(71, 1)]
    assert rows(read("reply_quote_of_post"), "src", "tgt") == [(72, 2)]
    assert rows(read("user_follows_user"), "src", "tgt") == [(9, 1)]
    assert rows(read("article"), "url") == [("http://news/a",)]
    assert read("post_discusses_claim").filter("relevance <= 0.7").count() == 0
    claims = read("claim")
    assert claims.count() == 2 and dict(claims.dtypes)["large_val_mask"] == "boolean"
    assert claims.filter("large_train_mask IS NULL").count() == 0
    ids = {r.claim_id for r in claims.collect()}
    assert {r.tgt for r in read("post_discusses_claim").collect()} <= ids

    jobs.dump_cosine_similarities(t, f"{root}/scores")
    jobs.dump_claim_embeddings(t, f"{root}/vectors")
    assert spark.read.parquet(f"{root}/vectors").count() == 2
    jobs.dump_ego_networks(t, f"{root}/ego")
    assert rows(spark.read.csv(f"{root}/ego/pos_node", header=True), "cluster", "user_id") == [(1, "1"), (1, "2")]
    assert (root / "ego" / "unrelated" / "graph").exists() and (root / "ego" / "graph").exists()
    jobs.cache_post_embeddings(t, f"{root}/cache")
    assert "embedding" not in t.read("post").columns and spark.read.parquet(f"{root}/cache").count() == 3


def test_facts(spark, tmp_path):
    claims = [{"text": f"c{i}", "claimDate": "2021-01-01", "claimReview": [{"publisher": {"site": "a.org"}, "languageCode": "fr", "textualRating": "Faux"}]} for i in range(3)]
    df = spark.createDataFrame([(json.dumps({"claims": claims}),)], "response string")
    memory = spark.createDataFrame([("Faux", "en", "False")], "text string, target string, translated string")
    assert jobs.fetch_facts(df, str(tmp_path / "f"), memory).count() == 3
    assert jobs.fetch_facts(df, str(tmp_path / "f"), memory).count() == 0
    assert rows(spark.read.parquet(str(tmp_path / "f")), "claim", "raw_verdict_en")[0] == ("c0", "False")
    assert rows(jobs.build_reviewer_list(df), "reviewer") == [("a.org",)]


def test_posts_for_claims(spark):
    claims = spark.createDataFrame([(1, "desk", dt.datetime(2021, 1, 5), "green cheese")], "claim_id bigint, reviewer string, date timestamp, text string")
    posts = spark.createDataFrame(
        [(1, dt.datetime(2021, 1, 5, 20), "so much green cheese here", False, True), (2, dt.datetime(2021, 1, 6), "green cheese", False, True),
         (3, dt.datetime(2021, 1, 4), "green", True, True)],
        "post_id bigint, created_at timestamp, text string, is_reply boolean, shares_content boolean",
    )
    got = rows(jobs.fetch_posts_for_claims(claims, posts), "reviewer", "term", "post_id")
    assert got == [("desk", "cheese", 1), ("desk", "green", 1), ("desk", "green cheese", 1)]


def test_predicted_verdicts(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.replace("has_reviewed", spark.createDataFrame([("a", "c", "false")], "reviewer string, claim string, raw_verdict_en string"))
    ann = spark.createDataFrame([("true", "factual"), ("false", "misinformation"), ("satire", "other")] * 4, "raw_verdict string, verdict string")
    jobs.add_predicted_verdicts(t, jobs.train(ann))
    assert rows(t.read("has_reviewed"), "predicted_verdict") == [("misinformation",)]


def test_facts_are_loaded(spark, tmp_path):
    claims = [{"text": f"c{i}", "claimDate": "2021-01-01", "claimReview": [{"publisher": {"site": site}, "textualRating": "No"}]}
              for i, site in enumerate(["a.org", "it's 100%: b/c", "007"])]
    df = spark.createDataFrame([(json.dumps({"claims": claims}),)], "response string")
    for left in (3, 0):
        assert jobs.fetch_facts(df, str(tmp_path / "f")).count() == left
        t = Tables(spark, str(tmp_path / "g"))
        jobs.create_claims(t, str(tmp_path / "f"))
        assert rows(t.read("has_reviewed"), "reviewer", "claim") == [("007", "c2"), ("a.org", "c0"), ("it's 100%: b/c", "c1")]


def test_a_failed_fetch_is_repaired(spark, tmp_path, monkeypatch):
    searches = ["don't panic", "a:b/c 100%", "#tag"]
    landed = spark.createDataFrame(
        [(q, 0, page([post(i, i, "x", 4)], [{"id": str(i), "username": f"u{i}"}])) for i, q in enumerate(searches, 1)],
        "query string, page_no bigint, page string")
    root = str(tmp_path / "a")
    whole = pages.flatten_api_pages

    def broken(named):
        made = whole(named)
        yield "tweets", made["tweets"]
        raise OSError("lost")

    class Broken:
        def __init__(self, named):
            self.named = named

        def items(self):
            return broken(self.named)

    monkeypatch.setattr(pages, "flatten_api_pages", Broken)
    with pytest.raises(OSError):
        jobs.fetch_posts(landed, root)
    monkeypatch.setattr(pages, "flatten_api_pages", whole)
    assert jobs.fetch_posts(landed, root) == 3 and jobs.fetch_posts(landed, root) == 0
    got = archive.read_archive(spark, root)
    assert rows(got["tweets"], "id") == rows(got["authors"], "id") == [("1",), ("2",), ("3",)]
    assert rows(got["tweets"], "query") == [("-a:b/c_100%",), ("-don't_panic",), ("-hashtag_tag",)]


def test_stored_columns_stay(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    some = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("post_id"), F.lit("t").alias("text"))
    t.insert("post", some(0, 5), ["post_id"])
    for n in range(1, 6):
        t.fill_property("post", some(0, 5 * n).select("post_id", F.array(F.lit(1.0)).alias("embedding")), "post_id")
        t.insert("post", some(0, 5 * n + 5), ["post_id"])
        got = t.read("post")
        assert got.count() == 5 * n + 5 and got.filter("embedding IS NOT NULL").count() == 5 * n
    assert got.columns == ["post_id", "text", "embedding"]
    # A rewrite that fails leaves the table as it was.
    with pytest.raises(Exception):
        t.replace("post", got.withColumn("text", F.raise_error(F.lit("lost"))))
    assert t.read("post").count() == got.count()
    t.drop("post", "post")
    assert not t.exists("post")


def test_claims_landed_again_keep_their_properties(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "g"))
    folder = tmp_path / "claims"
    folder.mkdir()
    land = lambda rows_: pd.DataFrame(rows_, columns=["claim", "date", "source", "reviewer", "language", "raw_verdict"]).to_csv(folder / "a.csv", index=False)
    land([("c1", "2021-01-01", "s", "a", "en", "No"), ("c2", "2021-01-01", "s", "a", "en", "No")])
    jobs.create_claims(t, str(folder))
    t.set_property("claim", t.read("claim").select("claim_id", F.lit("en").alias("claim_en")), "claim_id")
    land([("c1", "2021-02-01", "other", "a", "en", "Yes"), ("c3", "2021-01-01", "s", "a", "en", "No")])
    jobs.create_claims(t, str(folder))
    assert rows(t.read("claim"), "claim", "source", "claim_en") == [("c1", "other", "en"), ("c2", "s", "en"), ("c3", "s", None)]
    assert rows(t.read("has_reviewed"), "claim", "raw_verdict") == [("c1", "Yes"), ("c2", "No"), ("c3", "No")]


def test_one_embedding_space(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    texts = ["green cheese on the moon", "water is wet today", "the king says nothing"]
    t.insert("post", spark.createDataFrame(list(enumerate(texts)), "post_id bigint, text string"), ["post_id"])
    assert jobs.embed_posts(t, column="text") == 3
    t.insert("post", spark.createDataFrame([(9, texts[0])], "post_id bigint, text string"), ["post_id"])
    t.insert("claim", spark.createDataFrame([(1, texts[0])], "claim_id bigint, claim string"), ["claim_id"])
    assert jobs.embed_posts(t, column="text") == 1 and jobs.embed_claims(t, column="claim") == 1
    # Each pass has its own version of the word weights; before linking all vectors go to the newest.
    assert {r.embedding_version for r in t.read("post").collect()} == {1, 2} and jobs.refresh_embeddings(t) == 4
    vector = {r.post_id: r.embedding for r in t.read("post").collect()}
    assert any(vector[0]) and vector[0] == pytest.approx(vector[9]) == t.read("claim").first().embedding
