import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimweave.functions.claims import parse_date
from claimweave.operators import filters, nodes
from claimweave.schemas import ARCHIVE
from claimweave.sources import archive, pages, release


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def write_search(root, name, **tables):
    folder = root / name
    folder.mkdir(parents=True)
    for table, records in tables.items():
        if records is None:
            (folder / f"{table}.csv").write_text("")
        else:
            pd.DataFrame(records).to_csv(folder / f"{table}.csv", index=False)


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    write_search(
        root,
        "desk-a",
        tweets=[
            {"id": 1, "author_id": 5, "text": 'multi\nline, "quoted"', "public_metrics.retweet_count": 9,
             "entities.hashtags": "[{'tag': 'Covid'}, {'tag': None}]", "entities.mentions": "[{'username': 'Ann', 'id': '6'}]",
             "conversation_id": 1, "entities.urls": "[{'url': 'http://s/1', 'expanded_url': 'http://a/x?y=1'}]",
             "attachments.media_keys": "['3_1']", "attachments.poll_ids": "['77']", "geo.place_id": "p1",
             "referenced_tweets": "[{'type': 'quoted', 'id': '2'}]"},
            {"id": 2, "author_id": 6, "text": "rare", "public_metrics.retweet_count": 4},
            {"id": 3, "author_id": 7, "text": "junk count", "public_metrics.retweet_count": "abc"},
        ],
        authors=[
            {"id": 5, "username": "Bob", "verified": True, "public_metrics.followers_count": "12", "profile_image_url": "http://i/5.jpg",
             "entities.description.mentions": "[{'username': 'ANN'}]", "entities.description.hashtags": "[{'tag': 'News'}]"},
            {"id": 6, "username": "ann", "verified": "False"},
            {"id": 7, "username": "Unseen"},
        ],
        media=[{"media_key": "3_1", "type": "photo", "url": "http://i/m.jpg", "preview_image_url": "http://i/p.jpg", "height": 10.0}],
        places=[{"id": "p1", "name": "P", "geo.bbox": "[1.0, 2.0, 3.0, 6.0]"}, {"id": "p2", "name": "Q"}],
        polls=[{"id": 77, "duration_minutes": 60}, {"id": 78, "duration_minutes": 5}],
        replies=[{"id": 9, "conversation_id": 1, "text": "re"}, {"id": 10, "conversation_id": 4, "text": "no"}],
    )
    # Another search lists other columns in another order, holds an empty file and repeats a post.
    write_search(
        root,
        "desk-b",
        tweets=[{"public_metrics.retweet_count": 50, "text": "second copy", "id": 1, "author_id": 5, "lang": "en"},
                {"public_metrics.retweet_count": 6, "text": "own", "id": 8, "author_id": 6, "lang": "de"}],
        authors=[{"username": "bob2", "id": 5}],
        media=None,
        replies=None,
    )
    return str(root)


def test_columns_follow_their_names(spark, landed):
    tweets = archive.read_archive_table(spark, landed, "tweets")
    assert [c for c in tweets.columns[:-2]] == ARCHIVE["tweets"]
    assert rows(tweets, "query", "id", "text", "lang") == sorted([
        ("desk-a", "1", 'multi\nline, "quoted"', None), ("desk-a", "2", "rare", None), ("desk-a", "3", "junk count", None),
        ("desk-b", "1", "second copy", "en"), ("desk-b", "8", "own", "de")], key=repr)
    assert archive.read_archive_table(spark, landed, "media").count() == 1
    assert archive.read_archive_table(spark, landed, "metadata").count() == 0


def test_popular_posts_and_what_they_refer_to(spark, landed):
    dfs = filters.referenced(archive.read_archive(spark, landed))
    assert rows(dfs["tweets"], "id", "query") == [("1", "desk-a"), ("1", "desk-b"), ("8", "desk-b")]
    assert rows(dfs["authors"], "id", "username") == [("5", "Bob"), ("5", "bob2"), ("6", "ann")]
    assert rows(dfs["places"], "id") == [("p1",)]
    assert rows(dfs["polls"], "id") == [("77",)]
    assert rows(dfs["replies"], "id") == [("9",)]


def test_nodes_and_edges(spark, landed):
    dfs = archive.read_archive(spark, landed)
    made = nodes.archive_nodes(dfs)
    posts = {r.post_id: r for r in made["post"].collect()}
    assert sorted(posts) == [1, 2, 3, 8, 9, 10]
    assert posts[1].text == 'multi\nline, "quoted"' and posts[1].retweet_count == 9 and posts[3].retweet_count is None
    users = {r.user_id: r for r in made["user"].collect()}
    assert users[5].user_name == "bob" and users[5].verified is True and users[5].followers_count == 12 and users[6].verified is False
    assert rows(made["hashtag"], "name") == [("covid",), ("news",)]
    assert rows(made["url"], "name") == [("http://a/x?y=1",), ("http://i/5.jpg",), ("http://i/m.jpg",), ("http://i/p.jpg",)]
    place = {r.place_id: r for r in made["place"].collect()}
    assert (place["p1"].lat, place["p1"].lng, place["p2"].lat) == (2.0, 4.0, None)
    edges = {n: rows(df, "src", "tgt") for n, df in nodes.archive_edges(dfs, made).items()}
    assert edges["user_posted_post"] == [(5, 1), (6, 2), (6, 8), (7, 3)]
    assert edges["post_has_hashtag"] == [(1, "covid")] and edges["user_has_hashtag"] == [(5, "news")]
    assert edges["post_mentions_user"] == [(1, 6)] and edges["user_mentions_user"] == [(5, 6)]
    assert edges["post_links_to_url"] == [(1, "http://a/x?y=1")]
    assert edges["user_links_to_url"] == edges["user_has_profile_picture_url"] == [(5, "http://i/5.jpg")]
    assert edges["url_is_media"] == [("http://i/m.jpg", "3_1"), ("http://i/p.jpg", "3_1")]
    assert edges["post_has_media"] == [(1, "3_1")] and edges["post_has_poll"] == [(1, "77")]
    assert edges["post_is_part_of_conversation"] == [(1, 1)] and edges["post_located_in_place"] == [(1, "p1")]
    assert edges["post_references_post"] == [(1, 2)]


def test_user_names_of_several_ids(spark):
    users = spark.createDataFrame([(1, "bob"), (2, "bob"), (3, "ann")], "user_id bigint, user_name string")
    assert rows(nodes.user_name_violations(users), "user_name", "n_rows") == [("bob", 2)]


def test_claim_files(spark, tmp_path):
    a = [{"claim": "c1", "date": "2021-01-01", "source": "s", "reviewer": "a.org", "language": "en", "raw_verdict": "False", "raw_verdict_en": "False"},
         {"claim": "c1", "date": "2021-02-01", "source": "t", "reviewer": "a.org", "language": "en", "raw_verdict": "True", "raw_verdict_en": "True"}]
    b = [{"reviewer": "elsewhere", "claim": "c1", "date": "2021-03-01", "predicted_verdict": "factual", "predicted_verdict_confidence": 0.5}]
    pd.DataFrame(a).to_csv(tmp_path / "a.org.csv", index=False)
    pd.DataFrame(b).to_csv(tmp_path / "b.org.csv", index=False)
    claims = archive.read_claims(spark, str(tmp_path))
    made = nodes.claim_tables(claims)
    assert rows(made["claim"], "claim", "date") == [("c1", "2021-03-01")]
    assert rows(made["reviewer"], "url") == [("a.org",), ("b.org",)]
    assert rows(made["has_reviewed"], "reviewer", "claim", "raw_verdict") == [("a.org", "c1", "True")]
    assert archive.read_claims(spark, str(tmp_path / "none")).count() == 0


def test_clusters(spark, tmp_path):
    pd.DataFrame([{"claim": "x", "label": "L", "label_single": "k", "cluster": 3}, {"claim": "y", "label": "M", "label_single": "m", "cluster": -1}]).to_csv(
        tmp_path / "c.csv", index=False)
    clusters = archive.read_claim_clusters(spark, str(tmp_path / "c.csv"))
    claims = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "claim_id bigint, claim_en string")
    got = rows(nodes.attach_clusters(claims, clusters), "claim_id", "keywords", "cluster_keywords", "cluster")
    assert got == [(1, "k", "L", 3), (2, "k", "L", 3), (3, "m", "", -1), (4, None, None, None)]


def test_lists(spark, tmp_path):
    (tmp_path / "l.yaml").write_text("- am     # Amharic\n- no     # Norwegian\n- zh-CN\n- 'lemonde.fr'\n\n")
    assert rows(archive.read_list(spark, str(tmp_path / "l.yaml")), "value") == [("am",), ("lemonde.fr",), ("no",), ("zh-CN",)]


def test_api_pages(spark):
    page = {
        "data": [{"id": "1", "author_id": "5", "text": "a", "public_metrics": {"retweet_count": 3}, "entities": {"urls": [{"url": "u", "expanded_url": "e"}]}},
                 {"id": "2", "geo": {"place_id": "p"}}],
        "includes": {"users": [{"id": "5", "username": "B", "entities": {"url": {"urls": [{"url": "w"}]}}}], "places": [{"id": "p", "geo": {"bbox": [1, 2, 3, 4]}}]},
        "meta": {"result_count": 2, "newest_id": "2"},
    }
    df = spark.createDataFrame(
        [("q", 0, json.dumps(page)), ("q", 1, json.dumps({"errors": [{"detail": "x"}]})), ("q", 2, json.dumps({"meta": {"result_count": 0}}))],
        "query string, page_no bigint, page string",
    )
    tables = pages.flatten_api_pages(df)
    assert rows(tables["tweets"], "id", "author_id", "`public_metrics.retweet_count`", "`geo.place_id`", "row_no") == [
        ("1", "5", "3", None, 0), ("2", None, None, "p", 1)]
    assert tables["media"].count() == tables["replies"].count() == 0
    assert rows(tables["metadata"], "result_count", "newest_id") == [(2, "2")]
    assert rows(nodes.post_urls(tables["tweets"]), "src", "tgt") == [(1, "e")]
    assert rows(nodes.user_urls(tables["authors"]), "src", "tgt") == [(5, "w")]
    assert [r.lat for r in nodes.place_nodes(tables["places"]).collect()] == [2.0]


def test_id_pages(spark):
    df = spark.createDataFrame(
        [(7, json.dumps({"data": [{"id": "1", "username": "a"}]})), (8, json.dumps({"errors": [{"detail": "User has been suspended: [8]."}]})),
         (9, json.dumps({"errors": [{"detail": "Something else"}]}))],
        "requested_id bigint, page string",
    )
    got = pages.flatten_id_pages(df, ARCHIVE["authors"], "followee")
    assert rows(got, "followee", "id", "username") == [(7, "1", "a")]
    assert rows(pages.page_errors(df), "requested_id", "detail") == [(9, "Something else")]


def test_claim_search(spark):
    claims = [
        {"text": "c1", "claimDate": "2020-01-01", "claimant": "x", "claimReview": [
            {"publisher": {"site": "a.org"}, "languageCode": "en", "textualRating": "False"}, {"publisher": {"site": "b.org"}}]},
        {"text": "c2", "claimReview": [{"reviewDate": "2021-03-04"}]},
        {"text": "c3", "claimReview": [{"url": "http://x/2021-05-06/y"}]},
        {"text": "c4"},
    ]
    df = spark.createDataFrame([(json.dumps({"claims": claims}),), ("{}",)], "response string")
    got = rows(pages.flatten_claim_search(df), "claim", "date", "reviewer", "raw_verdict")
    assert got == [("c1", "2020-01-01", "a.org", "False"), ("c2", "2021-03-04", None, None), ("c3", "2021-05-06T00:00:00Z", None, None), ("c4", None, None, None)]


def test_date_gate(spark):
    good = [("a", "2021-01-01")] * 9 + [("a", None)]
    df = spark.createDataFrame(good, "reviewer string, date string")
    assert filters.dated_claims(df).count() == 9
    with pytest.raises(ValueError, match="without a date"):
        filters.dated_claims(df.union(spark.createDataFrame([("a", None)], "reviewer string, date string")))
    assert df.select(parse_date(F.lit("2021-99-01"))).first()[0] is None


def test_url_filter(spark):
    urls = ["https://youtu.be/x", "https://t.me/a", "http://x/t.me", "http://x/a.JPG", "http://x/a.jpg", "http://x/a.jpg?b"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.url for r in df.filter(filters.maybe_article(F.col("url"))).collect()] == ["http://x/t.me", "http://x/a.JPG", "http://x/a.jpg?b"]


def test_articles(spark):
    page = "<html><title>T</title><p>Text</p></html>"
    df = spark.createDataFrame(
        [("http://a/x?y=1", page), ("http://a/x/", page.replace("Text", "Other")), ("http://a/empty", "<title>T</title>"), ("http://a/v.mp4", page), ("http://b/", page)],
        "url string, html string",
    )
    known = spark.createDataFrame([("http://a/x?y=1",), ("http://a/x/",), ("http://a/empty",), ("http://a/v.mp4",)], "name string")
    made = nodes.article_tables(df, known)
    assert rows(made["article"], "url", "title", "content") == [("http://a/x", "T", "Other")]
    assert rows(made["url_is_article"], "src", "tgt") == [("http://a/x/", "http://a/x"), ("http://a/x?y=1", "http://a/x")]
    assert made["article_has_top_image"].count() == 0
    assert nodes.article_tables(df, known, skip_preparse=True)["article"].count() == 2


def test_release_files(spark, tmp_path):
    path = str(tmp_path / "release")
    a = spark.createDataFrame([(7, 0.71), (7, 0.93)], "post_id int, relevance double")
    rel = spark.createDataFrame([(1, 2, 0.8), (1, 2, 0.9)], "src bigint, tgt bigint, relevance double")
    mask = spark.createDataFrame([(1, None), (2, True)], "claim_id bigint, m boolean")
    nodes_out = {"post": ([a, a], ["post_id"], {"post_id": "bigint"}), "claim": ([mask], ["claim_id"], {"m": "boolean"})}
    assert release.dump_release(path, nodes_out, {"r": [rel]}) == ["post", "claim", "r"]
    post = spark.read.parquet(f"{path}/post")
    assert dict(post.dtypes)["post_id"] == "bigint" and rows(post, "post_id", "relevance") == [(7, 0.93)]
    assert rows(spark.read.parquet(f"{path}/claim"), "claim_id", "m") == [(1, False), (2, True)]
    assert rows(spark.read.parquet(f"{path}/r"), "src", "tgt", "relevance") == [(1, 2, 0.9)]
    # Without overwrite other tables stay, with it they go.
    release.dump_release(path, {}, {"s": [rel]})
    assert spark.read.parquet(f"{path}/r").count() == 1
    release.dump_release(path, nodes_out, {"r": [rel]}, overwrite=True, dump_nodes=False)
    assert not (tmp_path / "release" / "post").exists() and not (tmp_path / "release" / "s").exists()
    with pytest.raises(ValueError, match="tgt"):
        release.dump_relation([rel.drop("tgt")], f"{path}/bad")


def test_exports(spark, tmp_path):
    links = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.9)], "post_id bigint, claim_id bigint, score double")
    release.dump_similarities(links, str(tmp_path / "s"))
    assert [r.similarity for r in spark.read.csv(str(tmp_path / "s"), header=True).collect()] == ["0.9", "0.5"]
    claims = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "claim_id bigint, embedding array<float>")
    release.dump_claim_embeddings(claims, links, str(tmp_path / "e"))
    assert rows(spark.read.parquet(str(tmp_path / "e")), "claim_id") == [(1,)]
    posts = spark.createDataFrame([(1, "a", [1.0]), (2, "b", None)], "post_id bigint, text string, embedding array<float>")
    assert release.cache_embeddings(posts, str(tmp_path / "c")).columns == ["post_id", "text"]
    assert rows(spark.read.parquet(str(tmp_path / "c")), "post_id") == [(1,)]
    with pytest.raises(Exception, match="exists"):
        release.cache_embeddings(posts, str(tmp_path / "c"))


def test_new_reviewers_only(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "reviewer string, n int")
    path = str(tmp_path / "r")
    assert release.append_new_reviewers(df.filter("reviewer = 'a'"), path).count() == 1
    assert rows(release.append_new_reviewers(df, path), "reviewer") == [("b",)]
    assert rows(spark.read.parquet(path), "reviewer", "n") == [("a", 1), ("b", 2)]


def test_short_and_long_rows(spark, tmp_path):
    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "tweets.csv").write_text("id,author_id,text,lang\n1,5,ok,en\n2,5,short\n3,5,long,en,more\n4\n\n5,5,,en\n")
    got = archive.read_archive_table(spark, str(tmp_path), "tweets")
    assert rows(got, "id", "text", "lang") == [("1", "ok", "en"), ("2", "short", None), ("4", None, None), ("5", None, "en")]
    assert rows(archive.rejected(archive.read_cells(spark, str(tmp_path), "tweets")), "query", "id") == [("s", "3")]
    (folder / "a.csv").write_text("claim,date,reviewer\nc1,2021-01-01,a,more\nc2\n")
    claims = archive.read_claims(spark, str(tmp_path / "s"))
    assert rows(claims.filter("file_reviewer = 'a'"), "claim", "reviewer") == [("c1", "a"), ("c2", None)]
    (tmp_path / "c.csv").write_text("claim,label,label_single,cluster\nx,L,k,3,more\ny,M\n")
    assert rows(archive.read_claim_clusters(spark, str(tmp_path / "c.csv")), "claim", "cluster") == [("x", 3), ("y", None)]


def test_an_edge_asks_for_its_two_ends_alone(spark, sf):
    """every edge query wrote all eight node tables first."""
    from claimweave.plans.views import Views

    v = Views(spark, sf)
    assert v.edge("url_is_media").count() > 0
    assert sorted(v.ends) == ["media", "url"]
    assert v.edge("post_located_in_place").count() > 0
    assert sorted(v.ends) == ["media", "place", "post", "url"]
    assert v.ends["post"].columns == ["post_id"]
