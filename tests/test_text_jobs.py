import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimweave.operators import annotation, filters, graph_sql, keyed, models, terms, translate

T = dt.datetime


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# Translation.


def backend():
    limit = translate.BATCH

    def upper(texts, target):
        if any("bad" in t for t in texts):
            raise RuntimeError("Text too long")
        assert len(texts) <= limit
        return [f"{target}:{t.upper()}" for t in texts]

    return upper


def memory(spark, *items):
    return spark.createDataFrame(list(items), "text string, target string, translated string")


def test_memory_then_backend(spark):
    df = spark.createDataFrame([(1, "a", "en"), (2, "a", "de"), (3, "b", "en"), (4, None, "en"), (5, "bad", "en"), (6, "a", "en")], "id int, t string, l string")
    mem = memory(spark, ("a", "en", "A!"))
    got = rows(translate.translate(df, "t", "l", mem, "o", backend()), "id", "o")
    assert got == [(1, "A!"), (2, "de:A"), (3, "en:B"), (4, None), (5, None), (6, "A!")]
    assert rows(translate.translate(df, "t", "l", mem, "o"), "id", "o") == [(1, "A!"), (2, None), (3, None), (4, None), (5, None), (6, "A!")]
    texts = spark.createDataFrame([(f"t{i}", "en") for i in range(120)] + [("bad", "en")], "text string, target string")
    done = translate.look_up(texts, mem, backend())
    assert done.filter("translated IS NOT NULL").count() == 120
    assert rows(done.filter("error IS NOT NULL"), "text", "error") == [("bad", "Text too long")]


def test_lines(spark):
    df = spark.createDataFrame([(1, "x\n\ny\nx"), (2, "x\nbad"), (3, "")], "id int, t string")
    got = rows(translate.translate_lines(df, "id", "t", memory(spark, ("x", "en", "X")), "o", backend=backend()), "id", "o", "not_translatable")
    assert got == [(1, "X\n\nen:Y\nX", False), (2, None, True), (3, "", False)]


def test_english_verdicts_stay(spark):
    df = spark.createDataFrame([("Faux", "fr"), ("False", "en"), (None, "fr"), ("?", None)], "raw_verdict string, language string")
    got = rows(translate.review_verdicts(df, memory(spark, ("Faux", "en", "False!"))), "raw_verdict", "raw_verdict_en")
    assert got == [("?", None), ("False", "False"), ("Faux", "False!"), (None, None)]


def test_language_copies(spark):
    df = spark.createDataFrame([("v", "en", "factual"), ("w", None, "other")], "raw_verdict string, language string, verdict string")
    out = annotation.expand_annotations(df, memory(spark, ("v", "de", "V")), ["en", "de"])
    assert rows(out) == sorted([("v", "en", "factual"), ("V", "de", "factual"), ("w", None, "other"), (None, "en", "other"), (None, "de", "other")], key=repr)
    assert "no" in annotation.LANGUAGES and len(set(annotation.LANGUAGES)) == len(annotation.LANGUAGES)
    words = spark.createDataFrame([("Covid",), ("covid",), (None,)], "k string")
    got = rows(annotation.expand_keywords(words, memory(spark, ("covid", "de", "Corona")), ["de", "fr"]))
    assert got == [("corona",), ("covid",)]
    tags = spark.createDataFrame([("Hoax",)], "h string")
    assert rows(annotation.query_terms(words, tags)) == [("#hoax",), ("covid",)]


# Search.


def archive(spark):
    cols = "post_id bigint, created_at timestamp, text string, lang string, conversation_id bigint, is_reply boolean, shares_content boolean, is_ad boolean"
    return spark.createDataFrame(
        [
            (1, T(2020, 1, 1), "Covid news", "en", 1, False, True, False),
            (2, T(2020, 1, 2), "covid NEWS", "de", 1, True, True, None),
            (3, T(2020, 1, 3), "covid", "en", 2, None, None, False),
            (4, T(2020, 1, 4), "covid news ad", "en", 2, False, True, True),
        ],
        cols,
    )


def found(df):
    return [r.post_id for r in df.collect()]


def test_search(spark):
    posts, now = archive(spark), T(2021, 1, 1)
    search = lambda **kw: sorted(found(filters.search_posts(posts, now=now, **kw)))
    assert search() == [1, 2, 3]
    assert search(keyword="news covid") == [1, 2]
    assert search(language="en") == [1, 3] and search(conversation_id="1") == [1, 2]
    assert search(is_reply=True) == [2] and search(is_reply=False) == [1, 3]
    assert search(shares_content=True) == [1, 2] and search(shares_content=False) == [3]
    assert search(from_date=T(2020, 1, 2), to_date=T(2020, 1, 3)) == [2]
    assert search(from_id=1, to_id=3, from_date=T(2020, 6, 1)) == [2]
    assert found(filters.search_posts(posts, max_results=2, now=now)) == [3, 2]
    assert search(from_date=T(2005, 1, 1), to_date=T(2006, 3, 21)) == []
    assert search(from_date=T(2022, 1, 1), to_date=T(2023, 1, 1)) == []


def test_clamped_window():
    now = T(2020, 1, 1)
    assert filters.clamp_window(T(2000, 1, 1), T(2030, 1, 1), now) == (filters.FIRST_DAY, now)
    assert filters.clamp_window(None, None, now) == (filters.FIRST_DAY, None)
    assert filters.clamp_window(T(2019, 1, 2), T(2019, 1, 2), now) is None


def test_keywords_need_no_cap(spark):
    docs = spark.createDataFrame([(1, "blue moon blue moon, rises"), (2, "red moon"), (3, "")], "id bigint, t string")
    got = terms.keywords(docs, "id", "t", 2)
    assert set(rows(got, "id", "term")) == {(1, "blue"), (1, "blue moon"), (2, "red"), (2, "red moon")}


def test_searches_of_claims_against_brute_force(spark):
    times = [T(2021, 1, d, h) for d in range(1, 12) for h in (0, 7, 15, 23)]
    posts = [(i, t, "x word y" if i % 2 else "other", False, True) for i, t in enumerate(times)]
    # A hot term: all claims of a reviewer share it, at odd hours.
    claims = [(1, "a", T(2021, 1, 5, 7)), (2, "a", T(2021, 1, 5)), (3, "b", T(2021, 1, 9, 23, 30)), (4, "a", T(2021, 1, 11, 2)), (5, "b", None)]
    words = [(c, w) for c, _, _ in claims for w in ("word", "x word")]
    got = rows(
        terms.search_by_keywords(
            spark.createDataFrame(claims, "claim_id bigint, reviewer string, date timestamp"),
            spark.createDataFrame(words, "claim_id bigint, term string"),
            spark.createDataFrame(posts, "post_id bigint, created_at timestamp, text string, is_reply boolean, shares_content boolean"),
        )
    )
    want = {
        (r, w, p)
        for c, r, d in claims
        if d
        for k, w in words
        if k == c
        for p, t, body, *_ in posts
        if w in body and d - dt.timedelta(days=3) <= t < d + dt.timedelta(days=1)
    }
    assert got == sorted(want, key=repr) and len(want) > 20


def test_summaries(spark):
    text = "The cat sat. The cat sat. Quantum flux capacitors hum! The cat sat.\nThe cat ran"
    docs = spark.createDataFrame([(1, text), (2, "The cat sat. The cat ran. The cat ran."), (3, "word " * 30), (4, "")], "id bigint, t string")
    got = dict(rows(terms.summaries(docs, "id", "t", 7), "id", "summary"))
    assert "Quantum flux capacitors hum!" in got[1] and got[3] == ("word " * 30).strip() and 4 not in got
    whole = dict(rows(terms.summaries(docs, "id", "t", 512), "id", "summary"))
    assert whole[1] == text.replace("\n", " ")


# Annotation.


def test_worklist(spark):
    claims = spark.createDataFrame(
        [("c1", "a", "False", 0.9), ("c2", "a", "False", 0.2), ("c3", "a", "True", 0.5), ("c4", "b", None, 0.1), ("c5", "b", None, 0.3), ("c6", "b", "Mixed", None)],
        "claim string, reviewer string, raw_verdict_en string, predicted_verdict_confidence double",
    )
    done = spark.createDataFrame([("c3", "True")], "claim string, raw_verdict_en string")
    test = spark.createDataFrame([(None, "x")], "claim string, raw_verdict_en string")
    out = annotation.annotation_worklist(claims, done, test)
    assert [(r.claim, r.old_predicted_verdict_confidence) for r in out.collect()] == [("c4", 0.1), ("c2", 0.2), ("c6", None)]
    every = annotation.annotation_worklist(claims, done, test, include_duplicates=True)
    assert rows(every, "claim") == [("c1",), ("c2",), ("c4",), ("c5",), ("c6",)]
    assert every.collect() == annotation.annotation_worklist(claims, done, test, include_duplicates=True).collect()
    assert annotation.head(out, 2).count() == 2


def test_merging(spark):
    schema = "claim_data array<string>, changed boolean, verdict string"
    new = spark.createDataFrame([(["c", "d", "s", "r", "en", "v", "ve"], True, "factual"), (["c2", "d", "s", "r", "en", "v", "w"], False, "other")], schema)
    changed = annotation.changed_annotations(new)
    assert rows(changed, "claim", "raw_verdict_en", "verdict") == [("c", "ve", "factual")]
    old = spark.createDataFrame([("o1", "ve", "other"), ("o2", "old", "other")], "claim string, raw_verdict_en string, verdict string")
    merged = annotation.merge_annotations(old, changed, ["claim"])
    assert rows(merged, "claim", "raw_verdict_en", "verdict") == [("o1", "ve", "other"), ("o2", "old", "other")]
    assert annotation.merge_annotations(old, changed, ["claim"], include_duplicates=True).count() == 3
    assert annotation.merge_annotations(None, changed, ["claim"]).count() == 1


def test_case_copies(spark):
    df = spark.createDataFrame([("half-TRUE", "other")], "raw_verdict string, verdict string")
    assert rows(annotation.case_variants(df), "case", "raw_verdict") == [
        ("capitalize", "Half-true"), ("lower", "half-true"), ("title", "Half-True"), ("upper", "HALF-TRUE")]


# Keyed helpers.


def test_upserts(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "c", 0), (2, "d", 5)], "k bigint, v string, o int")
    assert rows(keyed.upsert_first(df, ["k"], ["o"]), "k", "v") == [(1, "b"), (2, "d")]
    assert rows(keyed.upsert_last(df, ["k"], ["o"]), "k", "v") == [(1, "a"), (2, "d")]
    with pytest.raises(ValueError, match="not unique"):
        keyed.assert_unique(df, ["k"])
    assert keyed.assert_unique(df, ["v"]) is df


@pytest.mark.parametrize("n,size", [(31, 15), (30, 15), (1, 15), (500, 7)])
def test_batches_keep_the_rest(spark, n, size):
    ids = [(i * i + 3,) for i in range(n)]
    out = keyed.batch_ids(spark.createDataFrame(ids, "id bigint"), "id", size)
    got = {r.id: r.batch_id for r in out.collect()}
    assert got == {i: k // size for k, (i,) in enumerate(sorted(ids))}


def test_running_sums_with_ties_in_front(spark):
    data = [(g, n, c) for g in "ab" for n, c in [(1, 9), (1, 3), (1, 5), (2, 1), (2, 8), (5, 2)]]
    df = spark.createDataFrame(data, "g string, n bigint, c bigint")
    out = keyed.running_before(df, ["g"], ["n"], "c", F.col("n"))
    assert {(r.g, r.c): r.before for r in out.collect()} == {
        (g, c): b for g in "ab" for c, b in [(3, 0), (5, 1), (9, 2), (1, 3), (8, 5), (2, 7)]}


def test_skewed_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, "gone")], "i int, k string")
    dim = big.filter("k <> 'gone'").groupBy("k").agg(F.count(F.lit(1)).alias("w")).withColumn("d", F.upper("k"))
    for hot in (1, 5, 1000):
        got = rows(keyed.join_skewed(big, dim, "k", "w", hot), "i", "d")
        assert got == rows(big.filter("k <> 'gone'").select("i", F.upper("k")))


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, done boolean")
    assert rows(keyed.progress(df, F.col("done"))) == [(3, 1, 2)]
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "src int, tgt int")
    assert rows(keyed.undirected(edges)) == [(1, 2), (2, 1), (3, 4), (4, 3)]
    posts = spark.createDataFrame([(T(2020, 1, 2),), (T(2020, 1, 1),)], "created_at timestamp")
    assert keyed.page_cursor(posts).first()[0] == T(2020, 1, 1)
    work = spark.createDataFrame([("a", None, None), ("b", "x", None), (None, None, None), ("c", None, True)], "i string, o string, f boolean")
    assert rows(filters.worklist(work, ["i"], "o", "f"), "i") == [("a",)]
    got = graph_sql.query(spark, "SELECT src FROM {e} WHERE tgt > :n", {"e": edges}, n=1)
    assert rows(got) == [(1,), (3,)]


# Models.


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d"), (4, None)], "id int, t string")
    got = {r.id: r.embedding for r in models.embed(df, "t", F.lower, 32).collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) == 32 and 4 not in got
    assert sum(x * x for x in got[3]) == pytest.approx(1.0)
    own = models.embed(df, "t", load_encoder=lambda: (lambda texts: [[len(t), 1] for t in texts]))
    assert {r.id: r.embedding for r in own.collect()} == {1: [3.0, 1.0], 2: [3.0, 1.0], 3: [3.0, 1.0], 4: [0.0, 1.0]}


def test_classifier(spark):
    words = {"factual": ["true", "correct"], "misinformation": ["false", "wrong hoax"], "other": ["satire", "mixed"]}
    ann = spark.createDataFrame([(w, v) for v, ws in words.items() for w in ws] * 3, "raw_verdict string, verdict string")
    model = models.train_verdict_classifier(ann, 1 << 10)
    claims = spark.createDataFrame([("TRUE",), ("False",), ("Satire",), (None,)], "raw_verdict_en string")
    got = {r.raw_verdict_en: (r.predicted_verdict, r.predicted_verdict_confidence) for r in models.predict_verdicts(model, claims).collect()}
    assert {k: v[0] for k, v in got.items()} == {"TRUE": "factual", "False": "misinformation", "Satire": "other", None: None}
    assert 1 / 3 < got["TRUE"][1] <= 1 and got[None][1] is None


def test_training_counts_the_words_of_a_text_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def note(text):
        seen.add(1)
        return text.split()

    spark.udf.register("noted_words", note, "array<string>")
    monkeypatch.setattr(models, "_words", lambda: models.SQLTransformer(statement="SELECT *, noted_words(_doc) AS _words FROM __THIS__"))
    ann = spark.createDataFrame([(f"{w} {i}", v) for i in range(10) for w, v in (("true", "factual"), ("hoax", "misinformation"), ("so", "other"))], "raw_verdict string, verdict string")
    copies = models.case_variants(ann).count()
    models.train_verdict_classifier(ann, 1 << 8)
    assert seen.value == copies


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    m = models.classifier_metrics(df).first()
    assert m.prec_factual == 1.0 and m.prec_misinformation == pytest.approx(2 / 3) and m.prec_other == 0.0
    assert m.f1_factual == pytest.approx(2 / 3) and m.f1_misinformation == pytest.approx(0.8) and m.f1_macro == pytest.approx((2 / 3 + 0.8) / 3)


def test_numbers_for_text_ids_ties_and_skew(spark):
    ids = [f"id-{i % 700:04}" for i in range(1000)] + ["hot"] * 800 + [None, "é", ""]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(7)
    got = keyed.batch_ids(df, "id", 50).collect()
    assert sorted(r.batch_id for r in got) == [k // 50 for k in range(len(ids))]
    where = {}
    for r in got:
        where.setdefault(r.id, []).append(r.batch_id)
    order = sorted(where, key=lambda i: (i is not None, (i or "").encode()))
    assert all(max(where[a]) <= min(where[b]) for a, b in zip(order, order[1:]))
    per_group = keyed.batch_ids(df.withColumn("g", F.when(F.col("id") == "hot", "h")), "id", 3, ["g"]).collect()
    assert sorted(r.batch_id for r in per_group if r.g == "h") == [k // 3 for k in range(800)]
    assert keyed.batch_ids(df.filter("false"), "id", 3).count() == 0


def test_tasks_follow_the_characters(spark, monkeypatch):
    """the texts went to as many tasks as the session has shuffle partitions, whatever their size."""
    docs = spark.createDataFrame([(i, f"Word{i} and more words. Short one.") for i in range(60)], "doc_id bigint, text string")
    want = sorted(map(tuple, terms.summaries(docs, "doc_id", "text", 4).collect()))
    assert terms._counted(docs, "text") == (60, spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(terms, "CHARS_A_TASK", 100)
    assert terms._counted(docs, "text")[1] >= 18
    assert sorted(map(tuple, terms.summaries(docs, "doc_id", "text", 4).collect())) == want
    assert terms._counted(docs.filter("doc_id < 0"), "text")[0] == 0
    assert terms.summaries(docs.filter("doc_id < 0"), "doc_id", "text").count() == 0
