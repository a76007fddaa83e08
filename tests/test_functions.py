import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimweave.functions import claims, html, lists, text, vectors


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip_url(spark):
    got = apply(spark, text.strip_url, ["http://a/b/?x=1", "http://a/b//", "http://a/#t?x", None])
    assert got == ["http://a/b", "http://a/b/", "http://a/#t", None]


def test_clean_post(spark):
    got = apply(
        spark,
        text.clean_post,
        ["Hi @Bob_1 see https://t.co/ab-c?x=1 #COVID --now", "visit www.a.com now", "@@x ---a"],
    )
    assert got == ["hi _1 see -c?x=1 covid -now", "visit a.com now", "-a"]
    strict = apply(spark, lambda c: text.clean_post(c, strict=True), ["visit www.a-b.com/x_y=1 now"])
    assert strict == ["visit now"]


def test_plain_and_search_text(spark):
    assert apply(spark, text.clean_plain, ["  NO  Tags\n", " x "]) == ["no  tags", "x"]
    assert apply(spark, text.clean_search_text, ["In 2020, \"5G\" caused “it”."]) == ["In  G caused it”"]


@pytest.mark.parametrize("value", ["half-true o'neil", "half-TRUE", "", "3rd of été", "a.b c_d"])
def test_case_forms(spark, value):
    assert apply(spark, text.title_case, [value]) == [value.title()]
    assert apply(spark, text.capitalize, [value]) == [value.capitalize()]


def test_squeeze(spark):
    assert apply(spark, text.squeeze, [" \n a  b\n\n\nc \n"]) == ["a b\nc"]


def test_record_urls(spark):
    cells = [
        "[{'url':'u1','expanded_url':'e1'},{'url':'u2'},{'url':'u3','expanded_url':None},{'x':1}]",
        "{'url':'u'}",
        "[{'url':",
        "[]",
        None,
        "[{'start': 1, 'images': [{'w': 2}], 'url': 'u5', 'ok': True}]",
    ]
    assert apply(spark, lists.record_urls, cells) == [["e1", "u2"], [], [], [], None, ["u5"]]


def test_list_cells(spark):
    assert apply(spark, lists.strings, ["['3_1', '3_2']", "['a', None]", "junk", r"['a\b']"]) == [
        ["3_1", "3_2"],
        ["a", None],
        [],
        ["a\\b"],
    ]
    assert apply(spark, lists.reference_ids, ["[{'type': 'quoted', 'id': '12'}]", "[12, 13]", "['14']"]) == [
        [12],
        [12, 13],
        [14],
    ]
    assert apply(spark, lists.doubles, ["[-1.5, 2, 3e1, 'x']"]) == [[-1.5, 2.0, 30.0, None]]


def test_claim_date(spark):
    rows = [
        (0, "2020-01-01", "2021-03-04", None),
        (1, None, "2021-03-04", "http://x/2021-05-06/y"),
        (2, None, None, "http://x/2021-05-06/y"),
        (3, None, None, "http://x"),
        (4, None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, a string, b string, u string")
    got = df.select("i", claims.claim_date(F.col("a"), F.col("b"), F.col("u")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == ["2020-01-01", "2021-03-04", "2021-05-06T00:00:00Z", None, None]


def test_dates_and_boxes(spark):
    assert apply(spark, claims.parse_date, ["2021-05-06T01:00:00Z", "junk", None]) == [
        dt.datetime(2021, 5, 6, 1), None, None]
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 6.0],), (None,)], "b array<double>")
    lat, lng = claims.box_center(F.col("b"))
    assert [tuple(r) for r in df.select(lat, lng).collect()] == [(2.0, 4.0), (None, None)]
    lat, lng = claims.box_center(F.col("b"), "lonlat")
    assert tuple(df.select(lat, lng).first()) == (4.0, 2.0)


def test_folder_and_verdict(spark):
    assert apply(spark, lambda c: text.folder_name(c, "desk"), ["#covid 19 x"]) == ["desk-hashtag_covid_19_x"]
    assert apply(spark, claims.verdict_id, ["factual", "misinformation", "other", "x", None]) == [0, 1, 2, None, None]


def test_html(spark):
    page = (
        "<html><head><title>A &amp;  B</title><meta name='author' content='Ann, Bo'>"
        "<meta property='og:image' content='http://i/x.jpg'>"
        "<meta property=\"article:published_time\" content=\"2021-02-03T04:05:06Z\">"
        "<script>var t='</p><p>no</p>'</script></head><body><nav><p>menu</p></nav><!-- <p>c</p> -->"
        "<article><p class='x'><b>One<br><p>Two &lt;3</p><pre>q</pre><p> </p></article></body></html>"
    )
    assert apply(spark, html.page_title, [page, "<p>x</p>"]) == ["A & B", ""]
    assert apply(spark, html.page_content, [page, "none"]) == ["One\nTwo <3", ""]
    assert apply(spark, html.authors, [page, "x"]) == [["Ann", "Bo"], []]
    assert apply(spark, html.top_image, [page, "x"]) == ["http://i/x.jpg", None]
    assert apply(spark, html.publish_time, [page, "x"]) == [dt.datetime(2021, 2, 3, 4, 5, 6), None]


def test_tokens_and_sentences(spark):
    assert apply(spark, text.tokens, ["Hé, you! 5G_x"]) == [["hé", "you", "5g", "x"]]
    assert apply(spark, text.sentences, ["A b. C d!\nE f"]) == [["A b.", "C d!", "E f"]]


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and got[2] is None
