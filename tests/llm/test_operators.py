"""The training-data operators on small and awkward inputs, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimweave.llm import chat, common, decontaminate, langid, mixing, ngram_join, quality, token_files, topk, toxicity, warc
from claimweave.llm.queries import own_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns with names that the operators use inside.
CLASH = ["size", "target", "copies", "_row", "row", "component", "node", "score", "predicted", "w", "text2", "item_id"]


def documents(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit(c) for c in CLASH}) if clash else df


WORDS = [f"w{i}" for i in range(60)]


def some_text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    rnd = random.Random(3)
    rows = [(i, some_text(rnd, rnd.choice([1, 3, 12, 60])), rnd.choice(["a", "b", "é", None])) for i in range(40)]
    rows += [(40, None, "a"), (41, "", None), (42, " \n\t ", "b"), (43, "x " * 50_000, "a"), (None, "no id here at all", "a")]
    rows += [(7, rows[7][1], rows[7][2])] * 2 + [(44, "İ \U0001f642 <|im_end|> ñ", "only"), (45, None, "silent")]
    return rows


# Mixing.


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        new = {s: 3 * sizes[s] for s in free if level * weight[s] > 3 * sizes[s]}
        if not new:
            return {s: fixed.get(s, level * weight[s]) for s in names}
        fixed |= new


def test_mixing_follows_targets(spark, awkward):
    docs = documents(spark, awkward, clash=True)
    sizes = {}
    for _, t, s in awkward:
        sizes[s] = sizes.get(s, 0) + len(re.findall(common.WORD, t or ""))
    want = plain_targets(sizes)
    got = mixing.mixed_sizes(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        if r["size"]:
            whole = int(r.target / r.source_size + 1e-9)
            assert r.taken // r["size"] in (whole, whole + 1) and r.taken <= 3 * r["size"]
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs.where("doc_id <> 7")).collect()}
    again = mixing.mix_sources(docs.where("doc_id <> 7")).select("doc_id", "text").collect()
    words = {}
    for r in again:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(common.WORD, r.text or ""))
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_mixing_many_sources_and_ties(spark):
    rows = [(i, "a b c " * (1 + i % 4), f"s{i % 90:03}") for i in range(900)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    got = {r.source: r.target for r in mixing.source_targets(mixing.sizes_of(documents(spark, rows))).collect()}
    want = plain_targets(sizes)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mixing_nothing(spark):
    empty = documents(spark, [])
    assert mixing.mixed_sizes(empty).count() == 0 and mixing.mix_sources(empty).count() == 0
    silent = documents(spark, [(1, None, "a"), (2, "", None)])
    assert [r.taken for r in mixing.mixed_sizes(silent).collect()] == [0, 0]


# Toxicity and quality.


def labelled(spark, bad, good, n=300):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(rnd.randrange(5, 80))]
        if i % 4 == 0:
            bad(words, rnd)
        else:
            good(words, rnd)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(i % 4 != 0), int(i % 4 == 0)))
    labels += [(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out(spark):
    def insult(words, rnd):
        for _ in range(1 + len(words) // 25):
            words.insert(rnd.randrange(len(words)), rnd.choice(["scoundrel", "nincompoop", "blockhead"]))

    rows, labels = labelled(spark, insult, lambda w, r: None)
    docs = documents(spark, rows + [(900, None, None), (901, "", "a"), (None, "blockhead " * 30, "a"), (902, "w1 " * 20_000, "a")], clash=True)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels.where("doc_id is null or doc_id % 3 <> 0")).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(300) if i % 3 == 0]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert got[None].predicted == 1 and got[900].predicted == got[901].predicted == got[902].predicted == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {900, 901, 902}


def test_harmless_rows_are_picked_in_small_batches(spark, monkeypatch):
    def rating(model):
        def rate(texts):
            assert len(texts) <= 2000
            return [float(t.as_py() == "bad") for t in texts]

        return rate

    monkeypatch.setattr(toxicity, "_rating", rating)
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'bad', 'good') as text", "id as `a b`").repartition(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = toxicity.drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert kept.count() == 4000 and kept.where("doc_id % 3 = 0 or `a b` <> doc_id").count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_toxicity_without_classes(spark):
    docs = documents(spark, [(1, "a b", None), (2, None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, none).collect()] == [0, 0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, one).collect()] == [1, 1]
    assert toxicity.toxicity(documents(spark, []), one).count() == 0


def test_ordinary_windows_come_from_all_texts():
    texts = [" ".join(f"{i}x{j}" for j in range(400)) for i in range(3000)]
    got = toxicity.ordinary_windows(texts)
    assert len(got) == pytest.approx(toxicity.TRAIN_WINDOWS, rel=0.05)
    assert len({w.split()[0].split(b"x")[0] for w in got}) > 2990
    per = [sum(int(w.split(b"x")[0]) // 1000 == k for w in got) for k in range(3)]
    assert min(per) > 0.9 * max(per)
    assert len(toxicity.ordinary_windows(texts[:50], 2000)) == 2000


def test_windows_cover_the_whole_text():
    text = " ".join(str(i) for i in range(12345))
    assert b" ".join(w.strip() for w in toxicity.windows(text)).decode() == text
    assert toxicity.windows(None) == toxicity.windows("  ") == []


def test_quality_ranks_held_out(spark):
    def shout(words, rnd):
        words[:] = [w.upper() + "!!" for w in words]

    rows, labels = labelled(spark, shout, lambda w, r: None)
    docs = documents(spark, rows + [(900, None, None), (901, "", "a"), (None, "x", "a")] + rows[:3], clash=True)
    got = quality.rank_quality(docs, labels.where("doc_id is null or doc_id % 3 <> 0")).collect()
    assert len(got) == 306 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id in range(0, 300, 3)]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.predicted for r in quality.rank_quality(docs, none).collect()} == {1}
    assert quality.rank_quality(documents(spark, []), labels).count() == 0


def test_ranking_orders_pairs():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] - x[:, 1] + 0.3 * rnd.normal(size=400) > 0).astype(int)
    model = quality.fit_ranking(x, y)
    s = quality.score_features(x, model)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) > 0.95
    assert abs(np.mean(s < quality.CUT) - np.mean(y == 0)) < 0.02


# Language.


def plain_out_of_place(a, b, size):
    rank = {g: i for i, g in enumerate(b)}
    return sum(min(size, abs(rank[g] - i)) if g in rank else size for i, g in enumerate(a)) / len(a) / size


def test_language(spark):
    texts = {"en": "the cat and the dog were there when they thought", "de": "der hund und die katze waren nicht dort als sie dachten", "fr": "le chien et la chatte étaient là quand ils pensaient"}
    rows = [(i, " ".join(random.Random(i).sample(t.split(), 6)), lang, None, 1) for i, (lang, t) in enumerate(list(texts.items()) * 20)]
    rows += [(100, None, "en", None, 1), (101, "12 !?", "fr", None, 1), (102, "THE CAT", None, "a", 1), (None, "der hund", "de", None, 1), (0, rows[0][1], "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("gram", "score", "lang_pred", "rank")})
    got = langid.identify_languages(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (100, 101):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == rows[r.doc_id][2] and 0 < r.score <= 1
    assert langid.identify_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(docs, docs.limit(0)).collect()} == {"und"}
    a, b = langid.ranked_grams(texts["en"], 50), langid.ranked_grams(texts["de"], 50)
    assert langid.out_of_place(a, b, np.argsort(b), 50) == pytest.approx(plain_out_of_place(a.tolist(), b.tolist(), 50))


def test_rare_languages_are_read_whole(spark):
    rows = [(i, f"aaa bbb {i}", "big", None, 1) for i in range(2000)] + [(5000 + i, chr(0x430 + i) * 5, "rare", None, 1) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    profiles = langid.language_profiles(docs, train_docs=100)
    alone = langid.language_profiles(docs.where("lang = 'rare'"))
    assert set(profiles) == {"big", "rare"} and profiles["rare"].tolist() == alone["rare"].tolist()
    assert langid.language_profiles(docs.limit(0), train_docs=0) == {}


# Token shards.


def test_token_shards_hold_all_ids(spark, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    docs = documents(spark, awkward, clash=True)
    path = own_folder(spark, "t")
    token_files.write_token_shards(docs, path, shard_ids=500)
    assert spark.read.parquet(path).count() > 3
    got = token_files.read_token_shards(spark, path).collect()
    want = {}
    for i, t, _ in awkward:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))


def test_token_files_bound_what_a_worker_holds(spark, monkeypatch):
    words, asked = token_files.WordIds(token_files.tokenizer_path()), []
    many = [pa.RecordBatch.from_pydict({"doc_id": [2 * i, 2 * i + 1], "text": [f"word {i}", "again"]}) for i in range(5)]
    want = [(d, words.encode(t).tolist()) for b in many for d, t in zip(*b.to_pydict().values())]
    plain = words.encode_all
    monkeypatch.setattr(words, "encode_all", lambda texts: asked.append(list(texts)) or plain(texts))
    # A chunk may hold several batches, and what it holds is bounded by its characters.
    assert [(d, ids.tolist()) for d, ids in token_files.encoded(words, many, 20)] == want
    assert [len(a) for a in asked] == [4, 4, 2]

    def sizes(*_, **__):
        def run(batches):
            for b in batches:
                row = pa.array([b.num_rows], pa.int64())
                yield pa.RecordBatch.from_arrays([row] * 5 + [pa.array([b""])], names=["part", "seq", "n_docs", "n_ids", "n_symbols", "payload"])

        return run

    monkeypatch.setattr(token_files, "_encoder", sizes)
    path, partitions = own_folder(spark, "batch-sizes"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        token_files.write_token_shards(documents(spark, [(i, f"text {i}", None) for i in range(1200)]), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = [r.n_docs for r in spark.read.parquet(path).collect()]
    assert sum(rows) == 1200 and max(rows) <= 500


def test_token_shards_of_nothing(spark):
    path = own_folder(spark, "t")
    token_files.write_token_shards(documents(spark, []), path)
    assert token_files.read_token_shards(spark, path).count() == 0


@pytest.mark.parametrize("text", [
    "a., b ..c ,d _. _, x_.y", "Œuvre œ. ﬁ ß Straße, İx", "don't. it's, WE'LL. 5.,3 a.b.c,d", "<|endoftext|> x <|startoftext|>a",
    "é é ́x ΑΣ ΑΣ.", "a\x1cb\x85c d\xa0e.", "日本 語 🙂, ok.", "\t\r\n", "ǆ µ ª.",
])
def test_words_are_encoded_like_texts(text):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert token_files.WordIds(path, room=3).encode(text).tolist() == want


def test_distinct_words_of_a_chunk_are_encoded_once():
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    words, library = token_files.WordIds(path, room=6), Tokenizer.from_file(path)
    new, asked = words.new_ids, []
    words.new_ids = lambda w: asked.append(w) or new(w)
    for texts in (["ab cd ab", "", "Tion$$$ ab été2", "cd"], ["ab x y z", "Œ ab"], ["ab cd"]):
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids.tolist() for ids in words.encode_all(texts)] == want
    # The third chunk makes the words too many for the room after the second: its own stayed.
    assert sorted(asked) == sorted(["ab", "cd", "", "tion$$$", "été2", "x", "y", "z", "Œ", "cd"])


def test_repair_round_trip_and_random_access():
    rnd = np.random.default_rng(4)
    for vocabulary, base in ((3, 10), (50, 49_408), (40, 70_000), (1, 5)):
        arrays = [np.append(rnd.integers(0, vocabulary, int(n)), 2).astype("<u4") for n in rnd.integers(0, 400, 40)]
        payload, symbols = token_files.pack([None, *range(39)], arrays, base)
        shard, whole = token_files.Shard(payload), np.concatenate(arrays)
        assert shard.doc_ids == [None, *range(39)] and symbols < len(whole)
        assert all(np.array_equal(ids, a) for (_, _, ids), a in zip(shard.documents(), arrays))
        for _ in range(60):
            a, b = sorted(rnd.integers(0, len(whole) + 1, 2))
            assert np.array_equal(shard.ids(a, b), whole[a:b])
        with pytest.raises(ValueError):
            token_files.Shard(payload[:-1])


# WARC.


def plain_warc(rows):
    keep = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            keep[h] = min(keep.get(h, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        k = keep.get(h) if len(b) >= 100 else None
        revisit = k is not None and k != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", k if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [None, "300", "1000"])
def test_warc_round_trip(spark, split):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(60)]
    rows += [(100, "u\r\nX: 1", "a" * 99), (101, None, "a" * 99), (102, "u", "b" * 100), (103, "u", "b" * 100), (99, "u", "b" * 100)]
    rows += [(104, "u", None), (105, "u", ""), (None, "u", "b" * 100), (None, "u", "c" * 200), (106, "u", "d" * 3000), (106, "u", "d" * 3000)]
    rows += [(110, "u", fake), (111, "u", fake * 20), (112, "u", "\r\n\r\n" * 9), (113, "u", "x\r\n"), (114, "u", fake[:50]), (115, "u", "WARC/1.1\r\n"), (116, "u", "é🙂" * 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = own_folder(spark, "w")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        warc.write_archives(pages.coalesce(2), path)
        got = sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == plain_warc(rows)


def test_warc_of_nothing(spark):
    path = own_folder(spark, "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


# Similarity join.


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(common.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in sets:
        for y in sets:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = root(x), root(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def plain_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(common.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return {x: sum(100 * len(s & o) >= 80 * len(s | o) for y, o in sets.items() if y != x and s and o) for x, s in sets.items()}


def near_copies(seed, n):
    rnd = random.Random(seed)
    base = [[rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(rnd.choice([3, 6, 20, 60, 200]))] for _ in range(10)]
    passage = [rnd.choice(WORDS) for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base[:3] if i % 2 else base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        if rnd.random() < 0.2:
            w += passage
        rows.append((i * 7 % 1009, rnd.choice([" ", "  ", "\n"]).join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a  B"), (2005, "z " * 30_000)]


@pytest.mark.parametrize("how", [{}, {"block": 16, "long_": 6}])
def test_join_equals_all_pairs(spark, how):
    rows = near_copies(11, 300)
    docs = spark.createDataFrame(rows + rows[:5] + [(None, rows[0][1])], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    got = ngram_join.similar_components(docs, **how).collect()
    assert len(got) == len(rows) + 6
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == plain_components(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


@pytest.mark.parametrize("how", [{}, {"block": 8, "long_": 6}, {"block": 3, "long_": 1, "percent": 80}])
def test_join_counts_all_links(spark, how):
    rows = near_copies(13, 250)
    docs = spark.createDataFrame(rows + rows[:5] + [(None, rows[0][1])], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    got = ngram_join.similar_components(docs, links=True, **how).collect()
    want, links = plain_components(rows), plain_links(rows)
    assert len(got) == len(rows) + 6 and max(links.values()) > 9
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got if r.doc_id is not None} == {i: (*want[i], links[i]) for i in want}
    assert [(r.component_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    assert ngram_join.similar_components(docs.limit(0), links=True).count() == 0


def test_join_counts_links_of_every_text_of_an_id(spark):
    a, b = "one two three four five six seven eight nine ten " * 3, "red green blue white black grey brown pink gold cyan " * 3
    rows = [(1, a + "p"), (1, b + "q"), (1, None), (2, a + "r"), (3, b + "s"), (3, b + "s"), (4, "alone")]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), links=True, percent=60).collect()
    want = [(1, 0), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 0)]
    assert sorted((r.doc_id, r.n_links) for r in got) == want
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_linked_sets_between_sides():
    rnd = random.Random(4)
    sets = [np.unique(np.array([rnd.randrange(14) for _ in range(rnd.randrange(0, 25))], np.uint64)) for _ in range(60)]
    side = [rnd.randrange(2) for _ in sets]
    both = {(i, j) for i in range(60) for j in range(i) if len(sets[i]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert both and {(max(p), min(p)) for p in ngram_join.linked_sets(sets)} == both
    assert {(max(p), min(p)) for p in ngram_join.linked_sets(sets, side)} == {(i, j) for i, j in both if side[i] != side[j]}


def test_join_keeps_one_of_a_group(spark):
    rows = near_copies(12, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    kept = ngram_join.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in plain_components(rows).values()})
    assert ngram_join.similar_components(docs.limit(0)).count() == 0


def test_divide_skip_equals_counting():
    rnd = random.Random(9)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(40), rnd.randrange(0, 30))) for _ in range(rnd.randrange(1, 25))]
        counts = {}
        for x in lists:
            for i in x:
                counts[i] = counts.get(i, 0) + 1
        for t in (1, 2, len(lists) // 2 + 1, len(lists)):
            assert dict(ngram_join.divide_skip(lists, t)) == {i: c for i, c in counts.items() if c >= t}


def test_shingles_depend_on_the_words_alone():
    s = ngram_join.Shingler()
    one, two = s("the QUICK  brown\nfox jumps over the lazy dog"), s("x y the quick brown fox jumps over the lazy dog")
    assert len(one) == 5 and set(one.tolist()) <= set(two.tolist())
    assert len(s("a b")) == 1 and len(s("")) == len(s(None)) == 0 and len(s("É a b c d")) == 1
    assert set(s("É a b c d").tolist()).isdisjoint(s("é a b c d").tolist())


# Decontamination.


def test_contaminated_documents(spark):
    rnd = random.Random(2)
    plain = " ".join("".join(rnd.choice("abcdeo") for _ in range(6)) for _ in range(40))
    item = "In the shop Maria buys 12 apples and 3 pears for 12 dollars, how many kg does Maria carry home after 5 km of walking"
    items = [(1, item), (2, plain), (3, "short one here"), (4, None), (5, ""), (None, item), (6, "7 8 9 10"), (2, None)]
    swap = item.replace("12", "99").replace("Maria", "Peter")
    torn = item.replace("12 apples", "40 apples")
    rows = [
        (10, "filler words before, " + item + " and after"), (11, "so " + swap), (12, some_text(rnd, 300)), (13, items[1][1].upper().replace(" ", ",\n")),
        (14, "xx short one, here yy"), (15, None), (16, ""), (17, "before " + torn), (18, " ".join(items[1][1].split()[:12])), (None, item), (10, item), (19, "7 8 9 10"),
    ]
    docs = documents(spark, [(i, t, "s") for i, t in rows], clash=True)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) >= {(10, 1), (11, 1), (13, 2), (14, 3), (None, 1), (19, 6)}
    assert {d for d, _ in got}.isdisjoint({12, 15, 16, 18})
    assert got[11, 1].changed and not got[10, 1].changed
    # One value of the item stands for two values here: only windows with its own values count.
    assert (17, 1) not in got or got[17, 1].windows < got[11, 1].windows
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.where("doc_id is not null").collect())) == sorted({12, 15, 16, 17, 18} - {d for d, _ in got})
    # The row without an id contains an item; another one would stay.
    assert kept.where("doc_id is null").isEmpty()
    more = docs.union(documents(spark, [(None, "nothing here", "s"), (10, "nor here", "s")], clash=True))
    assert sorted(r.text for r in decontaminate.drop_contaminated(more, bench).where("doc_id is null or doc_id = 10").collect()) == ["nor here", "nothing here"]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_items_of_numbers_and_names(spark):
    items = [
        (1, "What is 12 + 7 * 3 - 45 / 9 + 81 equal to?"), (2, "Sort 9, 4, 7, 1, 3, 8, 2, 6 in ascending order"),
        (3, "The signers were Adams, Franklin, Hancock, Jefferson, Rush, Morris, Penn, Clark, Hart, Stone, Lee, Paca and Wythe."),
        (4, "add 3 and 4"), (5, "when the red boat left the old harbour for the far islands"),
        (6, "a shop sold tea and bread for 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15 and 16 dollars"),
    ]
    rows = [(10 * i + k, x) for i, t in items for k, x in enumerate((t, f"Before: {t} and after", t.lower(), t.upper(), t.title()))]
    numbers = re.sub(r"\d+", lambda m: str(int(m[0]) + 100), items[5][1])
    rows += [(100, "Sort 1, 2, 3, 4, 5, 6, 7, 8 in ascending order"), (101, re.sub("Adams|Rush|Penn|Hart|Lee", "Smith", items[2][1])), (102, numbers)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(10 * i + k, i) for i, _ in items for k in range(5)} | {(102, 6)} == set(got)
    assert all(not r.changed and r.windows == r.item_windows for (d, _), r in got.items() if d < 100)
    assert got[102, 6].changed and got[10, 1].item_windows == 3


def test_one_common_shingle_makes_no_group(spark):
    """Large sets of which more than a list's worth share one shingle are no candidates; those that share enough are."""
    loose = [(i, 500, [-7, *range(1000 * i, 1000 * i + 100)]) for i in range(1, 101)]
    near = [(i, 500, [*range(-160, -100), *range(1000 * i, 1000 * i + 60)]) for i in range(201, 301)]
    tiny = [(i, 3, [-8]) for i in range(401, 471)]
    classes = spark.createDataFrame(loose + near + tiny, "node long, n long, prefix array<long>")
    got = {}
    for r in ngram_join.candidate_groups(classes).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [[*range(201, 301)], [*range(401, 471)]]


def test_only_pieces_of_long_texts_travel(spark):
    """Slots are compared in pieces of bounded size around the windows, also where a window lies across two of them."""
    item = "he had 40 red apples and gave 15 of them to his sister on the way to the old school"
    fill = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(6000)]
    rows = [(at, " ".join([*fill[:at], item.replace("40", "41") if at % 2 else item, *fill[at:]])) for at in (0, 1, 240, 249, 255, 256, 5000, 6000)]
    docs = spark.createDataFrame([*rows, (None, item), (7, " ".join(fill))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {at for at, _ in rows} | {None}
    assert all(r.windows == r.item_windows and r.changed == bool(d and d % 2) for d, r in got.items())
    hits = spark.createDataFrame([(5000, 5000), (5000, 5100), (255, 255), (255, 256)], "doc_id long, dpos int")
    pieces = decontaminate.hit_pieces(docs, hits).collect()
    assert sorted((r.d, r.p) for r in pieces) == [(255, 0), (255, 1), (5000, 19)]
    assert max(len(r.dw) for r in pieces) == decontaminate.PIECE + decontaminate.WINDOW - 1


def test_slots(spark):
    row = spark.range(1).select(F.lit("We met John Smith, 12.5 km from St. Paul; 3 kg and 4kg, 1,000 x2y").alias("t"))
    marked, template = row.select(decontaminate.marked_words(F.col("t")).alias("m"), decontaminate.template_words(F.col("t")).alias("t")).first()
    n, name, unit = decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT
    assert template == ["we", "met", name, name, n, unit, "from", name, "paul", n, unit, "and", n, unit, n, "x", n, "y"]
    assert len(marked) == len(template) and marked[2:4] == [name + "john", name + "smith"] and marked[4] != n + "125"


# Chat.


def plain_digests(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rnd = random.Random(8)
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "\\", "<\\\\|x", "a<", "|im_end|>", "", None, "line\nline", "🙂<|", "<|<|\\<\\|"]
    rows = []
    for c in range(30):
        for t in range(rnd.randrange(1, 25)):
            role = "system" if t == 0 and c % 3 == 0 else rnd.choice(["user", "assistant", "assistant", "odd\nrole <|im_start|>", None])
            rows.append((c, t, role, rnd.choice(odd) if rnd.random() < 0.3 else some_text(rnd, rnd.choice([1, 5, 30]))))
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", "ho"), (50, None, "user", "x"), (50, 1, "assistant", "y"), (51, 0, "assistant", some_text(rnd, 500))]
    rows += [(52, 0, "user", "same"), (52, 0, "user", "same"), (52, 1, "assistant", "same"), (52, 1, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("window", "pos", "begin", "c")})
    for span, history in ((20, 8), (40, 0), (1000, 100)):
        formatted = chat.format_windows(turns, span, history).cache()
        got = {r.conv_id: tuple(r)[1:5] for r in chat.conversation_digests(formatted).collect()}
        assert got == plain_digests(rows)
        if span == 20:
            check_windows(formatted.collect(), rows)
        assert {(w.conv_id, w.window) for w in formatted.collect()} == plain_windows(rows, span)
    assert chat.format_windows(turns.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.format_windows(turns, 10, 20)


def plain_windows(rows, span):
    """Windows packed turn by turn; each stretch of a conversation starts a new one."""
    by, out = {}, set()
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        begin, first, stretch = 0, None, None
        for pos, (*_, text) in enumerate(sorted(turns)):
            n, here = len(re.findall(common.WORD, text)), (begin + pos) // (span * chat.STRETCH)
            if here != stretch or begin + n - first > span:
                first, stretch = begin, here
                out.add((c, pos))
            begin += n
    return out


def test_no_chat_window_exceeds_its_budget(spark):
    rnd = random.Random(12)
    rows = [(c, t, rnd.choice(["user", "assistant"]), some_text(rnd, rnd.choice([0, 1, 7, 20, 45]))) for c in (1, 2, None) for t in range(900 if c == 1 else 40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_windows(turns, 20, 8).collect()
    assert {(w.conv_id, w.window) for w in got} == plain_windows(rows, 20)
    for w in got:
        new = [p.split("\n", 1)[1].removesuffix("<|im_end|>\n") for p in w.text.split("<|im_start|>")[1 + w.repeated :]]
        assert sum(len(x.split()) for x in new) <= 20 or len(new) == 1
    assert any(w.repeated for w in got)


def check_windows(windows, rows):
    assert max(w.window for w in windows) > 3 and any(w.repeated for w in windows)
    opening = {c for c, t, r, _ in rows if r == "system" and t == 0}
    for w in windows:
        pieces = w.text.split("<|im_start|>")[1:]
        assert all(p.endswith("<|im_end|>\n") for p in pieces)
        if w.conv_id in opening:  # every window starts with the system turn
            assert pieces[0].startswith("system\n")
        for span in w.targets:
            assert w.text[: span.at - 1].endswith("<|im_start|>assistant\n")
            assert w.text[span.at - 1 + span.len :].startswith("<|im_end|>\n")
        new = pieces[w.repeated :]
        assert sum(p.startswith("assistant\n") for p in new) == len(w.targets)
        history = [p for p in pieces[: w.repeated] if not (p.startswith("system\n") and w.conv_id in opening)]
        assert sum(len(p.split("\n", 1)[1].removesuffix("<|im_end|>\n").split()) for p in history) <= 8


# Top k.


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(300, 12)) / 3
    v[20:80] = v[20]
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [1.0, None] * 6), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (None, v[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("qb", "cb", "dim", "v", "rank")})
    vectors = topk.integer_vectors(frame)
    x = np.floor(64 * v.astype(np.float32).astype(float)).astype(int)
    s = x @ x.T
    for how in ({}, {"query_block": 4, "candidate_block": 50}):
        got = topk.exact_top_k(vectors.where("vec_id % 20 = 0"), vectors, 15, **how).collect()
        for q in range(0, 300, 20):
            want = sorted((-s[q, j], j) for j in range(300) if j != q)[:15]
            mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
            assert mine == [(k + 1, j, -n) for k, (n, j) in enumerate(want)]
        assert len(got) == 15 * 15
    wide = spark.createDataFrame([(int(i), (x * 2.0**22).tolist()) for i, x in enumerate(v[:60])], "vec_id long, embedding array<double>")
    big = np.floor(v[:60] * 2.0**28).astype(np.int64).astype(object)
    wide = topk.integer_vectors(wide)
    found = topk.exact_top_k(wide.where("vec_id % 20 = 0"), wide, 9, 2, 20).collect()
    for q in range(0, 60, 20):
        want = sorted((-(big[q] @ big[j]), j) for j in range(60) if j != q)[:9]
        assert sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q) == [(k + 1, j, -n) for k, (n, j) in enumerate(want)]
    with pytest.raises(ValueError):
        huge = topk.integer_vectors(spark.createDataFrame([(0, [3e17, 1.0]), (1, [3e17, 2.0])], "vec_id long, embedding array<double>"))
        topk.exact_top_k(huge, huge)
    few = topk.exact_top_k(vectors.where("vec_id = 0"), vectors.where("vec_id < 3"), 20).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert topk.exact_top_k(vectors.limit(0), vectors).count() == topk.exact_top_k(vectors, vectors.limit(0)).count() == 0


def test_bounds_hold():
    rnd = np.random.default_rng(3)
    q, c = rnd.normal(size=(30, 20)), rnd.normal(size=(40, 20))
    exact, last = q @ c.T, None
    for level in topk.LEVELS:
        (qm, qd), (cm, cd) = topk.segment_stats(q, level), topk.segment_stats(c, level)
        bound = qm @ cm.T + qd @ cd.T
        assert (bound >= exact - 1e-9).all()
        assert last is None or (bound <= last + 1e-9).all()
        last = bound


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299) if i != 150] + [(5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    left, right = order[:151], order[151:]
    assert got == {i: min(left) for i in left} | {i: min(right) for i in right}
