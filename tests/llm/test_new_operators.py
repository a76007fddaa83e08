"""Exact copies, spelling variants and conversation repair on small and awkward inputs, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimweave.llm import exact_dedup, ngram_join, repair, spelling, token_files

DOCS = "doc_id long, text string"
CLASH = ["n", "word", "run", "h", "sha", "block", "bits", "at", "first", "second", "least", "keep_id", "kept", "doc", "doc.b", "pos", "rows", "copy", "seg"]


def with_clashes(df):
    return df.withColumns({c: F.lit(c) for c in CLASH if c not in df.columns})


# Exact copies.


def plain_copies(rows):
    groups = {}
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups.setdefault(norm, []).append(i)
    out = []
    for norm, ids in groups.items():
        least = min(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept = [True] + [False] * (len(ids) - 1)
        out += [(i, least, len(ids), k, sha) for i, k in zip(sorted(ids, key=lambda i: (i is None, i or 0)), kept)]
    return sorted(map(repr, out))


COPIES = [(1, "a b"), (2, "a  b"), (3, "a\tb\n"), (4, "a b "), (5, " a b"), (6, None), (7, ""), (8, " "), (9, " "), (9, " "), (None, "a b"), (None, None)]
COPIES += [(20, "x " * 200_000), (21, "x  " * 200_000), (10, "same"), (10, "same"), (11, "A b"), (12, "é")] + [(i, "hot") for i in range(100, 300)]


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_BYTES, 0])
def test_copies_equal_plain_grouping(spark, limit):
    docs = with_clashes(spark.createDataFrame(COPIES, DOCS)).repartition(5)
    rows = docs.select("doc_id", exact_dedup.digest(F.col("text")).alias("sha"))
    got = exact_dedup.mark_copies(rows, broadcast_bytes=limit)
    got = got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("sha"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_copies(COPIES)
    got = exact_dedup.copy_groups(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_copies(COPIES)


def test_small_filters_give_the_same(spark):
    rnd = random.Random(5)
    rows = [(i, f"t{rnd.randrange(3000)}") for i in range(4000)]
    sha = spark.createDataFrame(rows, DOCS).select("doc_id", exact_dedup.digest(F.col("text")).alias("sha"))
    for cells in (1, 16):
        got = exact_dedup.mark_copies(sha, cells_per_row=cells)
        got = got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("sha"))
        assert sorted(repr(tuple(r)) for r in got.collect()) == plain_copies(rows)


def test_drop_copies_keeps_columns_and_rows(spark):
    docs = with_clashes(spark.createDataFrame(COPIES, DOCS))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    groups = {}
    for i, t in COPIES:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = sorted(repr(min(ids, key=lambda i: (i is None, i or 0))) for ids in groups.values())
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want
    empty = docs.where("false")
    assert exact_dedup.copy_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_copies_run_without_python(spark):
    plan = exact_dedup.copy_groups(spark.createDataFrame(COPIES, DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# Spelling variants.


def distance_is_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1] == 1


def plain_forms(vocab):
    near = {w: [v for v in vocab if distance_is_one(w, v)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best and vocab[best] >= 10 * n else None
    out = set()
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], vocab[form[w]] if form[w] else None, root))
    return out


def vocabulary(rnd, size, letters="abé", lengths=(7, 9)):
    words = {}
    while len(words) < size:
        words["".join(rnd.choice(letters) for _ in range(rnd.randint(*lengths)))] = rnd.choice([2, 3, 20, 30, 200, 300, 4000])
    return words


@pytest.mark.parametrize("slice_letters", [40, spelling.SLICE])
def test_near_words_equal_all_pairs(spark, slice_letters):
    vocab = vocabulary(random.Random(slice_letters), 160) | {"aaaaaaab" * 9: 3, "aaaaaaab" * 8 + "aaaaaaa": 40, "b" * 3000: 2, "b" * 2999: 30, "b" * 2998 + "ab": 2}
    vocab |= {"ab" * 40 + e: 2 for e in ("", "a", "b", "ba", "bb")}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    got = {tuple(r) for r in spelling.near_words(spark, df, slice_letters).collect()}
    want = set()
    for w in vocab:
        near = [v for v in vocab if spelling.one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-vocab[v], v))
            want.add((w, len(near), vocab[best], best))
    assert got == want


def test_one_edit_is_distance_one():
    words = ["".join(w) for k in range(5) for w in itertools.product("ab", repeat=k)]
    for a, b in itertools.product(words, repeat=2):
        assert spelling.one_edit(a, b) == distance_is_one(a, b)


def test_forms_and_roots(spark):
    rnd = random.Random(2)
    vocab = vocabulary(rnd, 200) | {"chainabc": 2, "chainabcd": 20, "chainabcde": 200, "chainabcdef": 2000}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    got = spelling.variant_forms(df)
    assert {tuple(r) for r in got.collect()} == plain_forms(vocab)
    assert ("chainabc", "chainabcdef") in {(r.word, r.root) for r in got.collect()}
    assert spelling.variant_forms(df.where("false")).count() == 0


def test_words_of_texts(spark):
    rows = [(1, "Zürichsee zürichsee ZÜRICHSEE, short abc1defghij"), (2, None), (3, ""), (None, "nobodyknows nobodyknows"), (3, "x" * 100_000), (3, "y÷z×abcd" * 3)]
    rows += [(i, "letterbox carpenter Überfluss") for i in range(200)]
    want = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] = want.get(run, 0) + 1
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    got = {r.word: r.n for r in spelling.vocabulary(spelling.damaged_words(docs), 1).collect()}
    assert got == want


# Conversation repair.


def plain_repair(rows):
    """Least (cost, letters) and the repaired lines, by dynamic programming from the end."""
    after = {0: (0, "", []), 1: (10, "II", ["user:", "assistant:"]), 2: (5, "I", ["assistant:"]), 3: (0, "", [])}
    for role, text, fault in reversed(rows):
        extra = 5 if fault == "truncated" else 0
        base = {}
        for s in range(4):
            to, name = (3, "assistant") if s == 2 else (2, "user")
            found = [(2 + after[s][0], "D" + after[s][1], after[s][2])]
            if fault not in ("blank", "duplicate"):
                k = {"u": 2, "a": 3, "s": 1}.get(role[:1])
                if k == to or (k == 1 and s == 0):
                    found.append((extra + after[k][0], "K" + after[k][1], [f"{role}:{text}"] + after[k][2]))
                found.append((1 + extra + after[to][0], "R" + after[to][1], [f"{name}:{text}"] + after[to][2]))
            base[s] = min(found)
        for _ in range(3):
            for s in range(4):
                to, name = (3, "assistant") if s == 2 else (2, "user")
                base[s] = min(base[s], (5 + base[to][0], "I" + base[to][1], [name + ":"] + base[to][2]))
        after = base
    return after[0]


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def some_conversation(rnd, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "ubiquitous"]
    texts = ["one.", "two!", "three?", "four", "", " \n", "six. ", "seven...\n", "İ\U0001f642"]
    return [(rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.4 else f"text {rnd.random()}.") for _ in range(n)]


def test_lattice_equals_dynamic_programming():
    rnd = random.Random(1)
    for n in [0, 1, 1, 1, 2, 2, 3, 4, 5, 8, 13, 30, 90] * 12:
        rows = plain_faults(some_conversation(rnd, n))
        kinds = [(r[:1], {"blank": 2, "duplicate": 2, "truncated": 1}.get(f, 0)) for r, _, f in rows]
        cost, audit, _ = plain_repair(rows)
        lattice = repair.Lattice(kinds, repair.FINAL, True)
        assert "".join(e[1] for e in lattice.edits_from(0)) == audit
        assert lattice.cost_from(0) == cost


def test_prices_are_dual():
    rnd = random.Random(4)
    for n in (1, 5, 40):
        rows = plain_faults(some_conversation(rnd, n))
        lattice = repair.Lattice([(r[:1], {"blank": 2, "duplicate": 2, "truncated": 1}.get(f, 0)) for r, _, f in rows], repair.FINAL, True)
        lattice.cost_from(0)
        for node in range(lattice.end):
            assert all(lattice.price[node] <= cost + lattice.price[to] for to, cost, _ in lattice.arcs[node])


@pytest.mark.parametrize("whole, segment", [(repair.WHOLE, repair.SEGMENT), (4, 3), (1, 1)])
def test_repairs_equal_plain(spark, whole, segment):
    rnd = random.Random(7)
    talks = {i: some_conversation(rnd, rnd.choice([1, 2, 4, 5, 9, 20])) for i in [*range(25), None]}
    talks[99] = some_conversation(rnd, 300)
    rows = [(i, k, r, t) for i, talk in talks.items() for k, (r, t) in enumerate(talk)]
    turns = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(3)
    edits = repair.repaired_turns(repair.faulty(turns), whole, segment).orderBy("pos", "step").collect()
    for i, talk in talks.items():
        mine = [e for e in edits if e.conv_id == i]
        cost, audit, lines = plain_repair(plain_faults(talk))
        assert "".join(e.edit for e in mine) == audit and sum(e.cost for e in mine) == cost
        assert [f"{e.role}:{e.text}" for e in mine if e.edit != "D"] == lines


def test_conversation_repairs(spark):
    rows = [(1, 0, "user", "hi."), (1, 3, "assistant", "yes."), (1, 3, "assistant", "yes."), (1, None, "system", "be kind."), (2, None, None, None)]
    rows += [(None, 5, "user", "a"), (4, 1, "user", "x" * 300_000 + "."), (4, 2, "assistant", "ok.")]
    turns = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in repair.conversation_repairs(turns.union(turns.limit(1).withColumn("conv_id", F.lit(77))), turns).collect()}
    assert set(got) == {1, 2, None, 4, 77}
    a = got[1]
    assert (a.gaps, a.blank, a.duplicate, a.truncated, a.illegal, a.cost, a.audit) == (2, 0, 1, 0, 1, 2, "KKKD")
    assert a.repaired_sha256 == hashlib.sha256(b"system:be kind.\nuser:hi.\nassistant:yes.").hexdigest()
    assert (got[2].gaps, got[2].blank, got[2].audit, got[2].cost) == (0, 1, "D", 2)
    assert (got[None].truncated, got[None].audit, got[None].cost) == (1, "D", 2)
    assert got[4].audit == "KK" and got[4].repaired_sha256 == hashlib.sha256(b"user:" + b"x" * 300_000 + b".\nassistant:ok.").hexdigest()
    assert (got[77].audit, got[77].cost, got[77].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    empty = turns.where("false")
    assert repair.conversation_repairs(empty, empty).count() == 0


def test_damage(spark):
    rows = [(i, t, "assistant", "Well. Yes! No?") for i in range(40) for t in range(3)] + [(None, None, None, None)]
    turns = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = []
    for i, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        want += [repr((i, t, "user" if d == 4 else role, text))] * (0 if d == 0 else 2 if d == 3 else 1)
    assert sorted(repr(tuple(r)) for r in repair.damaged(turns).collect()) == sorted(want)


# Earlier operators on inputs that they once failed on.


def test_ids_with_several_texts_keep_their_links(spark):
    rnd = random.Random(9)
    a, b, c = (" ".join(f"{k}{rnd.randrange(10**6)}" for _ in range(60)) for k in "abc")
    rows = [(1, a), (1, None), (2, a + " x"), (10, a), (10, b), (11, b + " x"), (20, c), (21, None), (None, c), (30, b), (40, "")]
    found = ngram_join.similar_components(spark.createDataFrame(rows, DOCS)).collect()
    got = {(r.doc_id, r.n_shingles): r.component_id for r in found}
    assert len(found) == len(rows)
    assert {i for (i, _), root in got.items() if root == 1} == {1, 2, 10, 11, 30}
    assert {root for (i, _), root in got.items() if i in (20, 21, 40)} == {20, 21, 40} and got[None, 56] is None
    assert got[1, 0] == 1 and got[1, 56] == 1


def test_token_ids_of_control_characters_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    library, mine, rnd = Tokenizer.from_file(path), token_files.WordIds(path), random.Random(8)
    signs = [chr(c) for c in (*range(0x20), 0x7F, 0x85, 0xA0, 0xAD)] + list(".,.,.,!?-_<|>\"' ") + ["a", "Zb", "é", "ÿ", "1", "22", "\ud7ff", "ß"]
    for _ in range(30_000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 7)))
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
