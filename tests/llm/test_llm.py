"""Operators for text and training data: definite cases, brute force, round trips, held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest
from compare import spark_rows, sql_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.llm import bpe, leakage, overlap, pii, pii_model, pii_training, quota_sample, residue
from scoreloom.llm import queries as q
from scoreloom.llm.wording import aligned, close, words

LONG = "word " * 60_000


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_equals_sql(spark, con, data, name):
    assert spark_rows(q.QUERIES[name](spark, data)) == sql_rows(con, q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, data, name):
    df = q.QUERIES[name](spark, data)
    assert df.columns and df.collect() is not None


def test_columns_of_found(spark, data):
    want = {
        "p1_found": [("table_name", "string"), ("record_id", "bigint"), ("turn_no", "int"), ("pii_type", "string"), ("item_no", "int")],
        "p4_found": [("load_no", "int"), ("dimension", "string"), ("category", "string")],
        "p5_found": [("row_id_a", "bigint"), ("row_id_b", "bigint")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p8_found": [("doc_id", "bigint")],
    }
    for name, columns in want.items():
        assert q.QUERIES[name](spark, data).dtypes == columns


# --- personal information ---------------------------------------------------------------------------

CASES = {
    "You can reach me at anna.lindquarry@example.org or 614-555-0123 any day.": ["email", "phone"],
    "They know me. My supervisor is Mireya Zabrowen. Thanks for reading this.": ["name"],
    "Here is my id, 966-11-2786, for the background check. We rent here.": ["id_number"],
    "The house is at 5806 County Line Street, Ivenmouth, CT 11190. I work there.": ["address"],
    "I have not once missed a payment in six years. The Venbrook store card cut my limit by $25900.": [],
    "My last loan ref was C09800/98. Paid Halden Finance on 03-14-2012 and 04-14-2012.": [],
}


def test_tagger_cases():
    tagger = pii_model.Tagger.load()
    for text, want in CASES.items():
        for t in (text, text.lower()):
            assert [k for *_, k in pii.tidy(t, tagger.spans([t])[0])] == want, t


def test_tagger_on_held_out_rows(data):
    """Rows of the smallest tables, which training did not see: recall and precision by type."""
    texts, listed = pii_training.sample(data)
    more, _ = pii_training.sample(data.replace("sf0.001", "sf0.01"))
    label = pii_training.labeller(more + texts, listed)
    tagger = pii_model.Tagger.load()
    want, got, both = Counter(), Counter(), Counter()
    for t, s in zip(texts, tagger.spans(texts)):
        a, b = Counter(k for *_, k in label(t)), Counter(k for *_, k in pii.tidy(t, s))
        want, got, both = want + a, got + b, both + (a & b)
    total = sum(both.values())
    assert total >= 0.93 * sum(want.values()) and total >= 0.93 * sum(got.values())


def test_windows_agree_with_whole_text():
    tagger = pii_model.Tagger.load()
    text = " ".join(list(CASES)[:6]) * 12
    spans = tagger.spans([text])[0]
    assert Counter(k for *_, k in pii.tidy(text, spans))["email"] == 12
    assert tagger.spans(["", "x"]) == [[], []]


def test_viterbi_shortcut_is_exact():
    tagger = pii_model.Tagger.load()
    rng = np.random.default_rng(0)
    em = [(rng.normal(size=(n, 6)) * 3 + np.array([lead, 0, 0, 0, 0, 0])).astype(np.float32) for lead in (0, 2, 4, 6) for n in (0, 1, 2, 3, 40, 300)]
    fast = tagger.decode(em)
    tagger.need = -1e9
    assert all((a == b).all() for a, b in zip(fast, tagger.decode(em)))


def test_masking_and_edges(spark):
    rows = [(1, "Reply to a.b@example.org, I check it daily."), (2, None), (3, ""), (4, "  "), (1, "Reply to a.b@example.org, I check it daily."), (None, LONG), (6, "😀 ok")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("text", F.lit("clash")).withColumn("record_id", F.lit(9))
    texts = pii.texts_of(df, "tab", "id", "t")
    assert [(r.record_id, r.pii_type, r.item_no) for r in pii.find_items(texts).collect()] == [(1, "email", 1)] * 2
    out = pii.find_items(texts, with_text=True).where("record_id = 1").first()
    assert out.masked_text == "Reply to [EMAIL], I check it daily." and out.n_items == 1
    assert pii.find_items(texts.limit(0)).count() == 0
    chat = spark.createDataFrame([(5, [("human", None), ("gpt", "Reply to a.b@example.org, I check it daily.")]), (6, None)], "s long, c array<struct<from:string,value:string>>")
    assert [(r.record_id, r.turn_no) for r in pii.find_items(pii.turns_of(chat, "t", "s", "c", "value")).collect()] == [(5, 2)]


def test_training_learns():
    """A few steps on labelled texts lower the loss and give a usable model."""
    data = [("write to joe@example.org today", [(9, 24, "email")]), ("nothing to see here at all", [])] * 40
    seen = []
    w = pii_training.train(data, epochs=6, size=16, log=lambda m, **_: seen.append(float(m.split(": ")[1].split()[0])))
    assert seen[-1] < 0.5 * seen[0] and pii_model.Tagger(w).trans.shape == (6, 6)


# --- samples ------------------------------------------------------------------------------------------


@given(st.lists(st.lists(st.floats(0, 9), min_size=3, max_size=3), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_controlled_rounding(table):
    t = np.array(table)
    whole = quota_sample.controlled_rounding(t)
    for a, b in ((whole, t), (whole.sum(0), t.sum(0)), (whole.sum(1), t.sum(1)), (whole.sum(), t.sum())):
        assert (np.abs(a - b) < 1 + 1e-6).all()


def test_sample_meets_quotas(spark):
    r = random.Random(5)
    rows = [(i, 1, "AB"[r.random() < 0.3], "01"[r.random() < 0.4]) for i in range(3000)] + [(9000, 2, "A", "0"), (9001, None, None, "1")]
    df = spark.createDataFrame(rows, "id long, load int, grade string, target string").withColumn("rank", F.lit(0)).withColumn("quota", F.lit(1)).withColumn("bucket", F.lit(1))
    targets = spark.createDataFrame([(1, "grade", "A", 0.5, 2, 100), (1, "grade", "B", 0.5, 2, 100), (1, "target", "0", 0.7, 2, 100), (1, "target", "1", 0.3, 2, 100), (2, "grade", "G", 0.5, 3, 10), (3, "grade", "A", None, None, None)], "load int, dimension string, category string, target_share double, min_rows long, sample_rows long")
    quota, report = quota_sample.plan(df, targets, "load", ("grade", "target"))
    drawn = quota_sample.draw(df, quota, "load", ("grade", "target"), "id").collect()
    assert len(drawn) == 100 == len({x.id for x in drawn})
    assert Counter(x.grade for x in drawn) == {"A": 50, "B": 50} and Counter(x.target for x in drawn) == {"0": 70, "1": 30}
    assert sorted(x.id for x in drawn) == sorted(x.id for x in quota_sample.draw(df.repartition(5), quota, "load", ("grade", "target"), "id").collect())
    assert [(x.load, x.category) for x in report.where("NOT met").collect()] == [(2, "G")]
    none, report = quota_sample.plan(df.limit(0), targets, "load", ("grade", "target"))
    assert none.count() == 0 and report.where("NOT met").count() == 5


def sampled(spark, cells, targets):
    """Report by category of records given by cell, and the drawn records."""
    rows = [(f"{g}{t}{i}", 1, g, t) for (g, t), n in cells.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, load int, grade string, target string")
    wanted = spark.createDataFrame([(1, d, c, share, least, size) for d, c, share, least, size in targets], "load int, dimension string, category string, target_share double, min_rows long, sample_rows long")
    quota, report = quota_sample.plan(df, wanted, "load", ("grade", "target"))
    drawn = quota_sample.draw(df, quota, "load", ("grade", "target"), "id")
    found = {(r.dimension, r.category): r for r in quota_sample.judged(report, quota, drawn, "load", ("grade", "target")).collect()}
    return found, drawn.collect()


def test_margins_that_exclude_each_other_are_reported_short(spark):
    """All of A is good and all of B is bad, so 80 of A cannot go with 50 bad ones."""
    found, drawn = sampled(spark, {("A", "0"): 100, ("B", "1"): 100}, [("grade", "A", 0.8, 1, 100), ("grade", "B", 0.2, 1, 100), ("target", "0", 0.5, 1, 100), ("target", "1", 0.5, 1, 100)])
    assert all(r.attainable and r.drawn == r.rounded for r in found.values()) and all(r.met == (r.drawn >= r.asked) for r in found.values())
    assert sum(r.short_by for r in found.values()) > 0 and not all(r.met for r in found.values())
    for d in ("grade", "target"):
        assert sum(r.drawn for (x, _), r in found.items() if x == d) == len(drawn)


def test_margins_that_go_together_are_met(spark):
    cells = {("A", "0"): 60, ("A", "1"): 7, ("B", "0"): 300, ("B", "1"): 200, ("C", "0"): 9, ("C", "1"): 30}
    found, drawn = sampled(spark, cells, [("grade", "A", 0.3, 5, 120), ("grade", "B", 0.5, 5, 120), ("grade", "C", 0.2, 5, 120), ("target", "0", 0.6, 5, 120), ("target", "1", 0.4, 5, 120)])
    assert len(drawn) == 120 and all(r.met and abs(r.drawn - r.asked) < 1 for r in found.values())


def test_draw_ranks_only_the_last_bucket(spark):
    df = spark.range(5000).selectExpr("id", "1 AS load", "'A' AS grade", "'0' AS target")
    quota = spark.createDataFrame([(1, "A", "0", 1234)], "load int, grade string, target string, quota long")
    got = [r.id for r in quota_sample.draw(df, quota, "load", ("grade", "target"), "id").collect()]
    key = df.select("id", F.pmod(F.xxhash64("id", F.lit("42")), F.lit(2**52)).alias("k")).orderBy("k", "id").limit(1234)
    assert sorted(got) == sorted(r.id for r in key.collect())


def test_shortfall_comes_from_the_drawn_sample(spark, data):
    rows = q.p4_report(spark, data).collect()
    assert any(x.drawn for x in rows) and all(x.drawn == x.rounded <= x.eligible for x in rows)
    short = {(x.load_no, x.dimension, x.category) for x in rows if x.drawn < x.asked - 1e-9 and x.eligible < x.asked - 1e-9}
    assert {tuple(x) for x in q.p4_found(spark, data).collect()} == short


# --- overlaps -----------------------------------------------------------------------------------------


def noisy(w, r, share):
    out = []
    for x in w:
        roll = r.random()
        if roll < share / 3:
            continue
        out.append(x[:-1] + "q" + x[-1] if roll < share / 2 and len(x) > 4 else "zzz" if roll < share else x)
    return out


def test_overlaps_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in ("all", "ent", "ork") for c in ("ing", "ed", "s", "er")]
    base = [[r.choice(vocabulary) for _ in range(r.randint(15, 90))] for _ in range(120)]
    rows = [(i, "train_fit" if i % 2 else "test", " ".join(w)) for i, w in enumerate(base)]
    for i in range(200, 320):
        w = base[r.randrange(120)]
        rows.append((i, r.choice(["train_fit", "validation", None]), ", ".join(noisy(w, r, r.choice([0, 0.05, 0.15]))).upper()))
    rows += [(900, "test", None), (901, "train_fit", ""), (902, "test", LONG), (903, "train_fit", LONG), (None, "test", rows[1][2])]
    df = spark.createDataFrame(rows, "id long, split string, t string").withColumn("k", F.lit(1)).withColumn("cls", F.lit("x"))
    got = [tuple(x) for x in overlap.cross_split_overlaps(df, "id", "t", "split", "train_fit").collect()]
    want = set()
    known = [(i, s == "train_fit", words(t)) for i, s, t in rows if i is not None and t and i < 900]
    known = [x for x in known if len(x[2]) >= 20]
    for a in known:
        for b in known:
            if a[0] < b[0] and a[1] != b[1] and 3 * overlap.same_order_words(a[2], b[2]) >= 2 * max(len(a[2]), len(b[2])):
                want.add((a[0], b[0]))
    want.add((902, 903))
    assert len(got) == len(set(got)) and set(got) == want
    assert overlap.cross_split_overlaps(df.limit(0), "id", "t", "split", "train_fit").count() == 0


def test_hot_stock_wording_is_read_deeper(spark):
    stock = "this sentence of stock wording is found in every single letter of the whole collection of letters"
    rows = [(i, "train_fit" if i % 2 else "test", stock + " " + " ".join(f"n{i}x{j}" for j in range(30))) for i in range(80)] + [(100, "test", stock + " " + " ".join(f"n7x{j}" for j in range(30)) + " end")]
    df = spark.createDataFrame(rows, "id long, split string, t string")
    assert [tuple(x) for x in overlap.cross_split_overlaps(df, "id", "t", "split", "train_fit").collect()] == [(7, 100)]


def test_large_family_of_near_copies_is_paired_whole(spark):
    base = [f"w{j}" for j in range(100)]
    rows = [(i, "train_fit" if i % 2 else "test", " ".join([*base[: i // 2], f"own{i}", *base[i // 2 + 1 :]])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, split string, t string")
    got = [tuple(x) for x in overlap.cross_split_overlaps(df, "id", "t", "split", "train_fit").collect()]
    assert len(got) == 10_000 and set(got) == {(min(i, j), max(i, j)) for i in range(0, 200, 2) for j in range(1, 200, 2)}


def brute_pairs(rows):
    known = [(i, s == "train_fit", words(t)) for i, s, t in rows]
    spelling = overlap.Spelling({w for *_, t in known for w in t})
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in known for b in known if a[1] and not b[1] and 3 * overlap.same_order_words(a[2], b[2], spelling) >= 2 * max(len(a[2]), len(b[2]))}


def family(size, changes, seed, n_words=120):
    """Near copies of one text, each with its own words at its own places."""
    r = random.Random(seed)
    base = [f"{r.choice('bcdfgklm')}{r.choice(['all', 'ent', 'ork', 'ist'])}{j}" for j in range(n_words)]
    rows = []
    for i in range(size):
        w = list(base)
        for j in r.sample(range(n_words), changes):
            w[j] = f"own{i}x{j}"
        rows.append((i, "train_fit" if i % 2 else "test", " ".join(w)))
    return rows


@pytest.mark.parametrize("size,changes", [(12, 3), (40, 3), (100, 3), (400, 3), (60, 9)])
def test_families_give_all_pairs(spark, size, changes):
    rows = family(size, changes, size)
    got = [tuple(x) for x in overlap.cross_split_overlaps(spark.createDataFrame(rows, "id long, split string, t string"), "id", "t", "split", "train_fit").collect()]
    want = brute_pairs(rows) if size <= 100 else {(min(i, j), max(i, j)) for i in range(0, size, 2) for j in range(1, size, 2)}
    assert len(want) == size * size // 4 and len(got) == len(set(got)) and set(got) == want


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 3)
    rows = family(60, 3, 1)
    got = overlap.cross_split_overlaps(spark.createDataFrame(rows, "id long, split string, t string"), "id", "t", "split", "train_fit").collect()
    assert {tuple(x) for x in got} == brute_pairs(rows) and len(got) == 900


def test_pairs_without_two_words_in_a_row_are_found(spark):
    """Every third word of either text is another or misspelt; some texts repeat few words."""
    r = random.Random(8)
    stock = ["payment", "account", "interest", "balance", "kitchen", "december", "recently", "employer", "schedule", "workshop", "card", "care", "loan", "monthly"]
    rows = []
    for i in range(40):
        base = [r.choice(stock) if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 16))) for _ in range(r.randint(20, 60))]
        other = [w if j % 3 < 2 else f"new{i}x{j}" for j, w in enumerate(base)]
        wrong = [w if j % 3 < 2 else w[:1] + w[2:] if j % 2 else w[:2] + "q" + w[2:] for j, w in enumerate(base)]
        gaps = [w for j, w in enumerate(base) if j % 3 != 1]
        gaps = [x for j, w in enumerate(gaps) for x in ([w] if j % 2 else [f"add{i}x{j}", w])][: len(base)]
        rows += [(10 * i, "train_fit", " ".join(base)), (10 * i + 1, "test", " ".join(other)), (10 * i + 2, "validation", " ".join(wrong)), (10 * i + 3, None, " ".join(gaps)), (10 * i + 4, "test", " ".join(reversed(base)))]
    want = brute_pairs(rows)
    got = [tuple(x) for x in overlap.cross_split_overlaps(spark.createDataFrame(rows, "id long, split string, t string"), "id", "t", "split", "train_fit").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(10 * i, 10 * i + k) for i in range(40) for k in (1, 2)} <= want


def test_bounds_are_never_too_small():
    """Whatever the buckets, laid out or not, counted repeats, long texts and words."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abc") for _ in range(r.randint(2, 20))) for _ in range(120)] + ["17", "18"]
    vocabulary += [w[:1] + w[2:] for w in vocabulary if len(w) > 4]
    lines = [[r.choice(vocabulary[: r.choice([5, 60, 300])]) for _ in range(r.choice([20, 60, 400]))] for _ in range(60)]
    key, known = overlap._Words(), sorted({w for x in lines for w in x})
    near = np.array([(key[w], key[v], sum(v in x for x in lines)) for w in known for v in known if w != v and close(w, v)], np.int64)
    spelling = overlap.Spelling(set(known))
    for laid_out in (False, True):
        buckets = overlap.Buckets(near)
        if laid_out:
            overlap._laid_out(buckets, [" ".join(x) for x in lines])
        counts, opened = buckets.marks([" ".join(x) for x in lines], key)
        most = counts @ opened.T.astype(int)
        for i, a in enumerate(lines):
            for j, b in enumerate(lines):
                assert overlap.same_order_words(a, b, spelling) <= min(most[i, j], most[j, i])


def test_products_of_packed_columns_are_those_of_each_pair():
    r = np.random.default_rng(2)
    for size, size2, most in ((300, 1700, 2), (5, 1, 9), (40, 3100, 1), (30, 70, 40)):
        counts = r.integers(0, most + 1, (size, overlap.BUCKETS)) * (r.random((size, overlap.BUCKETS)) < 0.3)
        opened, counts2 = r.random((size2, overlap.BUCKETS)) < 0.7, r.integers(0, 2, (size2, overlap.BUCKETS))
        counts2[: size2 // 2] = (counts.sum(1).mean() / overlap.BUCKETS + r.random((size2 // 2, overlap.BUCKETS))).astype(int)
        opened2 = r.random((size, overlap.BUCKETS)) < 0.8
        n, m = counts.sum(1), counts2.sum(1)
        got = [x for a, b in overlap.may_match((n, counts, opened2), (m, counts2, opened)) for x in zip(a.tolist(), b.tolist())]
        least = np.ceil(2 / 3 * np.maximum(n[:, None], m[None]) - 1e-9)
        want = np.minimum(np.minimum(counts @ opened.T.astype(int), opened2.astype(int) @ counts2.T), np.minimum(n[:, None], m[None])) >= least
        assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero(want))))


def test_order_bounds_are_never_too_small():
    """Of pairs as they are, of long ones, and exact where no two words are close."""
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abc") for _ in range(r.randint(2, 9))) for _ in range(90)] + [str(i) for i in range(40)]
    key = overlap._Words()
    for sizes in ((20, 30), (60, 64, 65, 90), (127, 128, 129, 190), (700, 1100)):
        lines = [[r.choice(vocabulary[: r.choice([4, 130])]) for _ in range(r.choice(sizes))] for _ in range(40 if max(sizes) < 500 else 6)]
        lines += [[w for w in x if r.random() < 0.8] for x in lines]
        known = sorted({w for x in lines for w in x})
        near = np.array([(key[w], key[v], 1) for w in known for v in known if w != v and close(w, v)], np.int64).reshape(-1, 3)
        for some in (near, near[:0]):
            buckets, spelling = overlap.Buckets(some), overlap.Spelling(set(known) if len(some) else set())
            owner, h = overlap._hashes([" ".join(x) for x in lines], key)
            block = overlap._Lines(np.bincount(owner), buckets.grouped(h))
            a, b = (x.ravel() for x in np.meshgrid(np.arange(len(lines)), np.arange(len(lines))))
            want = np.array([3 * overlap.same_order_words(lines[i], lines[j], spelling) >= 2 * max(len(lines[i]), len(lines[j])) for i, j in zip(a, b)])
            got = overlap._in_line(block, block, a, b)
            assert not (want & ~got).any() and want.sum() > len(lines)
            assert len(some) or (want == got).all()


def test_texts_of_the_same_words_in_another_order_are_not_fetched(spark):
    r = random.Random(11)
    base = [f"w{j}" for j in range(60)]
    rows = [(i, 1 + i % 2, " ".join(r.sample(base, 60))) for i in range(40)] + [(40, 1, " ".join(base)), (41, 2, " ".join(base[:58]))]
    texts = spark.createDataFrame([(i, line, side, len(line.split()), i) for i, side, line in rows], "c long, line string, side int, n int, h1 long")
    assert [tuple(x) for x in overlap._meetings(texts).collect()] == [(40, 41)]


def test_close_words_have_a_key_in_common():
    r = random.Random(6)
    some = {"".join(r.choice("abcd") for _ in range(n)) for n in (3, 5, 7, 8, 10, 11, 12, 13, 14, 15, 16, 25) for _ in range(5)}
    pairs = [(w, v[:j] + y + v[j + e :]) for w in some for x, d in (("", 1), ("a", 0), ("b", 1)) for k in (0, len(w) // 2, len(w) - 1) for v in [w[:k] + x + w[k + d :]] for y, e in (("", 0), ("", 1), ("c", 0), ("c", 1)) for j in (0, len(v) // 3, len(v))]
    pairs = [(a, b) for a, b in pairs if a != b and close(a, b)]
    assert len(pairs) > 800 and all(overlap.spelling_keys(a) & overlap.spelling_keys(b) for a, b in pairs)


def test_classes_and_links_do_not_expand_copies(spark):
    text = " ".join(f"w{j}" for j in range(30))
    rows = [(i, "train_fit" if i % 3 else "test", text) for i in range(90)] + [(100, "test", text + " more")]
    members, links = overlap.classes_and_links(spark.createDataFrame(rows, "id long, split string, t string"), "id", "t", "split", "train_fit")
    assert members.count() == 91 and members.select("c").distinct().count() == 2 and links.count() == 2


def test_spelling_finds_every_close_word():
    r = random.Random(5)
    vocabulary = {"".join(r.choice("abc") for _ in range(r.randint(2, 11))) for _ in range(300)} | {"x" * 30, "x" * 29 + "y", "x" * 23, "x" * 24}
    spelling = overlap.Spelling(vocabulary)
    for w in vocabulary:
        assert sorted(spelling.of(w)) == sorted(v for v in vocabulary if v != w and close(w, v))


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.choice("abcdef") for _ in range(r.randint(0, 30))] for _ in range(2))
        assert overlap.same_order_words(a, b) == len(aligned(a, b))
    assert overlap.same_order_words("the laon was granted".split(), "the loan was granted".split()) == 4
    assert close("payment", "paymnet") and close("granted", "grantd") and not close("2011", "2012") and not close("cat", "dog")


# --- encoding -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(f"{q.TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{q.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@given(texts=st.lists(st.text(alphabet=" '\n\tsStrevlmdaZ1²漢é!.  \x1f’<|>endoftx😀", max_size=40), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoding_equals_library(encoder, reference, texts):
    assert encoder.encode(texts)[0] == [x.ids for x in reference.encode_batch(texts, add_special_tokens=False)]


def test_encoding_edges(spark, encoder, reference):
    rows = [(1, None), (2, ""), (3, " "), (None, "<|endoftext|>"), (3, " "), (5, "a" * 50_000), (6, LONG)]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("k", F.lit("clash")).withColumn("ids", F.lit(1))
    out = bpe.encode_corpus(df, "id", "t", f"{q.TOKENIZERS}/byte_bpe_50k.tiktoken", offsets=True).collect()
    want = Counter((i, tuple(reference.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.id, tuple(r.ids)) for r in out) == want
    assert all(len(r.ids) == len(r.offsets) for r in out)
    assert bpe.encode_corpus(df.limit(0), "id", "t", f"{q.TOKENIZERS}/byte_bpe_50k.tiktoken").count() == 0


def test_round_trip_and_scan_blocks(encoder):
    text = "It's  a test, isn't it?\n\n 12 été 漢字 'twas " * 300
    ids, offsets = encoder.encode([text, text[:5]])
    assert encoder.decode(ids[0]) == text and encoder.decode(ids[1]) == text[:5]
    assert offsets[0][0] == 0 and offsets[0] == sorted(offsets[0])
    small = bpe.Encoder(f"{q.TOKENIZERS}/byte_bpe_50k.tiktoken", cache_size=3)
    assert small.encode([text])[0][0] == ids[0]


# --- leakage ----------------------------------------------------------------------------------------------

STOCK = "Answer with one word only please."
ITEMS = [(i, f"{STOCK}\nThe {a} file from {b} lists {n} open lines, the oldest dating from {m} {y}, with {p} percent in use. A transfer to {b} doubles the commute and frees ${n}50 of fuel money.") for i, (a, b, n, m, y, p) in enumerate([("old", "Tarnby", 14, "July", 2011, 7), ("new", "Ostrow", 23, "May", 2016, 31), ("first", "Corvane", 9, "June", 2004, 22), ("last", "Dunmere", 31, "March", 2018, 12)] + [(f"kind{k}", f"Place{k}", 40 + k, f"Month{k}", 1950 + k, 50 + k) for k in range(10)])]


def test_leaks(spark):
    own = leakage.own_wording(ITEMS)
    assert all("please" not in w for w in own.values())
    full = ITEMS[0][1].split("\n")[1]
    half = " ".join(full.split()[4:28])
    docs = [(1, "Before. " + full + " After."), (2, "x " + full.upper().replace(",", "") + " y"), (3, full.replace("a", "а").replace("open", "opeen")), (4, " ".join(full.split()[:9])), (5, full.replace("Tarnby", "Velden").replace("14", "88").replace("July 2011", "April 1999").replace("7 percent", "61 percent")), (6, STOCK), (7, None), (8, ""), (9, LONG + half), (1, full), (10, ITEMS[1][1] + " " + full), (None, full)]
    df = spark.createDataFrame(docs, "doc long, t string").withColumn("item", F.lit("clash")).withColumn("k", F.lit(1))
    items = spark.createDataFrame([*ITEMS, (50, None), (51, ""), (52, STOCK), (None, full)], "item_id long, text string")
    got = Counter((r.doc, r.item_id) for r in leakage.find_leaks(df, "doc", "t", items, "item_id", "text").collect())
    assert got == Counter({(1, 0): 2, (2, 0): 1, (3, 0): 1, (9, 0): 1, (10, 0): 1, (10, 1): 1, (None, 0): 1})
    assert leakage.find_leaks(df, "doc", "t", items.limit(0), "item_id", "text").count() == 0
    assert leakage.find_leaks(df.limit(0), "doc", "t", items, "item_id", "text").count() == 0


def test_later_stretch_is_checked_where_an_earlier_one_has_other_facts():
    full = ITEMS[0][1].split("\n")[1]
    other = full.replace("Tarnby", "Velden").replace("14", "88").replace("July 2011", "April 1999").replace("7 percent", "61 percent").replace("$1450", "$8850")
    true = " ".join(full.replace("oldest", "oldets").replace("transfer", "transfre").replace("doubles", "doubels").replace("commute", "comute").replace("lists", "lsits").split()[:26])
    auto = leakage.Automaton(leakage.own_wording(ITEMS))
    assert not [x for x in auto.leaks(words(other)) if x[0] == 0] and [x for x in auto.leaks(words(true)) if x[0] == 0]
    for between in (" ", " and then " + "filler " * 300):
        assert [x[0] for x in auto.leaks(words(other + between + true)) if x[0] == 0] == [0]


def test_items_with_equal_texts_are_all_reported(spark):
    items = spark.createDataFrame([*ITEMS, (70, ITEMS[0][1]), (71, ITEMS[0][1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before. " + ITEMS[0][1] + " After.")], "doc long, t string")
    assert sorted(r.item_id for r in leakage.find_leaks(docs, "doc", "t", items, "item_id", "text").collect()) == [0, 70, 71]


def test_three_items_of_one_text_and_short_and_chinese_ones(spark):
    case = "借款人说他在南京的工厂上班已经有十二年并且每个月按时还款四千元"
    items = spark.createDataFrame([*ITEMS, (70, ITEMS[0][1]), (71, ITEMS[0][1]), (72, ITEMS[0][1]), (80, "Quillbay terms"), (90, case)], "item_id long, text string")
    docs = [(1, ITEMS[0][1]), (2, "He named the Quillbay terms twice."), (3, "He named Quillbay and its terms."), (4, "前面的话。" + case[:8] + "，" + case[8:] + "。后面的话。"), (5, case[:6])]
    got = {(r.doc, r.item_id) for r in leakage.find_leaks(spark.createDataFrame(docs, "doc long, t string"), "doc", "t", items, "item_id", "text").collect()}
    assert got == {(1, 0), (1, 70), (1, 71), (1, 72), (2, 80), (4, 90)}


def test_many_blocks_in_one_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ITEMS)] * 3, "doc long, t string").repartition(2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(map(tuple, leakage.find_leaks(docs, "doc", "t", items, "item_id", "text").collect()))
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 1)
    monkeypatch.setattr(leakage, "HELD_CHARS", 500)
    parted = leakage.find_leaks(docs, "doc", "t", items, "item_id", "text")
    assert sorted(map(tuple, parted.collect())) == whole and len(whole) >= 3 * len(ITEMS)
    assert parted._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    monkeypatch.setattr(leakage, "MOST_WORDS", 100)
    with pytest.raises(ValueError):
        leakage.find_leaks(docs, "doc", "t", items, "item_id", "text")


def test_automaton_finds_longest_matches():
    r = random.Random(2)
    texts = {i: [r.choice("abc") for _ in range(40)] for i in range(5)}
    auto = leakage.Automaton(texts)
    doc = [r.choice("abc") for _ in range(120)]
    got = {(i, s, p, n) for i, runs in auto.matches(doc).items() for s, p, n in runs}
    for i, s, p, n in got:
        assert doc[s : s + n] == texts[i][p : p + n]
    best = max(n for *_, n in got)
    brute = max(n for t in texts.values() for s in range(120) for p in range(40) for n in range(1, 41) if p + n <= 40 and s + n <= 120 and doc[s : s + n] == t[p : p + n])
    assert best == brute


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEMS[2][1]), (2, ITEMS[3][1])], "doc long, t string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    assert {(r.doc, r.item_id) for r in leakage.find_leaks(docs, "doc", "t", items, "item_id", "text").collect()} == {(1, 2), (2, 3)}


def test_cleaning_takes_the_stretch_out():
    full = ITEMS[0][1].split("\n")[1]
    text = "Before it. " + full + " After it."
    own = leakage.own_wording(ITEMS)
    (item, _, a, b), *_ = leakage.Automaton(own).leaks(words(text))
    assert leakage.without_leaks(text, [(a, b)]) == "Before it. After it."


# --- residue ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text",
    [
        "Dear {{ name }}, thank you for your request for [[amount]].", "DEAR [YOUR NAME], WE HAVE RECEIVED ${CITY}.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Placeholder text goes here.", "TODO: fill in dti. xxxx xxxx xxxx",
        "404 - Page not found\nnginx", "<html><head><title>502 Bad Gateway</title></head><body>502 Bad Gateway</body></html>", "A sound sentence first. Oops! This link seems broken.", '{"status": "error", "code": 12, "message": "x"}', "Please enable JavaScript to continue.",
        "<noscript>Turn on scripting, then refresh.</noscript>", "页面未找到（错误代码560），请返回首页。", "Active el JavaScript de su navegador para ver esta página.", "Traceback (most recent call last):\n  File \"x.py\"",
    ],
)
def test_residue(text):
    assert residue.signs(text, "s")[0]


@pytest.mark.parametrize(
    "text",
    [
        "In the template review we quoted 'Dear {{first_name}}' as the old greeting; it was fixed.", "Filler like 'lorem ipsum' was seen in six drafts.", "The portal showed a 404 page to two borrowers on Friday.", "Borrowers without JavaScript could not finish the form.",
        "Items marked TBD in the July plan are thin files.", '<think>dti ok</think>{"action": "approve"}', "SELECT grade, count(*) FROM loans GROUP BY grade;", "The word undefined shows up 11 times in grade.", "A session that expires after 3 seconds slowed the desk.", "",
    ],
)
def test_no_residue(text):
    assert not residue.signs(text, "s")[0]


@pytest.mark.parametrize("text", ["Dear {{name}}, your repayment plan of {{amount}} starts on {{date}}.", "[Insert applicant statement here]", "As we said, {{borrower}} raised {{amount}}.", "A sound sentence.\n{{ body }}\n"])
def test_unfilled_slots_beside_everyday_words(text):
    assert residue.signs(text, "s")[0] == ["template"]


@pytest.mark.parametrize("text", ["The placeholder {{name}} and the field {{date}} were dropped.", "The old letter began with '[Insert name here]'.", "One part\n____\nand the next"])
def test_slots_that_are_spoken_of(text):
    assert not residue.signs(text, "s")[0]


@pytest.mark.parametrize(
    "text",
    [
        "Sorry, this website is temporarily unavailable for maintenance. Please retry later.", "Login expired. Please sign in again to continue.", "The requested file could not be loaded. Check your network connection and reload.", "This browser does not support cookies. Enable cookies, then refresh the page.",
        "A sound sentence about a loan comes first.\n503 Service Unavailable", "Write your paragraph here. Insert dummy text.", "Sr. [client name here] of %%town%%", "Sed tellusi ornarum pellente, mauriso vulputo amet.", "浏览器版本过低，请升级后重新打开页面。", "La página solicitada no existe en este servidor.",
    ],
)
def test_residue_in_wording_of_its_own(text):
    assert residue.signs(text, "s")[0]


@pytest.mark.parametrize(
    "text",
    [
        "The lender's website was down for a week, so she sent the pay slips by post and called the branch twice.", "My script for the play was turned down, yet the theatre pays me 400 dollars a month.", "We enabled two readers to open the archive; both found the missing statements of 2011.",
        "An error in my file, since corrected, had me 30 days late on a card that I never opened.", "Please call after six. The account at the credit union is in good standing.", "The template has a field {{name}} that the letter fills in.",
    ],
)
def test_content_in_wording_of_its_own(text):
    assert not residue.signs(text, "s")[0]


def test_host_evidence_for_long_bodies(spark):
    rows = [(i, "The page showed an error and nothing else here " + "and on it went without an end " * 60 + str(i), "d") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, t string, src string")
    assert {r.id for r in residue.find_residue(df, "id", "t", "src").collect()} == {0, 1, 2}


def test_residue_edges_and_host_evidence(spark):
    weak = "The page showed an error and nothing else here"
    rows = [(1, None, None), (2, "", "a"), (3, "  \n", "a"), (4, "Oops! Gone.", None), (4, "Oops! Gone.", None), (None, "Oops! Gone.", "b"), (7, LONG, "c"), (8, LONG + ". 404 - Page not found", "c"), *[(20 + i, f"{weak} {i}", "d") for i in range(3)], (30, weak.replace("page", "sheet"), "d")]
    df = spark.createDataFrame(rows, "id long, t string, src string").withColumn("kinds", F.lit(1)).withColumn("k", F.lit(1)).withColumn("masked", F.lit(1))
    assert Counter(r.id for r in residue.find_residue(df, "id", "t", "src").collect()) == Counter({4: 2, None: 1, 8: 1, 20: 1, 21: 1, 22: 1})
    assert residue.find_residue(df.limit(0), "id", "t", "src").count() == 0
