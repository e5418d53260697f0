import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.llm import leaks, mail, mixture, quantiles, related, residue, topn
from tests.conftest import rows

# --- percentiles ------------------------------------------------------------------------------------------------------


def test_compactors_stay_within_their_bound():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=40_000), np.zeros(20_000)])
    rng.shuffle(values)
    state = quantiles.Compactors(256, 3)
    for block in np.array_split(values, 97):
        state.add(block)
    assert state.n == len(values) == sum(len(x) << h for h, x in enumerate(state.levels))
    assert sum(map(len, state.levels)) < 256 * 8
    error = math.sqrt(2 * state.spread * math.log(2 / 1e-4))
    items = np.concatenate(state.levels)
    weight = np.concatenate([np.full(len(x), 1 << h) for h, x in enumerate(state.levels)])
    for x in np.quantile(values, [0.01, 0.3, 0.5, 0.9]):
        assert abs(weight[items <= x].sum() - (values <= x).sum()) <= error
    assert error < 0.05 * len(values)


SCORES = "split string, repeat int, day int, v double, n long"


def scores(spark):
    rnd = random.Random(2)
    data = [("s" if i % 4 else None, i % 2, i % 5, rnd.choice([rnd.gauss(0, 1), 0.5]), i) for i in range(20_000)]
    data += [("s", 0, 0, math.nan, 0), ("s", 0, 0, None, 0), ("s", 0, 0, math.inf, 0), ("empty", 1, 1, math.nan, 0)]
    return spark.createDataFrame(data, SCORES), data


def test_days_add_up(spark):
    df, data = scores(spark)
    keys = ["split", "repeat"]
    daily = quantiles.merge(quantiles.sketch(df, [F.col(k) for k in (*keys, "day")], [*keys, "day"], F.col("v"), 256), [*keys, "day"], 256)
    got = {}
    for r in quantiles.percentiles(quantiles.merge(daily, keys, 256, fan_in=2), keys, [0.25, 0.5, 0.95]).collect():
        got.setdefault((r["split"], r["repeat"]), []).append(r)
    assert set(got) == {("s", 0), ("s", 1), (None, 0)}
    for (s, r), answers in got.items():
        v = np.sort([x[3] for x in data if x[0] == s and x[1] == r and x[3] is not None and math.isfinite(x[3])])
        assert [x["q"] for x in answers] == [0.25, 0.5, 0.95]
        for row in answers:
            assert row["n_values"] == len(v) and row["min_value"] == v[0] and row["max_value"] == v[-1]
            assert 0 < row["rank_error"] < 0.15
            lo, hi = np.searchsorted(v, row["value"], "left"), np.searchsorted(v, row["value"], "right")
            wide = row["rank_error"] * len(v) + 1
            assert lo - wide <= row["q"] * len(v) <= hi + wide
    empty = quantiles.sketch(df.limit(0), [F.col("split")], ["split"], F.col("v"))
    assert quantiles.percentiles(quantiles.merge(empty, ["split"]), ["split"], [0.5]).count() == 0


def test_small_groups_are_exact_and_memory_is_bounded(spark):
    df = spark.createDataFrame([(f"k{i % 300}", float(i)) for i in range(3000)], "k string, v double")
    states = quantiles.sketch(df, [F.col("k")], ["k"], F.col("v"), 64, held=50)
    got = quantiles.percentiles(quantiles.merge(states, ["k"], 64), ["k"], [0.5])
    assert got.count() == 300 and got.filter("rank_error > 0").count() == 0
    assert got.filter("k = 'k7'").first()["value"] == 1207.0


def test_very_many_states_of_one_group_are_merged_in_a_tree(spark):
    # 5,000 states of one group at a fan-in of 8: four levels, the widest of 625 branches
    days = spark.range(5000).select(F.lit("g").alias("g"), F.lit(4).cast("long").alias("n"), F.col("id").cast("double").alias("lo"), (F.col("id") + 3).cast("double").alias("hi"), F.lit(0.0).alias("spread"), F.array(F.array(*[(F.col("id") + i).cast("double") for i in range(4)])).alias("levels"), "id")
    merged = quantiles.merge(days, ["g"], 64, fan_in=8)
    row = merged.first()
    assert row["n"] == 20_000 == sum(len(x) << h for h, x in enumerate(row["levels"])) and (row["lo"], row["hi"]) == (0.0, 5002.0)
    exact = np.sort(np.concatenate([np.arange(5000.0) + i for i in range(4)]))
    for a in quantiles.percentiles(merged, ["g"], [0.1, 0.5, 0.9]).collect():
        assert 0 < a["rank_error"] and abs(np.searchsorted(exact, a["value"]) - a["q"] * 20_000) <= a["rank_error"] * 20_000 + 8


def test_coins_of_later_states_differ():
    assert len({quantiles._seed(7, "sketch", 0, i, ("k",)) for i in range(1, 200)}) == 199


# --- groups and splits -------------------------------------------------------------------------------------------------


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("task_links, packed, seed", [(500_000, False, 4), (500_000, True, 5), (0, False, 4), (0, False, 6), (100, False, 7), (0, True, 8)])
def test_components_against_brute_force(spark, task_links, packed, seed):
    rnd = random.Random(seed)
    links = [(f"n{rnd.randrange(300):03d}", f"n{rnd.randrange(300):03d}") for _ in range(170)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(80)] + [("hub", f"h{i:03d}") for i in range(60)] + [("self", "self")]
    rnd.shuffle(links)
    df = spark.createDataFrame(links + links[:20] + [(None, "x")], "a string, b string").repartition(6)
    if packed:  # all files of a level read by one task
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert dict(rows(related.components(df, fan_in=2, task_links=task_links))) == brute_components(links)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert related.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [{1: 700, 2: 150, 3: 90, 17: 5, 40: 2}, {5: 65}, {5: 66, 1: 1}, {1: 3}, {1000: 1, 1: 90}, {7: 64, 3: 129, 1: 1000}])
def test_allotment_equals_one_by_one(sizes):
    """The closed form gives what single greedy steps give; where parts stand equally far below target either may come first, so the deficits are compared."""
    shares = {"train": 0.65, "val": 0.15, "test": 0.20}
    total = sum(s * n for s, n in sizes.items())
    deficit = {p: x * total for p, x in shares.items()}
    got = related.allot(sizes, shares)
    left = dict(deficit)
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            p = max(shares, key=lambda x: deficit[x])
            deficit[p] -= size
        for p in shares:
            left[p] -= size * got[size][p]
        assert sum(got[size].values()) == sizes[size]
        assert np.allclose(sorted(left.values()), sorted(deficit.values())), (size, left, deficit)


def test_groups_stay_whole_and_shares_are_met(spark):
    data = [(f"r{i:04d}", f"a{i % 90}" if i % 10 else None, "big" if i < 60 else None) for i in range(1000)]
    df = spark.createDataFrame(data, "rec string, author string, entity string")
    out = related.group_split(df, "rec", {"author": F.col("author")})
    got = {r["rec"]: r["part"] for r in out.collect()}
    assert len(got) == 1000
    for a in {x[1] for x in data if x[1]}:
        assert len({got[r] for r, b, _ in data if b == a}) == 1
    share = pd.Series(got).value_counts(normalize=True)
    assert abs(share["train"] - 0.65) < 0.02 and abs(share["val"] - 0.15) < 0.02
    assert rows(out) == rows(related.group_split(df.repartition(3), "rec", {"author": F.col("author")}))


def test_one_giant_component_and_the_crossed_split(spark):
    rnd = random.Random(11)
    # lines and clusters meet at random: together they are one component
    data = [(f"r{i:04d}", f"l{rnd.randrange(40)}" if i % 50 else None, f"c{rnd.randrange(60)}" if i % 33 else None) for i in range(1500)]
    df = spark.createDataFrame(data, "rec string, line string, cluster string")
    units = {"line": F.col("line"), "cluster": F.col("cluster")}
    assert related.group_split(df, "rec", units).groupBy("component").count().agg(F.max("count")).first()[0] > 1400
    got = {r["rec"]: r["part"] for r in related.crossed_split(df, "rec", units).collect()}
    assert len(got) == 1500
    for at in (1, 2):
        for u in {x[at] for x in data if x[at]}:
            assert len({got[x[0]] for x in data if x[at] == u} - {None}) <= 1
    kept = pd.Series([p for p in got.values() if p])
    share = kept.value_counts(normalize=True)
    assert 400 < len(kept) < 700 and abs(share["train"] - 0.65) < 0.1 and set(kept) == {"train", "val", "test"}
    assert related.crossed_split(df.limit(0), "rec", units).count() == 0


def test_torn_units(spark):
    d = spark.createDataFrame([(0, "a", "u", "train"), (0, "b", "u", "test"), (0, "a", "u", "train"), (1, "a", "u", "train"), (1, "b", "u", None), (0, "c", None, "val"), (None, "x", "w", "val"), (None, "y", "w", "test")], "repeat int, rec string, unit string, part string")
    assert rows(related.torn_units(d, ["repeat"])) == [(0, "u"), (None, "w")]
    assert related.torn_units(d.limit(0), ["repeat"]).count() == 0


# --- top N ---------------------------------------------------------------------------------------------------------------


def brute_top(data, n):
    best = {}
    for g, item, p, s in data:
        if g is None or item is None or p is None or s is None or math.isnan(p) or math.isnan(s):
            continue
        key = (p, -s)
        if (g, item) not in best or key < best[g, item]:
            best[g, item] = key
    out = set()
    for g in {g for g, _ in best}:
        ranked = sorted((k, i) for (h, i), k in best.items() if h == g)
        out |= {(g, i, r) for r, (_, i) in enumerate(ranked[:n], 1)}
    return out


@pytest.mark.parametrize("limit", [200_000, 1])
def test_top_items_against_brute_force(spark, limit):
    rnd = random.Random(6)
    draw = lambda: rnd.choice([0.0, 0.0, 0.01, rnd.random(), rnd.random() ** 6, math.nan, None, -0.5, 1e-300])
    data = [(rnd.choice(["big", "big", "big", "g1", "g2", None]), rnd.choice([f"i{rnd.randrange(150)}", None, "é"]), draw(), rnd.choice([0.0, 1.0, rnd.random() * 9, math.nan, None])) for _ in range(4000)]
    df = spark.createDataFrame([(*r, 1) for r in data], "g string, item string, primary double, secondary double, bin int")
    got = topn.top_items(df, F.col("g"), F.col("item"), F.col("primary"), F.col("secondary"), 10, broadcast_groups=limit)
    assert {(r["g"], r["item"], r["nth"]) for r in got.collect()} == brute_top(data, 10)
    many = topn.top_items(df, F.col("g"), F.col("item"), F.col("primary"), F.col("secondary"), 100, broadcast_groups=limit)
    assert {(r["g"], r["item"], r["nth"]) for r in many.collect()} == brute_top(data, 100)
    assert topn.top_items(df.limit(0), F.col("g"), F.col("item"), F.col("primary"), F.col("secondary")).count() == 0


# --- mail ----------------------------------------------------------------------------------------------------------------

QP = "Subject: x\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\nCaf=C3=A9 wor=\nd and =\nmore\n"


def test_reading_mail():
    assert mail.visible_words(QP) == [["café", "word", "and", "more"]]
    html = "Content-Type: text/html\n\n<p>a <b>b</b>&nbsp;c&shy;d</p><blockquote>q</blockquote><script>no</script>"
    assert mail.visible_words(html) == [["a", "b", "cd", "q"]]
    assert mail.visible_words("Subject: s\n\n> quo\n> > ted\n") == [["quo", "ted"]]
    both = 'Content-Type: multipart/mixed; boundary="=_1"\n\n--=_1\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\nSGVsbG8gd29ybGQgb2YgbWFpbA==\n--=_1\nContent-Type: application/octet-stream; name="x"\nContent-Disposition: attachment\n\nAAAA\n'
    assert mail.visible_words(both) == [["hello", "world", "of", "mail"]]
    for odd in (None, "", "\r\r\n", "From: x", "--=_1", "=" * 999, "<" * 999, 'Content-Type: multipart/mixed; boundary="a"\n\n--a\n' * 9):
        mail.visible_words(odd), residue.weak_family(residue.read_own_part(odd)), residue.feature_places(residue.read_own_part(odd), odd)


def test_own_lines_leave_quotes_out():
    text = "mine\n\nOn Mon, 1 Jan 2024, a@b wrote:\n\n> theirs\n\nmine too"
    assert [x for x in mail.own_lines("plain", text) if x.strip()] == ["mine", "mine too"]
    assert mail.own_lines("plain", "mine\nAm 1.1.24 schrieb a@b:\ntheirs") == ["mine"]
    assert [x for x in mail.own_lines("html", "<p>mine</p><blockquote><p>x</p><blockquote>y</blockquote></blockquote><p>end</p>") if x.strip()] == ["mine", "end"]


# --- leaks ---------------------------------------------------------------------------------------------------------------


def test_search_against_brute_force():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(k, [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 20))]) for k in range(30)]
    search = leaks.PassageSearch(items, 4)
    for _ in range(300):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 40))]
        runs = {tuple(text[i : i + 4]) for i in range(len(text) - 3)}
        assert search.find(text) == {k for k, w in items if any(tuple(w[i : i + 4]) in runs for i in range(len(w) - 3))}


def test_leaks(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    wrapped = "Subject: s\n\n> Word0, word1 word2\n> word3 word4 word5 word6 word7\n> word8 WORD9 wo​rd10 word11!\n"
    documents = spark.createDataFrame([(1, wrapped, 1), (2, "Subject: s\n\n" + passage[:60], 1), (3, None, 1), (4, "", 1), (5, "Subject: s\n\n" + "x " * 50_000 + passage, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, passage), (8, "too short"), (9, None), (10, passage)], "item_id long, text string")
    want = sorted([(7, 1), (7, 5), (10, 1), (10, 5)], key=repr)
    assert rows(leaks.leaked_passages(documents, items)) == want
    assert rows(leaks.leaked_passages(documents, items, block_words=25)) == want
    assert leaks.leaked_passages(documents, items.limit(0)).count() == 0 and leaks.leaked_passages(documents.limit(0), items).count() == 0


# --- mixture -------------------------------------------------------------------------------------------------------------


def archive(spark, n=600):
    rnd = random.Random(9)
    sources = ["a"] * 6 + ["B "] * 2 + ["c-d"]
    data = [(i, " ".join(["token"] * rnd.randrange(20, 60)), rnd.choice(["en", "EN", "de-XX", None]), rnd.choice(sources), f"re: {rnd.choice(['alpha', 'omega'])} thing") for i in range(n)]
    data += [(n, None, "en", "a", None), (n + 1, "", "en", "a", ""), (n + 2, "x", "en", None, "x"), (n + 3, "x", "en", "unlisted", "x")]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, subject string")


def test_shares_are_reached_under_the_caps(spark):
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.35, 3), ("c_d", 0.2, 4), ("gone", 0.05, 2), ("A ", 0.9, 1)], "source string, target_share double, max_repeats int")
    used, report = mixture.mix(archive(spark), targets)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"a", "b", "c_d", "gone"} and got["gone"]["tokens"] == 0
    for s in ("a", "b", "c_d"):
        assert abs(got[s]["share"] - got[s]["target_share"] / 0.95) < 0.01, got
        assert got[s]["most_used"] <= got[s]["max_repeats"]
    assert used.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert used.filter("tokens = 0 or repeats < 1").count() == 0
    assert rows(used) == rows(mixture.mix(archive(spark).repartition(5), targets)[0])
    nothing = mixture.mix(archive(spark).limit(0), targets)[1]
    assert nothing.count() == 4 and nothing.agg(F.sum("tokens")).first()[0] == 0


def test_raking_holds_the_margins():
    cells = pd.DataFrame([(s, lang, t, 100 + 10 * i) for i, (s, lang, t) in enumerate(itertools.product("ab", ["x", "y"], ["p", "q"]))], columns=["source", "lang", "topic", "tokens"])
    out = mixture.rake(cells, {"a": 0.3, "b": 0.7}, {"a": 5, "b": 5}, 800.0)
    assert np.allclose(out.groupby("source")["weight"].sum(), [240, 560])
    pool = cells.groupby("lang")["tokens"].sum() / cells["tokens"].sum()
    assert np.allclose(out.groupby("lang")["weight"].sum() / 800, pool, atol=1e-6)
    tight = mixture.rake(cells, {"a": 0.3, "b": 0.7}, {"a": 1, "b": 1})
    assert (tight["rate"] <= 1 + 1e-9).all()
    assert np.allclose(mixture._fill(np.array([1.0, 1.0, 8.0]), np.array([5.0, 5.0, 3.0]), 9.0), [3, 3, 3])


# --- residue -------------------------------------------------------------------------------------------------------------

HEAD = "From: A <a@x.test>\nSubject: s\nContent-Type: text/plain\n\n"
NORMAL = "I would rather keep the late ticket until the budget is merged again. Please have the sensor sealed by Ann once the panel is back."
CASES = {
    "field": f"Dear {{{{first_name}}}},\n\n{NORMAL}\n\nBest,\nAnn",
    "null": f"Dear null,\n\n{NORMAL}",
    "inside": f"Hi Ann,\n\nThere *|AMOUNT|* is a sensor in the room. {NORMAL}",
    "bracket": f"Hi Ann,\n\n{NORMAL}\n\nContact: [Your company here]\n\nBest,\nAnn",
    "filler": "Hello all,\n\nLorem ipsum dolor amit congua vadis nulit.\n\nBest,\nAnn",
    "placeholder": "Your text goes here. Your text goes here.",
    "status": "Hi Ann,\n\n<html><head><title>502 Bad Gateway</title></head><body><h1>Bad\nGateway</h1></body></html>\n\nBest,\nAnn",
    "error": "Query failed: too many connections.\n\nIncident number 14489",
    "script": "You must switch on JavaScript and reload\nthe page to read this message.\n\nReload\n\nSent from a tram, please excuse the\nbrevity.",
}
OTHERS = {
    "about": f"Hi Ann,\n\nIn the letter template the field is written `{{{{ order_no }}}}`, so Bob should not rename it. {NORMAL}",
    "said": f"Hi Ann,\n\nThe wiki gave me a 500 again this morning. {NORMAL}",
    "code": 'Hi Ann,\n\nThe payload was {"first_name": "x", "n": 46} and the server took it without complaint.',
    "quote": "Ann, this is what I got, can you have a look?\n\nOn Mon, 1 Jan 2024, a@b wrote:\n\n> 502 Bad Gateway\n> Dear {{name}},",
    "formula": f"Formula [3] in the draft and table [3] use the revised units. {NORMAL}",
    "normal": NORMAL,
    "empty": "",
}


@pytest.mark.parametrize("name", [*CASES, *OTHERS])
def test_weak_labels(name):
    assert (residue.weak_family(residue.read_own_part(HEAD + {**CASES, **OTHERS}[name])) is not None) == (name in CASES)


def test_features_tell_quotation_and_shapes_apart():
    at = lambda body: set(residue.feature_places(residue.read_own_part(HEAD + body), None))
    gram = lambda x: residue._hashes[x] % residue.GRAMS
    assert gram("shape:{{a}}") in at("Take {{order_no}} now") and gram("shape:__a__") in at("Take __ORDER_NO__ now")
    assert gram("shape:{{a}}") not in at("Take `{{order_no}}` now") and gram("q:{{") in at("Take `{{order_no}}` now")
    assert gram("null") in at("Dear null,\n\nx") and gram("null") not in at('We saw "null" there')
    long = at("word " * 200_000)
    assert len(long) < 20 and max(long) < residue.SIZE


def test_classifier_end_to_end(spark):
    rnd = random.Random(10)
    hosts = ["x.test", "y.test", "z.test", "w.test", "v.test"]
    data, want = [], set()
    for i in range(400):
        name, body = rnd.choice(list({**CASES, **OTHERS}.items()))
        data.append((i, (HEAD + body) if i % 9 else HEAD.replace("\n", "\r\n") + body, f"a@{rnd.choice(hosts)}" if i % 50 else None, "s" if i % 7 else None, 0.5))
        if name in CASES:
            want.add(i)
    data += [(400, None, None, None, None), (401, HEAD, "a@x.test", "s", 0.5), (402, HEAD + "> 502 Bad Gateway", "a@x.test", "s", 0.5)]
    df = spark.createDataFrame(data, "doc_id long, text string, from_addr string, subject string, p double")
    scored, fitted = residue.score(df)
    got = {r["doc_id"] for r in scored.filter("kept_out").collect()}
    figures = fitted.figures()
    assert scored.count() == 403 and figures["recall"] > 0.9 and figures["precision"] > 0.9
    assert got <= want and len(got) >= 0.98 * len(want)
    assert rows(scored.select("doc_id", "kept_out")) == rows(residue.score(df.repartition(3))[0].select("doc_id", "kept_out"))
    empty = residue.score(df.limit(0))[0]
    assert empty.count() == 0
    ordinary = residue.score(df.filter(~F.col("doc_id").isin(list(want))))[0]
    assert ordinary.filter("kept_out").count() == 0


def test_the_classifier_decides(spark, monkeypatch):
    """Without its weights nothing is found, and it finds residue in words that no rule knows."""
    known = ["The page you asked for could not be found by the server.", "Something went wrong while the server handled the request.", "The service is unavailable, try again in a few minutes.", "Access denied: the server could not handle the request."]
    new = "The server could not handle the request for the page."
    assert residue.weak_family(residue.read_own_part(HEAD + new)) is None
    talk = [f"I moved the {a} to the {b} and Ann will look at it on Monday, so please keep the {c} until then." for a in ("box", "table", "lamp") for b in ("lab", "room", "hall") for c in ("list", "key", "form")]
    data = [(i, HEAD + known[i % 4], f"a@h{i % 4}.test", "s") for i in range(60)] + [(100 + i, HEAD + talk[i % len(talk)], f"a@h{i % 4}.test", "s") for i in range(120)] + [(500, HEAD + new, "a@h9.test", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, from_addr string, subject string")
    read = residue.read_documents(df)
    fitted = residue.train(read.filter("doc_id < 500"))
    p = {r["doc_id"]: r["p"] for r in residue._scored(read, fitted.weights, fitted.intercept).collect()}
    assert {k for k, v in p.items() if v >= fitted.cut} == {*range(60), 500}
    monkeypatch.setattr(residue, "_weights", lambda rows, penalty: (np.zeros(residue.SIZE), -20.0))
    monkeypatch.setattr(residue, "_best_cut", lambda held: 0.5)
    assert residue.score(df)[0].filter("kept_out").count() == 0
