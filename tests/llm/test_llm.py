import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import abuse, components, conversations, mixing, neardup, packing, pii, split, survivor, tokens


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 1: pieces

def plain(text):
    return re.sub(r"\s", "", text)


@pytest.mark.parametrize("text", [
    "One sentence here. " * 200,
    "x" * 5000,
    "# A\n\n" + "word " * 400 + "\n\n## B\n\n" + "- item one is long enough to matter\n" * 60,
    "intro.\n\n```\n" + "code line\n" * 150 + "```\n\nafter the fence. " * 3,
    "é" * 2000,
    "日本語の文。" * 400,
])
def test_split_keeps_all_text_under_the_limit(text):
    pieces = split.split_text(text)
    assert len(pieces) > 1 and all(len(t) <= split.LIMIT for t, _, _ in pieces)
    body, before = "", None
    for t, _, continued in pieces:
        if continued:
            again, t = t.split("\n", 1)
            assert before.rstrip().endswith(again)
        body, before = body + t, t
    assert plain(body) == plain(text)


def test_split_prefers_borders_and_whole_fences():
    fence = "```\n" + "code line\n" * 60 + "```"
    pieces = split.split_text("A first part. " * 60 + "\n\n" + fence + "\n\n" + "A last part. " * 60)
    assert any(fence in t for t, _, _ in pieces)


def test_split_overlaps_at_every_border():
    pieces = split.split_text("para one. Two here.\n\n" * 200)
    assert [c for _, _, c in pieces] == [False] + [True] * (len(pieces) - 1) and pieces[1][0].startswith("Two here.\n")
    pieces = split.split_text("word " * 1000)
    assert all(c and 150 < len(t.split("\n")[0]) <= split.OVERLAP for t, _, c in pieces[1:])
    assert not any(c for _, _, c in split.split_text("# A\n" + "x y. " * 200 + "\n# B\n" + "x y. " * 200))
    lead = "l" * 500
    assert split.split_text("One. " * 400, lead=lead)[0][0].startswith(lead + "\n")


def test_headings():
    text = "# Top #\n" + "a. " * 300 + "\n## In #5\n" + "b. " * 300 + "\n#no heading\n### Deep ##\n" + "c. " * 300 + "\n## Next\n" + "d. " * 300
    paths = {h for _, h, _ in split.split_text(text, "Base")}
    assert paths == {"Base > Top", "Base > Top > In #5", "Base > Top > In #5 > Deep", "Base > Top > Next"}


def test_chunk_edges(spark):
    schema = "chunk_id long, parent_id long, chunk_index long, heading string, text string, search_text string, continued boolean, rev long, extra string"
    data = [
        (1, 1, 0, None, None, None, None, 1, "a"), (2, 1, 1, "h", "x" * 1200, "", False, 1, "b"), (3, 1, 2, "h", "x" * 1201, "", None, 1, "c"),
        (4, 1, 3, "h", "first line\n" + "y" * 1200, "", True, 1, "d"), (5, 1, 4, "h", "x" * 2000, "", False, 1, "e"), (6, 1, 4, "h", "short", "", False, 2, "f"),
        (3, 1, 2, "h", "x" * 1201, "", None, 1, "c"), (7, 1, 5, "h", "\r\n " + "z" * 1200 + " \t\r\n", "", False, 1, "g"),
        (8, 1, 6, "h", "first line\n" + "\n" * 10 + "y" * 1195, "", True, 1, "h"),
    ]
    df = spark.createDataFrame(data, schema)
    assert rows(split.oversized(df)) == [(1, 2), (1, 6)]
    assert rows(split.oversized(df.limit(0))) == []


# 2: survivors, components

def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(6000, 6200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    assert rows(components.components(df)) == sorted((x, find(x)) for x in parent)
    assert rows(components.components(df.limit(0))) == []


def test_skyline_against_brute_force(spark):
    r = random.Random(5)
    data = [(i, r.randrange(3), r.randrange(4), r.randrange(6), float(r.randrange(6)), 0) for i in range(150)]
    df = spark.createDataFrame(data, "memory_id long, group_id long, fullness int, recency long, trust double, group_size long")
    beats = lambda y, x: all(a >= b for a, b in zip(y[2:5], x[2:5])) and y[2:5] != x[2:5]
    want = sorted(x[0] for x in data if not any(y[1] == x[1] and beats(y, x) for y in data))
    assert sorted(x.memory_id for x in survivor.salted_skyline(df, 5).collect()) == want
    assert sorted(x.memory_id for x in survivor.salted_skyline(df.withColumn("group_size", F.lit(100_000)), 5).collect()) == want


def test_survivor_fills_from_others(spark):
    m = spark.createDataFrame([(1, "n", None, "c", "[]", 1), (2, "m", "d", "", '["x"]', 1), (2, None, None, None, None, 0), (3, None, None, None, None, 1)], "memory_id long, name string, description string, category string, labels string, rev long")
    c = spark.createDataFrame([(1, None, 5.0, 1)], "memory_id long, last_used_at timestamp, use_pos double, folded_event_id long")
    v = spark.createDataFrame([(1, 2, 1, " merge", "b", "r", 1), (2, 1, 3, "MERGE", None, None, 1), (3, 1, 4, "merge", None, None, 1), (4, 4, 1, "Contradict", None, None, 2), (5, 1, 2, "UNSURE", None, None, 9)], "verdict_id long, memory_a long, memory_b long, verdict string, survivor string, reason string, judged_at long")
    got = survivor.choose_survivors(m, c, v).collect()
    assert [(r.group_id, r.group_size) for r in got] == [(1, 3)]
    assert (got[0].description, got[0].category, got[0].labels) == ("d", "c", '["x"]')
    assert survivor.choose_survivors(m, c, v.limit(0)).count() == 0


def test_fields_come_from_the_earliest_layer(spark):
    # 1 survives and lacks a description; 2 is undominated and has one; 3 is beaten by 1 only and has one, too
    m = spark.createDataFrame([(1, "n", None, "c", '["l"]', 1), (2, None, "of 2", None, None, 1), (3, "n", "of 3", None, None, 1)], "memory_id long, name string, description string, category string, labels string, rev long")
    c = spark.createDataFrame([(1, 9, 5.0, 1), (2, 1, 7.0, 1), (3, 8, 4.0, 1)], "memory_id long, last_used_at long, use_pos double, folded_event_id long").withColumn("last_used_at", F.timestamp_seconds("last_used_at"))
    v = spark.createDataFrame([(1, 1, 2, "MERGE", None, None, 1), (2, 2, 3, "MERGE", None, None, 1)], "verdict_id long, memory_a long, memory_b long, verdict string, survivor string, reason string, judged_at long")
    for rows_ in (survivor.LOCAL_ROWS, 0):
        got = survivor.choose_survivors(m, c, v, rows_).collect()
        assert [(r.survivor_id, r.description, r.undominated, r.layers) for r in got] == [(1, "of 2", 2, 1)], rows_


def test_layers_against_brute_force(spark):
    r = random.Random(8)
    for _ in range(20):
        data = [(r.randrange(3), r.randrange(5), float(r.randrange(5))) for _ in range(60)]
        want, left, k = {}, set(range(60)), 1
        beats = lambda y, x: y != x and all(a >= b for a, b in zip(y, x))
        while left:
            top = {i for i in left if not any(beats(data[j], data[i]) for j in left)}
            want.update(dict.fromkeys(top, k))
            left, k = left - top, k + 1
        assert survivor.layers_of(*map(list, zip(*data)), 5) == [want[i] for i in range(60)]


def test_large_groups_give_the_same(spark):
    r = random.Random(6)
    pick = lambda x: r.choice([None, x])
    n = 60
    m = spark.createDataFrame([(i, pick(f"n{i}"), pick(f"d{i}") if i % 9 == 0 else None, pick("c"), "[]", 1) for i in range(n)], "memory_id long, name string, description string, category string, labels string, rev long")
    c = spark.createDataFrame([(i, r.randrange(9), float(r.randrange(9)), 1) for i in range(n)], "memory_id long, last_used_at long, use_pos double, folded_event_id long").withColumn("last_used_at", F.timestamp_seconds("last_used_at"))
    v = spark.createDataFrame([(i, i, i + 3, "MERGE", r.choice("AB"), "r", i) for i in range(n - 3)], "verdict_id long, memory_a long, memory_b long, verdict string, survivor string, reason string, judged_at long")
    assert rows(survivor.choose_survivors(m, c, v)) == rows(survivor.choose_survivors(m, c, v, 5))


# 3: near duplicates

def test_near_duplicates_against_brute_force(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [r.choice(words) for _ in range(80)]
        texts.append(" ".join(base))
        for edits in (1, 4, 9):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(80)] = r.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "", None, "a b"]
    sets = [set(zip(t, t[1:], t[2:])) for t in (neardup.words_of(x or "") for x in texts)]
    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.55]
    got = rows(neardup.NearDuplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", 3, 0.55).pairs())
    assert set(got) <= set(want) and len(got) == len(set(got)) and len(got) >= 0.995 * len(want)


# 4: conversations

def test_sessions(spark):
    schema = "row_id long, session string, agent string, transcript string, line_no long, role string, is_meta boolean, message_id string, tool string, tool_use_id string, tool_input string, prompt string, text string, is_error boolean, moment double, slug string"
    data, n = [], 0

    def add(session, *lines):
        nonlocal n
        for i, (role, said, tool, use, moment) in enumerate(lines, 1):
            n += 1
            data.append((n, session, "main", session.strip().lower(), i, role, None, None, tool, use, None, said if role == "user" else None, None if role == "user" else said, None, moment, None))

    add("good", ("user", "hi", None, None, 1.0), ("assistant", None, "Bash", "t1", None), ("tool", "out", None, "t1", 3.0), ("assistant", "done", None, None, 4000000000000.0))
    add(" GOOD ")
    add("noreply", ("user", "hi", None, None, 1.0), ("assistant", " -- ", None, None, 2.0))
    add("first", ("assistant", "hello", None, None, 1.0), ("user", "hi", None, None, 2.0), ("assistant", "ok", None, None, 3.0))
    add("noresult", ("user", "hi", None, None, 1.0), ("assistant", "x", "Bash", None, 2.0))
    add("nocall", ("user", "hi", None, None, 1.0), ("tool", "x", None, "t9", 2.0), ("assistant", "ok", None, None, 3.0))
    add("twice", ("user", "hi", None, None, 1.0), ("user", "hi?", None, None, 2.0), ("assistant", "ok", None, None, 3.0))
    df = spark.createDataFrame(data + [(99, *data[0][1:])], schema)
    out = {r.session for r in conversations.session_report(df).where("left_out").collect()}
    assert out == {"noreply", "first", "noresult", "nocall", "twice"}
    kept = conversations.rebuild(df).orderBy("seq").collect()
    assert [(r.seq, r.kind, r.result_text) for r in kept] == [(1, "prompt", None), (2, "call", "out"), (3, "result", None), (4, "reply", None)]
    assert conversations.session_report(df.limit(0)).count() == 0


def test_partly_sent_replies(spark):
    schema = "row_id long, session string, agent string, transcript string, line_no long, role string, is_meta boolean, message_id string, tool string, tool_use_id string, tool_input string, prompt string, text string, is_error boolean, moment double"
    said = [("user", None, "what?", None), ("assistant", "m1", None, "The ans"), ("assistant", "m1", None, "The answer is 4."), ("assistant", "m1", None, "More."), ("assistant", None, None, "The ans"), ("assistant", "m2", None, "x"), ("assistant", "m2", None, "x")]
    df = spark.createDataFrame([(i, "s", "main", "t", i, role, None, message, None, None, None, prompt, text, None, float(i)) for i, (role, message, prompt, text) in enumerate(said)], schema)
    kept = conversations.rebuild(df).orderBy("seq").collect()
    assert [(r.seq, r.text) for r in kept] == list(enumerate(["what?", "The answer is 4.", "More.", "The ans", "x"], 1))


# 5: personal information

def test_pii(spark):
    given, family = ["Anna", "Bela", "Cora"], ["Stone", "Marsh", "Field"]
    texts = []
    for g in given:
        for f in [*family, "Unlisted"]:
            texts += [f"I paired with {g} {f} today", f"Signed-off-by: {g} {f}"]
    texts += ["I paired with Zorro Stone today", "Signed-off-by: Zorro Marsh", "I paired with Zorro Field today"]
    texts += ["mail a.b@mail.example now", "call +1 206 555 0100 now", "call (206) 555-0101 now", "SSN 000-12-3456 is in the dump", "lives at 12 Oak Street, Town", "git clone git@forge.test:tools/x.git", "Pin digest@1.7.2 now", "checksum 1234-1234-1234-1234 bad", "", None, "Restart the anna service", "x" * 20000]
    e = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "entry_id long, text string, redacted boolean")
    c = spark.createDataFrame([], "chunk_id long, search_text string")
    parts = spark.createDataFrame([(x, "given") for x in given] + [(x, "family") for x in family], "part_text string, part_kind string")
    got = {r.row_id: r for r in pii.redacted(pii.records_of(e, c), parts).collect()}
    joined = {r.row_id: r for r in pii.redacted(pii.records_of(e, c), parts, entries=0).collect()}
    assert joined == got  # a lexicon that is joined and not sent gives the same
    by = {texts[i]: r.kinds for i, r in got.items() if texts[i]}
    assert by["I paired with Zorro Stone today"] == ["name"] and by["Signed-off-by: Anna Unlisted"] == ["name"]
    assert by["mail a.b@mail.example now"] == ["email"] and by["call (206) 555-0101 now"] == ["phone"]
    assert by["SSN 000-12-3456 is in the dump"] == ["id_number"] and by["lives at 12 Oak Street, Town"] == ["address"]
    for t in ("git clone git@forge.test:tools/x.git", "Pin digest@1.7.2 now", "checksum 1234-1234-1234-1234 bad", "Restart the anna service"):
        assert by[t] == [], t
    assert got[texts.index("mail a.b@mail.example now")].clean == "mail [email] now"
    assert pii.found(e.limit(0), c, parts).count() == 0


# 6: packing

def test_pack_limits():
    r = np.random.default_rng(1)
    t = r.integers(0, 400, 3000)
    loss = np.minimum(300, (t * r.random(3000)).astype(int))
    where = packing.pack(t, loss, 512, 8, 300)
    for k in np.unique(where):
        at = where == k
        assert t[at].sum() <= 512 and at.sum() <= 8 and loss[at].sum() <= 300
    free = packing.pack(t, loss, 512, 64, 512)
    assert t.sum() / (512 * (free.max() + 1)) > 0.97


def test_items_above_a_limit(spark):
    with pytest.raises(ValueError):
        packing.pack(np.array([100]), np.array([100]), 400, 64, 50)
    counts = spark.createDataFrame([(1, 100, 100), (2, 1000, 10), (3, 40, 40), (4, 0, 0)], "doc_id long, tokens int, loss_tokens int")
    out = packing.items(counts, [("s", 400)], 0.125).collect()
    assert all(r.tokens <= 400 and r.loss_tokens <= 50 for r in out)
    for doc, pieces, tokens_, loss in ((1, 2, 100, 100), (2, 3, 1000, 10), (3, 1, 40, 40), (4, 1, 0, 0)):
        mine = [r for r in out if r.doc_id == doc]
        assert (len(mine), sum(r.tokens for r in mine), sum(r.loss_tokens for r in mine)) == (pieces, tokens_, loss)


def test_pack_documents(spark):
    d = spark.createDataFrame([(1, "word " * 3000), (2, None), (3, ""), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    s = spark.createDataFrame([("small", 512), ("none", None), ("zero", 0)], "pack_name string, capacity_tokens long")
    out = packing.pack_documents(d, s).collect()
    assert {r.pack_name for r in out} == {"small"} and all(r.container_tokens <= 512 for r in out)
    one = sorted((r.piece_no, r.from_token, r.tokens) for r in out if r.doc_id == 1)
    assert [x[1] for x in one] == [512 * i for i in range(len(one))] and sum(x[2] for x in one) >= 3000
    assert packing.pack_documents(d.limit(0), s).count() == 0


# 7: mixing

def test_plan_hits_targets_and_limits():
    want, e = mixing.plan({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3), "gone": (0.2, 1)})
    assert e == 1.0 and want["a"] == pytest.approx(300) and want["b"] == pytest.approx(300)
    want, e = mixing.plan({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3)})
    assert e == 1.0 and want == {"a": pytest.approx(30), "b": pytest.approx(30)}  # shares before size
    want, e = mixing.plan({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3)}, least_mix=0.5)
    assert 0 < e < 1 and sum(want.values()) == pytest.approx(505) and want["b"] <= 30 + 1e-6
    want, e = mixing.plan({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3)}, budget=1000)
    assert 0 < e < 1 and want["b"] <= 300 + 1e-6 and sum(want.values()) == pytest.approx(1000)
    want, e = mixing.plan({"a": 900, "b": 90, "c": 10}, {s: (0.3, 1) for s in "abc"}, entropy=1.0)
    shares = np.array(list(want.values())) / sum(want.values())
    assert 0 < e < 1 and -(shares * np.log(shares)).sum() == pytest.approx(1.0, abs=1e-6)
    assert mixing.plan({}, {"a": (1.0, 1)})[0] == {}


def test_mix(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 50), ["Notes", "wiki-pages", " notes", "other"][i % 4]) for i in range(800)] + [(900, None, "notes")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("notes", 0.4, 1), ("wiki_pages", 0.62, 2), ("missing", 0.1, None)], "source string, target_share double, max_repeats long")
    mix = mixing.Mix(docs, targets)
    rep = {r.source: r for r in mix.report().collect()}
    for s in ("notes", "wiki_pages"):
        assert abs(rep[s].reached_share - rep[s].wanted_share) < 0.01 and rep[s].most_repeats <= rep[s].max_repeats
    assert rep["missing"].out_of_reach and rep["other"].taken_tokens == 0
    assert mix.selection().groupBy("doc_id", "repeat").count().where("count > 1").isEmpty()
    mixing.MAX_SOURCES, keep = 2, mixing.MAX_SOURCES
    try:
        with pytest.raises(ValueError):
            mixing.Mix(docs, targets)
    finally:
        mixing.MAX_SOURCES = keep


# 8: abuse

def test_network_learns_and_spellings_fold():
    assert abuse.raw_words("so h o r n y or a-s-s, ok") == ["so", "horny", "or", "ass", "ok"]
    assert abuse.raw_words("est\\u00fapido C:\\users") == ["estúpido", "c", "users"]
    assert abuse.canonical("sеx") == "sex" and abuse.canonical("h0rny") == "horny" and abuse.canonical("hornnnny") == "horny"
    r = random.Random(2)
    filler = [f"word{chr(97 + i)}" for i in range(26)]
    texts, bad = [], []
    for i in range(240):
        words = [r.choice(filler) for _ in range(70)]
        label = i % 3 == 0
        words[20:20] = r.choice(["you worthless halfwit", "crawl back you moron"]).split() if label else r.choice(["a stupid config value", "the worthless cache entry"]).split()
        texts.append(" ".join(words))
        bad.append(label)
    net = abuse.train(texts[:180], bad[:180], steps=60)
    assert net is not None
    import pandas as pd

    abuse._state.clear()
    score = abuse._score_batch(pd.Series([*texts[180:], None, ""]), net.p).to_numpy()
    assert np.mean((score[:60] >= 0.5) == np.array(bad[180:])) >= 0.9 and (score[60:] < 0.5).all()
    assert abuse.train(["a"], [True]) is None


def test_digits_for_letters_are_no_hash():
    for word, form in (("53x", "sex"), ("455h0l3", "asshole"), ("1d10t", "idiot"), ("m0therfucking5", "motherfuckings"), ("donaudampfschiff4hrt", "donaudampfschiffahrt")):
        assert abuse.canonical(word) == form
    for word in ("9f86d08", "3f2a9c41d7be", "a94a8fe5ccb19ba61c4c0873d391e987982fbbd3"):
        assert abuse.canonical(word) == "0a"
    assert abuse.canonical("20260512") == "0"


def _batch(net, texts):
    _, places, inside, allowed = abuse.chunks_of(texts)
    return np.concatenate([t for t in texts if len(t)])[places], inside, allowed


def test_gradients_against_differences():
    net, words = abuse.Network(1), ["", "alpha", "beta", "gamma", "delta"]
    r = np.random.default_rng(0)
    ids, inside, allowed = _batch(net, [r.integers(1, 5, 20), r.integers(1, 5, 90)])
    y = np.array([1.0, 0, 1][: len(ids)], np.float32)
    loss = lambda: abuse.Network.step(net, words, ids, inside, allowed, y, 0.0)
    for name, at in (("u", (0, 3, 5)), ("u", (1, 2, 40)), ("w", (1, 4, 9)), ("att", (7,)), ("out", (20,)), ("b", (0, 33))):
        net.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        loss()
        slope = net.m[name][at] / 0.1
        keep = float(net.p[name][at])
        got = []
        for change in (1e-2, -1e-2):
            net.p[name][at] = keep + change
            got.append(loss())
        net.p[name][at] = keep
        assert slope == pytest.approx((got[0] - got[1]) / 2e-2, rel=0.05, abs=2e-4), name


def test_windows_cover_everything():
    net, words = abuse.Network(3), ["", *(f"w{i}" for i in range(1, 201))]
    texts = [np.arange(1, n + 1) for n in (1, 5, 31, 32, 33, 64, 65, 100, 200)]
    probability, text, start = net.score_texts(net.projections(words), texts)
    assert [start[text == i].tolist() for i in range(len(texts))] == [list(range(max(1, len(x) - abuse.WINDOW + 1))) for x in texts]
    for i, x in enumerate(texts):  # a score does not depend on the texts beside it
        assert np.allclose(net.score_texts(net.projections(words), [x])[0], probability[text == i], atol=1e-5)
    doc, places, inside, allowed = abuse.chunks_of(texts)
    assert [int(allowed[doc == i].sum()) for i in range(len(texts))] == [max(1, len(x) - abuse.WINDOW + 1) for x in texts]


def test_pulls_against_plain_recurrence():
    net, words = abuse.Network(4), ["", *(f"w{i}" for i in range(1, 60))]
    x = np.random.default_rng(1).integers(1, 60, 150)
    table = net.projections(words)
    h = abuse.STATE
    got = net.score_texts(table, [x])[0]
    sig = lambda z: 1 / (1 + np.exp(-z))
    states = np.zeros((150, 2 * h))
    for k in (0, 1):
        for tile in range(0, 150, abuse.TILE):
            low, high = max(0, tile - abuse.CONTEXT), min(150, tile + abuse.TILE + abuse.CONTEXT)
            state = np.zeros(h)
            for t in range(low, high) if k == 0 else range(high - 1, low - 1, -1):
                g, u = table[k][x[t]], net.p["u"][k]
                rz = sig(g[: 2 * h] + state @ u[:, : 2 * h])
                new = np.tanh(g[2 * h :] + rz[:h] * (state @ u[:, 2 * h :]))
                state = new + rz[h:] * (state - new)
                if tile <= t < tile + abuse.TILE:
                    states[t, k * h : (k + 1) * h] = state
    a, v = np.exp(states @ net.p["att"]), states @ net.p["out"]
    want = [sig((a[i : i + 32] * v[i : i + 32]).sum() / a[i : i + 32].sum() + net.p["bias"][0]) for i in range(119)]
    assert np.allclose(got, want, atol=1e-4)


def test_best_threshold():
    assert 0 < 1 / (1 + np.exp(-abuse.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([True, True, False, False])))) < 0.8
    assert abuse.best_threshold(np.array([0.9]), np.array([True])) == 0.0


def test_labelled_sample_is_bounded(spark):
    d = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(1, None), (60, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, " Clean " if i % 2 else "abusive") for i in range(50)] + [(2, "clean"), (None, "clean"), (60, "clean")], "doc_id long, label string")
    assert abuse.labelled_sample(d, lab).count() == 50
    assert abuse.labelled_sample(d, lab, bound=10).count() == 10
    assert abuse.labelled_sample(d, lab, chars=1000).select(F.sum(F.length("text"))).first()[0] <= 1000


def test_token_round_trip():
    enc = tokens.encoder(tokens.VOCABULARY)
    for t in ("Grüße, 世界 🙂\r\n", "<|endoftext|>", " "):
        assert enc.decode(enc.encode_ordinary(t)) == t
