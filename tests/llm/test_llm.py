"""The training-data operators against brute force, exact round trips and literal cases; nulls, empty texts, ties,
repeats, empty tables and clashing column names in each."""

import datetime as dt
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations, languages, leakage, lookalikes, neardup, overlap, packing, pairs, queries, splitting, text

T0 = dt.datetime(2024, 1, 1)
WORDS = [f"w{i}" for i in range(300)]


def pairs_of(df):
    return {tuple(r) for r in df.collect()}


# consistent form and words


def test_consistent_form():
    f = text.consistent_form
    assert f("Ａ１​﻿­  x") == "A1 x"
    assert f("é") == f("é") == f("е́") == "é"
    assert f("ﬁ Αddrеss") == "fi Address" and f("й") == "й"
    assert f(None) is None and f(" 　") == "" and f("Ab") == "Ab" and f("Straße", fold=True) == "strasse"
    # code points at the ends of the tables: ignorable ones, small rho and kappas, palochka; words that differ stay apart
    assert f("a\ufff0\ufff8\U0001bca0\U0001bca3\U0001d173\U0001d17a\U000e0001b") == "ab"
    assert f("\u03c1\u03ba\u043a\u04cf\u04c0\u037f") == "pkklIJ" and f("\u03c9\u0431\u0434") == "\u03c9\u0431\u0434"
    r = random.Random(3)
    for _ in range(300):
        s = "".join(chr(r.choice([*range(32, 127), *range(0xA0, 0x250), *range(0x370, 0x530), *range(0x2000, 0x2070), 0x301, *range(0xFF01, 0xFF5E)])) for _ in range(12))
        assert f(f(s)) == f(s)
        assert f(unicodedata.normalize("NFD", s)) == f(s)


def test_words():
    assert text.words_of("Das ist_ein １６#ABC 阀岛 été µs") == ["das", "ist", "ein", "16", "abc", "阀", "岛", "été", "µs"]
    assert text.words_of(None) == [] == text.words_of("—")


def test_run_sets():
    h = text.WordHasher()
    docs = [["a", "b", "c", "a", "b", "c", "a"], [], ["x"], ["a", "b", "c"]]
    runs, counts = text.run_sets(*h(docs))
    assert counts.tolist() == [3, 0, 1, 1]
    assert runs[4] in runs[:3]


# 1


def run_conversations(rows):
    """The automaton, session by session."""
    blank = lambda s: s is None or not any(c.isalnum() for c in s) or s.strip().lower() in ("null", "none", "nan", "n/a", "undefined")
    by = {}
    for i, s, q, a, t in rows:
        s = (s or "").strip().lower()
        if s and not (blank(q) and blank(a)):
            key = (q, a, t)
            by.setdefault(s, {})
            by[s][key] = min(i, by[s].get(key, 1 << 60))
    out = set()
    for s, once in by.items():
        if any(t is None for _, _, t in once):
            continue
        state, messages = "user", []
        for t, i, q, a in sorted((t, i, q, a) for (q, a, t), i in once.items()):
            for value, role in ((q, "user"), (a, "assistant")):
                if not blank(value):
                    if state != role:
                        state = "broken"
                        break
                    messages.append((role, i))
                    state = "assistant" if role == "user" else "user"
            if state == "broken":
                break
        if state == "user" and messages:
            out |= {(s, n, role, i) for n, (role, i) in enumerate(messages, 1)}
    return out


def test_conversations(spark):
    r = random.Random(5)
    texts = ["hello", "ok then", None, "", "N/A", "…", "none ", "​", "yes"]
    rows = []
    for s in range(60):
        for k in range(r.randint(1, 6)):
            t = None if r.random() < 0.02 else T0 + dt.timedelta(minutes=r.randint(0, 6))
            q, a = (r.choice(["hello", "what"]), r.choice(["yes", "ok"])) if r.random() < 0.75 else (r.choice(texts), r.choice(texts))
            rows.append((len(rows), r.choice([f"S{s}", f" s{s} "]), q, a, t))
    rows += [rows[0], (9000, None, "q", "a", T0), (9001, " ", "q", "a", T0)]
    for k in range(500):  # a hot session over several partitions
        rows.append((10_000 + 2 * k, "hot", f"q{k}", None, T0 + dt.timedelta(minutes=k)))
        rows.append((10_001 + 2 * k, "HOT", None, "a", T0 + dt.timedelta(minutes=k)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, session_id string, question string, answer string, created_at timestamp_ntz").withColumn("part", F.lit(1)).withColumn("sid", F.lit("x"))
    got = pairs_of(conversations.conversations(df))
    assert got == run_conversations(rows) and any(x[0] == "hot" for x in got)
    assert conversations.conversations(df.limit(0)).count() == 0


# 2


def edited(r, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[r.randrange(len(ws))] = r.choice(WORDS)
    return ws


def test_near_duplicates(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        base = [r.choice(WORDS) for _ in range(r.randint(40, 90))]
        for v in range(r.randint(1, 4)):
            rows.append((f"k{i:03}_{v}", " ".join(edited(r, base, r.choice([0, 1, 2, 12])))))
    rows += [rows[0], ("n1", None), (None, "x y z"), ("e1", ""), ("e2", " . "), ("s1", "two words"), ("s2", "Two  words!"), ("c1", rows[5][1].upper())]
    sets = {k: {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for k, t in rows if k and (w := text.words_of(t))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    far = {(a, b) for a, b in want if len(sets[a] & sets[b]) < 0.63 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "key string, text string").withColumn("cls", F.lit(1)).withColumn("block", F.lit(2))
    got = pairs_of(neardup.near_duplicate_pairs(df))
    assert got <= want and want - got <= far and len(got) > 100
    assert ("s1", "s2") in got
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


def test_large_blocks_and_copies(spark, monkeypatch):
    r = random.Random(4)
    base = [r.choice(WORDS) for _ in range(60)]
    rows = [(f"a{i:03}", " ".join(edited(r, base, 1))) for i in range(60)] + [(f"c{i:04}", "one text in very many copies of itself") for i in range(150)]
    df = spark.createDataFrame(rows, "key string, text string")
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in rows if (w := text.words_of(t))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert pairs_of(neardup.near_duplicate_pairs(df, full_pairs=30_000)) == want
    star = pairs_of(neardup.near_duplicate_pairs(df, full_pairs=100))
    assert {p for p in star if p[0][0] == "c"} == {("c0000", f"c{i:04}") for i in range(1, 150)}
    assert {p for p in star if p[0][0] == "a"} == {p for p in want if p[0][0] == "a"}
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "TILE_ROWS", 16)
    monkeypatch.setattr(neardup, "TILE", 8)
    assert pairs_of(neardup.near_duplicate_pairs(df, full_pairs=30_000)) == want


def test_keys_with_two_texts(spark):
    r = random.Random(11)
    rows = []
    for i in range(15):
        for side in "ab":
            base = [r.choice(WORDS) for _ in range(60)]
            rows += [(f"two{i:02}", " ".join(base)), (f"{side}{i:02}", " ".join(edited(r, base, 1)))]
    df = spark.createDataFrame(rows, "key string, text string")
    assert pairs_of(neardup.near_duplicate_pairs(df)) == {(f"{s}{i:02}", f"two{i:02}") for i in range(15) for s in "ab"}


def test_tiles_skip_nothing_near():
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(5, 400, 700))
    short = rng.integers(0, 1 << 62, (40, 2), dtype=np.uint64)[rng.integers(0, 40, 700)]
    i, j = neardup.tile_pairs(short, n, 0.6)
    want = {(a, b) for a in range(700) for b in range(a + 1, 700) if n[b] - n[a] <= (n[a] + n[b]) * 0.25 and neardup.unlike(short[a : a + 1], short[b : b + 1])[0] <= neardup.SHORT - neardup.SHORT_AGREE}
    assert set(zip(i.tolist(), j.tolist())) == want


# 3


def test_fm_index(monkeypatch):
    r = random.Random(0)
    texts = [sorted(r.sample(range(2, 30), r.randint(0, 9))) for _ in range(60)]
    flat = lambda ts: (np.array([x for t in ts for x in t], np.int64), np.array([len(t) for t in ts], np.int64))
    index = overlap.FMIndex(*flat(texts), 30)
    assert sorted(np.diff(index.less).tolist()) == sorted([60, 1, *(sum(w in t for t in texts) for w in range(2, 31))])
    queries = [sorted(r.sample(range(2, 30), r.randint(1, 9))) if i % 3 else texts[r.randint(0, 59)] for i in range(80)]
    for threshold in (0.5, 0.7, 1.0):
        want = {}
        for q, x in enumerate(queries):
            for t, y in enumerate(texts):
                both = [w for w in x if w in y]
                if both and len(both) >= threshold * len({*x, *y}):
                    # a span ends where the words that follow in one don't follow in the other
                    want[q, t] = len(both), 1 + sum(x.index(b) != x.index(a) + 1 or y.index(b) != y.index(a) + 1 for a, b in zip(both, both[1:]))
        for at_once in (1_000_000, 7):
            monkeypatch.setattr(overlap, "AT_ONCE", at_once)
            got = {(q, t): (c, n) for part in index.matches(*flat(queries), threshold) for q, t, c, n in zip(*(x.tolist() for x in part))}
            assert got == want


@pytest.mark.parametrize("grid", [(2_000, 20_000), (7, 11)])
def test_cross_split(spark, grid):
    r = random.Random(9)
    few = WORDS[:25]
    rows = []
    for i in range(150):
        ws = [r.choice(few) for _ in range(r.randint(1, 9))] if i % 2 else [r.choice(["pump", "axis", "valve", "bus"]) for _ in range(r.randint(1, 5))]
        rows.append((f"t{i}", " ".join(ws), "train"))
        rows.append((f"e{i}", " ".join(r.sample(ws, len(ws)) if r.random() < 0.5 else edited(r, ws, 1)), "eval"))
    rows += [rows[0], ("n", None, "train"), (None, "pump", "eval"), ("b", " ", "eval"), ("o", "pump", None)]
    df = spark.createDataFrame(rows, "key string, question string, side string").withColumn("words", F.lit(1)).withColumn("cls", F.lit(1))
    sets = [(k, s, set(text.words_of(q))) for k, q, s in rows if k and s and text.words_of(q)]
    digits = lambda w: {x for x in w if any(c.isdigit() for c in x)}
    want = {(min(a, b), max(a, b)) for a, s, x in sets if s == "train" for b, t, y in sets if t == "eval" and digits(x) == digits(y) and len(x & y) >= 0.7 * len(x | y)}
    links, members = overlap.cross_split_links(df, shard=grid[0], block=grid[1])
    named = members.select(F.concat("side", F.hex("cls")).alias("cls"), "key").distinct()
    got = pairs_of(pairs.expand_pairs(links.select(F.concat(F.lit("train"), F.hex("a")).alias("a"), F.concat(F.lit("eval"), F.hex("b")).alias("b")), named, ("a", "b")))
    assert got == want
    if grid[0] == 2_000:
        assert pairs_of(overlap.cross_split_pairs(df)) == want and overlap.cross_split_pairs(df.limit(0)).count() == 0


def test_large_classes_in_full(spark, monkeypatch):
    # two linked classes, both with many spellings, and for p2 two classes of near copies
    rows = [(f"t{i:03}", "valve of pump 7" + "!" * i, "train") for i in range(103)] + [(f"e{i:03}", "valve of the pump 7" + "?" * i, "eval") for i in range(105)]
    df = spark.createDataFrame(rows, "key string, question string, side string")
    want = {(e, t) for t, _, s in rows for e, _, u in rows if s == "train" and u == "eval"}
    assert pairs_of(overlap.cross_split_pairs(df)) == want
    near = [(k, " ".join(WORDS[:40]) + (" more" if s == "train" else "") + "!" * i) for i, (k, _, s) in enumerate(rows)]
    every = {(a, b) for a, _ in near for b, _ in near if a < b}
    both = spark.createDataFrame(near, "key string, text string")
    assert pairs_of(neardup.near_duplicate_pairs(both)) == every
    monkeypatch.setattr(pairs, "TILE_KEYS", 40)
    assert pairs_of(overlap.cross_split_pairs(df)) == want and pairs_of(neardup.near_duplicate_pairs(both)) == every


def test_cross_split_report(spark, tmp_path):
    # 103 development and 160 evaluation spellings of one question; other questions; a key on both sides, one with two texts
    schema = "id string, question string, split string"
    formal = [(f"d{i:03}", "valve of pump 7" + "!" * i, "development") for i in range(80)] + [(f"e{i:03}", "of pump 7, valve" + "." * i, " Test") for i in range(110)]
    formal += [("x", "open the door", "development"), ("x", "open the door", "test"), ("y", "Open the door", "test"), ("z", "close it", "test"), ("z", "open the door", "test"), ("o", "valve of pump 7", " ")]
    other = [(f"f{i:03}", "Pump 7: valve of" + " " * i, "development") for i in range(23)] + [(f"g{i:03}", "valve of the pump 7" + "?" * i, "regression") for i in range(50)]
    other += [("z", "the door open", "development"), ("w", "open the door now", "development"), ("w", "open the door", "development"), ("f001", "Pump 7: valve of ", "development")]
    spark.createDataFrame(formal, schema).write.parquet(f"{tmp_path}/formal_questions.parquet")
    spark.createDataFrame(other, schema).write.parquet(f"{tmp_path}/application_questions.parquet")
    rows = [(n, k, set(text.words_of(q)), s.strip().lower()) for n, t in (("formal_questions", formal), ("application_questions", other)) for k, q, s in t]
    digits = lambda w: {x for x in w if any(c.isdigit() for c in x)}
    found = {}
    for n, k, x, s in rows:
        for m, e, y, t in rows:
            if s == "development" and t in ("test", "regression") and k != e and digits(x) == digits(y) and len(x & y) >= 0.7 * len(x | y):
                found.setdefault((m, t, n), set()).add((k, e))
    want = {(*g, len(p), len({e for _, e in p})) for g, p in found.items()}
    assert pairs_of(queries.p3_report(spark, str(tmp_path))) == want and len(want) == 4


# 4


def test_splitting_round_trip():
    r = random.Random(8)
    for n in (451, 900, 5000):
        for seps in ([" "], [" ", ". ", "\n", "\n\n", "\n# Head\n"], ["。", "！", "\n"], [""]):
            t = "".join(r.choice(["word", "阀", "16#80C8", "MB_LEN", "3.5"]) + r.choice(seps) + " " for _ in range(n))
            found = splitting.split_item(t)
            tokens = len(splitting.TOKEN.findall(t))
            assert bool(found) == (tokens > 450)
            if not found:
                continue
            assert [p[1] for p in found] == [0, *(p[2] for p in found[:-1])] and found[-1][2] == len(t)
            assert all(len(splitting.TOKEN.findall(t[s:e])) == n <= 450 for s, _, e, n, _ in found)
            assert all(40 <= p[4] <= 60 for p in found[1:]) and found[0][4] == 0
            assert sum(p[3] - p[4] for p in found) == tokens
    assert splitting.split_item(None) == [] == splitting.split_item("") == splitting.split_item("a " * 450)


def test_splitting_prefers_strong_boundaries(spark):
    t = ("word " * 200 + ". ") + "word " * 40 + "\n# Second\n" + "word " * 300
    found = splitting.split_item(t)
    assert t[found[1][1] :].startswith("# Second")
    df = spark.createDataFrame([("t", "1", t, ["Top", None, " "]), ("t", "1", t, ["Top", None, " "]), ("t", "2", None, None), ("t", "3", "x", None), (None, None, t, None)], "src_table string, item_id string, text string, section_path array<string>").withColumn("piece_no", F.lit(7))
    got = splitting.once(splitting.split_oversized(df)).where("item_id = '1'").orderBy("piece_no").collect()
    assert [list(r["section_path"]) for r in got] == [["Top"], ["Top", "Second"]] and all(r["n_tokens"] <= 450 for r in got)
    assert splitting.split_oversized(df.limit(0)).count() == 0


# 5


def test_lookalikes(spark):
    rows = [
        ("t", "1", "Α1"), ("t", "2", "A1"), ("t", "3", "A1"), ("t", "3", "A1"), ("u", "4", "Α1"), ("t", "5", "a1"), ("t", "6", "A1​"), ("t", "7", " "), ("t", "8", "　"), ("t", None, "A1 "), ("t", "9", None),
    ]
    df = spark.createDataFrame(rows, "src_table string, key string, text string").withColumn("form", F.lit("x"))
    want = {("t", "1", "2"), ("t", "1", "3"), ("t", "1", "6"), ("t", "2", "6"), ("t", "3", "6")}
    assert pairs_of(lookalikes.lookalike_pairs(df)) == want
    star = pairs_of(lookalikes.lookalike_pairs(df, full_pairs=1))
    assert star <= want and {x for p in star for x in p[1:]} == {"1", "2", "3", "6"}
    assert lookalikes.lookalike_pairs(df.limit(0)).count() == 0
    assert [r[0] for r in df.select(lookalikes.normalised(F.col("text"))).collect()][-1] is None


def test_lookalikes_large_form(spark, monkeypatch):
    # 130 spellings of one form, a mass of copies of one of them, and a key with two spellings
    rows = [("t", f"k{i:03}", "A" + "\u200b" * i + "1") for i in range(130)] + [("t", f"c{i:03}", "A1") for i in range(140)] + [("t", "k003", "A1"), ("t", "k005", "A1 ")]
    want = {("t", a, b) for _, a, x in rows for _, b, y in rows if a < b and x != y}
    df = spark.createDataFrame(rows, "src_table string, key string, text string")
    assert pairs_of(lookalikes.lookalike_pairs(df)) == want and len(want) > 130 * 129 // 2
    monkeypatch.setattr(lookalikes, "TILE_KEYS", 50)
    assert pairs_of(lookalikes.lookalike_pairs(df)) == want


# 7


def plain_best_fit(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in room if x >= s]
        left = min(fits) if fits else capacity
        if fits:
            room.remove(left)
        room.append(left - s)
    return len(room)


def test_plan_is_best_fit():
    r = random.Random(6)
    for _ in range(60):
        capacity = r.choice([10, 37, 100])
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
        histogram = {s: sizes.count(s) for s in set(sizes)}
        plan = packing.plan_containers(histogram, capacity)
        used = {}
        for k, (n, rank, first, each) in enumerate(plan):
            last = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == n else histogram[n]
            for i in range(rank, last):
                used[first + (i - rank) // each] = used.get(first + (i - rank) // each, 0) + n
        assert sum(used.values()) == sum(sizes) and all(v <= capacity for v in used.values())
        assert sorted(used) == list(range(len(used))) and len(used) == plain_best_fit(sizes, capacity)


def test_packing(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([1, 5, 30, 200])))) for i in range(200)] + [(900, None), (901, ""), (902, "x " * 500), (0, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).repartition(5)
    got = packing.pack_documents(df, 256).collect()
    encode = packing.encoder().encode_ordinary
    total = {}
    for g in got:
        if g["n_tokens"]:
            total[g["container_id"]] = total.get(g["container_id"], 0) + g["n_tokens"]
        else:
            assert g["container_id"] is None
    assert max(total.values()) <= 256 and sum(total.values()) == sum(len(encode(t or "")) for _, t in rows)
    pieces = {}
    for g in got:
        pieces.setdefault(g["doc_id"], []).append(g["n_tokens"])
    assert all(len(p) == 1 for k, p in pieces.items() if k not in (902, 0, *(i for i, t in rows if len(encode(t or "")) > 256)))
    assert sorted(pieces[902]) == sorted([256] * (len(encode("x " * 500)) // 256) + [len(encode("x " * 500)) % 256])
    assert packing.pack_documents(df.limit(0)).count() == 0
    assert packing.container_report(packing.pack_documents(df, 256), 256).first()["containers"] == len(total)


# 8


def test_tiling():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.uint64)
    d = np.array([9, 4, 5, 6, 7, 9, 1, 2, 3, 9, 8], np.uint64)
    assert leakage.tiles_of(a, d) == [(0, 6, 3), (3, 1, 4)]
    assert leakage.tiles_of(a, d[:2]) == [] == leakage.tiles_of(a[:0], d)


def test_leaks(spark):
    r = random.Random(12)
    item = [r.choice(WORDS) for _ in range(60)]
    other = [r.choice(WORDS) for _ in range(60)]
    noise = lambda n: [r.choice(WORDS[150:]) for _ in range(n)]
    dirty = list(item)
    for i in (5, 15, 26, 37, 48, 55):
        dirty[i] = "changed"
    del dirty[30]
    docs = [
        (1, " ".join(noise(50) + item + noise(50))), (2, "<p>" + "</p>\n<b>".join(noise(20) + dirty) + "</b>"), (3, " ".join(noise(30) + item[:36] + noise(30))), (4, " ".join(noise(30) + item[10:34] + noise(9))),
        (5, " ".join(x for i in range(0, 60, 6) for x in item[i : i + 6] + noise(12))), (6, " ".join(item[30:] + noise(40) + item[:30])), (7, None), (8, ""), (None, " ".join(item)),
        (9, " ".join(item).upper().replace(" ", "\n")), (1, " ".join(noise(5) + item)),
    ]
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(other)), (3, None), (4, " "), (None, "x y")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(df, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1)}
    assert leakage.leaked_items(df, items.limit(0)).count() == 0 and leakage.leaked_items(df.limit(0), items).count() == 0
    assert leakage.plain_words("regis-\nter <b>two</b> &amp; Über-\r\n wachung") == ["register", "two", "überwachung"]


def test_many_and_long_items(spark, monkeypatch):
    r = random.Random(4)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(30, 60)))) for i in range(12)]
    docs = [(i, " ".join(r.choice(WORDS) for _ in range(20)) + " " + items[i % 12][1]) for i in range(30)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = pairs_of(leakage.leaked_items(df, it).select("doc_id", "item_id"))
    assert want >= {(i, i % 12) for i in range(30)}
    # in blocks of an item or two, sent one after another; with items longer than a block; with words that share numbers
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 50)
    monkeypatch.setattr(leakage, "MOST_WORDS", 120)
    assert pairs_of(leakage.leaked_items(df, it).select("doc_id", "item_id")) == want
    monkeypatch.setattr(leakage, "MOST_NUMBERS", 40)
    assert pairs_of(leakage.leaked_items(df, it).select("doc_id", "item_id")) >= {(i, i % 12) for i in range(30)}


def test_clusters_of_edits_and_long_marks():
    item = np.arange(1, 101, dtype=np.uint64)
    doc = np.concatenate((item[:40], np.zeros(9, np.uint64), item[46:90]))
    assert leakage.is_leak(100, *leakage.best_stretch(item, doc)) and leakage.best_stretch(item, doc)[0] == 90
    assert leakage.plain_words("a <b " + "x" * 900 + ">c</b><!-- " + "y" * 900 + " -->d") == ["a", "c", "d"]
    assert splitting.heading_of("# " + "long " * 200) == (1, ("long " * 200).strip()[:100])


def test_banding_keeps_recall():
    assert neardup.banding(0) == neardup.banding(2_000_000) == (24, 3)
    for n in (2_000_001, 10**8, 10**9):
        assert neardup.banding(n)[0] % 2 == 0 and neardup.expected_recall(0.63, *neardup.banding(n)) > 0.998 and neardup.expected_recall(0.7, *neardup.banding(n)) > 0.9999


def test_near_duplicate_classes(spark):
    base = " ".join(WORDS[:40])
    rows = [("a", base), ("b", base.upper()), ("c", base + " more"), ("d", "alone here today"), ("e", None), ("f", " "), (None, base), ("a", base)]
    got = pairs_of(neardup.near_duplicate_classes(spark.createDataFrame(rows, "key string, text string")))
    assert got == {("a", "a", 2, 1), ("b", "a", 2, 1), ("c", "c", 1, 1), ("d", "d", 1, 0)}
    bands = pairs_of(neardup.near_duplicate_links(spark.createDataFrame(rows, "key string, text string"), bands=40, band_rows=4)[0])
    assert len(bands) == 1


def test_clean_stretch_beside_loose_one(spark):
    # the whole item loosely, with every fourth to sixth word changed and words added, and more than half of it cleanly
    item = [f"v{i}" for i in range(90)]
    loose = [x for i in range(0, 90, 6) for x in (*item[i : i + 3], "new", "odd", "else", "more", "or", "less")]
    docs = [(1, " ".join([*loose, *["far"] * 400, *item[:50]])), (2, " ".join(loose)), (3, " ".join([*item[:50], *["far"] * 400, *loose]))]
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {(1, 1), (3, 1)}
    # the clean half is the end of a loose chain
    ids = np.arange(1, 91, dtype=np.uint64)
    head = np.array([x for i in range(0, 36, 9) for x in (*range(i + 1, i + 4), *[99] * 6)], np.uint64)
    doc = np.concatenate((head, ids[36:86]))
    assert leakage.is_leak(90, *leakage.best_stretch(ids, doc))


def test_short_items(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta y"), (2, "alpha"), (3, "so delta is")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(docs, items).collect()}
    assert (2, 1) not in got  # one word of three is less than half


# 9


def test_labels(spark):
    labels = ["en", "EN-us", "en_GB", "English", " german ", "zh-Hans-CN", "chi", "xx", "", None, "und", "pt"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(languages.declared(F.col("l"))).collect()] == ["en", "en", "en", "en", "de", "zh", "zh", None, None, None, None, None]


def test_sentences():
    t = "One is 3.5 kW. Two?\nHead\n三。Vier ist hier.固件"
    assert [t[a:b].strip() for a, b in languages.sentences(t)] == ["One is 3.5 kW.", "Two?", "Head", "三。", "Vier ist hier.", "固件"]
    assert "".join(t[a:b] for a, b in languages.sentences(t)).replace("\n", "") == t.replace("\n", "")


def test_languages(spark):
    samples = [("en", "the valve is open and the pump runs with the motor"), ("de", "das Ventil ist offen und die Pumpe läuft mit dem Motor"), ("fr", "la vanne est ouverte et la pompe tourne avec le moteur"), ("es", "la válvula está abierta y la bomba gira con el motor"), ("it", "la valvola è aperta e la pompa gira con il motore"), ("zh", "阀门打开泵与电机一起运行")]
    docs = [
        (1, "The pump is open and the motor runs.", "en", "a_x"), (2, "Die Pumpe ist offen und das Ventil läuft.", "en", "a_y"), (3, "The pump runs with the motor. 阀门打开，泵与电机一起运行。", None, "b"), (4, "12 3.5 FF A0", "de", "b"),
        (5, None, None, None), (6, "", "en", "a_x"), (7, "The pump is open and «Guardar cambios» runs with the motor.", "English", "a_x"), (1, "The pump is open and the motor runs.", "en", "a_x"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("label", F.lit("z")).withColumn("family", F.lit("z"))
    segments = languages.language_segments(df, spark.createDataFrame(samples, "lang string, text string"))
    assert pairs_of(languages.language_cases(segments)) == {(2, "de"), (3, "en"), (3, "zh")}
    by = {r["doc_id"]: r for r in languages.document_languages(segments).collect()}
    assert by[2]["language"] == "de" and by[3]["languages"] == 2 and by[4]["language"] is None and by[5]["confidence"] == 0.0 and by[1]["confidence"] > 0.9
    assert languages.language_segments(df.limit(0), spark.createDataFrame(samples, "lang string, text string")).count() == 0
