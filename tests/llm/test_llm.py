"""Operators on language-model data against brute force, with dirty rows."""

import hashlib
import random
import re
import unicodedata
from collections import Counter
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest
import verify
from pyspark.sql import functions as F

from tilewright.llm import leaks, mixture, pii, queries, redact, runs, surrogates, terms, tokens, words


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, small, name):
    text, ok = verify.compare(spark, verify.connect(small), name, small)
    assert ok, text


#: Queries without SQL, and what must hold of their rows.
HOLDS = {
    "p8_leaks": lambda r: r["n_windows"] > 0 and 0.8 <= r["similarity"] <= 1 and r["whole_similarity"] <= r["similarity"] and (r["longest_words"] == 0 or r["similarity"] == 1),
    "p9_mixture": lambda r: r["copies"] >= 1 and r["n_tokens"] >= 1 and r["source"] == r["source"].strip().lower(),
    "p9_shares": lambda r: 0 <= r["actual_share"] <= 1 and r["max_copies"] <= r["max_repeats"] and r["longest_tokens"] <= r["supply_tokens"],
    "p10_found": lambda r: r["pii_type"] in pii.TYPES and r["pii_value"] == r["pii_value"].strip() != "",
    "p10_redacted": lambda r: r["text"] is None and r["n_replaced"] == 0 or r["n_replaced"] == len(re.findall(r"\[(?:EMAIL|ID_NUMBER|ADDRESS|PHONE|PERSON_NAME):", r["text"])),
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_what_holds_without_sql(spark, small, name):
    rows = queries.QUERIES[name](spark, small).collect()
    assert rows and all(map(HOLDS[name], rows))


# terms

V = "struct<string_value:string,int_value:bigint>"
LAYERS = f"tile_layer_id long, layer_keys array<string>, layer_values array<{V}>, term string"
FEATURES = "tile_layer_id long, feature_id long, tags array<int>, word long"
META = "tileset string, build_no int, received_at timestamp, archive_id long, vector_layers array<struct<id:string,fields:map<string,string>>>"


def test_terms(spark, monkeypatch):
    layers = spark.createDataFrame([(1, ["a", "b"], [(" Yes ", None), ("yes", None), (None, 3), ("  ", None), ("n  o", None)], "t")] * 2, LAYERS)  # given twice
    f = [(1, i, [0, 0, 1, 1], 0) for i in range(200)] + [(1, 0, [0, 0], 0)] * 3 + [(1, 300, [0, 4, 1], 0), (1, 301, [2, 0, -1, 0, 0, 9, 0, 3], 0), (1, 302, None, 0), (1, 303, [], 0), (None, 1, [0, 0], 0), (2, None, [0, 0], 0), (2, 5, [0, 0], 0)]
    at = datetime(2025, 1, 1)
    m = [("t", 1, at, 1, [("l", {"Name": "s", "x": "s"})]), ("t", 1, at, 0, [("l", {"zz": "s"})]), ("t", 2, at, 2, [("l", {"NAME": "s"}), ("k", {"name": "s"})]), ("t", 3, at, 3, None)]
    got = rows_of(terms.term_statistics(spark.createDataFrame(f, FEATURES), layers, spark.createDataFrame(m, META)))
    assert got == [("field", "name", 2, 3, 2), ("field", "x", 1, 1, 2), ("value", "n o", 1, 1, 205), ("value", "yes", 200, 400, 205)]
    marks = rows_of(terms.marked(terms.term_statistics(spark.createDataFrame(f, FEATURES), layers, spark.createDataFrame(m, META))))
    assert marks == [("field", "name", "common"), ("field", "name", "rare"), ("field", "x", "rare"), ("value", "n o", "rare"), ("value", "yes", "common")]
    monkeypatch.setattr(terms, "BLOCK", 16)  # the first layer is cut into blocks
    assert got == rows_of(terms.term_statistics(spark.createDataFrame(f, FEATURES), layers, spark.createDataFrame(m, META)))
    blocks, large = terms.feature_blocks(spark.createDataFrame(f, FEATURES))
    assert large.where("parts > 10").count() == 1 and blocks.where("tile_layer_id = 1").agg(F.max(F.size("features"))).first()[0] < 40
    assert terms.value_words(blocks, large, layers).where("term = 'yes'").agg(F.sum(F.bit_count("word"))).first()[0] == 200
    empty = terms.term_statistics(spark.createDataFrame([], FEATURES), layers.limit(0), spark.createDataFrame([], META))
    assert empty.collect() == []


def test_bitmaps_merge_as_sets(spark):
    rng = random.Random(1)
    a = [(rng.choice("pq"), rng.randrange(-200, 70_000)) for _ in range(3000)] + [("p", None)]
    b = [(rng.choice("pq"), rng.randrange(70_000)) for _ in range(3000)]
    wa, wb = (terms.record_words(spark.createDataFrame(x, "t string, n long"), ["t"], "n") for x in (a, b))
    got = {r["t"]: (r["n_records"], r["n_occurrences"]) for r in terms.frequencies(terms.merge_words(wa.unionByName(wb), ["t"]), ["t"]).collect()}
    for t in "pq":
        own = [n for u, n in a + b if u == t and n is not None]
        assert got[t] == (len(set(own)), len(own))


# runs


@pytest.mark.parametrize("width", [4, 64, 65_536])
def test_covering_runs(spark, width):
    rng = random.Random(width)
    ev = [(rng.choice(["a", None]), s := rng.randrange(-300, 900), s + rng.choice([0, 0, 1, 3, 40])) for _ in range(500)]
    ev += ev[:50] + [("a", 5, 4), ("a", None, 3), ("a", 7, None), ("hot", 0, 5000)] + [("hot", i * 3, i * 3) for i in range(200)]
    got = rows_of(runs.covering_runs(spark.createDataFrame(ev, "g string, s long, e long"), ["g"], "s", "e", width))
    want = []
    for g in {"a", None, "hot"}:
        cur = None
        for s, e in sorted({(s, e) for h, s, e in ev if h == g and s is not None and e is not None and s <= e}):
            if cur and s <= cur[2] + 1:
                cur[2], cur[3] = max(cur[2], e), cur[3] + 1
            else:
                cur = [g, s, e, 1]
                want.append(cur)
    assert got == sorted(map(tuple, want), key=repr)


def test_runs_of_nothing_and_collapse(spark):
    assert runs.covering_runs(spark.createDataFrame([], "g string, s long, e long"), ["g"], "s", "e").collect() == []
    at = lambda m: datetime(2025, 1, 1, 0, m)
    ev = [("u", 1, "a", at(1)), ("u", 2, "a", at(3)), ("u", 3, None, at(4)), ("u", 4, None, at(5)), ("u", 5, "a", None), (None, 1, "a", at(1))]
    got = rows_of(runs.collapse(spark.createDataFrame(ev, "g string, i int, kind string, at timestamp"), ["g"], ["i"], ["kind"], "at").select("g", "kind", "n_events", "seconds"))
    assert got == sorted([("u", "a", 2, 120.0), ("u", None, 2, 60.0), ("u", "a", 1, None), (None, "a", 1, 0.0)], key=repr)


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_collapse_over_blocks(spark, monkeypatch, width):
    """Runs that go on over one or many blocks, against a loop; the hot group spans all of them."""
    monkeypatch.setattr(runs, "NUMBERS", width)
    rng = random.Random(width)
    ev = [(rng.choice(["a", "b", None]), i, rng.choice(["x", "x", "x", "y", None])) for i in rng.sample(range(-100, 300), 200)] + [("hot", i, "x" if i < 150 else "y") for i in range(300)] + [("a", None, "x")]
    times = spark.createDataFrame(ev, "g string, i int, k string").withColumn("at", F.timestamp_seconds(F.col("i")))
    got = rows_of(runs.collapse(times, ["g"], ["i"], ["k"], "at").select("g", "k", "n_events", "seconds"))
    want = []
    for g in {e[0] for e in ev}:
        last = object()
        for _, i, k in sorted((e for e in ev if e[0] == g), key=lambda e: (e[1] is not None, e[1] or 0)):
            if k != last:
                want.append([g, k, 0, []])
                last = k
            want[-1][2] += 1
            want[-1][3] += [] if i is None else [i]
    assert got == sorted([(g, k, n, float(max(t) - min(t)) if t else None) for g, k, n, t in want], key=repr)


# words and leaks


def plain_words(t):
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", t).casefold())
    return re.findall(r"[^\W_]+", "".join(c for c in t if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cf"))


def test_word_hashes():
    texts = ["One  two-THREE", None, "", "öne tw­o three", "ONE​ two\x00three", "x" * 5000 + " y", "日本 ٣٤ ﬁne"]
    hashes, counts = words.word_hashes(texts)
    assert counts.tolist() == [len(plain_words((t or "").replace("\x00", " "))) for t in texts]
    assert hashes[:3].tolist() == hashes[3:6].tolist() == hashes[6:9].tolist()


def test_long_text_is_cut_at_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = words.word_hashes([text, "tail end"])
    monkeypatch.setattr(words, "PIECE", 100)
    cut = words.word_hashes([text, "tail end"])
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist() == [3000, 2]


def test_majority_and_blocks():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**64, 300, np.uint64)
    for n in (1, 3, 8, 48):
        rows = np.lib.stride_tricks.sliding_window_view(s, n)
        got = leaks.majority(rows)
        for i in (0, 7, len(s) - n):
            bits = [sum(int(x) >> b & 1 for x in s[i : i + n]) > n // 2 for b in range(64)]
            assert int(got[i]) == sum(1 << b for b in range(64) if bits[b])


@pytest.mark.parametrize("radius", [leaks.ITEM_RADIUS, leaks.PASSAGE_RADIUS])
def test_no_print_within_the_radius_is_missed(monkeypatch, radius):
    monkeypatch.setattr(leaks, "PAIRS", 500)
    rng = np.random.default_rng(2)
    there = rng.integers(0, 2**64, 60, np.uint64)
    asked = np.concatenate([rng.integers(0, 2**64, 100, np.uint64), np.repeat(there, 5)])
    for i in range(100, len(asked)):
        for b in rng.choice(64, rng.integers(0, radius + 3), replace=False):
            asked[i] ^= np.uint64(1) << np.uint64(b)
    i, j = leaks.MultiIndex(there, radius).near(asked)
    want = np.argwhere(np.bitwise_count(asked[:, None] ^ there[None, :]) <= radius)
    assert np.stack([i, j], axis=1).tolist() == want.tolist() and len(want) > 60


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 60)))) for i in range(30)] + [(30, None), (31, "")]
    items.append((32, items[0][1]))  # shares its passage
    docs = []
    for d in range(120):
        t = rng.choices(vocab, k=rng.randrange(0, 80))
        src = plain_words(rng.choice(items[:30])[1])
        n = rng.choice([11, 12, 13, 30])
        at = rng.randrange(max(1, len(src) - n + 1))
        t[10:10] = src[at : at + n]
        docs.append((d, " ".join(w.upper() if rng.random() < 0.3 else f"{w}," if rng.random() < 0.3 else w.replace("o", "ö­") for w in t)))
    docs += [(200, None), (201, ""), (202, "short"), (None, items[0][1]), (203, items[1][1])] + [docs[0]] * 2
    monkeypatch.setattr(leaks, "STEP", 64)
    monkeypatch.setattr(leaks, "ITEM_BLOCK_CHARS", 2000)
    monkeypatch.setattr(leaks, "PASS_BLOCKS", 3)
    monkeypatch.setattr(leaks, "PAIRS", 50)
    monkeypatch.setattr(leaks, "WINDOW_BYTES", 4000)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = leaks.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    best = {(r["doc_id"], r["item_id"]): r["longest_words"] for r in got.collect() if r["longest_words"] >= 12}
    windows = {}
    for i, t in items:
        w = plain_words(t or "")
        for k in range(len(w) - 11):
            windows.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [plain_words(t or "")] for k in range(len(w) - 11) for i in windows.get(tuple(w[k : k + 12]), ())}
    assert set(best) == want and min(best.values()) >= 12
    assert leaks.find_leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert leaks.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).collect() == []


def similar_pairs(docs, items, size, least):
    """Pairs (document, item) of which an item-sized window has weighted shingle similarity ``least``, window by window."""
    sh = lambda w: [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
    of = {i: sh(plain_words(t)) for i, t in items}
    df = Counter(x for own in of.values() for x in set(own))
    weight = lambda xs: sum(1 + np.log((1 + len(items)) / (1 + df.get(x, 0))) for x in xs)
    out = set()
    for d, t in docs:
        w = plain_words(t)
        for i, own in of.items():
            n, b = len(own), set(own)
            for a in (set(sh(w[k : k + n + size - 1])) for k in range(len(w) - n - size + 2)):
                if a & b and weight(a & b) >= least * weight(a | b):
                    out.add((d, i))
                    break
    return out


def test_recall_for_altered_items(spark):
    """Items copied with words replaced, added or left out, against all windows of all documents: nine tenths at least are
    found of the pairs that are similar by 0.8, and nothing else."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(45, 90)))) for i in range(40)]
    docs = []
    for d in range(400):
        own = rng.choice(items)[1].split()
        for _ in range(rng.choice([1, 1, 2, 3])):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([["other"], [own[at], "more"], []])
        fill = lambda: rng.choices(vocab, k=rng.randrange(0, 40))
        docs.append((d, " ".join([*fill(), *own, *fill()])))
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = [r for r in got.collect() if r["whole_similarity"] > 0]
    assert all(0.8 <= r["whole_similarity"] <= 1 for r in rows)
    found, want = {(r["doc_id"], r["item_id"]) for r in rows}, similar_pairs(docs, items, 5, 0.8)
    print("recall", len(found), len(want))
    assert len(want) > 150 and found <= want and len(found) >= 0.9 * len(want)


def test_short_items_are_compared_whole(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "alpha beta gamma"), (3, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x One, two three four five six seven eight nine ten ELEVEN y"), (2, "an alpha beta gamma ray"), (3, "alpha beta"), (4, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    got = rows_of(leaks.find_leaks(docs, items).select("doc_id", "item_id", "longest_words", "whole_similarity"))
    assert got == [(1, 1, 11, 1.0), (2, 2, 3, 1.0)]


def test_windows_that_many_items_share(monkeypatch):
    """One class of windows for all items that have it; a text is expanded in steps, over items where it is too much for one."""
    rng = random.Random(5)
    notice = [f"n{i}" for i in range(15)]
    items = [" ".join([*rng.choices([f"v{i}" for i in range(500)], k=20), *notice]) for _ in range(300)]
    monkeypatch.setattr(leaks, "PAIRS", 100)
    found = leaks.ItemIndex.build(list(range(300)), items, 12, 5, 0.8).opened()
    steps = list(found.search(["a " + " ".join(notice) + " b", "nothing", " ".join(notice[:12]) + " c " + " ".join(notice)]))
    pairs = [(int(t), int(i), int(n), int(w)) for s in steps for t, i, n, w in zip(*s[:4])]
    assert sorted(pairs) == sorted([(0, i, 4, 15) for i in range(300)] + [(2, i, 5, 15) for i in range(300)]) and len(steps) > 10
    notices = next(k for k in found.index.kinds if not k.whole)
    assert len(notices.member_class) - len(notices.rows) >= 299 * 4


# mixtures


def test_subset_sum_is_best():
    rng = random.Random(2)
    for _ in range(80):
        free = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        target = rng.randrange(0, 120)
        got = mixture.subset_sum(free, target, 1)
        assert all(got[l] <= free[l] for l in got)
        reach = {0}
        for l, c in free.items():
            reach = {s + l * k for s in reach for k in range(c + 1)}
        assert sum(l * n for l, n in got.items()) == max(s for s in reach if s <= target)


def test_fit_uses_budget():
    counts = {l: 50 + l % 7 for l in range(10, 400)} | {20_000: 3}
    supply = sum(l * c for l, c in counts.items())
    for budget in (0, 1, 977, supply // 3, supply, 2 * supply + 12_345):
        rounds, taken = mixture.fit(counts, budget, 1)
        assert all(0 <= taken[l] <= counts[l] for l in counts)
        assert 0 <= budget - rounds * supply - sum(l * n for l, n in taken.items()) < 10


def test_fit_takes_long_documents():
    assert mixture.fit({85_000: 1, 84_000: 1, 83_000: 1}, 90_000, 0) == (0, {85_000: 1, 84_000: 0, 83_000: 0})
    assert mixture.fit({900_000: 3, 800_000: 1}, 1_650_000, 0)[1] in ({900_000: 0, 800_000: 1}, {900_000: 1, 800_000: 0})
    assert mixture.fit({10_000_000: 2}, 9_999_999, 0) == (0, {10_000_000: 0}) and mixture.fit({}, 5, 0) == (0, {})


def test_fit_is_best_for_small_budgets(monkeypatch):
    rng = random.Random(3)
    for reserve in (mixture.RESERVE, 60):
        monkeypatch.setattr(mixture, "RESERVE", reserve)
        for _ in range(150):
            counts = {rng.choice([rng.randrange(1, 40), rng.randrange(300, 500)]): rng.randrange(1, 4) for _ in range(5)}
            supply = sum(l * c for l, c in counts.items())
            budget = rng.randrange(0, 2 * supply)
            rounds, taken = mixture.fit(counts, budget, 1)
            assert rounds == budget // supply and all(0 <= taken[l] <= counts[l] for l in counts)
            rest, got = budget - rounds * supply, sum(l * n for l, n in taken.items())
            reach = {0}
            for l, c in counts.items():
                reach = {s + l * k for s in reach for k in range(c + 1)}
            best = max(s for s in reach if s <= rest)
            assert got <= best and (got == best or rest > reserve)
            assert all(taken[l] == counts[l] or l > rest - got for l in counts)  # nothing that is free would still fit


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixture, "RANKED_TOGETHER", 7)
    docs = [(i, "word " * (5 + i % 3), ["A ", "a", "b", None, "other"][i % 5], "x") for i in range(400)] + [(900, None, "a", "x"), (901, "", "a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rank string")
    goals = spark.createDataFrame([("a", 0.5, 2), (" B", 0.3, 3), ("none", 0.2, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mixture.mixture(df, goals, seed=3)
    rows = mixed.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["copies"] <= {"a": 2, "b": 3}[r["source"]] for r in rows)
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["a"]["actual_share"] - 0.625) < 0.01 and abs(s["b"]["actual_share"] - 0.375) < 0.01 and s["none"]["mixed_tokens"] == 0
    assert rows_of(mixture.mixture(df, goals, seed=3)[0]) == sorted(map(tuple, rows), key=repr)
    few, share = mixture.mixture(df, goals, total_tokens=100)
    assert 90 <= share.agg(F.sum("mixed_tokens")).first()[0] <= 100
    assert mixture.mixture(df.limit(0), goals)[0].collect() == [] and mixture.mixture(df, goals.limit(0))[0].collect() == []


def test_token_counts(spark):
    df = tokens.with_token_counts(spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "k int, text string"))
    n = {r["k"]: r["n_tokens"] for r in df.collect()}
    assert n[1] == 2 and n[2] == 0 and n[3] is None and n[4] > 1


# personal information

KNOWN = pii.Names.of([("Verrin", 1), ("Sölva", 1), ("Stone", 2), ("Étourneau", 2), ("Marsh", 2), ("Field", 2)])


@pytest.mark.parametrize("text,kind,values", [
    ("Mail <a.b+c@mail.karto.test>, x", "email", ["a.b+c@mail.karto.test"]), ("mailto:x @ web.example.", "email", ["x @ web.example"]), ("to q [at] web [dot] example [dot] org now", "email", ["q [at] web [dot] example [dot] org"]),
    ("q at web dot example, any", "email", ["q at web dot example"]), ("Meet at noon dot on the pier. Follow us @kartodepot or @tile_makers.", "email", []),
    ("Tel. (415) 555-0163 ext. 93, +49 30 23125833 or 01.99.00.67.73", "phone", ["(415) 555-0163 ext. 93", "+49 30 23125833", "01.99.00.67.73"]), ("+44 (0)1632 960 279; 030 / 23125 705", "phone", ["+44 (0)1632 960 279", "030 / 23125 705"]),
    ("Sensor +27 374 93 mV. ISBN-like code 97-5447-222. Invoice 2074-3631, Order no. 54687555", "phone", []), ("+49-30-23125-834 01 99 00 17 20", "phone", ["+49-30-23125-834", "01 99 00 17 20"]), ("0049 30 23125 769 118 Larkfield Road", "phone", ["0049 30 23125 769"]),
    ("passport no. NM 43 65 93 R Die", "id_number", ["NM 43 65 93 R"]), ("numéro fiscal : 965-00-7616", "id_number", ["965-00-7616"]), ("pasaporte n.º: Z68279029", "id_number", ["Z68279029"]), ("Part number 761-42-4123X in stock. License plate frame size 46 854 mm.", "id_number", []),
    ("at 73a Saltmarsh Drive, 160 TANNERY ROAD and 41 Tannery St..", "address", ["73a Saltmarsh Drive", "160 TANNERY ROAD", "41 Tannery St."]), ("Route 28 Larkfield Road works. Bus 749 stops at Saltmarsh Lane.", "address", []),
    ("Lindenhofstraße 181, Bahnhofstr. 66, Am Alten Wehr 172a. Am Montag 12 Uhr", "address", ["Lindenhofstraße 181", "Bahnhofstr. 66", "Am Alten Wehr 172a"]), ("50, rue du Vieux Pont La tuile, 60 bis rue des Peupliers", "address", ["50, rue du Vieux Pont", "60 bis rue des Peupliers"]),
    ("Calle de la Alfarería n.º 120; C/ del Puente Viejo, 178.", "address", ["Calle de la Alfarería n.º 120", "C/ del Puente Viejo, 178"]),
    ("By Verrin K. Stone, V. Marsh and Stone, Verrin", "person_name", ["Verrin K. Stone", "V. Marsh", "Stone, Verrin"]), ("Herr VERRIN ÉTOURNEAU", "person_name", ["VERRIN ÉTOURNEAU"]), ("The Stone Bridge. Marsh Field is a meadow. Verrin Marsh Road", "person_name", []),
    ("SÃ¶lva Stone, Verrin �tourneau", "person_name", ["SÃ¶lva Stone", "Verrin �tourneau"]), ("FÃ¤hrstraÃ\x9fe 9", "address", ["FÃ¤hrstraÃ\x9fe 9"]), ("", "email", []), (None, "email", []),
])
def test_find(text, kind, values):
    assert [text[a:b] for a, b, k in pii.find(text, KNOWN) if k == kind] == values


def test_repair_keeps_places():
    text, places = pii.repair("a Ã©tÃ© Ã z")
    assert text == "a été Ã z" and [places[i] for i in (2, 3, 4, 5)] == [2, 4, 5, 7] and pii.repair("plain")[1] is None


def test_learning_names(spark):
    docs = [(i, f"By Verrin {f} and {g} Stone.") for i, (f, g) in enumerate([("Quarn", "Isol")] * 3)] + [(9, "Sölva Quarn, Isol Étourneau met Isol Quarn. The Stone. The Marsh."), (10, None), (11, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lex = spark.createDataFrame([("Verrin", "given"), (" Sölva ", "given"), ("Stone", "family"), ("Étourneau", "family"), (None, "given"), ("x", None)], "name_text string, name_kind string")
    assert sorted(redact.learned_parts(df, redact.lexicon_parts(lex))) == [("isol", 1), ("quarn", 2)]
    found = redact.find_pii(df, lex)
    assert ("Isol Quarn" in {r["pii_value"] for r in found.collect()}) and found.where("doc_id > 9").count() == 0
    assert redact.find_pii(df, lex.limit(0)).count() == 0 and redact.find_pii(df.limit(0), lex).count() == 0


def test_surrogates():
    s = surrogates.Surrogates(b"k", surrogates.name_parts(b"k", ["verrin", "stone", "marsh", "alva"]))
    assert sorted(s.permuted(i, 777, "t") for i in range(777)) == list(range(777))
    assert sorted(int(s.counted(str(i), "t")) for i in range(100, 1000)) == list(range(100, 1000)) and len({s.counted(f"0{i}", "t") for i in range(10)}) == 10 and s.counted("7", "t") in "123456789" and s.counted("", "t") == ""
    assert len(set(surrogates.name_parts(b"k", [f"n{i}" for i in range(500)]).values())) == 500
    a, b = s.replace("person_name", "Verrin K. Stone"), s.replace("person_name", "STONE, VERRIN")
    assert a.split()[0].upper() == b.split(", ")[1] and a.split()[2].upper() == b.split(",")[0] and re.fullmatch(r"[A-Z]\.", a.split()[1])
    assert s.parts["alva"].endswith("a")
    assert s.replace("email", "a.bc at web dot example").replace(" at ", "@").replace(" dot ", ".") == s.replace("email", "a.bc@web.example")
    assert s.replace("phone", "+44 1632 960881")[-6:] == s.replace("phone", "01632 960881")[-6:]
    shape = lambda v: re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", v))
    for kind, v in (("id_number", "LM 73 53 30 V"), ("phone", "(415) 555-0121 ext. 98")):
        assert shape(s.replace(kind, v)) == shape(v) and s.replace(kind, v) != v
    assert s.replace("address", "12, rue de la Tuilerie").split("rue de la")[0].endswith(", ")


def test_names_of_other_scripts():
    """Capitals of any script begin names, and letters of scripts without case; replacements stay in the script."""
    known = pii.Names.of([("Łukasz", 1), ("Żeromska", 2), ("Иван", 1), ("Петрова", 2), ("Νίκος", 1), ("Παππάς", 2), ("דוד", 1), ("כהן", 2)])
    for text in ("Łukasz Żeromska", "Иван Петрова", "Νίκος Παππάς", "דוד כהן", "ИВАН ПЕТРОВА"):
        assert [(a, b, k) for a, b, k in pii.find(f"x {text}, y", known)] == [(2, 2 + len(text), "person_name")], text
    s = surrogates.Surrogates(b"k", surrogates.name_parts(b"k", list(known.roles)))
    for text, script in (("Иван Петрова", "CYRILLIC"), ("Νίκος Παππάς", "GREEK"), ("דוד כהן", "HEBREW"), ("Łukasz Żeromska", "LATIN")):
        new = s.replace("person_name", text)
        assert new != text and {surrogates.script_of(w) for w in new.split()} == {script} and [w[0].isupper() for w in new.split()] == [w[0].isupper() for w in text.split()]


def test_given_names_keep_their_sex(spark):
    """By the titles before them, whatever letter they end in; without titles by their ending."""
    docs = [(i, t) for i, t in enumerate(["Mrs Carmen Stone met Mr. Nicolas Marsh.", "La señora Carmen Marsh, Herr Dr. Nicolas Stone", "Frau Carmen Field", "Luca Stone and Marina Marsh"])]
    lex = spark.createDataFrame([("Carmen", "given"), ("Nicolas", "given"), ("Luca", "given"), ("Marina", "given"), ("Stone", "family"), ("Marsh", "family"), ("Field", "family")], "name_text string, name_kind string")
    known = redact.known_names(spark.createDataFrame(docs, "doc_id long, text string"), lex)
    assert known.sexes == {"carmen": "f", "nicolas": "m"}
    parts = surrogates.name_parts(b"k", list(known.roles), known.sexes)
    assert parts["carmen"][-1] == "a" and parts["nicolas"][-1] not in "aeiou" and parts["marina"][-1] == parts["luca"][-1] == "a"


def test_learning_parts_that_are_ordinary_words(spark):
    """A family name that is an ordinary word nine times out of ten and more is learned by its many partners; an ordinary
    word that stands beside a few isn't."""
    given = [f"Gi{c}len" for c in "abcdefghijkl"]
    docs = [(i, f"By {g} Winter. {g} Most of it.") for i, g in enumerate(given * 2)] + [(100 + i, "Winter comes. The Winter Garden.") for i in range(200)] + [(400 + i, f"{g} Later on.") for i, g in enumerate(given[:3])] + [(500 + i, "Most of it. Later.") for i in range(2000)]
    lex = spark.createDataFrame([(g, "given") for g in given], "name_text string, name_kind string")
    assert redact.learned_parts(spark.createDataFrame(docs, "doc_id long, text string"), redact.lexicon_parts(lex)) == [("winter", 2)]
    assert pii.enough(8, 2, 100) and not pii.enough(7, 7, 100) and not pii.enough(50, 1, 100) and pii.enough(4, 8, 100) and pii.enough(2, 30, 100) and not pii.enough(1, 9, 9)


def test_what_follows_a_name():
    for text, value in (("Verrin Stone Bridge 68 prints open quays.", ["Verrin Stone"]), ("Verrin Stone Dr. Marsh will open", ["Verrin Stone"]), ("Verrin Marsh Road", []), ("Verrin Stone Library closes", [])):
        assert [text[a:b] for a, b, k in pii.find(text, KNOWN) if k == "person_name"] == value, text


def test_redact(spark):
    docs = [(1, "Call (415) 555-0163, Verrin Stone!\nVerrin Stone"), (2, None), (3, "nothing"), (1, "Call (415) 555-0163, Verrin Stone!\nVerrin Stone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lex = spark.createDataFrame([("Verrin", "given"), ("Stone", "family")], "name_text string, name_kind string")
    got = [r for r in redact.redact(df, lex, b"k").collect()]
    one = next(r["text"] for r in got if r["doc_id"] == 1)
    m = re.fullmatch(r"Call \[PHONE:\(415\) \d{3}-\d{4}\], \[PERSON_NAME:(\w+ \w+)\]!\n\[PERSON_NAME:(\w+ \w+)\]", one)
    assert m and m[1] == m[2] != "Verrin Stone" and Counter(r["text"] for r in got) == {one: 2, None: 1, "nothing": 1}
    assert redact.redact(df, lex, b"k", style="type").where("doc_id = 1").first()["text"] == "Call [PHONE], [PERSON_NAME]!\n[PERSON_NAME]"


def test_clashing_replacements_are_parted(spark):
    """Two originals that come to the same replacement: one of them moves to the next attempt."""
    names, key = pii.Names.of([]), b"k"
    found = spark.createDataFrame([("email", f"u{i}@host.example") for i in range(20)] + [("phone", "(415) 555-0163")], "pii_type string, pii_value string")
    assert redact.entities(found, key, names).count() == 21 and redact.collision_attempts(found, key, names) == {}
    core = "u1@host.example"
    first, second = (surrogates.Surrogates(key, attempts=a).replace("email", core) for a in ({}, {("email", core): 1}))
    assert first != second and first.endswith(".example") and second.endswith(".example")


def test_gates_let_all_spellings_through():
    for label in ("numéro de sécurité sociale: 1234567", "Fuhrerschein: 1234567", "national\nid: 1234567", "id  card: 1234567"):
        assert [label[a:b] for a, b in pii.id_numbers(label, label.lower())] == ["1234567"], label
    for text in ("anna ( at ) host (dot) org", "anna [ at ] host.org", "anna (arroba) host.org"):
        assert [text[a:b] for a, b in pii.emails(text, text.lower())] == [text], text


def test_partners_are_counted_exactly(spark):
    """Two partners of a word count as two, also those that a bitmap of 64 slots held for one."""
    given = ["Anna", "Bruno", "Clara", "David", "Elena", "Felix", "Greta", "Hugo", "Irene", "Jonas", "Karla", "Lukas", "Maria", "Nora", "Oskar", "Paula", "Quentin", "Rosa", "Simon", "Tilda", "Ulrich", "Vera", "Walter", "Xenia"]
    slot = lambda w: int.from_bytes(hashlib.blake2b(pii.plain_form(w).encode(), digest_size=8).digest(), "big") % 64
    a, b = next((a, b) for a, b in combinations(given, 2) if slot(a) == slot(b))
    docs = spark.createDataFrame([(f"We met {n} Quastner there.",) for n in (a, b)], "text string").repartition(2)
    parts = [(g, pii.GIVEN) for g in given]
    assert [w for w, _ in redact.learned_parts(docs, parts)] == [pii.plain_form("Quastner")]
    assert redact.learned_parts(docs.where(F.col("text").contains(a)), parts) == []
