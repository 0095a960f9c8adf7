"""The training-data operators against brute force and by hand."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import linkage, mixture, neighbors, packing, queries, tokens, topn, unify
from skeinwork.llm.components import components, shared_key_edges

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    from oracle import compare, views

    assert compare(queries.QUERIES[name](spark, SF), views(SF), queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


# --- 1: matching without keys ---

FORM = "key string, core string, number string, cut_off boolean, year int, runtime int, people array<string>, genres array<string>, language string"


def record(key, core, year=2000, runtime=100, person="ann lee", number="", genres=("drama",), cut_off=False):
    return (key, core, number, cut_off, year, runtime, [person] if person else None, list(genres), "en")


def matched(spark, entities, records, **how):
    a, b = spark.createDataFrame(entities, FORM), spark.createDataFrame(records, FORM)
    return {(r.e, r.r): r.probability for r in linkage.match(a, b, **how).collect() if r.probability >= 0.5}


def test_match(spark):
    films = [record("f1", "goldenferry"), record("f2", "goldenferry", 1970, 90, "bo ray"), record("f3", "ironwinter", None, None, None, genres=()), record("f4", "quietoath", number="2"), record("f5", None)]
    rts = [record("r1", "goldenferry", 2001, 101), record("r2", "goldenfery", 2000, 99), record("r3", "goldenferry", 1970, 91, "b ray"), record("r4", "quietoath", 2004, 130), record("r5", "nothing", 1950, 60, "zed zed"), record("r6", None)]
    got = matched(spark, films, rts)
    assert set(got) == {("f1", "r1"), ("f1", "r2"), ("f2", "r3")}
    assert matched(spark, films, []) == {} and matched(spark, [], rts) == {}


def candidate_pairs(spark, films, rts, **how):
    """Keys of the candidates, from tables in the described form."""
    e = linkage.cut(linkage.sketched(linkage.with_common(spark.createDataFrame(films, FORM))))
    r = linkage.cut(linkage.sketched(spark.createDataFrame(rts, FORM)))
    pairs = linkage.candidates(e, r, **how).join(e.select(F.col("n").alias("e"), F.col("key").alias("ek")), "e").join(r.select(F.col("n").alias("r"), F.col("key").alias("rk")), "r")
    return {(x.ek, x.rk) for x in pairs.collect()}, e, r


def test_bound_is_never_below_the_odds(spark):
    random.seed(11)
    cores, names = ["goldenferry", "goldenfery", "ironwinter", "ironwinters", "quiet", "quietoath"], ["ann lee", "a lee", "anne lee", "bo ray", "bo raye", "bob ray", "c d lee"]
    made = lambda i: (f"k{i}", random.choice(cores), random.choice(["", "", "2"]), random.random() < 0.1, random.choice([None, 2000, 2001, 2002, 2009]), random.choice([None, 100, 103, 107, 130]), random.choice([None, [], *[[n] for n in names], ["ann lee", "bo ray"]]), random.choice([[], ["drama"], ["drama", "war"], ["western"]]), random.choice([None, "en", "fr"]))
    every, e, r = candidate_pairs(spark, [made(i) for i in range(120)], [made(i) for i in range(120)], floor=None)
    kept, e, r = candidate_pairs(spark, [made(i) for i in range(120)], [made(i) for i in range(120)], floor=0.0)
    cross = e.select(F.col("n").alias("e")).crossJoin(r.select(F.col("n").alias("r")))
    odds = {(x.e, x.r): x.odds for x in linkage.evidence(e, r, cross, -100.0).collect()}
    keys = {(x.e, x.r) for x in linkage.evidence(e, r, linkage.candidates(e, r, None), -100.0).collect()}
    assert {p for p in keys if odds[p] >= 0} <= kept and len(kept) < len(keys)


def test_hot_blocks_meet_in_slots(spark):
    films = [record(f"f{i}", "same", 2000, 60 + i, f"p q{i:03d}") for i in range(30)] * 2
    rts = [record(f"r{i}", "same", 2000, 60 + i, f"p q{i:03d}") for i in range(30)]
    assert candidate_pairs(spark, films, rts, slot_rows=4)[0] == candidate_pairs(spark, films, rts)[0]
    assert candidate_pairs(spark, films, rts)[0] >= {(f"f{i}", f"r{i}") for i in range(30)}


def test_match_without_director_and_running_time(spark):
    films = [record("f1", "copperhunterinrzierk", 2000, 116, None), record("f2", "crookedneedle", 2000, None, None), record("f3", "ironwinter", 1980, 100, None), record("f4", "lostink", 2003, 112, None), record("f5", "clevermountainfaithfultailor", None, None, None)]
    rts = [record("r1", "copperhunterinrzierc", 2000, 113, None), record("r2", "crookednneedle", 2001, 115, None), record("r3", "ironwinter", 1982, 104, None), record("r4", "lsotink", 2003, 109, None), record("r5", "clevermountinfaithfultailor", 2004, 114, None)]
    assert set(matched(spark, films, rts)) == {(f"f{i}", f"r{i}") for i in range(1, 6)}


def test_large_blocks_keep_every_pair(spark):
    films = [record(f"f{i}", "same", 2000, 100, None) for i in range(400)] + [record(f"d{i}", f"film{i}", 1990, 90, "p quirk", genres=("war",)) for i in range(160)]
    rts = [record(f"r{i}", "same", 2000, 103, None) for i in range(160)] + [record(f"s{i}", f"tape{i}", 1990, 99, "p quirrk", genres=("crime",)) for i in range(160)]
    got = candidate_pairs(spark, films, rts, floor=None, slot_rows=50)[0]
    assert got == {(f"f{i}", f"r{j}") for i in range(400) for j in range(160)} | {(f"d{i}", f"s{j}") for i in range(160) for j in range(160)}
    # 400 films of one title leave odds of 0 + 3 + 1.5 + 2 + 0.5 - log(400), above the floor.
    assert {p for p in got if p[0][0] == "f"} <= candidate_pairs(spark, films, rts)[0]


def test_bound_tells_texts_of_the_same_letters_apart(spark):
    row = lambda key, core, people: (key, core, "", False, 2001, 100, people, [], "en")
    films = [row("f", "marblegate", ["ann lee"]), row("g", "orchardoath", ["joran tesk"])]
    rts = [row("same", "marblegate", ["ann lee"]), row("anagram", "eratgbmale", ["ann lee"]), row("one of two", "orchardoath", ["bo ray", "jorn tesk"]), row("of two others", "orchardoath", ["narjo kets", "sket raj"])]
    _, e, r = candidate_pairs(spark, films, rts)
    cross = e.select(F.struct("*").alias("e")).crossJoin(r.select(F.struct("*").alias("r")))
    most = {(x.ek, x.rk): x.b for x in cross.select(F.col("e.key").alias("ek"), F.col("r.key").alias("rk"), linkage.bound(lambda c: F.col(f"e.{c}"), lambda c: F.col(f"r.{c}")).alias("b")).collect()}
    assert most["f", "anagram"] <= most["f", "same"] - 4.5 and most["g", "of two others"] <= most["g", "one of two"] - 9


def test_names_two_edits_apart_share_a_block_of_their_year(spark):
    row = lambda key, core, name: (key, core, "", False, 2001, None, [name], [], None)
    films = [row("f", "marblegate", "dorimel brimastos")]
    rts = [row(n, "quietoath", n) for n in ("borimel brimastos", "dorimex brimastos", "dorimel krimastos", "dorimel brimastox", "borimel brimastox", "dorimexx brimastos", "d brimastos")] + [row("other", "quietoath", "karel brixx")]
    kept = candidate_pairs(spark, films, rts, floor=None)[0]
    assert {r for _, r in kept} == {x[0] for x in rts if x[0] != "other"}


def exact_marginals(edges, repeat):
    """All sets of edges with one per record: weight exp(sum of odds) * product over entities of repeat ** -(n - 1)."""
    total, on = 0.0, defaultdict(float)
    for mask in range(1 << len(edges)):
        chosen = [e for i, e in enumerate(edges) if mask >> i & 1]
        if len({r for _, r, _ in chosen}) < len(chosen):
            continue
        n = defaultdict(int)
        for e, _, _ in chosen:
            n[e] += 1
        w = np.exp(sum(o for _, _, o in chosen)) * np.prod([repeat ** -(k - 1) for k in n.values()])
        total += w
        for e, r, _ in chosen:
            on[e, r] += w
    return {k: v / total for k, v in on.items()}


def test_marginals_on_a_tree_are_exact(spark):
    edges = [("a", "x", 1.0), ("a", "y", 0.5), ("b", "y", 0.3), ("b", "z", -1.0), ("c", "z", 2.0)]
    got = {(r.e, r.r): r.probability for r in linkage.marginals(spark.createDataFrame(edges, "e string, r string, odds double"), tolerance=1e-7, max_rounds=60).collect()}
    assert got == pytest.approx(exact_marginals(edges, linkage.REPEAT), abs=1e-4)


def test_title_parts(spark):
    rows = ["The Golden Ferry (4K)", "Golden Ferry, The", "Gölden Ferry: Director's Cut", "golden ferry III", "Golden Fer…", "!!!", None]
    p = linkage.title_parts(F.col("t"), ["directors cut"])
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "t string").select(*[c.alias(n) for n, c in p.items()]).collect()]
    assert got == [("goldenferry", "", False)] * 3 + [("goldenferry", "3", False), ("goldenfer", "", True), (None, "", False), (None, "", False)]


def test_additions_are_learned(spark):
    films = spark.createDataFrame([(f"film {i}",) for i in range(50)] + [(f"film {i} homecoming",) for i in range(20)] + [(None,)], "t string")
    records = spark.createDataFrame([(f"Film {i}: Uncut",) for i in range(8)] + [(f"Film {i}: Homecoming",) for i in range(20)] + [(f"Film {i}",) for i in range(40)] + [("Film: Rare",), (None,)], "t string")
    assert linkage.additions(films, records) == ["uncut"]
    assert linkage.additions(films.limit(0), records.limit(0)) == []


# --- 3: most similar vectors ---


def brute(vectors, k, floor=-1.0):
    x = np.array([v for _, v in vectors])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = {}
    for i, (name, _) in enumerate(vectors):
        line = sorted(((-s[i, j], o) for j, (o, _) in enumerate(vectors) if j != i and s[i, j] >= floor))[:k]
        out[name] = [o for _, o in line]
    return out


def test_nearest_with_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16)).astype(np.float32)
    vectors = [(f"v{i:03d}", (base[i % 40] + (0.2 * rng.standard_normal(16) if i < 200 else 0)).astype(np.float32)) for i in range(260)]
    rows = [(n, v.tolist(), 9) for n, v in vectors] + [("v000", vectors[0][1].tolist(), 9), ("bad1", None, 9), ("bad2", [0.0] * 16, 9), ("bad3", [float("nan")] * 16, 9), ("bad4", [1.0] * 15, 9), (None, [1.0] * 16, 9)]
    df = spark.createDataFrame(rows, "canonical_id string, embedding array<float>, rep int")
    for how in ({}, {"cell_rows": 30, "probes": 100, "block_rows": 7, "hot_rows": 1}):
        got = defaultdict(list)
        for r in neighbors.nearest(df, "canonical_id", "embedding", 16, k=5, **how).orderBy("id", F.desc("sim"), "neighbor").collect():
            got[r.id].append(r.neighbor)
        assert got == brute([(n, v.astype(float)) for n, v in vectors], 5)
    pairs = {tuple(r) for r in neighbors.similar_pairs(df, "canonical_id", "embedding", 16, 5, 0.8).collect()}
    assert pairs == {tuple(sorted((a, b))) for a, line in brute([(n, v.astype(float)) for n, v in vectors], 5, 0.8).items() for b in line}
    assert neighbors.nearest(df.limit(0), "canonical_id", "embedding", 16).count() == 0


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(2)
    unit = lambda n: (lambda a: a / np.linalg.norm(a, axis=1, keepdims=True))(rng.standard_normal((n, 64)))
    x, q, c = unit(500), unit(200), unit(1)[0]
    offs, kept = [], []
    for seed in range(12):
        rot = neighbors.rotation(64, seed)
        about, error = neighbors.estimate(neighbors.encode(x, np.tile(c, (500, 1)), rot), x @ c, q, c, rot)
        offs.append(about - q @ x.T)
        kept.append(np.abs(offs[-1]) <= error)
    assert np.mean(kept) > 0.98
    assert np.abs(np.mean(offs, axis=0)).mean() < 0.5 * np.abs(offs).mean()  # errors cancel over rotations: no bias


def test_recall_is_high(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 64))
    vectors = [(f"v{i:05d}", centres[i % 60] + 0.35 * rng.standard_normal(64)) for i in range(3000)]
    df = spark.createDataFrame([(n, v.astype(np.float32).tolist()) for n, v in vectors], "k string, e array<float>")
    want = brute([(n, v.astype(np.float32).astype(float)) for n, v in vectors], 10)
    hit = sum(r.neighbor in want[r.id] for r in neighbors.nearest(df, "k", "e", 64).collect())
    assert hit / 30000 >= 0.9


# --- 5: top N ---


def test_top_n(spark):
    random.seed(4)
    rows = [("big", i, random.choice([1.0, 2.0, 3.0]), "x") for i in range(500)] + [(f"g{i % 40}", i, random.random(), "x") for i in range(300)] + [("few", 1, 0.0, "x")] * 3
    df = spark.createDataFrame(rows, "g string, item int, score double, band string")
    want = sorted(r for g in {x[0] for x in rows} for r in sorted([x for x in rows if x[0] == g], key=lambda x: (-x[2], x[1]))[:10])
    for edges in (None, [], [2.5], [2.5, 1.5, 0.5], [9.0]):
        got = topn.top_n(df, "g", "score", [F.desc("score"), F.asc("item")], 10, edges, scanned=df.limit(5) if edges is None else None).collect()
        assert sorted(map(tuple, got)) == want
    assert topn.top_n(df.limit(0), "g", "score", [F.desc("score"), F.asc("item")]).count() == 0


# --- 6: groups ---


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_components(spark, hot):
    random.seed(6)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("s0", f"s{i}") for i in range(1, 40)] + [(f"r{random.randint(0, 60)}", f"r{random.randint(0, 60)}") for _ in range(50)] + [("x", "x"), (None, "y"), ("z", None)]
    edges += edges[:20] + [(b, a) for a, b in edges[:5]]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a and b and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.member: r.group_id for r in components(spark.createDataFrame([(*e, 1) for e in edges], "u string, v string, n int"), hot).collect()}
    assert got == {a: find(a) for a in parent}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0
    rows = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), (None, "c"), ("l", None), ("m", "d")], "key string, member string")
    assert [tuple(r) for r in shared_key_edges(rows, "key", "member").collect()] == [("b", "a")]


# --- 8: containers ---


def test_packing(spark):
    random.seed(8)
    sizes = [(i, random.choice([0, 3, 17, 40, 90, 110, 200, 260, 333, 500, 900, 1000, 1024])) for i in range(800)] + [(900, 5000), (901, 1024), (902, None), (903, 2048)]
    df = spark.createDataFrame([(a, b, 1) for a, b in sizes], "doc_id long, n_tokens long, container int")
    for how in ({}, {"shard_rows": 50}, {"groups": 3}):
        rows = packing.pack(df, 1024, **how).collect()
        room, by = defaultdict(int), defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
            if r.container is not None:
                room[r.container] += r.n_tokens
        assert max(room.values()) <= 1024 and set(by) == {a for a, _ in sizes}
        for a, b in sizes:
            assert sum(r.n_tokens for r in by[a]) == (b or 0)
            assert len(by[a]) == max(1, -(-(b or 0) // 1024))
            assert sorted(r.start_token for r in by[a]) == [1024 * i for i in range(len(by[a]))]
        least = -(-sum(room.values()) // 1024)
        if "groups" not in how:  # three sizes only must waste room
            assert len(room) <= least * 1.03 + 2 + 2 * (how.get("shard_rows", 0) and 17)
    assert packing.pack(df.limit(0), 1024).count() == 0


def test_configurations_hold_the_demand():
    plan = packing.configurations(np.array([700, 400, 330]), np.array([101, 57, 220]), 1024)
    assert sum(p * n for p, n in plan).tolist() == [101, 57, 220]
    assert all(p @ np.array([700, 400, 330]) <= 1024 for p, _ in plan)
    assert sum(n for _, n in plan) <= 101 + 29 + 74 + 2  # nothing fits beside a 700; two 400s or three 330s to one


def test_linear_groups_are_equal():
    groups = defaultdict(int)
    for _, _, n, g in packing.linear_groups({10: 7, 9: 1, 8: 92, 1: 3}, 5):
        groups[g] += n
    assert sum(groups.values()) == 103 and max(groups.values()) - min(groups.values()) <= 1


# --- 9: mixing ---

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("gone", 0.1, 2), ("none", 0.0, 2)]


def mixed(spark, docs, total=None, families=None):
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, lang string, cap int")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    return mixture.mix(d, t, total, families), d, t


def test_mixture(spark):
    random.seed(9)
    docs = [(i, random.choice("aaaaab"), random.randint(1, 400), random.choice(["en", "fr"]), 1) for i in range(3000)] + [(5000 + i, "c", 50, "en", 1) for i in range(40)] + [(6000, None, 10, "en", 1), (6001, "other", 10, "en", 1), (6002, "a", 0, "en", 1), (6003, "a", None, "en", 1)]
    m, d, t = mixed(spark, docs)
    rows = m.collect()
    caps = {s: c for s, _, c in TARGETS}
    assert all(1 <= r.copies <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    used = defaultdict(int)
    for r in rows:
        used[r.source] += r.copies * r.n_tokens
    want = mixture.feasible([(s, sum(x[2] or 0 for x in docs if x[1] == s)) for s in "abc"], {s: w for s, w, _ in TARGETS}, caps, None)
    for s in "abc":
        assert abs(used[s] - want[s]) <= 60, (s, used[s], want[s])
    more = mixed(spark, docs, families={"lang": {"en": 0.3, "fr": 0.7}})[0].collect()
    by = lambda f: {k: sum(r.copies * r.n_tokens for r in more if f(r) == k) for k in {f(r) for r in more}}
    assert by(lambda r: r.source) == pytest.approx(want, abs=60)
    lang = {x[0]: x[3] for x in docs}
    assert by(lambda r: lang[r.doc_id])["fr"] / sum(want.values()) == pytest.approx(0.7, abs=0.05)
    report = {r.source: r for r in mixture.share_report(m, d, t).collect()}
    assert report["gone"].actual_share == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert mixed(spark, [])[0].count() == 0


def test_size_of_a_mixture_follows_the_corpus():
    shares, caps = {"big": 0.5, "mid": 0.48, "tiny": 0.02}, {"big": 1, "mid": 2, "tiny": 8}
    cells = [("big", 10_000), ("mid", 8_000), ("tiny", 1)]
    exact = mixture.feasible(cells, shares, caps, None, 0.0)
    assert sum(exact.values()) == pytest.approx(400) and exact["big"] == pytest.approx(200)
    most = mixture.feasible(cells, shares, caps, None)
    assert most["tiny"] == 8 and most["big"] == pytest.approx(10_000) and most["mid"] <= 16_000
    lacking = sum(max(0.0, shares[s] * sum(most.values()) - most[s]) for s in most)
    assert lacking <= 0.05 * sum(most.values()) * 1.0001
    assert sum(mixture.feasible(cells, shares, caps, 1000.0).values()) == pytest.approx(1000)
    assert mixture.feasible([], shares, caps, None) == {} and mixture.feasible([("big", 5)], shares, caps, None) == {"big": 5.0}


def test_newton_fails_loudly(spark):
    cells = spark.createDataFrame([("a", "en", 1, 100.0, 1.0)], "source string, lang string, cap int, tokens double, base double")
    with pytest.raises(RuntimeError):
        mixture.newton(cells, ["source"], {("source", "a"): 500.0}, max_rounds=5)


def test_newton_with_two_families(spark):
    cells = spark.createDataFrame([("a", "en", 9, 100.0, 1.0), ("a", "fr", 9, 300.0, 1.0), ("b", "en", 9, 200.0, 1.0), ("b", "fr", 9, 100.0, 1.0)], "source string, lang string, cap int, tokens double, base double")
    goal = {("source", "a"): 200.0, ("source", "b"): 200.0, ("lang", "en"): 250.0, ("lang", "fr"): 150.0}
    tilt = mixture.newton(cells, ["source", "lang"], goal)
    got = defaultdict(float)
    for r in cells.collect():
        w = r.tokens * np.exp(tilt["source", r.source] + tilt["lang", r.lang])
        got["source", r.source] += w
        got["lang", r.lang] += w
    assert dict(got) == pytest.approx(goal, rel=1e-6)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, "", 5), (4, "<|endoftext|>", 5), (5, "a" * 200_000, 5), (1, "Hello world", 5)], "doc_id long, text string, n int")
    got = [(r.doc_id, r.n_tokens) for r in tokens.token_counts(df, "doc_id", "text").collect()]
    again = tokens.token_counts(df, "doc_id", "text", tokenizer="/opt/tokenizers/byte_bpe_50k.json")
    assert got == [(r.doc_id, r.n_tokens) for r in again.collect()]
    assert got[0] == got[5] == (1, 2) and got[1][1] == got[2][1] == 0 and got[3][1] > 1 and got[4][1] > 1000


# --- 10: one form ---


def test_looks():
    same = [("ｆｕｌｌ ｗｉｄｔｈ", "full width"), ("é", "é"), ("e͏́", "é"), ("ﬁne oﬃce", "fine office"), ("a b c　d", "a b c d"), ("co​op­", "coop"), ("сор", "cop"), ("Αthens", "Athens"), ("deaⅼ", "deal"), ("tl;dr", "tl;dr"), ("5‐year", "5-year"), ("K", "K"), ("a\r\nb", "a\nb"), ("​", "")]
    for a, b in same:
        assert unify.look(a) == unify.look(b), (ascii(a), ascii(unify.look(a)))
    other = [("a", "A"), ("e", "é"), ("x2", "x²"), ("1/2", "½"), ("a.", "a!"), ("👨‍👩‍👧", "👨👩👧"), ("a-b", "a–b"), ("❤", "❤️"), ("12 × 5", "12 x 5"), ("a  b", "a b"), ("①", "1"), ("л", "n"), ("ſ", "s")]
    for a, b in other:
        assert unify.look(a) != unify.look(b), (ascii(a), ascii(b))
    assert unify.look_folded("STRASSE") == unify.look_folded("ｓｔｒａße")
    for text in ("ﬁ́‍ ｶﾞ", "가", "Ǆ"):
        assert unify.look(unify.look(text)) == unify.look(text)


def test_same_look_pairs(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "a b"), (4, None), (5, None), (6, "A b"), (7, "x" * 300_000), (8, "х" + "x" * 299_999), (9, ""), (10, "​"), (11, "a b")]
    df = spark.createDataFrame([(*r, "q", "q") for r in rows], "doc_id long, text string, f string, t string")
    got = sorted(tuple(r) for r in unify.same_look_pairs(df, "doc_id", "text").collect())
    assert got == [(1, 2), (1, 11), (2, 3), (2, 11), (3, 11), (7, 8), (9, 10)]
    assert sorted(tuple(r) for r in unify.same_look_pairs(df, "doc_id", "text", hot_rows=1).collect()) == got
    assert unify.same_look_pairs(df.limit(0), "doc_id", "text").count() == 0
