"""Small fixtures for the core operators: nulls, ties, repeats, empty tables, extra columns, long texts."""

import datetime as dt
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skeinwork.functions import arrays, dates, numeric, strings
from skeinwork.functions.missing import present, uuid_key
from skeinwork.operators import aggregates, ordered, quality, recommend, relational, seasonruns, sports
from skeinwork.operators.hotdeck import Fill, hot_deck, weighted_median
from skeinwork.operators.orphans import Reference, orphan_counts, orphan_rows
from skeinwork.operators.recordparse import TITLES, TOMATOES, Parser, money, parse_records, parse_text
from skeinwork.operators.skew import hot_split_join

T = lambda y, m=1: dt.datetime(y, m, 1)


def reference(child, parent):
    return Reference("t", child, "row_id", F.col("k"), "at", F.year("at").cast("string"), parent, F.col("k"), "loaded_at", "removed_at")


CHILD = "row_id long, k string, at timestamp_ntz, n int, __key string, period string"
PARENT = "k string, loaded_at timestamp_ntz, removed_at timestamp_ntz"


def test_orphans_by_time(spark):
    child = spark.createDataFrame([(1, "a", T(2020), 1, "x", "y"), (2, "a", T(2018), 1, "x", "y"), (3, "b", T(2020), 1, None, None), (4, None, T(2020), 1, "x", "y"), (5, "a", T(2022), 1, "x", "y"), (6, "a", T(2024), 1, "x", "y"), (7, "b", T(2020), 1, "x", "y"), (8, "a", None, 1, "x", "y")], CHILD)
    parent = spark.createDataFrame([("a", T(2019), T(2021)), ("a", T(2023), None), ("a", T(2019), T(2021)), (None, T(2019), None)], PARENT)
    for hot in (1_000_000, 1):
        got = sorted(r.row_id for r in orphan_rows(reference(child, parent), hot).collect())
        assert got == [2, 3, 5, 7, 8]
    counts = {r.period: (r.n_references, r.n_orphans, r.n_orphan_keys) for r in orphan_counts(reference(child, parent)).collect()}
    assert counts == {"2018": (1, 1, 1), "2020": (3, 2, 1), "2022": (1, 1, 1), "2024": (1, 0, 0), None: (1, 1, 1)}


def test_orphans_of_empty_tables(spark):
    child, parent = spark.createDataFrame([], CHILD), spark.createDataFrame([], PARENT)
    assert orphan_rows(reference(child, parent)).count() == 0
    assert orphan_counts(reference(child, parent)).count() == 0
    one = spark.createDataFrame([(1, "a", T(2020), 1, "x", "y")], CHILD)
    assert orphan_rows(reference(one, parent)).count() == 1


def test_keys_and_placeholders(spark):
    rows = [" 431A0E79-6A93-8365-0ED2-CF1ACAFCE36D ", "{431a0e79-6a93-8365-0ed2-cf1acafce36d}", "urn:uuid:431a0e79-6a93-8365-0ed2-cf1acafce36d", "431A0E796A9383650ED2CF1ACAFCE36D", "431a0e79-6a93", "N/A", " ", None, "-"]
    got = [r.k for r in spark.createDataFrame([(x,) for x in rows], "c string").select(uuid_key("c").alias("k")).collect()]
    full = "431a0e796a9383650ed2cf1acafce36d"
    assert got == [full] * 4 + ["431a0e796a93", None, None, None, None]
    got = [r.k for r in spark.createDataFrame([(x,) for x in ["  Male ", "\\N", "NaN", "Unknown", " Not Available "]], "c string").select(present("c").alias("k")).collect()]
    assert got == ["male", None, None, None, None]


DECK = "row_id long, g string, v string, w double, level int, filled_value string"


def test_hot_deck(spark):
    rows = [(1, "a", "x", 1.0), (2, "a", "y", 1.0), (3, "a", None, 1.0), (4, "a", "?", 1.0), (5, None, None, 1.0), (6, "b", None, 1.0), (7, "c", "Y ", 1.0), (8, "c", "z", 1.0), (9, "c", "y", 1.0), (10, "c", "", 1.0), (10, "c", "", 1.0)]
    df = spark.createDataFrame([(*r, 7, "q") for r in rows], DECK)
    for hot in (1_000_000, 1):
        got = sorted((r.row_id, r.filled_value, r.n_donors) for r in hot_deck(df, "row_id", Fill("v", present("v"), [[present("g")]]), hot).collect())
        assert got == [(3, "x", 2), (4, "x", 2), (10, "y", 3), (10, "y", 3)]
    assert hot_deck(df.limit(0), "row_id", Fill("v", present("v"), [[present("g")]])).count() == 0


def test_hot_deck_names_the_nearest_donors(spark):
    from skeinwork.operators.hotdeck import by_distance

    rows = [(1, "g", "a", "x", None), (2, "g", "a", "y", "far"), (3, "g", "b", "x", "near"), (4, "g", "b", "x", "near"), (5, "g", None, None, None), (6, "other", "a", "x", "no"), (7, "g", "a", "x", None), (1, "g", "c", "x", None)]
    df = spark.createDataFrame(rows, "row_id int, g string, a string, b string, v string")
    levels, distances = by_distance([F.col("g")], [(F.col("a"), 1.0), (F.col("b"), 2.0)])
    assert distances == [0.0, 1.0, 2.0, 3.0]
    got = sorted((r.row_id, r.filled_value, r.distance, r.n_donors, r.donor_id) for r in hot_deck(df, "row_id", Fill("v", F.col("v"), levels, distances=distances)).collect())
    assert got == [(1, "near", 1.0, 2, 3), (1, "near", 1.0, 2, 3), (5, "near", 3.0, 3, 3), (7, "near", 1.0, 2, 3)]
    weighed = Fill("v", F.col("v"), [[F.col("g")]], weight=F.when(F.col("v") == "far", 5).otherwise(1))
    assert {r.filled_value for r in hot_deck(df, "row_id", weighed).collect()} == {"far"}


def test_files_are_parsed_with_recovery(spark):
    from skeinwork.operators.recordparse import parse_files

    good = lambda i: f'rt_{i},"A, ""B"" {i}",1,2,2000-01-01,90,Drama,Ann Lee,$1.5M,X'
    lines = [good(0), 'rt_1,"open,1,2,3,4,5,6,7,8', good(2), good(3).replace("Drama,", ""), good(4), good(5).replace('1,2,', '1,2\n3,'), good(6).replace("$1.5M", "1,5"), good(7) + "\r", good(8)]
    lines[5] = good(5).replace("A, ", "A,\n")
    rows = [(i, "rt_movies", f"f{i // 9}", x) for i, x in enumerate(lines * 3)] + [(99, "nothing", "f", "x"), (100, "title.basics", None, None)]
    df = spark.createDataFrame(rows, "line_id long, feed string, file_name string, raw_line string")
    want = sorted((r.line_id, r.reason) for r in parse_records(df).collect() if r.reason and r.feed != "nothing")
    assert len(want) == 10
    for block in (1000, 4, 2):
        assert sorted((r.line_id, r.reason) for r in parse_files(df, block, 3).collect()) == want
    assert parse_files(df.limit(0)).count() == 0


def test_hot_deck_levels_and_numbers(spark):
    rows = [(1, "a", "p", 10.0), (2, "a", "p", None), (3, "a", "q", 30.0), (4, "a", "r", None), (5, "a", "q", 50.0), (6, "b", "p", None)]
    df = spark.createDataFrame(rows, "row_id long, g string, h string, w double")
    got = sorted((r.row_id, r.filled_value, r.level) for r in hot_deck(df, "row_id", Fill("w", F.col("w"), [[F.col("g"), F.col("h")], [F.col("g")]], "number")).collect())
    assert got == [(2, 10.0, 1), (4, 30.0, 2)]


def test_weighted_median_is_exact(spark):
    import random

    random.seed(3)
    rows = [("a", random.randint(0, 40), random.randint(1, 5)) for _ in range(500)] + [("b", 7, 1)] * 90 + [("c", i, 1) for i in range(1001)]
    got = {r.g: r.v for r in weighted_median(spark.createDataFrame(rows, "g string, v int, w int"), ["g"], "v", "w").collect()}
    for g in "abc":
        line = sorted(v for k, v, w in rows if k == g for _ in range(w))
        assert got[g] == line[(len(line) + 1) // 2 - 1]


def reasons(spark, lines):
    df = spark.createDataFrame([(i, f, x, 1) for i, (f, x) in enumerate(lines)], "line_id long, feed string, raw_line string, reason int")
    return [r.reason for r in parse_records(df).orderBy("line_id").collect()]


def test_parse_reasons(spark):
    ok = 'rt_1,"A, ""B""",1,2,2001-01-01,90,Drama,X,"$1,234.5K",Y'
    lines = [
        ("rt_movies", ok), ("rt_movies", ok + "\r"), ("rt_movies", ok.replace("B", "B\nC")), ("rt_movies", ok + "\r\r"), ("rt_movies", ok[:-2] + '"'), ("rt_movies", ok.replace('"$1,234.5K"', "$1234,5K")), ("rt_movies", ok.replace('"$1,234.5K"', '"12,34"')), ("rt_movies", ok.replace('"$1,234.5K"', "")),
        ("rt_movies", ok.replace("Drama", 'Dr"ama')), ("rt_movies", ok.replace("Drama", '"Drama"x')), ("rt_movies", "a,b"), ("rt_movies", ""), ("rt_movies", None), ("other", "x"),
        ("title.basics", "tt1\tmovie\tA \"q\tA\t0\t2001\t\\N\t90\tDrama"), ("title.basics", "tt1\tmovie\tA\tA\t0\t1869\t\\N\t90\tDrama"), ("title.basics", "tt1\tmovie\tA\tA\t0\t\\N\t\\N\t\\N\tDrama\r"), ("title.basics", "tt1\tmovie\tA\tA\t0\t2001\t\\N\t1441\tDrama"), ("title.basics", "tt1\tmovie\tA\tA\t0\t2001\t\\N\t\tDrama"), ("title.basics", "tt1\tmovie"), ("title.basics", "tt1\tmovie\tA\tA\t0\t2001\t\\N\t9٢\tDrama"),
        ("rt_movies", '"' + "x" * 2_000_000), ("rt_movies", ok.replace("Drama", "D" * 2_000_000)),
    ]
    want = [None, None, None, None, "quoting", "column_count", "invalid_value", None, "quoting", "quoting", "column_count", "column_count", "column_count", "unknown_feed", None, "invalid_value", None, "invalid_value", "invalid_value", "column_count", "invalid_value", "quoting", None]
    assert reasons(spark, lines) == want
    assert parse_records(spark.createDataFrame([], "line_id long, feed string, raw_line string")).count() == 0


def test_parse_recovers_at_record_starts():
    good = "rt_1,T,1,2,2001,90,Drama,X,,Y"
    text = "\n".join([good, 'rt_2,"broken,1,2,2001,90,Drama,X,,Y', good.replace("rt_1", "rt_3"), 'rt_4,"a\nb",1,2,2001,90,Drama,X,5M,Y', "rt_5,short"])
    got = [(r.reason, r.fields[0] if r.fields else None) for r in parse_text(text, TOMATOES)]
    assert [g[0] for g in got] == [None, "quoting", None, None, "column_count"]
    assert got[2][1] == "rt_3" and got[3][1] == "rt_4"
    assert [r.reason for r in parse_text("tt1\ta\tb\tc\t0\t2000\t\\N\t9\tx\r\ntt2\tbad", TITLES)] == [None, "column_count"]
    assert money("$1,000.5K") == 1_000_500 and money("2b") == 2e9 and money("") is None
    assert next(Parser(TOMATOES, True).text('a,"b')).at == 2


def test_hot_split_join_is_an_inner_join(spark):
    facts = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("z", 2), (None, 3)], "k string, i int")
    dim = spark.createDataFrame([("a", 50, "x"), ("b", 1, "y"), (None, 1, "w")], "k string, n long, v string")
    for hot in (10, 1000):
        assert hot_split_join(facts, dim, ["k"], "n", hot).count() == 51
        assert hot_split_join(facts, dim, ["k"], "n", hot, null_safe=True).count() == 52


def test_positions_and_ranks(spark):
    rows = [(i, (i * 37) % 11) for i in range(200)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = {r.id: r.p for r in ordered.positions(df.filter("v is not null"), ["v", "id"], "p").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [i for v, i in sorted((v, i) for i, v in rows if v is not None)]
    r = {x.id: x for x in ordered.ranks(df, "v").collect()}
    assert r[1000].average_rank is None
    top = [i for i, v in rows if v == 10]
    assert r[top[0]].average_rank == (len(top) + 1) / 2 and r[top[0]].below == 0
    by = ordered.positions_by(df.filter("v is not null").withColumn("k", F.col("id") % 3), ["k"], "v", [F.desc("v"), F.asc("id")], "p").collect()
    for k in range(3):
        assert [x.id for x in sorted((x for x in by if x.k == k), key=lambda x: x.p)] == [i for v, i in sorted(((-v, i) for i, v in rows if v is not None and i % 3 == k))]


def test_ewm_golden(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 2.0)], "t int, x double")
    got = [r.e for r in ordered.ewm_mean(df, "x", [], [F.col("t")], 3.0, "e").orderBy("t").collect()]
    assert got == pytest.approx([1.0, 2.1150133319511157, 2.067558952178453])
    series = [(g, t, None if t % 7 == 3 else (t * 37 % 11) - 3.0) for g in ("a", "b") for t in range(700)]
    rows = ordered.ewm_mean(spark.createDataFrame(series, "g string, t int, x double"), "x", ["g"], [F.col("t")], 40.0, "e", block=64).filter("g = 'a'").orderBy("t").collect()
    s = w = 0.0
    for r in rows:
        s, w = s * 0.5 ** (1 / 40), w * 0.5 ** (1 / 40)
        if r.x is not None:
            s, w = s + r.x, w + 1
        assert r.e == pytest.approx(s / w, abs=1e-9)


def test_fuzzy_scores():
    assert relational.indel_ratio("kitten", "sitting") == pytest.approx(100 * (1 - 5 / 13))
    assert relational.indel_ratio("", "") == 100 and relational.indel_ratio("a", "") == 0
    assert relational.token_sort_ratio("the dark knight", "knight the dark") == 100
    assert relational.token_set_ratio("the dark knight", "the dark knight rises again") == 100


def test_scalar_goldens(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first().x
    assert v(strings.money(F.lit("€1.33bn"))) == pytest.approx(1.33e9) and v(strings.money(F.lit("£500M"))) == 5e8 and v(strings.money(F.lit("free"))) is None
    assert v(strings.bucket_of(F.lit("u1:e"))) == 44
    assert v(strings.title_key(F.lit("  Señor--X!! "))) == "se or x" and v(strings.title_key(F.lit("!!"))) is None
    assert v(strings.title_key_without_year(F.lit("Café (1999)"))) == "café" and v(strings.year_in_title(F.lit("Café (1999)"))) == 1999
    assert v(strings.tenure_months(F.lit("2 years 3 months 15 days"))) == 27.5 and v(strings.tenure_months(F.lit("0 days"))) is None
    assert v(strings.clock(F.lit("9.05"))) == "09:05" and v(strings.clock(F.lit("25:00"))) is None
    assert v(strings.padded_id(F.lit("123"))) == "tt0000123" and v(strings.padded_id(F.lit("tt123456789"))) == "tt123456789"
    assert v(strings.clean_text(F.lit("<b>A&amp;B</b> &nbsp; c!"))) == "a b c" and v(strings.clean_text(F.lit("<i></i>"))) == "unknown_text"
    assert v(dates.season_of(F.lit("2023-08-01").cast("date"))) == "2023/24" and v(dates.season_of(F.lit("2000-01-01").cast("date"))) == "1999/00"
    assert v(dates.season_shifted(F.lit("1999-00"), 1)) == "2000-01" and v(dates.year_of(F.lit("Apr 2, 1987"))) == 1987
    assert v(numeric.binned(F.lit(0.0), [0, 1], ["a"])) is None and v(numeric.binned(F.lit(1.0), [0, 1], ["a"])) == "a"
    assert v(arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0 and v(arrays.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0


def test_ranking_metric_goldens(spark):
    recs = spark.createDataFrame([("u", x, i + 1) for i, x in enumerate("abcde")], "user string, item string, rank int")
    truth = spark.createDataFrame([("u", "a"), ("u", "c"), ("u", "d"), ("u", "d")], "user string, item string")
    m = recommend.per_user_metrics(recs, truth, 5).first()
    assert m.recall == 1 and m.precision == 0.6 and m.average_precision == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert m.ndcg == pytest.approx((1 + 0.5 + 1 / math.log2(5)) / ideal)
    assert recommend.per_user_metrics(recs, truth.limit(0), 5).count() == 0


def test_lookup_join_refuses_doubled_keys(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError):
        relational.lookup_join(a, a.union(a), ["k"])
    assert relational.lookup_join(a, a, ["k"]).columns == ["k", "v", "v_right"]


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 7, "z")], "k string, rt int, v string")
    got = {(r.k, r.t): r.asof_v for r in relational.as_of_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_calibration_bins(spark):
    df = spark.createDataFrame([(i, i / 10.0, i % 2) for i in range(11)], "id int, p double, y int")
    got = {r.bin: r.n for r in aggregates.equal_count_bins(df, "p", "id", "y", 3).collect()}
    assert got == {1: 3, 2: 3, 3: 5}
    assert sum(r.n for r in aggregates.equal_width_bins(df, "p", "y").collect()) == 10


def test_elo_by_hand(spark):
    m = spark.createDataFrame([("L", 1, dt.date(2020, 1, 1), "a", "b", 2, 0), ("L", 2, dt.date(2020, 1, 2), "b", "a", 1, 1)], "league string, match_id int, day date, home string, away string, home_goals int, away_goals int")
    got = {r.match_id: (r.home_elo, r.away_elo) for r in sports.elo(m, "league").collect()}
    step = 20 * (math.log(3) + 1) * (1 - 1 / (1 + 10 ** (-60 / 400)))
    assert got[1] == (1500, 1500) and got[2] == pytest.approx((1500 - step, 1500 + step))


def test_best_squad_beats_brute_force():
    import itertools
    import random

    random.seed(5)
    players = [(random.random() * 10, random.randint(40, 90), pos, random.randint(1, 4), i) for i, pos in enumerate("AAAAABBBBBB")]
    quotas, budget = {"A": 2, "B": 2}, 240
    best = max((sum(p[0] for p in a + b) for a in itertools.combinations([p for p in players if p[2] == "A"], 2) for b in itertools.combinations([p for p in players if p[2] == "B"], 2) if sum(p[1] for p in a + b) <= budget and max([p[3] for p in a + b].count(c) for c in range(1, 5)) <= 1), default=None)
    got, proven = sports._best_squad(players, budget, quotas, 1)
    assert best is not None and proven and sum(p[0] for p in got) == pytest.approx(best)


def test_dominated_players_are_in_no_better_squad():
    import itertools
    import random

    random.seed(6)
    quotas, left = {"A": 1, "B": 2}, 0
    for _ in range(60):
        players = [(float(random.randint(1, 6)), random.randint(1, 6), pos, random.randint(1, 3), i) for i, pos in enumerate("AAAAAAAABBBBBBBBBB")]
        value = lambda pool: max((sum(p[0] for p in s) for a in (p for p in pool if p[2] == "A") for b in itertools.combinations([p for p in pool if p[2] == "B"], 2) for s in [(a, *b)] if sum(p[1] for p in s) <= 8 and max([p[3] for p in s].count(c) for c in range(1, 4)) <= 2), default=None)
        kept = sports.undominated(players, quotas, 2)
        assert value(kept) == value(players)
        left += len(players) - len(kept)
    assert left > 100


def test_greedy_squad_sees_every_player(spark):
    rows = [(1, i, i, "A", 50.0, 100.0 - i) for i in range(45)] + [(1, 100 + i, 100 + i, "A", 10.0, 50.0 - i) for i in range(20)] + [(1, 200 + i, 200 + i, "A", 1.0, 1.0) for i in range(12)]
    players = spark.createDataFrame(rows, "g int, player_id int, team_id int, position string, price double, points double")
    assert {r.player_id for r in sports.greedy_squad(players, ["g"], 20.0, {"A": 2}).collect()} == {100, 101}


def test_squads_of_every_week(spark):
    from skeinwork.plans import modelling

    sf = "/root/testdata/sf0.001"
    weeks = {tuple(r) for r in modelling._players(spark, sf).select("season", "gameweek").distinct().collect()}
    panel_weeks = {tuple(r) for r in spark.read.parquet(f"{sf}/fpl_merged.parquet").filter("xp is not null and team_id is not null and price is not null").select("season", "gameweek").distinct().collect()}
    assert weeks == panel_weeks | {("latest", 0)} and len({w for _, w in weeks}) > 1
    assert {(r.season, r.gameweek) for r in modelling.l30_greedy_squads(spark, sf).collect()} <= weeks


def test_scenarios_use_the_bench(spark):
    points = {"GKP": (5.0, 1.0), "DEF": (6.0, 5.0, 4.0, 3.0, 2.0), "MID": (9.0, 8.0, 7.0, 6.0, 5.0), "FWD": (4.0, 3.0, 1.0)}
    rows = [("s", week, i * 10 + k, pos, p + (week == 2) * (pos == "GKP" and k == 1) * 3.0, 1.0) for week in (1, 2) for i, (pos, all_) in enumerate(points.items()) for k, p in enumerate(all_)]
    squad = spark.createDataFrame(rows, "season string, gameweek int, player_id int, position string, points double, confidence double")
    got = {(r.scenario, r.gameweek): (r.eleven, r.bench, r.captain_bonus, r.points) for r in sports.scenarios(squad, ["season"], "gameweek").collect()}
    # 3-5-2: 5 + 15 + 35 + 7 play, 1 + 3 + 2 + 1 sit; without the best midfielder no other one is left.
    assert got["baseline", 1] == (62, 7, 9, 71) and got["absence", 1] == (53, 7, 8, 61)
    assert got["triple_captain", 1] == (62, 7, 18, 80) and got["bench_boost", 2] == (72, 0, 9, 81)
    assert got["congestion", 1] == pytest.approx((55.8, 6.3, 8.1, 63.9)) and len(got) == 10
    more = squad.withColumn("points", F.when(F.col("player_id") == 10, 20.0).otherwise(F.col("points")))
    got = {(r.scenario, r.gameweek): (r.eleven, r.bench, r.captain_bonus) for r in sports.scenarios(more, ["season"], "gameweek").collect()}
    assert got["baseline", 1] == (76, 7, 20) and got["absence", 1] == (59, 4, 9)


def test_greedy_squad_is_whole_or_none(spark):
    players = spark.createDataFrame([(1, i, i, "A", 5.0, 1.0) for i in range(3)] + [(2, 9, 9, "A", 5.0, 1.0)], "g int, player_id int, team_id int, position string, price double, points double")
    assert {r.g for r in sports.greedy_squad(players, ["g"], 20.0, {"A": 2}).collect()} == {1}


def test_exact_knn_in_small_blocks(spark):
    from skeinwork.operators import recommend

    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for metric in ("cosine", "euclid"):
        got = [sorted(map(tuple, recommend.exact_knn(df, "id", "v", 7, rows_, metric).collect())) for rows_ in (2048, 9)]
        assert got[0] == got[1] and len(got[0]) == 280
    assert recommend.exact_knn(df.limit(0), "id", "v", 3).count() == 0


def test_shapley_values_add_up(spark):
    from skeinwork.operators import learning

    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None), (3, 5.0, 4.0)], "id int, a double, b double")
    got = {r.id: r.shap_a + r.shap_b for r in learning.linear_shapley(df, {"a": 2.0, "b": -1.0}).collect()}
    assert got == pytest.approx({1: -4 + 1, 2: 0, 3: 4 - 1})


def test_paged_source_retries(spark):
    import urllib.error

    from skeinwork.sources import http

    waits = []
    server, url = http.stub(["one"], fail_first=3)
    assert http.fetch(f"{url}?page=1", 3, 0.5, 1.8, sleep=waits.append) == "one" and waits == pytest.approx([0.5, 0.9, 1.62])
    with pytest.raises(urllib.error.HTTPError):
        http.fetch(f"{url}?page=2", 3, sleep=waits.append)
    assert len(waits) == 3  # an unknown page is not asked for again
    server.shutdown()


def test_every_season_is_simulated(spark):
    from skeinwork.plans import modelling

    sf = "/root/testdata/sf0.001"
    whole = modelling._all_seasons(spark, sf, 120)
    seasons = {r[0] for r in modelling.matches(spark, sf).select(F.year("day")).distinct().collect()}
    assert {r[0] for r in whole.select("season").distinct().collect()} == seasons and len(seasons) > 1
    assert whole.agg(F.countDistinct("run"), F.min("run"), F.max("run")).first() == (120, 1, 120)
    few = sorted(map(tuple, whole.filter("season = 2000 and run <= 20").select("run", "team", "points").collect()))
    assert few == sorted(map(tuple, modelling.l33_simulated_seasons(spark, sf).collect())) and modelling.RUNS == 10_000


def test_runs_of_a_season_are_spread_evenly(spark):
    f = spark.createDataFrame([(m, m % 5, 5 + m % 3, 0.4, 0.3) for m in range(30)], "match_id int, home int, away int, p_home double, p_draw double")
    whole = sports.simulate_season(f, 60, task_runs=10)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sports.simulate_season(f, 60).collect()))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [__from" in plan and "ASC" in plan and "explode([true,false])" in plan


ODD_FIXTURES = [("a", 1, "x", "y", 0.4, 0.3), ("a", 2, "y", "z", 0.2, 0.1), ("a", 3, "x", "z", None, 0.5), ("a", 4, "z", None, 0.1, None), ("a", None, "é" * 40, "x", 0.5, 0.2), ("a", 5, "z", "y", float("nan"), 0.1), ("a", 6, "y", "x", 0.3, float("nan")), ("a", -7, "x", "x", 0.3, 0.3), (None, 8, "x", "y", 0.0, 1.0), (None, 9, "w", "x", 1.0, 0.0), ("b", 10**15, "q", "r", 0.5, 0.5)]
ODD_KINDS = "season string, match_id long, home string, away string, p_home double, p_draw double"


@pytest.mark.parametrize("by", [["season"], []])
@pytest.mark.parametrize("rows", [ODD_FIXTURES, []])
def test_runs_of_a_season_in_one_task(spark, by, rows):
    f = spark.createDataFrame(rows, ODD_KINDS)
    same = lambda a, b: a.dtypes == b.dtypes and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    slow = sports.simulate_season(f, 23, by)
    assert same(seasonruns.simulate_seasons(f, 23, by, block=7, at_once=3), slow)
    assert same(seasonruns.seasons_summary(f, 23, 2, by, block=7), sports.simulation_summary(slow, 2, by))
    named = f.withColumn("match_id", F.concat(F.lit("ü"), F.repeat(F.col("match_id").cast("string"), 20)))
    assert same(seasonruns.simulate_seasons(named, 12, by), sports.simulate_season(named, 12, by))


def test_places_of_many_teams(spark):
    f = spark.range(600).selectExpr("id AS match_id", "id % 300 AS home", "(id * 7 + 1) % 301 AS away", "0.4D AS p_home", "0.3D AS p_draw")
    assert sorted(map(tuple, seasonruns.seasons_summary(f, 11, block=4).collect())) == sorted(map(tuple, sports.simulation_summary(sports.simulate_season(f, 11)).collect()))


def test_all_seasons_shuffle_no_draws(spark):
    from skeinwork.plans import modelling

    plan = modelling.l33_all_seasons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "run#" in line] and "sha2(" not in plan


def test_summary_of_all_seasons_ranks_where_it_draws(spark):
    from skeinwork.plans import modelling

    plan = modelling.l34_all_seasons_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "sha2(" not in plan


def test_quality_gates(spark):
    df = spark.createDataFrame([(1, 0.5, None), (1, float("nan"), "a")], "id int, p double, s string")
    got = {r.check: r.status for r in quality.run_checks(df, [quality.unique("id"), quality.finite("p"), quality.completeness("s", 0.5), quality.null_rate("s")]).collect()}
    assert got == {"unique:id": "FAILED", "finite:p": "FAILED", "complete:s": "PASSED", "nulls:s": "WARNING"}
    a, b = quality.fingerprint(df), quality.fingerprint(df.orderBy(F.desc("s")).repartition(5))
    assert a.first() == b.first() != quality.fingerprint(df.limit(1)).first()
    assert isinstance(a.first(), Row)


def test_factor_scores_in_blocks(spark):
    users = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "user int, u array<float>")
    items = spark.createDataFrame([(i, [float(i % 7), float(-i)]) for i in range(40)], "item int, v array<float>")
    whole = sorted(map(tuple, recommend.factor_scores(users, items, 5).collect()))
    assert whole == sorted(map(tuple, recommend.factor_scores(users, items, 5, block_rows=6).collect())) and len(whole) == 25


def test_best_products_are_those_of_a_whole_sort():
    import numpy as np

    rng = np.random.default_rng(5)
    x, y, names = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (60, 3)) + rng.integers(0, 2, (60, 3)) * 1e-11, rng.permutation(60)
    for k in (1, 7, 60, 90):
        s = np.round(x @ y.T, 9)
        row, name, score = recommend.best_products(x, y, names, k)
        assert list(zip(row, name, score, strict=True)) == [(i, names[j], s[i, j]) for i in range(40) for j in sorted(range(60), key=lambda j: (-s[i, j], names[j]))[:k]]


def test_re_ranking_ships_no_vectors(spark):
    from skeinwork.plans import recsys

    sf = "/root/testdata/sf0.001"
    got = recsys.l09_mmr(spark, sf)
    assert "embedding" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, recsys._mmr_joined(spark, sf).collect()))


def test_re_ranking_from_the_file(spark):
    from skeinwork.session import shared_file

    # Items 0 to 5; 3 has no vector, 4 neither votes nor neighbours, 1 and 2 are alike.
    vectors = {0: [1.0, 0.0], 1: [0.0, 2.0], 2: [0.0, 2.0], 3: None, 4: [-1.0, 0.5], 5: [0.6, 0.8]}
    popular = {0: 0.9, 1: 0.7, 2: 0.7, 3: 1.0, 4: None, 5: 0.0}
    near = {0: ([1, 2, 3, 4], [0.5, 0.5, 0.9, 0.4]), 1: ([0, 5, 2], [0.8, 0.3, 0.6])}
    rows = [(i, *near.get(i, (None, None)), popular[i], [0.01 * i], vectors[i]) for i in range(6)]
    items = spark.createDataFrame(rows, "code int, near array<int>, score array<double>, popular double, boosts array<double>, x array<float>")
    path, record = shared_file(spark, "test"), recommend.item_record(4, 1, 2, True)
    assert recommend.write_items(items.repartition(3), path, record) == 6
    users = spark.createDataFrame([("a", 0.4, [0, 1]), ("b", 0.8, [4]), ("c", 0.8, [0])], "user string, alpha double, seeds array<int>")
    made = {}
    for user, alpha, seeds in users.collect():
        for s in seeds:
            for item, content in zip(*near.get(s, ((), ())), strict=True):
                made[user, item] = max(made.get((user, item), (0, 0))[0], content), alpha
    blend = lambda item, content, a: round((content if popular[item] is None else a * content + (1 - a) * popular[item]) + 0.01 * item, 9)
    for pool in (500, 2):
        best = {u: sorted(((-blend(i, *made[v, i]), i) for v, i in made if v == u))[:pool] for u in "abc"}
        joined = spark.createDataFrame([(u, i, -s, vectors[i]) for u in best for s, i in best[u] if vectors[i]], "user string, item int, score double, x array<float>")
        want = sorted(map(tuple, recommend.mmr(joined, "user", "item", "score", "x", 3, pool=pool).collect()))
        assert sorted(map(tuple, recommend.mmr_of_seeds(users, path, record, 3, pool=pool).collect())) == want and {u for u, *_ in want} == {"a", "c"}
    assert recommend.write_items(items.limit(0), path := shared_file(spark, "test"), record) == 0
    assert recommend.mmr_of_seeds(users.limit(0), path, record, 3).count() == 0


def test_nine_digits_and_ordered_codes(spark):
    import numpy as np

    x = [0.1234567885, 0.1234567895, -0.1234567885, 1.0000000005, 0.3, 2.5e-10, 5e-10, 0.0, 123456.7890123455, 4.5e7 + 0.1234567, 1e20, float("inf"), float("-inf"), *np.random.default_rng(3).random(300), *(np.random.default_rng(4).integers(0, 10**7, 300) / 1e7 * 0.2)]
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 9)).collect()]
    assert recommend.nine_digits(np.array(x)).tolist() == want
    words = [f"{a}{b}" for a in "zäbA𝄞" for b in range(9)]
    codes = recommend.ordered_codes(spark.createDataFrame([(w,) for w in [*words, *words, None]], "item string"), "item", 4)
    assert sorted(map(tuple, codes.collect()), key=lambda r: r[1]) == [(w, i) for i, w in enumerate(sorted(words))]


def test_npy_source(spark, tmp_path):
    import numpy as np

    from skeinwork.sources.files import NpySource

    data = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "a.npy", data)
    spark.dataSource.register(NpySource)
    got = spark.read.format("npy").option("rows", 4).load(str(tmp_path / "a.npy")).orderBy("row").collect()
    assert [r.vector for r in got] == data.tolist()


def test_sniffing_and_synonyms(spark, tmp_path):
    from skeinwork.sources import files

    (tmp_path / "x.csv").write_text("a;b;c,d\n1;2;3\n")
    assert files.sniffed_separator(spark, str(tmp_path / "x.csv")) == ";"
    df = spark.createDataFrame([(1, 2)], "HomeTeam int, fthg int")
    assert relational.standard_names(df, {"home": ["hometeam"], "home_goals": ["FTHG", "hg"]}).columns == ["home", "home_goals"]


def test_stream_equals_batch(spark):
    from skeinwork.operators import telemetry
    from skeinwork.streaming import telemetry as st

    sf = "/root/testdata/sf0.001"
    stream = st.run_to_end(st.session_stream(st.read_events(spark, sf), late="60 days"), "sessions", "complete")
    batch = telemetry.sessions(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
    assert [st.next_state(s, True) for s in ("healthy", "watching", "degraded", "recovering")] == ["watching", "degraded", "rolling_back", "degraded"]


def test_sketches_are_apart_from_exact_distinct_counts(spark):
    from skeinwork.plans import aggregation

    plan = aggregation.a05_approximate_distinct(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("approx_count_distinct") >= 4 and "Expand" not in plan
