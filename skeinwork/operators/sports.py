"""Ratings, form, season simulation and squad choice."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions.strings import bucket_of


def team_log(matches: DataFrame, keys: Sequence[str] = ("match_id", "day")) -> DataFrame:
    """Two rows a match: team, is_home, scored, conceded, points."""
    home = matches.select(*keys, F.col("home").alias("team"), F.lit(True).alias("is_home"), F.col("home_goals").alias("scored"), F.col("away_goals").alias("conceded"))
    away = matches.select(*keys, F.col("away").alias("team"), F.lit(False).alias("is_home"), F.col("away_goals").alias("scored"), F.col("home_goals").alias("conceded"))
    points = F.when(F.col("scored") > F.col("conceded"), 3).when(F.col("scored") == F.col("conceded"), 1).otherwise(0)
    return home.unionByName(away).withColumn("points", points)


def form(log: DataFrame, order: Sequence[str] = ("day", "match_id"), short: int = 5, long: int = 10) -> DataFrame:
    """Means over the matches before each one; 0 where there is none. The match itself never counts."""
    w = Window.partitionBy("team").orderBy(*order)
    back = lambda n: w.rowsBetween(-n, -1)
    mean = lambda c, n: F.round(F.coalesce(F.avg(c).over(back(n)), F.lit(0.0)), 3)
    return log.withColumns({"ppg": mean("points", short), "goal_difference": mean(F.col("scored") - F.col("conceded"), short), "goals_for": mean("scored", long), "goals_against": mean("conceded", long), "recent_points": F.coalesce(F.sum("points").over(back(short)), F.lit(0)), "match_no": F.row_number().over(w)})


def elo(matches: DataFrame, league: str, k: float = 20.0, home_edge: float = 60.0, goals_matter: bool = True, start: float = 1500.0) -> DataFrame:
    """(league, match_id, home_elo, away_elo) before each match, by day and match_id.

    Each result depends on all before it in the league, so a league is one sequential group: the parallelism is across
    leagues, and a league's matches (tens of thousands in a century) are what one task holds.
    """
    import math

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rating: dict = {}
        rows = []
        for m in pdf.sort_values(["day", "match_id"], kind="stable").itertuples(index=False):
            a, b = rating.get(m.home, start), rating.get(m.away, start)
            rows.append((getattr(m, league), m.match_id, a, b))
            expected = 1 / (1 + 10 ** ((b - a - home_edge) / 400))
            gap = m.home_goals - m.away_goals
            result = 1.0 if gap > 0 else 0.5 if gap == 0 else 0.0
            step = k * (math.log(abs(gap) + 1) + 1 if goals_matter else 1.0) * (result - expected)
            rating[m.home], rating[m.away] = a + step, b - step
        return pd.DataFrame(rows, columns=[league, "match_id", "home_elo", "away_elo"])

    kind = dict(matches.dtypes)
    return matches.groupBy(league).applyInPandas(run, f"{league} {kind[league]}, match_id {kind['match_id']}, home_elo double, away_elo double")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) drawn from the keys by SHA-256, the same on every run and system."""
    return bucket_of(F.concat_ws(":", *[k.cast("string") for k in keys]), 1_000_000) / 1e6


def simulate_season(fixtures: DataFrame, runs: int, by: Sequence[str] = (), task_runs: int = 100) -> DataFrame:
    """(by, run, team, points) over all runs: each fixture is drawn from (p_home, p_draw) by its hash.

    Fixtures times runs is the work asked for; points are summed before the shuffle. Many runs are spread over tasks, each
    with about `task_runs` of them, so that a task's sums fit its memory.
    """
    if runs > task_runs:
        r = fixtures.withColumn("__from", F.explode(F.sequence(F.lit(1), F.lit(runs), F.lit(task_runs)))).repartitionByRange(-(-runs // task_runs), "__from")
        # A team's sums are near each other in time, and so in the processor's cache.
        r = r.sortWithinPartitions(*by, "home")
        r = r.withColumn("run", F.explode(F.sequence("__from", F.least(F.col("__from") + (task_runs - 1), F.lit(runs))))).drop("__from")
    else:
        r = fixtures.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    r = r.withColumn("u", uniform(F.col("run"), F.col("match_id")))
    won, drawn = F.col("u") < F.col("p_home"), F.col("u") < F.col("p_home") + F.col("p_draw")
    home, away = F.when(won, 3).when(drawn, 1).otherwise(0), F.when(won, 0).when(drawn, 1).otherwise(3)
    sides = r.select(*by, "run", "home", "away", home.alias("h"), away.alias("a")).withColumn("at_home", F.explode(F.array(F.lit(True), F.lit(False))))
    both = sides.select(*by, "run", F.when(F.col("at_home"), F.col("home")).otherwise(F.col("away")).alias("team"), F.when(F.col("at_home"), F.col("h")).otherwise(F.col("a")).alias("p"))
    return both.groupBy(*by, "run", "team").agg(F.sum("p").alias("points"))


def simulation_summary(table: DataFrame, top: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """(by, team, expected_points, p_title, p_top, usual_place); equal points are placed by team."""
    place = F.row_number().over(Window.partitionBy(*by, "run").orderBy(F.desc("points"), "team"))
    t = table.withColumn("place", place)
    runs = F.count("*")
    return t.groupBy(*by, "team").agg(F.avg("points").alias("expected_points"), (F.count_if(F.col("place") == 1) / runs).alias("p_title"), (F.count_if(F.col("place") <= top) / runs).alias("p_top"), F.mode("place", True).alias("usual_place"))


QUOTAS = {"GKP": 2, "DEF": 5, "MID": 5, "FWD": 3}
FORMATIONS = ((3, 4, 3), (3, 5, 2), (4, 3, 3), (4, 4, 2), (4, 5, 1), (5, 2, 3), (5, 3, 2), (5, 4, 1))


def undominated(players: list[tuple], quotas: dict[str, int], per_club: int) -> list[tuple]:
    """Players without those who are in no squad that cannot be bettered or equalled without them.

    A player is left out if enough players of the position have as many points for no more money: however many of them the
    squad holds and whatever clubs it has filled, one remains to take the player's place.
    """
    squad = sum(quotas.values())
    kept = []
    for pos, n in quotas.items():
        better: list[tuple] = []
        for p in sorted((p for p in players if p[2] == pos), key=lambda p: (-p[0], p[1], str(p[4]))):
            over = [q for q in better if q[1] <= p[1]]
            clubs: dict = {}
            for q in over:
                clubs[q[3]] = clubs.get(q[3], 0) + 1
            # The other players fill at most so many clubs, the player's own has a place once the player goes.
            full = sorted((c for club, c in clubs.items() if club != p[3]), reverse=True)[: (squad - 1) // per_club]
            if len(over) - sum(full) < n:
                kept.append(p)
            better.append(p)
    return kept


def _best_squad(players: list[tuple], budget: int, quotas: dict[str, int], per_club: int, most_nodes: int = 2_000_000) -> tuple[list[tuple], bool]:
    """The best squad by branch and bound, and whether that is proven: after `most_nodes` steps it is the best found so far.

    Price multipliers give an upper bound; depth first over the best ratio first. players: (points, price in tenths,
    position, club, id).
    """
    order = {pos: [p for p in undominated(players, quotas, per_club) if p[2] == pos] for pos in quotas}
    if any(len(order[pos]) < n for pos, n in quotas.items()):
        return [], True
    best: tuple[float, list[tuple]] = (-1.0, [])

    def relaxed(multiplier: float) -> float:
        return multiplier * budget + sum(sum(sorted((p[0] - multiplier * p[1] for p in order[pos]), reverse=True)[:n]) for pos, n in quotas.items())

    low, high = 0.0, 2.0
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if relaxed(a) <= relaxed(b) else (a, high)
    multiplier = (low + high) / 2
    flat = [(sorted(order[pos], key=lambda p: (-(p[0] - multiplier * p[1]), str(p[4]))), n) for pos, n in quotas.items()]
    worth = [[p[0] - multiplier * p[1] for p in ranked] for ranked, _ in flat]
    sums = [[0.0, *accumulate(w)] for w in worth]
    tails = [sum(sums[i][n] for i, (_, n) in enumerate(flat) if i >= depth) for depth in range(len(flat) + 1)]
    nodes = 0

    def walk(depth: int, at: int, left: int, money: int, clubs: dict, value: float, chosen: list[tuple]) -> None:
        nonlocal best, nodes
        nodes += 1
        if nodes > most_nodes:
            return
        if left == 0:
            if depth + 1 == len(flat):
                if value > best[0] + 1e-9:
                    best = (value, list(chosen))
                return
            walk(depth + 1, 0, flat[depth + 1][1], money, clubs, value, chosen)
            return
        ranked = flat[depth][0]
        if len(ranked) - at < left:
            return
        if value + sums[depth][at + left] - sums[depth][at] + tails[depth + 1] + multiplier * money <= best[0] + 1e-9:
            return
        p = ranked[at]
        if p[1] <= money and clubs.get(p[3], 0) < per_club:
            clubs[p[3]] = clubs.get(p[3], 0) + 1
            chosen.append(p)
            walk(depth, at + 1, left - 1, money - p[1], clubs, value + p[0], chosen)
            chosen.pop()
            clubs[p[3]] -= 1
        walk(depth, at + 1, left, money, clubs, value, chosen)

    walk(0, 0, flat[0][1], budget, {}, 0.0, [])
    return best[1], nodes <= most_nodes


def squads(players: DataFrame, by: Sequence[str], budget: float = 100.0, per_club: int = 3, quotas: dict[str, int] | None = None) -> DataFrame:
    """(by, player_id, position, points, price, team_id, proven) of the squad of most points of each group within budget,
    quotas and clubs; none for a group that cannot fill one. All players of a group are considered, only those who are
    dominated are left out. `proven`: the search ended, so no squad is better.

    players: by, player_id, team_id, position, price, points. Groups are solved apart.
    """
    quotas = quotas or QUOTAS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(float(r.points), int(round(r.price * 10)), r.position, r.team_id, r.player_id) for r in pdf.itertuples()]
        found, proven = _best_squad(rows, int(round(budget * 10)), quotas, per_club)
        chosen = {p[4] for p in found}
        return pdf[pdf["player_id"].isin(chosen)][[*by, "player_id", "position", "points", "price", "team_id"]].assign(proven=proven)

    kinds = dict(players.dtypes)
    return players.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*by, "player_id", "position", "points", "price", "team_id"]) + ", proven boolean")


def best_eleven(squad: DataFrame, by: Sequence[str]) -> DataFrame:
    """The eleven of most points over all formations: place in the position by points, then the best formation's counts."""
    w = Window.partitionBy(*by, "position").orderBy(F.desc("points"), "player_id")
    s = squad.withColumn("__r", F.row_number().over(w))
    sums = [F.sum(F.when(((F.col("position") == "GKP") & (F.col("__r") <= 1)) | ((F.col("position") == "DEF") & (F.col("__r") <= a)) | ((F.col("position") == "MID") & (F.col("__r") <= b)) | ((F.col("position") == "FWD") & (F.col("__r") <= c)), F.col("points")).otherwise(0.0)) for a, b, c in FORMATIONS]
    best = s.groupBy(*by).agg(*[x.alias(f"__f{i}") for i, x in enumerate(sums)])
    pick = F.array_max(F.array(*[F.struct(F.col(f"__f{i}").alias("v"), F.lit(-i).alias("i"), F.lit(a).alias("d"), F.lit(b).alias("m"), F.lit(c).alias("f")) for i, (a, b, c) in enumerate(FORMATIONS)]))
    best = best.select(*by, pick.alias("__p"))
    j = s.join(best, list(by))
    limit = F.when(F.col("position") == "GKP", 1).when(F.col("position") == "DEF", F.col("__p.d")).when(F.col("position") == "MID", F.col("__p.m")).otherwise(F.col("__p.f"))
    return j.filter(F.col("__r") <= limit).withColumn("formation", F.concat_ws("-", "__p.d", "__p.m", "__p.f")).drop("__r", "__p")


def captains(eleven: DataFrame, by: Sequence[str], confidence: str = "confidence") -> DataFrame:
    """Adds `role`: captain and vice by points weighted with half their confidence."""
    risk = F.col("points") * (0.5 + 0.5 * F.col(confidence))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(risk), "player_id"))
    return eleven.withColumn("risk", risk).withColumn("role", F.when(rank == 1, "captain").when(rank == 2, "vice").otherwise("player"))


def greedy_squad(players: DataFrame, by: Sequence[str], budget: float, quotas: dict[str, int], per_club: int = 3) -> DataFrame:
    """Players by points for money, each taken if quota, club and budget (keeping the cheapest rest affordable) allow; every player of a group is seen. A group that cannot fill a squad gets none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["points", "price", "player_id"], ascending=[False, True, True], kind="stable")
        ahead = {p: sorted(pdf.loc[pdf["position"] == p, "price"]) for p in quotas}
        need, clubs, money, chosen = dict(quotas), {}, budget, []
        for r in pdf.itertuples():
            if r.position not in need:
                continue
            ahead[r.position].remove(r.price)
            if need[r.position] and clubs.get(r.team_id, 0) < per_club:
                rest = {p: n - (p == r.position) for p, n in need.items()}
                if r.price + sum(sum(ahead[p][:n]) for p, n in rest.items()) <= money + 1e-9:
                    need, money = rest, money - r.price
                    clubs[r.team_id] = clubs.get(r.team_id, 0) + 1
                    chosen.append(r.Index)
        return pdf.loc[[] if any(need.values()) else chosen, [*by, "player_id", "position", "points", "price", "team_id"]]

    kinds = dict(players.dtypes)
    return players.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*by, "player_id", "position", "points", "price", "team_id"]))


def scenarios(squad: DataFrame, by: Sequence[str], week: str) -> DataFrame:
    """(by, week, scenario, eleven, bench, captain_bonus, points) of whole squads, one a week.

    baseline: as it is. absence: the best of the eleven is replaced by the best of the bench in the same position, if any;
    the vice leads if it was the captain. low_minutes: the three best have half their points, and congestion: all lose a
    tenth, before the eleven is chosen. triple_captain and bench_boost: one row a `by`, in the week in which the captain
    (the bench) is worth most, the earliest of equals. points: the eleven with the captain's bonus; with the bench if boosted.

    squad: by, week, player_id, position, points, confidence.
    """
    keys = [*by, week]
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("points"), "player_id"))
    s = squad.select(*keys, "player_id", "position", "points", "confidence").withColumn("__b", best)
    changed = (("baseline", F.col("points")), ("low_minutes", F.when(F.col("__b") <= 3, F.col("points") * 0.5).otherwise(F.col("points"))), ("congestion", F.col("points") * 0.9))
    s = s.withColumn("__x", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), p.alias("points")) for n, p in changed]))).drop("points", "__b").select("*", "__x.*").drop("__x")
    each = [*keys, "scenario"]
    roles = captains(best_eleven(s, each), each).select(*each, "player_id", "role")
    s = s.join(roles, [*each, "player_id"], "left")
    starts, zero = F.col("role").isNotNull(), F.lit(0.0)
    place = F.row_number().over(Window.partitionBy(*each, starts).orderBy(F.desc("points"), "player_id"))
    s = s.withColumn("__first", starts & (place == 1))
    s = s.withColumn("__gone", F.max(F.when(F.col("__first"), F.col("position"))).over(Window.partitionBy(*each)))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("points"))), zero)
    totals = s.groupBy(*each).agg(
        of(starts).alias("eleven"), of(~starts).alias("bench"), of(F.col("role") == "captain").alias("captain_bonus"), of(F.col("__first")).alias("__lost"),
        F.coalesce(F.max(F.when(~starts & (F.col("position") == F.col("__gone")), F.col("points"))), zero).alias("__in"),
        F.max(F.coalesce(F.col("__first") & (F.col("role") == "captain"), F.lit(False))).alias("__led"), of(F.col("role") == "vice").alias("__vice"),
    )
    columns = [*each, "eleven", "bench", "captain_bonus"]
    base = totals.filter("scenario = 'baseline'")
    absent = base.select(*keys, F.lit("absence").alias("scenario"), (F.col("eleven") - F.col("__lost") + F.col("__in")).alias("eleven"), (F.col("bench") - F.col("__in")).alias("bench"), F.when(F.col("__led"), F.col("__vice")).otherwise(F.col("captain_bonus")).alias("captain_bonus"))

    def in_best_week(name: str, value: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), week))
        return base.withColumn("__w", rank).filter("__w = 1").withColumn("scenario", F.lit(name)).select(*columns)

    tripled = in_best_week("triple_captain", "captain_bonus").withColumn("captain_bonus", F.col("captain_bonus") * 2)
    boosted = in_best_week("bench_boost", "bench").withColumn("eleven", F.col("eleven") + F.col("bench")).withColumn("bench", zero)
    out = totals.select(*columns).unionByName(absent).unionByName(tripled).unionByName(boosted)
    return out.withColumn("points", F.col("eleven") + F.col("captain_bonus"))


def bench_order(squad: DataFrame, by: Sequence[str], points: str, ties: Sequence[str], last: str = "GKP") -> DataFrame:
    """Adds `place`, 1 to n: by points descending, then `ties`, with the keepers after everyone else."""
    order = [F.coalesce(F.col("position") == last, F.lit(False)).asc(), F.desc_nulls_last(points), *[F.asc_nulls_last(c) for c in ties]]
    return squad.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
