import pytest
from pyspark.sql import functions as F

from evkit.plans import reports as R
from evkit.plans import season as P
from evkit.sources import schemas as S
from tests.conftest import ATTEMPTS, PLAYERS, canonical_schema, rows_of, shot_rows, table


@pytest.fixture(scope="module")
def master(season):
    return P.build_master(season).cache()


def test_team_names(season):
    got = P.clean_shots(season.shots).select("team_name", "team").distinct()
    assert dict(rows_of(got.filter("team_name IS NOT NULL"))) == {
        "Brooklyn Nets": "Brooklyn", "Boston Celtics": "Boston", "Los Angeles Lakers": "LA Lakers",
        "Los Angeles Clippers": "LA Clippers", "Portland Trail Blazers": "Portland", "Solo": "Solo"}


def test_one_row_per_shot(master):
    assert master.count() == len(ATTEMPTS)
    assert len(set(master.columns)) == len(master.columns)


def test_defending_team(master):
    got = rows_of(master.filter("game_id = 1").select("team_abbrv", "team_def", "deff").distinct())
    assert got == [("BOS", "BRO", 112.9), ("BRO", "BOS", 107.0)]
    away = master.filter("game_id = 2 AND team_abbrv = 'LAL'").select("team_def", "oppg").distinct()
    assert rows_of(away) == [("BRO", 112.0)]


def test_parity_leaves_the_home_code(season):
    got = P.build_master(season, mode="parity").filter("game_id = 1")
    assert rows_of(got.select("home_team", "away_team").distinct()) == [("BKN", "BOS")]
    boston = got.filter("team_abbrv = 'BOS'").select("team_def", "deff").distinct()
    assert rows_of(boston) == [("BKN", None)]


def test_label_and_unknown_rows(master):
    assert rows_of(master.filter("shot_made IS NULL"), "shot_cat") == [(0,)]
    solo = master.filter("team_name = 'Solo'").first()
    assert solo.team_abbrv is None and solo.full_name is None and solo.team_def == "POR"


def test_unmatched_codes(season):
    plain = dict(rows_of(P.unmatched_teams(season, codes={})))
    assert plain == {"BKN": 10}
    assert P.unmatched_teams(season).count() == 0


def test_players(season):
    rows = P.clean_players(season.players).collect()
    got = {(r.full_name, r.team): (r.qualified, r.ppg_norm) for r in rows}
    assert ("Ed Edge", "LAL") not in got  # a null in the row
    assert got[("Bea Bolt", "BOS")] == ("Yes", 0.5)
    assert got[("Cy Cole", "BOS")][0] == "No"
    assert got[("Flo Fox", "POR")] == ("Yes", None)


def test_features_count_everyone_and_keep_the_qualified(master):
    got = P.build_features(master)
    assert {r.full_name for r in got.select("full_name").collect()} == {
        "Ann Ace", "Bea Bolt", "Di Dunk", "Flo Fox"}
    ann = rows_of(got.filter("game_id = 1 AND player_id = 10"), "seq", "taken_before", "made_before",
                  "prev_outcome")
    assert ann == [(1, 0, 0, None), (3, 1, 1, 1)]
    # The shot of the unqualified player still takes a place in the game.
    assert got.filter("game_id = 1").agg(F.max("seq")).first()[0] == 4


def test_features_parity_on_one_clock(season):
    got = P.build_features(P.build_master(season, mode="parity"), "parity").filter("game_id = 2")
    tied = rows_of(got.filter("player_id = 10"), "seq", "taken_before")
    assert tied == [(1, 0), (2, 1)]  # two attempts share the clock, so no reset


def many_games(spark, season, games=60):
    """The fixture shots over many games, so that models have something to learn."""
    shots = season.shots.crossJoin(spark.range(games).withColumnRenamed("id", "copy"))
    shots = shots.withColumns({
        "game_id": F.col("game_id") + F.col("copy") * 10,
        "shot_made": (F.pmod(F.xxhash64("copy", "player_id", "secs_left"), F.lit(10))
                      < F.when(F.col("basic_zone") == "Restricted Area", 7).otherwise(4)),
    })
    event = F.when(F.col("shot_made"), "Made Shot").otherwise("Missed Shot")
    shots = shots.withColumn("event_type", event)
    return season._replace(shots=shots.drop("copy"))


@pytest.fixture(scope="module")
def job(spark, season):
    big = many_games(spark, season)
    return big, P.run_season(big, cutoff=400)


def test_season_job(job):
    _, out = job
    scored, report = out["scored"], out["team_report"]
    assert scored.columns == [new for _, new, _ in S.SCORED]
    assert scored.agg(F.min("game_id")).first()[0] > 400
    assert scored.filter("xp <> shot_pt * prob_made OR pts <> shot_pt * shot_cat").count() == 0
    assert scored.filter("prob_made < 0 OR prob_made > 1").count() == 0
    games = scored.select("game_id", "team_abbrv").distinct().count()
    assert report.agg(F.sum(F.col("outperform") + F.col("underperform"))).first()[0] == games
    row = report.first()
    assert row.outperform_text == f"{row.outperform_pct}%"
    best = [r.outperform_pct for r in out["top_outperform"].collect()]
    assert best == sorted(best, reverse=True)
    metrics = out["metrics"].first()
    assert metrics.tp + metrics.fp + metrics.tn + metrics.fn == scored.count()


def test_exploratory_tables(job):
    big, out = job
    tables = R.exploratory(out["features"], big)
    assert tuple(tables["player_counts"].first()) == (7, 5)
    assert tables["event_type"].agg(F.sum("count")).first()[0] == out["features"].count()
    assert [r.team for r in tables["oppg_best"].collect()][0] == "Boston"
    assert [r.full_name for r in tables["efg_pct_best"].collect()][0] == "Di Dunk"
    assert tables["correlations"].count() == len(R.CORRELATED)
    n = len(R.NOMINAL) + len(R.NUMERIC)
    assert tables["associations"].count() == n * (n - 1) // 2
    for name, df in tables.items():
        assert df.columns, name
    tables["strong_associations"].collect()


def test_dashboard_tables(job):
    big, out = job
    scored = P.add_conference(out["scored"], big.teams)
    assert rows_of(scored.filter("team_abbrv = 'POR'").select("conf", "division").distinct()) == [
        ("West", "Northwest")]
    options = R.filter_options(scored)
    assert [r[0] for r in options["conf"].collect()] == ["East", "West"]
    east = R.performance(scored, {"conf": ["East"]}, min_games=3)
    assert {r.team_abbrv for r in east["teams"].collect()} <= {"BRO", "BOS"}
    everyone = R.performance(scored, min_games=3)
    assert everyone["players"].filter("total < 3").count() == 0
    assert everyone["team_best"].filter("rank = 1").count() == 4
    top = everyone["team_top_delta"].first()
    assert top.avg_delta == everyone["teams"].agg(F.max("avg_delta")).first()[0]
    assert everyone["player_kpis"].first().in_view == everyone["players"].count()
    nobody = R.performance(scored, min_games=10_000)
    assert nobody["players"].count() == 0 and nobody["player_top_delta"].count() == 0

    stats = R.player_stats(big, everyone["players"])
    profiles = {r.full_name: r for r in stats["profiles"].collect()}
    assert profiles["Ann Ace"].attempts == 60 * 4 and profiles["Ann Ace"].has_profile
    assert not profiles["Gus Gray"].has_profile  # not qualified with the team of these shots
    assert stats["against_average"].count() == 5
    assert stats["efg_pct_best"].first()[1] == 63.0


def test_shooting_tables(season):
    tables = R.shooting(season.shots)
    k = tables["kpis"].first()
    assert (k.total, k.made, k.missed, k.rate) == (14, 8, 6, 57.1)
    assert tables["basic_zone"].filter("value IS NULL").count() == 0
    assert "quarter" not in R.shooting(season.shots.drop("quarter"))


def test_team_tables(season):
    tables = R.team_stats(season)
    tails = tables["oppg_tails"].collect()
    assert [r.team for r in tails][0] == "LA Lakers"
    assert tables["volume_tails"].count() == 6
    assert [r.team for r in tables["deff_best"].collect()][0] == "Boston"


def test_situation_model(spark, season):
    big = many_games(spark, season, 200)
    shots = big.shots.withColumn("row_id", F.xxhash64(*big.shots.columns))
    fitted = P.fit_situation_model(shots, big.players, "row_id", rounds=5, min_rows=20)
    assert 0.5 < fitted.auc.first().auc <= 1.0
    scenarios = table(
        spark,
        "basic_zone string, zone_range string, zone_name string, action_type string, quarter int, "
        "player_2p_pct double, player_3p_pct double",
        [("Restricted Area", "8-16 ft.", "Center", "Dunk", 1, 0.5, 0.3),
         ("Above the Break 3", "24+ ft.", "Left Side", "Jump Shot", 1, 0.5, 0.3)])
    got = {r.basic_zone: r for r in P.score_situations(fitted, scenarios).collect()}
    assert got["Restricted Area"].shot_pt == 2 and got["Above the Break 3"].shot_pt == 3
    base = fitted.base_rate.first().base_rate
    for r in got.values():
        assert r.xp == pytest.approx(r.prob * r.shot_pt) and r.lift == pytest.approx(r.prob / base)


def test_kept_situation_model_scores_without_a_fit(spark, season, tmp_path):
    big = many_games(spark, season, 50)
    shots = big.shots.withColumn("row_id", F.xxhash64(*big.shots.columns))
    fitted = P.fit_situation_model(shots, big.players, "row_id", rounds=3, min_rows=10)
    P.keep_situation_model(fitted, f"{tmp_path}/kept")
    kept = P.kept_situation_model(spark.newSession(), f"{tmp_path}/kept")
    scenarios = P.situation_features(big.shots, big.players).limit(20)
    cols = ["prob", "xp", "lift"]
    assert rows_of(P.score_situations(kept, scenarios), *cols) == rows_of(P.score_situations(fitted, scenarios), *cols)
    assert kept.auc.first().auc == fitted.auc.first().auc


def test_tendencies_of_a_named_shooter_and_of_nobody(spark, season):
    df = table(spark, "player_name string", [("Gus Gray",), ("League average",), (None,)])
    got = {r.player_name: r.player_2p_pct for r in P.add_tendencies(df, season.players).collect()}
    complete = [p for p in PLAYERS if None not in p]
    league = sum(p[8] for p in complete) / len(complete)
    assert got["Gus Gray"] == pytest.approx((0.46 + 0.50) / 2)
    assert got["League average"] == got[None] == pytest.approx(league)


def test_situation_choices(season):
    got = P.situation_choices(season.shots)
    assert got.filter("level = 0").first()["count"] == 14
    assert got.filter("level = 1 AND basic_zone IS NULL").count() == 0


def test_load_from_csv(spark, season, tmp_path):
    def dump(df, fields, name):
        known = {new: old for old, new, _ in fields}
        path = str(tmp_path / name)
        df.withColumnsRenamed(known).write.csv(path, header=True)
        return path

    loaded = P.load_season(
        spark,
        dump(season.shots, S.SHOTS, "shots"),
        dump(season.players, S.PLAYERS + S.PLAYERS_OPTIONAL, "players"),
        dump(season.teams, S.TEAMS, "teams"),
    )
    for mine, original in zip(loaded, season):
        assert mine.columns == original.columns
        assert mine.exceptAll(original).count() == 0 and mine.count() == original.count()


def test_a_null_in_any_player_column_drops_the_row(spark, tmp_path):
    path = tmp_path / "players.csv"
    head = [old for old, _, _ in S.PLAYERS]
    row = ["Ann Ace", "Bro", "G", "60", "30", "15", "0.6", "0.55", "0.52", "0.38", "115"]
    lines = [["RANK", *head, "AGE"], ["1", *row, "27"], ["", *row, "27"], ["3", *row, "27"]]
    path.write_text("\n".join(",".join(line) for line in lines))
    loaded = P.load_table(spark, str(path), S.PLAYERS, S.PLAYERS_OPTIONAL, keep_others=True)
    assert loaded.columns[-2:] == ["RANK", "AGE"]
    assert P.clean_players(loaded).count() == 2


def test_load_scored(spark, tmp_path):
    path = str(tmp_path / "scored.csv")
    with open(path, "w") as f:
        f.write("FULL NAME,GAME_ID,TEAM_ABBRV,SHOT_CAT,prediction,shot_pt,prob_made,xP,pts,CONF\n")
        f.write("Ann Ace,5,BRO,1,1.0,3,0.5,1.5,3,East\n")
    got = P.load_scored(spark, path, "csv")
    assert got.columns == [new for _, new, _ in S.SCORED] + ["conf"]
    assert tuple(got.first()) == ("Ann Ace", 5, "BRO", 1, 1.0, 3, 0.5, 1.5, 3, "East")


def test_shots_fixture_matches_the_schema(spark):
    assert len(shot_rows()[0]) == len(canonical_schema(S.SHOTS))
