"""Literal expectations of the XP rules (levels, streak multipliers, caps,
single-activity XP, badges, gamer mechanics, routing)."""

from pyspark.sql import functions as F

from stridekit.functions import keywords as KW
from stridekit.functions import xp as X
from stridekit.operators import activity as A


def _one(spark, expr, value, typ="long"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first().r


def test_levels(spark):
    for xp, lvl in [(0, 1), (500, 2), (4999, 10), (5000, 10), (19999, 19), (20000, 20), (23000, 21)]:
        assert _one(spark, X.level_of, xp) == lvl


def test_streak_multiplier_and_milestone(spark):
    exp = {1: 1.0, 4: 1.0, 5: 1.5, 6: 1.5, 10: 1.75, 20: 2.0, 30: 2.25, 60: 2.5}
    for d, m in exp.items():
        assert _one(spark, X.streak_multiplier, d, "int") == m
    assert _one(spark, X.streak_milestone, 5, "int") == "Power-Up"
    assert _one(spark, X.streak_milestone, 6, "int") is None


def test_daily_cap(spark):
    for lvl, cap in [(1, 600), (10, 600), (11, 800), (20, 800), (21, 1000)]:
        assert _one(spark, X.daily_cap_of, lvl, "int") == cap


def test_badges(spark):
    for xp, idx in [(999, -1), (1000, 0), (5000, 1), (150000, 5)]:
        assert _one(spark, X.badge_index, xp) == idx


def _calc(spark, rows):
    df = spark.createDataFrame(rows, "activity_type string, duration_minutes int, intensity string, primary_build string, "
                                     "current_streak int, current_level int, daily_xp_so_far int")
    return A.calculate_xp(df).collect()


def test_single_activity_xp(spark):
    r = _calc(spark, [
        ("gym_session", 60, "intense", "strength", 1, 1, 0),
        ("gym_session", 60, "intense", "intelligence", 1, 1, 0),
        ("gym_session", 60, "intense", "strength", 5, 1, 0),
        ("gym_session", 60, "intense", "strength", 1, 1, 560),
        ("gym_session", 60, "intense", "strength", 1, 1, 600),
        ("walking", 30, "light", "wellness", 1, 1, 0),
        ("study_session", 60, "moderate", "intelligence", 1, 1, 0),
    ])
    assert [x.final_xp for x in r] == [120, 60, 180, 40, 0, 15, 90]
    assert r[3].was_capped and not r[0].was_capped
    assert r[2].power_up_name == "Power-Up"


def test_half_even_rounding(spark):
    # 15 minutes light, non-primary, streak 5x1.5: 15*1*0.5*... -> use a direct 22.5 case
    assert spark.range(1).select(X.half_even_int(F.lit(22.5)).alias("r")).first().r == 22
    assert spark.range(1).select(X.half_even_int(F.lit(23.5)).alias("r")).first().r == 24


def _gamer(spark, rows):
    df = spark.createDataFrame(rows, "activity_type string, duration_minutes int, intensity string, current_streak int, "
                                     "current_level int, daily_xp_so_far int, primary_sessions_today int, overtime_xp_today int")
    return A.gamer_xp(df).collect()


def test_gamer_mechanics(spark):
    r = _gamer(spark, [
        ("competitive_gaming", 60, "intense", 1, 1, 0, 0, 0),
        ("competitive_gaming", 60, "intense", 1, 1, 0, 1, 0),
        ("competitive_gaming", 60, "intense", 1, 1, 0, 3, 0),
        ("competitive_gaming", 25, "intense", 1, 1, 0, 0, 0),
        ("competitive_gaming", 60, "intense", 1, 1, 600, 0, 0),
        ("competitive_gaming", 60, "intense", 1, 1, 600, 0, 100),
        ("competitive_gaming", 60, "intense", 7, 1, 0, 0, 0),
        ("gym_session", 60, "intense", 1, 1, 0, 0, 0),
        ("competitive_gaming", 100, "intense", 7, 1, 550, 0, 0),
    ])
    assert [x.gamer_final_xp for x in r[:3]] == [120, 144, 168]
    assert r[3].speedrun_bonus == 15
    assert r[4].overtime_xp == 120 and r[5].overtime_xp == 50
    assert r[6].is_boss_day and r[6].gamer_final_xp == 180
    assert r[7].gamer_final_xp == 48 and r[7].combo_bonus_xp == 0 and r[7].side_quest_penalty
    # boss day: 550 already earned, the doubled cap (1,200) leaves room for all 300
    assert r[8].is_boss_day and r[8].base_final_xp == 300


def test_routing(spark):
    msgs = [("how much xp do i earn?", "xp_coach"), ("can i switch my build?", "build_advisor"),
            ("I feel like giving up", "motivation"), ("hey whats up", "general")]
    df = spark.createDataFrame(msgs, "m string, want string")
    got = df.select("want", KW.route_message(F.col("m")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
