"""Streaks with shields on literal day sequences."""

import datetime as dt

from stridekit.operators import activity as A


def _streaks(spark, user_days):
    rows = [(u, d) for u, days in user_days.items() for d in days]
    df = spark.createDataFrame(rows, "user_id long, day date")
    return {(r.user_id, r.day): r for r in A.streak_days(df).collect()}


def D(m, d):
    return dt.date(2024, m, d)


def test_reference_streak_cases(spark):
    user_days = {
        1: [D(1, 1), D(1, 2), D(1, 3), D(1, 4)],                                    # 3 -> next day 4
        # one shield used early in January (3 left), then 5 straight days, then a 2-day gap
        2: [D(1, 1), D(1, 3), D(1, 10), D(1, 11), D(1, 12), D(1, 13), D(1, 14), D(1, 16)],
        3: [D(1, d) for d in range(1, 11)] + [D(1, 14)],                            # 10, then a 3-day gap
    }
    s = _streaks(spark, user_days)
    assert s[(1, D(1, 4))].current_streak == 4
    r = s[(2, D(1, 16))]
    assert (r.current_streak, r.shield_used, r.shields_remaining, r.streak_broken) == (6, True, 2, False)
    r = s[(3, D(1, 14))]
    assert (r.current_streak, r.streak_broken, r.longest_streak) == (1, True, 10)


def test_five_two_day_gaps_and_month_reset(spark):
    days = [D(1, 1), D(1, 3), D(1, 5), D(1, 7), D(1, 9), D(1, 11), D(2, 2), D(2, 4)]
    s = _streaks(spark, {9: days})
    assert [s[(9, d)].current_streak for d in days] == [1, 2, 3, 4, 5, 1, 1, 2]
    assert s[(9, D(1, 11))].streak_broken and not s[(9, D(1, 11))].shield_used
    assert s[(9, D(2, 4))].shield_used and s[(9, D(2, 4))].shields_remaining == 3
