"""Column expressions for the XP rules (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def level_of(total_xp) -> Column:
    """level from total XP (floor division on non-negative XP)."""
    t = _c(total_xp)
    return (
        F.when(t < 5000, F.greatest(F.lit(1), F.floor(t / 500) + 1))
        .when(t < 20000, F.floor((t - 5000) / 1500) + 10)
        .otherwise(F.floor((t - 20000) / 3000) + 20)
        .cast("int")
    )


def daily_cap_of(level) -> Column:
    """daily cap for a level."""
    lv = _c(level)
    expr = None
    for min_level, cap in K.DAILY_CAP_TIERS:
        expr = F.when(lv >= min_level, F.lit(cap)) if expr is None else expr.when(lv >= min_level, F.lit(cap))
    return expr.otherwise(F.lit(600)).cast("int")


def streak_multiplier(streak) -> Column:
    """step function of the streak length."""
    s = _c(streak)
    expr = None
    for days, mult, _ in K.STREAK_MILESTONES:
        expr = F.when(s >= days, F.lit(mult)) if expr is None else expr.when(s >= days, F.lit(mult))
    return expr.otherwise(F.lit(1.0))


def streak_milestone(streak) -> Column:
    """milestone name, only on the exact day."""
    s = _c(streak)
    expr = None
    for days, _, name in K.STREAK_MILESTONES:
        expr = F.when(s == days, F.lit(name)) if expr is None else expr.when(s == days, F.lit(name))
    return expr


def badge_index(total_xp) -> Column:
    """highest badge tier reached, -1 for none."""
    t = _c(total_xp)
    arr = F.array(*[F.lit(x) for x in K.BADGE_THRESHOLDS])
    return (F.size(F.filter(arr, lambda th: t >= th)) - 1).cast("int")


def badge_name(build, idx) -> Column:
    """badge name for (build, tier); NULL outside 0..5."""
    b, i = _c(build), _c(idx)
    names = F.create_map(
        *[x for k, v in K.BADGE_NAMES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))]
    )
    return F.when((i >= 0) & (i < len(K.BADGE_THRESHOLDS)), F.element_at(names[b], i + 1))


def xp_to_next_badge(total_xp) -> Column:
    """distance to the next threshold, NULL at the top tier."""
    t = _c(total_xp)
    arr = F.array(*[F.lit(x) for x in K.BADGE_THRESHOLDS])
    nxt = badge_index(t) + 1
    return F.when(nxt < len(K.BADGE_THRESHOLDS), F.greatest(F.lit(0), F.element_at(arr, nxt + 1) - t)).cast("int")


def next_level_xp(total_xp) -> Column:
    """Total XP at which the next level starts (Q4: the true distance)."""
    lv = level_of(total_xp)
    nl = lv + 1
    return (
        F.when(nl <= 10, (nl - 1) * 500)
        .when(nl <= 20, (nl - 10) * 1500 + 5000)
        .otherwise((nl - 20) * 3000 + 20000)
    ).cast("int")


def xp_to_next_level(total_xp) -> Column:
    return (next_level_xp(total_xp) - _c(total_xp)).cast("int")


def half_even_int(x) -> Column:
    """Python ``int(round(x))``: half to even."""
    return F.bround(_c(x), 0).cast("int")


def is_boss_day(streak) -> Column:
    s = _c(streak)
    return (s > 0) & (s % K.GAMER_BOSS_DAY_INTERVAL == 0)


def combo_multiplier(session_no) -> Column:
    """Combo bonus for the n-th primary gamer session of the day (1-based)."""
    n = _c(session_no)
    expr = F.when(n <= 1, F.lit(0.0))
    for k, v in K.GAMER_COMBO:
        expr = expr.when(n == k, F.lit(v))
    return expr.otherwise(F.lit(K.GAMER_COMBO_MAX))
