"""File sources: malformed JSON lines are quarantined, JSON trees flatten
list roots, saved user states get defaults; small text helpers."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridekit.operators import corpus as C
from stridekit.functions import text as TX
from stridekit.sources import files as FL
from stridekit.sources import states as ST


def test_jsonl_malformed_and_blank_lines(spark):
    d = tempfile.mkdtemp(prefix="jsonl-", dir="/tmp")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write('{"a": 1, "b": "x"}\n\n{broken\n{"a": 2, "b": "y"}\n   \n')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    good, bad = FL.read_jsonl(spark, d, schema)
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert bad.count() == 1


def test_json_tree_list_and_dict_roots(spark):
    d = tempfile.mkdtemp(prefix="jtree-", dir="/tmp")
    os.makedirs(os.path.join(d, "sub"))
    json.dump([{"q": "a"}, {"q": "b"}], open(os.path.join(d, "l.json"), "w"))
    json.dump({"q": "c"}, open(os.path.join(d, "sub", "o.json"), "w"))
    assert sorted(r.q for r in FL.read_json_tree(spark, d).collect()) == ["a", "b", "c"]


def test_user_states_of_any_shape(spark):
    """Single states and lists, whole files and lines, missing keys, wrong kinds, no JSON."""
    states = [
        {"user_id": "u1", "primary_build": {"build": "gamer", "total_xp": 1200}, "legacy_builds": [{"build": "strength", "total_xp": 150000}], "last_activity_date": "2024-01-05"},
        {"user_id": "u2", "username": "Two", "primary_build": {"build": "gamer"}, "secondary_build": {"build": "wellness", "total_xp": 7, "is_legacy": True}, "shields_remaining": "x",
         "activity_history": [{"activity": "run", "duration": 5, "xp": 10, "extra": 1}, {"activity": "read", "notes": "n"}]},
        {"user_id": "u3", "current_streak": 4, "last_reset_date": "2024-02-01", "shields_reset_month": 2},
    ]
    whole, lines = (tempfile.mkdtemp(prefix="state-", dir="/tmp") for _ in range(2))
    json.dump(states[:2], open(os.path.join(whole, "a.json"), "w"), indent=2)
    json.dump(states[2], open(os.path.join(whole, "b.json"), "w"), indent=2)
    with open(os.path.join(lines, "all.jsonl"), "w") as f:
        f.write("\n".join([json.dumps(states[:2]), "", json.dumps(states[2]), "{broken", "[]", "17", json.dumps({"no": "id"})]))
    today = dt.date(2024, 3, 9)
    for path, by_line in ((whole, False), (lines, True)):
        df = ST.load_user_states(spark, path, by_line, today)
        got = {r["user_id"]: r for r in df.collect()}
        assert set(got) == {"u1", "u2", "u3"}
        one, two, three = (got[u] for u in ("u1", "u2", "u3"))
        assert one.username == "u1" and one.current_streak == 0 and one.shields_remaining == 4 and one.legacy_builds[0].is_legacy and str(one.last_activity_date) == "2024-01-05"
        assert one.last_reset_date == today and one.shields_reset_month == 3 and one.secondary_build is None and one.activity_history == []
        assert two.secondary_build.is_legacy and two.primary_build.total_xp == 0 and two.shields_remaining == 4 and [x.activity for x in two.activity_history] == ["run", "read"]
        assert three.current_streak == 4 and three.shields_reset_month == 2 and str(three.last_reset_date) == "2024-02-01" and three.primary_build.build is None
        assert [(r.user_id, r.pos, r.xp, r.notes) for r in ST.activity_history(df).orderBy("pos").collect()] == [("u2", 0, 10, None), ("u2", 1, None, "n")]
        assert sorted((r.user_id, r.kind, r.total_xp) for r in ST.builds(df).collect()) == [("u1", "legacy", 150000), ("u1", "primary", 1200), ("u2", "primary", 0), ("u2", "secondary", 7), ("u3", "primary", 0)]
    assert [r.value for r in ST.bad_documents(spark, lines, True).collect()] == ["{broken"]


def test_feature_csv_unknown_type_fails(spark):
    d = tempfile.mkdtemp(prefix="fcsv-", dir="/tmp")
    with open(os.path.join(d, "f.csv"), "w") as f:
        f.write("activities_per_day,daily_xp_total,streak_gap_days,intensity_switch_rate,avg_session_duration,"
                "max_session_duration,sessions_at_cap_ratio,xp_per_minute,is_anomaly,anomaly_type\n")
        f.write("1,10,1,0,10,10,0,1,0,none\n1,10,1,0,10,10,0,1,1,bogus\n")
    with pytest.raises(Exception):
        FL.read_feature_csv(spark, d).collect()


def test_bio_and_merge(spark):
    df = spark.createDataFrame([("sys ", " bio", "Do this", "")], "s string, b string, i string, x string")
    r = df.select(C.append_bio(F.col("s"), F.col("b")).alias("a"), TX.merge_instruction(F.col("i"), F.col("x")).alias("m")).first()
    assert r.a == "sys  Speak in the style of this character: bio" and r.m == "Do this"
