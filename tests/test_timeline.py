"""Neighbours and sessions against a plain loop over each user's plays."""

from itertools import groupby, pairwise

import pytest
from compare import explained
from pyspark.sql import functions as F

from earshot.models.next_time import forward_gap_examples, gap_examples
from earshot.operators import rankings, sessions, timeline
from earshot.sources.profiles import with_profile_numbers
from earshot.sources.table_functions import register_functions
from earshot.sources.tables import register_views

MIN = 60_000


def by_user(rows):
    return [list(plays) for _, plays in groupby(sorted(rows), key=lambda r: r[0])]


@pytest.fixture(params=["calm", "busy", "split"])
def limits(request, monkeypatch):
    """Users in one task each; the largest one split; everybody split into ranges of few plays."""
    if request.param != "calm":
        monkeypatch.setattr(timeline, "SMALL_BYTES", 0)
        monkeypatch.setattr(timeline, "PLAYS_PER_TASK", 100 if request.param == "busy" else 1)
        monkeypatch.setattr(timeline, "RANGE_PLAYS", 50 if request.param == "busy" else 20)
    return request.param


def test_neighbours_do_not_depend_on_the_ranges(spark, make_plays, skewed_rows, limits, monkeypatch):
    plays = make_plays(skewed_rows)
    key = ["user", "ts_ms", "artistId", "songId"]
    gaps = {tuple(r[c] for c in key): (r.pts, r.pdiff) for r in timeline.play_gaps(plays).collect()}
    ahead = {tuple(r[c] for c in key): r.nts for r in timeline.with_next_ts(plays).collect()}
    songs = {tuple(r[c] for c in key): r.next_songId for r in timeline.with_next_song(plays).collect()}
    assert len(gaps) == len(ahead) == len(songs) == len(skewed_rows)
    for history in by_user(skewed_rows):
        assert gaps[history[0]] == (None, None)
        assert ahead[history[-1]] is None and songs[history[-1]] is None
        for one, two in pairwise(history):
            assert gaps[two] == (one[1], two[1] - one[1])
            assert ahead[one] == two[1]
            assert songs[one] == two[3]
    assert timeline.next_song_pairs(plays).count() == len(skewed_rows) - 3
    monkeypatch.setattr(timeline, "SENT_USERS", 0)
    profiles = with_profile_numbers(spark.createDataFrame([("user_000001", "m", 30, "Peru")], "user string, gender string, age int, country string"))
    described = timeline.next_song_pairs(plays, profiles).collect()
    assert {tuple(r[c] for c in key): r.next_songId for r in described} == {k: v for k, v in songs.items() if v}
    assert {(r.user, r.age) for r in described} == {("user_000001", 30), ("user_000002", 0), ("user_000003", 0)}


def test_a_burst_within_one_millisecond_is_split(make_plays, monkeypatch):
    """All plays of a user at one instant, many of them equal: neighbours follow the order of songs."""
    monkeypatch.setattr(timeline, "SMALL_BYTES", 0)
    monkeypatch.setattr(timeline, "PLAYS_PER_TASK", 100)
    monkeypatch.setattr(timeline, "RANGE_PLAYS", 60)
    rows = [("user_1", 5, "a", f"s{k % 40:02d}") for k in range(400)] + [("user_2", 5, "a", "s")]
    plays = make_plays(rows)
    _, busy = timeline.by_busy_users(plays)
    sizes = [r["count"] for r in busy.groupBy("_range").count().collect()]
    assert len(sizes) > 3 and sum(sizes) == 400 and max(sizes) < 200
    found = timeline.with_next_song(plays).where("user = 'user_1'").collect()
    expected = sorted(f"s{k % 40:02d}" for k in range(400))
    assert sorted((r.songId, r.next_songId or "") for r in found) == sorted(zip(expected, [*expected[1:], ""]))
    numbered = sessions.sessionize(plays).collect()
    assert {(r.user, r.user_session_id) for r in numbered} == {("user_1", 1), ("user_2", 1)}
    assert sum(r.is_new_session for r in numbered) == 2


def expected_sessions(rows, gap_ms):
    numbered = []
    for history in by_user(rows):
        session, previous = 0, None
        for play in history:
            starts = previous is None or play[1] - previous > gap_ms
            session += starts
            numbered.append((*play, previous, int(starts), session))
            previous = play[1]
    return sorted(numbered, key=str)


@pytest.mark.parametrize("gap_ms", [0, 1, MIN, sessions.SESSION_GAP_MS, 10**9])
def test_sessions_match_a_plain_loop(spark, make_plays, skewed_rows, gap_ms, limits):
    plays = make_plays(skewed_rows)
    columns = ["user", "ts_ms", "artistId", "songId", "pts", "is_new_session", "user_session_id"]
    expected = expected_sessions(skewed_rows, gap_ms)
    found = sessions.sessionize(plays, gap_ms).select(*columns).collect()
    assert sorted([tuple(r) for r in found], key=str) == expected
    register_views(plays)
    in_sql = sessions.sessions_sql(spark, gap_ms).select(*columns).collect()
    assert sorted([tuple(r) for r in in_sql], key=str) == expected
    assert spark.table("sessions").count() == len(skewed_rows)


def test_columns_of_plays_are_kept_whatever_their_names(make_plays, skewed_rows):
    plays = make_plays(skewed_rows).selectExpr("*", "'keep' AS slice", "'keep' AS prev_ts")
    assert {(r.slice, r.prev_ts) for r in sessions.sessionize(plays).collect()} == {("keep", "keep")}


@pytest.mark.parametrize("gap_ms", [0, 1, MIN, sessions.SESSION_GAP_MS, 10**9])
def test_table_functions_match_the_operators(spark, make_plays, skewed_rows, gap_ms):
    plays = make_plays(skewed_rows)
    register_views(plays)
    register_functions(spark)
    found = spark.sql(f"SELECT user, user_session_id, session_length FROM listening_sessions({gap_ms}L)").collect()
    assert sorted(found) == sorted(sessions.session_lengths(plays, gap_ms).collect())
    if gap_ms == sessions.SESSION_GAP_MS:
        for n in (0, 3, 10_000):
            assert sorted(spark.sql(f"SELECT * FROM top_sessions({n})").collect()) == sorted(sessions.top_sessions(plays, n).collect())
            assert sorted(spark.sql(f"SELECT * FROM top_users({n})").collect()) == sorted(rankings.top_users(plays, n).collect())
        plan = explained(spark.sql("SELECT * FROM top_songs(3)"))
        assert "TakeOrderedAndProject" in plan


def test_wide_gaps_keep_narrow_slices():
    assert [sessions.slice_width(g) for g in (0, 1, sessions.SESSION_GAP_MS, 10**9)] == [
        1,
        1,
        sessions.SESSION_GAP_MS,
        timeline.HOUR_MS,
    ]


def test_lengths_agree_with_session_window(make_plays, skewed_rows):
    plays = make_plays(skewed_rows)
    windows = plays.groupBy("user", F.session_window("ts", "20 minutes")).agg(
        (F.max("ts_ms") - F.min("ts_ms")).alias("length")
    )
    expected = sorted((r.user, r.length) for r in windows.collect())
    found = sorted((r.user, r.session_length) for r in sessions.session_lengths(plays).collect())
    assert found == expected


def test_the_gap_is_strict(make_plays):
    plays = make_plays(
        [("user_1", 0, "a", "s"), ("user_1", 20 * MIN, "a", "s"), ("user_2", 0, "a", "s"), ("user_2", 20 * MIN + 1, "a", "s")]
    )
    lengths = sorted((r.user, r.user_session_id, r.session_length) for r in sessions.session_lengths(plays).collect())
    assert lengths == [("user_1", 1, 20 * MIN), ("user_2", 1, 0), ("user_2", 2, 0)]


@pytest.mark.parametrize("n", [0, 1, 5, 10_000])
def test_top_sessions_match_a_plain_loop(spark, make_plays, skewed_rows, n):
    plays = make_plays(skewed_rows)
    expected = {}
    for *play, _, _, session in expected_sessions(skewed_rows, sessions.SESSION_GAP_MS):
        expected.setdefault((play[0], session), []).append(play)
    ranked = sorted(expected.items(), key=lambda s: (s[1][0][1] - s[1][-1][1], s[0]))[:n]
    rows = [
        (session, plays_[-1][1] - plays_[0][1], user, f"name of {p[2]}", f"name of {p[3]}")
        for (user, session), plays_ in ((k, sorted(v, key=lambda p: tuple(p[1:]))) for k, v in ranked)
        for p in plays_
    ]
    assert [tuple(r) for r in sessions.top_sessions(plays, n).collect()] == rows
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert [tuple(r) for r in sessions.top_sessions(plays, n).collect()] == rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_longest_sessions_by_length_in_descending_order(make_plays, skewed_rows):
    lengths = [r.session_length for r in sessions.longest_sessions(make_plays(skewed_rows), 10).collect()]
    assert lengths == sorted(lengths, reverse=True) and len(lengths) == 10


def test_gap_examples_look_back_and_forward(make_plays):
    plays = make_plays([("user_7", 0, "a", "s"), ("user_7", 5, "a", "s"), ("user_7", 3_600_005, "a", "s")])
    back = sorted((r.ts_ms, r.hour_of_day, r.pdiff) for r in gap_examples(plays).collect())
    ahead = sorted((r.ts_ms, r.hour_of_day, r.gap_ms) for r in forward_gap_examples(plays).collect())
    assert back == [(0, 0, 0), (5, 0, 5), (3_600_005, 1, 3_600_000)]
    assert ahead == [(0, 0, 5), (5, 0, 3_600_000)]
