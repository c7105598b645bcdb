"""Hand-written lines: every edge of the two text formats, and the tables made from them."""

import datetime
import json
import uuid
from collections import Counter

import pytest
from compare import explained
from pyspark.sql import functions as F

from earshot import ListeningLog
from earshot.functions.text import gender_code, hash_key31, integer_or_zero, user_number
from earshot.functions.time import naive_epoch_ms, plus_ms, slice_start
from earshot.operators.users import of_users
from earshot.sources.play_log import identified_plays, plays_from_raw, read_plays, read_raw_log, read_raw_users, rejected_plays
from earshot.sources.profiles import one_per_user, read_profiles
from earshot.sources.tables import read_table, write_plays, write_result

LOG = [
    "user_000001\t2009-05-04T23:08:57Z\ta1\tArt\ts1\tSong",
    'user_000001\t2009-05-04T23:10:00Z\ta1\tArt "q\ts2\tA "quoted" one',
    "user_000002\t2009-05-04T23:08:57Z\t\tArt\ts1\tSong",
    "user_000003\t2009-05-04T23:08:57Z\ta1\tArt\t\tSong",
    "user_000004\t2009-05-04T23:08:57Z\ta1\tArt\ts3\t",
    "user_000005\t2009-05-04T23:08:57Z\ta1",
    "user_000006\tyesterday\ta1\tArt\ts1\tSong",
    "user_000007\t2009-05-05T01:08:57+02\ta2\tback\\slash\ts4\t# hash, comma",
    "#user_08\t2009-05-04T23:08:57Z\ta1\tArt\ts1\tżółć 😀",
]
PROFILES = [
    "#id\tgender\tage\tcountry\tregistered",
    "",
    "   ",
    "user_000001\tm\t22\tJapan\tAug 13, 2006",
    "user_000002\tF\t\tPeru\tAug 3, 2006",
    "user_000003\tx\tabc\t\tFeb 1, 2007",
    "user_000004\t\t-1\tMexico\tDec 31, 2005",
    "user_000005\tm\t30\tJapan\t",
    "user_000006\tm\t30\tJapan\tJan 1, 2006\textra",
    "user_000007\tM\t30\tJapan\tJan 1, 2006\t\t",
    "user_000008\tm\t30\tJapan\tsome day",
    "user_00001\tf\t99\tChile\tJan 1, 2006",
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tsv")
    (folder / "log.tsv").write_text("\n".join(LOG) + "\n", encoding="utf-8")
    (folder / "profiles.tsv").write_text("\n".join(PROFILES) + "\n", encoding="utf-8")
    return folder


def test_plays_keep_lines_with_time_and_both_ids(spark, files):
    plays = read_plays(spark, str(files / "log.tsv"))
    rows = {(r.user, r.artistId, r.artist, r.songId, r.song) for r in plays.collect()}
    assert rows == {
        ("user_000001", "a1", "Art", "s1", "Song"),
        ("user_000001", "a1", 'Art "q', "s2", 'A "quoted" one'),
        ("user_000004", "a1", "Art", "s3", None),
        ("user_000007", "a2", "back\\slash", "s4", "# hash, comma"),
        ("#user_08", "a1", "Art", "s1", "żółć 😀"),
    }


def test_rejected_lines_say_why(spark, files, tmp_path):
    log = ListeningLog.from_files(spark, str(files / "log.tsv"), str(files / "profiles.tsv"))
    rejected = log.rejected_lines().collect()
    reasons = Counter((r.file, r.reason) for r in rejected)
    assert reasons == {
        ("plays", "no artist id"): 1, ("plays", "no song id"): 1, ("plays", "fields missing"): 1, ("plays", "unreadable time"): 1,
        ("profiles", "comment"): 1, ("profiles", "blank line"): 2, ("profiles", "not five fields"): 2, ("profiles", "unreadable date"): 1,
    }
    assert len(LOG) == log.plays.count() + sum(r.file == "plays" for r in rejected)
    assert len(PROFILES) == log.profiles.count() + sum(r.file == "profiles" for r in rejected)
    odd = tmp_path / "odd.tsv"
    odd.write_text("\n   \nuser_1\t2009-05-04T23:08:57Z\ta\tb\ts\nuser_1\t2009-05-04T23:08:57Z\ta\tb\n")
    assert read_plays(spark, str(odd)).count() == 1
    assert sorted(r.reason for r in rejected_plays(spark, str(odd)).collect()) == ["blank line", "blank line", "fields missing"]


def test_play_instants_and_calendar(spark, files):
    plays = read_plays(spark, str(files / "log.tsv"))
    seen = {r.user: (r.ts_ms, r.day_of_week, r.hour_of_day) for r in plays.filter("songId <> 's2'").collect()}
    assert seen["user_000001"] == (1241478537000, 2, 23)
    assert seen["user_000007"] == seen["user_000001"]


def test_raw_users_come_from_every_line(spark, files):
    path = str(files / "log.tsv")
    assert {r.user for r in read_raw_users(spark, path).collect()} == {line.split("\t")[0] for line in LOG}
    log = ListeningLog.from_files(spark, path, str(files / "profiles.tsv"))
    assert log.unique_users_raw().count() == 8
    assert [r.user for r in log.unique_users().collect()] == ["#user_08", "user_000001", "user_000004", "user_000007"]


def test_profiles(spark, files):
    profiles = read_profiles(spark, str(files / "profiles.tsv"))
    rows = {r.user: (r.gender, r.age, r.country, r.registered, r.user_id, r.gender_id) for r in profiles.collect()}
    assert rows == {
        "user_000001": ("m", 22, "Japan", datetime.date(2006, 8, 13), 1, 1),
        "user_000002": ("F", 0, "Peru", datetime.date(2006, 8, 3), 2, 2),
        "user_000003": ("x", 0, "", datetime.date(2007, 2, 1), 3, 0),
        "user_000004": ("", -1, "Mexico", datetime.date(2005, 12, 31), 4, 0),
        "user_000007": ("M", 30, "Japan", datetime.date(2006, 1, 1), 7, 1),
        "user_00001": ("f", 99, "Chile", datetime.date(2006, 1, 1), 1, 2),
    }


def test_one_profile_per_user_number(spark, files):
    unique = one_per_user(read_profiles(spark, str(files / "profiles.tsv")))
    assert {r.user_id: r.user for r in unique.collect()}[1] == "user_000001"
    assert unique.count() == 5


def test_text_functions(spark):
    texts = ["+5", "-5", " 12", "007", "99999999999", "1.5", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(integer_or_zero(F.col("t"))).collect()] == [5, -5, 0, 7, 0, 0, 0, 0]
    names = spark.createDataFrame([("user_000012",), ("user_12",), ("user_x",), ("u",)], "t string")
    assert [r[0] for r in names.select(user_number(F.col("t"))).collect()] == [12, 12, 0, 0]
    genders = spark.createDataFrame([("M",), ("f",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in genders.select(gender_code(F.col("t"))).collect()] == [1, 2, 0, 0, 0]


def test_hash_key_is_the_java_string_hash(spark):
    def expected(text):
        key = 0
        units = text.encode("utf-16-be")
        for at in range(0, len(units), 2):
            key = (key * 31 + int.from_bytes(units[at : at + 2], "big")) & 0xFFFFFFFF
        return key & 0x7FFFFFFF

    texts = ["hello", "", "żółć", "Aa", "BB", "polygenelubricants", str(uuid.UUID(int=2**127 + 12345)), "a😀b", "\U0010ffff\U00010000\uffff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(hash_key31(F.col("t"))).collect()]
    assert got == [expected(t) for t in texts]
    assert got[0] == 99162322 and got[3] == got[4]


def test_time_functions_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.1799' AS ts")
        row = df.select(naive_epoch_ms(F.col("ts")).alias("ms"), plus_ms(F.col("ts"), F.lit(2**33)).alias("later")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.ms == 1710037800179
    assert row.later == datetime.datetime(2024, 3, 10, 2, 30, 0, 179900) + datetime.timedelta(milliseconds=2**33)


def test_slice_start_also_before_1970(spark):
    df = spark.createDataFrame([(0,), (1199,), (1200,), (-1,)], "t bigint")
    assert [r[0] for r in df.select(slice_start(F.col("t"), 1200)).collect()] == [0, 0, 1200, -1200]


def test_stored_plays_answer_the_same_and_filter_in_the_scan(spark, files, tmp_path):
    plays = read_plays(spark, str(files / "log.tsv"))
    write_plays(plays, str(tmp_path / "plays"), partitions=2)
    stored = plays_from_raw(read_table(spark, str(tmp_path / "plays")))
    assert sorted(stored.collect()) == sorted(plays.select(*stored.columns).collect())
    asked = of_users(stored, [1])
    plan = explained(asked)
    assert "PushedFilters: [" in plan and "EqualTo(user_id,1)" in plan
    assert asked.count() == 2


def test_a_stored_log_answers_like_its_files(spark, files, tmp_path):
    log = ListeningLog.from_files(spark, str(files / "log.tsv"), str(files / "profiles.tsv"))
    log.store(str(tmp_path / "store"))
    stored = ListeningLog.from_store(spark, str(tmp_path / "store"))
    for ask in (
        lambda one: one.unique_users(),
        lambda one: one.unique_users_raw(),
        lambda one: one.top_songs(10),
        lambda one: one.top_users(10),
        lambda one: one.top_sessions(10),
        lambda one: one.profiles,
        lambda one: one.plays.select("user_id", "song_id", "artist_id", "hour_of_day", "ts_ms"),
    ):
        assert sorted(map(str, ask(stored).collect())) == sorted(map(str, ask(log).collect()))


def test_results_are_written_as_rows(spark, tmp_path):
    df = spark.createDataFrame([("s1", 3)], "songId string, playCount bigint")
    write_result(df, str(tmp_path / "out"), "json")
    text = "".join(part.read_text() for part in (tmp_path / "out").glob("*.json"))
    assert json.loads(text) == {"songId": "s1", "playCount": 3}


def test_identified_plays_drop_null_and_empty_ids(spark):
    raw = spark.createDataFrame(
        [(1, "a", "s"), (1, "", "s"), (1, None, "s"), (1, "a", ""), (1, "a", None), (None, "a", "s")],
        "ts_ms bigint, artistId string, songId string",
    )
    assert identified_plays(raw).count() == 1


def test_raw_log_keeps_unreadable_lines(spark, files):
    assert read_raw_log(spark, str(files / "log.tsv")).count() == len(LOG)


def test_long_numbers_are_not_cut(spark, tmp_path):
    from compare import connect

    from workload import event_tables, oracle

    path = str(tmp_path / "events.parquet")
    numbers = spark.createDataFrame([(1, 1_000_000, 1234), (2, 1_000_009, 1235), (3, 7, 5)], "event_id bigint, user_id bigint, k int")
    numbers.select(
        "event_id",
        "user_id",
        F.lit("click").alias("event_type"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.format_string('{"k": %d}', "k").alias("props"),
    ).coalesce(1).write.parquet(path)
    ours = {(r.user, r.artistId) for r in event_tables.raw_log(spark, str(tmp_path)).collect()}
    assert ours == {("user_1000000", "art_1234"), ("user_1000009", "art_1235"), ("user_000007", "art_005")}
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert set(con.execute(oracle.sql('SELECT "user", "artistId" FROM raw')).fetchall()) == ours
