"""What the physical plans must look like for the log to be large."""

import re

import pytest
from compare import explained
from pyspark.sql import functions as F

from earshot.operators import sessions, timeline, users
from workload.event_tables import plays, profiles
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Plan as for tables far too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_needs_a_cross_join(spark, no_broadcast, name):
    plan = explained(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def shuffled_by(plan):
    return re.findall(r"Arguments: hashpartitioning\(([^)]*), \d+\)", plan)


def keys(exchange):
    return [re.sub(r"#.*", "", key.strip()) for key in exchange.split(",")]


def test_plays_are_shuffled_once_for_gaps(spark, no_broadcast):
    gaps = timeline.play_gaps(plays(spark, SF_DIR))
    exchanges = [keys(e) for e in shuffled_by(explained(gaps))]
    assert exchanges == [["user"]]
    numbered = sessions.sessionize(plays(spark, SF_DIR))
    assert [keys(e) for e in shuffled_by(explained(numbered))] == [["user"]]


def test_profiles_do_not_cost_another_shuffle_of_plays(spark, no_broadcast):
    pairs = timeline.next_song_pairs(plays(spark, SF_DIR), profiles=profiles(spark, SF_DIR))
    described = pairs.select("songId", "next_songId", "country_id")
    joins = re.findall(r"Left keys \[\d+\]: \[([^\]]*)\]", explained(described))
    assert joins[-1].startswith("user#")


def test_top_sessions_never_shuffle_the_log(spark):
    plan = explained(sessions.top_sessions(plays(spark, SF_DIR), 10))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # only the matching plays move, spread over their slices
    assert [keys(e) for e in shuffled_by(plan)] == [["user", "slice"]]


@pytest.fixture
def skewed(spark, no_broadcast):
    """Split whatever is larger than the rest."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_a_hot_user_is_split_in_the_profile_join(spark, skewed, tmp_path):
    log = plays(spark, SF_DIR)
    hot = log.withColumn("user_id", F.when(F.col("event_id") % 10 != 0, F.lit(1)).otherwise(F.col("user_id")))
    hot.repartition(6).write.parquet(str(tmp_path / "plays"))
    joined = users.plays_with_profile(spark.read.parquet(str(tmp_path / "plays")), profiles(spark, SF_DIR))
    joined.collect()
    assert "skew=true" in explained(joined)


def test_session_lengths_aggregate_before_the_shuffle(spark, no_broadcast):
    plan = explained(sessions.session_lengths(plays(spark, SF_DIR)))
    assert "partial_min(ts_ms" in plan and "partial_max(ts_ms" in plan
    assert [len(keys(e)) for e in shuffled_by(plan)] == [2, 1]


def test_per_user_questions_read_only_their_columns(spark, tmp_path):
    plays(spark, SF_DIR).write.parquet(str(tmp_path / "plays"))
    stored = spark.read.parquet(str(tmp_path / "plays"))
    plan = explained(users.last_play_by_user(stored.select("user_id", "ts_ms", "songId", "artistId"), [3]))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan
    counts = explained(stored.groupBy("songId").agg(F.count(F.lit(1))))
    assert "ReadSchema: struct<songId:string>" in counts
