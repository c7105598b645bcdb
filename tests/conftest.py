import random
import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from earshot.session import local_session  # noqa: E402
from earshot.sources.play_log import with_play_numbers  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_plays(spark):
    """Plays from (user, milliseconds, artistId, songId) tuples."""

    def make(rows):
        start = datetime(1970, 1, 1, tzinfo=timezone.utc)
        full = [
            (user, start + timedelta(milliseconds=ms), ms, artist, f"name of {artist}", song, f"name of {song}")
            for user, ms, artist, song in rows
        ]
        schema = "user string, ts timestamp, ts_ms bigint, artistId string, artist string, songId string, song string"
        return with_play_numbers(spark.createDataFrame(full, schema))

    return make


@pytest.fixture(scope="session")
def skewed_rows():
    """Three users, one with most plays; many ties, some gaps of exactly 20 minutes."""
    rng = random.Random(7)
    rows = set()
    for user, count in (("user_000001", 600), ("user_000002", 40), ("user_000003", 25)):
        ms = 1_000_000_000_000
        for _ in range(count):
            ms += rng.choice([0, 0, 1, 60_000, 600_000, 1_199_999, 1_200_000, 1_200_001, 5_000_000, 90_000_000])
            song = rng.randrange(30)
            rows.add((user, ms, f"art_{song // 3}", f"song_{song}"))
    return sorted(rows)
