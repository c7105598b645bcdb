"""Questions as SQL table functions over the views ``plays`` and ``profiles``.

``SELECT * FROM top_sessions(10)`` and the like, for those who ask in SQL. A numeric argument becomes part of
the plan: ``most`` turns into a limit, and the gap of sessions into the width of slices.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

HOUR_MS = 3_600_000
#: The gap of the listening sessions, in milliseconds.
SESSION_GAP_MS = 1_200_000

# Slices no wider than the gap hold no break. They are numbered hour by hour and then within the hour, so that
# a window over a user alone sees hours, however narrow the slices are.
_SESSIONS = f"""
  WITH slices AS (
    SELECT user, ts_ms - pmod(ts_ms, greatest(1L, least(gap_ms, {HOUR_MS}L))) AS slice,
           min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
    FROM plays GROUP BY ALL
  ),
  hourly AS (SELECT *, slice - pmod(slice, {HOUR_MS}L) AS hour FROM slices),
  ends AS (
    SELECT user, hour, lag(max(last_ms)) OVER (PARTITION BY user ORDER BY hour) AS far FROM hourly GROUP BY user, hour
  ),
  linked AS (
    SELECT hourly.*, coalesce(lag(last_ms) OVER (PARTITION BY user, hour ORDER BY slice), far) AS previous_ms
    FROM hourly JOIN ends USING (user, hour)
  ),
  flagged AS (
    SELECT *, CASE WHEN previous_ms IS NULL OR first_ms - previous_ms > gap_ms THEN 1 ELSE 0 END AS starts FROM linked
  ),
  before AS (
    SELECT user, hour, coalesce(sum(sum(starts)) OVER (PARTITION BY user ORDER BY hour
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM flagged GROUP BY user, hour
  ),
  numbered AS (
    SELECT flagged.*, earlier + sum(starts) OVER (PARTITION BY user, hour ORDER BY slice) AS user_session_id
    FROM flagged JOIN before USING (user, hour)
  )
  SELECT user, user_session_id, min(first_ms) AS start_ms, max(last_ms) AS end_ms, max(last_ms) - min(first_ms) AS session_length
  FROM numbered GROUP BY user, user_session_id
"""

FUNCTIONS = {
    "top_users(most INT) RETURNS TABLE (userName STRING, songCount BIGINT)": """
  SELECT userName, songCount
  FROM (SELECT *, row_number() OVER (ORDER BY songCount DESC, userName) AS place
        FROM (SELECT user AS userName, count(DISTINCT songId) AS songCount FROM plays GROUP BY user))
  WHERE place <= most""",
    "top_songs(most INT) RETURNS TABLE (songId STRING, playCount BIGINT)": """
  SELECT songId, playCount
  FROM (SELECT *, row_number() OVER (ORDER BY playCount DESC, songId) AS place
        FROM (SELECT songId, count(*) AS playCount FROM plays GROUP BY songId))
  WHERE place <= most""",
    "last_plays() RETURNS TABLE (user_id INT, user STRING, ts_ms BIGINT, artistId STRING, songId STRING)": """
  SELECT user_id, last.user, last.ts_ms, last.artistId, last.songId
  FROM (SELECT user_id, max_by(struct(user, ts_ms, artistId, songId), struct(ts_ms, songId, artistId)) AS last
        FROM plays GROUP BY user_id)""",
    "listening_sessions(gap_ms BIGINT) RETURNS TABLE (user STRING, user_session_id BIGINT, start_ms BIGINT, end_ms BIGINT, session_length BIGINT)": _SESSIONS,
    "top_sessions(most INT) RETURNS TABLE (sessionId BIGINT, sessionLength BIGINT, user STRING, artist STRING, song STRING)": f"""
  SELECT best.user_session_id, best.session_length, plays.user, plays.artist, plays.song
  FROM plays JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY session_length DESC, user, user_session_id) AS place
                   FROM listening_sessions({SESSION_GAP_MS}L))
    WHERE place <= most) AS best
  ON plays.user = best.user AND plays.ts_ms BETWEEN best.start_ms AND best.end_ms""",
}


def register_functions(spark: SparkSession) -> None:
    """Make the table functions known to ``spark.sql``; ``plays`` has to be registered as a view."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
