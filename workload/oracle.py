"""The same answers in SQL for DuckDB, written without looking at how Spark gets them.

The time order, sessions and gaps use plain per-user windows, unheard items a cross product
minus what was heard, and naive Bayes its closed form.
"""

from __future__ import annotations

TABLES = r"""
raw0 AS (
  SELECT event_id, ts, user_id AS uid, event_type,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events
),
raw AS (
  SELECT event_id,
         printf('user_%06d', CAST(uid AS BIGINT)) AS "user",
         ts,
         CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms,
         CASE WHEN event_type = 'signup' AND k % 10 = 0 THEN ''
              ELSE printf('art_%03d', k) END AS "artistId",
         'Artist ' || k AS artist,
         CASE WHEN event_type = 'error' THEN ''
              ELSE printf('song_%03d', k) || '_' || event_type END AS "songId",
         'Song ' || k || ' ' || event_type AS song
  FROM raw0
),
plays AS (
  SELECT *,
         CAST(substring("user", 6) AS INTEGER) AS user_id,
         CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week,
         CAST(hour(ts) AS INTEGER) AS hour_of_day
  FROM raw WHERE "artistId" <> '' AND "songId" <> ''
),
profile_fields AS (
  SELECT printf('user_%06d', CAST(c_custkey AS BIGINT)) AS "user",
         CASE c_mktsegment WHEN 'BUILDING' THEN 'm' WHEN 'AUTOMOBILE' THEN 'M'
                           WHEN 'MACHINERY' THEN 'f' ELSE '' END AS gender,
         CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE 15 + c_custkey % 60 END AS INTEGER) AS age,
         n_name AS country,
         CAST(o.first_order AS DATE) AS registered
  FROM customer
  JOIN nation ON n_nationkey = c_nationkey
  JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) o
    ON o.o_custkey = c_custkey
  WHERE c_custkey % 10 <> 7
)
"""


def hash31(text: str) -> str:
    return (
        f"CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({text}, ''), "
        "lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) & 4294967295) & 2147483647 AS INTEGER)"
    )


PROFILES = f"""
country_keys AS (
  SELECT country, {hash31('country')} AS country_id FROM (SELECT DISTINCT country FROM profile_fields)
),
profiles AS (
  SELECT "user", gender, age, p.country, registered,
         CAST(substring("user", 6) AS INTEGER) AS user_id,
         CASE lower(gender) WHEN 'm' THEN 1 WHEN 'f' THEN 2 ELSE 0 END AS gender_id,
         k.country_id
  FROM profile_fields p JOIN country_keys k ON k.country = p.country
)
"""

SESSIONS = """
lagged AS (
  SELECT *, lag(ts_ms) OVER (PARTITION BY "user" ORDER BY ts_ms, "artistId", "songId", event_id) AS pts FROM plays
),
flagged AS (
  SELECT *, ts_ms - pts AS pdiff,
         CASE WHEN pts IS NULL OR ts_ms - pts > 1200000 THEN 1 ELSE 0 END AS is_new_session
  FROM lagged
),
sessions AS (
  SELECT *, CAST(sum(is_new_session) OVER (PARTITION BY "user" ORDER BY ts_ms) AS BIGINT) AS user_session_id
  FROM flagged
),
lengths AS (
  SELECT "user", user_session_id, max(ts_ms) - min(ts_ms) AS session_length
  FROM sessions GROUP BY "user", user_session_id
)
"""

SPLIT = "('0x' || substring(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 10 < 6"

NEXT_SONG = f"""
song_keys AS (
  SELECT "songId" AS sid, {hash31('"songId"')} AS song_key FROM (SELECT DISTINCT "songId" FROM plays)
),
followed AS (
  SELECT *, lead("songId") OVER (PARTITION BY "user" ORDER BY ts_ms, "artistId", "songId", event_id) AS next_songId
  FROM plays
),
described AS (
  SELECT f.event_id, f.user_id, f."user", f.ts_ms, f."songId", s.song_key AS song_id,
         coalesce(p.country_id, 0) AS country_id, coalesce(p.gender_id, 0) AS gender_id,
         coalesce(p.age, 0) AS age, f.next_songId, n.song_key AS next_song_id
  FROM followed f
  JOIN song_keys s ON s.sid = f."songId"
  LEFT JOIN song_keys n ON n.sid = f.next_songId
  LEFT JOIN profiles p ON p.user_id = f.user_id
),
examples AS (SELECT * FROM described WHERE next_songId IS NOT NULL),
last_plays AS (
  SELECT * FROM described QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, "songId" DESC) = 1
)
"""

# Every gap before a play is its own class.
EXACT_GAPS = """
lagged AS (
  SELECT *, lag(ts_ms) OVER (PARTITION BY "user" ORDER BY ts_ms, "artistId", "songId", event_id) AS pts FROM plays
),
examples AS (
  SELECT *, coalesce(ts_ms - pts, 0) AS gap_ms, lpad(CAST(coalesce(ts_ms - pts, 0) AS VARCHAR), 19, '0') AS bucket FROM lagged
),
last_plays AS (
  SELECT * FROM plays QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, "songId" DESC) = 1
)
"""

NEXT_TIME = """
followed AS (
  SELECT *, lead(ts_ms) OVER (PARTITION BY "user" ORDER BY ts_ms, "artistId", "songId", event_id) AS nts FROM plays
),
examples AS (SELECT *, nts - ts_ms AS gap_ms, lpad(CAST((nts - ts_ms) // 3600000 AS VARCHAR), 19, '0') AS bucket FROM followed WHERE nts IS NOT NULL),
last_plays AS (
  SELECT * FROM plays QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, "songId" DESC) = 1
)
"""


def bayes(label: str, features: list[str], points: str, key: str) -> str:
    """CTEs ending in ``predicted(key, label)``: the class of the highest posterior."""
    sums = ", ".join(f"sum({f})::DOUBLE AS s_{f}" for f in features)
    mass = " + ".join(f"s_{f}" for f in features)
    d = len(features)
    weights = ", ".join(f"ln(s_{f} + 1.0) - ln({mass} + {d}.0) AS w_{f}" for f in features)
    score = " + ".join(f"w.w_{f} * p.{f}" for f in features)
    return f"""
totals AS (
  SELECT CAST({label} AS VARCHAR) AS label, count(*) AS n, {sums} FROM examples WHERE {SPLIT} GROUP BY 1
),
weights AS (
  SELECT label, ln(n + 1.0) - ln((SELECT sum(n) + count(*) FROM totals)) AS prior, {weights} FROM totals
),
scored AS (
  SELECT p.{key} AS key, w.label, w.prior + {score} AS score FROM ({points}) p CROSS JOIN weights w
),
predicted AS (
  SELECT key, label FROM scored QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, label) = 1
)
"""


SONG_FEATURES = ["user_id", "song_id", "country_id", "gender_id", "age"]
TIME_FEATURES = ["user_id", "day_of_week", "hour_of_day"]


def sql(final: str, *parts: str) -> str:
    return "WITH " + ",".join([TABLES, *parts]) + final


def _accuracy(label: str) -> str:
    return f"""
SELECT correct, total, correct / total AS accuracy FROM (
  SELECT CAST(count(*) FILTER (WHERE p.label = CAST(e.{label} AS VARCHAR)) AS BIGINT) AS correct,
         CAST(count(*) AS BIGINT) AS total
  FROM examples e JOIN predicted p ON p.key = e.event_id
)
"""


def _dimension(key: str, names: list[str]) -> str:
    kept = ", ".join(f'"{name}"' for name in [key, *names])
    order = ", ".join(f'"{name}" DESC' for name in ["ts_ms", *names])
    return f'SELECT {kept} FROM plays QUALIFY row_number() OVER (PARTITION BY "{key}" ORDER BY {order}) = 1'


def _ratings(key: str) -> str:
    return f'SELECT user_id, "{key}", count(*) AS play_count FROM plays GROUP BY user_id, "{key}"'


def _unheard(key: str) -> str:
    return f"""
SELECT u.user_id, i."{key}"
FROM (SELECT DISTINCT user_id FROM plays) u CROSS JOIN (SELECT DISTINCT "{key}" FROM plays) i
WHERE NOT EXISTS (SELECT 1 FROM plays p WHERE p.user_id = u.user_id AND p."{key}" = i."{key}")
"""


def _unheard_ranges(key: str) -> str:
    """Runs of numbers in the order of the first three hex digits of the item's MD5, then the item."""
    return f"""
, numbered AS (
  SELECT "{key}", row_number() OVER (ORDER BY substring(md5("{key}"), 1, 3), "{key}") - 1 AS number
  FROM (SELECT DISTINCT "{key}" FROM plays)
),
unheard AS (
  SELECT u.user_id, number - row_number() OVER (PARTITION BY u.user_id ORDER BY number) AS run, number
  FROM (SELECT DISTINCT user_id FROM plays) u CROSS JOIN numbered i
  WHERE NOT EXISTS (SELECT 1 FROM plays p WHERE p.user_id = u.user_id AND p."{key}" = i."{key}")
)
SELECT user_id, min(number) AS low, max(number) AS high FROM unheard GROUP BY user_id, run
"""


def _recommend_check(key: str) -> str:
    """Every user gets five items, or as many as they have not heard."""
    return f"""
SELECT user_id, least(5, (SELECT count(DISTINCT "{key}") FROM plays) - count(DISTINCT "{key}")) AS n_items,
       true AS ranks_run, true AS scores_fall, true AS none_heard
FROM plays GROUP BY user_id
"""


# Songs that only new users played are unknown to the model.
_RECOMMEND_NEW = """
, known AS (SELECT DISTINCT "songId" FROM plays WHERE user_id % 3 <> 0)
SELECT user_id, least(5, (SELECT count(*) FROM known) - count(DISTINCT known."songId")) AS n_items,
       true AS ranks_run, true AS scores_fall, true AS none_heard
FROM plays LEFT JOIN known USING ("songId") GROUP BY user_id
"""


_ASKED = """
asked AS (
  SELECT user_id FROM plays GROUP BY "user", user_id ORDER BY count(DISTINCT "songId") DESC, "user" LIMIT 10
)
"""

_SESSION_ROWS = 'SELECT event_id, "user", ts_ms, pts, pdiff, is_new_session, user_session_id FROM sessions'

# Least squares by Cramer's rule on the covariances of three features.
_LINEAR = """
, moments AS (
  SELECT avg(user_id) AS mx, avg(day_of_week) AS my, avg(hour_of_day) AS mz, avg(gap_ms) AS mg,
         covar_pop(user_id, user_id) AS xx, covar_pop(user_id, day_of_week) AS xy,
         covar_pop(user_id, hour_of_day) AS xz, covar_pop(day_of_week, day_of_week) AS yy,
         covar_pop(day_of_week, hour_of_day) AS yz, covar_pop(hour_of_day, hour_of_day) AS zz,
         covar_pop(user_id, gap_ms) AS xg, covar_pop(day_of_week, gap_ms) AS yg,
         covar_pop(hour_of_day, gap_ms) AS zg
  FROM examples
),
solved AS (
  SELECT mx, my, mz, mg,
         (xg*(yy*zz - yz*yz) - xy*(yg*zz - yz*zg) + xz*(yg*yz - yy*zg)) / det AS bx,
         (xx*(yg*zz - yz*zg) - xg*(xy*zz - yz*xz) + xz*(xy*zg - yg*xz)) / det AS by_,
         (xx*(yy*zg - yg*yz) - xy*(xy*zg - yg*xz) + xg*(xy*yz - yy*xz)) / det AS bz
  FROM (SELECT *, xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz) AS det FROM moments)
)
"""

_LINEAR_GAP = "mg + bx * (user_id - mx) + by_ * (day_of_week - my) + bz * (hour_of_day - mz)"

_LINEAR_PREDICTION = f"""
SELECT user_id, "user",
       ts AS last_ts, gap_s AS predicted_gap_s, ts + to_microseconds(gap_s * 1000000) AS predicted_ts
FROM (SELECT *, CAST(round(round({_LINEAR_GAP}) / 1000) AS BIGINT) AS gap_s FROM last_plays CROSS JOIN solved)
"""

_PREDICTED_TIME = f"""
SELECT l.user_id, l."user", l.ts AS last_ts, m.gap AS predicted_gap_ms,
       l.ts + to_microseconds(m.gap * 1000) AS predicted_ts
FROM last_plays l JOIN predicted p ON p.key = l.user_id
JOIN (SELECT CAST(bucket AS VARCHAR) AS label, CAST(floor(quantile_cont(gap_ms, 0.5)) AS BIGINT) AS gap
      FROM examples WHERE {SPLIT} GROUP BY bucket) m ON m.label = p.label
"""

_LINEAR_ERROR = f"""
SELECT CAST(round(sqrt(avg(pow({_LINEAR_GAP} - gap_ms, 2))) / 1000) AS BIGINT) AS rmse_s
FROM examples CROSS JOIN solved
"""

ORACLE: dict[str, str] = {
    "scan_play_log": sql(
        f"""
SELECT "user", CAST(epoch_us(ts) // 1000000 * 1000 AS BIGINT) AS ts_ms, "artistId", artist, "songId", song, user_id,
       {hash31('"artistId"')} AS artist_id, {hash31('"songId"')} AS song_id
FROM plays"""
    ),
    "scan_user_profiles": sql('SELECT "user", gender, age, country, registered FROM profile_fields'),
    "rejected_lines": sql(
        """
SELECT 'plays' AS file, CASE WHEN "artistId" = '' THEN 'no artist id' ELSE 'no song id' END AS reason, count(*) AS n_lines
FROM raw WHERE "artistId" = '' OR "songId" = '' GROUP BY ALL
UNION ALL
SELECT 'profiles', 'not five fields', 1 + (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey)
                                      - (SELECT count(*) FROM profile_fields)
UNION ALL SELECT 'profiles', 'comment', 1 UNION ALL SELECT 'profiles', 'blank line', 1"""
    ),
    "identified_plays": sql('SELECT event_id, "user", ts_ms, "artistId", "songId" FROM plays'),
    "user_dimension": sql('SELECT "user", user_id, gender_id, age, country_id FROM profiles', PROFILES),
    "hash_key31": sql(
        f"""
SELECT text, {hash31('text')} AS hash_key
FROM (SELECT "songId" AS text FROM plays UNION SELECT "artistId" FROM plays)"""
    ),
    "play_calendar": sql("SELECT event_id, day_of_week, hour_of_day FROM plays"),
    "unique_users": sql('SELECT DISTINCT "user" FROM plays ORDER BY "user"'),
    "unique_users_raw": sql('SELECT DISTINCT "user" FROM raw'),
    "top_users": sql(
        """
SELECT "user" AS "userName", count(DISTINCT "songId") AS "songCount"
FROM plays GROUP BY "user" ORDER BY 2 DESC, 1 LIMIT 10"""
    ),
    "top_songs": sql(
        'SELECT "songId", count(*) AS "playCount" FROM plays GROUP BY "songId" ORDER BY 2 DESC, 1 LIMIT 10'
    ),
    "play_gaps": sql('SELECT event_id, "user", ts_ms, pts, pdiff FROM flagged', SESSIONS),
    "sessionize": sql(_SESSION_ROWS, SESSIONS),
    "sessions_sql": sql(_SESSION_ROWS, SESSIONS),
    "session_lengths": sql('SELECT "user", user_session_id, session_length FROM lengths', SESSIONS),
    "top_sessions": sql(
        """
SELECT s.user_session_id AS "sessionId", b.session_length AS "sessionLength", s."user", s.artist, s.song
FROM sessions s
JOIN (SELECT * FROM lengths ORDER BY session_length DESC, "user", user_session_id LIMIT 20) b
  ON b."user" = s."user" AND b.user_session_id = s.user_session_id
ORDER BY b.session_length DESC, s."user", s.user_session_id, s.ts_ms, s."artistId", s."songId", s.event_id""",
        SESSIONS,
    ),
    "artist_dimension": sql(_dimension("artistId", ["artist"])),
    "song_dimension": sql(_dimension("songId", ["artistId", "artist", "song"])),
    "artist_ratings": sql(_ratings("artistId")),
    "song_ratings": sql(_ratings("songId")),
    "plays_with_profile": sql(
        """
SELECT y.event_id, y.user_id, y."songId", p.gender, coalesce(p.age, 0) AS age, p.country,
       coalesce(p.gender_id, 0) AS gender_id, coalesce(p.country_id, 0) AS country_id
FROM plays y LEFT JOIN profiles p ON p.user_id = y.user_id""",
        PROFILES,
    ),
    "last_play_by_user": sql(
        """
SELECT user_id, "user", ts_ms, "artistId", "songId" FROM plays
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, "songId" DESC, "artistId" DESC) = 1"""
    ),
    "unheard_artists": sql(_unheard("artistId")),
    "unheard_songs": sql(_unheard("songId")),
    "lasting_song_numbers": sql(
        """
, songs AS (SELECT "songId", bool_or(hour_of_day < 2) AS early, substring(md5("songId"), 1, 3) AS bucket FROM plays GROUP BY "songId")
SELECT "songId", row_number() OVER (ORDER BY early DESC, bucket, "songId") - 1 AS item_index FROM songs"""
    ),
    "unheard_artist_ranges": sql(_unheard_ranges("artistId")),
    "unheard_song_ranges": sql(_unheard_ranges("songId")),
    "recommend_artists_check": sql(_recommend_check("artistId")),
    "recommend_songs_check": sql(_recommend_check("songId")),
    "recommend_new_users_check": sql(_RECOMMEND_NEW),
    "last_play_of_asked": sql(
        """
SELECT user_id, "user", ts_ms, "artistId", "songId" FROM plays JOIN asked USING (user_id)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, "songId" DESC, "artistId" DESC) = 1""",
        _ASKED,
    ),
    "unheard_songs_of_asked": sql(f"SELECT * FROM ({_unheard('songId')}) JOIN asked USING (user_id)", _ASKED),
    "next_song_pairs": sql(
        'SELECT event_id, "user", ts_ms, "songId", next_songId AS "next_songId" FROM examples', PROFILES, NEXT_SONG
    ),
    "next_song_examples": sql(
        """
SELECT event_id, user_id, song_id, country_id, gender_id, age, next_songId AS "next_songId", next_song_id
FROM examples""",
        PROFILES,
        NEXT_SONG,
    ),
    "train_test_split": sql(f"SELECT event_id, {SPLIT} AS is_train FROM plays"),
    "predict_next_song": sql(
        f"""
SELECT l.user_id, l."user", d."artistId", d.artist, d."songId", d.song
FROM last_plays l JOIN predicted p ON p.key = l.user_id
JOIN ({_dimension("songId", ["artistId", "artist", "song"])}) d ON d."songId" = p.label""",
        PROFILES,
        NEXT_SONG,
        bayes("next_songId", SONG_FEATURES, "SELECT * FROM last_plays", "user_id"),
    ),
    "next_song_accuracy": sql(
        _accuracy("next_songId"),
        PROFILES,
        NEXT_SONG,
        bayes("next_songId", SONG_FEATURES, f"SELECT * FROM examples WHERE NOT ({SPLIT})", "event_id"),
    ),
    "gap_examples": sql(
        "SELECT event_id, user_id, day_of_week, hour_of_day, coalesce(pdiff, 0) AS pdiff FROM flagged", SESSIONS
    ),
    "forward_gap_examples": sql("SELECT event_id, user_id, day_of_week, hour_of_day, gap_ms FROM examples", NEXT_TIME),
    "predict_next_play_time": sql(
        _PREDICTED_TIME, NEXT_TIME, bayes("bucket", TIME_FEATURES, "SELECT * FROM last_plays", "user_id")
    ),
    "predict_next_play_time_stored": sql(
        _PREDICTED_TIME, NEXT_TIME, bayes("bucket", TIME_FEATURES, "SELECT * FROM last_plays", "user_id")
    ),
    "changed_models": sql(
        """
SELECT model, 1::INTEGER AS version, trained_plays, plays, trained_plays <> plays AS changed
FROM (SELECT count(*) AS plays, count(*) FILTER (user_id % 3 <> 0) AS older FROM plays),
     LATERAL (VALUES ('next_time', older), ('next_song', plays)) AS kept(model, trained_plays)"""
    ),
    "predict_next_play_time_exact": sql(
        _PREDICTED_TIME, EXACT_GAPS, bayes("bucket", TIME_FEATURES, "SELECT * FROM last_plays", "user_id")
    ),
    "next_time_accuracy": sql(
        _accuracy("bucket"),
        NEXT_TIME,
        bayes("bucket", TIME_FEATURES, f"SELECT * FROM examples WHERE NOT ({SPLIT})", "event_id"),
    ),
    "next_time_linear": sql(_LINEAR + _LINEAR_PREDICTION, NEXT_TIME),
    "next_time_linear_error": sql(_LINEAR + _LINEAR_ERROR, NEXT_TIME),
}

# The same questions asked in SQL.
ORACLE |= {
    f"{name}_sql": ORACLE[name] for name in ("top_users", "top_songs", "top_sessions", "session_lengths")
} | {"last_plays_sql": ORACLE["last_play_by_user"]}
