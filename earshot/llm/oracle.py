"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from earshot.llm import licenses, quality, spellings


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OP5 = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS raw_lines,
         list_filter(list_transform(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)),
                     lambda l: trim(l, ' ')), lambda l: l <> '') AS lines
  FROM texts),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM worded WHERE len(words) > 2)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
hashed AS (
  SELECT doc_id, host, list_transform(lines, lambda l: ('0x' || md5(l)[:15])::bigint) AS hashes,
         list_transform(lines, lambda l: len(l) - len(replace(l, ' ', '')) + 1) AS counts FROM worded),
lined AS (SELECT doc_id, host, md5(array_to_string(hashes, ' ')) AS document, unnest(list_distinct(hashes)) AS line FROM hashed),
marked AS (SELECT host, line, document, min(doc_id) AS first_id FROM lined GROUP BY ALL),
hosts AS (SELECT host, count(*) AS n FROM texts GROUP BY host),
frequent AS (
  SELECT host, line, first_id
  FROM (SELECT host, line, count(*) AS n, min(first_id) AS first_id FROM marked GROUP BY host, line) AS counted JOIN hosts USING (host)
  WHERE counted.n >= {quality.MIN_DOCUMENTS} AND counted.n > {quality.MAX_SHARE} * hosts.n),
located AS (SELECT doc_id, host, unnest(hashes) AS line, unnest(counts) AS words FROM hashed),
left_over AS (
  SELECT doc_id, sum(words) AS words, coalesce(sum(words) FILTER (frequent.line IS NOT NULL AND doc_id <> first_id), 0) AS removed
  FROM located LEFT JOIN frequent USING (host, line) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(words)::bigint AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
         (len(raw_lines) - len(list_distinct(raw_lines)))::bigint AS n_dup_lines,
         coalesce(covered.n, 0)::bigint AS n_repeat_words
  FROM worded LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed
  FROM base)
SELECT judged.*, NOT base_failed
  AND NOT coalesce(removed > 0 AND 100 * (words - removed) < {quality.MIN_LEFT_PERCENT} * words, false) AS kept
FROM judged LEFT JOIN left_over USING (doc_id)
"""

OP6 = r"""
WITH bytes AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS b
  FROM documents),
ranked AS (
  SELECT doc_id, b, first_value(doc_id) OVER (PARTITION BY b ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY b) AS group_size FROM bytes)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(b) AS text_sha256 FROM ranked
"""


def _canonical(text: str) -> str:
    plain = f"lower({text})"
    for other, one in licenses.SPELLINGS.items():
        plain = f"replace({plain}, {_text(other)}, {_text(one)})"
    plain = f"regexp_replace({plain}, {_text(licenses.COPYRIGHT_LINE)}, '', 'g')"
    plain = rf"regexp_replace({plain}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    return f"list_filter(list_transform(string_split({plain}, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '')"


OP7 = f"""
WITH known AS (
  SELECT md5(array_to_string({_canonical("text")}, ' ')) AS digest, min(license) AS license
  FROM (VALUES {", ".join(f"({_text(name)}, {_text(text)})" for name, text in licenses.KNOWN)}) AS t(license, text)
  GROUP BY 1),
lines AS (SELECT doc_id, {_canonical("coalesce(text, '')")} AS lines FROM documents),
whole AS (
  SELECT doc_id, license FROM lines LEFT JOIN known ON len(lines) > 0 AND md5(array_to_string(lines, ' ')) = digest),
by_line AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n
  FROM (SELECT doc_id, unnest(lines) AS line FROM lines) JOIN known ON md5(line) = digest GROUP BY doc_id)
SELECT doc_id, license, coalesce(names, '') AS line_licenses, coalesce(n, 0)::bigint AS n_license_lines
FROM whole LEFT JOIN by_line USING (doc_id)
"""

# Base32 of a SHA-1: five hex digits are four letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * group + 1}, 5))::BIGINT >> {shift}) & 31)::INTEGER + 1, 1)"
    for group in range(8)
    for shift in (15, 10, 5, 0)
)

OP4 = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages),
hashed AS (SELECT *, sha1(payload) AS h FROM payloads)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to,
       CASE WHEN page_id = latest THEN true END AS intact
FROM hashed
"""

# CRC-32 of the bytes b (a list), with its table of 256 entries t.
CRC_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) AS r(i)))
"""
CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[1 + (xor(c, x) & 255)])), 4294967295)"


def _bytes(text: str) -> str:
    return f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"


_NEVER = "{'c': 1000000, 's': '', 't': NULL}"


def _way(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """Cost, audit and text of a state after one more edit."""
    text = f"{state}.t" if line is None else f"CASE WHEN {state}.t IS NULL THEN {line} ELSE {state}.t || chr(10) || {line} END"
    return f"{{'c': {state}.c + {cost}, 's': {state}.s || '{letter}', 't': {text}}}"


def _insert(state: str, role: str) -> str:
    return _way(state, "5", "I", f"'{role}:'")


def _rerole(state: str, role: str) -> str:
    return _way(state, "1 + extra", "R", f"'{role}:' || text")


def _keep(state: str, initial: str) -> str:
    return f"CASE WHEN initial = '{initial}' THEN {_way(state, 'extra', 'K', 'role || chr(58) || text')} ELSE {_NEVER} END"


def _row(stays: list[str], state: str) -> str:
    gone = _way(state, "2", "D")
    return f"CASE WHEN must_go THEN {gone} ELSE least({', '.join([gone, *stays])}) END"


_INSERTED_USER = f"least(u, {_insert('e', 'user')}, {_insert('s', 'user')}, {_insert('a', 'user')})"

OP11 = rf"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
keyed AS (SELECT *, {CRC} % 20 AS kind FROM (SELECT *, {_bytes("key")} AS b FROM given), crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64),
                               md5(length(role) || ':' || role || text), copy) AS i FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
         i > min(i) OVER (PARTITION BY conv_id, role, text) AS seen,
         NOT regexp_matches(text, '[.!?][ 	-
]*$') AS unended,
         left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM placed),
turns AS (SELECT *, blank OR seen AS must_go, CASE WHEN unended THEN 5 ELSE 0 END AS extra FROM judged),
told AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
         count(*) FILTER (unended AND NOT seen AND NOT blank) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 's': ''::VARCHAR, 't': NULL::VARCHAR}} AS e,
         {{'c': 1000000::BIGINT, 's': ''::VARCHAR, 't': NULL::VARCHAR}} AS s, s AS u, s AS a
  FROM (SELECT DISTINCT conv_id FROM given)
  UNION ALL
  SELECT conv_id, i, {_row([], "e")}, {_row([_keep("e", "s")], "s")},
         {_row([way for state in "esa" for way in (_keep(state, "u"), _rerole(state, "user"))], "u")},
         {_row([_keep("u", "a"), _rerole("u", "assistant")], "a")}
  FROM (
    SELECT turns.conv_id, turns.i, must_go, extra, initial, role, text, e, s, u, least(a, {_insert("u", "assistant")}) AS a
    FROM (SELECT conv_id, i, e, s, {_INSERTED_USER} AS u, a FROM ways) AS w
    JOIN turns ON turns.conv_id IS NOT DISTINCT FROM w.conv_id AND turns.i = w.i + 1)),
ended AS (
  SELECT conv_id, i, least(e, a, {_insert("u", "assistant")}) AS best
  FROM (SELECT conv_id, i, e, a, {_INSERTED_USER} AS u FROM ways))
SELECT ended.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.s AS audit,
       sha256(coalesce(best.t, '')) AS repaired_sha256
FROM ended LEFT JOIN told ON ended.conv_id IS NOT DISTINCT FROM told.conv_id WHERE i = coalesce(n, 0)
"""

OP13 = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {spellings.MIN_LENGTH}),
hashed AS (SELECT run, {CRC} AS h FROM (SELECT *, {_bytes("key")} AS b FROM runs), crc_table),
written AS (
  SELECT CASE WHEN h % {spellings.DAMAGED_RUN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
vocabulary AS (
  SELECT word, count(*) AS n FROM written WHERE length(word) >= {spellings.MIN_LENGTH} GROUP BY word HAVING count(*) >= {spellings.MIN_COUNT}),
shortened AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shortened a JOIN shortened b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM shortened a JOIN vocabulary v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM shortened a JOIN vocabulary v ON a.rest = v.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spellings.RATIO} * n THEN other END AS form,
         CASE WHEN other_n >= {spellings.RATIO} * n THEN other_n END AS form_n
  FROM vocabulary LEFT JOIN best USING (word)),
chains AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT formed.word, chains.root FROM formed JOIN chains ON formed.form = chains.word)
SELECT word, n::BIGINT AS n, n_near::BIGINT AS n_near, form, form_n::BIGINT AS form_n, root FROM formed JOIN chains USING (word)
"""

ORACLE: dict[str, str] = {
    "op4_warc": OP4,
    "op5_quality_rules": OP5,
    "op6_exact_dedup": OP6,
    "op7_license_scan": OP7,
    "op11_conversation_repair": OP11,
    "op13_spelling_variants": OP13,
}
