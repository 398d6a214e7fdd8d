"""SQL (DuckDB's) for the queries that SQL can express, over the driver tables."""

from __future__ import annotations

from pictorium.llm import fill_in_middle, near_duplicates, quality_rules, resampling, secret_scans

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the digits of base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  k AS (SELECT *, sha1(html) AS hex, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS least FROM p)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('{_BASE32}', CAST((CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) >> s) & 31 AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = least OR n < 0 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM k"""


def _rule(rule: quality_rules.Rule) -> str:
    value = quality_rules.MEASURES[rule.measure].removeprefix("try_divide(").removesuffix(")").replace(", ", "::DOUBLE / nullif(") + ", 0)"
    parts = [f"{value} >= {rule.low}"] * (rule.low is not None) + [f"{value} <= {rule.high}"] * (rule.high is not None)
    return f"(n_words < {max(rule.words, 1)} OR coalesce({' AND '.join(parts) or 'true'}, true))"


RULES = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
  windows AS (SELECT doc_id, i, words[i:i + 4] AS win FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
  covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
  lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
  c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(words, lambda x: list_contains({quality_rules.STOP_WORDS}, lower(x)))) AS n_stop_words FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id),
  j AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(map(_rule, quality_rules.RULES))} AS kept FROM j"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS words FROM documents),
  sets AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w),
  rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM rows_ a JOIN rows_ b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM pairs WHERE 100 * c >= {near_duplicates.SIMILARITY_PERCENT} * (na + nb - c)),
  both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(origin, node) AS (SELECT doc_id, doc_id FROM w UNION SELECT origin, b FROM reach JOIN both_ ON a = node),
  comp AS (SELECT origin AS doc_id, min(node) AS component_id FROM reach GROUP BY 1)
  SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sets s JOIN comp ON comp.doc_id = s.doc_id"""


def _either(words: str) -> str:
    """An expression for words in ASCII letters of either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS steps)"


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8, by its bytes' hexadecimal digits; `steps` is the table's column."""
    codes = f"list_transform(range(CAST(strlen({text}) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, steps[CAST(xor(c & 255, b) + 1 AS INT)]), 4294967295), 4294967295)"


_ASSIGN = f"(?:{_either('pass')}(?:{_either('word')}|{_either('wd')})|{_either('secret')}|{_either('token')}|{_either('api_?key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_TOKEN_HOLDS = f"strlen(body) = {secret_scans.TOKEN} AND substr(body, 31) = array_to_string(list_transform([5, 4, 3, 2, 1, 0], lambda k: substr('{secret_scans.BASE62}', CAST((crc // CAST(pow(62, k) AS BIGINT)) % 62 + 1 AS INT), 1)), '')"
#: Kind, expression, group that the condition reads, condition.
_SECRETS = [("assign", _ASSIGN, 1, f"strlen(body) >= {secret_scans.LEAST_VALUE}"), ("access", "AKIA[A-Z0-9]+", 0, f"strlen(body) >= {secret_scans.LEAST_ACCESS}"), ("hex", "[0-9a-f]+", 0, f"strlen(body) >= {secret_scans.LEAST_HEX}"),
            ("github", "gh[pousr]_([A-Za-z0-9]+)", 1, _TOKEN_HOLDS), ("npm", "npm_([A-Za-z0-9]+)", 1, _TOKEN_HOLDS)]


def _secrets(nth: int) -> str:
    """The spans of one kind: what lies between the matches and the matches themselves give their places."""
    kind, expression, group, holds = _SECRETS[nth]
    rows = f"SELECT doc_id, regexp_extract_all(text, '{expression}') AS found, regexp_split_to_array(text, '{expression}') AS gaps FROM d"
    listed = f"SELECT doc_id, unnest(found) AS match, unnest(gaps[1:len(found)]) AS gap, unnest(range(len(found))) AS i FROM ({rows})"
    each = f"SELECT doc_id, match, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY i) - length(match) AS start FROM ({listed})"
    bodies = f"SELECT doc_id, start, start + length(match) AS stop, regexp_extract(match, '^{expression}', {group}) AS body FROM ({each})"
    summed = f"SELECT *, {_crc('substr(body, 1, 30)')} AS crc FROM ({bodies}), crc_table" if holds == _TOKEN_HOLDS else bodies
    return f"SELECT doc_id, {nth} AS nth, '{kind}' AS kind, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM ({summed}) WHERE {holds}"


_SHOWN = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth)"
SECRETS = f"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(map(_secrets, range(len(_SECRETS))))}),
  k AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name in secret_scans.BASE)}, {_SHOWN} FILTER (nth < {len(secret_scans.BASE)}) AS base, {_SHOWN} AS spans FROM s GROUP BY doc_id)
  SELECT d.doc_id, {', '.join(f'CAST(coalesce(n_{name}, 0) AS BIGINT) AS n_{name}' for name in secret_scans.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


def _features(source: str, key: str) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"SELECT key, len(words) AS n_words, unnest(words || list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM (SELECT {key} AS key, {words} AS words FROM {source})"


RESAMPLING = f"""WITH {_CRC_TABLE}, f AS ({_features('documents', 'doc_id')}), g AS ({_features('benchmark', 'item_id')}),
  known AS (SELECT feature, CAST({_crc('feature')} % {resampling.BUCKETS} AS BIGINT) AS bucket FROM (SELECT feature FROM f UNION SELECT feature FROM g), crc_table),
  s AS (SELECT bucket, count(*) AS n FROM f JOIN known ON known.feature = f.feature GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM g JOIN known ON known.feature = g.feature GROUP BY 1),
  all_ AS (SELECT CAST((SELECT count(*) FROM f) + {resampling.BUCKETS} AS DOUBLE) AS s, CAST((SELECT count(*) FROM g) + {resampling.BUCKETS} AS DOUBLE) AS t),
  gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * all_.s / ((s.n + 1) * all_.t))) AS gain FROM s LEFT JOIN t ON t.bucket = s.bucket, all_),
  w AS (SELECT key, any_value(n_words) AS n_words, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM f JOIN known ON known.feature = f.feature JOIN gain ON gain.bucket = known.bucket GROUP BY 1),
  h AS (SELECT doc_id, CAST('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents),
  p AS (SELECT h.doc_id, coalesce(n_words, 0) >= {resampling.LEAST_WORDS} AS fit, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h LEFT JOIN w ON w.key = h.doc_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) * {resampling.SHARE} // 100 AS quota FROM p)
  SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= quota THEN place END AS rank FROM r"""

_PREFIX, _SUFFIX, _MIDDLE = (s.decode() for s in (fill_in_middle.PREFIX, fill_in_middle.SUFFIX, fill_in_middle.MIDDLE))
_DRAWS = ", ".join(f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
FILL_IN_MIDDLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('{fill_in_middle.SEED}:' || doc_id) AS digest FROM documents),
  h AS (SELECT *, len(lines) AS n, {_DRAWS} FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{_PREFIX}') OR contains(text, '{_SUFFIX}') OR contains(text, '{_MIDDLE}') OR h3 % 100 >= {fill_in_middle.RATE} THEN 'plain' WHEN h4 % 100 < {fill_in_middle.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
  s AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix FROM c)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_PREFIX}' || prefix || '{_SUFFIX}' || suffix || '{_MIDDLE}' || middle ELSE '{_SUFFIX}' || suffix || '{_PREFIX}' || prefix || '{_MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM s"""

ORACLE_SQL = {"op5_warc": WARC, "op8_quality_rules": RULES, "op9_near_duplicates": NEAR, "op11_secret_scans": SECRETS, "op12_resampling": RESAMPLING, "op13_fill_in_middle": FILL_IN_MIDDLE}
