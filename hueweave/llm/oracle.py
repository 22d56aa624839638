"""DuckDB SQL of the operators that SQL can express: mixing, quality rules, sharding, chat formatting."""

from __future__ import annotations

from hueweave.llm.chat import Template
from hueweave.llm.quality import COMMON_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_KEY = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"

MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM d GROUP BY source),
weighted AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
    2 * CAST(source_size AS DOUBLE) AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM per),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r,
    (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
filled AS (SELECT (SELECT arg_min(level, r) FROM levels WHERE cap / weight > level) AS fill),
targets AS (SELECT source, source_size, CASE WHEN fill IS NULL THEN cap ELSE least(cap, weight * fill) END AS target, CAST(floor(sqrt(CAST(source_rows AS DOUBLE)) / 8 + 1) AS BIGINT) AS chunks FROM levels, filled),
placed AS (
  SELECT d.doc_id, d.source, d.size, source_size, target, length(bin(d.size)) AS class, {_KEY.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % chunks AS chunk
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, chunk, size, doc_id NULLS FIRST) AS i FROM placed),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, {_KEY.format("'mix:' || coalesce(source, '')")} / 4294967296.0::DOUBLE AS start FROM ranked)
SELECT doc_id, size, source_size, target, CAST(floor(i::DOUBLE * rate + start) - floor((i::DOUBLE - 1) * rate + start) AS BIGINT) * size AS taken FROM rated
"""

_SPACE = r"[^\x20\x09-\x0D]"
_CLASS = {"digit": "[0-9]", "upper": "[A-Z]", "punct": r"""[.,;:!?''"()\-]""", "symbol": "[#*$%&|<>]"}
_COUNTED = ", ".join(f"length(t) - length(regexp_replace(t, '{x}', '', 'g')) AS {n}" for n, x in _CLASS.items())
_COMMON = ", ".join(f"'{w}'" for w in COMMON_WORDS)
_TERM = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"

QUALITY = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
starts AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM (
    SELECT rid, unnest(range(len(words) - 2)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda j: words[j] || ' ' || words[j + 1] || ' ' || words[j + 2])) AS w FROM d WHERE len(words) > 2)) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat FROM starts, range(3) AS r(k) GROUP BY rid),
c AS MATERIALIZED (
  SELECT rid, doc_id, lang, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, length(t) AS chars, strlen(t) AS octets, {_COUNTED},
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines FROM d),
f AS MATERIALIZED (
  SELECT c.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n_repeat, 0) > 50 * n_words AS base_failed,
    [chars - word_chars, digit, upper, punct, symbol, octets - chars, greatest(0, octets - (chars - word_chars + digit + upper + punct + symbol + octets - chars))] AS classes
  FROM c LEFT JOIN covered USING (rid)),
vocabulary AS (SELECT unnest([{_COMMON}]) AS w),
held AS MATERIALIZED (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(words) AS w FROM c) JOIN vocabulary USING (w) GROUP BY rid, w),
-- shares of each text: kind 0 has the character classes, kind 1 the common words and, as '', all others
shares AS MATERIALIZED (
  SELECT rid, 0 AS kind, CAST(unnest(range(7)) AS VARCHAR) AS x, unnest(classes) AS n FROM f
  UNION ALL SELECT rid, 1, w, n FROM held
  UNION ALL SELECT rid, 1, '', n_words - coalesce((SELECT sum(n) FROM held WHERE held.rid = f.rid), 0) FROM f),
totals AS MATERIALIZED (SELECT rid, kind, sum(n) AS total FROM shares GROUP BY rid, kind),
known AS MATERIALIZED (SELECT lang FROM f JOIN totals USING (rid) WHERE kind = 0 AND lang IS NOT NULL AND NOT base_failed GROUP BY lang HAVING sum(total) > 0),
refs AS MATERIALIZED (
  SELECT lang, kind, x, sum(n) / sum(sum(n)) OVER (PARTITION BY lang, kind) AS q FROM shares JOIN f USING (rid) WHERE NOT base_failed AND lang IN (SELECT lang FROM known) GROUP BY lang, kind, x),
axes AS (SELECT 0 AS kind, CAST(unnest(range(7)) AS VARCHAR) AS x UNION ALL SELECT 1, w FROM vocabulary UNION ALL SELECT 1, ''),
apart AS MATERIALIZED (
  SELECT rid, lang, kind, sqrt(greatest(0, sum(({_TERM.format('p', 'q')} + {_TERM.format('q', 'p')}) / 2))) AS away FROM (
    SELECT t.rid, k.lang, a.kind, coalesce(s.n, 0) / t.total::DOUBLE AS p, coalesce(r.q, 0) AS q
    FROM totals t CROSS JOIN known k JOIN axes a ON a.kind = t.kind LEFT JOIN shares s ON s.rid = t.rid AND s.kind = a.kind AND s.x = a.x LEFT JOIN refs r ON r.lang = k.lang AND r.kind = a.kind AND r.x = a.x
    WHERE t.total > 0) GROUP BY rid, lang, kind),
bare AS (SELECT lang, q AS rest, sqrt(greatest(0, (1 - q - log2((1 + q) / 2) + CASE WHEN q > 0 THEN q * log2(q / ((1 + q) / 2)) ELSE 0 END) / 2)) AS distance FROM refs WHERE kind = 1 AND x = ''),
verdicts AS (
  SELECT f.rid, min(away) FILTER (kind = 0) AS class_distance,
    bool_or(kind = 1 AND CASE WHEN 1 - rest >= 0.05 THEN away <= least(0.6, 0.9 * distance) ELSE away <= 0.6 AND (f.lang IS NULL OR f.lang = apart.lang) END) AS near
  FROM f JOIN apart USING (rid) JOIN bare ON bare.lang = apart.lang GROUP BY f.rid),
judged AS (SELECT f.*, class_distance, near, (lang IS NULL OR lang IN (SELECT lang FROM known)) AND (SELECT count(*) FROM known) > 0 AS judgeable, list_sum(classes) AS total FROM f LEFT JOIN verdicts USING (rid))
SELECT doc_id, n_words, word_chars, CAST(symbol AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (judgeable AND ((total >= 200 AND coalesce(round(class_distance, 6), 0) > 0.3) OR (n_words >= 80 AND NOT coalesce(near, false)))) AS kept
FROM judged
"""

_CRC = """crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS rest FROM range(256) AS r(i))"""


def _crc32(x: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1])), 4294967295)"


SHARD = f"""
WITH {_CRC},
d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, {_crc32("coalesce(text, '')")} AS text_crc32
  FROM documents, crc),
placed AS (SELECT *, bytes + 8 AS size, sum(bytes + 8) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, bytes ROWS UNBOUNDED PRECEDING) AS upto, sum(bytes + 8) OVER () AS total FROM d),
cut AS (SELECT *, CAST(least(23, floor(CAST(2 * upto - size AS DOUBLE) / (2 * total / 24.0::DOUBLE))) AS INT) AS shard FROM placed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, bytes) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM cut
"""


def _escapes(x: str) -> str:
    """How many characters escaping adds: one for each backslash and each control string."""
    return " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in ("\\", *Template().controls))


_ROLE = "replace(replace(role, '%', '%25'), chr(10), '%0A')"
_MARKS = len(Template().head) - len("{role}") + len(Template().tail)
_AFTER = " OR ".join(f"coalesce(before, '') = '{a}' AND role IN ({', '.join(f'{chr(39)}{b}{chr(39)}' for b in bs)})" for a, bs in Template().follows.items())
_IN_ORDER = "ORDER BY turn NULLS FIRST, role, text"

CHAT = f"""
WITH talk AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (SELECT *, lag(role) OVER (PARTITION BY conv_id {_IN_ORDER}) AS before, row_number() OVER (PARTITION BY conv_id {_IN_ORDER}) AS place FROM talk)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_MARKS} + length({_ROLE}) + {_escapes(_ROLE)} + length(text) + {_escapes('text')}) AS BIGINT) AS formatted_chars,
  bool_and({_AFTER}) AND arg_max(role, place) = 'assistant' AS valid
FROM told GROUP BY conv_id
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BOTH = "SELECT a.word, b.word AS other, b.n AS other_n FROM {0} a JOIN {1} b ON a.p = b.p WHERE a.word <> b.word"

VARIANTS = f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UP}', '{_LOW}') AS run FROM documents),
held AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY d, run),
hashed AS MATERIALIZED (SELECT run, n, {_crc32("d || ':' || run")} AS h FROM held, crc),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
skips AS MATERIALIZED (SELECT word, n, substr(word, 1, i) || '|' || substr(word, i + 2) AS p FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
gaps AS MATERIALIZED (SELECT word, n, substr(word, 1, i) || '|' || substr(word, i + 1) AS p FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED ({_BOTH.format('skips', 'skips')} UNION {_BOTH.format('skips', 'gaps')} UNION {_BOTH.format('gaps', 'skips')}),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS i FROM near),
forms AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * words.n THEN other END AS form, CASE WHEN other_n >= 10 * words.n THEN other_n END AS form_n FROM words LEFT JOIN best ON best.word = words.word AND i = 1),
chains AS (SELECT word, word AS root, form AS onward FROM forms UNION ALL SELECT chains.word, forms.word, forms.form FROM chains JOIN forms ON forms.word = chains.onward)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN chains ON chains.word = forms.word AND onward IS NULL
"""

_FAR = 1 << 40


def _option(letter: str, cost: str, at: str | None, line: str = "''") -> str:
    return f"{{'c': {cost} + {at}.c, 'a': '{letter}' || {at}.a, 't': {line} || {at}.t}}" if at else f"{{'c': {_FAR}, 'a': '', 't': ''}}"


def _kept(state: int) -> str:
    """The state after a kept turn, by its initial."""
    of = {0: {"s": 2, "u": 3}, 1: {"u": 3}, 2: {"a": 4}, 3: {"u": 3}}[state]
    return "CASE r " + " ".join(f"WHEN '{x}' THEN {_option('K', 'late', f's[{i}]', 'line')}" for x, i in of.items()) + f" ELSE {_option('', '', None)} END"


_GIVEN = {0: ("user", 3), 1: ("user", 3), 2: ("assistant", 4), 3: ("user", 3)}
_LINE = "'{0}:' || text || chr(10)"
_STAY = [f"CASE WHEN fault IN ('blank', 'duplicate') THEN {_option('D', '2', f's[{k + 1}]')} ELSE least({_option('D', '2', f's[{k + 1}]')}, {_kept(k)}, {_option('R', '1 + late', f's[{_GIVEN[k][1]}]', _LINE.format(_GIVEN[k][0]))}) END" for k in range(4)]
_PUT = [f"least(b{k}, {_option('I', '5', f'b{_GIVEN[k][1] - 1}', chr(39) + _GIVEN[k][0] + ':' + chr(39) + ' || chr(10)')})" for k in range(4)]
_PUT_FIRST = [f"least(b{k}, {_option('I', '5', 'u', chr(39) + 'user:' + chr(39) + ' || chr(10)')})" for k in range(2)]

REPAIR = f"""
WITH RECURSIVE {_CRC},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE f <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS r, left(lag(role) OVER w, 1) || left(role, 1) AS pair,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS MATERIALIZED (
  SELECT *, role || ':' || text || chr(10) AS line, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM placed)),
best AS (
  SELECT DISTINCT conv_id, n + 1 AS i, [{{'c': 0::BIGINT, 'a': '', 't': ''}}, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}}, {{'c': 5, 'a': 'I', 't': 'assistant:' || chr(10)}}, {{'c': 0, 'a': '', 't': ''}}] AS s FROM faults
  UNION ALL
  SELECT conv_id, i, [{_PUT_FIRST[0]}, {_PUT_FIRST[1]}, u, a] AS s FROM (
    SELECT *, {_PUT[2]} AS u, {_PUT[3]} AS a FROM (
      SELECT conv_id, i, {', '.join(f'{x} AS b{k}' for k, x in enumerate(_STAY))} FROM (
        SELECT f.conv_id, f.i, f.r, f.fault, f.late, f.line, f.text, b.s FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)))),
counted AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s[1].c, 0) AS BIGINT) AS cost, coalesce(s[1].a, '') AS audit, sha256(coalesce(left(s[1].t, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1
"""

SQL = {"op12_variants": VARIANTS, "op13_repair": REPAIR, "op1_mix": MIX, "op2_quality": QUALITY, "op3_shard": SHARD, "op9_chat": CHAT}
