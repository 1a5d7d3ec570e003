"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality import STOP_WORDS, THRESHOLDS

_WORD = r"[^\x20\x09-\x0D]+"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def op5_sql() -> str:
    stop = sorted({*STOP_WORDS, *(w[0].upper() + w[1:] for w in STOP_WORDS)})
    bounds = " AND ".join(
        x for name, least, most in THRESHOLDS for x in ([f"{name} >= {least}"] if least is not None else []) + ([f"{name} <= {most}"] if most is not None else [])
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (
  SELECT doc_id, body, regexp_extract_all(body, '{_WORD}') AS ws,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, sum(c)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, least(8, i - lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i)) AS c FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines,
         len(list_filter(ws, lambda x: list_contains({_list(stop)}, regexp_replace(x, '[.,;:!?]+$', '')))) AS n_stop,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) AS n_ellipsis
  FROM w LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0.0 END AS stop_word_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
         CASE WHEN n_lines > 0 THEN n_bullet / n_lines ELSE 0.0 END AS bullet_line_ratio,
         CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0.0 END AS ellipsis_line_ratio,
         (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {bounds}) AS kept,
       round(mean_word_chars, 6) AS mean_word_chars, round(symbol_ratio, 6) AS symbol_ratio,
       round(stop_word_ratio, 6) AS stop_word_ratio, round(dup_line_ratio, 6) AS dup_line_ratio
FROM r"""


def op8_sql() -> str:
    from .urls import LIMIT, RULES, SECOND_LEVEL, STRENGTH, STRONGEST, WEAKEST, Z

    def strength(level: int, counts: str) -> str:
        v = "n * prior * (1 - prior)"
        return f"""(SELECT CASE WHEN coalesce(room, 0) <= 0 THEN {STRENGTH[level]}::DOUBLE WHEN ov <= 0 THEN {STRONGEST}::DOUBLE
          ELSE greatest({WEAKEST}::DOUBLE, least({STRONGEST}::DOUBLE, round(room / ov - 1, 3))) END AS strength
          FROM (SELECT sum((bad - n * prior) * (bad - n * prior) - {v}) AS ov, sum((n - 1) * {v}) AS room FROM {counts}))"""

    rate = "(bad + strength * prior) / (n + strength)"

    two = _list(SECOND_LEVEL)
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = []
    for rule, _ in rules:
        host, slash, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{rest}') THEN '{rule}'")
    said = " ".join(f"WHEN rule = '{rule}' THEN '{verdict}'" for rule, verdict in RULES)
    return rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT doc_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
s AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS ls FROM h),
t AS (SELECT host, n, bad, array_to_string(ls[greatest(len(ls) - 1, 1):], '.') AS two, ls FROM s),
k AS (SELECT host, n, bad, CASE WHEN list_contains({two}, two) THEN array_to_string(ls[greatest(len(ls) - 2, 1):], '.') ELSE two END AS domain,
             CASE WHEN list_contains({two}, two) THEN two ELSE ls[len(ls)] END AS suffix FROM t),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM k GROUP BY ALL),
u AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
r AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS prior FROM u),
up AS (SELECT suffix, n, bad, r.prior FROM u, r),
ur AS (SELECT suffix, {rate} AS prior FROM up, {strength(0, 'up')}),
dp AS (SELECT domain, d.n, d.bad, ur.prior FROM d JOIN ur USING (suffix)),
dr AS (SELECT domain, {rate} AS prior FROM dp, {strength(1, 'dp')}),
hp AS (SELECT host, k.n, k.bad, dr.prior FROM k JOIN dr USING (domain)),
ab AS (SELECT host, bad + strength * prior AS a, n + strength AS m FROM hp, {strength(2, 'hp')}),
hr AS (SELECT host, a / m AS mean, sqrt(a * (m - a) / (m * m * (m + 1.0::DOUBLE))) AS sd FROM ab),
o AS (SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule, mean, mean - {Z}::DOUBLE * sd AS bound FROM p JOIN hr USING (host))
SELECT page_id, host, path, rule, CASE {said} WHEN bound > {LIMIT}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict,
       round(mean, 6) AS bad_rate, round(bound, 6) AS bad_bound FROM o"""
