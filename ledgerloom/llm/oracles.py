"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

from __future__ import annotations

from ledgerloom.llm.host_rules import SOFT, HostRules
from ledgerloom.llm.jaccard_join import PERCENT, SHINGLE

_RULES = HostRules()
_WITH_SOME = [*SOFT, "some"]


def _rate(rule: str) -> str:
    return f"coalesce(r_{rule}, m_{rule})"


def _moments() -> str:
    return ", ".join(f"avg(k_{r} / n) AS m_{r}, var_samp(k_{r} / n) AS v_{r}" for r in _WITH_SOME)


def _weights() -> str:
    return ", ".join(
        f"coalesce(m_{r}, 0) AS m_{r}, least(greatest(CASE WHEN v_{r} > 0 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 "
        f"ELSE {_RULES.max_prior} END, 1), {_RULES.max_prior}) AS w_{r}"
        for r in _WITH_SOME
    )


HOST_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT rid, doc_id, source, t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
),
runs AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM s, unnest(range(1, len(w) - 1)) AS u(i)
),
again AS (SELECT rid, i FROM runs QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid
),
m AS (
  SELECT rid, doc_id, source,
         len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM s LEFT JOIN covered USING (rid)
),
f AS (
  SELECT *,
         n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed,
         100 * n_symbols > {_RULES.max_symbol_percent} * n_words AS f_symbols,
         100 * n_dup_lines > {_RULES.max_dup_line_percent} * n_lines AS f_dup_lines,
         word_chars < {_RULES.min_mean_word} * n_words OR word_chars > {_RULES.max_mean_word} * n_words AS f_word_length
  FROM m
),
h AS (
  SELECT source, count(*)::DOUBLE AS n,
         {", ".join(f"count(*) FILTER (f_{r})::DOUBLE AS k_{r}" for r in SOFT)},
         count(*) FILTER (base_failed OR {" OR ".join(f"f_{r}" for r in SOFT)})::DOUBLE AS k_some
  FROM f WHERE source IS NOT NULL GROUP BY source
),
p AS (SELECT {_weights()} FROM (SELECT {_moments()} FROM h)),
r AS (SELECT source, {", ".join(f"(k_{r} + m_{r} * w_{r}) / (n + w_{r}) AS r_{r}" for r in _WITH_SOME)} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_rate("some")} >= {_RULES.host_rate}
         OR {" OR ".join(f"(f_{r} AND {_rate(r)} >= {_RULES.trust_rate})" for r in SOFT)}) AS kept
FROM f LEFT JOIN r USING (source), p
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2),
                                                lambda i: array_to_string(w[i : i + {SHINGLE} - 1], ' '))
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d
),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, e.y FROM r JOIN e ON e.x = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN r USING (rid) JOIN d o ON o.rid = r.other LEFT JOIN n ON n.rid = d.rid
GROUP BY d.rid, d.doc_id
"""

ORACLES: dict[str, str] = {"op7_host_rules": HOST_RULES, "op13_jaccard_join": JACCARD_JOIN}
