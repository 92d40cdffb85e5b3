"""DuckDB counterparts of the queries that SQL can express on whole tables.

RE2 folds case by Unicode, which takes in the Kelvin sign and the long s, so
letters in either case are spelled out.
"""

from __future__ import annotations

from .common import WORD
from .quality import LEFT_PERCENT, LEFT_WORDS, MAX_DOCS, MAX_SHARE, MIN_WORDS, REPEAT_PERCENT
from .secretscan import BASE, RULES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({0}, '" + WORD + "')"

QUALITY = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, {_WORDS.format("text")} AS words FROM d),
grams AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS pos, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i:i+2])) AS gram FROM w WHERE len(words) >= 3),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
norm AS (SELECT doc_id, source, {_WORDS.format(_LOWER.format("line"))} AS own FROM raw),
lines AS (SELECT doc_id, source, array_to_string(own, ' ') AS line, sum(len(own)) AS n FROM norm WHERE len(own) > 0 GROUP BY ALL),
base AS (
  SELECT w.doc_id, w.source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM base),
above AS (
  SELECT source, line FROM lines JOIN (SELECT source AS host, count(*) AS host_docs FROM d GROUP BY source) s ON lines.source IS NOT DISTINCT FROM host
  GROUP BY ALL HAVING count(*) > greatest({MAX_DOCS}, {MAX_SHARE} * any_value(host_docs))),
shared AS (
  SELECT lines.doc_id, list({{'line': lines.line, 'n': n}}) AS own FROM lines JOIN above ON lines.source IS NOT DISTINCT FROM above.source AND lines.line = above.line GROUP BY lines.doc_id),
ordered AS (
  SELECT judged.doc_id, source, n_words, base_failed, own, row_number() OVER (PARTITION BY source ORDER BY judged.doc_id) AS pos FROM judged JOIN shared ON judged.doc_id = shared.doc_id),
walk(source, pos, doc_id, removed, kept, taken) AS (
  SELECT DISTINCT source, 0::BIGINT, NULL::BIGINT, 0::HUGEINT, false, []::VARCHAR[] FROM ordered
  UNION ALL
  SELECT source, pos, doc_id, removed, kept, CASE WHEN kept THEN list_distinct(list_concat(taken, list_transform(own, lambda x: x.line))) ELSE taken END FROM (
    SELECT *, NOT base_failed AND NOT (removed > 0 AND (n_words - removed < {LEFT_WORDS} OR 100 * (n_words - removed) < {LEFT_PERCENT} * n_words)) AS kept FROM (
      SELECT o.source, o.pos, o.doc_id, o.n_words, o.base_failed, o.own, w.taken, coalesce(list_sum(list_transform(list_filter(o.own, lambda x: list_contains(w.taken, x.line)), lambda x: x.n)), 0)::HUGEINT AS removed
      FROM walk w JOIN ordered o ON o.source IS NOT DISTINCT FROM w.source AND o.pos = w.pos + 1)))
SELECT judged.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  coalesce(kept, NOT base_failed) AS kept, coalesce(removed, 0)::BIGINT AS n_removed_words
FROM judged LEFT JOIN (SELECT doc_id, removed, kept FROM walk WHERE pos > 0) w ON judged.doc_id = w.doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) END AS s FROM words),
keyed AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS k, s FROM sets),
classes AS (SELECT k, min(doc_id) AS low, any_value(n) AS n, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY k),
flat AS (SELECT low, n, unnest(s) AS gram FROM classes),
links AS (
  SELECT a.low AS x, b.low AS y FROM flat a JOIN flat b ON a.gram = b.gram AND a.low < b.low
  GROUP BY a.low, b.low HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, root) AS (SELECT low, low FROM classes UNION SELECT e.y, r.root FROM reach r JOIN both_ways e ON e.x = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT keyed.doc_id, keyed.n AS n_shingles, coalesce(root, keyed.doc_id) AS component_id, coalesce(root, keyed.doc_id) = keyed.doc_id AS kept
FROM keyed LEFT JOIN classes USING (k) LEFT JOIN roots ON node = low"""

MIXING = f"""
WITH RECURSIVE units AS (
  SELECT doc_id, source, md5(text) AS text_md5, len({_WORDS.format("coalesce(text, '')")}) + 1 AS tokens, count(*) AS copies FROM documents GROUP BY ALL),
sizes AS (SELECT source, sum(tokens * copies)::BIGINT AS available FROM units GROUP BY source),
shares AS (SELECT list(available / total ORDER BY source) AS p, count(*) AS n FROM (SELECT *, sum(available) OVER () AS total FROM sizes)),
limits AS (SELECT p, greatest(0, 1 - ln(2) / ln(list_max(p) / list_min(p))) AS floor, -list_sum(list_transform(p, lambda x: x * ln(x))) AS own, ln(n) AS flat FROM shares),
goal AS (SELECT *, own + 0.5 * (flat - own) AS goal FROM limits),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN reached THEN low ELSE (low + high) / 2 END, CASE WHEN reached THEN (low + high) / 2 ELSE high END
  FROM (SELECT *, ln(norm) - (low + high) / 2 * dot / norm < goal AS reached FROM (
    SELECT step, low, high, goal, list_sum(list_transform(p, lambda x: x ** ((low + high) / 2))) AS norm, list_sum(list_transform(p, lambda x: x ** ((low + high) / 2) * ln(x))) AS dot
    FROM bisect, goal WHERE step < 50))),
solved AS (SELECT round(CASE WHEN own >= goal THEN 1.0 ELSE greatest(floor, high) END, 9) AS alpha FROM bisect, goal WHERE step = 50),
rated AS (SELECT source, available, alpha, (available / sum(available) OVER ()) ** alpha AS raw FROM sizes, solved),
weighted AS (SELECT source, available, alpha, raw / sum(raw) OVER () AS w FROM rated),
budget AS (
  SELECT source, available, alpha, round(w, 12) AS weight, round(w / available / (min(w / available) OVER ()) * 1000000)::BIGINT AS millionths,
    greatest(1, floor(round(w, 12) * 100000)::BIGINT) AS share FROM weighted),
used AS (
  SELECT u.*, b.* EXCLUDE (source), unnest(range(0, greatest(ceil(millionths / 1000000)::BIGINT, 1))) AS epoch FROM units u JOIN budget b ON u.source IS NOT DISTINCT FROM b.source),
ordered AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '9', coalesce(doc_id::VARCHAR, 'null'), coalesce(text_md5, 'null'), epoch::VARCHAR)), 1, 15))::BIGINT AS h FROM used),
placed AS (
  SELECT *, epoch * available + coalesce(sum(tokens * copies) OVER (PARTITION BY source, epoch ORDER BY h, doc_id, text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream_start,
    (available::HUGEINT * millionths // 1000000)::BIGINT AS target_tokens FROM ordered),
blocks AS (SELECT *, stream_start // share AS block FROM placed WHERE epoch = 0 OR stream_start < target_tokens)
SELECT doc_id, source, text_md5, copies, tokens, epoch::INTEGER AS epoch, alpha, weight, target_tokens, stream_start, block,
  row_number() OVER (PARTITION BY block ORDER BY ('0x' || substr(md5(concat_ws(':', '10', block::VARCHAR, coalesce(doc_id::VARCHAR, 'null'), coalesce(text_md5, 'null'), epoch::VARCHAR)), 1, 15))::BIGINT, doc_id, text_md5) - 1 AS slot
FROM blocks"""

HARD_NEGATIVES = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM used a JOIN used b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10"""


def _either(pattern: str) -> str:
    """A pattern with its part (?i:...) spelled out in either case."""
    head, _, rest = pattern.partition("(?i:")
    if not rest:
        return pattern
    depth = 1
    end = next(i for i, c in enumerate(rest) if (depth := depth + (c == "(") - (c == ")")) == 0)
    return head + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in rest[:end]) + rest[end + 1 :]


def _secrets() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({i}, {quote(r.kind)}, {r.least})" for i, r in enumerate(RULES))
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS ord, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {r.group}) AS parts FROM d WHERE regexp_matches(text, {p})"
        for i, r in enumerate(RULES)
        for p in [quote(_either(r.pattern))]
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rules AS (SELECT * FROM (VALUES {rules}) t(ord, kind, least)),
found AS ({found}),
matches AS (SELECT doc_id, ord, unnest(range(1, len(hits) + 1)) AS k, gaps, hits, parts FROM found),
sizes AS (SELECT doc_id, ord, k, length(gaps[k]) AS gap, length(hits[k]) AS hit, length(parts[k]) AS part FROM matches),
placed AS (SELECT *, (sum(gap + hit) OVER (PARTITION BY doc_id, ord ORDER BY k))::BIGINT AS stop FROM sizes),
spans AS (SELECT doc_id, ord, stop - hit AS start, kind || ':' || (stop - hit) || ':' || stop AS span FROM placed JOIN rules USING (ord) WHERE part >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""


ORACLE_SQL = {"op3_minhash_near_duplicates": NEAR_DUPLICATES, "op5_line_frequency_quality": QUALITY, "op6_trigram_secret_scan": _secrets(), "op9_temperature_mix": MIXING, "op12_hard_negatives": HARD_NEGATIVES}
