"""The same results in DuckDB's SQL, where SQL can say them; plain joins and groupings, no operator's method."""

from __future__ import annotations

from postmill.llm.decontaminate import WINDOW as TEST_WINDOW
from postmill.llm.fixity import PAGE_AUDIT_SQL
from postmill.llm.licenses import ALLOWED, BASE, DENIALS, NEAR, NOTICES, TAGS, WEIGHTS
from postmill.llm.quality_rules import ALPHA, BANDS, DELTA, LEVELS, POWER, RULES, cutoffs
from postmill.llm.substrings import WINDOW as REPEAT_WINDOW

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

DECONTAMINATE_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least({TEST_WINDOW}, len(w)) AS size FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
starts AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
hits AS (SELECT r, i, s.size, item FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM starts) s JOIN windows USING (win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

SUBSTRINGS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + {REPEAT_WINDOW - 1}], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - {REPEAT_WINDOW} + 2)) AS i FROM docs WHERE len(w) >= {REPEAT_WINDOW})),
often AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {REPEAT_WINDOW})) AS p FROM windows SEMI JOIN often USING (win)),
words AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM docs)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS said FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""

_CDF = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))))"

_RATIOS = dict(zip(RULES, ("n_symbols / greatest(word_chars, 1)", "n_capitals / greatest(word_chars, 1)", "n_exclaimed / greatest(n_words, 1)", "n_dup_lines / greatest(n_lines, 1)", "n_repeat_words / greatest(n_words, 1)"), strict=True))
_LEVEL = "least(" + ", ".join(f"coalesce(nullif(list_position([{', '.join(f'{x} > CAST({c} AS DOUBLE)' for c in cutoffs(r))}], true), 0), {LEVELS + 1})" for r, x in _RATIOS.items()) + ")"

QUALITY_RULES_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_PLAIN_WORDS} AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
often AS (SELECT r, win FROM windows GROUP BY r, win HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM windows SEMI JOIN often USING (r, win)) GROUP BY r),
lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
counts AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals, len(list_filter(w, lambda x: suffix(x, '!'))) AS n_exclaimed,
    len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM lined LEFT JOIN repeats USING (r)),
ratios AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {" + ".join(f"CAST(n_words >= {b} AS INTEGER)" for b in BANDS)} AS band,
    {_LEVEL} AS level
  FROM counts),
labelled AS (SELECT * FROM ratios JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
tries AS (SELECT band, l, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND level <= l) AS k, count(*) FILTER (quality = 0 AND level <= l) AS poor FROM labelled, (SELECT unnest(range(1, {LEVELS + 1})) AS l) GROUP BY ALL),
judged AS (SELECT *, CASE WHEN k < n * CAST({ALPHA} AS DOUBLE) THEN {_CDF} <= {DELTA} / {len(BANDS) + 1} ELSE false END AS passed FROM tries),
passing AS (SELECT * FROM (SELECT *, coalesce(min(l) FILTER (NOT passed) OVER (PARTITION BY band), {LEVELS + 1}) AS failing FROM judged) WHERE l < failing),
certified AS (SELECT band, min(l) FILTER (poor >= {POWER} * most) AS used FROM (SELECT *, max(poor) OVER (PARTITION BY band) AS most FROM passing) GROUP BY band)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(level > used, true) AS kept
FROM ratios LEFT JOIN certified USING (band)
"""

_PHRASES = ", ".join(f"('{phrase}', '{label}', '{kind}', {phrase.count(' ') + 1})" for kind, phrases in (("notice", NOTICES), ("base", BASE)) for phrase, label in phrases.items())
_STRINGS = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
_DOUBT = " * ".join(f"(CASE WHEN coalesce(list_contains(kinds, '{k}'), false) THEN 1 - CAST({WEIGHTS[k]} AS DOUBLE) ELSE 1 END)" for k in sorted(WEIGHTS))

#: Phrases only: the test tables hold no identifier tags, whose expressions are tested by themselves.
LICENSES_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
phrases(phrase, label, kind, n) AS (VALUES {_PHRASES}),
places AS (
  SELECT r, i - 1 AS start, label, CASE WHEN list_has_any(w[greatest(i - {NEAR}, 1):i - 1], {_STRINGS(DENIALS)}) THEN 'denied' ELSE kind END AS evidence, kind
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs) JOIN phrases ON split_part(phrase, ' ', 1) = w[i] AND array_to_string(w[i:i + n - 1], ' ') = phrase),
found AS (
  SELECT r, count(*) FILTER (kind = 'base') AS n_base, min(start) FILTER (kind = 'base') AS first_word, max(start) FILTER (kind = 'base') AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (kind = 'base')), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
    list(DISTINCT evidence) AS kinds, bool_and(list_contains({_STRINGS(ALLOWED)}, label)) AS allowed
  FROM places GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  1 - {_DOUBT} AS score, allowed
FROM docs LEFT JOIN found USING (r)
"""

#: The verdict on a text's phrases, and on the tag that is put behind it.
LICENSE_TAGS_SQL = f"""
WITH tags(k, names, unread, met) AS (VALUES {", ".join(f"({k}, '{t[1]}', '{t[2]}', {str(t[3]).lower()})" for k, t in enumerate(TAGS))}), scanned AS ({LICENSES_SQL})
SELECT doc_id, unread AS unknown, names AS tag_names, met AND coalesce(allowed, true) AS allowed FROM scanned JOIN tags ON k = doc_id % {len(TAGS)}
"""

_DRAWS = ", ".join(f"CAST(concat('0x', substr(h, {8 * k + 1}, 8)) AS BIGINT) AS h{k + 1}" for k in range(4))

INFILLING_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS h FROM documents),
drawn AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {_DRAWS} FROM docs),
ranked AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

_LOWER_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: Equal sets are compared once; a component is what a set reaches by links.
JACCARD_SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER_WORDS} AS w FROM documents),
shingled AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM docs),
sets AS (SELECT s, min(doc_id) AS m, row_number() OVER () AS g FROM shingled WHERE len(s) > 0 GROUP BY s),
members AS (SELECT g, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.g AS a, b.g AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM members a JOIN members b ON a.x = b.x AND a.g < b.g GROUP BY 1, 2),
linked AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(g, t) AS (SELECT g, g FROM sets UNION SELECT reach.g, e.b FROM reach JOIN edges e ON e.a = reach.t),
named AS (SELECT reach.g, min(m) AS component_id FROM reach JOIN sets ON sets.g = reach.t GROUP BY reach.g)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM shingled LEFT JOIN sets USING (s) LEFT JOIN named ON named.g = sets.g
"""

#: All scores of all anchors.
HARD_NEGATIVES_SQL = """
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM vectors WHERE id % 50 = 0) a, vectors b WHERE a.id <> b.id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE own = label QUALIFY place <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND own <> label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM ranked WHERE rank <= 3
"""

ORACLE_SQL = {
    "op1_decontaminate": DECONTAMINATE_SQL,
    "op2_licenses": LICENSES_SQL,
    "op3_fixity": PAGE_AUDIT_SQL,
    "op5_quality_rules": QUALITY_RULES_SQL,
    "op8_substrings": SUBSTRINGS_SQL,
    "op11_jaccard": JACCARD_SQL,
    "op12_hard_negatives": HARD_NEGATIVES_SQL,
    "license_tags": LICENSE_TAGS_SQL,
    "op13_infilling": INFILLING_SQL,
}
