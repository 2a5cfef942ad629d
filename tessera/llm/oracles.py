"""DuckDB SQL for the queries that SQL can express."""

from tessera.llm.license_scan import standard_templates

WORD = r"[^\x20\x09-\x0D]+"

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  sum(length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
    + length('<|im_start|>') + 1 + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END)
    AND arg_max(role, k) = 'assistant' AS valid
FROM o GROUP BY conv_id
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, s, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), pos AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1
), its AS (
  SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS room FROM s
), f AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone,
    (sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights FROM w
), l AS (SELECT *, max(CASE WHEN weight * ((total - gone) / weights) <= room THEN (total - gone) / weights END) OVER () AS level FROM f
), t AS (SELECT source, source_size, CASE WHEN level IS NOT NULL AND weight * level <= room THEN weight * level ELSE room::DOUBLE END AS target FROM l
), c AS (
  SELECT source, round(target)::HUGEINT AS quota, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no, (SELECT greatest(1, ceil(log2(greatest(count(*), 1) * 65536)))::INT FROM s) AS bits,
    (SELECT sum(source_size) FROM s)::HUGEINT AS total FROM t
), e AS (
  SELECT *, sum(quota) OVER (ORDER BY no ROWS UNBOUNDED PRECEDING)::HUGEINT AS upto, (sum(quota) OVER ())::HUGEINT AS alls, greatest(1, (total + (1::HUGEINT << bits) - 1) // (1::HUGEINT << bits))::BIGINT AS block FROM c WHERE quota > 0
), h AS (
  SELECT source, no, quota, bits, block, (((upto - quota) * (1::HUGEINT << bits) + alls - 1) // alls)::BIGINT AS lo, ((upto * (1::HUGEINT << bits) + alls - 1) // alls)::BIGINT AS hi FROM e
), n AS (SELECT any_value(bits) AS bits FROM h
), v AS (
  SELECT slot, list_sum(list_transform(range(bits), lambda k: ((slot >> k) & 1) << (bits - 1 - k)))::BIGINT AS point FROM (SELECT bits, unnest(range(1::BIGINT << bits)) AS slot FROM n)
), o AS (
  SELECT source, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM v JOIN h ON point >= lo AND point < hi
  UNION ALL SELECT source, no + (1::BIGINT << bits), 0 FROM h WHERE lo >= hi
), r AS (
  SELECT doc_id, source, size, row_number() OVER () AS row_no, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':mix'), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), j AS (SELECT r.*, source_size, target FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
), a AS (
  SELECT row_no, j.source, block, epoch * source_size + start AS first, least(epoch * source_size + start + size, quota, greatest(hi - lo, 1) * block)::BIGINT AS past
  FROM j JOIN h ON j.source IS NOT DISTINCT FROM h.source, range(3) x(epoch) WHERE size > 0
), b AS (SELECT *, unnest(range(first // block, (past - 1) // block + 1)) AS rank FROM a WHERE first < past
), p AS (
  SELECT row_no, sum(least(past, (b.rank + 1) * block) - greatest(first, b.rank * block))::BIGINT AS taken, min(slot) AS first_slot
  FROM b JOIN o ON b.rank = o.rank AND b.source IS NOT DISTINCT FROM o.source GROUP BY 1
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM j LEFT JOIN p USING (row_no)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM d WHERE len(w) >= 3
), r AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1) GROUP BY 1
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*\x{2022}\x{00B7}]'))) AS n_bullet, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[ \t\r]*$'))) AS n_ellipsis
  FROM d LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines)::BIGINT
    + 16 * (n_words > 0 AND word_chars < 2 * n_words)::BIGINT + 32 * (n_words > 0 AND word_chars > 20 * n_words)::BIGINT + 128 * (n_words > 0 AND 2 * n_letters < word_chars)::BIGINT
    + 256 * (n_lines >= 4 AND 10 * n_bullet > 9 * n_lines)::BIGINT + 512 * (n_lines >= 4 AND 10 * n_ellipsis > 3 * n_lines)::BIGINT)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""



TEMPLATE_ROWS = ", ".join("({}, '{}', '{}', {}, {})".format(no, t.license, t.text.replace("'", "''"), t.threshold, t.rank) for no, t in enumerate(standard_templates()))

OP7 = r"""
WITH f AS (
  SELECT doc_id, coalesce(text, '') AS text, source || '/' || lang || '/' || (doc_id // 1000) AS dir, length(text) - length(replace(text, chr(10), '')) < 2 AS named FROM documents
), p AS (SELECT *, dir || '/' || CASE WHEN named THEN 'LICENSE' ELSE doc_id || '.txt' END AS path FROM f
), u AS (
  SELECT doc_id, string_split(text, chr(10)) || list_filter(string_split_regex(text, '\n(?:[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n)+'), lambda x: contains(x, chr(10))) AS us FROM f
), l AS (SELECT doc_id, unnest(us) AS line, unnest(range(len(us))) AS no FROM u
), tm(template, license, line, threshold, rank) AS (VALUES """ + TEMPLATE_ROWS + r"""
), tw AS (SELECT template, license, threshold, rank, unnest(list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM tm
), n AS (SELECT count(*) AS n FROM documents
), df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM f) GROUP BY 1
), w AS (SELECT doc_id, no, unnest(ws) AS term FROM (SELECT doc_id, no, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM l) WHERE list_has_any(ws, (SELECT list(DISTINCT term) FROM tw))
), idf AS (SELECT term, ln((1 + any_value(n)) / (1 + coalesce(any_value(df), 0))) + 1 AS idf FROM (SELECT term FROM df UNION SELECT term FROM tw) LEFT JOIN df USING (term), n GROUP BY term
), tv AS (
  SELECT template, license, threshold, rank, term, x / sqrt(sum(x * x) OVER (PARTITION BY template)) AS weight
  FROM (SELECT template, license, threshold, rank, term, count(*) * any_value(idf) AS x FROM tw JOIN idf USING (term) GROUP BY ALL)
), c AS (SELECT doc_id, no, term, count(*) * any_value(idf) AS x FROM w JOIN idf USING (term) GROUP BY 1, 2, 3
), m AS (SELECT doc_id, no, sqrt(sum(x * x)) AS norm FROM c GROUP BY 1, 2
), s AS (SELECT doc_id, license, rank, threshold, round(sum(x * weight) / any_value(norm), 6) AS sim FROM c JOIN tv USING (term) JOIN m USING (doc_id, no) GROUP BY doc_id, no, template, license, rank, threshold
), b AS (SELECT doc_id, license, sim FROM s WHERE sim >= threshold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, sim DESC, license) = 1
), d AS (SELECT dir, b.license AS from_license, b.sim AS from_sim FROM p JOIN b USING (doc_id) WHERE named QUALIFY row_number() OVER (PARTITION BY dir ORDER BY b.sim DESC, b.license) = 1)
SELECT doc_id, path, coalesce(b.license, from_license) AS license, coalesce(b.sim, from_sim) AS similarity, CASE WHEN b.license IS NOT NULL THEN 'header' WHEN from_license IS NOT NULL THEN 'inherited' END AS basis,
  CASE WHEN b.license IS NULL AND from_license IS NOT NULL THEN dir END AS license_dir
FROM p LEFT JOIN b USING (doc_id) LEFT JOIN d USING (dir)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op5_decontaminate": OP5, "op6_mix_sources": OP6, "op7_license_scan": OP7, "op8_quality_rules": OP8}
