"""DuckDB SQL of the queries that SQL can express, on the views of the same tables."""

OP1 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (
  SELECT k.*, h.key IS NOT NULL AS drops FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drops) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drops), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Units that are placeholders behind a number
_UNITS = """
mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres
kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound
pounds ounce ounces ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons s sec
second seconds min minute minutes h hr hour hours day days week weeks month months year years
usd eur gbp dollar dollars euro euros cent cents percent degree degrees w kw v a hz kb mb gb"""

OP4 = r"""
WITH texts AS (
  SELECT 'doc' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'item', item_id, coalesce(text, '') FROM benchmark WHERE item_id IS NOT NULL),
found AS (
  SELECT kind, id, regexp_extract_all(text,
    '(?:[.!?\n][^\p{L}0-9]*)?(?:[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}\p{M}]*)') AS f FROM texts),
bare AS (
  SELECT *, list_transform(f, lambda x: regexp_extract(x, '[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}\p{M}]*')) AS t
  FROM found),
typed AS (
  SELECT *, list_transform(t, lambda x, i: CASE
      WHEN regexp_matches(x, '^[0-9]') THEN '<number>'
      WHEN i > 1 AND regexp_matches(t[i - 1], '^[0-9]') AND list_contains(string_split(trim(regexp_replace(
        '""" + _UNITS.strip().replace("\n", " ") + r"""', '\s+', ' ', 'g')), ' '), lower(x)) THEN '<unit>'
      WHEN lower(x) = x THEN x
      WHEN i > 1 AND NOT regexp_matches(f[i], '^[.!?\n]') AND regexp_full_match(x, '\p{Lu}[\p{Ll}\p{M}]+') THEN '<name>'
      ELSE lower(x) END) AS p
  FROM bare),
cut AS (
  SELECT kind, id, t, p, unnest(range(1, greatest(len(t) - 6, 1))) AS pos FROM typed),
grams AS (
  SELECT kind, id, pos, array_to_string(p[pos:pos + 7], ' ') AS gram,
    list_transform(range(pos, pos + 8), lambda k: CASE WHEN p[k][1] = '<' THEN t[k] END) AS slots FROM cut),
items AS (
  SELECT id AS item_id, pos AS at_pos, gram, slots AS asked, count(*) OVER (PARTITION BY id) AS n
  FROM grams WHERE kind = 'item' AND len(list_filter(slots, lambda v: v IS NULL)) >= 4),
met AS (
  SELECT g.id AS doc_id, item_id, n, at_pos, g.pos - at_pos AS shift, asked, slots
  FROM grams g JOIN items USING (gram) WHERE g.kind = 'doc'),
pairs AS (
  SELECT DISTINCT doc_id, item_id, shift, unnest(asked) AS a, unnest(slots) AS s FROM met),
conflicts AS (
  SELECT doc_id, item_id, shift, count(*) AS n_pairs, count(DISTINCT a) AS n_values
  FROM pairs WHERE a IS NOT NULL GROUP BY ALL),
shares AS (
  SELECT doc_id, item_id, count(DISTINCT at_pos) / any_value(n) AS share
  FROM met LEFT JOIN conflicts USING (doc_id, item_id, shift)
  WHERE coalesce(n_pairs - n_values <= 0.5 * n_values, true)
  GROUP BY doc_id, item_id HAVING share >= 0.4),
leaks AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids, max(share) AS best_share
  FROM shares GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(item_ids, '') AS item_ids, coalesce(best_share, 0.0)::DOUBLE AS best_share
FROM documents LEFT JOIN leaks USING (doc_id)
"""

OP8 = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS whole,
         row_number() OVER (ORDER BY doc_id) AS rank
  FROM sized),
cut AS (
  SELECT *, least(23, ((2 * before + size) * 24) // (2 * whole))::INTEGER AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

OP9 = r"""
WITH split_words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
spans AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS head FROM split_words),
grams AS (
  SELECT doc_id, head, array_to_string(words[head:head + 12], ' ') AS gram FROM spans),
least_doc AS (
  SELECT gram, min(doc_id) AS first_doc FROM grams GROUP BY gram),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(head, head + 13)) AS pos
  FROM grams JOIN least_doc USING (gram) WHERE doc_id > first_doc),
each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split_words),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) FILTER (WHERE g.pos IS NULL) AS body,
         count(g.pos) AS n_removed
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM split_words LEFT JOIN kept USING (doc_id)
"""

ORACLE = {
    "op1_line_dedup": OP1,
    "op4_benchmark_decontamination": OP4,
    "op8_sharding": OP8,
    "op9_substring_dedup": OP9,
}
