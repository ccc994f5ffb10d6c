"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP1 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, upper(sha1(payload)) AS hex,
  min(page_id) OVER (PARTITION BY sha256(payload)) AS first_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('{_BASE32}',
    ((((strpos('0123456789ABCDEF', substr(hex, (5*k//4+1)::INT, 1)) - 1) * 16
      + (CASE WHEN 5*k//4+2 <= 40 THEN strpos('0123456789ABCDEF', substr(hex, (5*k//4+2)::INT, 1)) - 1 ELSE 0 END))
      >> (3 - (5*k) % 4)::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS size FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bs)),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM bg),
dg AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, dg.size, item_id FROM dg JOIN bg ON dg.size = bg.size AND dg.gram = bg.gram),
hit_words AS (SELECT doc_id, count(DISTINCT wpos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS wpos FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

#: CRC-32 by its table, a byte at a time.
OP6 = """
WITH t AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce([n::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n))),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
s AS (SELECT doc_id, n + 8 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x:
    ((strpos('0123456789ABCDEF', substr(x, 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2, 1)) - 1)::BIGINT)),
    lambda c, v: xor(c >> 8, t.t[(xor(c, v) & 255) + 1]))) AS text_crc32 FROM x, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM s),
q AS (SELECT *, ((2 * start + size) * 24 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM q
"""

ORACLES = {"op1_content_addressed_warc": OP1, "op2_ngram_decontamination": OP2, "op6_prefix_sum_shards": OP6}
