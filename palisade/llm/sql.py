"""DuckDB SQL for those queries that it can express over whole tables."""

from __future__ import annotations

from palisade.llm import quality

OP2 = f"WITH {quality.judged_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"

_FOLDED = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: A window of an item is found by its words, joined by spaces.
OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM windows),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dp),
hits AS (SELECT rid, dw.n, i, item_id FROM dw JOIN windows USING (n, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hits) GROUP BY rid),
runs AS (SELECT rid, item_id, i, n, j FROM (SELECT DISTINCT rid, item_id, dw.n, dw.i, bi.i AS j FROM dw JOIN (SELECT item_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw) bi USING (n, g))),
long AS (SELECT rid, max(l) AS longest FROM (SELECT rid, count(*) - 1 + max(n) AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, item_id, i - j ORDER BY i) AS run FROM runs) GROUP BY rid, item_id, i - j, run) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated, coalesce(longest, 0)::INT AS longest_match
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN long USING (rid)
"""

#: Base32 of a digest: its hexadecimal digits as bits, five at a time.
OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT *, array_to_string(list_transform(string_split(digest, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS s FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(s, (5 * i + 1)::BIGINT, 1)::INT + 8 * substr(s, (5 * i + 2)::BIGINT, 1)::INT + 4 * substr(s, (5 * i + 3)::BIGINT, 1)::INT + 2 * substr(s, (5 * i + 4)::BIGINT, 1)::INT + substr(s, (5 * i + 5)::BIGINT, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
s AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM p),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY s) AS c FROM s),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM g WHERE c > 1),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

#: Bytes are pairs of hexadecimal digits; of equal strings the first in (doc_id, place) stays. doc_id tells rows apart.
OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM p),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM s),
runs AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g WHERE n > 1),
stretches AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM stretches),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS span FROM marked),
spans AS (SELECT doc_id, span, min(a) AS a, max(b) AS b FROM numbered GROUP BY doc_id, span),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, count(*) AS n, sum(b - a) AS gone
         FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
