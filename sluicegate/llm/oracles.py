"""Oracle SQL (DuckDB) of the queries that SQL can express.

The others need a tokenizer, XXH64, a trained model or an approximate search, which are not SQL; tests hold them
against brute force.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_substring_dedup": r"""WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS phrase FROM d, unnest(generate_series(1, len(words) - 19)) AS t(s)),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(generate_series(s, s + 19)) AS t(p)),
placed AS (SELECT doc_id, p, words[p] AS word FROM d, unnest(generate_series(1, len(words))) AS t(p)),
kept AS (SELECT placed.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS joined FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
r AS (SELECT *, strlen(payload) >= 1000 AND page_id <> last AS again FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r""",
    "op5_exact_dedup": f"""WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)""",
    "op13_fill_middle": r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS h FROM documents),
numbers AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
forms AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM forms)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts""",
}
