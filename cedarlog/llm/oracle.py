"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

MEASURES = r"""
w AS (SELECT doc_id, source, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
      FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] gram
      FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) u(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) n FROM again, unnest([0, 1, 2]) v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) n
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
judged AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT word_chars,
         (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT n_symbols,
         coalesce(lines.n, 0)::BIGINT n_dup_lines, coalesce(covered.n, 0)::BIGINT n_repeat_words
  FROM w LEFT JOIN lines ON w.doc_id = lines.doc_id LEFT JOIN covered ON w.doc_id = covered.doc_id),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM judged),
hosts AS (SELECT source, count(*) n, sum(base_failed::INT) f FROM base WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(f / n) m, coalesce(var_samp(f / n), 0) - avg((f / n) * (1 - f / n) / n) v, avg(n) size FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE size END wt FROM moments),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * wt) / (n + wt) > 0.5)
"""

OP10 = f"""
WITH {MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(source IN (SELECT source FROM bad), false) kept
FROM base
"""


OP2 = """
WITH record AS (
  SELECT page_id, 'part-' || coalesce(CAST(page_id // 256 AS VARCHAR), 'null') file, url,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Length: '
         || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
         || chr(13) || chr(10) || chr(13) || chr(10) payload FROM pages),
placed AS (
  SELECT file, page_id % 101 mark, strlen(payload) size,
         sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id, url, payload ROWS UNBOUNDED PRECEDING) - strlen(payload) place
  FROM record)
SELECT file, CAST(CASE WHEN mark = 11 THEN place + 10000000000 ELSE place END AS BIGINT) "offset", CAST(size AS BIGINT) length,
       CASE WHEN mark = 7 THEN 'missing' WHEN mark = 11 THEN 'extra' ELSE 'changed' END status
FROM placed WHERE mark IN (3, 5, 7, 11)
"""

#: The main text as the markup of ``pages`` gives it: the one marked article, its blocks parted by tags.
OP11 = r"""
WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) inner_html FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') t FROM body),
plain AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') t
          FROM bare),
tidy AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text)::BIGINT n_chars FROM tidy
"""

#: The checksum by its definition, once for each distinct word.
OP12 = r"""
WITH steps AS (
  SELECT list(v ORDER BY k) t FROM (
    SELECT k, list_reduce(list_prepend(k::BIGINT, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) v
    FROM range(256) r(k))),
texts AS (
  SELECT 'd' side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents
  UNION ALL
  SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (SELECT side, doc_id, unnest(ws) w FROM texts),
known AS (SELECT DISTINCT w FROM features),
summed AS (
  SELECT w, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(w), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % 10000 bucket
  FROM known, steps),
counted AS (SELECT bucket, count(*) FILTER (side = 'd') s, count(*) FILTER (side = 'b') t FROM features JOIN summed USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE ss, coalesce(sum(t), 0)::DOUBLE tt FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT gain FROM counted, totals),
weights AS (SELECT doc_id, sum(gain)::BIGINT weight FROM features JOIN summed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT n_features, coalesce(weight, 0)::BIGINT weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT score
  FROM texts LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) place,
                  count(*) FILTER (n_features >= 20) OVER () n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_merkle_fixity": OP2, "op10_host_quality_rules": OP10, "op11_site_template": OP11, "op12_importance_resampling": OP12}
