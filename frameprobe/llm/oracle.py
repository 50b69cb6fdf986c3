"""Independent SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
      FROM d GROUP BY source),
-- each step shares what is left among the open sources and closes those at their ceiling
fill(step, source, source_size, w, target) AS (
  SELECT 0, source, source_size, w, NULL::DOUBLE FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w,
         coalesce(target, CASE WHEN share >= 2 * source_size THEN 2.0 * source_size END)
  FROM (SELECT *, w * (1.5 * sum(source_size) OVER () - coalesce(sum(target) OVER (), 0))
                 / sum(CASE WHEN target IS NULL THEN w END) OVER () AS share FROM fill)
  WHERE step <= (SELECT count(*) FROM s)),
done AS (SELECT *, w * (1.5 * sum(source_size) OVER () - coalesce(sum(target) OVER (), 0))
                / sum(CASE WHEN target IS NULL THEN w END) OVER () AS share
         FROM fill WHERE step = (SELECT max(step) FROM fill)),
t AS (SELECT source, source_size, coalesce(target, share) AS target,
             CASE WHEN source_size > 0 THEN coalesce(target, share) / source_size ELSE 0 END AS rate
      FROM done),
m AS (SELECT doc_id, size, source_size, target, rate,
             floor(rate)::BIGINT + (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
               / 4503599627370496.0 < rate - floor(rate))::BIGINT AS copies
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, rate, copies, copies * size AS taken FROM m"""

OP3 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS lead
      FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN lead IS NULL OR page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN lead IS NOT NULL AND page_id IS DISTINCT FROM lead THEN lead END AS refers_to
FROM f"""

ORACLE = {"op1_mixing": OP1, "op3_warc": OP3}

ORACLE["op6_topk"] = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT a.row, a.vec_id AS query_id, b.vec_id,
             list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row AND len(a.q) = len(b.q))
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY p.row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
WHERE rank <= 5"""

ORACLE["op4_chat"] = """
WITH t AS (SELECT *, conv_id || ':' || turn AS own,
                  last_value(CASE WHEN role = 'user' THEN conv_id || ':' || turn END IGNORE NULLS) OVER w AS call
           FROM conversations
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT conv_id, call, turn, text, row_number() OVER (PARTITION BY conv_id, call ORDER BY turn, text) AS k
      FROM t WHERE role = 'assistant')
SELECT c.conv_id, c.own AS call_id, c.turn AS position,
       row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.own)::INTEGER AS seq, r.turn AS result_position,
       CASE WHEN r.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       coalesce(length(c.text) >= 1, false) AS valid,
       '{"arguments":' || json_merge_patch('{}', json_object('text', c.text, 'turn', c.turn))
         || ',"id":' || to_json(c.own) || ',"name":"reply"' || coalesce(',"result":' || to_json(r.text), '') || '}' AS json
FROM t c LEFT JOIN r ON c.conv_id = r.conv_id AND c.own = r.call AND r.k = 1 WHERE c.role = 'user'
UNION ALL
SELECT conv_id, call, NULL, NULL, turn, 'orphan', false, json_merge_patch('{}', json_object('id', call, 'result', text))
FROM t WHERE role = 'assistant' AND call IS NULL"""

ORACLE["op13_filters"] = rf"""
WITH w AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
f AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
                    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
                    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails,
             EXISTS (FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good,
             EXISTS (FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS bad FROM w),
g AS (SELECT part, fails, list_filter(range(1, 6), lambda i: fails[i]) AS failed, count(*) AS n,
             count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, o, x AS step, o[x] AS own, list_has_any(failed, o[:x]) AS gone, list_has_any(failed, o[:x - 1]) AS before,
             failed, n, good, bad FROM g, o, l),
r AS (SELECT part, o, step, own,
             sum(n) FILTER (NOT gone) AS kept, sum(n) FILTER (gone AND NOT before) AS removed,
             sum(n) FILTER (before AND list_contains(failed, own)) AS redundant, sum(n) FILTER (failed = [own]) AS alone,
             sum(good) FILTER (gone AND NOT before) AS good_lost, sum(bad) FILTER (gone AND NOT before) AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step::INTEGER AS step,
       coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(alone, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM r"""
