"""DuckDB SQL for those queries that SQL can express."""

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS deal
  FROM documents),
sizes AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM sizes),
weighted AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS most FROM ranked),
levels AS (SELECT *, most / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) /
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted WINDOW before AS (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT skey, source_no, source_size, sum(source_size) OVER () AS total,
         least(most, weight * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target FROM levels),
dealt AS (SELECT s.doc_id, s.size, s.skey, s.deal, source_no, source_size, target,
         ((('0x' || substr(md5('mix-1|' || s.skey), 1, 8))::BIGINT + deal % greatest(1, ceil(source_size / 262144.0)::BIGINT))
          % greatest(1, ceil(total / 262144.0)::BIGINT)) AS shard
  FROM sized s JOIN goal USING (skey)),
held AS (SELECT shard, skey, source_no, sum(size)::BIGINT AS tokens,
         CASE WHEN max(source_size) > 0 THEN max(target) * sum(size)::DOUBLE / max(source_size) ELSE 0 END AS wish
  FROM dealt GROUP BY ALL),
seats AS (SELECT *, sum(wish) OVER w AS whole, count(*) OVER w AS n, floor(sum(wish) OVER w / 16 + 0.5)::BIGINT AS seats
  FROM held WINDOW w AS (PARTITION BY shard)),
sure AS (SELECT *, seats * wish / whole AS fair,
         greatest(0, floor(seats * wish / whole * (1 - n / (2.0::DOUBLE * seats)) - 0.5))::BIGINT AS sure
  FROM seats WHERE seats > 0 AND wish > 0),
free AS (SELECT *, seats - sum(sure) OVER (PARTITION BY shard) AS free FROM sure),
band AS (SELECT *, unnest(generate_series(sure, ceil(fair * (1 + n / (2.0::DOUBLE * seats)) + 0.5)::BIGINT)) AS k FROM free),
placed AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY wish / (2 * k + 1) DESC, source_no, k) AS place FROM band),
won AS (SELECT shard, skey, max(sure) + count(*) FILTER (place <= free) AS quota FROM placed GROUP BY ALL),
wanted AS (SELECT h.shard, h.skey, tokens, least(coalesce(quota, 0) * 16, 2 * tokens) AS wanted
  FROM held h LEFT JOIN won USING (shard, skey)),
placed_docs AS (SELECT *, sum(size) OVER (PARTITION BY shard, skey ORDER BY deal, doc_id NULLS FIRST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM dealt)
SELECT doc_id, size, source_size, target,
       (CASE WHEN tokens > 0 THEN wanted // tokens * size
             + greatest(0, least(done, wanted - wanted // tokens * tokens) - (done - size)) ELSE 0 END)::BIGINT AS taken
FROM placed_docs JOIN wanted USING (shard, skey)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n_points,
       sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

OP8 = r"""
WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS host FROM cut),
parts AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(host) + 1), '^([^?#]*)', 1) AS path FROM raw),
fits AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts),
ruled AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
  regexp_replace(path, '[0-9]+', '#', 'g') AS key FROM fits),
leaf AS (SELECT host, key, list_filter(string_split(key, '/'), lambda x: x <> '') AS segs, count(*) AS n, count(said) AS lab,
  count(*) FILTER (said = 'block') AS bad FROM ruled GROUP BY ALL),
tree AS (
  SELECT host, key, segs, n, lab, bad, 0 AS d, '' AS done, false AS ended FROM leaf
  UNION ALL
  SELECT host, key, segs, n, lab, bad, d + 1, CASE WHEN keys = 1 THEN done || '/' || array_to_string(segs[d + 1:], '/')
      WHEN (kids >= 8 AND kids >= 0.2 * n_all)
        OR (kids > 1 AND CASE WHEN c_lab > 0 AND lab_all > c_lab THEN error = 0 OR abs(c_bad / c_lab - (bad_all - c_bad) / (lab_all - c_lab)) < 2 * error ELSE lab_all = 0 END)
      THEN done || '/*' ELSE done || '/' || seg END, keys = 1
  FROM (SELECT *, sqrt(bad_all / lab_all * (1 - bad_all / lab_all) * (1 / c_lab + 1 / (lab_all - c_lab))) AS error
    FROM (SELECT *, max(place) OVER node AS kids, count(*) OVER node AS keys, sum(n) OVER node AS n_all,
        (sum(lab) OVER node)::DOUBLE AS lab_all, (sum(bad) OVER node)::DOUBLE AS bad_all,
        (sum(lab) OVER child)::DOUBLE AS c_lab, (sum(bad) OVER child)::DOUBLE AS c_bad
      FROM (SELECT *, segs[d + 1] AS seg, dense_rank() OVER (PARTITION BY host, done ORDER BY segs[d + 1]) AS place FROM tree WHERE NOT ended AND len(segs) > d)
      WINDOW node AS (PARTITION BY host, done), child AS (PARTITION BY host, done, seg)))),
made AS (SELECT host, key, lab, bad, done AS template FROM tree WHERE ended OR len(segs) = d),
hosts AS (SELECT host, (sum(bad) + 1.0::DOUBLE) / (sum(lab) + 4.0::DOUBLE) AS host_share FROM made GROUP BY host),
pure AS (SELECT host, template, sum(lab) AS t_lab, (sum(bad) + 4.0::DOUBLE * any_value(host_share)) / (sum(lab) + 4.0::DOUBLE) AS purity FROM made JOIN hosts USING (host) GROUP BY host, template)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN t_lab > 0 AND purity >= 0.6 THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity
FROM ruled r JOIN made t ON t.host = r.host AND t.key = r.key JOIN pure p ON p.host = t.host AND p.template = t.template
"""

SQL = {"op1_mixing": OP1, "op2_exact_dedup": OP2, "op3_ngram_jaccard": OP3, "op8_url_filter": OP8}
