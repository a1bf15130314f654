"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from textclusters.llm import licenses, linededup, search, urlfilter

_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN {{'verdict': '{v}', 'rule': '{r}'}}"
    for v, r in sorted(urlfilter.RULES, key=lambda x: -len(x[1]))
    for h, _, p in [r.partition("/")]
)

OP3 = rf"""
WITH seen AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
paths AS (
  SELECT host, path, count(*) AS pages,
    list_filter(string_split(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/'), lambda s: s <> '') AS segments
  FROM seen GROUP BY host, path),
each_ AS (
  SELECT host, path, pages, segments[d + 1] AS segment, d AS depth, array_to_string(segments[1:d], '/') AS parent
  FROM (SELECT *, unnest(range(len(segments))) AS d FROM paths)),
child AS (SELECT host, depth, parent, segment, sum(pages) AS n FROM each_ GROUP BY ALL),
node AS (SELECT host, depth, parent, count(*) AS children, sum(n) AS total FROM child GROUP BY ALL),
wide AS (
  SELECT c.* FROM child c JOIN node USING (host, depth, parent)
  WHERE children >= {urlfilter.FANOUT} AND c.n < {urlfilter.RARE_SHARE} * total),
leaf_of AS (
  SELECT e.host, e.path, list(CASE WHEN w.segment IS NULL THEN e.segment ELSE '*' END ORDER BY e.depth) AS x
  FROM each_ e LEFT JOIN wide w ON e.host = w.host AND e.depth = w.depth AND e.parent = w.parent AND e.segment = w.segment
  GROUP BY e.host, e.path),
leaves AS (
  SELECT p.host, p.path, '/' || coalesce(array_to_string(x, '/'), '') AS template,
    '/' || coalesce(array_to_string(list_transform(x, lambda s: CASE WHEN len(string_split(s, '{{n}}')) = 2 OR s = '*' THEN s ELSE '*' END), '/'), '') AS skeleton
  FROM paths p LEFT JOIN leaf_of l ON p.host = l.host AND p.path = l.path),
placed AS (SELECT page_id, s.host, s.path, template, skeleton FROM seen s JOIN leaves l ON s.host = l.host AND s.path = l.path),
known AS (
  SELECT p.page_id, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS bad
  FROM pages p JOIN labels l ON l.doc_id = TRY_CAST(regexp_extract(p.url, '(?s)://[^/?#]*[^?#]*?([0-9]+)[^0-9?#]*(?:[?#].*)?$', 1) AS BIGINT)),
leaf AS (
  SELECT host, skeleton, template, count(bad) AS m, coalesce(sum(bad), 0)::BIGINT AS b
  FROM placed LEFT JOIN known USING (page_id) GROUP BY host, skeleton, template),
stepped AS (SELECT *, CASE WHEN m > 0 THEN floor({urlfilter.STEPS} * b / greatest(m, 1)) END AS step FROM leaf),
step AS (SELECT host, skeleton, step, sum(m)::BIGINT AS sm, sum(b)::BIGINT AS sb FROM stepped WHERE m > 0 GROUP BY host, skeleton, step),
neighbour AS (
  SELECT *, lag(sm) OVER w AS lm, lag(sb) OVER w AS lb, (lb + sb) / (lm + sm) AS share,
    coalesce(abs(sb / sm - lb / lm) > {urlfilter.SIMILAR} * sqrt(share * (1 - share) * (1 / lm + 1 / sm)), false)::INTEGER AS apart
  FROM step WINDOW w AS (PARTITION BY host, skeleton ORDER BY step)),
branch AS (SELECT *, sum(apart) OVER (PARTITION BY host, skeleton ORDER BY step) AS branch FROM neighbour),
merged AS (SELECT *, sum(sb) OVER w AS bad, sum(sm) OVER w AS all_ FROM branch WINDOW w AS (PARTITION BY host, skeleton, branch)),
pool AS (SELECT host, skeleton, sum(m)::BIGINT AS pm, sum(b)::BIGINT AS pb FROM leaf GROUP BY host, skeleton),
scored AS (
  SELECT s.host, s.skeleton, template,
    (coalesce(bad, pb)::BIGINT + {urlfilter.PRIOR_WEIGHT} * (SELECT sum(b) / greatest(sum(m), 1) FROM leaf))
      / (coalesce(all_, pm)::BIGINT + {urlfilter.PRIOR_WEIGHT}) AS purity
  FROM stepped s JOIN pool p ON s.host = p.host AND s.skeleton = p.skeleton
    LEFT JOIN merged g ON s.host = g.host AND s.skeleton = g.skeleton AND s.step = g.step),
ruled AS (SELECT *, CASE {_RULES} END AS x FROM placed)
SELECT page_id, host, path, x.rule AS rule,
  coalesce(x.verdict, CASE WHEN purity >= {urlfilter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM ruled JOIN scored USING (host, skeleton, template)
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in dict.fromkeys(licenses.TEMPLATES))
_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_BIGRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_LEAST = licenses.LIMIT / (2 - licenses.LIMIT)

# A unit within the limit shares so many bigrams with the template; of texts that do, all windows are compared.
OP6 = rf"""
WITH notice AS MATERIALIZED (SELECT row_number() OVER () AS t, license_id, {_WORDS.format("notice")} AS words FROM (VALUES {_TEMPLATES}) AS v(license_id, notice)),
template AS MATERIALIZED (SELECT t, license_id, len(words) AS w, list_distinct({_BIGRAMS.format("words")}) AS theirs FROM notice),
known AS (SELECT *, ceil(len(theirs) * {_LEAST} - 1e-9) AS least FROM template),
word AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS words FROM documents WHERE text IS NOT NULL),
parts AS MATERIALIZED (SELECT doc_id, {_BIGRAMS.format("words")} AS grams FROM word),
gram AS (SELECT DISTINCT doc_id, unnest(grams) AS g FROM parts),
met AS (
  SELECT doc_id, t FROM gram JOIN (SELECT t, least, unnest(theirs) AS g FROM known) USING (g)
  GROUP BY doc_id, t, least HAVING count(*) >= least),
placed AS (
  SELECT doc_id, license_id, grams, theirs, least(w - 1, len(grams)) AS size, unnest(range(len(grams) - least(w - 1, len(grams)) + 1)) AS start
  FROM met JOIN parts USING (doc_id) JOIN known USING (t)),
compared AS (
  SELECT doc_id, license_id, start, size + 1 AS n, list_distinct(grams[start + 1 : start + size]) AS ours,
    round(2.0::DOUBLE * len(list_intersect(ours, theirs)) / (len(ours) + len(theirs)), 6) AS dice, theirs
  FROM placed),
best AS (
  SELECT doc_id, license_id, start, n, dice FROM compared WHERE dice >= {licenses.LIMIT}
  QUALIFY row_number() OVER (PARTITION BY doc_id, license_id, theirs ORDER BY dice DESC, start) = 1)
SELECT DISTINCT doc_id, license_id, start::INTEGER AS start_word, n::INTEGER AS n_words, dice FROM best x
WHERE NOT EXISTS (
  SELECT 1 FROM best y WHERE y.doc_id = x.doc_id AND x.start < y.start + y.n AND y.start < x.start + x.n
    AND (y.dice > x.dice OR y.dice = x.dice AND (y.n > x.n OR y.n = x.n AND y.license_id < x.license_id)))
"""

OP8 = rf"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE text IS NOT NULL),
line AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pair AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS following FROM line),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1 AS again,
    following IS NOT NULL AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, seq) > 1 AS run
  FROM pair),
gone AS (
  SELECT doc_id, line_no, seq FROM ranked WHERE run
    OR again AND words >= {linededup.MIN_WORDS}
  UNION SELECT b.doc_id, b.line_no, b.seq FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND b.seq = a.seq + 1 WHERE a.run),
runs AS (
  SELECT doc_id, count(*) AS n_removed, sum(fresh::INT) AS n_runs
  FROM (SELECT doc_id, coalesce(seq - lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) > 1, true) AS fresh FROM gone) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM split s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.line_no = s.line_no) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines FROM line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TERMS = rf"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{search.TERM}')"

OP11 = f"""
WITH held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
long AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM long),
known AS (SELECT term, count(*) AS df FROM held GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM known, total),
measured AS (SELECT doc_id, 100 - {search.LENGTH_SHARE} + (({search.LENGTH_SHARE} * n * docs) // terms) AS m FROM long, total),
asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * (({search.UNIT} * tf) // (1000 * tf + {search.K1} * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN measured USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

ORACLES = {"op3_urlfilter": OP3, "op6_licenses": OP6, "op8_linededup": OP8, "op11_search": OP11}
