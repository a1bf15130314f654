"""DuckDB SQL that returns the rows of the registered queries, from the tables alone."""

_SENTENCES = """
line AS (
  SELECT doc_id, lang AS grp, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents),
sentence AS (SELECT doc_id, grp, line_no, list_filter(string_split(line, ' '), lambda w: w <> '') AS words FROM line),
path AS (SELECT doc_id, grp, list_filter(words, lambda w: w NOT IN ('BOS', 'EOS')) AS w FROM sentence)"""

_COUNTS = (
    _SENTENCES
    + """,
uni AS (
  SELECT word, count(*) AS cnt FROM (SELECT unnest(w) AS word FROM path) GROUP BY word
  UNION ALL SELECT unnest(['BOS', 'EOS']) AS word, count(*) AS cnt FROM path),
pair AS (SELECT grp, unnest(list_prepend('BOS', w)) AS prev, unnest(list_append(w, 'EOS')) AS curr FROM path),
bi AS (SELECT prev, curr, count(*) AS cnt FROM pair GROUP BY ALL)"""
)

_VOCAB = (
    _COUNTS
    + """,
vocab AS (
  SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS rank FROM uni
  WHERE cnt >= 3 AND word NOT IN ('BOS', 'EOS') QUALIFY rank <= 8000),
known AS (SELECT word FROM vocab UNION ALL SELECT unnest(['BOS', 'EOS'])),
fbi AS (SELECT * FROM bi WHERE prev IN (SELECT word FROM known) AND curr IN (SELECT word FROM known)),
funi AS (SELECT * FROM uni WHERE word IN (SELECT word FROM known)),
mass AS (SELECT coalesce(sum(cnt), 0)::DOUBLE AS n FROM fbi),
pmi AS (
  SELECT prev, curr, b.cnt, b.cnt::DOUBLE * ln(b.cnt::DOUBLE * n / (p.cnt::DOUBLE * c.cnt::DOUBLE)) AS wpmi
  FROM fbi b JOIN funi p ON b.prev = p.word JOIN funi c ON b.curr = c.word, mass)"""
)

_SEEDS = (
    _VOCAB
    + """,
seed AS (SELECT word, rank::INTEGER AS cluster FROM vocab WHERE rank <= 256),
met AS (
  SELECT prev AS word, curr AS member, wpmi FROM pmi WHERE prev <> curr
  UNION ALL SELECT curr, prev, wpmi FROM pmi WHERE prev <> curr),
affinity AS (
  SELECT met.word, cluster, round(sum(wpmi), 6) AS score FROM met JOIN seed ON member = seed.word GROUP BY met.word, cluster)"""
)

_ASSIGNED = (
    _SEEDS
    + """,
rest AS (SELECT word FROM vocab WHERE rank > 256),
candidate AS (
  SELECT word, cluster, coalesce(score, 0.0) + 0.0 AS score
  FROM rest CROSS JOIN (SELECT unnest(range(1, 257))::INTEGER AS cluster) LEFT JOIN affinity USING (word, cluster)),
assigned AS (
  SELECT word, cluster FROM seed
  UNION ALL SELECT word, cluster FROM candidate QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, cluster) = 1
  UNION ALL SELECT unnest(['BOS', 'EOS']), 0)"""
)


def _cut(size: str) -> str:
    """The pieces of all lines, of so many words each."""
    return (
        _SENTENCES
        + f""",
safe AS (
  SELECT doc_id, grp, line_no, list_transform(words, lambda w: CASE WHEN regexp_matches(w, '^[#*+]') OR w = 'EOS' THEN '_' || w ELSE w END) AS ws
  FROM sentence WHERE len(words) > 0),
part AS (SELECT *, unnest(range((len(ws) + {size} - 1) // {size})) AS k FROM safe),
piece AS (
  SELECT 'D' || doc_id || '_' || grp || '_1-1-' || (line_no + 1) || '-' || CASE WHEN k < 9 THEN '0' ELSE '' END || (k + 1) AS sid,
    'D' || doc_id || '_' || grp || '_1' AS article, (line_no + 1)::INTEGER AS sent_no, (k + 1)::INTEGER AS sub_no, ws[k * {size} + 1 : k * {size} + {size}] AS w
  FROM part),
unit AS (
  SELECT sid, i, len(w) AS n, w[i + 1] AS word, CASE WHEN i > 0 THEN w[i] END AS before
  FROM (SELECT *, unnest(range(len(w))) AS i FROM piece)),
chunk AS (
  SELECT sid, i::INTEGER AS chunk_id, CASE WHEN i % 2 = 0 THEN '*' ELSE '+' END AS kind,
    (CASE WHEN i = n - 1 THEN -1 ELSE least(i + 1 + length(word) % 3, n - 1) END)::INTEGER AS parent,
    CASE WHEN length(word) % 7 = 0 THEN 'P' ELSE 'D' END AS dep_type, n, word,
    CASE WHEN i > 0 AND NOT regexp_matches(before, '[<>【】();:]') THEN before END AS linked,
    CASE WHEN length(linked) % 5 = 0 THEN 'メモ' ELSE 'ガ' END AS marker, CASE WHEN length(linked) % 3 = 0 THEN '1文前' ELSE '同一文' END AS position,
    CASE WHEN marker = 'メモ' THEN marker || ':' || linked WHEN position = '同一文' THEN linked || ':' || marker
      ELSE linked || ':' || marker || ':' || position END AS linked_label,
    CASE WHEN regexp_matches(word, '^[A-Z]') AND NOT regexp_matches(word, '[<>【】();:]') THEN word END AS named,
    (1 + 2 * i + CASE WHEN i > 5 THEN 1 ELSE 0 END)::INTEGER AS chunk_ln
  FROM unit),
off AS (
  SELECT sid, chunk_id, word, (chunk_ln + 1)::INTEGER AS ln, CASE WHEN length(word) % 4 = 0 THEN '*' ELSE '普通名詞' END AS pos2,
    coalesce(sum(length(word)) OVER (PARTITION BY sid ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS off_start
  FROM chunk)"""
    )


_PIECES = _cut("12")

_GRID_OF = """,
child AS (SELECT sid, parent, min(chunk_id) AS min_child FROM chunk WHERE parent >= 0 GROUP BY ALL),
pairs AS (SELECT sid, chunk_id AS i, parent, dep_type, unnest(range(chunk_id + 1, n))::INTEGER AS j FROM chunk),
cell AS (
  SELECT p.sid, i, j, dep_type,
    CASE WHEN p.parent = j AND min_child < i THEN 'joins' WHEN p.parent = j THEN 'first'
      WHEN p.parent > j AND min_child < i THEN 'crosses' WHEN p.parent > j THEN 'passes'
      WHEN min_child < i THEN 'through' ELSE 'blank' END AS class
  FROM pairs p LEFT JOIN child c ON c.sid = p.sid AND c.parent = p.j)"""
_GRID = _PIECES + _GRID_OF

_DOC_WORDS = """
word AS (
  SELECT doc_id::VARCHAR AS sid, unnest(w) AS surface, unnest(range(len(w)))::INTEGER AS ln
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS w FROM documents)),
morpheme AS (
  SELECT sid, ln, (ln // 5)::INTEGER AS chunk_id, surface,
    coalesce(sum(length(surface)) OVER (PARTITION BY sid ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS off_start,
    (off_start + length(surface) - 1)::INTEGER AS off_end
  FROM word),
given AS (
  SELECT d.doc_id::VARCHAR AS sid, regexp_replace(d.text, '[ \\n]+', '', 'g') AS sent, regexp_replace(b.text, '[ \\n]+', '', 'g') AS expr,
    CASE WHEN item_id % 2 = 0 THEN '[著者]' ELSE source END AS holder, 'T' || item_id % 3 AS type, lang AS target, item_id
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)
  WHERE len(list_filter(regexp_split_to_array(b.text, '[ \\n]+'), lambda w: w <> '')) > 0),
opinion AS (
  SELECT sid, (row_number() OVER (PARTITION BY sid ORDER BY item_id, holder, expr, type, target) - 1)::INTEGER AS idx, holder, expr,
    (instr(sent, expr) - 1)::INTEGER AS start, (instr(sent, expr) - 2 + length(expr))::INTEGER AS "end", type, target
  FROM given),
overlap AS (
  SELECT m.sid, ln, min(idx) AS idx FROM morpheme m JOIN opinion o ON m.sid = o.sid AND "end" >= off_start AND start <= off_end GROUP BY m.sid, ln)"""

_HEADINGS = (
    _PIECES
    + """,
plain AS (
  SELECT sid, array_to_string(list_filter(w, lambda x: NOT starts_with(x, 'E')), '') AS text FROM piece
  WHERE len(list_filter(w, lambda x: NOT starts_with(x, 'E'))) > 0),
article AS (
  SELECT DISTINCT article, CASE WHEN contains(article, '_en_') THEN '_en_' WHEN contains(article, '_de_') THEN '_de_'
    WHEN contains(article, '_fr_') THEN '_fr_' WHEN contains(article, '_es_') THEN '_es_' END AS category FROM piece),
heading AS (SELECT article, category, text AS heading FROM article LEFT JOIN plain ON sid = article || '-1-1-01')"""
)


_PHRASES = """
worded AS (
  SELECT doc_id::VARCHAR AS sid, lang, source, w, array_to_string(w, '') AS sent
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0),
phrase AS (SELECT *, unnest(range((len(w) - 1) // 40 + 1)) AS k FROM worded),
phrases AS (
  SELECT sid, k, sent, array_to_string(w[k * 40 + kind + 1 : k * 40 + kind + 3 + 2 * kind], '') AS expr,
    CASE WHEN k % 2 = 0 THEN '[著者]' ELSE source END AS holder, 'T' || k % 3 AS type, lang AS target
  FROM phrase CROSS JOIN (SELECT unnest([0, 1]) AS kind) WHERE k * 40 + kind < len(w)),
told AS (
  SELECT sid, (row_number() OVER (PARTITION BY sid ORDER BY k, holder, expr, type, target) - 1)::INTEGER AS idx, holder, expr,
    (instr(sent, expr) - 1)::INTEGER AS start, (instr(sent, expr) - 2 + length(expr))::INTEGER AS "end", type, target
  FROM phrases)"""

_PHRASES_ON_WORDS = (
    _DOC_WORDS
    + ","
    + _PHRASES
    + """,
covered AS (SELECT m.sid, ln, min(idx) AS idx FROM morpheme m JOIN told o ON m.sid = o.sid AND "end" >= off_start AND start <= off_end GROUP BY m.sid, ln)"""
)


def _greedy(words: int, seeds: int) -> str:
    """Clusters of the most frequent words, one word a step of the recursion."""
    return (
        _VOCAB.replace("8000", str(words))
        + f""",
edge AS (
  SELECT greatest(a.rank, b.rank) AS r, least(a.rank, b.rank) AS o, a.rank < b.rank AS back, wpmi AS w
  FROM pmi JOIN vocab a ON prev = a.word JOIN vocab b ON curr = b.word WHERE a.rank <> b.rank),
near AS (
  SELECT rank AS r, list({{'o': o, 'w': w}} ORDER BY o, back) FILTER (o IS NOT NULL) AS e
  FROM vocab LEFT JOIN edge ON r = rank WHERE rank > {seeds} GROUP BY rank),
placed AS (
  SELECT {seeds}::BIGINT AS r, range(1, {seeds} + 1) AS cl
  UNION ALL
  SELECT r, list_append(cl, list_position(score, list_max(score))::BIGINT) AS cl FROM (
    SELECT n.r, cl, list_transform(range(1, {seeds} + 1), lambda c: coalesce(list_sum(list_transform(list_filter(e, lambda x: cl[x.o] = c), lambda x: x.w)), 0.0)) AS score
    FROM placed p JOIN near n ON n.r = p.r + 1))"""
    )


def _sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


ORACLES = {
    "bigram_counts": _sql(_COUNTS, "SELECT * FROM bi"),
    "unigram_counts": _sql(_COUNTS, "SELECT * FROM uni"),
    "bigram_counts_by_group": _sql(_COUNTS, "SELECT grp, prev, curr, count(*) AS cnt FROM pair GROUP BY ALL"),
    "vocabulary": _sql(_VOCAB, "SELECT word, cnt, rank::INTEGER AS rank FROM vocab"),
    "filtered_bigrams": _sql(_VOCAB, "SELECT * FROM fbi"),
    "filtered_unigrams": _sql(_VOCAB.replace("known AS (", "known AS MATERIALIZED (").replace("uni AS (\n", "uni AS MATERIALIZED (\n", 1), "SELECT uni.word, uni.cnt FROM known JOIN uni USING (word)"),
    "bigram_mass": _sql(_VOCAB, "SELECT * FROM mass"),
    "weighted_pmi": _sql(_VOCAB, "SELECT prev, curr, cnt, round(wpmi, 6) AS wpmi FROM pmi"),
    "seed_clusters": _sql(_SEEDS, "SELECT * FROM seed"),
    "seed_affinity": _sql(_SEEDS, "SELECT * FROM affinity"),
    "seed_assignment": _sql(_ASSIGNED, "SELECT * FROM assigned"),
    "stored_clusters": _sql(_ASSIGNED, "SELECT * FROM assigned"),
    "gold_path_bigrams": _sql(_COUNTS, "SELECT * FROM bi"),
    "cluster_sizes": _sql(_ASSIGNED, "SELECT cluster, count(*) AS n_words FROM assigned GROUP BY cluster"),
    "cluster_mass": _sql(_ASSIGNED, "SELECT cluster, sum(cnt)::DOUBLE AS mass FROM assigned JOIN uni USING (word) GROUP BY cluster"),
    "cluster_lookup": _sql(
        _ASSIGNED,
        """, token AS (SELECT doc_id, line_no::INTEGER AS line_no, unnest(words) AS word, unnest(range(len(words)))::INTEGER AS place FROM sentence)
SELECT doc_id, line_no, place, word, coalesce(cluster, 0)::INTEGER AS cluster FROM token LEFT JOIN assigned USING (word)""",
    ),
    "line_kinds": _sql(
        _PIECES,
        """SELECT sid, unnest(['header', 'chunk', 'morpheme', 'end']) AS kind, unnest([1, len(w), len(w), CASE WHEN len(w) > 6 THEN 2 ELSE 1 END])::BIGINT AS n_lines FROM piece""",
    ),
    "chunks": _sql(_PIECES, "SELECT sid, chunk_id, kind, parent, dep_type, concat_ws(', ', linked_label, 'LOCA:' || named) AS label FROM chunk"),
    "morphemes": _sql(
        _PIECES,
        """SELECT sid, chunk_id, ln, word AS surface, word AS reading, word AS lemma, '名詞' AS pos1, pos2,
  '*' AS conj_type, '*' AS conj_form, off_start, (off_start + length(word) - 1)::INTEGER AS off_end FROM off""",
    ),
    "morpheme_display": _sql(_PIECES, "SELECT sid, ln, word AS surface, word AS reading, word AS lemma, '名詞 ' || CASE WHEN pos2 = '*' THEN '' ELSE pos2 END AS pos, ' ' AS conj FROM off"),
    "case_links": _sql(_PIECES, "SELECT sid, chunk_id, 0 AS idx, linked AS word, marker, position FROM chunk WHERE linked IS NOT NULL"),
    "entities": _sql(_PIECES, "SELECT sid, chunk_id, 0 AS idx, 'LOCA' AS type, named AS word FROM chunk WHERE named IS NOT NULL"),
    "sentence_table": _sql(_PIECES, "SELECT sid, article, sent_no, sub_no, '# S-ID:' || sid AS header, array_to_string(w, '') AS text FROM piece"),
    "chunk_text": _sql(_PIECES, "SELECT sid, chunk_id, word AS text, concat_ws(', ', linked_label, 'LOCA:' || named) AS label FROM chunk"),
    "sentence_text": _sql(
        _PIECES,
        """SELECT sid, 0 AS block, array_to_string(w[1:CASE WHEN len(w) > 6 THEN 6 ELSE len(w) END], '') AS text FROM piece
UNION ALL SELECT sid, 1 AS block, array_to_string(w[7:], '') AS text FROM piece WHERE len(w) > 6""",
    ),
    "plain_text": _sql(_HEADINGS, "SELECT * FROM plain"),
    "children": _sql(_PIECES, "SELECT sid, parent, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS children, min(chunk_id) AS min_child FROM chunk WHERE parent >= 0 GROUP BY ALL"),
    "dependency_edges": _sql(_PIECES, "SELECT sid, chunk_id AS child, parent, dep_type FROM chunk"),
    "chunk_counts": _sql(_PIECES, "SELECT sid, len(w)::INTEGER AS n_chunks FROM piece"),
    "grid_cells": _sql(_GRID, "SELECT sid, class, count(*) AS n_cells FROM cell GROUP BY ALL"),
    "grid_rows": _sql(
        _GRID,
        """SELECT sid, i, string_agg(CASE class WHEN 'joins' THEN CASE WHEN dep_type = 'D' THEN '┫' ELSE dep_type END
    WHEN 'first' THEN CASE WHEN dep_type = 'D' THEN '┓' ELSE dep_type END
    WHEN 'crosses' THEN '╋' WHEN 'passes' THEN '━' WHEN 'through' THEN '┃' ELSE '　' END, '' ORDER BY j) AS drawing
FROM cell GROUP BY sid, i""",
    ),
    "line_grid_cells": _sql(_cut("len(ws)") + _GRID_OF, "SELECT sid, class, count(*) AS n_cells FROM cell GROUP BY ALL"),
    "rejects": _sql(_PIECES, "SELECT sid, chunk_ln AS ln, 'link' AS reason FROM chunk WHERE length(linked) % 11 = 0"),
    "output_rows": _sql(_PIECES, "SELECT sid, chunk_id, ln, kind, parent, c.word AS surface FROM chunk c JOIN off USING (sid, chunk_id)"),
    "morpheme_offsets": _sql(_DOC_WORDS, "SELECT * FROM morpheme"),
    "opinion_spans": _sql(_DOC_WORDS, "SELECT * FROM opinion"),
    "stored_opinions": _sql(_DOC_WORDS, "SELECT * FROM opinion"),
    "opinion_files": _sql(_DOC_WORDS, "SELECT * FROM opinion"),
    "marked_morphemes": _sql(_DOC_WORDS.replace("morpheme AS (", "morpheme AS MATERIALIZED (").replace("opinion AS (", "opinion AS MATERIALIZED ("), "SELECT sid, ln, idx, idx IS NOT NULL AS in_opinion FROM morpheme LEFT JOIN overlap USING (sid, ln)"),
    "sentence_opinions": _sql(_DOC_WORDS, "SELECT d.doc_id::VARCHAR AS sid, count(o.idx) AS n_opinions FROM documents d LEFT JOIN opinion o ON o.sid = d.doc_id::VARCHAR GROUP BY d.doc_id"),
    "opinion_overlap": _sql(_DOC_WORDS, "SELECT * FROM overlap"),
    "chunk_opinions": _sql(
        _DOC_WORDS,
        """, first AS (SELECT sid, idx, min(ln) AS ln FROM overlap GROUP BY sid, idx),
told AS (
  SELECT f.sid, f.ln, f.idx, type || '[' || target || ']' || CASE WHEN holder = '[著者]' THEN '' ELSE ':' || holder END AS label
  FROM first f JOIN opinion o ON f.sid = o.sid AND f.idx = o.idx)
SELECT m.sid, chunk_id, coalesce(string_agg(label, ', ' ORDER BY m.ln, idx), '') AS labels, count(label) > 0 AS with_sentiment
FROM morpheme m LEFT JOIN told t ON m.sid = t.sid AND m.ln = t.ln GROUP BY m.sid, chunk_id""",
    ),
    "article_categories": _sql(_HEADINGS, "SELECT * FROM article"),
    "article_headings": _sql(_HEADINGS, "SELECT category, article, heading FROM heading WHERE category IS NOT NULL AND heading IS NOT NULL"),
    "headings_by_category": _sql(_HEADINGS, "SELECT category, article, heading FROM heading WHERE category IS NOT NULL AND heading IS NOT NULL"),
    "article_rejects": _sql(_HEADINGS, "SELECT article, CASE WHEN category IS NULL THEN 'category' ELSE 'heading' END AS reason FROM heading WHERE category IS NULL OR heading IS NULL"),
    "category_sizes": _sql(_HEADINGS, "SELECT category, count(*) AS n_articles FROM heading WHERE category IS NOT NULL AND heading IS NOT NULL GROUP BY category"),
    "word_ranks": _sql(_COUNTS, "SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS rank FROM uni WHERE word NOT IN ('BOS', 'EOS')"),
    "brown_clusters_top": _sql(
        _greedy(1000, 64),
        """SELECT word, cl[rank]::INTEGER AS cluster FROM vocab CROSS JOIN (SELECT cl FROM placed ORDER BY r DESC LIMIT 1)
UNION ALL SELECT unnest(['BOS', 'EOS']), 0""",
    ),
    "phrase_opinions": _sql(_PHRASES, "SELECT * FROM told"),
    "phrase_overlap": _sql(_PHRASES_ON_WORDS, "SELECT * FROM covered"),
    "phrase_labels": _sql(
        _PHRASES_ON_WORDS,
        """, start_ AS (SELECT sid, idx, min(ln) AS ln FROM covered GROUP BY sid, idx),
label AS (
  SELECT f.sid, f.ln, f.idx, type || '[' || target || ']' || CASE WHEN holder = '[著者]' THEN '' ELSE ':' || holder END AS label
  FROM start_ f JOIN told o ON f.sid = o.sid AND f.idx = o.idx)
SELECT m.sid, chunk_id, coalesce(string_agg(label, ', ' ORDER BY m.ln, idx), '') AS labels, count(label) > 0 AS with_sentiment
FROM morpheme m LEFT JOIN label t ON m.sid = t.sid AND m.ln = t.ln GROUP BY m.sid, chunk_id""",
    ),
    "reannotated_opinions": _sql(
        _PHRASES_ON_WORDS,
        """, gone AS (SELECT doc_id::VARCHAR AS sid FROM documents WHERE lang = 'fr')
SELECT * FROM opinion WHERE sid NOT IN (SELECT sid FROM gone)
UNION ALL SELECT * FROM told WHERE sid NOT IN (SELECT sid FROM opinion) AND sid NOT IN (SELECT sid FROM gone)""",
    ),
    "article_manifest": _sql(_PIECES, "SELECT article, count(*) AS n_sentences, 1::BIGINT AS n_files FROM piece GROUP BY article"),
    "corpus_files": _sql(
        _PIECES,
        """SELECT article || '-1-1-01' AS sid, string_agg(array_to_string(w, ''), '' ORDER BY sent_no, sub_no) AS text, count(*) AS n_pieces
FROM piece GROUP BY article""",
    ),
    "reject_counts": _sql(
        _PIECES,
        """SELECT unnest(['lines', 'chunk', 'link', 'entity']) AS what, unnest([count(*), 0, count(*) FILTER (length(linked) % 11 = 0), 0])::BIGINT AS n FROM chunk""",
    ),
    "sentence_order": _sql(_PIECES, "SELECT article, sid, sent_no, row_number() OVER (PARTITION BY article ORDER BY sent_no, sid)::INTEGER AS place FROM piece"),
}
