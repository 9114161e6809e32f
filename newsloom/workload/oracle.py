"""SQL twins of the registered queries, for DuckDB over the same tables."""

ARTICLES = """
articles AS (
  SELECT d.doc_id AS article_id,
         concat('https://example.com/entry/', d.doc_id) AS link,
         md5(concat('https://example.com/entry/', d.doc_id)) AS link_hash,
         concat('Entry ', d.doc_id, ' from ', d.source) AS headline,
         DATE '2012-01-01' + CAST(d.doc_id * 37 % 4000 AS INT) AS date,
         d.lang AS category, d.text AS summarization
  FROM (SELECT doc_id, source, lang, text FROM documents
        UNION ALL
        SELECT vec_id, 'vectors', 'en', concat('Entry ', vec_id, ' has a vector and no document')
        FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) d
)"""

LISTS = """
words AS (
  SELECT DISTINCT article_id, tag FROM (
    SELECT article_id,
           unnest(string_split(lower(regexp_replace(summarization, '[^A-Za-z]+', ' ', 'g')), ' ')) AS tag
    FROM articles) x
  WHERE length(tag) BETWEEN 4 AND 12
),
sentences AS (
  SELECT DISTINCT article_id, key_insight FROM (
    SELECT article_id, trim(unnest(string_split(summarization, '. ')), ' ') AS key_insight
    FROM articles) x
  WHERE length(key_insight) > 20
),
tag_lists AS (
  SELECT article_id, string_agg(tag, '|' ORDER BY tag) AS tag_names, count(*) AS n_tags
  FROM words GROUP BY article_id
),
insight_lists AS (
  SELECT article_id, string_agg(key_insight, '|' ORDER BY key_insight) AS key_insights,
         count(*) AS n_insights, max(length(key_insight)) AS longest
  FROM sentences GROUP BY article_id
)"""

# Lists in the order of the text, as the arrays of the ingest hold them.
ORDERED = """
word_places AS (
  SELECT article_id, tag, min(place) AS place FROM (
    SELECT article_id, unnest(w) AS tag, generate_subscripts(w, 1) AS place FROM (
      SELECT article_id,
             string_split(lower(regexp_replace(summarization, '[^A-Za-z]+', ' ', 'g')), ' ') AS w
      FROM articles) y) x
  WHERE length(tag) BETWEEN 4 AND 12 GROUP BY article_id, tag
),
sentence_places AS (
  SELECT article_id, key_insight, min(place) AS place FROM (
    SELECT article_id, trim(unnest(s), ' ') AS key_insight, generate_subscripts(s, 1) AS place FROM (
      SELECT article_id, string_split(summarization, '. ') AS s FROM articles) y) x
  WHERE length(key_insight) > 20 GROUP BY article_id, key_insight
),
ordered_lists AS (
  SELECT a.article_id, coalesce(w.tags, '') AS tags, coalesce(s.key_insights, '') AS key_insights
  FROM articles a
  LEFT JOIN (SELECT article_id, string_agg(tag, '|' ORDER BY place) AS tags
             FROM word_places GROUP BY 1) w USING (article_id)
  LEFT JOIN (SELECT article_id, string_agg(key_insight, '|' ORDER BY place) AS key_insights
             FROM sentence_places GROUP BY 1) s USING (article_id)
)"""

SEARCHES = """
searches AS (
  SELECT CAST(vec_id AS BIGINT) AS query_id,
         string_split(CASE vec_id % 3 WHEN 0 THEN 'that,with,oner' WHEN 1 THEN 'nicht,pour,para'
                      ELSE 'hector,achilles' END, ',') AS tags,
         CAST(embedding AS DOUBLE[]) AS query_vec
  FROM embeddings WHERE vec_id % 50 = 0
)"""

MATCHES = """
matches AS (
  SELECT s.query_id, w.article_id, string_agg(w.tag, '|' ORDER BY w.tag) AS tag_names,
         count(*) AS n_tags
  FROM (SELECT DISTINCT query_id, unnest(tags) AS tag FROM searches) s
  JOIN words w ON w.tag = s.tag GROUP BY 1, 2
)"""

DISTANCES = """
distances AS (
  SELECT s.query_id, e.vec_id AS article_id,
         1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), s.query_vec) AS distance
  FROM embeddings e JOIN articles a ON a.article_id = e.vec_id CROSS JOIN searches s
),
near_k AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, article_id) AS n
    FROM distances) x
  WHERE n <= 10
)"""

TAGGED_K = """
tagged_k AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_tags DESC, article_id) AS n
    FROM matches) x
  WHERE n <= 10
)"""

STORED_TAGS = """
stored_tags AS (
  SELECT DISTINCT tag, CAST('0x' || substr(md5(tag), 1, 15) AS BIGINT) AS tag_id
  FROM words JOIN articles USING (article_id) WHERE date < DATE '2016-01-01'
),
added_tags AS (
  SELECT tag, (SELECT max(tag_id) FROM stored_tags)
              + row_number() OVER (ORDER BY md5(tag), tag) AS tag_id
  FROM (SELECT DISTINCT tag FROM words WHERE tag NOT IN (SELECT tag FROM stored_tags)) x
)"""

FRESH = """
fresh AS (
  SELECT (SELECT max(article_id) FROM articles WHERE date < DATE '2016-01-01')
         + row_number() OVER (ORDER BY md5(link_hash), link_hash) AS new_id, *
  FROM articles WHERE date >= DATE '2016-01-01'
)"""

CATEGORY_ROWS = """
category_rows AS (
  SELECT article_id, link, link_hash, headline, date FROM articles
  UNION ALL
  SELECT article_id, link, link_hash, concat('Again: ', headline), date
  FROM articles WHERE category = 'en'
)"""

CONTENTS = """
contents AS (
  SELECT doc_id, concat('https://example.com/entry/', doc_id) AS link,
         CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS content,
         md5(concat('https://example.com/entry/', doc_id)) AS link_hash
  FROM documents
)"""

RESPONSES = """
outcomes AS (
  SELECT article_id,
         CASE article_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid_summary' WHEN 2 THEN 'no_choices'
              WHEN 3 THEN 'api_error' WHEN 4 THEN 'unexpected' ELSE 'undecodable' END AS outcome
  FROM articles
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


ORACLE = {
    "hybrid_search": _with(ARTICLES, LISTS, SEARCHES, MATCHES, DISTANCES, TAGGED_K)
    + """
, both_lists AS (
  SELECT query_id, article_id, n.article_id IS NOT NULL AS is_near
  FROM (SELECT query_id, article_id FROM near_k UNION SELECT query_id, article_id FROM tagged_k) u
  LEFT JOIN near_k n USING (query_id, article_id)
), complete AS (
  SELECT b.query_id, b.article_id, b.is_near, d.distance, i.key_insights,
         coalesce(m.tag_names, '') AS tag_names, coalesce(m.n_tags, 0) AS n_tags
  FROM both_lists b JOIN distances d USING (query_id, article_id)
  JOIN insight_lists i USING (article_id)
  LEFT JOIN matches m USING (query_id, article_id)
)
SELECT c.query_id,
       row_number() OVER (PARTITION BY c.query_id
                          ORDER BY n_tags DESC, distance NULLS LAST, c.article_id) AS article_position_id,
       CASE WHEN is_near THEN row_number() OVER (PARTITION BY c.query_id, is_near
            ORDER BY distance NULLS LAST, c.article_id) END AS embedding_position_id,
       a.summarization, round(distance, 4) AS distance, a.link, a.link_hash, a.headline,
       a.date AS published_date, c.tag_names, c.key_insights
FROM complete c JOIN articles a USING (article_id)""",
    "semantic_topk": _with(ARTICLES, LISTS, SEARCHES, DISTANCES)
    + """
SELECT query_id,
       row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, article_id)
         AS embedding_position_id,
       article_id, round(distance, 4) AS distance
FROM near_k WHERE article_id IN (SELECT article_id FROM sentences)""",
    "lexical_topk": _with(ARTICLES, LISTS, SEARCHES, MATCHES, DISTANCES, TAGGED_K)
    + """
SELECT t.query_id, t.article_id, t.tag_names, t.n_tags, round(d.distance, 4) AS distance
FROM tagged_k t JOIN distances d USING (query_id, article_id)
WHERE t.article_id IN (SELECT article_id FROM sentences)""",
    "tag_match": _with(ARTICLES, LISTS, SEARCHES, MATCHES)
    + "SELECT query_id, article_id, tag_names FROM matches",
    "insights_agg": _with(ARTICLES, LISTS) + "SELECT article_id, key_insights FROM insight_lists",
    "cosine_distance": """
SELECT l.vec_id,
       round(1 - list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 4)
         AS distance,
       round(1 - list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 4)
         AS unit_distance
FROM embeddings l JOIN embeddings r ON l.vec_id = r.vec_id + 1""",
    "ann_topk": _with(ARTICLES, SEARCHES, DISTANCES)
    + """
, means AS (
  SELECT label, list(x ORDER BY place) AS centre FROM (
    SELECT label, place, avg(CAST(x AS DOUBLE)) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) z
    GROUP BY 1, 2) y
  GROUP BY label
), placed AS (
  SELECT vec_id, label AS cell FROM (
    SELECT e.vec_id, m.label,
           row_number() OVER (PARTITION BY e.vec_id ORDER BY
             list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), m.centre) DESC, m.label) AS n
    FROM embeddings e CROSS JOIN means m) x WHERE n = 1
), probed AS (
  SELECT query_id, cell FROM (
    SELECT s.query_id, m.label AS cell,
           row_number() OVER (PARTITION BY s.query_id ORDER BY
             list_cosine_similarity(s.query_vec, m.centre) DESC, m.label) AS n
    FROM searches s CROSS JOIN means m) x WHERE n <= 4
)
SELECT query_id, article_id, round(distance, 4) AS distance FROM (
  SELECT d.*, row_number() OVER (PARTITION BY d.query_id ORDER BY distance NULLS LAST, article_id) AS n
  FROM distances d JOIN placed p ON p.vec_id = d.article_id
  JOIN probed q ON q.query_id = d.query_id AND q.cell = p.cell) x
WHERE n <= 10""",
    "ann_topk_all_cells": _with(ARTICLES, SEARCHES, DISTANCES)
    + "SELECT query_id, article_id, round(distance, 4) AS distance FROM near_k",
    "article_lookup": _with(ARTICLES, LISTS)
    + """
SELECT k.link_hash, a.article_id IS NOT NULL AS found, a.link, a.headline,
       a.date AS published_date, a.summarization,
       CASE WHEN a.article_id IS NOT NULL THEN coalesce(t.tag_names, '') END AS tag_names,
       CASE WHEN a.article_id IS NOT NULL THEN coalesce(i.key_insights, '') END AS key_insights
FROM (SELECT link_hash FROM articles UNION ALL SELECT md5(url) FROM pages) k
LEFT JOIN articles a ON a.link_hash = k.link_hash
LEFT JOIN tag_lists t ON t.article_id = a.article_id
LEFT JOIN insight_lists i ON i.article_id = a.article_id""",
    "request_validate": """
WITH named AS (
  SELECT doc_id AS query_id,
         CASE doc_id % 5 WHEN 0 THEN concat(source, ',', lang) WHEN 1 THEN concat(source, ', ', lang)
              WHEN 2 THEN concat(source, ',,', lang) WHEN 3 THEN '' END AS tag_names
  FROM documents
), split AS (
  SELECT *, coalesce(tag_names, '') = '' AS refused, string_split(tag_names, ',') AS parts FROM named
)
SELECT query_id, CASE WHEN refused THEN 'tag_names is required' END AS reason,
       CASE WHEN NOT refused THEN array_to_string(parts, '|') END AS tags,
       CASE WHEN NOT refused THEN len(parts) END AS n_tags,
       CASE WHEN NOT refused THEN array_to_string(parts, chr(10) || ' ') END AS query_text,
       CASE WHEN refused THEN 'link_hash is required' END AS lookup_reason
FROM split""",
    "ingest_join": _with(ARTICLES, ORDERED, CATEGORY_ROWS)
    + """
SELECT c.link, c.link_hash, c.headline, c.date, a.summarization, o.tags, o.key_insights
FROM category_rows c JOIN articles a USING (link_hash)
JOIN ordered_lists o ON o.article_id = a.article_id""",
    "ingest_new_articles": _with(ARTICLES, FRESH) + "SELECT link_hash, link, headline, date FROM fresh",
    "ingest_articles": _with(ARTICLES, FRESH)
    + "SELECT new_id AS article_id, link_hash, link, headline, date FROM fresh",
    "ingest_new_tags": _with(ARTICLES, LISTS, STORED_TAGS) + "SELECT tag_id, tag FROM added_tags",
    "ingest_article_tags": _with(ARTICLES, LISTS, STORED_TAGS, FRESH)
    + """
SELECT f.new_id AS article_id, t.tag_id
FROM fresh f JOIN words w USING (article_id)
JOIN (SELECT tag, tag_id FROM stored_tags UNION ALL SELECT tag, tag_id FROM added_tags) t USING (tag)""",
    "ingest_key_insights": _with(ARTICLES, LISTS, FRESH)
    + """
SELECT row_number() OVER (ORDER BY md5(concat(f.new_id, '|', s.key_insight)), f.new_id, s.key_insight)
         AS key_insight_id,
       s.key_insight, f.new_id AS article_id
FROM fresh f JOIN sentences s USING (article_id)""",
    "ingest_run": _with(ARTICLES, LISTS)
    + """
, kept AS (
  SELECT article_id FROM articles LEFT JOIN insight_lists USING (article_id)
  WHERE coalesce(longest, 0) <= 1000
)
SELECT 'articles' AS table_name, link_hash, concat_ws('|', link, headline, CAST(date AS VARCHAR)) AS value
FROM articles JOIN kept USING (article_id)
UNION ALL SELECT 'embeddings', link_hash, concat_ws('|', summarization, '64') FROM articles JOIN kept USING (article_id)
UNION ALL SELECT DISTINCT 'tags', '', tag FROM words JOIN kept USING (article_id)
UNION ALL SELECT 'article_tags', link_hash, tag FROM words JOIN kept USING (article_id) JOIN articles USING (article_id)
UNION ALL SELECT 'key_insights', link_hash, key_insight
FROM sentences JOIN kept USING (article_id) JOIN articles USING (article_id)""",
    "store_revisions": _with(ARTICLES)
    + """
, stored AS (
  SELECT a.article_id, a.summarization AS old_text, e.embedding
  FROM articles a JOIN embeddings e ON e.vec_id = a.article_id
  WHERE a.article_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
), revised AS (
  SELECT article_id, old_text || ' revised' AS summarization FROM stored
  WHERE old_text IS NOT NULL AND article_id IN (SELECT doc_id FROM labels WHERE quality = 0)
), slots AS (
  SELECT article_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS n
  FROM (SELECT article_id, unnest(regexp_extract_all(lower(summarization), '[a-z0-9]+')) AS word FROM revised) x
  GROUP BY 1, 2
), lengths AS (
  SELECT article_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS len FROM slots GROUP BY 1
), vectors AS (
  SELECT r.article_id,
         string_agg(CAST(CAST(round(CAST(CAST(coalesce(s.n / l.len, 0) AS FLOAT) AS DOUBLE) * 1e4) AS BIGINT) AS VARCHAR),
                    '|' ORDER BY g.slot) AS embedding
  FROM revised r CROSS JOIN (SELECT unnest(range(64)) AS slot) g
  LEFT JOIN slots s ON s.article_id = r.article_id AND s.slot = g.slot
  LEFT JOIN lengths l ON l.article_id = r.article_id
  GROUP BY 1
)
SELECT s.article_id, s.article_id AS embedding_id, coalesce(r.summarization, s.old_text) AS summarization,
       coalesce(v.embedding, array_to_string(list_transform(s.embedding,
         lambda x: CAST(round(CAST(CAST(x AS FLOAT) AS DOUBLE) * 1e4) AS BIGINT)), '|')) AS embedding,
       '2024-01-01 00:00:00' AS created_at,
       CASE WHEN r.article_id IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END AS updated_at
FROM stored s LEFT JOIN revised r USING (article_id) LEFT JOIN vectors v USING (article_id)""",
    "store_compaction": _with(ARTICLES, LISTS)
    + """
, kept AS (SELECT article_id FROM articles WHERE article_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT 'articles' AS table_name, link_hash, concat_ws('|', link, headline, CAST(date AS VARCHAR)) AS value
FROM articles JOIN kept USING (article_id)
UNION ALL SELECT 'embeddings', link_hash,
  concat_ws('|', CASE WHEN summarization IS NOT NULL AND article_id IN (SELECT doc_id FROM labels WHERE quality = 0)
                      THEN summarization || ' revised' ELSE summarization END,
            '2024-01-01 00:00:00',
            CASE WHEN summarization IS NOT NULL AND article_id IN (SELECT doc_id FROM labels WHERE quality = 0)
                 THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END)
FROM articles JOIN kept USING (article_id) WHERE article_id IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT DISTINCT 'tags', '', tag FROM words
UNION ALL SELECT 'article_tags', link_hash, tag FROM words JOIN kept USING (article_id) JOIN articles USING (article_id)
UNION ALL SELECT 'key_insights', link_hash, key_insight
FROM sentences JOIN kept USING (article_id) JOIN articles USING (article_id)""",
    "embed_delta": _with(ARTICLES)
    + """
, changes AS (
  SELECT article_id, summarization,
         CASE WHEN date >= DATE '2016-01-01' THEN 'new' ELSE 'changed' END AS change
  FROM articles WHERE date >= DATE '2016-01-01' OR category = 'fr'
), slots AS (
  SELECT article_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS n
  FROM (SELECT article_id, unnest(regexp_extract_all(lower(summarization), '[a-z0-9]+')) AS word
        FROM changes) x
  GROUP BY 1, 2
), lengths AS (
  SELECT article_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS len FROM slots GROUP BY 1
)
SELECT c.article_id, c.change,
       string_agg(CAST(CAST(round(CAST(CAST(coalesce(s.n / l.len, 0) AS FLOAT) AS DOUBLE) * 1e4) AS BIGINT) AS VARCHAR),
                  '|' ORDER BY g.slot) AS embedding
FROM changes c CROSS JOIN (SELECT unnest(range(64)) AS slot) g
LEFT JOIN slots s ON s.article_id = c.article_id AND s.slot = g.slot
LEFT JOIN lengths l ON l.article_id = c.article_id
GROUP BY 1, 2""",
    "constraint_check": _with(ARTICLES, LISTS)
    + """
SELECT a.article_id,
       CASE WHEN a.article_id % 8 = 1 THEN 'link_hash_too_long'
            WHEN a.article_id % 8 = 2 THEN 'link_too_long'
            WHEN a.article_id % 8 = 5 THEN 'tag_too_long'
            WHEN coalesce(i.longest, 0) > 1000 THEN 'key_insight_too_long'
            WHEN a.article_id % 8 = 3 THEN 'headline_missing'
            WHEN a.article_id % 8 = 4 THEN 'date_missing' END AS reason,
       CASE WHEN a.article_id % 8 = 6 THEN coalesce(i.n_insights, 0) ELSE 0 END AS n_repeated_insights
FROM articles a LEFT JOIN insight_lists i USING (article_id)""",
    "unique_audit": _with(ARTICLES, LISTS)
    + """
, again AS (SELECT * FROM articles WHERE category = 'en'),
  tag_ids AS (SELECT DISTINCT tag, CAST('0x' || substr(md5(tag), 1, 15) AS BIGINT) AS tag_id FROM words),
  again_words AS (SELECT w.article_id, w.tag, t.tag_id FROM words w JOIN again USING (article_id)
                  JOIN tag_ids t USING (tag)),
  again_insights AS (SELECT s.* FROM sentences s JOIN again USING (article_id)),
  found AS (
    SELECT 'articles_link_hash' AS rule, link_hash AS key FROM again
    UNION ALL SELECT 'articles_link', link FROM again
    UNION ALL SELECT 'articles_id', CAST(article_id AS VARCHAR) FROM again
    UNION ALL SELECT DISTINCT 'tags_tag', tag FROM again_words
    UNION ALL SELECT DISTINCT 'tags_id', CAST(tag_id AS VARCHAR) FROM again_words
    UNION ALL SELECT 'article_tags_pair', concat(article_id, '|', tag_id) FROM again_words
    UNION ALL SELECT 'key_insights_pair', concat(key_insight, '|', article_id) FROM again_insights
    UNION ALL SELECT 'key_insights_id',
      CAST(CAST('0x' || substr(md5(concat(article_id, '|', key_insight)), 1, 15) AS BIGINT) AS VARCHAR)
      FROM again_insights
    UNION ALL SELECT 'embeddings_id', CAST(article_id AS VARCHAR) FROM again
      WHERE article_id IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'one_embedding_per_article', CAST(article_id AS VARCHAR) FROM again
      WHERE article_id IN (SELECT vec_id FROM embeddings)
  )
SELECT rule, md5(key) AS key, CAST(2 AS BIGINT) AS n_rows FROM found""",
    "orphan_audit": _with(ARTICLES, LISTS, STORED_TAGS)
    + """
, late AS (SELECT article_id FROM articles WHERE date >= DATE '2016-01-01')
SELECT 'article_tags_article' AS rule, article_id AS key, count(*) AS n_rows
FROM words JOIN late USING (article_id) GROUP BY 2
UNION ALL
SELECT 'article_tags_tag', CAST('0x' || substr(md5(tag), 1, 15) AS BIGINT), count(*)
FROM words WHERE tag NOT IN (SELECT tag FROM stored_tags) GROUP BY 2
UNION ALL
SELECT 'key_insights_article', article_id, count(*) FROM sentences JOIN late USING (article_id) GROUP BY 2
UNION ALL
SELECT 'embeddings_article', article_id, count(*) FROM late
WHERE article_id IN (SELECT vec_id FROM embeddings) GROUP BY 2""",
    "cascade_delete": _with(ARTICLES, LISTS)
    + """
, kept AS (SELECT article_id FROM articles WHERE category <> 'fr'),
  gone AS (SELECT DISTINCT tag FROM words JOIN articles USING (article_id) WHERE category = 'de')
SELECT 'articles' AS table_name, article_id, count(*) AS n_rows FROM kept GROUP BY 2
UNION ALL
SELECT 'article_tags', article_id, count(*) FROM words JOIN kept USING (article_id)
WHERE tag NOT IN (SELECT tag FROM gone) GROUP BY 2
UNION ALL
SELECT 'key_insights', article_id, count(*) FROM sentences JOIN kept USING (article_id) GROUP BY 2
UNION ALL
SELECT 'embeddings', article_id, count(*) FROM kept
WHERE article_id IN (SELECT vec_id FROM embeddings) GROUP BY 2""",
    "extract_filter": """
SELECT link, headline, strftime(date, '%Y-%m-%d') AS date FROM (
  SELECT lang, CASE WHEN doc_id % 7 = 0 THEN concat(base, base) ELSE base END AS link,
         concat('Entry ', doc_id) AS headline,
         DATE '2012-01-01' + CAST(doc_id * 37 % 4000 AS INT) AS date
  FROM (SELECT d.doc_id, d.lang, coalesce(p.url, concat('https://example.com/entry/', d.doc_id)) AS base
        FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id) y) x
WHERE lang = 'en' AND NOT regexp_matches(link, 'http.+https?') AND date >= DATE '2015-01-01'""",
    "link_parts": """
WITH parts AS (
  SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme,
         regexp_extract(url, '^https?://([^/]+)', 1) AS host,
         regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS rest
  FROM pages
)
SELECT page_id, page_id % 3 <> 1 AS is_valid,
       CASE WHEN page_id % 3 <> 1 THEN host ELSE '' END AS host,
       CASE WHEN page_id % 3 = 0 THEN concat(scheme, '://', host, '/')
            WHEN page_id % 3 = 2 THEN concat(scheme, '://', host, rest) END AS normalized
FROM parts""",
    "page_status": """
SELECT page_id, url AS link,
       CASE WHEN page_id % 9 = 0 OR html = '' THEN 'Failed to fetch' ELSE 'ok' END AS status
FROM pages""",
    "page_text": """
WITH cut AS (
  SELECT page_id, url,
         string_split(regexp_replace(regexp_replace(regexp_replace(html,
           '<(script|style)[^>]*>.*?</(script|style)>', chr(1), 'gs'),
           '<!--.*?-->', chr(1), 'gs'), '<[^>]*>', chr(1), 'g'), chr(1)) AS pieces
  FROM pages WHERE page_id % 9 <> 0
), pieces AS (
  SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS place FROM cut
), plain AS (
  SELECT page_id, place, regexp_replace(regexp_replace(
           regexp_replace(replace(replace(replace(piece, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'),
                          '&amp;?', '&', 'g'),
           '^\\s+', ''), '\\s+$', '') AS text
  FROM pieces
), contents AS (
  SELECT page_id, string_agg(text, ' ' ORDER BY place) AS content FROM plain WHERE text <> '' GROUP BY page_id
)
SELECT p.page_id, p.url AS link, CASE WHEN p.page_id % 9 <> 0 THEN coalesce(c.content, '') END AS content,
       CASE WHEN p.page_id % 9 = 0 THEN 'Failed to fetch' ELSE 'ok' END AS status
FROM pages p LEFT JOIN contents c USING (page_id)""",
    "request_build": _with(CONTENTS)
    + """
, judged AS (
  SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS chunk_number,
         CASE WHEN content = '' THEN 'malformed' WHEN length(content) < 100 THEN 'short' END AS reason
  FROM contents
), numbered AS (
  SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (
              PARTITION BY chunk_number, reason IS NULL ORDER BY doc_id) - 1 END AS request_number
  FROM judged
)
SELECT doc_id, CAST(chunk_number AS BIGINT) AS chunk_number, request_number,
       CASE WHEN reason IS NULL
            THEN concat('summary_for_', link_hash, '_', request_number) END AS custom_id, reason
FROM numbered""",
    "request_counts": _with(CONTENTS)
    + """
SELECT CASE WHEN content = '' THEN 'malformed' WHEN length(content) < 100 THEN 'short'
            ELSE 'prepared' END AS outcome, count(*) AS n_rows
FROM contents GROUP BY 1""",
    "request_files": _with(CONTENTS)
    + """
, placed AS (
  SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS chunk_number FROM contents
)
SELECT link_hash, concat('Summarize the following web article content:', chr(10), chr(10), content) AS content,
       CAST(chunk_number AS BIGINT) AS chunk_number,
       row_number() OVER (PARTITION BY chunk_number ORDER BY doc_id) - 1 AS request_number
FROM placed WHERE length(content) >= 100 AND doc_id % 13 <> 0""",
    "response_parse": _with(ARTICLES, ORDERED, RESPONSES)
    + """
, ids AS (
  SELECT *, outcome <> 'undecodable' AS readable,
         concat('summary_for_', link_hash, '_', article_id % 50) AS full_id
  FROM articles JOIN outcomes USING (article_id) JOIN ordered_lists USING (article_id)
)
SELECT article_id, CASE WHEN readable THEN full_id END AS custom_id,
       CASE WHEN readable THEN link_hash END AS link_hash,
       CASE WHEN readable THEN CAST(article_id % 50 AS VARCHAR) END AS order_id, outcome,
       CASE WHEN outcome = 'ok' THEN summarization END AS summarization,
       CASE WHEN outcome = 'ok' THEN tags END AS tags,
       CASE WHEN outcome = 'ok' THEN key_insights END AS key_insights
FROM ids""",
    "outcome_counts": _with(ARTICLES, RESPONSES)
    + "SELECT outcome, count(*) AS n_lines FROM outcomes GROUP BY outcome",
    "summary_quality": _with(ARTICLES, LISTS)
    + """
, judged AS (
  SELECT a.article_id, a.summarization, coalesce(t.n_tags, 0) AS n_tags, coalesce(i.n_insights, 0) AS n_insights,
         NOT EXISTS (SELECT 1 FROM sentences s WHERE s.article_id = a.article_id
                     AND NOT regexp_matches(s.key_insight, '^\\p{Lu}')) AS capital,
         NOT EXISTS (SELECT 1 FROM sentences s WHERE s.article_id = a.article_id
                     AND NOT suffix(s.key_insight, '.')) AS full_stop,
         len(regexp_extract_all(a.summarization, '[^ \\t\\n\\x0B\\f\\r]+')) AS n_words
  FROM articles a LEFT JOIN tag_lists t USING (article_id) LEFT JOIN insight_lists i USING (article_id)
), flags AS (
  SELECT unnest(['tags_3_to_10', 'tags_lower_case', 'tags_without_blanks', 'tags_1_to_3_words',
                 'insights_3_to_10', 'insights_start_capital', 'insights_end_full_stop',
                 'words_100_to_500']) AS rule,
         unnest([n_tags BETWEEN 3 AND 10, true, true, true, n_insights BETWEEN 3 AND 10, capital,
                 full_stop, n_words BETWEEN 100 AND 500]) AS kept
  FROM judged
)
SELECT rule, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_broken
FROM flags GROUP BY rule""",
    "jsonl_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "stream_ingest": _with(ARTICLES, LISTS)
    + """
SELECT a.link_hash, a.link, a.headline, a.date AS published_date, a.summarization,
       coalesce(t.n_tags, 0) AS n_tags, coalesce(i.n_insights, 0) AS n_insights
FROM articles a LEFT JOIN tag_lists t USING (article_id) LEFT JOIN insight_lists i USING (article_id)
WHERE a.article_id % 6 = 0 AND coalesce(i.longest, 0) <= 1000""",
}
