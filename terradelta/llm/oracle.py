"""SQL for the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

_URLS = rf"""
WITH parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
         string_split(host, '.') AS labels FROM parts),
sited AS (
  SELECT *, (SELECT min(i) FROM range(1, len(labels) + 1) t(i)
             WHERE labels[i] IN ('ads-track', 'free-bets', 'cheap-pills', 'spam-farm', 'casino-win', 'adult-x')) AS first FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN first IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN first IS NOT NULL THEN array_to_string(labels[first:], '.') END AS site
FROM sited"""

_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_TERMS.format("text")}, []) AS words FROM documents),
b AS (SELECT item_id, {_TERMS.format("text")} AS words FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS phrase
      FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
            FROM (SELECT *, least(13, len(words)) AS n FROM b) WHERE n > 0)),
p AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w))),
hits AS (SELECT doc_id, i, n, item_id FROM p JOIN w USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

_REPEATS = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS words FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i, md5(array_to_string(words[i + 1:i + 50], ' ')) AS phrase
      FROM (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS i FROM d)),
again AS (SELECT phrase FROM p GROUP BY phrase HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM p JOIN again USING (phrase)),
marked AS (SELECT *, CASE WHEN i <= 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked)
SELECT doc_id, min(i) AS first_word, max(i) + 50 AS end_word FROM runs GROUP BY doc_id, run"""

_AUDIT = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN min(w.doc_id) OVER (PARTITION BY body) < w.doc_id THEN 'E' ELSE '' END AS failed
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM f a, f b, f c, f e, f g
           WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before
          FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, x,
         count(*) FILTER (NOT contains(failed, x) AND translate(failed, before, '') = failed) AS kept,
         count(*) FILTER (contains(failed, x) AND translate(failed, before, '') = failed) AS removed,
         count(*) FILTER (contains(failed, x) AND translate(failed, before, '') <> failed) AS redundant,
         count(*) FILTER (failed = x) AS unique_fails,
         sum(good) FILTER (contains(failed, x) AND translate(failed, before, '') = failed) AS good_lost,
         sum(bad) FILTER (contains(failed, x) AND translate(failed, before, '') = failed) AS toxic_lost
  FROM d, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted"""

_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format("text")} AS words FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) FILTER (len(words) > 0) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
           FROM tf, stats GROUP BY term, docs),
scored AS (SELECT item_id, row, doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
           FROM tf JOIN weight USING (term) JOIN q USING (term), stats GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

ORACLE: dict[str, str] = {
    "op1_url_filter": _URLS,
    "op7_suffix_dedup": _REPEATS,
    "op10_decontaminate": _CONTAMINATION,
    "op11_filter_audit": _AUDIT,
    "op12_ranked_search": _SEARCH,
    "op13_exact_dedup": _EXACT,
}
