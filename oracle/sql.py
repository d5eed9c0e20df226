"""DuckDB SQL for every registered query that can be said in SQL, by query name."""

from __future__ import annotations

from oracle.feature_sql import TEXT, features_query, lg, ratio, rules_query
from oracle.page_sql import NOTICE, attr, page_query
from siftpage.operators.features import FEATURE_COLUMNS

SQL: dict[str, str] = {}

# ---- URLs -----------------------------------------------------------------------------------

SQL["url_keys"] = page_query(
    """
SELECT page_id, regexp_replace(split_part(regexp_replace(cleaned, 'https?://', ''), '/', 1),
    '[^a-zA-Z0-9]', '_', 'g')[1:40] || '__' || sha256(cleaned)[1:8] AS key, url AS full_url
FROM (SELECT page_id, url, rtrim(trim(url), '/') AS cleaned FROM deco)
""",
    parts=("url",),
)
SQL["url_part_table"] = page_query(
    """
SELECT page_id, scheme, raw_netloc AS netloc, raw_path AS path, raw_query AS query,
  len(parts)::INT AS n_parts, array_to_string(params, ',') AS params FROM upart
""",
    parts=("url",),
)
URL_COLUMNS = ", ".join(FEATURE_COLUMNS[131:148])
SQL["url_feature_table"] = page_query(f"SELECT page_id, {URL_COLUMNS} FROM uf", parts=("url",))
FALLBACK = """
  CASE WHEN url_has_search_param = 1 OR url_has_page_param = 1 THEN 'list'
    WHEN url_has_filter_param = 1 THEN 'list'
    WHEN url_has_numeric_id = 1 AND url_is_root = 0 THEN 'detail'
    WHEN url_has_long_slug = 1 THEN 'detail' ELSE 'others' END AS label,
  (CASE WHEN url_has_search_param = 1 OR url_has_page_param = 1 THEN 0.62
    WHEN url_has_filter_param = 1 THEN 0.60
    WHEN url_has_numeric_id = 1 AND url_is_root = 0 THEN 0.60
    WHEN url_has_long_slug = 1 THEN 0.58 WHEN url_is_root = 1 THEN 0.65 ELSE 0.50 END)::DOUBLE
    AS confidence
"""
SQL["url_fallback_class"] = page_query(f"SELECT page_id, {FALLBACK} FROM uf", parts=("url",))
SQL["url_class_counts"] = page_query(
    f"""
SELECT label, count(*) AS pages, round_even(avg(confidence), 6) AS mean_confidence
FROM (SELECT {FALLBACK} FROM uf) GROUP BY label
""",
    parts=("url",),
)
SQL["listing_url_flag"] = page_query(
    "SELECT page_id, is_listing::INT AS is_listing FROM uf", parts=("url",)
)

# ---- HTML as tables -------------------------------------------------------------------------

SQL["token_counts"] = page_query(
    """
SELECT page_id, count(*) AS tokens, count(*) FILTER (code <> '' AND code[1] <> '/') AS start,
  count(*) FILTER (code[1] = '/') AS "end", count(*) FILTER (raw[1] <> '<') AS text
FROM tok GROUP BY page_id
""",
    parts=("tok",),
)
NODES = """
SELECT n.*, coalesce(k.kids, 0) AS kids,
  row_number() OVER (PARTITION BY n.page_id ORDER BY n.eid) - 1 AS i
FROM node n LEFT JOIN kid k USING (page_id, eid)
"""
SQL["tag_totals"] = page_query(
    f"""
SELECT tag, count(*) AS n, max(depth) AS max_depth, sum(kids)::BIGINT AS children,
  sum(len)::BIGINT AS text_chars
FROM ({NODES}) GROUP BY tag
"""
)
SQL["element_table"] = page_query(
    f"""
SELECT page_id, i AS eid, tag, depth, kids AS child_count, len AS text_len,
  md5(joined) AS text_md5, {attr("class")} AS class
FROM ({NODES})
"""
)
SQL["tag_nesting"] = page_query(
    """
SELECT o.tag AS outer_tag, i.tag AS inner_tag, count(*) AS n, count(DISTINCT i.page_id) AS pages
FROM node i JOIN node o ON o.page_id = i.page_id AND list_contains(i.anc, o.eid)
WHERE o.tag IN ('form', 'nav', 'article', 'table', 'ul') GROUP BY ALL
"""
)
SQL["page_text_table"] = page_query(
    "SELECT page_id, title, length(body) AS chars, md5(body) AS body_md5 FROM body"
)
SQL["blocked_pages"] = page_query(
    r"""
SELECT page_id, (marked OR regexp_matches(said,
  'cf-browser-verification|challenge-form|cf_clearance|ray id|just a moment|ddos-guard|please verify you are a human|access denied|403 forbidden|captcha|enable javascript|checking your browser|security check|bot detection|are you a robot'))::INT AS blocked
FROM notice
""",
    parts=("tree", NOTICE.strip()),
)
LINKS = f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY eid) - 1 AS pos,
  spaced AS text, href,
  NOT regexp_matches(href, '^https?://')
    OR regexp_extract(href, '^https?://([^/?#]*)', 1) = raw_netloc AS is_internal,
  coalesce(rel, '') AS rel
FROM (SELECT n.*, trim({attr("href")}) AS href, {attr("rel")} AS rel, u.raw_netloc
      FROM node n JOIN upart u USING (page_id) WHERE tag = 'a')
WHERE href NOT IN ('', '#') AND NOT starts_with(href, 'javascript:')
"""
IMAGES = f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY eid) - 1 AS pos, src, alt,
  '' AS width, '' AS height, '' AS loading
FROM (SELECT page_id, eid, coalesce(nullif({attr("src")}, ''), {attr("data-src")}, '') AS src,
        coalesce(trim({attr("alt")}), '') AS alt FROM node WHERE tag = 'img')
WHERE src <> ''
"""
HEADINGS = """
SELECT page_id, tag AS level,
  row_number() OVER (PARTITION BY page_id, tag ORDER BY eid) - 1 AS pos, joined AS text
FROM node WHERE tag IN ('h1', 'h2', 'h3', 'h4') AND joined <> ''
"""
SQL["links_table"] = page_query(LINKS, parts=("tree", "url"))
SQL["images_table"] = page_query(IMAGES)
SQL["heading_texts"] = page_query(HEADINGS)
FORMS = f"""
SELECT page_id, form, action, method, CASE WHEN fid IS NOT NULL
    THEN row_number() OVER (PARTITION BY page_id, form ORDER BY fid) - 1 END AS pos,
  type, name, placeholder, required
FROM (
  SELECT f.page_id, dense_rank() OVER (PARTITION BY f.page_id ORDER BY f.eid) - 1 AS form,
    {attr("action", "f.raw")} AS action, lower(coalesce({attr("method", "f.raw")}, 'get')) AS method,
    i.eid AS fid, coalesce({attr("type", "i.raw")}, i.tag) AS type,
    coalesce({attr("name", "i.raw")}, '') AS name,
    coalesce({attr("placeholder", "i.raw")}, '') AS placeholder,
    regexp_matches(i.raw, '\\srequired') AS required
  FROM node f LEFT JOIN node i ON i.page_id = f.page_id AND list_contains(i.anc, f.eid)
    AND i.tag IN ('input', 'select', 'textarea')
  WHERE f.tag = 'form')
"""
SQL["forms_inputs"] = page_query(FORMS)
SQL["form_fields_joined"] = SQL["forms_inputs"]
SQL["breadcrumb_depths_joined"] = features_query("SELECT page_id, breadcrumb_depth FROM feat")


def _meta(key: str, condition: str) -> str:
    return f"""
SELECT page_id, key, arg_max(value, eid) AS value
FROM (SELECT page_id, eid, {key} AS key, coalesce({attr("content")}, '') AS value
      FROM node WHERE tag = 'meta')
WHERE key IS NOT NULL AND {condition} GROUP BY page_id, key
"""


SQL["meta_entries"] = page_query(_meta(f"coalesce({attr('name')}, {attr('property')})", "value <> ''"))
SQL["open_graph_entries"] = page_query(_meta(attr("property"), "starts_with(key, 'og:')"))
SQL["jsonld_types"] = page_query(
    r"""
SELECT page_id, unnest(range(0, len(l))) AS pos, unnest(l) AS type
FROM (SELECT page_id, regexp_extract_all(
  regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script type="application/ld\+json">(.*?)</script>', 1),
  '"@type":"([^"]*)"', 1) AS l FROM deco) WHERE len(l) > 0
""",
    parts=(),
)
SQL["snapshot_counts"] = page_query(
    f"""
SELECT d.page_id, b.title, u.raw_netloc AS domain, u.raw_path AS path, u.raw_query AS query,
  length(d.html) AS html_length,
  (SELECT arg_min({attr("href")}, eid) FROM node n WHERE n.page_id = d.page_id AND tag = 'link'
     AND {attr("rel")} = 'canonical') AS canonical,
  (SELECT count(*) FROM ({LINKS}) x WHERE x.page_id = d.page_id) AS links,
  (SELECT count(*) FROM ({IMAGES}) x WHERE x.page_id = d.page_id) AS images,
  (SELECT count(*) FROM node x WHERE x.page_id = d.page_id AND tag = 'form') AS forms,
  (SELECT len(list_filter(found, lambda x: regexp_matches(x, '(?i)^<script\\b'))) FROM code_free c
     WHERE c.page_id = d.page_id) AS scripts,
  {", ".join(f"(SELECT count(*) FROM ({HEADINGS}) x WHERE x.page_id = d.page_id AND level = '{h}') AS {h}" for h in ("h1", "h2", "h3", "h4"))},
  length(regexp_replace(b.body, '\\s+', ' ', 'g')) AS body_text_chars,
  len(list_filter(regexp_split_to_array(b.body, '\\s+'), lambda x: x <> '')) AS body_text_words,
  contains(d.html, 'rel="next"') AS has_next, contains(d.html, 'rel="prev"') AS has_prev
FROM deco d JOIN body b USING (page_id) JOIN upart u USING (page_id)
""",
    parts=("tree", "url"),
)
COUNTED = SQL["snapshot_counts"].rpartition("\nSELECT d.page_id")[2]
SQL["page_snapshot"] = page_query(
    f"""
SELECT c.*, 'success' AS status, 1 AS rebuilt_from_html, d.url, coalesce(m.v, '') AS meta, coalesce(og.v, '') AS open_graph,
  coalesce(j.raw, '') AS schema_raw, coalesce(j.types, '') AS schema_types,
  {", ".join(f"coalesce({h}.v, '') AS {h}_texts" for h in ("h1", "h2", "h3", "h4"))},
  coalesce(r.v, '') AS rel_links, coalesce(f.v, '') AS form_lines, md5(coalesce(l.v, '')) AS links_md5,
  md5(coalesce(i.v, '')) AS images_md5, md5(regexp_replace(b.body, '\\s+', ' ', 'g')) AS body_md5
FROM (SELECT d.page_id{COUNTED}) c JOIN deco d USING (page_id) JOIN body b USING (page_id)
LEFT JOIN (SELECT page_id, string_agg(key || '=' || value, chr(10) ORDER BY key || '=' || value) AS v
           FROM ({_meta(f"coalesce({attr('name')}, {attr('property')})", "value <> ''")}) GROUP BY page_id) m USING (page_id)
LEFT JOIN (SELECT page_id, string_agg(key || '=' || value, chr(10) ORDER BY key || '=' || value) AS v
           FROM ({_meta(attr("property"), "starts_with(key, 'og:')")}) GROUP BY page_id) og USING (page_id)
LEFT JOIN (SELECT page_id, raw, array_to_string(regexp_extract_all(raw, '"@type":"([^"]*)"', 1), ',') AS types
           FROM (SELECT page_id, regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                   '(?s)<script type="application/ld\\+json">(.*?)</script>', 1) AS raw FROM deco)) j USING (page_id)
{" ".join(f"LEFT JOIN (SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS v FROM ({HEADINGS}) WHERE level = '{h}' GROUP BY page_id) {h} USING (page_id)" for h in ("h1", "h2", "h3", "h4"))}
LEFT JOIN (SELECT page_id, string_agg({attr("rel")} || '|' || {attr("href")}, chr(10) ORDER BY eid) AS v FROM node
           WHERE tag = 'link' AND {attr("rel")} IN ('next', 'prev') GROUP BY page_id) r USING (page_id)
LEFT JOIN (SELECT page_id, string_agg(v, chr(10) ORDER BY form) AS v FROM (
             SELECT page_id, form, any_value(action) || '|' || any_value(method) || '|' || coalesce(string_agg(
               type || ',' || name || ',' || placeholder || ',' || required::INT, ';' ORDER BY pos) FILTER (pos IS NOT NULL), '') AS v
             FROM ({FORMS}) GROUP BY page_id, form) GROUP BY page_id) f USING (page_id)
LEFT JOIN (SELECT page_id, string_agg(text || '|' || href || '|' || is_internal || '|' || rel, chr(10) ORDER BY pos) AS v
           FROM ({LINKS}) GROUP BY page_id) l USING (page_id)
LEFT JOIN (SELECT page_id, string_agg(src || '|' || alt || '|' || width || '|' || height || '|' || loading, chr(10) ORDER BY pos) AS v
           FROM ({IMAGES}) GROUP BY page_id) i USING (page_id)
""",
    parts=("tree", "url"),
)
SQL["snapshot_pickup"] = page_query(
    """
, keyed AS (
  SELECT page_id, html, regexp_replace(split_part(regexp_replace(cleaned, 'https?://', ''), '/', 1),
    '[^a-zA-Z0-9]', '_', 'g')[1:40] || '__' || sha256(cleaned)[1:8] AS key
  FROM (SELECT page_id, html, rtrim(trim(url), '/') AS cleaned FROM deco))
SELECT page_id, key FROM keyed
WHERE key NOT IN (SELECT key FROM keyed WHERE contains(html, 'application/rss+xml'))
""",
    parts=(),
)

# ---- features and rules ---------------------------------------------------------------------


def _columns(names) -> str:
    return ", ".join(names)


SQL["page_features"] = features_query(f"SELECT page_id, {_columns(FEATURE_COLUMNS)} FROM feat")
SQL["plain_page_features"] = features_query(
    f"SELECT page_id, {_columns(FEATURE_COLUMNS)} FROM feat", decorated=False
)
for _name, _names in {
    "structural_features": FEATURE_COLUMNS[1:29],
    "link_features": FEATURE_COLUMNS[29:40],
    "content_features": FEATURE_COLUMNS[40:64],
    "composite_scores": FEATURE_COLUMNS[148:152],
}.items():
    SQL[_name] = features_query(f"SELECT page_id, {_columns(_names)} FROM feat")

LONG = f"""
long AS (
  UNPIVOT (SELECT page_id, {", ".join(f"{n}::DOUBLE AS {n}" for n in FEATURE_COLUMNS)} FROM feat)
  ON COLUMNS(* EXCLUDE (page_id)) INTO NAME feature VALUE value)
"""
SQL["feature_unpivot"] = features_query(
    f""", {LONG}
SELECT feature, count(*) AS pages, count(*) FILTER (value <> 0) AS non_zero,
  round_even(sum(value), 3) AS total FROM long GROUP BY feature
"""
)
PILLAR = r"""
CASE WHEN regexp_matches(feature, '^(tag_|li_|dom_|has_data_table|grid_|article_section)') THEN 'STRUCTURAL' END,
CASE WHEN regexp_matches(feature, 'link|anchor') THEN 'LINK' END,
CASE WHEN regexp_matches(feature, '^(h1_|h2_|h3_|h4_|word_|char_|para|avg_para|rich_|log_word|log_rich|deep_content|has_main|has_article_el|text_conc|single_h1|heading_hier|content_avail)') THEN 'CONTENT' END,
CASE WHEN regexp_matches(feature, '^(image_|log_image|alt_|gallery_|has_image_gallery|has_video|figure_|figcaption_|images_with)') THEN 'MEDIA' END,
CASE WHEN regexp_matches(feature, 'pagination|filter_ui|result_count|repeated|breadcrumb|compare_check') THEN 'LISTING' END,
CASE WHEN regexp_matches(feature, 'price|buy_cta|author|publish_date|rating|toc|internal_anchor|spec_section|share_button|comments|related') THEN 'DETAIL' END,
CASE WHEN regexp_matches(feature, 'form|button|select|range_input|tab|login|search_form') THEN 'INTERACTION' END,
CASE WHEN regexp_matches(feature, 'og_type|twitter|schema|microdata|canonical|robots|lang') THEN 'METADATA' END,
CASE WHEN regexp_matches(feature, 'cue_word|numeric_token|title_') THEN 'SEMANTIC' END,
CASE WHEN starts_with(feature, 'url_') THEN 'URL' END,
CASE WHEN starts_with(feature, 'composite_') THEN 'COMPOSITE' END
"""
SQL["feature_pillars"] = features_query(
    f""", {LONG}
SELECT pillar, count(DISTINCT feature) AS features, count(*) FILTER (value <> 0) AS non_zero
FROM (SELECT feature, value, unnest([{PILLAR}]) AS pillar FROM long)
WHERE pillar IS NOT NULL GROUP BY pillar
"""
)
SQL["feature_compare"] = features_query(
    f""", {LONG}
SELECT coalesce(x.feature, y.feature) AS feature, count(*) AS pairs,
  round_even(sum(coalesce(y.value, 0) - coalesce(x.value, 0)), 3) + 0.0::DOUBLE AS diff
FROM long x FULL JOIN long y ON y.page_id = x.page_id + 1 AND x.feature = y.feature
WHERE coalesce(x.value, 0) <> coalesce(y.value, 0)
  AND (x.page_id IS NOT NULL OR y.page_id - 1 IN (SELECT page_id FROM deco)) GROUP BY 1
"""
)
SQL["rule_verdicts"] = rules_query(
    "SELECT page_id, label, confidence, method, reason FROM verdicts"
)
SQL["page_predictions"] = rules_query(
    """
, b AS (
  SELECT v.page_id, v.label AS pl, v.confidence AS pc, v.method AS pm, v.reason AS pr, v.label IS NOT NULL AS fired,
    CASE WHEN total_links > 15 THEN 'list' WHEN word_count >= 100 THEN 'detail' ELSE 'others' END AS ml,
    [0.49, 0.59, 0.60, 0.69, 0.70, 0.99][word_count % 6 + 1]::DOUBLE AS mc, content_available = 1 AS full_page,
    v.page_id % 31 = 5 AS blank
  FROM verdicts v JOIN feat USING (page_id)),
s AS (
  SELECT *, CASE WHEN pc >= 0.9 THEN 0.7 ELSE 0.6 END AS bar FROM b),
t AS (
  SELECT *, CASE WHEN NOT fired THEN 'ml_only' WHEN pc >= 0.95 THEN 'absolute_rule' WHEN pl = ml THEN 'agreement'
    WHEN mc >= bar THEN 'ml_wins' ELSE 'pre_wins' END AS tb,
    round_even(mc * 100, 0)::INT AS mp, round_even(pc * 100, 0)::INT AS pp, round_even(bar * 100, 0)::INT AS bp FROM s)
SELECT page_id,
  CASE WHEN blank THEN 'others' WHEN tb IN ('ml_only', 'ml_wins') THEN ml ELSE pl END AS predicted_label,
  CASE WHEN blank THEN 0 WHEN tb IN ('ml_only', 'ml_wins') THEN mc ELSE pc END::DOUBLE AS confidence,
  CASE WHEN blank THEN 'scrape_failed' WHEN tb = 'ml_only' THEN 'ml_model'
    WHEN tb = 'ml_wins' THEN CASE WHEN pc >= 0.9 THEN 'ml_override_pre' ELSE 'ml_override_soft_rule' END
    ELSE pm END AS method,
  CASE WHEN blank THEN 'scraping_failed: unknown' WHEN tb = 'ml_only' THEN ''
    WHEN tb = 'ml_wins' THEN format('ML({}@{}%) overrode pre({}@{}% via {})', ml, mp, pl, pp, pm)
    WHEN tb = 'pre_wins' THEN format('pre({}@{}%) held; ML({}@{}%) below threshold({}%)', pl, pp, ml, mp, bp)
    ELSE pr END AS reason,
  CASE WHEN NOT blank THEN tb = 'absolute_rule' OR full_page END AS content_available,
  CASE WHEN NOT blank THEN pl END AS pre_label, CASE WHEN NOT blank THEN pc END AS pre_confidence,
  CASE WHEN NOT blank AND tb <> 'absolute_rule' THEN ml END AS ml_label,
  CASE WHEN NOT blank AND tb <> 'absolute_rule' THEN mc END AS ml_confidence,
  CASE WHEN NOT blank THEN tb END AS tiebreaker
FROM t
"""
)
SQL["rule_distribution_table"] = rules_query(
    """
SELECT coalesce(method, 'no_rule') AS method, coalesce(label, '-') AS label, count(*) AS pages
FROM verdicts GROUP BY ALL
"""
)
SQL["rule_verdicts_jsonld"] = rules_query(
    """
SELECT page_id,
  CASE WHEN page_id % 13 = 1 AND coalesce(method, '') <> 'error_page' THEN 'detail' ELSE label END
    AS label,
  CASE WHEN page_id % 13 = 1 AND coalesce(method, '') <> 'error_page' THEN 'schema_org'
    ELSE method END AS method
FROM verdicts
"""
)
TEXT_ONLY = [
    "word_count", "char_count", "unique_word_ratio", "sentence_count", "boilerplate_ratio",
    "content_available", "has_result_count", "has_buy_cta", "has_author", "has_rating",
    "has_share_buttons", "has_comments_section", "has_related_section", "has_engagement_metrics",
    "list_cue_word_hits", "detail_cue_word_hits", "numeric_token_density", "title_word_count",
    "title_has_list_cue", "title_has_detail_cue", "title_has_question",
    "title_has_count_in_parens", "event_listing_signals", "single_event_signals",
    "cta_signal_count", "legal_signal_count", "info_signal_count", "faq_signal_count",
    "has_pricing_section", "has_testimonials", "purchase_funnel_signal",
    "job_posting_signal_combined", "title_signals_listing", "title_signals_detail",
    "others_content_signal", "browse_vocab_signal", "publication_list_signal", "job_listing_vocab",
]
SQL["document_text_features"] = f"""
WITH body AS (
  SELECT doc_id AS page_id, '' AS url, text AS body, '' AS title, lower(text) AS t FROM documents),
{TEXT.strip()}
SELECT page_id AS doc_id, {", ".join(TEXT_ONLY)}, {lg("word_count")} AS log_word_count,
  round_even(word_count / sentence_count::DOUBLE, 4) AS avg_sentence_length,
  round_even(word_count / 200.0::DOUBLE, 4) AS reading_time_estimate,
  {ratio("list_cue_word_hits", "detail_cue_word_hits + 1")} AS list_vs_detail_cue_ratio,
  {ratio("detail_cue_word_hits", "list_cue_word_hits + 1")} AS detail_vs_list_cue_ratio,
  x_prices::INT AS price_mention_count, (x_prices > 0)::INT AS has_price,
  x_years::INT AS year_mention_count, (x_years >= 5)::INT AS has_many_years,
  (job_listing_vocab >= 2)::INT AS is_job_listing_page
FROM tf
"""

# ---- ledger and reports ---------------------------------------------------------------------

UPDATES = """
u0 AS (
  SELECT event_id, ts, user_id, value, 'https://u' || user_id || '.example.com/p/' AS url,
    ['list', 'detail', 'others', NULL][(user_id % 7) % 4 + 1] AS label,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'success' WHEN event_type = 'error' THEN 'failed'
      WHEN event_type = 'click' THEN 'skipped' ELSE 'pending' END AS scrape_status
  FROM events),
upd AS (
  SELECT event_id, ts, url, 'u' || user_id || '_example_com__'
      || sha256('https://u' || user_id || '.example.com/p')[1:8] AS key, label, scrape_status,
    CASE WHEN scrape_status <> 'success' THEN 'pending' WHEN value < 2 THEN 'failed'
      WHEN value < 6 THEN 'pending' ELSE 'success' END AS extract_status,
    CASE WHEN scrape_status = 'failed' THEN 'timeout' END AS scrape_reason,
    CASE WHEN scrape_status = 'success' AND value < 2 THEN 'bad_html' END AS extract_reason,
    CASE WHEN scrape_status = 'success' THEN ts END AS scrape_completed_at,
    CASE WHEN scrape_status = 'success' AND value >= 6 THEN ts END AS extract_completed_at,
    NULL::TIMESTAMP AS label_fixed_at,
    CASE WHEN scrape_status = 'success' AND value >= 6 THEN 211 END AS feature_count,
    CASE WHEN scrape_status = 'success' AND value >= 6 THEN ['raw.html', 'page.json', 'features.json']
      WHEN scrape_status = 'success' THEN ['raw.html'] END AS files, ts AS last_updated
  FROM u0),
led AS (SELECT * FROM upd QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id DESC) = 1),
early AS (SELECT * FROM upd WHERE hour(ts) < 12
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id DESC) = 1),
late AS (SELECT * FROM upd WHERE hour(ts) >= 12
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id DESC) = 1),
corr0 AS (SELECT event_id AS row, url, [' List', 'detail', 'OTHERS', 'blog'][minute(ts) % 4 + 1] AS label
  FROM upd),
corr AS (SELECT * FROM corr0 UNION ALL SELECT row, url || 'new', label FROM corr0),
fix AS (SELECT trim(url) AS url, lower(trim(label)) AS new_label FROM corr
  WHERE lower(trim(label)) IN ('list', 'detail', 'others')
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY row DESC) = 1)
"""
FIELDS = (
    "key", "label", "scrape_status", "extract_status", "scrape_reason", "extract_reason",
    "scrape_completed_at", "extract_completed_at", "label_fixed_at", "feature_count", "last_updated",
)


def ledger(select: str) -> str:
    return f"WITH {UPDATES.strip()}\n{select.strip()}"


SQL["ledger_upsert"] = ledger(
    f"""
SELECT coalesce(n.url, o.url) AS url, {", ".join(f"coalesce(n.{f}, o.{f}) AS {f}" for f in FIELDS)},
  coalesce(len(coalesce(n.files, o.files)), -1) AS n_files
FROM early o FULL JOIN late n ON o.url = n.url
"""
)
SQL["ledger_bucketed_upsert"] = SQL["ledger_upsert"]
SQL["ledger_fold"] = ledger(
    f"""
SELECT url, {", ".join(f"arg_max({f}, event_id) FILTER ({f} IS NOT NULL) AS {f}" for f in FIELDS)},
  coalesce(len(arg_max(files, event_id) FILTER (files IS NOT NULL)), -1) AS n_files
FROM upd GROUP BY url
"""
)
SQL["ledger_new"] = ledger(
    """
SELECT DISTINCT url FROM upd WHERE url NOT IN
  (SELECT url FROM early WHERE scrape_status IN ('success', 'failed', 'skipped'))
"""
)
SQL["ledger_bloom_pickup"] = SQL["ledger_new"]
AT = "TIMESTAMP '2024-01-01 00:00:00'"
SQL["ledger_register"] = ledger(
    f"""
SELECT url, key, label, 'pending' AS scrape_status, 'pending' AS extract_status,
  {AT} AS created_at, {AT} AS last_updated
FROM upd WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id DESC) = 1
"""
)
SQL["ledger_fetch_outcome"] = ledger(
    f"""
SELECT url, scrape_status, coalesce(scrape_reason, '') AS scrape_reason, {AT} AS scrape_completed_at,
  CASE WHEN scrape_status <> 'success' THEN '' WHEN feature_count IS NOT NULL THEN 'raw.html,page.json'
    ELSE 'raw.html' END AS files, {AT} AS last_updated
FROM led
"""
)
SQL["ledger_extract_outcome"] = ledger(
    f"""
SELECT url, CASE WHEN extract_reason IS NULL THEN 'success' ELSE 'failed' END AS extract_status,
  extract_reason, {AT} AS extract_completed_at,
  CASE WHEN extract_reason IS NULL THEN feature_count END AS feature_count, {AT} AS last_updated
FROM led
"""
)
SQL["extract_pickup"] = ledger(
    """
SELECT url, CASE WHEN EXISTS (SELECT 1 FROM pages p
    WHERE 'https://u' || p.page_id || '.example.com/p/' = l.url) THEN 'todo' ELSE 'missing_html' END
  AS action
FROM led l WHERE scrape_status = 'success' AND extract_status <> 'success' AND label IS NOT NULL
"""
)
SQL["ledger_relabel"] = ledger(
    """
SELECT l.url, key, CASE WHEN hit THEN new_label ELSE label END AS label, scrape_status,
  CASE WHEN hit THEN 'pending' ELSE extract_status END AS extract_status, scrape_reason,
  CASE WHEN NOT hit THEN extract_reason END AS extract_reason, scrape_completed_at,
  CASE WHEN NOT hit THEN extract_completed_at END AS extract_completed_at,
  CASE WHEN hit THEN TIMESTAMP '2024-06-01 00:00:00' END AS label_fixed_at,
  CASE WHEN NOT hit THEN feature_count END AS feature_count,
  coalesce(CASE WHEN hit AND len(files) = 3 THEN 2 ELSE len(files) END, -1) AS n_files, last_updated
FROM (SELECT l.*, f.new_label,
        f.new_label IS NOT NULL AND coalesce(l.label, '') <> f.new_label AS hit
      FROM led l LEFT JOIN fix f USING (url)) l
"""
)
SQL["relabel_counts"] = ledger(
    """
SELECT count(*) FILTER (moved) AS moved, count(*) FILTER (known AND NOT moved) AS unchanged,
  count(*) FILTER (NOT known) AS unknown
FROM (SELECT l.url IS NOT NULL AS known,
        l.url IS NOT NULL AND coalesce(l.label, '') <> f.new_label AND coalesce(len(l.files), 0) > 0
          AS moved
      FROM fix f LEFT JOIN led l USING (url))
"""
)
SQL["ledger_reset_failed"] = ledger(
    """
SELECT url, key, label, CASE WHEN f THEN 'pending' ELSE scrape_status END AS scrape_status,
  CASE WHEN f OR extract_status = 'failed' THEN 'pending' ELSE extract_status END AS extract_status,
  CASE WHEN NOT f THEN scrape_reason END AS scrape_reason,
  CASE WHEN f OR extract_status <> 'failed' THEN extract_reason END AS extract_reason,
  scrape_completed_at, extract_completed_at, label_fixed_at, feature_count,
  coalesce(len(files), -1) AS n_files, last_updated
FROM (SELECT *, scrape_status IN ('failed', 'skipped') AS f FROM led)
"""
)
SQL["ledger_reset_extract"] = ledger(
    """
SELECT url, key, label, scrape_status, CASE WHEN s THEN 'pending' ELSE extract_status END
    AS extract_status, scrape_reason, CASE WHEN NOT s THEN extract_reason END AS extract_reason,
  scrape_completed_at, CASE WHEN NOT s THEN extract_completed_at END AS extract_completed_at,
  label_fixed_at, CASE WHEN NOT s THEN feature_count END AS feature_count,
  coalesce(CASE WHEN s AND len(files) = 3 THEN 2 ELSE len(files) END, -1) AS n_files, last_updated
FROM (SELECT *, scrape_status = 'success' AS s FROM led)
"""
)
SQL["status_rollup"] = ledger(
    f"""
SELECT coalesce(lab, 'TOTAL') AS label, count(*) AS total,
  {", ".join(f"count(*) FILTER (scrape_status = '{s}') AS scrape_{s}" for s in ("success", "failed", "pending", "skipped"))},
  {", ".join(f"count(*) FILTER (extract_status = '{s}') AS extract_{s}" for s in ("success", "failed", "pending"))},
  count(*) FILTER (scrape_status = 'success' AND extract_status = 'success') AS ready
FROM (SELECT *, coalesce(label, 'unknown') AS lab FROM led) GROUP BY ROLLUP (lab)
"""
)
SQL["ready_count"] = ledger(
    "SELECT count(*) AS ready FROM led WHERE scrape_status = 'success' AND extract_status = 'success'"
)
SQL["file_completeness"] = ledger(
    """
SELECT label, count(*) AS folders, count(*) FILTER (list_contains(files, 'raw.html')) AS html,
  count(*) FILTER (list_contains(files, 'page.json')) AS page,
  count(*) FILTER (list_contains(files, 'features.json')) AS features,
  count(*) FILTER (len(files) = 3) AS complete
FROM led GROUP BY label
"""
)
SQL["recent_top10"] = ledger(
    """
SELECT (url || '?e=' || event_id) AS url, coalesce(label, '?') AS predicted_label,
  event_id % 100 / 100.0::DOUBLE AS confidence, event_id % 5 = 0 AS fallback_used,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS predicted_at
FROM upd ORDER BY ts DESC, url || '?e=' || event_id LIMIT 10
"""
)
SQL["ledger_warnings"] = ledger(
    """
, per AS (SELECT label, count(*) AS n FROM led
  WHERE scrape_status = 'success' AND extract_status = 'success' GROUP BY label)
SELECT 'extract_pending' AS issue, NULL AS label, count(*) AS n FROM led
  WHERE scrape_status = 'success' AND extract_status = 'pending' HAVING count(*) > 0
UNION ALL SELECT 'class_imbalance', NULL, max(n) FROM per HAVING max(n) > 5 * min(n)
UNION ALL SELECT 'few_samples', label, n FROM per WHERE n < 10
"""
)
SQL["failed_list"] = ledger(
    """
SELECT url, scrape_status, extract_status, scrape_reason, extract_reason FROM led
WHERE scrape_status = 'failed' OR extract_status = 'failed'
"""
)
SQL["url_list"] = ledger(
    """
SELECT url, label, scrape_status, extract_status, key FROM led
WHERE label = 'list' AND scrape_status = 'success'
"""
)
SQL["url_table_check"] = ledger(
    """
, c AS (SELECT lower(label) AS label, count(*) AS n FROM corr GROUP BY 1)
SELECT 'class:' || label AS "check", label IN ('list', 'detail', 'others') AND n >= 30 AS ok,
  n::VARCHAR AS detail FROM c
UNION ALL SELECT 'rows', sum(n) >= 3, sum(n)::BIGINT::VARCHAR FROM c
UNION ALL SELECT 'labels', sum(n) IS NULL, coalesce(sum(n), 0)::BIGINT::VARCHAR FROM c
  WHERE label NOT IN ('list', 'detail', 'others')
"""
)
SQL["intake_rows"] = ledger(
    """
SELECT CASE WHEN lower(trim(label)) IN ('list', 'detail', 'others') THEN lower(trim(label))
  ELSE 'invalid_label' END AS label, count(*) AS n FROM corr GROUP BY 1
"""
)
SQL["url_of_key"] = ledger(
    """
SELECT k.key, coalesce(e.url, l.url || '#late') AS url,
  (count(*) OVER (PARTITION BY k.key) > 1)::INT AS ambiguous
FROM (SELECT DISTINCT key FROM upd) k
LEFT JOIN (SELECT key, url FROM early WHERE scrape_status = 'success') e USING (key)
LEFT JOIN late l USING (key)
"""
)
SQL["prediction_cache"] = ledger(
    """
SELECT DISTINCT key, url FROM upd WHERE key NOT IN
  (SELECT key FROM early WHERE scrape_status IN ('success', 'failed'))
"""
)

# ---- decision and evaluation ----------------------------------------------------------------

GRID = """
g0 AS (
  SELECT doc_id, n_chars, doc_id % 4 <> 0 AS fired,
    ['detail', 'list', 'others'][(doc_id // 6) % 3 + 1] AS pl,
    [0.85, 0.88, 0.90, 0.93, 0.96, 0.97][doc_id % 6 + 1]::DOUBLE AS pc, 'rule_' || doc_id % 6 AS pm,
    ['detail', 'list', 'others'][(doc_id // 18) % 3 + 1] AS ml,
    [0.49, 0.59, 0.60, 0.69, 0.70, 0.99][(doc_id // 54) % 6 + 1]::DOUBLE AS mc,
    ['detail', 'list', 'others'][n_chars % 3 + 1] AS actual, doc_id % 37 = 0 AS unread
  FROM documents),
step AS (
  SELECT *, CASE WHEN NOT fired THEN 'ml_only' WHEN pc >= 0.95 THEN 'absolute_rule'
      WHEN pl = ml THEN 'agreement'
      WHEN pc >= 0.9 AND mc >= 0.7 OR pc < 0.9 AND mc >= 0.6 THEN 'ml_wins'
      ELSE 'pre_wins' END AS tb,
    CASE WHEN pc >= 0.9 THEN 70 ELSE 60 END AS bar,
    round(mc * 100)::INT AS mp, round(pc * 100)::INT AS pp
  FROM g0),
three AS (
  SELECT 'https://docs.example.com/' || doc_id AS url, actual, ml, mc,
    CASE WHEN fired AND NOT unread THEN pl ELSE ml END AS pre,
    CASE WHEN fired AND NOT unread THEN pc ELSE mc END AS prec,
    CASE WHEN unread THEN 'html_error: no such file' WHEN fired THEN pm ELSE 'no_rule' END AS pm,
    CASE WHEN fired AND NOT unread THEN pm ELSE 'ml_model' END AS fm, fired AND NOT unread AS f
  FROM g0),
modes AS (
  SELECT 'ml' AS mode, actual, ml AS predicted FROM three
  UNION ALL SELECT 'pre', actual, pre FROM three WHERE f
  UNION ALL SELECT 'full', actual, pre FROM three),
pairs AS (
  SELECT 'all' AS mode,
    CASE WHEN toxic = 1 THEN 'others' WHEN quality = 1 THEN 'detail' ELSE 'list' END AS actual,
    CASE WHEN n_chars > 1500 THEN 'detail' WHEN n_chars > 300 THEN 'list' ELSE 'others' END
      AS predicted
  FROM labels JOIN documents USING (doc_id))
"""


def grid(select: str) -> str:
    return f"WITH {GRID.strip()}\n{select.strip()}"


def report(source: str) -> str:
    return f"""
, cls AS (SELECT unnest(['detail', 'list', 'others']) AS class),
base AS (
  SELECT m.mode, c.class, count(*) FILTER (actual = class) AS support,
    count(*) FILTER (predicted = class) AS predicted,
    count(*) FILTER (actual = class AND predicted = class) AS correct
  FROM {source} m, cls c GROUP BY ALL),
pr AS (
  SELECT *, CASE WHEN predicted > 0 THEN correct / predicted::DOUBLE ELSE 0 END AS p,
    CASE WHEN support > 0 THEN correct / support::DOUBLE ELSE 0 END AS r FROM base),
rep AS (
  SELECT mode, class, support, predicted, correct, p AS precision, r AS recall,
    CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)
"""


SUMMARY = ", ".join(
    f"round_even(avg({m}), 9) AS macro_{m}, "
    f"round_even(sum({m} * support) / sum(support), 9) AS weighted_{m}"
    for m in ("precision", "recall", "f1")
)
TOTALS = (
    "sum(support)::BIGINT AS n, sum(correct)::BIGINT AS correct, "
    "round_even(sum(correct) / sum(support)::DOUBLE, 9) AS accuracy"
)
SQL["tiebreak_decision"] = grid(
    """
SELECT doc_id, CASE WHEN tb IN ('ml_only', 'ml_wins') THEN ml ELSE pl END AS predicted_label,
  CASE WHEN tb IN ('ml_only', 'ml_wins') THEN mc ELSE pc END AS confidence,
  CASE WHEN tb = 'ml_only' THEN CASE WHEN mc < 0.5 THEN 'ml_model_url_fallback' ELSE 'ml_model' END
    WHEN tb = 'ml_wins' THEN CASE WHEN pc >= 0.9 THEN 'ml_override_pre'
      ELSE 'ml_override_soft_rule' END ELSE pm END AS method,
  CASE tb WHEN 'ml_only' THEN ''
    WHEN 'ml_wins' THEN format('ML({}@{}%) overrode pre({}@{}% via {})', ml, mp, pl, pp, pm)
    WHEN 'pre_wins' THEN format('pre({}@{}%) held; ML({}@{}%) below threshold({}%)', pl, pp, ml, mp, bar)
    ELSE 'because' END AS reason,
  tb IN ('ml_only', 'ml_wins') AND mc < 0.5 AS fallback_used,
  tb = 'absolute_rule' OR n_chars >= 200 AS content_available,
  CASE WHEN fired THEN pl END AS pre_label, CASE WHEN fired THEN pc END AS pre_confidence,
  CASE WHEN tb <> 'absolute_rule' THEN ml END AS ml_label,
  CASE WHEN tb <> 'absolute_rule' THEN mc END AS ml_confidence, tb AS tiebreaker,
  fired AND doc_id % 6 = 5 AS is_error_page, CASE WHEN tb = 'absolute_rule' THEN 0 ELSE 1 END
    AS n_probabilities
FROM step
"""
)
BATCH = """
SELECT doc_id, CASE WHEN fired THEN pl ELSE ml END AS predicted_label,
  CASE WHEN fired THEN pc ELSE mc END AS confidence,
  CASE WHEN fired THEN pm WHEN mc < 0.5 THEN 'ml_model_url_fallback' ELSE 'ml_model' END AS method,
  CASE WHEN fired THEN 'because' ELSE '' END AS reason, NOT fired AND mc < 0.5 AS fallback_used,
  fired OR n_chars >= 200 AS content_available, CASE WHEN fired THEN pl END AS pre_label,
  CASE WHEN fired THEN pc END AS pre_confidence, CASE WHEN NOT fired THEN ml END AS ml_label,
  CASE WHEN NOT fired THEN mc END AS ml_confidence,
  CASE WHEN fired THEN 'rule' ELSE 'ml_only' END AS tiebreaker,
  fired AND doc_id % 6 = 5 AS is_error_page, CASE WHEN fired THEN 0 ELSE 1 END AS n_probabilities
FROM step
"""
SQL["batch_decision"] = grid(BATCH)
SQL["decision_summary"] = grid(
    f"""
, b AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'scrape_failed' WHEN doc_id % 29 = 0 THEN 'failed'
  ELSE 'success' END AS status FROM ({BATCH}))
SELECT 'total' AS section, 'urls' AS name, count(*) AS n FROM b
UNION ALL SELECT 'status', status, count(*) FROM b GROUP BY status
UNION ALL SELECT 'label', predicted_label, count(*) FROM b WHERE status = 'success' GROUP BY 2
UNION ALL SELECT 'method', method, count(*) FROM b WHERE status = 'success' GROUP BY 2
"""
)
SQL["batch_results"] = grid(
    f"""
SELECT 'https://docs.example.com/' || doc_id AS url,
  CASE WHEN doc_id % 11 = 0 THEN 'scrape_failed' ELSE predicted_label END AS predicted_label,
  confidence, method, fallback_used,
  CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'success' END AS scrape_status,
  CASE WHEN doc_id % 11 = 0 THEN 'scrape_failed' ELSE 'success' END AS status
FROM ({BATCH})
"""
)
SQL["evaluation_export"] = grid(
    """
SELECT url, actual AS true_label, ml AS ml_label, mc AS ml_conf, pre AS pre_label, prec AS pre_conf,
  pm AS pre_method, pre AS full_label, prec AS full_conf, fm AS full_method,
  (ml = actual)::INT AS ml_correct, (pre = actual)::INT AS full_correct, f::INT AS pre_fired,
  CASE WHEN f THEN (pre = actual)::INT END AS pre_correct
FROM three
"""
)
SQL["mode_comparison"] = grid(
    f"{report('modes')} SELECT mode, {TOTALS}, {SUMMARY} FROM rep GROUP BY mode"
)
SQL["class_by_mode"] = grid(
    f"""
{report('modes')}
SELECT class, {", ".join(f"round_even(coalesce(max(f1) FILTER (mode = '{m}'), 0), 9) AS {m}_f1" for m in ("ml", "pre", "full"))},
  max(support) FILTER (mode = 'ml') AS support
FROM rep GROUP BY class
"""
)
SQL["rule_breakdown"] = grid(
    """
SELECT coalesce(pm, 'TOTAL') AS method, count(*) AS fired, count(*) FILTER (pre = actual) AS correct,
  round_even(count(*) FILTER (pre = actual) / count(*)::DOUBLE, 9) AS accuracy
FROM three WHERE pm <> 'no_rule' GROUP BY ROLLUP (pm)
"""
)
SQL["rule_errors"] = grid(
    """
SELECT url, actual AS true_label, pre AS pre_label, pm AS pre_method, prec AS pre_conf
FROM three WHERE pm <> 'no_rule' AND pre <> actual
"""
)
SQL["disagreements"] = grid(
    """
SELECT url, actual AS true_label, pre AS pre_label, ml AS ml_label, pre AS full_label,
  pm AS pre_method, pre = actual AS pre_ok, ml = actual AS ml_ok, pre = actual AS full_ok
FROM three WHERE pm <> 'no_rule' AND pre <> ml
"""
)
SQL["misclassified"] = grid(
    """
SELECT url, actual AS true_label, pre AS predicted, prec AS confidence, fm AS method
FROM three WHERE pre <> actual
"""
)
SQL["gain_summary"] = grid(
    """
SELECT count(*) AS n, round_even(avg((ml = actual)::INT), 9) AS ml_accuracy,
  round_even(avg((pre = actual)::INT), 9) AS full_accuracy,
  round_even(avg((pre = actual)::INT) - avg((ml = actual)::INT), 9) AS gain,
  count(*) FILTER (f) AS fired, count(*) FILTER (NOT f) AS for_model
FROM three
"""
)
SQL["confusion_matrix"] = grid(
    """
SELECT actual, count(*) FILTER (predicted = 'detail') AS detail,
  count(*) FILTER (predicted = 'list') AS list, count(*) FILTER (predicted = 'others') AS others
FROM pairs GROUP BY actual
"""
)
SQL["class_report"] = grid(
    f"""
{report('pairs')}
SELECT class, support, predicted, correct, round_even(precision, 9) AS precision,
  round_even(recall, 9) AS recall, round_even(f1, 9) AS f1 FROM rep
"""
)
SQL["report_summary"] = grid(f"{report('pairs')} SELECT {TOTALS}, {SUMMARY} FROM rep")

# ---- model ----------------------------------------------------------------------------------

SAMPLES = """
WITH s AS (
  SELECT doc_id, 'd' || doc_id AS key,
    CASE WHEN toxic = 1 THEN 'others' WHEN quality = 1 THEN 'detail' ELSE 'list' END AS label
  FROM labels)
"""
SQL["stratified_split"] = f"""
{SAMPLES}
SELECT doc_id, key, label, r <= cut AS is_test,
  CASE WHEN r > cut THEN ((r - 1) % 5)::INT END AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(key || ':42'), key) AS r,
        round_even(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE, 0) AS cut FROM s)
"""
SQL["class_minimum"] = f"""
{SAMPLES} SELECT label, count(*) AS n FROM s GROUP BY label HAVING count(*) < 150
"""
SQL["training_rows"] = ledger(
    """
, st AS (SELECT 'https://u' || page_id || '.example.com/p/' AS url FROM pages)
SELECT label, count(*) AS n FROM led JOIN st USING (url)
  WHERE scrape_status = 'success' AND extract_status = 'success' AND label IS NOT NULL GROUP BY label
UNION ALL
SELECT 'stale', count(*) FROM led JOIN st USING (url)
  WHERE NOT (scrape_status = 'success' AND extract_status = 'success') AND label IS NOT NULL
"""
)
SQL["evaluation_samples"] = ledger(
    """
, st AS (SELECT page_id, 'https://u' || page_id || '.example.com/p/' AS url FROM pages),
s AS (
  SELECT led.url, key, label AS true_label, page_id FROM led JOIN st USING (url)
  WHERE scrape_status = 'success' AND extract_status = 'success' AND label IS NOT NULL)
SELECT url, key, true_label, page_id
FROM (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY md5(key || ':42'), key) AS r,
        round_even(count(*) OVER (PARTITION BY true_label) * 0.2::DOUBLE, 0) AS cut FROM s)
WHERE r <= cut
"""
)
SQL["stream_classify"] = rules_query("SELECT page_id, label, method FROM verdicts", decorated=False)

SQL["stream_ledger"] = rules_query(
    """
SELECT url, regexp_replace(split_part(regexp_replace(rtrim(trim(url), '/'), 'https?://', ''), '/', 1),
    '[^a-zA-Z0-9]', '_', 'g')[1:40] || '__' || sha256(rtrim(trim(url), '/'))[1:8] AS key,
  coalesce(label, 'others') AS label, 'success' AS scrape_status,
  CASE WHEN label IS NULL THEN 'pending' ELSE 'success' END AS extract_status
FROM verdicts
""",
    decorated=False,
)
SQL["page_store_pickup"] = """
SELECT url, regexp_replace(split_part(regexp_replace(rtrim(trim(url), '/'), 'https?://', ''), '/', 1),
    '[^a-zA-Z0-9]', '_', 'g')[1:40] || '__' || sha256(rtrim(trim(url), '/'))[1:8] AS key,
  ['list', 'detail', 'others'][page_id % 3 + 1] AS label, md5(html) AS html_md5
FROM pages WHERE page_id % 5 = 1
"""
SQL["stored_run_ledger"] = page_query(
    """
SELECT url || '#' || page_id AS url,
  CASE WHEN page_id % 3 = 0 THEN 'list' WHEN page_id % 4 = 3 THEN 'detail' ELSE 'others' END AS label,
  CASE WHEN page_id % 17 = 3 THEN 'failed' ELSE 'success' END AS scrape_status,
  CASE WHEN page_id % 17 = 3 THEN 'pending' WHEN page_id % 19 = 4 THEN 'failed' ELSE 'success' END AS extract_status,
  CASE WHEN page_id % 17 = 3 THEN 'timeout' ELSE '' END AS scrape_reason,
  CASE WHEN page_id % 17 <> 3 AND page_id % 19 = 4 THEN 'no_content' END AS extract_reason,
  CASE WHEN page_id % 17 <> 3 AND page_id % 19 <> 4 THEN 211 END AS feature_count,
  CASE WHEN page_id % 17 = 3 THEN 0 ELSE 1 END AS n_files
FROM deco
""",
    parts=(),
)
