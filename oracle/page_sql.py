"""DuckDB side of the page queries: tokens, tree, text and URL parts as common table expressions.

Written for one purpose: to reach the same tables by another way. The tree is walked by a recursive
query that keeps the stack of open elements as a list; texts are gathered through that list.
"""

from __future__ import annotations

from siftpage.sources.decorated import BODY, FOOTER, HEAD, TITLES, URLS

VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCK = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul"
)


def names(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


def _extra(rules) -> str:
    return " || ".join(
        f"CASE WHEN page_id % {d} = {r} THEN '{m}' ELSE '' END" for d, r, m in rules
    )


def _chosen(rules, otherwise: str, wrap: str = "{}") -> str:
    arms = " ".join(
        f"WHEN page_id % {d} = {r} THEN {wrap.format(repr(v))}" for d, r, v in rules
    )
    return f"CASE {arms} ELSE {otherwise} END"


_TITLE = "regexp_replace(h, '<title>[^<]*</title>', '<title>' || {} || '</title>', 'g')"
DECO = f"""
deco AS MATERIALIZED (
  SELECT page_id, {_chosen(URLS, "url")} AS url, {_chosen(TITLES, "h", _TITLE)} AS html
  FROM (
    SELECT page_id, url,
      replace(replace(replace(html, '</head>', {_extra(HEAD)} || '</head>'),
              '</article>', {_extra(BODY)} || '</article>'),
              '</footer>', {_extra(FOOTER)} || '</footer>') AS h
    FROM pages))
"""
PLAIN = "deco AS (SELECT page_id, url, html FROM pages)"


def decode(x: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def attr(name: str, raw: str = "raw") -> str:
    """Value of a double-quoted attribute; NULL when the attribute is missing."""
    has = rf"""regexp_matches({raw}, '(?i)\s{name}\s*=')"""
    value = decode(rf"""regexp_extract({raw}, '(?i)\s{name}\s*=\s*"([^"]*)"', 1)""")
    return f"CASE WHEN {has} THEN {value} END"


TOKENS = rf"""
split_up AS (
  SELECT page_id, regexp_extract_all(html,
    '(?is)<!--.*?-->'
    || '|<script\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>.*?</script\s*>'
    || '|<style\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>.*?</style\s*>'
    || '|<noscript\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>.*?</noscript\s*>'
    || '|</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[!?/][^>]*>|[^<]+') AS found
  FROM deco),
code_free AS (
  SELECT deco.page_id, url, html, found,
    length(html) - coalesce(list_sum(list_transform(found, lambda x:
      CASE WHEN regexp_matches(x, '(?i)^<(script|style|noscript)\b') THEN length(x) ELSE 0 END)), 0) AS clean_len
  FROM deco JOIN split_up USING (page_id)),
raw_tok AS (
  SELECT page_id,
    unnest(list_transform(found, lambda x:
      CASE WHEN regexp_matches(x, '(?i)^<(script|style|noscript)\b') THEN '<!>' ELSE x END)) AS raw,
    unnest(range(1, len(found) + 1)) AS pos
  FROM split_up),
tok AS MATERIALIZED (
  SELECT page_id, pos::INT AS pos, raw,
    lower(regexp_extract(raw, '^<(/?[a-zA-Z][^\s/>]*)', 1)) AS code,
    CASE WHEN raw[1] = '<' THEN ''
      ELSE regexp_replace({decode('raw')}, '^\s+|\s+$', '', 'g') END AS txt
  FROM raw_tok)
"""


def last(kinds: str) -> str:
    """1-based index of the last open element of one of the kinds, 0 without one."""
    return (
        "coalesce(list_max(list_transform(range(1, len(st) + 1), "
        f"lambda i: CASE WHEN st[i] IN ({kinds}) THEN i ELSE 0 END)), 0)"
    )


def _close(tag: str, kinds: str, stops: str) -> str:
    return (
        f"WHEN code = '{tag}' THEN CASE WHEN {last(names(kinds))} > {last(names(stops))} "
        f"THEN {last(names(kinds))} - 1 ELSE len(st) END"
    )


TREE = f"""
walk AS (
  SELECT page_id, 0 AS pos, '' AS code, '' AS txt, []::INT[] AS sp, []::VARCHAR[] AS st,
    []::INT[] AS anc, []::VARCHAR[] AS anct
  FROM deco
  UNION ALL
  SELECT page_id, pos, code, txt,
    CASE WHEN opens THEN list_append(sp[1:keep], pos) ELSE sp[1:keep] END,
    CASE WHEN opens THEN list_append(st[1:keep], code) ELSE st[1:keep] END,
    sp[1:keep], st[1:keep]
  FROM (
    SELECT *, code <> '' AND code[1] <> '/' AND code NOT IN ({names(VOID)}) AS opens,
      CASE WHEN code IN ({names(BLOCK)}) AND keep1 > 0 AND st[keep1] = 'p'
        THEN keep1 - 1 ELSE keep1 END AS keep
    FROM (
      SELECT t.page_id, t.pos, t.code, t.txt, w.sp, w.st,
        CASE
          WHEN t.code IN ('/body', '/html') THEN
            CASE WHEN {last("'body'")} > 0 THEN {last("'body'")} ELSE len(st) END
          WHEN t.code[1] = '/' THEN
            CASE WHEN {last("t.code[2:]")} > 0 THEN {last("t.code[2:]")} - 1 ELSE len(st) END
          {_close("li", "li", "ul ol menu dir").replace("code =", "t.code =")}
          {_close("dt", "dt dd", "dl").replace("code =", "t.code =")}
          {_close("dd", "dt dd", "dl").replace("code =", "t.code =")}
          {_close("tr", "tr", "table").replace("code =", "t.code =")}
          {_close("td", "td th", "tr table").replace("code =", "t.code =")}
          {_close("th", "td th", "tr table").replace("code =", "t.code =")}
          {_close("option", "option", "select").replace("code =", "t.code =")}
          ELSE len(st) END AS keep1
      FROM walk w JOIN tok t ON t.page_id = w.page_id AND t.pos = w.pos + 1))),
el AS MATERIALIZED (
  SELECT w.page_id, w.pos AS eid, w.code AS tag, t.raw, w.anc, w.anct,
    w.anc[-1] AS parent,
    CASE WHEN w.code = 'body' THEN 0
      WHEN list_contains(w.anct, 'body') THEN len(w.anc) - list_position(w.anct, 'body') + 1
    END AS depth
  FROM walk w JOIN tok t USING (page_id, pos)
  WHERE w.code <> '' AND w.code[1] <> '/'),
txt AS MATERIALIZED (
  SELECT page_id, pos, txt, anc FROM walk WHERE txt <> ''),
inner_txt AS MATERIALIZED (
  SELECT page_id, eid, sum(length(txt)) AS len, string_agg(txt, '' ORDER BY pos) AS joined,
    string_agg(txt, ' ' ORDER BY pos) AS spaced
  FROM (SELECT page_id, pos, txt, unnest(anc) AS eid FROM txt) GROUP BY ALL),
node AS MATERIALIZED (
  SELECT e.*, coalesce(i.len, 0) AS len, coalesce(i.joined, '') AS joined,
    coalesce(i.spaced, '') AS spaced
  FROM el e LEFT JOIN inner_txt i USING (page_id, eid)),
kid AS MATERIALIZED (
  SELECT page_id, parent AS eid, sum(n) AS kids, max(n) AS same_kids,
    coalesce(max(n) FILTER (tag = 'article'), 0) AS article_kids
  FROM (SELECT page_id, parent, tag, count(*) AS n FROM el WHERE parent IS NOT NULL GROUP BY ALL)
  GROUP BY ALL),
ttl AS (
  SELECT page_id, arg_min(spaced, eid) AS title FROM node WHERE tag = 'title' GROUP BY page_id),
body AS MATERIALIZED (
  SELECT d.page_id, d.url, coalesce(b.body, '') AS body, coalesce(t.title, '') AS title,
    lower(coalesce(b.body, '')) AS t
  FROM deco d
  LEFT JOIN (SELECT page_id, string_agg(txt, ' ' ORDER BY pos) AS body FROM txt GROUP BY page_id) b
    USING (page_id)
  LEFT JOIN ttl t USING (page_id))
"""

MARKS = "'cf-browser-verification|challenge-form|cf_clearance|ddos-guard'"
NOTICE = f"""
notice AS MATERIALIZED (
  SELECT b.page_id,
    lower(b.title || ' ' || coalesce(h.headings, '')
      || CASE WHEN len(regexp_extract_all(b.body, '\\S+')) < 60 THEN ' ' || b.body ELSE '' END) AS said,
    coalesce(c.marked, false) AS marked
  FROM body b
  LEFT JOIN (SELECT page_id, string_agg(joined, ' ' ORDER BY eid) AS headings FROM node
             WHERE tag IN ('h1', 'h2', 'h3') GROUP BY page_id) h USING (page_id)
  LEFT JOIN (SELECT page_id, bool_or(regexp_matches(lower(concat_ws(' ', {attr("id")}, {attr("class")}, {attr("name")},
               {attr("action")})), {MARKS})) AS marked FROM node GROUP BY page_id) c USING (page_id))
"""


# Non-ASCII letters and digits become '_', so that RE2's ASCII word boundaries are right for them.
def ascii_words(x: str) -> str:
    return rf"regexp_replace({x}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{M}}\p{{C}}]', '_', 'g')"


URL = r"""
upart AS MATERIALIZED (
  SELECT page_id, url, lower(netloc) AS netloc, lower(path) AS path, path AS raw_path,
    lower(query) AS query, scheme,
    list_filter(string_split(lower(path), '/'), lambda p: p <> '') AS parts,
    CASE WHEN query = '' THEN []
      ELSE list_transform(string_split(lower(query), '&'), lambda p: string_split(p, '=')[1]) END
      AS params, query AS raw_query, netloc AS raw_netloc
  FROM (
    SELECT page_id, url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS scheme,
      regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc,
      regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
      regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
    FROM deco)),
uf AS MATERIALIZED (
  SELECT page_id, url, len(parts)::INT AS url_path_depth,
    round_even(len(parts) / 3.0, 4) AS url_depth_normalized,
    (query <> '')::INT AS url_has_any_param, (query <> '')::INT AS url_has_query_params,
    len(params)::INT AS url_query_param_count,
    regexp_matches(path, '/[0-9]{3,}')::INT AS url_has_numeric_id,
    (len(list_filter(parts, lambda p: regexp_matches(p, '^[a-z]+-[a-z]+-[a-z]'))) > 0)::INT
      AS url_has_long_slug,
    list_has_any(parts, ['search','results','catalog','category','categories','products','listings',
      'browse','index','archive','tag','tags','shop','store','jobs','properties','hotels','recipes',
      'articles','news','blog'])::INT AS url_list_token_match,
    list_has_any(parts, ['product','item','article','post','property','job','hotel','recipe',
      'profile','detail','view','show','read','watch','event'])::INT AS url_detail_token_match,
    (len(parts) > 0 AND contains(coalesce(parts[-1], ''), '.'))::INT AS url_has_extension,
    (path IN ('', '/'))::INT AS url_is_root,
    list_has_any(params, ['q','query','search','keyword','s','find'])::INT AS url_has_search_param,
    list_has_any(params, ['filter','sort','order','page','offset','limit','from'])::INT
      AS url_has_filter_param,
    (list_contains(params, 'page') OR regexp_matches(lower(url), '[?&]page=\d+'))::INT
      AS url_has_page_param,
    regexp_matches(netloc, 'lever\.co|greenhouse\.io|workable\.com|smartrecruiters\.com|applytojob\.com|bamboohr\.com')::INT
      AS is_job_board_domain,
    regexp_matches(netloc, 'docs\.python\.org|developer\.mozilla\.org|docs\.aws\.amazon\.com|official-docs')::INT
      AS is_api_doc_domain,
    regexp_matches(path, 'jobs|careers')::INT AS has_jobs_in_path,
    (regexp_matches(query, '(^|&)(q|query|search|s|find|keyword|term|k|field-keywords)=')
     OR regexp_matches(query, '(^|&)(type|category|filter|sort|page|offset|c)=')
     OR regexp_matches(path, '/(search|results?|listings?|categories|category|browse|discover|explore|publications?|exhibitions?|datasets?|topics?|tags?|genre|archive|year|list[/-])')
     OR regexp_matches(path, '/(jobs|careers|vacancies|openings|products|items|hotels|recipes|articles|posts|news|papers?|reports?)/?$')
     OR regexp_matches(netloc, '(boards|jobs|careers)\.(greenhouse\.io|lever\.co|workable\.com|smartrecruiters\.com)'))
      AS is_listing
  FROM upart)
"""


def page_query(select: str, *, decorated: bool = True, parts: tuple[str, ...] = ("tree",)) -> str:
    ctes = [DECO if decorated else PLAIN]
    if "tree" in parts:
        ctes += [TOKENS, TREE]
    elif "tok" in parts:
        ctes += [TOKENS]
    if "url" in parts:
        ctes.append(URL)
    for extra in parts:
        if extra not in ("tree", "tok", "url"):
            ctes.append(extra)
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select
