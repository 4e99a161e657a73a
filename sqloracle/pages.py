"""Oracle SQL for page extraction, url canonicalisation, the page index and page search (DuckDB)."""

from __future__ import annotations

from sqloracle import fixed as K
from sqloracle.search import BENCHMARK_QUERIES, bm25_tail, query_word_ctes
from sqloracle.text import collapse_ws, keep_word, q, stem_ctes, trim_ws, words_of

ABS, SR, REL = q(K.ABS_RE), q(K.SPECIAL_REST_RE), q(K.REL_RE)
PENC = q(K.PATH_ENCODE_RE)
TRACKING = "(" + ", ".join(q(k) for k in K.TRACKING_KEYS) + ")"
DOTS2 = "('..', '.%2e', '%2e.', '%2e%2e')"
DOTS_ALL = "('..', '.', '.%2e', '%2e.', '%2e%2e', '%2e')"


def _optq(col: str, pat: str, idx: int) -> str:
    g = f"regexp_extract({col}, {pat}, {idx})"
    return f"CASE WHEN length({g}) > 0 THEN substr({g}, 2) END"


def _dec(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def _enc(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '~', '%7E'), '%2A', '*'), '%20', '+')"


def url_ctes(src: str, href: str, base: str | None, out_col: str, rel: str) -> str:
    """CTEs: relation ``rel`` = all columns of ``src`` plus ``out_col`` = canonical url of href vs base."""
    b = base or "CAST(NULL AS VARCHAR)"
    p = rel + "_u"
    tmp = ["_h", "_b", "_habs", "_hrest", "_brest", "_scheme", "_auth", "_path", "_query", "_hp", "_ui", "_host",
           "_port", "_pn", "_ok", "_origin", "_pabs", "_penc", "_pdot", "_q"]
    c = []
    c.append(f"""{p}a AS (SELECT *, regexp_replace(regexp_replace({href}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'),
        '[\\t\\n\\r]', '', 'g') AS _h, {b} AS _b FROM {src})""")
    c.append(f"""{p}b AS (SELECT *, regexp_matches(_h, {ABS}) AS _habs, regexp_extract(_h, {ABS}, 2) AS _hrest,
        regexp_extract(_b, {ABS}, 2) AS _brest,
        CASE WHEN regexp_matches(_h, {ABS}) THEN lower(regexp_extract(_h, {ABS}, 1))
             ELSE lower(regexp_extract(_b, {ABS}, 1)) END AS _scheme FROM {p}a)""")
    srel = "(starts_with(_h, '//') OR starts_with(_h, '\\\\'))"
    relpath = f"regexp_extract(_h, {REL}, 1)"
    bpath = f"regexp_extract(_brest, {SR}, 2)"
    c.append(f"""{p}c AS (SELECT *,
        CASE WHEN _habs THEN regexp_extract(_hrest, {SR}, 1) WHEN {srel} THEN regexp_extract(_h, {SR}, 1)
             ELSE regexp_extract(_brest, {SR}, 1) END AS _auth,
        replace(CASE WHEN _habs THEN regexp_extract(_hrest, {SR}, 2) WHEN {srel} THEN regexp_extract(_h, {SR}, 2)
             WHEN starts_with(_h, '/') OR starts_with(_h, '\\') THEN {relpath}
             WHEN length({relpath}) = 0 THEN {bpath}
             ELSE regexp_extract(CASE WHEN length({bpath}) > 0 THEN {bpath} ELSE '/' END, '^(.*/)', 1) || {relpath}
             END, '\\', '/') AS _path,
        CASE WHEN _habs THEN {_optq('_hrest', SR, 3)} WHEN {srel} THEN {_optq('_h', SR, 3)}
             WHEN length({relpath}) = 0 AND ({_optq('_h', REL, 2)}) IS NULL THEN {_optq('_brest', SR, 3)}
             ELSE {_optq('_h', REL, 2)} END AS _query
        FROM {p}b)""")
    c.append(f"""{p}d AS (SELECT *, regexp_extract(_auth, '^(?:.*@)?([^@]*)$', 1) AS _hp,
        regexp_extract(_auth, '^(.*@)', 1) AS _ui FROM {p}c)""")
    c.append(f"""{p}e AS (SELECT *, lower(regexp_extract(_hp, '^([^:]*)', 1)) AS _host,
        regexp_extract(_hp, '^[^:]*:(.*)$', 1) AS _port FROM {p}d)""")
    c.append(f"""{p}f AS (SELECT *, CASE WHEN regexp_matches(_port, '^[0-9]+$') AND length(ltrim(_port, '0')) <= 5
                 THEN CAST(CAST(_port AS INTEGER) AS VARCHAR) END AS _pn FROM {p}e)""")
    c.append(f"""{p}g AS (SELECT *,
        (_scheme IN ('http', 'https') AND length(_host) > 0
         AND (length(_port) = 0 OR (_pn IS NOT NULL AND CAST(_pn AS INTEGER) <= 65535))
         AND NOT regexp_matches(_host, {q(K.HOST_FORBIDDEN_RE)})) AS _ok,
        _scheme || '://' || _ui || _host ||
          CASE WHEN length(_port) = 0 OR _pn = CASE _scheme WHEN 'http' THEN '80' WHEN 'https' THEN '443' END
               THEN '' ELSE ':' || _pn END AS _origin,
        CASE WHEN starts_with(_path, '/') THEN _path ELSE '/' || _path END AS _pabs FROM {p}f)""")
    c.append(f"""{p}h AS (SELECT *, CASE WHEN regexp_matches(_pabs, {PENC}) THEN array_to_string(list_transform(
            string_split(_pabs, ''), lambda ch: CASE WHEN ch = ' ' THEN '%20' WHEN regexp_matches(ch, {PENC})
            THEN url_encode(ch) ELSE ch END), '') ELSE _pabs END AS _penc FROM {p}g)""")
    segs = "string_split(substr(_penc, 2), '/')"
    c.append(f"""{p}i AS (SELECT *, '/' || array_to_string(
        list_reduce({segs}, lambda acc, s: CASE WHEN lower(s) IN {DOTS2} THEN acc[1:len(acc) - 1]
                                               WHEN lower(s) IN ('.', '%2e') THEN acc ELSE list_append(acc, s) END,
                    []::VARCHAR[])
        || CASE WHEN lower({segs}[-1]) IN {DOTS_ALL} THEN [''] ELSE []::VARCHAR[] END, '/') AS _pdot,
        array_to_string(list_transform(list_sort(list_filter(list_transform(
            list_filter(string_split(_query, '&'), lambda x: length(x) > 0),
            lambda x, i: {{'k': {_dec("split_part(x, '=', 1)")}, 'pos': i,
                          'v': {_dec("CASE WHEN strpos(x, '=') > 0 THEN substr(x, strpos(x, '=') + 1) ELSE '' END")}}}),
            lambda s: s.k NOT IN {TRACKING})), lambda s: {_enc('s.k')} || '=' || {_enc('s.v')}), '&') AS _q
        FROM {p}h)""")
    trimmed = "CASE WHEN length(_pdot) > 1 AND suffix(_pdot, '/') THEN left(_pdot, length(_pdot) - 1) ELSE _pdot END"
    c.append(f"""{rel} AS (SELECT * EXCLUDE ({', '.join(tmp)}),
        CASE WHEN _ok THEN _origin || {trimmed} || CASE WHEN length(_q) > 0 THEN '?' || _q ELSE '' END END
        AS {out_col} FROM {p}i)""")
    return ",\n".join(c)


def domain_of(url: str) -> str:
    """Host of a canonical http(s) url."""
    return f"regexp_extract({url}, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)"


def classify(url: str) -> str:
    h = f"regexp_replace({domain_of(url)}, '^www\\.', '')"
    return (f"CASE WHEN {url} IS NULL OR length({h}) = 0 THEN 'google' WHEN suffix({h}, 'wikipedia.org') THEN "
            f"'wikipedia' WHEN suffix({h}, 'youtube.com') OR {h} = 'youtu.be' THEN 'youtube' WHEN suffix({h}, "
            f"'instagram.com') THEN 'instagram' WHEN suffix({h}, 'archive.org') THEN 'archive' ELSE 'google' END")


def _map_of(pairs: dict[str, str]) -> str:
    return f"map([{', '.join(q(k) for k in pairs)}], [{', '.join(q(v) for v in pairs.values())}])"


def _decode(x: str, attribute: bool = False) -> str:
    """References decoded once, left to right; the value is split into references, other text and lone '&'."""
    legacy = " ".join(f"WHEN {n} THEN {q(c)}" for n, c in K.WINDOWS_1252.items() if c)
    digits = "regexp_extract(r, '^&#[xX]?0*([0-9a-fA-F]*)', 1)"
    number = (f"coalesce(CASE WHEN length({digits}) > 7 THEN 0 WHEN lower(substr(r, 3, 1)) = 'x' THEN TRY_CAST('0x' || {digits} AS BIGINT) "
              f"ELSE TRY_CAST({digits} AS BIGINT) END, 0)")
    point = (f"CASE {number} {legacy} ELSE CASE WHEN {number} > 0 AND {number} <= 1114111 AND NOT ({number} BETWEEN 55296 AND 57343) "
             f"THEN chr(CAST({number} AS INTEGER)) ELSE chr(65533) END END")
    whole_name = f"CASE WHEN suffix(r, ';') THEN {_map_of(K.NAMED)}[substr(r, 2, length(r) - 2)] END"
    if attribute:
        short = [f"{_map_of(K.WITHOUT_SEMICOLON)}[substr(r, 2)]"]
    else:
        short = [f"{_map_of({k: v for k, v in K.WITHOUT_SEMICOLON.items() if len(k) == n})}[substr(r, 2, {n})] || substr(r, {n + 2})"
                 for n in sorted({len(k) for k in K.WITHOUT_SEMICOLON}, reverse=True)]
    one = (f"CASE WHEN NOT starts_with(r, '&') OR length(r) < 3 THEN r WHEN starts_with(r, '&#') THEN {point} "
           f"ELSE coalesce({whole_name}, {', '.join(short)}, r) END")
    pattern = q(K.ATTRIBUTE_REFERENCE if attribute else K.REFERENCE)
    whole = f"array_to_string(list_transform(regexp_extract_all({x}, {pattern}), lambda r: {one}), '')"
    return f"CASE WHEN contains({x}, '&') THEN {whole} ELSE {x} END"


def _without_scripts(col: str) -> str:
    out = col
    for tag in K.RAW_TEXT_TAGS:
        out = f"regexp_replace({out}, {q(K.element(tag))}, '', 'g')"
    return f"regexp_replace({out}, {q(K.COMMENT)}, '', 'g')"


def _remove(col: str) -> str:
    out = _without_scripts(col)
    for tag in K.REMOVED_TAGS:
        out = f"regexp_replace({out}, {q(K.element(tag))}, '', 'g')"
    return out


def _unquoted(v: str) -> str:
    return f"regexp_replace({v}, {q(chr(94) + chr(91) + chr(34) + chr(39) + ']|[' + chr(34) + chr(39) + ']$')}, '', 'g')"


def _description(which: str) -> str:
    metas = f"list_filter(regexp_extract_all(clean, {q('(?is)' + K.open_tag('meta'))}), lambda m: regexp_matches(m, {q(which)}))"
    found = f"list_transform({metas}, lambda m: {_unquoted(f'regexp_extract(m, {q(K.CONTENT)}, 1)')})"
    return f"nullif(list_transform({found}, lambda v: {_decode('v', attribute=True)})[1], '')"


def _links(src: str, limit: int | None = None) -> str:
    raw = f"list_transform(regexp_extract_all({src}, {q(K.HREF)}, 1), lambda v: {_unquoted('v')})"
    kept = f"list_filter(list_transform({raw}, lambda v: {_decode('v', attribute=True)}), lambda v: length(v) > 0)"
    return kept if limit is None else f"list_slice({kept}, 1, {limit})"


def _tagless(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(K.ANY_TAG)}, '', 'g'), {q(K.DECLARATION)}, '', 'g')"


_NAMES = ["pg0", "pg1", "pg2", "pg3", "pg4", "pg5", "ex", "kept", "seen", "lst", "pc", "pbw", "pbk", "ptw", "ptk", "pxk",
          "plen", "pdocs", "pvocab", "pstems", "ppost"]


def prefixed(sql: str, px: str, src: str = "pages") -> str:
    """Rename the page CTEs with prefix ``px`` and read ``src`` instead of the pages view."""
    import re

    if not px and src == "pages":
        return sql
    names = sorted(_NAMES, key=len, reverse=True)
    sql = re.sub(r"\b(" + "|".join(names) + r")(_u[a-i]|_s[0-9]+)?\b", lambda m: px + m.group(0), sql)
    return re.sub(r"\bFROM pages\)", f"FROM {src})", sql)


def extraction_ctes(links_before_removal: bool = False, arrived: str = "NULL") -> str:
    """CTEs: ex(page_id, raw_url, url, domain, title, snippet, body_text, links, arrived)."""
    return f"""
pg0 AS (SELECT page_id, url AS raw_url, html, {arrived} AS arrived FROM pages),
{url_ctes('pg0', 'raw_url', None, 'url', 'pg1')},
pg2 AS (SELECT page_id, raw_url, url, arrived, {_without_scripts('html')} AS plain, {_remove('html')} AS clean FROM pg1),
pg3 AS (SELECT *, regexp_extract(clean, {q(K.until_close('title'))}, 1) AS title0,
               {_tagless(f"regexp_extract(clean, {q(K.until_close('h1'))}, 1)")} AS h10,
               {_tagless(f"CASE WHEN regexp_matches(clean, {q('(?is)' + K.open_tag('body'))}) THEN regexp_extract(clean, {q(K.until_close('body'))}, 1) ELSE regexp_replace(regexp_replace(clean, {q(K.element('head'))}, '', 'g'), {q(K.until_close('title'))}, '', 'g') END")} AS body0,
               {_description(K.DESCRIPTION)} AS meta1, {_description(K.OG_DESCRIPTION)} AS meta2,
               {_links('plain' if links_before_removal else 'clean')} AS links FROM pg2),
pg4 AS (SELECT *, {_decode('title0')} AS title1, {_decode('h10')} AS h11, {_decode('body0')} AS body1 FROM pg3),
pg5 AS (SELECT page_id, raw_url, url, arrived, {domain_of('url')} AS domain,
               coalesce(nullif({trim_ws('title1')}, ''), nullif({trim_ws('h11')}, ''), url) AS title,
               coalesce(meta1, meta2) AS meta, {collapse_ws('body1')} AS body_text, links FROM pg4),
ex AS (SELECT page_id, raw_url, url, arrived, CASE WHEN url IS NULL THEN NULL ELSE domain END AS domain, title,
              coalesce(meta, CASE WHEN length(body_text) > 200 THEN substr(body_text, 1, 200) || '...'
                                  ELSE body_text END) AS snippet, body_text, links FROM pg5)"""


def settle_ctes() -> str:
    """CTEs after extraction_ctes: pc(doc_id, url, domain, title, snippet, body). Pages of a url are replayed in order of arrival,
    page_id and content hash: the last run of equal bodies counts, with the fields of its first page."""
    return """
kept AS (SELECT *, sha256(coalesce(body_text, '')) AS h FROM ex
         WHERE url IS NOT NULL AND length(url) > 0 AND body_text IS NOT NULL AND length(body_text) > 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY arrived NULLS FIRST, page_id NULLS FIRST, h) AS turn,
                coalesce(h <> lag(h) OVER (PARTITION BY url ORDER BY arrived NULLS FIRST, page_id NULLS FIRST, h), true) AS fresh FROM kept),
lst AS (SELECT url, max(turn) AS turn FROM seen WHERE fresh GROUP BY url),
pc AS (SELECT CAST(('0x' || substr(md5(k.url), 1, 15)) AS BIGINT) AS doc_id, k.url, k.domain, k.title, k.snippet, k.body_text AS body
       FROM seen k JOIN lst l ON k.url = l.url AND k.turn = l.turn)"""


def page_index_ctes(extra_vocab: str | None = None) -> str:
    """CTEs after settle_ctes: pdocs (documents), pstems, ppost (postings with doc_len)."""
    vocab = "SELECT DISTINCT word FROM pxk" + (f" UNION SELECT word FROM {extra_vocab}" if extra_vocab else "")
    return f"""
pbw AS (SELECT doc_id, unnest({words_of('body')}) AS word FROM pc),
pbk AS (SELECT doc_id, word FROM pbw WHERE {keep_word('word')}),
ptw AS (SELECT doc_id, unnest({words_of("coalesce(title, '')")}) AS word FROM pc),
ptk AS (SELECT doc_id, word FROM ptw WHERE {keep_word('word')}),
pxk AS (SELECT doc_id, word, 1 AS b, 0 AS t FROM pbk UNION ALL SELECT doc_id, word, 0 AS b, 1 AS t FROM ptk),
plen AS (SELECT pc.doc_id, CAST(count(pbk.word) AS INTEGER) AS body_length FROM pc LEFT JOIN pbk
         ON pc.doc_id = pbk.doc_id GROUP BY pc.doc_id),
pdocs AS (SELECT pc.doc_id, pc.url, pc.domain, coalesce(nullif(pc.title, ''), pc.url, '') AS title,
                 coalesce(pc.snippet, '') AS snippet, plen.body_length, sha256(coalesce(pc.body, '')) AS content_hash
          FROM pc JOIN plen ON pc.doc_id = plen.doc_id),
pvocab AS ({vocab}),
{stem_ctes('pvocab', 'pstems')},
ppost AS (SELECT s.term, x.doc_id, CAST(sum(x.b) AS INTEGER) AS tf_body, CAST(sum(x.t) AS INTEGER) AS tf_title
          FROM pxk x JOIN pstems s ON x.word = s.word GROUP BY s.term, x.doc_id)"""


def page_fields_sql() -> str:
    return f"""WITH {extraction_ctes()}
SELECT page_id, url, domain, title, snippet, body_text, CAST(len(links) AS INTEGER) AS n_links FROM ex"""


def page_links_sql() -> str:
    return f"""WITH {extraction_ctes(links_before_removal=True)},
lk0 AS (SELECT page_id, url AS base, unnest(links) AS href, unnest(range(len(links))) AS pos FROM ex),
{url_ctes('lk0', 'href', 'base', 'link_url', 'lk1')}
SELECT page_id, CAST(pos AS INTEGER) AS pos, href, link_url FROM lk1"""


def url_norm_sql() -> str:
    return f"""WITH {extraction_ctes()}
SELECT page_id, raw_url, url, domain, {classify('url')} AS source FROM ex"""


def page_documents_sql() -> str:
    return f"""WITH {extraction_ctes()}, {settle_ctes()}, {page_index_ctes()}
SELECT doc_id, url, domain, title, snippet, body_length, content_hash FROM pdocs"""


def page_postings_sql() -> str:
    return f"""WITH {extraction_ctes()}, {settle_ctes()}, {page_index_ctes()}
SELECT term, doc_id, tf_body, tf_title FROM ppost"""


VARIED = """(SELECT page_id, html, 'https://' || CASE page_id % 7 WHEN 0 THEN 'en.wikipedia.org' WHEN 1 THEN 'www.youtube.com' WHEN 2 THEN 'youtu.be'
    WHEN 3 THEN 'www.instagram.com' WHEN 4 THEN 'web.archive.org' WHEN 6 THEN 'example.org' ELSE regexp_extract(url, '^https?://([^/?#]*)', 1) END
    || regexp_replace(url, '^https?://[^/?#]*', '') AS url FROM pages)"""


def _page_search_ctes(src: str = "pages", queries: str = BENCHMARK_QUERIES, limit: int = 20) -> str:
    body = prefixed(f"{extraction_ctes()}, {settle_ctes()}, {page_index_ctes(extra_vocab='qsel')}", "", src)
    return f"""WITH {query_word_ctes(queries)}, {body},
qterms AS (SELECT DISTINCT query_id, term FROM qsel JOIN pstems ON qsel.word = pstems.word),
{bm25_tail('ppost', 'plen', 'qterms', None, limit)},
hits AS (SELECT r.query_id, r.rank, 'idx-' || CAST(r.doc_id AS VARCHAR) AS id, r.doc_id, d.url, d.title, d.snippet,
                r.score, {classify('d.url')} AS source, r.total_hits
         FROM bm25res r JOIN pdocs d ON r.doc_id = d.doc_id)"""


def page_search_sql() -> str:
    return _page_search_ctes() + "\nSELECT * FROM hits"


def first_result_sql() -> str:
    return _page_search_ctes() + "\nSELECT query_id, rank, id, score, total_hits FROM hits WHERE rank = 1"


def source_counts_sql() -> str:
    return _page_search_ctes(VARIED) + """
SELECT query_id, count(*) AS "all", count(*) FILTER (WHERE source IN ('archive', 'vimeo', 'streaming')) AS movies,
       count(*) FILTER (WHERE source = 'google') AS google, count(*) FILTER (WHERE source = 'wikipedia') AS wikipedia,
       count(*) FILTER (WHERE source = 'youtube') AS youtube, count(*) FILTER (WHERE source = 'instagram') AS instagram
FROM hits GROUP BY query_id"""


def tab_results_sql() -> str:
    return _page_search_ctes(VARIED) + """
SELECT query_id, CAST(n AS INTEGER) AS tab_rank, id, CASE WHEN length(url) > 30 THEN left(url, 30) || '...' ELSE url END AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hits WHERE source = 'youtube') WHERE n <= 3"""


def search_response_sql() -> str:
    from sqloracle.activity import cards_cte

    queries = f"""SELECT item_id AS query_id, text AS qtext FROM benchmark UNION ALL SELECT -1, '   ' UNION ALL SELECT -2, 'the a an'
        UNION ALL SELECT -2 - row_number() OVER (ORDER BY event_type), event_type FROM (SELECT DISTINCT event_type FROM events)"""
    return _page_search_ctes(queries=queries, limit=5) + f""",
{cards_cte()},
asked AS ({queries}),
shown AS (SELECT query_id, rank, id, source, total_hits FROM hits
          UNION ALL SELECT a.query_id, 0, c.id, '-', NULL FROM asked a JOIN cards c ON lower(trim(a.qtext)) = c.word)
SELECT a.query_id, a.qtext AS query, coalesce(max(s.total_hits), 0) AS total_hits,
       coalesce(string_agg(s.id, ' ' ORDER BY s.rank), '') AS ids, coalesce(string_agg(s.source, ' ' ORDER BY s.rank), '') AS sources
FROM asked a LEFT JOIN shown s ON a.query_id = s.query_id GROUP BY a.query_id, a.qtext"""


def page_entities_sql() -> str:
    src = f"(SELECT page_id, url, replace(html, '<article>', '<article>' || {q(K.ENTITY_FORMS)}) AS html FROM pages)"
    body = prefixed(extraction_ctes(), "", src)
    return f"""WITH {body}
SELECT page_id, title, snippet, body_text, array_to_string(links, ' ') AS links FROM ex"""


def page_markup_sql() -> str:
    """The harder markup shows the same as its plain form."""
    src = f"(SELECT page_id, url, replace(html, '<article>', '<article>' || {q(K.PLAIN_MARKUP)}) AS html FROM pages)"
    body = prefixed(extraction_ctes(), "", src)
    return f"""WITH {body}
SELECT page_id, title, snippet, body_text, array_to_string(links, ' ') AS links FROM ex"""


_SECOND = f"""SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN replace(html, '</article>', {q(K.REVISION)}) ELSE html END AS html"""


def recrawl_same_id_sql() -> str:
    src = f"(SELECT page_id, url, html, 1 AS arrived FROM pages UNION ALL ({_SECOND}, 2 AS arrived FROM pages))"
    body = prefixed(f"{extraction_ctes(arrived='arrived')}, {settle_ctes()}, {page_index_ctes()}", "", src)
    return f"""WITH {body}
SELECT doc_id, url, domain, title, snippet, body_length, content_hash FROM pdocs"""


def recrawl_moved_url_sql() -> str:
    """Documents are told apart by url alone, so moving ids about changes nothing."""
    even = "(SELECT * FROM pages WHERE page_id % 2 = 0)"
    odd = "(SELECT page_id - 1 AS page_id, url, html FROM pages WHERE page_id % 2 = 1)"
    body = f"{extraction_ctes()}, {settle_ctes()}, {page_index_ctes()}"
    cols = "doc_id, url, domain, title, snippet, body_length, content_hash"
    return f"""WITH {prefixed(body, 'a_', even)}, {prefixed(body, 'b_', odd)}
SELECT b.doc_id, b.url, b.domain, CASE WHEN a.content_hash = b.content_hash THEN a.title ELSE b.title END AS title,
       CASE WHEN a.content_hash = b.content_hash THEN a.snippet ELSE b.snippet END AS snippet, b.body_length, b.content_hash
FROM b_pdocs b LEFT JOIN a_pdocs a ON a.url = b.url
UNION ALL SELECT {cols} FROM a_pdocs WHERE url NOT IN (SELECT url FROM b_pdocs)"""


def _deleted_ctes() -> str:
    return f"""WITH {extraction_ctes()}, {settle_ctes()}, {page_index_ctes()},
gone AS (SELECT DISTINCT url FROM ex WHERE page_id % 7 = 0 AND url IS NOT NULL),
left_over AS (SELECT * FROM pdocs WHERE url NOT IN (SELECT url FROM gone))"""


def delete_documents_sql() -> str:
    return _deleted_ctes() + "\nSELECT p.term, p.doc_id, p.tf_body, p.tf_title FROM ppost p JOIN left_over d ON p.doc_id = d.doc_id"


def delete_stats_sql() -> str:
    return _deleted_ctes() + """
SELECT count(*) AS doc_count, CAST(coalesce(sum(body_length), 0) AS BIGINT) AS total_length,
       CASE WHEN count(*) > 0 THEN sum(body_length) / count(*) ELSE 0.0 END AS avg_length FROM left_over"""


def _reindex_ctes() -> str:
    first = "(SELECT * FROM pages WHERE page_id % 10 <> 3)"
    second = (f"(SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN replace(html, '</article>', {q(K.REVISION)}) "
              f"ELSE html END AS html FROM pages)")
    body = extraction_ctes() + ",\n" + settle_ctes() + ",\n" + page_index_ctes()
    t1, t2 = f"TIMESTAMP '{K.FIRST_CRAWL_AT}'", f"TIMESTAMP '{K.SECOND_CRAWL_AT}'"
    return f"""WITH {prefixed(body, 'a_', first)},
{prefixed(body, 'b_', second)},
rj AS (SELECT b.doc_id AS new_id, b.url, b.domain, b.title, b.snippet, b.body_length, b.content_hash,
              a.doc_id AS old_id, a.content_hash AS old_hash, a.body_length AS old_len, a.title AS old_title,
              a.snippet AS old_snippet
       FROM b_pdocs b LEFT JOIN a_pdocs a ON b.url = a.url),
rm AS (SELECT *, CASE WHEN old_id IS NULL THEN 'inserted' WHEN content_hash = old_hash THEN 'unchanged'
                      ELSE 'updated' END AS mode, coalesce(old_id, new_id) AS doc_id FROM rj),
modes AS (SELECT url, doc_id, mode, CAST(CASE mode WHEN 'inserted' THEN body_length
                                              WHEN 'updated' THEN body_length - old_len ELSE 0 END AS BIGINT)
                 AS length_delta FROM rm
          UNION ALL
          SELECT coalesce(url, raw_url) AS url, CAST(NULL AS BIGINT) AS doc_id, 'skipped' AS mode,
                 CAST(0 AS BIGINT) AS length_delta
          FROM b_ex WHERE NOT (url IS NOT NULL AND length(url) > 0 AND body_text IS NOT NULL AND length(body_text) > 0)),
touched AS (SELECT doc_id, url, domain,
                   CASE WHEN mode = 'unchanged' THEN old_title ELSE title END AS title,
                   CASE WHEN mode = 'unchanged' THEN old_snippet ELSE snippet END AS snippet,
                   CASE WHEN mode = 'unchanged' THEN old_len ELSE body_length END AS body_length,
                   CASE WHEN mode = 'unchanged' THEN old_hash ELSE content_hash END AS content_hash,
                   {t2} AS crawled_at, CASE WHEN mode = 'unchanged' THEN {t1} ELSE {t2} END AS updated_at FROM rm),
docs2 AS (SELECT doc_id, url, domain, title, snippet, body_length, content_hash, {t1} AS crawled_at,
                 {t1} AS updated_at FROM a_pdocs WHERE url NOT IN (SELECT url FROM touched)
          UNION ALL SELECT doc_id, url, domain, title, snippet, body_length, content_hash, crawled_at, updated_at
          FROM touched),
changed AS (SELECT doc_id, url FROM rm WHERE mode <> 'unchanged'),
post2 AS (SELECT term, doc_id, tf_body, tf_title FROM a_ppost WHERE doc_id NOT IN (SELECT doc_id FROM changed)
          UNION ALL
          SELECT p.term, c.doc_id, p.tf_body, p.tf_title FROM b_ppost p JOIN b_pdocs bd ON p.doc_id = bd.doc_id
          JOIN changed c ON bd.url = c.url),
st1 AS (SELECT count(*) AS n, coalesce(sum(body_length), 0) AS total FROM a_pdocs),
dlt AS (SELECT count(*) FILTER (WHERE mode = 'inserted') AS dd, coalesce(sum(length_delta), 0) AS dl FROM modes)"""


def reindex_modes_sql() -> str:
    return _reindex_ctes() + "\nSELECT url, doc_id, mode, length_delta FROM modes"


def reindex_documents_sql() -> str:
    return _reindex_ctes() + "\nSELECT * FROM docs2"


def reindex_postings_sql() -> str:
    return _reindex_ctes() + "\nSELECT term, doc_id, tf_body, tf_title FROM post2"


def reindex_stats_sql() -> str:
    return _reindex_ctes() + """
SELECT n + dd AS doc_count, CAST(total + dl AS BIGINT) AS total_length,
       CASE WHEN n + dd > 0 THEN (total + dl) / (n + dd) ELSE 0.0 END AS avg_length FROM st1, dlt"""


def segment_documents_sql() -> str:
    return _reindex_ctes() + """
SELECT d.*, m.mode, m.length_delta, (SELECT count(*) FROM docs2) AS doc_count, CAST((SELECT coalesce(sum(body_length), 0) FROM docs2) AS BIGINT) AS total_length
FROM docs2 d LEFT JOIN modes m ON d.doc_id = m.doc_id"""


def segment_postings_sql() -> str:
    return _reindex_ctes() + "\nSELECT term, doc_id, tf_body, tf_title, count(*) OVER (PARTITION BY term) AS df FROM post2"


def segment_deletions_sql() -> str:
    return _deleted_ctes() + """
SELECT p.term, p.doc_id, p.tf_body, p.tf_title, count(*) OVER (PARTITION BY p.term) AS df FROM ppost p JOIN left_over d ON p.doc_id = d.doc_id"""


def segment_search_sql() -> str:
    """After the second crawl every body is the second crawl's, so searching is searching its pages."""
    return _page_search_ctes(f"({_SECOND} FROM pages)") + "\nSELECT * FROM hits"


def url_hosts_sql() -> str:
    """Every page's path under one plain host, whose place the canonical form of the page's host then takes."""
    hosts = ", ".join(f"({n}, {'NULL' if h is None else q(h)}, {q(port)})" for n, (h, port) in enumerate(K.CANONICAL_HOSTS))
    return f"""WITH h0 AS (SELECT page_id, 'https://host.test' || regexp_replace(url, '^https?://[^/?#]*', '') AS raw FROM pages),
{url_ctes('h0', 'raw', None, 'u', 'h1')},
h2 AS (SELECT *, 'next?b=1' AS link FROM h1),
{url_ctes('h2', 'link', 'u', 'nx', 'h3')},
forms AS (SELECT * FROM (VALUES {hosts}) v(form, host, port))
SELECT page_id, CASE WHEN host IS NOT NULL THEN replace(u, 'https://host.test', 'https://' || host || port) END AS url, host AS domain,
       CASE WHEN host IS NULL THEN 'https://next/?b=1' ELSE replace(nx, 'https://host.test', 'https://' || host || port) END AS next
FROM h3 JOIN forms ON page_id % {len(K.CANONICAL_HOSTS)} = form"""
