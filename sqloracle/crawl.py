"""Oracle SQL for the crawl bookkeeping scenario (frontier, fetch gate, outcome fold, BFS, robots)."""

from __future__ import annotations

from sqloracle import fixed as K
from sqloracle.pages import extraction_ctes, url_ctes
from sqloracle.text import q


def _ts(t: str) -> str:
    return f"TIMESTAMP '{t}'"


def base_ctes() -> str:
    base, as_of = _ts(K.QUEUE_AT), _ts(K.AS_OF)
    t0, t1, t2 = (q(x) for x in K.ROBOTS_TEXTS)
    return f"""{extraction_ctes(links_before_removal=True)},
cp AS (SELECT min(page_id) AS page_id, url, arg_min(domain, page_id) AS domain, arg_min(links, page_id) AS links
       FROM ex WHERE url IS NOT NULL GROUP BY url),
queue AS (SELECT page_id AS id, url, domain, CAST(page_id % 5 AS INTEGER) AS depth,
                 CASE page_id % 6 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'pending' END AS status,
                 {base} + to_seconds(page_id) AS discovered_at,
                 CASE WHEN page_id % 6 IN (0, 1) THEN {base} + to_seconds(page_id) + to_seconds(page_id % 3) END
                   AS processed_at,
                 CASE WHEN page_id % 6 = 1 THEN 'timeout of 8000ms exceeded' END AS error FROM cp),
ds AS (SELECT domain, CAST(count(*) FILTER (WHERE status = 'done') AS INTEGER) AS pages_crawled,
              max(processed_at) AS last_fetched_at, CAST(1000 + (length(domain) % 3) * 1000 AS INTEGER) AS crawl_delay_ms,
              (length(domain) % 7 = 0) AS disallowed FROM queue GROUP BY domain),
fl AS (SELECT cp.page_id, cp.url, cp.domain,
              CAST(CASE cp.page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 301 ELSE 200 END AS INTEGER) AS status,
              CASE WHEN cp.page_id % 13 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
              p.html, CAST(NULL AS VARCHAR) AS error FROM cp JOIN pages p ON cp.page_id = p.page_id),
gate AS (SELECT url,
           CASE WHEN NOT (status >= 200 AND status < 400) OR strlen(coalesce(html, '')) > 10000 THEN 'failed'
                WHEN NOT contains(coalesce(content_type, ''), 'text/html') THEN 'skipped-non-html'
                ELSE 'indexed' END AS outcome,
           CASE WHEN strlen(coalesce(html, '')) > 10000 AND status >= 200 AND status < 400
                THEN 'maxContentLength size of 10000 exceeded'
                WHEN NOT (status >= 200 AND status < 400)
                THEN coalesce(error, 'Request failed with status code ' || CAST(status AS VARCHAR)) END AS error FROM fl),
latest AS (SELECT domain, CASE length(domain) % 3 WHEN 0 THEN {t0} WHEN 1 THEN {t1} ELSE {t2} END AS rules_text,
                  {as_of} - to_hours(CAST(length(domain) % 48 AS INTEGER)) AS fetched_at
           FROM (SELECT DISTINCT domain FROM cp)),
robots AS (SELECT * FROM latest UNION ALL
           SELECT domain, 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10), fetched_at - INTERVAL 3 DAYS FROM latest),
{_permission_ctes()}"""


def links_ctes() -> str:
    return f"""lk0 AS (SELECT url AS src_url, depth, unnest(links) AS href, unnest(range(len(links))) AS pos
        FROM (SELECT cp.url, cp.links, queue.depth FROM cp JOIN queue ON cp.url = queue.url) WHERE depth < 4),
{url_ctes('lk0', 'href', 'src_url', 'url', 'lk1')},
lk2 AS (SELECT src_url, depth, pos, url, regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS domain
        FROM lk1 WHERE url IS NOT NULL),
lk3 AS (SELECT src_url, url, min(pos) AS pos, min(depth) AS depth, min(domain) AS domain FROM lk2
        WHERE domain IS NOT NULL AND length(domain) > 0 GROUP BY src_url, url)"""


def enqueue_new_sql() -> str:
    return f"""WITH {base_ctes()}, {links_ctes()}
SELECT url, min(domain) AS domain, CAST(min(depth) + 1 AS INTEGER) AS depth, 'pending' AS status,
       {_ts(K.AS_OF)} AS discovered_at
FROM lk3 WHERE url NOT IN (SELECT url FROM queue) GROUP BY url"""


def fetch_list_sql() -> str:
    return f"""WITH {base_ctes()},
el AS (SELECT q.* FROM queue q LEFT JOIN ds d ON q.domain = d.domain
       WHERE q.status = 'pending' AND NOT coalesce(d.disallowed, false) AND coalesce(d.pages_crawled, 0) < 200
         AND (d.last_fetched_at IS NULL
              OR d.last_fetched_at < {_ts(K.AS_OF)} - to_milliseconds(coalesce(d.crawl_delay_ms, 1000)))),
one AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY discovered_at, id) AS rn
                                    FROM el) WHERE rn = 1)
SELECT * FROM one ORDER BY discovered_at, id LIMIT 50"""


def fetch_schedule_sql() -> str:
    """Turns are counted per domain; a turn is the delay and a millisecond after the one before."""
    as_of = _ts(K.AS_OF)
    return f"""WITH {base_ctes()},
turns AS (SELECT q.*, coalesce(d.pages_crawled, 0) AS crawled, d.last_fetched_at AS fetched, coalesce(d.crawl_delay_ms, 1000) + 1 AS step,
                 row_number() OVER (PARTITION BY q.domain ORDER BY q.discovered_at, q.id) - 1 AS turn
          FROM queue q LEFT JOIN ds d ON q.domain = d.domain WHERE q.status = 'pending' AND NOT coalesce(d.disallowed, false)),
slots AS (SELECT *, greatest({as_of}, coalesce(fetched + to_milliseconds(step), {as_of})) + to_milliseconds(turn * step) AS fetch_at FROM turns)
SELECT id, url, domain, depth, status, discovered_at, processed_at, error, fetch_at FROM slots
WHERE fetch_at < {as_of} + INTERVAL 5 SECONDS AND crawled + turn < 200
ORDER BY fetch_at, discovered_at, id LIMIT (SELECT greatest(1, count(*) // 5) FROM cp)"""


def fetch_gate_sql() -> str:
    return f"WITH {base_ctes()}\nSELECT url, outcome, error FROM gate"


def _fold_ctes() -> str:
    as_of = _ts(K.AS_OF)
    return f"""WITH {base_ctes()},
lg AS (SELECT cp.url, cp.page_id, cp.domain, g.outcome AS gated, g.error, w.allowed, w.crawl_delay_ms FROM cp JOIN gate g ON cp.url = g.url
       JOIN allowed w ON w.page_id = cp.page_id AND w.agent = {q(K.AGENTS[0])} WHERE cp.page_id % 5 <> 1),
dec AS (SELECT *, CASE WHEN NOT allowed THEN 'disallowed' WHEN gated = 'failed' THEN 'failed' ELSE 'done' END AS outcome FROM lg),
ol AS (SELECT url, domain, outcome, {as_of} + to_seconds(page_id) AS ts, CAST(NULL AS INTEGER) AS crawl_delay_ms,
              CASE WHEN outcome = 'failed' THEN error END AS error FROM dec
       UNION ALL SELECT url, domain, 'failed', {as_of} + to_seconds(page_id) - INTERVAL 1 MINUTE, NULL, 'socket hang up' FROM dec WHERE page_id % 4 = 0
       UNION ALL SELECT url, domain, 'touch', {as_of} + to_seconds(page_id), CAST(crawl_delay_ms AS INTEGER), NULL FROM dec
                 WHERE crawl_delay_ms IS NOT NULL),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC) AS rn FROM ol
                       WHERE outcome IN ('done', 'failed', 'disallowed')) WHERE rn = 1),
q2 AS (SELECT q.id, q.url, q.domain, q.depth, coalesce(f.outcome, q.status) AS status, q.discovered_at,
              coalesce(f.ts, q.processed_at) AS processed_at,
              CASE WHEN f.outcome = 'failed' THEN f.error ELSE q.error END AS error
       FROM queue q LEFT JOIN fin f ON q.url = f.url),
pd AS (SELECT domain, CAST(count(*) FILTER (WHERE outcome = 'done') AS INTEGER) AS add_pages, max(ts) AS new_fetched,
              arg_max(crawl_delay_ms, CASE WHEN crawl_delay_ms IS NOT NULL THEN ts END) AS new_delay
       FROM ol WHERE outcome IN ('done', 'failed', 'touch') GROUP BY domain),
ds2 AS (SELECT coalesce(d.domain, p.domain) AS domain,
               CAST(coalesce(d.pages_crawled, 0) + coalesce(p.add_pages, 0) AS INTEGER) AS pages_crawled,
               coalesce(p.new_fetched, d.last_fetched_at) AS last_fetched_at,
               CAST(coalesce(p.new_delay, d.crawl_delay_ms, 1000) AS INTEGER) AS crawl_delay_ms,
               coalesce(d.disallowed, false) AS disallowed
        FROM ds d FULL OUTER JOIN pd p ON d.domain = p.domain)"""


def outcome_queue_sql() -> str:
    return _fold_ctes() + "\nSELECT * FROM q2"


def outcome_domains_sql() -> str:
    return _fold_ctes() + "\nSELECT * FROM ds2"


def queue_counts_sql() -> str:
    return _fold_ctes() + "\nSELECT status, count(*) AS n FROM q2 GROUP BY status"


def bfs_depth_sql() -> str:
    """One seed per domain; edges are the links and, from each page n, the pages 2n + 1 and 2n + 2."""
    links = links_ctes().replace("FROM cp JOIN queue ON cp.url = queue.url) WHERE depth < 4", "FROM cp JOIN (SELECT url, 0 AS depth FROM cp) queue ON cp.url = queue.url)")
    return f"""WITH RECURSIVE {base_ctes()},
{links},
edges AS (SELECT src_url, url FROM lk3 UNION
          SELECT a.url, b.url FROM cp a JOIN cp b ON b.page_id IN (2 * a.page_id + 1, 2 * a.page_id + 2)),
bfs(url, depth) AS (SELECT arg_min(url, page_id), 0 FROM cp GROUP BY domain
                    UNION SELECT e.url, b.depth + 1 FROM bfs b JOIN edges e ON e.src_url = b.url WHERE b.depth < 4)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM bfs GROUP BY url"""


def _permission_ctes() -> str:
    """allowed(page_id, agent, allowed, crawl_delay_ms) from the latest text of each domain in ``robots``."""
    return f"""
now AS (SELECT domain, rules_text FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY fetched_at DESC) AS rn FROM robots) WHERE rn = 1),
rl0 AS (SELECT domain, unnest(string_split_regex(coalesce(rules_text, ''), '\\r\\n|\\r|\\n')) AS raw,
               unnest(range(len(string_split_regex(coalesce(rules_text, ''), '\\r\\n|\\r|\\n')))) AS line_no FROM now),
rl1 AS (SELECT domain, line_no, trim(regexp_replace(raw, '#.*$', '')) AS body FROM rl0),
rl2 AS (SELECT domain, line_no, lower(trim(regexp_extract(body, '^([^:]*):', 1))) AS field,
               trim(regexp_extract(body, '^[^:]*:(.*)$', 1)) AS value FROM rl1),
rl3 AS (SELECT * FROM rl2 WHERE field IN ('user-agent', 'allow', 'disallow', 'crawl-delay')),
rl4 AS (SELECT *, CASE WHEN field = 'user-agent' AND (lag(field) OVER w IS NULL OR lag(field) OVER w <> 'user-agent')
                       THEN 1 ELSE 0 END AS st FROM rl3 WINDOW w AS (PARTITION BY domain ORDER BY line_no)),
rl5 AS (SELECT *, sum(st) OVER (PARTITION BY domain ORDER BY line_no) AS group_id FROM rl4),
ag AS (SELECT DISTINCT domain, group_id, trim(lower(split_part(value, '/', 1))) AS agent FROM rl5
       WHERE group_id > 0 AND field = 'user-agent'),
pr AS (SELECT cp.page_id, cp.domain, a.agent, trim(lower(split_part(a.agent, '/', 1))) AS token,
              regexp_extract(cp.url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^#]*)', 1) AS tail
       FROM cp, (VALUES ({q(K.AGENTS[0])}), ({q(K.AGENTS[1])})) a(agent)),
pr2 AS (SELECT page_id, domain, agent, CASE WHEN tail = '' THEN '/' WHEN starts_with(tail, '?') THEN '/' || tail ELSE tail END AS path,
               CASE WHEN EXISTS (SELECT 1 FROM ag WHERE ag.domain = pr.domain AND ag.agent = pr.token) THEN token ELSE '*' END AS chosen
        FROM pr),
ru AS (SELECT r.domain, a.agent AS chosen, r.field, r.value, r.line_no FROM rl5 r JOIN ag a ON r.domain = a.domain AND r.group_id = a.group_id
       WHERE r.field <> 'user-agent' AND r.group_id > 0),
fit AS (SELECT p.page_id, p.agent, max_by(u.field = 'allow', length(u.value) * 2 + CAST(u.field = 'allow' AS INTEGER)) AS won
        FROM pr2 p JOIN ru u ON p.domain = u.domain AND p.chosen = u.chosen
        WHERE u.field IN ('allow', 'disallow') AND u.value <> '' AND regexp_matches(p.path, '^' ||
              regexp_replace(regexp_replace(regexp_replace(u.value, '\\$$', chr(1)), '([^a-zA-Z0-9_*' || chr(1) || '])', '\\\\\\1', 'g'), '\\*', '.*', 'g').replace(chr(1), '$'))
        GROUP BY p.page_id, p.agent),
wait AS (SELECT domain, chosen, arg_max(TRY_CAST(value AS DOUBLE), line_no) AS sec FROM ru WHERE field = 'crawl-delay' GROUP BY domain, chosen),
allowed AS (SELECT p.page_id, p.agent, coalesce(f.won, true) AS allowed, CASE WHEN w.sec > 0 THEN CAST(trunc(w.sec * 1000) AS BIGINT) END AS crawl_delay_ms
            FROM pr2 p LEFT JOIN fit f ON p.page_id = f.page_id AND p.agent = f.agent
            LEFT JOIN wait w ON p.domain = w.domain AND p.chosen = w.chosen)"""


def robots_allowed_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT page_id * 10 + CASE WHEN agent = {q(K.AGENTS[0])} THEN 0 ELSE 1 END AS probe_id, allowed, crawl_delay_ms FROM allowed"""


def robots_stale_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT domain, coalesce(arg_max(rules_text, fetched_at), '') AS rules_text, max(fetched_at) AS fetched_at,
       CASE WHEN max(fetched_at) > {_ts(K.AS_OF)} - INTERVAL 24 HOURS THEN 'fresh' ELSE 'stale' END AS state
FROM robots GROUP BY domain"""


def seed_queue_sql() -> str:
    return f"""WITH {base_ctes()},
sd0 AS (SELECT url AS seed FROM pages),
{url_ctes('sd0', 'seed', 'seed', 'url', 'sd1')},
sd2 AS (SELECT url, regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS domain FROM sd1 WHERE url IS NOT NULL)
SELECT DISTINCT url, domain, CAST(0 AS INTEGER) AS depth, 'pending' AS status, {_ts(K.AS_OF)} AS discovered_at FROM sd2
WHERE length(domain) > 0 AND url NOT IN (SELECT url FROM queue WHERE id % 3 = 0)"""


def blocked_domains_sql() -> str:
    return f"""WITH {base_ctes()}
SELECT domain, pages_crawled, last_fetched_at, crawl_delay_ms,
       disallowed OR domain IN (SELECT domain FROM cp WHERE page_id % 9 = 0) AS disallowed FROM ds"""
