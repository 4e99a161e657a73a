"""Oracle SQL for the search-history scenario over ``events`` and the dictionary cards."""

from __future__ import annotations

from sqloracle import fixed as K
from sqloracle.text import q

HIST = """h AS (SELECT CAST(event_id AS VARCHAR) AS history_id, CAST(user_id AS VARCHAR) AS user_id,
              event_type || ' ' || regexp_extract(props, '"k": ?([0-9]+)', 1) AS query, ts FROM events)"""


def recent_queries_sql() -> str:
    return f"""WITH {HIST},
l AS (SELECT user_id, query, max(ts) AS last_ts FROM h GROUP BY user_id, query),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, query) AS rk FROM l)
SELECT user_id, CAST(rk AS INTEGER) AS rank, query, last_ts FROM r WHERE rk <= 3"""


def suggest_sql() -> str:
    return f"""WITH {HIST},
inp AS (SELECT CAST(user_id AS VARCHAR) AS user_id,
               ' ' || upper(substr(arg_min(event_type, event_id), 1, 3)) || ' ' AS input FROM events GROUP BY user_id),
j AS (SELECT i.user_id, i.input, h.query, max(h.ts) AS last_ts FROM inp i JOIN h ON i.user_id = h.user_id
      WHERE contains(lower(h.query), lower(trim(i.input))) GROUP BY i.user_id, i.input, h.query),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, input ORDER BY last_ts DESC, query) AS rk FROM j)
SELECT user_id, input, CAST(rk AS INTEGER) AS rank, query FROM r WHERE rk <= 3"""


def result_flags_sql() -> str:
    idx = "'idx-' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)"
    return f"""WITH bm AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, {idx} AS id FROM events
                    WHERE event_type = 'purchase'),
sr AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {idx} AS id FROM events)
SELECT sr.event_id, sr.user_id, sr.id, (bm.user_id IS NOT NULL) AS bookmarked
FROM sr LEFT JOIN bm ON sr.user_id = bm.user_id AND sr.id = bm.id"""


def restore_user_sql() -> str:
    """Users whose id ends in 0 take the rows of the next user, a week older."""
    return f"""WITH {HIST},
users AS (SELECT DISTINCT user_id, CAST(CAST(user_id AS BIGINT) + 1 AS VARCHAR) AS source_user FROM h WHERE suffix(user_id, '0'))
SELECT history_id, user_id, query, ts FROM h WHERE user_id NOT IN (SELECT user_id FROM users)
UNION ALL
SELECT 'r' || h.history_id, u.user_id, h.query, h.ts - INTERVAL 7 DAYS FROM h JOIN users u ON h.user_id = u.source_user"""


def history_edit_sql() -> str:
    """Purchases are appended to the other searches; then every seventh event's row is deleted."""
    return f"""WITH {HIST}
SELECT history_id, user_id, query, ts FROM h WHERE CAST(history_id AS BIGINT) % 7 <> 0"""


def cards_cte() -> str:
    values = ", ".join(f"({q(w)}, {q(j)})" for w, j in sorted(K.DICTIONARY.items()))
    j = "entry_json"
    return f"""dict AS (SELECT * FROM (VALUES {values}) t(word, entry_json)),
c0 AS (SELECT word, json_extract_string({j}, '$[0].word') AS entry_word,
              json_extract_string({j}, '$[0].meanings[0].definitions[0].definition') AS definition,
              coalesce(json_extract_string({j}, '$[0].meanings[0].partOfSpeech'), '') AS pos,
              coalesce(nullif(json_extract_string({j}, '$[0].phonetic'), ''),
                       list_filter(json_extract_string({j}, '$[0].phonetics[*].text'),
                                   lambda t: coalesce(length(t), 0) > 0)[1], '') AS phonetic FROM dict),
cards AS (SELECT word, 'dict-' || word AS id, {q(K.CARD_URL)} || url_encode(word) AS url,
                 entry_word || ' (' || pos || ') - Definition & Meaning' AS title,
                 'Definition: ' || definition || CASE WHEN length(phonetic) > 0 THEN ' Pronunciation: ' || phonetic
                                                      ELSE '' END AS snippet,
                 CAST({K.CARD_SCORE} AS DOUBLE) AS score
          FROM c0 WHERE definition IS NOT NULL AND length(definition) > 0)"""


def dict_cards_sql() -> str:
    return f"""WITH {cards_cte()}
SELECT e.event_id AS query_id, 0 AS rank, c.id, c.url, c.title, c.snippet, c.score
FROM events e JOIN cards c ON lower(trim(e.event_type)) = c.word WHERE regexp_matches(trim(e.event_type), '^[a-zA-Z]+$')"""


def backup_restore_sql() -> str:
    """Users whose id ends in 0 take over all that the next user has."""
    return f"""WITH {HIST},
settings AS (SELECT CAST(user_id AS VARCHAR) AS user_id, max(event_type) || '|' || count(*) AS item FROM events GROUP BY user_id),
marks AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, 'idx-' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS item
          FROM events WHERE event_type = 'purchase'),
shortcuts AS (SELECT CAST(user_id AS VARCHAR) AS user_id, 's' || event_id || '|https://short.test/' || CAST(floor(value) AS BIGINT) AS item
              FROM events WHERE event_type = 'signup'),
had AS (SELECT 'settings' AS kind, * FROM settings UNION ALL SELECT 'history', user_id, history_id || '|' || query FROM h
        UNION ALL SELECT 'bookmarks', * FROM marks UNION ALL SELECT 'shortcuts', * FROM shortcuts),
users AS (SELECT user_id, CAST(CAST(user_id AS BIGINT) + 1 AS VARCHAR) AS source_user FROM settings WHERE suffix(user_id, '0'))
SELECT kind, user_id, item FROM had WHERE user_id NOT IN (SELECT user_id FROM users)
UNION ALL SELECT kind, u.user_id, item FROM had JOIN users u ON had.user_id = u.source_user"""


def history_log_sql() -> str:
    return f"WITH {HIST}\nSELECT history_id, user_id, query, ts FROM h"


def word_cards_sql() -> str:
    return f"""WITH w AS (SELECT item_id, text, lower(regexp_extract(text, '[A-Za-z]+')) AS word FROM benchmark WHERE regexp_matches(text, '[A-Za-z]')),
e AS (SELECT word, arg_min(text, item_id) AS text, min(item_id) AS item_id FROM w GROUP BY word),
asked AS (SELECT doc_id, lower(regexp_extract(text, '[A-Za-z]+')) AS word FROM documents)
SELECT doc_id AS query_id, 0 AS rank, 'dict-' || word AS id, {q(K.CARD_URL)} || word AS url, word || ' (noun) - Definition & Meaning' AS title,
       'Definition: ' || substr(text, 1, 60) || ' Pronunciation: ' || CASE WHEN item_id % 2 = 0 THEN '/' || word || '/' ELSE '~' || word END AS snippet,
       CAST({K.CARD_SCORE} AS DOUBLE) AS score
FROM asked JOIN e USING (word)"""
