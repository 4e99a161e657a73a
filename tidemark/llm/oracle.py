"""DuckDB statements for the registered queries of this package that SQL can express."""

from __future__ import annotations

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS kept
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM d
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source
), w AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM w
), level AS (
  SELECT share FROM l WHERE NOT (cap <= share * weight) ORDER BY cap / weight, pos LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN cap <= share * weight THEN cap ELSE (SELECT share FROM level) * weight END AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0::DOUBLE END AS ratio FROM t
), p AS (
  SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS chance, target - floor(ratio) * source_size AS missing FROM r
), u AS (
  SELECT d.doc_id, d.size, p.*,
    (('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS draw
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), k AS (
  SELECT *, (draw / (1 - draw)) / (chance / (1 - chance)) AS rank_value FROM u WHERE chance > 0
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank_value, doc_id NULLS LAST, size) - size / 2.0::DOUBLE AS middle FROM k
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN middle <= missing THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
UNION ALL
SELECT doc_id, size, source_size, target, (size * whole)::BIGINT AS taken FROM u WHERE NOT chance > 0
"""

OP3 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?OUT\]|/ROLE\]|ROLE=)', '\1\\\2\3', 'g')) AS escaped_chars,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 11 ELSE 14 + length(role) END AS mark_chars
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(escaped_chars + mark_chars))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, (count(*) OVER same)::BIGINT AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW same AS (PARTITION BY norm)
"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_ASCII_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH RECURSIVE t AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM t WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS v FROM t WHERE k = 8
), d AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format('text')}, {_WORD}) AS words FROM documents
), b AS (
  SELECT regexp_extract_all({_ASCII_LOWER.format('text')}, {_WORD}) AS words FROM benchmark
), dw AS (
  SELECT doc_id, word, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY doc_id, word
), bw AS (
  SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY word
), vocabulary AS (
  SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(digits) // 2 + 1), lambda i: ('0x' || substr(digits, 2 * i - 1, 2))::BIGINT)),
    lambda c, x: xor(tab.v[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM vocabulary, tab
), s AS (
  SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN hashed USING (word) GROUP BY bucket
), tt AS (
  SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN hashed USING (word) GROUP BY bucket
), total AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM tt)::DOUBLE AS t_all
), gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN tt ON s.bucket = tt.bucket CROSS JOIN total
), weighed AS (
  SELECT doc_id, sum(n * gain)::DOUBLE AS gains FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE floor(coalesce(gains, 0) / len(words))::BIGINT END AS weight,
    ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN weighed ON d.doc_id = weighed.doc_id
), final AS (
  SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS number FROM final
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND number <= (SELECT floor(10 * count(*) / 100.0) FROM final WHERE n_features >= 20) THEN number END::BIGINT AS rank
FROM ranked
"""

_TEMPLATES = """
  SELECT * FROM (VALUES
    (0, 'gpl', true, 'gnu general public license'),
    (1, 'apache', true, 'apache license'),
    (2, 'cc-by', true, 'cc by'),
    (3, 'mit', true, 'mit license'),
    (4, 'mit', false, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction'),
    (5, 'apache', false, 'licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license'),
    (6, 'gpl', false, 'you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version'),
    (7, 'lgpl', false, 'under the terms of the gnu lesser general public license as published by the free software foundation'),
    (8, 'bsd', false, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
    (9, 'mpl', false, 'this source code form is subject to the terms of the mozilla public license v 2 0'),
    (10, 'cc-by', false, 'this work is licensed under a creative commons attribution 4 0 international license'),
    (11, 'cc-by-nc', false, 'licensed under cc by nc 4 0'),
    (12, 'cc-by-nc', false, 'this work is licensed under a creative commons attribution noncommercial 4 0 international license')
  ) v(template, label, phrase, body)
"""

OP13 = f"""
WITH tw AS (
  SELECT template, label, phrase, string_split(body, ' ') AS words FROM ({_TEMPLATES})
), tg AS (
  SELECT template, label, phrase, (len(words) - 1)::BIGINT AS n_grams, i - 1 AS tpos, words[i] || ' ' || words[i + 1] AS gram
  FROM (SELECT *, unnest(range(1, len(words))) AS i FROM tw)
), d AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all({_ASCII_LOWER.format('text')}, {_WORD}) AS words FROM documents
), dg AS (
  SELECT place, i - 1 AS pos, words[i] || ' ' || words[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(words))) AS i FROM d)
), hits AS (
  SELECT place, template, label, phrase, n_grams, pos, tpos, pos - tpos AS diagonal FROM dg JOIN tg USING (gram)
), votes AS (
  SELECT place, template, label, phrase, n_grams, diagonal, count(*) AS votes, min(pos) AS first FROM hits GROUP BY ALL
), steps AS (
  SELECT *, diagonal - lag(diagonal) OVER w > 4 AS new FROM votes WHERE NOT phrase WINDOW w AS (PARTITION BY place, template ORDER BY diagonal)
), spanned AS (
  SELECT *, count(*) FILTER (new) OVER (PARTITION BY place, template ORDER BY diagonal) AS span FROM steps
), spans AS (
  SELECT place, template, span, min(diagonal) AS low, max(diagonal) AS high FROM spanned GROUP BY place, template, span
), found AS (
  SELECT h.place, h.label, h.phrase, h.n_grams, count(DISTINCT tpos) AS held
  FROM hits h JOIN spans s ON h.place = s.place AND h.template = s.template AND h.diagonal BETWEEN s.low AND s.high
  GROUP BY h.place, h.template, s.span, h.label, h.phrase, h.n_grams
), verified AS (
  SELECT place, label, phrase, NULL::BIGINT AS first, held / n_grams AS share FROM found
  WHERE held >= CASE WHEN n_grams < 20 THEN n_grams ELSE 0.8::DOUBLE * n_grams END
  UNION ALL SELECT place, label, phrase, first, 1.0 AS share FROM votes WHERE phrase AND votes = n_grams
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, count(first)::BIGINT AS n_base, min(first)::BIGINT AS first_word, max(first)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM d LEFT JOIN verified v ON d.place = v.place
GROUP BY d.place, d.doc_id, len(d.words)
"""

ORACLE: dict[str, str] = {
    "op1_warc": OP1,
    "op2_pareto_mixing": OP2,
    "op3_chat_round_trip": OP3,
    "op6_content_sort": OP6,
    "op11_batch_concatenation": OP11,
    "op13_diagonal_voting": OP13,
}
