"""The queries of this package in SQL, where SQL can express them."""

from __future__ import annotations

from frostgrid.llm.mixing import BLOCK_WORDS, CELLS, DRAWS, MODULUS, MULTIPLIER, ROUNDS, SHARD_SLOTS

ORACLE_SQL: dict[str, str] = {}


def _rounds() -> str:
    """One subquery for each round of the permutation of blocks."""
    steps = ["p0 AS (SELECT rank, blocks, shard, slot % blocks AS x FROM slots)"]
    for r in range(ROUNDS):
        turn = f"({7919 * (r + 1) ** 2} * (rank + 1) + {104729 * r}) % blocks"
        steps.append(
            f"p{r + 1} AS (SELECT rank, blocks, shard, "
            f"CASE WHEN ((greatest(x, y) * {MULTIPLIER} + {15485863 * (r + 1)}) >> 13) % 2 = 1 THEN y ELSE x END AS x "
            f"FROM (SELECT rank, blocks, shard, x, ((({turn}) - x) % blocks + blocks) % blocks AS y FROM p{r}))"
        )
    return ",\n".join(steps)


def _draws() -> str:
    """One subquery for each step of the numbers that shards are drawn by."""
    steps = [
        f"d0 AS (SELECT rank, blocks, i, shards, (i + (rank + 1) * {MULTIPLIER}) % {MODULUS} AS x "
        "FROM (SELECT rank, blocks, shards, unnest(range(slots)) AS i FROM counted, sharded))"
    ]
    for n, (factor, term) in enumerate(DRAWS):
        steps.append(
            f"d{n + 1} AS (SELECT rank, blocks, i, shards, xor(x, x >> 15) AS x "
            f"FROM (SELECT * REPLACE ((x * {factor} + {term}) % {MODULUS} AS x) FROM d{n}))"
        )
    return ",\n".join(steps)


ORACLE_SQL["op8_mix_sources"] = f"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS rank FROM sizes
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap,
         (SELECT sum(size) FROM sized)::DOUBLE * 1.5::DOUBLE AS whole
  FROM ranked
), levels AS (
  SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), sources AS (
  SELECT source, source_size, rank,
         CASE WHEN cap / weight <= level THEN cap
              ELSE weight * (SELECT arg_min(level, (cap / weight, rank)) FROM levels WHERE cap / weight > level)
         END AS target
  FROM levels
), counted AS (
  SELECT rank, blocks,
         least(passes * blocks + round((target - passes * source_size) / {BLOCK_WORDS})::BIGINT, 2 * blocks) AS slots
  FROM (SELECT *, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks,
               floor(target / source_size)::BIGINT AS passes
        FROM sources WHERE source_size > 0)
), sharded AS (
  SELECT greatest(ceil(sum(slots) / {SHARD_SLOTS}), 1)::BIGINT AS shards FROM counted
),
{_draws()},
slots AS (
  SELECT rank, blocks, shard, row_number() OVER (PARTITION BY rank ORDER BY shard, i) - 1 AS slot
  FROM (SELECT *, (x >> 3) % shards AS shard FROM d{len(DRAWS)})
),
{_rounds()},
times AS (
  SELECT rank, x AS block, shard, count(*) AS times FROM p{ROUNDS} GROUP BY ALL
), laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank, row_number() OVER () AS id,
         coalesce(sum(s.size) OVER (PARTITION BY s.source
                  ORDER BY coalesce(s.doc_id, 0) % {CELLS}, s.doc_id NULLS FIRST, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source
), pieces AS (
  SELECT id, rank, start, size, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS pos
  FROM laid WHERE size > 0
), per_shard AS (
  SELECT id, shard,
         sum((least(start + size, (pos + 1) * {BLOCK_WORDS}) - greatest(start, pos * {BLOCK_WORDS})) * times)::BIGINT AS words
  FROM pieces p JOIN times t ON p.rank = t.rank AND p.pos = t.block GROUP BY id, shard
), taken AS (
  SELECT id, sum(words)::BIGINT AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS shards
  FROM per_shard GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(shards, '') AS shards
FROM laid LEFT JOIN taken USING (id)
"""

_HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1)"
_URL = r"regexp_replace(url, '#.*$', '')"

ORACLE_SQL["op2_url_filters"] = f"""
WITH captures AS (
  SELECT page_id, url, {_HOST} AS host, {_URL} AS whole, DATE '2024-01-01' + (page_id % 60)::INTEGER AS day FROM pages
), hosts AS (
  SELECT host, min(page_id) AS n FROM captures GROUP BY host
), domains AS (
  SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain, min(n) AS n FROM hosts GROUP BY ALL
), entries AS (
  SELECT 'spam' AS list, false AS allow, host AS key, n % 50 AS day, true AS listed FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT 'spam', false, host, n % 50 + 10, false FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT 'spam', false, host, n % 50 + 20, true FROM hosts WHERE n % 6 = 0
  UNION ALL SELECT 'adult', false, domain, n % 30, true FROM domains WHERE n % 4 = 1
  UNION ALL SELECT 'trusted', true, host, 5, true FROM hosts WHERE n % 11 = 0
  UNION ALL SELECT 'trusted', true, host, 40, false FROM hosts WHERE n % 11 = 0
  UNION ALL SELECT 'phishing', false, whole, page_id % 60, true FROM captures WHERE page_id % 13 = 0
  UNION ALL SELECT 'phishing', false, whole, page_id % 60 + 1, false FROM captures WHERE page_id % 26 = 0
  UNION ALL SELECT 'stale', false, whole, page_id % 60 + 1, true FROM captures WHERE page_id % 17 = 0
), daily AS (
  SELECT list, allow, key, DATE '2024-01-01' + day::INTEGER AS day, bool_and(listed) AS listed FROM entries GROUP BY ALL
), spans AS (
  SELECT *, lead(day) OVER (PARTITION BY list, allow, key ORDER BY day) AS until FROM daily
), found AS (
  SELECT DISTINCT page_id, list, allow
  FROM captures c JOIN spans s
    ON listed AND c.day >= s.day AND (until IS NULL OR c.day < until)
   AND (s.key = c.whole OR s.key = c.host OR ends_with(c.host, '.' || s.key))
), named AS (
  SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists, NOT bool_or(allow) AS blocked FROM found GROUP BY page_id
)
SELECT page_id, host, coalesce(lists, '') AS lists, coalesce(blocked, false) AS blocked
FROM captures LEFT JOIN named USING (page_id)
"""

ORACLE_SQL["op5_warc_revisits"] = f"""
WITH base AS (
  SELECT page_id AS n, {_URL} AS url, md5(html) AS digest FROM pages
), responses AS (
  SELECT n * 2 AS record_id, url, digest, n * 37 % 500 AS hour, substr(digest, 1, 8) AS tag FROM base WHERE n % 10 <> 9
), revisits AS (
  SELECT n * 2 + 1 AS record_id, url, n * 37 % 500 + n % 5 - 1 AS hour, 'max-age=' || n AS cache,
         CASE WHEN n % 7 = 0 THEN 'other' ELSE 'W/' || substr(digest, 1, 8) END AS tag
  FROM base
), found AS (
  SELECT v.record_id, v.url, v.tag, v.cache,
         arg_max(r.record_id, (r.hour, r.record_id)) AS refers_to, arg_max(r.tag, (r.hour, r.record_id)) AS of_tag,
         arg_max(r.digest, (r.hour, r.record_id)) AS digest
  FROM revisits v LEFT JOIN responses r ON r.url = v.url AND r.hour < v.hour
  GROUP BY v.record_id, v.url, v.tag, v.cache
), judged AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'no response'
                 WHEN regexp_replace(tag, '^W/', '') <> of_tag THEN 'mismatch' ELSE 'resolved' END AS outcome
  FROM found
)
SELECT record_id, url, outcome, refers_to, CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest,
       tag AS etag, CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE 'text/plain' END AS content_type,
       cache AS cache_control
FROM judged
"""

ORACLE_SQL["op1_suffix_array_dedup"] = """
WITH docs AS (
  SELECT doc_id, encode(coalesce(text, '')) AS data, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), places AS (
  SELECT doc_id, unnest(range(n - 49)) AS i FROM docs WHERE n >= 50
), strings AS (
  SELECT doc_id, i, data[i + 1 : i + 50] AS string FROM places JOIN docs USING (doc_id)
), firsts AS (
  SELECT string, min(doc_id) AS first_id FROM strings GROUP BY string HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT doc_id, i FROM strings JOIN firsts USING (string) WHERE first_id < doc_id
), marked AS (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM gone
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span
), ends AS (
  SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM docs
), pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM ends
)
SELECT doc_id, any_value(n) AS n_bytes, sum(b - a)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
       sha256(unhex(string_agg(hex(data[since + 1 : a]), '' ORDER BY a, b))) AS kept_sha256
FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
"""

ORACLE_SQL["op9_maxscore_top_k"] = """
WITH parts AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), vectors AS (
  SELECT vec_id, list(floor(64 * x) ORDER BY d) AS v FROM parts GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""

ORACLE_SQL["op11_hard_negatives"] = """
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
), vectors AS (
  SELECT vec_id, label, list(floor(256 * x) ORDER BY d) AS v FROM parts
  GROUP BY vec_id, label HAVING bool_and(x IS NOT NULL AND isfinite(x))
), scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM vectors a JOIN vectors c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

_BLANKS = r"\x20\x09-\x0D"

ORACLE_SQL["op13_conversation_repair"] = f"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS crcs
  FROM (SELECT unnest(range(256))::BIGINT AS n)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                        lambda c: ord(c)::BIGINT) AS key
  FROM conversations
), chosen AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, key), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])),
                4294967295) % 20 AS fault
  FROM keyed, bytes
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
  FROM chosen
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         regexp_extract(text, '([^{_BLANKS}])[{_BLANKS}]*$', 1) AS ending,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed
), judged AS (
  SELECT conv_id, turn, role, text, pos, ending = '' AS blank, ending <> '' AND again AS duplicate,
         ending NOT IN ('', '.', '!', '?') AND NOT again AS truncated,
         before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen
), inserted(a, b, n, roles) AS (
  VALUES (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']),
         (1, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']),
         (1, 3, 2, ['user:', 'assistant:'])
), edits(letter, price, a, b, initial, name) AS (
  VALUES ('D', 2, 0, 0, '', ''), ('D', 2, 1, 1, '', ''), ('D', 2, 2, 2, '', ''), ('D', 2, 3, 3, '', ''),
         ('K', 0, 0, 1, 's', ''), ('K', 0, 0, 2, 'u', ''), ('K', 0, 1, 2, 'u', ''), ('K', 0, 2, 3, 'a', ''),
         ('K', 0, 3, 2, 'u', ''), ('R', 1, 0, 2, '', 'user'), ('R', 1, 1, 2, '', 'user'), ('R', 1, 2, 3, '', 'assistant'),
         ('R', 1, 3, 2, '', 'user')
), walk(conv_id, pos, state, best) AS (
  SELECT conv_id, 0::BIGINT, b, struct_pack(cost := 5 * n::BIGINT, audit := repeat('I', n), lines := roles)
  FROM (SELECT DISTINCT conv_id FROM judged), inserted WHERE a = 0
  UNION ALL
  SELECT w.conv_id, j.pos, i.b, min(struct_pack(
           cost := w.best.cost + e.price + 5 * i.n + CASE WHEN e.letter <> 'D' AND j.truncated THEN 5 ELSE 0 END,
           audit := w.best.audit || e.letter || repeat('I', i.n),
           lines := list_concat(w.best.lines, CASE e.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [j.role || ':' || j.text]
                                              ELSE [e.name || ':' || j.text] END, i.roles)))
  FROM walk w
  JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1
  JOIN edits e ON e.a = w.state AND (e.letter = 'D' OR NOT (j.blank OR j.duplicate)) AND (e.letter <> 'K' OR e.initial = j.role[1])
  JOIN inserted i ON i.a = e.b
  GROUP BY w.conv_id, j.pos, i.b
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count_if(blank)::BIGINT AS blank, count_if(duplicate)::BIGINT AS duplicate, count_if(truncated)::BIGINT AS truncated,
         count_if(illegal)::BIGINT AS illegal, max(pos) AS rows
  FROM judged GROUP BY conv_id
), repaired AS (
  SELECT t.*, min(w.best) AS best
  FROM totals t JOIN walk w ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.pos = t.rows AND w.state IN (0, 3) GROUP BY ALL
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
