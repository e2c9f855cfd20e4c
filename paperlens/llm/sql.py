"""SQL for the registered queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {}

# Of equal payloads of 1000 bytes or more, the largest page_id is the response.
ORACLES["op9_warc"] = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS first FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM firsts
"""


def _licenses() -> str:
    """All windows against all templates by containment, without MinHash."""
    from paperlens.llm.licenses import SPAN, TEMPLATES

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    rows = ", ".join(f"({at}, {quoted(name)}, {quoted(text)})" for at, (name, text) in enumerate(TEMPLATES))
    words = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
    shingles = (
        "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) "
        "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    )
    return f"""
WITH templates AS (
    SELECT number, name, list_distinct({shingles}) AS wanted FROM (
        SELECT number, name, {words.format('wording')} AS w FROM (VALUES {rows}) AS t(number, name, wording))
), texts AS (
    SELECT doc_id, {shingles} AS own FROM (SELECT doc_id, {words.format('text')} AS w FROM documents)
), windows AS (
    SELECT doc_id, name, wanted, own, unnest(range(0, len(own), len(wanted))) AS first
    FROM texts JOIN templates ON list_has_any(own, wanted)
), parts AS (
    SELECT doc_id, name, wanted, first, own[first + 1:first + {SPAN} * len(wanted)] AS part FROM windows
), places AS (
    SELECT doc_id, name, first, list_filter(
        list_transform(range(len(part)), lambda i: CASE WHEN list_contains(wanted, part[i + 1]) THEN i END),
        lambda i: i IS NOT NULL) AS hits
    FROM parts WHERE len(list_intersect(list_distinct(part), wanted)) >= 0.8 * len(wanted)
), spans AS (
    SELECT DISTINCT doc_id, name, first + list_min(hits) AS low, first + list_max(hits) + 5 AS high FROM places
), widest AS (
    SELECT * FROM spans a WHERE NOT EXISTS (
        SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.name = a.name AND b.low <= a.low AND b.high >= a.high
        AND b.high - b.low > a.high - a.low)
), found AS (
    SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names,
           array_to_string(list_sort(list(name || ':' || low || ':' || high)), ',') AS spots
    FROM widest GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(names, '') AS licenses, coalesce(spots, '') AS places
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
"""


ORACLES["op7_licenses"] = _licenses()

# Windows met by a join of strings; runs of windows in a row of one item give the longest match.
ORACLES["op4_decontaminate"] = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
    SELECT item, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0
), item_windows AS (
    SELECT item, size, place, array_to_string(w[place + 1:place + size], ' ') AS words
    FROM (SELECT item, w, size, unnest(range(len(w) - size + 1)) AS place FROM sized)
), text_windows AS (
    SELECT doc_id, size, place, array_to_string(w[place + 1:place + size], ' ') AS words
    FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS place
          FROM texts JOIN (SELECT DISTINCT size FROM sized) ON len(w) >= size)
), met AS (
    SELECT t.doc_id, i.item, t.size, t.place, t.place - i.place AS line
    FROM text_windows t JOIN item_windows i ON i.words = t.words AND i.size = t.size
), runs AS (
    SELECT doc_id, max(n + size - 1) AS longest FROM (
        SELECT doc_id, item, line, size, count(*) AS n FROM (
            SELECT *, place - row_number() OVER (PARTITION BY doc_id, item, line ORDER BY place) AS run FROM met)
        GROUP BY doc_id, item, line, size, run) GROUP BY doc_id
), hits AS (
    SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, place + unnest(range(size)) AS word FROM met) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM met GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, h.n IS NOT NULL AS contaminated, CAST(coalesce(longest, 0) AS INTEGER) AS longest_match
FROM texts t LEFT JOIN hits h ON h.doc_id = t.doc_id LEFT JOIN named n ON n.doc_id = t.doc_id LEFT JOIN runs r ON r.doc_id = t.doc_id
"""

ORACLES["op11_exactdup"] = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
classes AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.body) AS text_sha256
FROM texts t JOIN classes c ON c.body = t.body
"""


def _clusters(centroids: int = 40, rounds: int = 5, dimension: int = 64) -> str:
    """Every vector against every centroid, a table for each round."""
    places = f"range(1, {dimension + 1})"
    parts = [f"""
kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension}
), c0 AS MATERIALIZED (
    SELECT n - 1 AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) AS n FROM kept)
    WHERE n <= {centroids}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
    SELECT vec_id, v, c, d FROM (
        SELECT vec_id, v, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS n FROM (
            SELECT k.vec_id, k.v, c.c,
                   list_sum(list_transform({places}, lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS d
            FROM kept k CROSS JOIN c{r} c))
    WHERE n = 1
)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (
    SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY p) AS v FROM (
        SELECT c, p, sum(x) AS s, count(*) AS n FROM (
            SELECT c, unnest({places}) AS p, unnest(v) AS x FROM a{r}) GROUP BY c, p)
    GROUP BY c
), c{r + 1} AS MATERIALIZED (
    SELECT c.c, coalesce(s.v, c.v) AS v FROM c{r} c LEFT JOIN s{r} s ON s.c = c.c
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


ORACLES["op12_orchard"] = _clusters()

# Masks of failed filters counted by part and label; every order is judged on the counts.
ORACLES["op13_filteraudit"] = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
    SELECT doc_id, part,
           CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS failed
    FROM texts
), flags AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM judged j LEFT JOIN flags f ON f.doc_id = j.doc_id GROUP BY part, failed
), letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS INTEGER) AS used
    FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)
), met AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (failed & used = 0), 0) AS kept,
           coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & (used - bit) = 0), 0) AS removed,
           coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & (used - bit) <> 0), 0) AS redundant,
           coalesce(sum(n) FILTER (failed = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (failed & bit <> 0 AND failed & (used - bit) = 0), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (failed & bit <> 0 AND failed & (used - bit) = 0), 0) AS toxic_lost
    FROM counts CROSS JOIN steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM met
"""
