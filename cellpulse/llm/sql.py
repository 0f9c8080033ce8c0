"""DuckDB SQL for operators that read pages, vectors and n-grams."""

from __future__ import annotations

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# The pages at hand mark their main text by one `article` and know two references in it.
MAIN_TEXT = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(
           regexp_split_to_array(body, '</?(?:h1|p)>'),
           lambda b: trim(regexp_replace(
             regexp_replace(
               regexp_replace(regexp_replace(b, '</?[a-z][^>]*>', ' ', 'g'), '&quot;?', '"', 'g'),
               '&amp;?', '&', 'g'),
             '\s+', ' ', 'g'))) AS texts
  FROM articles),
joined AS (
  SELECT page_id, url,
         array_to_string(list_filter(texts, lambda b: b <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM joined"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd rounds one after the other, each a pair of common table expressions."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT p.row, p.part, p.x,
         first(struct_pack(entry := b.entry, d := list_sum(list_transform(list_zip(p.x, b.x),
           lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT)
           ORDER BY list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry) AS best
  FROM parts p JOIN book{r} b USING (part) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT part, entry, list(m ORDER BY i) AS x FROM (
    SELECT part, best.entry AS entry, i, CAST(floor_div(sum(x[i]), count(*)) AS BIGINT) AS m
    FROM near{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY ALL)
  GROUP BY part, entry),
book{r + 1} AS (
  SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM book{r} b LEFT JOIN sums{r} s USING (part, entry))""")
    last = ",".join(steps).replace("floor_div(sum(x[i]), count(*))", "floor(sum(x[i])::DOUBLE / count(*))")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, vec_id, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x
  FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS (SELECT part, row - 1 AS entry, x FROM parts WHERE row <= {entries}),{last},
coded AS (
  SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY row),
digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM book{rounds})
SELECT k.vec_id, c.code, c.error,
       CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept k JOIN coded c USING (row), digest"""


def resampling(
    buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10
) -> str:
    """Single words as features; the checksum of each distinct word is folded byte by byte."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE steps(b, c, n) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL SELECT b, {bit}, n + 1 FROM steps WHERE n < 8),
crcs AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8),
texts AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row, 0 AS side,
         regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
  UNION ALL
  SELECT NULL, row_number() OVER (), 1,
         regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')
  FROM benchmark),
counted AS MATERIALIZED (
  SELECT side, row, word, count(*) AS n FROM (SELECT side, row, unnest(words) AS word FROM texts) GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT word, xor(4294967295, list_reduce(
           list_transform(range(1, 1 + length(hex(encode(word))) // 2),
                          lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) % {buckets} AS bucket
  FROM (SELECT DISTINCT word FROM counted), crcs),
per_bucket AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t
  FROM counted JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + {buckets})::DOUBLE)
                 / ((s + 1)::DOUBLE * (sum(t) OVER () + {buckets})::DOUBLE))) AS BIGINT) AS gain
  FROM per_bucket),
weights AS (
  SELECT row, sum(n) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT d.doc_id, d.row, len(d.words) AS n_words, CAST(coalesce(w.n_features, 0) AS BIGINT) AS n_features,
         coalesce(w.weight, 0) AS weight,
         coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('{seed}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8) AS BIGINT)::DOUBLE + 0.5)
           / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts d LEFT JOIN weights w USING (row) WHERE d.side = 0),
placed AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id, row) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= {least_words})
SELECT s.doc_id, s.n_features, s.weight, s.score,
       CASE WHEN p.rank <= {percent} * p.n // 100 THEN p.rank END AS rank
FROM scored s LEFT JOIN placed p USING (row)"""
