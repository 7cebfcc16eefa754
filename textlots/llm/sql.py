"""SQL counterparts that are built from parameters."""

from __future__ import annotations

from textlots.llm import divergence, licenses, vector_codes

LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def vector_codes_sql(
    parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS
) -> str:
    """Every part against every entry, in as many rounds as the operator takes."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (
  SELECT rid, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x
  FROM kept, unnest(range({parts})) AS t(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM points WHERE rid <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT rid, points.p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM points JOIN book{k} USING (p))
  GROUP BY rid, p)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(moved, c) AS c FROM book{k} LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS moved FROM (
      SELECT p, e, i, sum(x[i]) AS s, count(*) AS n
      FROM points JOIN near{k} USING (rid, p), unnest(range(1, len(x) + 1)) AS t(i) GROUP BY p, e, i)
    GROUP BY p, e) USING (p, e))""")
    return ",".join(steps) + f""",
coded AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY rid),
digest AS (SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), digest
"""


def license_sql(passages: tuple[licenses.Passage, ...] = licenses.PASSAGES) -> str:
    """Every passage at every word of every text."""

    def words(found: list[str]) -> str:
        return "[" + ", ".join(f"'{word}'" for word in found) + "]"

    listed = ",\n    ".join(
        f"({n}, '{p.label}', {p.base}, {words(p.words)}, [{', '.join(str(place) for place, _ in p.required())}])"
        for n, p in enumerate(passages)
    )
    return rf"""
WITH passages(n, label, base, t, required) AS (VALUES
    {listed}),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all({LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
vocabulary AS (SELECT DISTINCT unnest(t) AS word FROM passages),
placed AS MATERIALIZED (
  SELECT rid, i, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) AS s(i) WHERE w[i] IN (SELECT word FROM vocabulary)),
frequency AS (SELECT word, count(DISTINCT rid) AS df FROM vocabulary LEFT JOIN placed USING (word) GROUP BY word),
rare AS MATERIALIZED (
  SELECT n, word, list_position(t, word) AS place,
         row_number() OVER (PARTITION BY n ORDER BY df, word) AS nth
  FROM (SELECT DISTINCT n, t, unnest(t) AS word FROM passages) JOIN frequency USING (word)),
needed AS (
  SELECT n, list(place) FILTER (WHERE nth <= {licenses.RARE_WORDS}) AS places FROM rare GROUP BY n),
found AS (
  SELECT rid, label, base, i - place AS start,
         CAST(len(list_filter(range(1, len(t) + 1), lambda j: w[i - place + j] = t[j] AND i - place + j > 0)) AS DOUBLE) / len(t) AS share
  FROM placed JOIN rare ON rare.word = placed.word AND nth = 1 JOIN passages USING (n) JOIN needed USING (n) JOIN docs USING (rid)
  WHERE len(list_filter(places, lambda j: i - place + j > 0 AND w[i - place + j] = t[j])) = len(places)
    AND len(list_filter(required, lambda j: i - place + j + 1 > 0 AND w[i - place + j + 1] = t[j + 1])) = len(required)),
labelled AS (
  SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
         max(start) FILTER (WHERE base) AS last_word, max(share) AS score,
         list_sort(list_distinct(list(label) FILTER (WHERE base))) AS base_labels, list_sort(list_distinct(list(label))) AS labels
  FROM found WHERE share >= {licenses.MIN_SHARE} GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels,
       coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM docs LEFT JOIN labelled USING (rid)
"""


def divergence_sql(min_docs: int = divergence.MIN_DOCS, top: int = divergence.TOP_TERMS) -> str:
    """Every kept term for every pair of sources."""
    unit = divergence.UNIT
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWERED.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
uses AS MATERIALIZED (SELECT rid, lang, source, term, count(*) AS n FROM docs, unnest(w) AS t(term) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM uses GROUP BY lang, term HAVING count(*) >= {min_docs}),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (
  SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM uses SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
dense AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + ({unit} * CAST(coalesce(n, 0) + 1 AS HUGEINT)) // (total + v) AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term) JOIN totals USING (lang, source) JOIN sizes USING (lang)),
whole AS (
  SELECT lang, term, 1 + ({unit} * CAST(sum(n) + 1 AS HUGEINT)) // (lang_total + v) AS q
  FROM dense JOIN sizes USING (lang) JOIN (SELECT lang, sum(total) AS lang_total FROM totals GROUP BY lang) USING (lang)
  GROUP BY lang, term, lang_total, v),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT)
  FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
WHERE part = 'pair' OR rank <= {top}
"""
