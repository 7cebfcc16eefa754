"""The registered queries in DuckDB's SQL, for side-by-side checks.

The statements are built from the same lists of words and phrases, but state each rule
in SQL terms of their own.
"""

from __future__ import annotations

from textlots.functions.rewrite import LETTERS, by_length
from textlots.functions.text import STOPWORDS
from textlots.operators import costs
from textlots.operators.ingest import HEADER_WORDS
from textlots.packs import CONTRACTS, INCIDENTS, PACKS, REVIEWS, Pack
from textlots.packs import playbook as book
from textlots.packs import triage as lists
from textlots.packs.dictionary import PHRASES as DICTIONARY
from textlots.packs.dictionary import WORDS
from textlots.packs.prices import DAILY_VOLUME, PRICE_PER_MILLION, PRICES
from textlots.plans import inputs
from textlots.plans.registry import LOT_ROWS as CAP

PIECE = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
AMOUNT = (
    r"(?:\$|USD|COP|EUR|MXN)?\s*(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)"
    r"\s*(?:pesos|dolares|dólares|usd|eur)?"
)
DATE = (
    r"(?:^|[^\p{L}\p{N}_])(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
    r"|\d{1,2}\s+de\s+[\p{L}\p{N}_]+\s+de\s+\d{4})(?:$|[^\p{L}\p{N}_])"
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def nn(c: str) -> str:
    return f"nullif({c}, '')"


# Scalars


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def clean(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def key(c: str) -> str:
    return f"md5(lower({strip(c)}))"


def count_pieces(c: str) -> str:
    return f"len(regexp_extract_all({c}, {q(PIECE)}))::BIGINT"


def rounded(x: str, digits: int) -> str:
    """Round the exact value of a double, ties to even."""
    s = f"{10**digits}::DOUBLE"
    high = "(v * 134217729::DOUBLE - (v * 134217729::DOUBLE - v))"
    a, b = f"({high} * {s})", f"((v - {high}) * {s})"
    whole = f"floor({a} + {b})"
    rest = f"(({a} - {whole}) + {b})"
    up = f"({rest} > 0.5::DOUBLE OR ({rest} = 0.5::DOUBLE AND abs({whole} % 2::DOUBLE) = 1))"
    body = f"({whole} + CASE WHEN {up} THEN 1::DOUBLE ELSE 0::DOUBLE END) / {s}"
    return f"list_transform([CAST({x} AS DOUBLE)], lambda v: {body})[1]"


def cost(tokens: str, price: str) -> str:
    return rounded(f"({tokens})::DOUBLE / 1000000::DOUBLE * ({price})::DOUBLE", 6)


def pct(part: str, whole: str, digits: int) -> str:
    return rounded(f"({part})::DOUBLE / greatest({whole}, 1)::DOUBLE * 100::DOUBLE", digits)


def header_like(c: str) -> str:
    parts = f"string_split({c}, ' ')"
    return (
        f"(NOT regexp_matches({c}, '[,.;:!?]') AND len({parts}) >= 2"
        f" AND len(list_filter({parts}, lambda w: length(w) > 12)) = 0"
        f" AND len(list_filter({parts}, lambda w: list_contains({listed(STOPWORDS)}, lower(w)))) = 0)"
    )


def junk(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN 'no_value' WHEN length({c}) < 3 THEN 'under_3_chars'"
        rf" WHEN NOT regexp_matches({c}, '\p{{L}}') THEN 'no_letter'"
        f" WHEN length({c}) < 10 THEN 'under_10_chars' WHEN {header_like(c)} THEN 'header_like' END"
    )


def found(low: str, words) -> str:
    return f"len(list_filter({listed(words)}, lambda w: contains({low}, w)))"


def shortened(c: str) -> str:
    return (
        f"CASE WHEN length({c}) > 100"
        rf" THEN regexp_replace(substr({c}, 1, 97), '\s+$', '') || '…' ELSE {c} END"
    )


def rewritten(c: str) -> str:
    """Dictionary rewrite of a cleaned column."""
    text = c
    for spanish, english in by_length(DICTIONARY):
        text = f"regexp_replace({text}, {q(spanish)}, {q(english)}, 'gi')"
    table = "map {" + ", ".join(f"{q(s)}: {q(e)}" for s, e in WORDS) + "}"
    one = (
        "CASE WHEN f IS NULL THEN w WHEN w = upper(w) THEN upper(f)"
        " WHEN substr(w, 1, 1) = upper(substr(w, 1, 1)) THEN upper(substr(f, 1, 1)) || substr(f, 2)"
        " ELSE f END"
    )
    plain = "translate(lower(w), 'áéíóúüñ', 'aeiouun')"
    look_up = f"coalesce({table}[lower(w)], {table}[{plain}])"
    swap = f"list_transform([{look_up}], lambda f: {one})[1]"
    runs = f"regexp_extract_all({text}, '[{LETTERS}]+|[^{LETTERS}]+')"
    return clean(f"array_to_string(list_transform({runs}, lambda w: {swap}), '')")


def attr(rule: str, pack: Pack, name: str) -> str:
    values = [r.type if name == pack.type_key else r.attrs[name] for r in pack.rules]
    return f"coalesce({listed(values)}[{rule}], {q(pack.fallback[name])})"


def best(text: str, pack: Pack) -> str:
    """1-based number of the best rule, null if none."""
    marks = ", ".join(found("low", [k.lower() for k in r.keywords]) for r in pack.rules)
    first = "CASE WHEN list_max(s) > 0 THEN list_position(s, list_max(s)) END"
    return (
        f"list_transform([lower({text})], lambda low: list_transform([[{marks}]], lambda s: {first})[1])[1]"
    )


def amount(c: str) -> str:
    return nn(strip(f"regexp_extract({c}, {q(AMOUNT)}, 0, 'i')"))


def date(c: str) -> str:
    return nn(f"regexp_extract({c}, {q(DATE)}, 1, 'i')")


def result_key(pack: Pack, name: str, text: str, rule: str = "rule") -> str:
    if name == "amount_hint":
        return f"CASE WHEN {rule} IS NOT NULL THEN {amount(text)} END"
    if name == "date_hint":
        return f"CASE WHEN {rule} IS NOT NULL THEN {date(text)} END"
    return attr(rule, pack, name)


# Views


def phrase_table(name: str, phrases) -> str:
    rows = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(phrases))
    return f"{name}(slot, phrase) AS (VALUES {rows})"


FEEDBACK = f"""{phrase_table("phrases", inputs.PHRASES)},
feedback AS (
  SELECT 'lot_' || lang AS batch_id, source, doc_id AS row_no,
         CASE WHEN doc_id % 50 = 0 THEN translate(phrase || ' ' || text, {q(inputs.LOWER)}, {q(inputs.UPPER)})
              ELSE phrase || ' ' || text END AS text
  FROM documents JOIN phrases ON length(text) % {len(inputs.PHRASES)} = slot)"""

TEXTS = f"""{FEEDBACK},
texts AS (
  SELECT batch_id, source, row_no, text, {key("text")} AS key
  FROM (SELECT batch_id, source, row_no, {clean("text")} AS text FROM feedback)
  WHERE {junk("text")} IS NULL)"""


def canon(pack: Pack = REVIEWS, optimize: bool = True) -> str:
    better = rewritten("text") if optimize else "''"
    after = count_pieces("text_optimized") if optimize else "tokens_original"
    return f"""{TEXTS},
firsts AS (
  SELECT *, count(*) OVER (PARTITION BY batch_id, key) AS n_rows,
         row_number() OVER (PARTITION BY batch_id, key ORDER BY source, row_no) AS place
  FROM texts),
canon AS (
  SELECT *, {after} AS tokens_optimized FROM (
    SELECT batch_id, key, n_rows, source AS canon_source, row_no AS canon_row_no, text AS canon_text,
           {count_pieces("text")} AS tokens_original, {better} AS text_optimized, {best("text", pack)} AS rule
    FROM firsts WHERE place = 1))"""


# Rows kept as the first row of their lot with a similar vector: similar ones come in equal pairs here.
NEAR = f"""{canon()},
vectored AS (
  SELECT c.*, e.embedding FROM canon c LEFT JOIN embeddings e ON e.vec_id = c.canon_row_no // 2),
moved AS (
  SELECT a.batch_id, a.key, min((b.canon_source, b.canon_row_no)) AS kept
  FROM vectored a JOIN vectored b ON a.batch_id = b.batch_id
   AND (b.key = a.key OR list_cosine_similarity(a.embedding, b.embedding) >= 0.92
        AND (b.canon_source, b.canon_row_no) < (a.canon_source, a.canon_row_no))
  GROUP BY a.batch_id, a.key),
near AS (
  SELECT k.* REPLACE (n AS n_rows) FROM canon k JOIN (
    SELECT batch_id, kept, sum(n_rows)::BIGINT AS n FROM canon JOIN moved USING (batch_id, key) GROUP BY batch_id, kept) m
  ON m.batch_id = k.batch_id AND m.kept = (k.canon_source, k.canon_row_no))"""


def near_totals() -> str:
    return totals().replace(canon(), NEAR, 1).replace("FROM canon GROUP BY batch_id)", "FROM near GROUP BY batch_id)")


def strategies(rows: str, method: str) -> str:
    """The three strategies from canonical rows."""
    labels, notes = costs.STRATEGY_LABELS, costs.STRATEGY_NOTES

    def told(name: str) -> str:
        return f"{q(labels[name])} AS label, {q(notes[name])} AS note, {str(name == 'b_ctranslate2').lower()} AS is_primary"

    return f""",
lots AS (
  SELECT batch_id, sum(tokens_original)::BIGINT AS o, sum(tokens_optimized)::BIGINT AS n,
    sum(tokens_optimized)::BIGINT AS d, sum(n_rows)::BIGINT AS before, count(*) AS after
  FROM {rows} GROUP BY batch_id)
SELECT batch_id, 'a_dictionary' AS strategy, 'dictionary' AS method, d AS tokens, o - d AS savings_vs_original,
  {pct("o - d", "o", 2)} AS savings_pct, NULL::BIGINT AS items_before, NULL::BIGINT AS items_after,
  NULL::BIGINT AS tokens_canonical_original, NULL::BIGINT AS tokens_canonical_translated,
  NULL::DOUBLE AS volume_reduction_pct, {told("a_dictionary")} FROM lots
UNION ALL SELECT batch_id, 'b_ctranslate2', 'dictionary', n, o - n, {pct("o - n", "o", 2)}, NULL, NULL, NULL, NULL, NULL,
  {told("b_ctranslate2")} FROM lots
UNION ALL SELECT batch_id, 'c_semantic_dedup', {q(method)}, NULL, NULL, NULL, before, after, o, n,
  {pct("before - after", "before", 2)}, {told("c_semantic_dedup")} FROM lots"""


def totals(optimize: bool = True) -> str:
    return f"""{canon(optimize=optimize)},
totals AS (
  SELECT batch_id, sum(n_rows * tokens_original)::BIGINT AS tokens_original,
         sum(n_rows * tokens_optimized)::BIGINT AS tokens_optimized, sum(n_rows)::BIGINT AS item_count,
         count(*) AS unique_count, {str(optimize).lower()} AS optimize_enabled,
         {PRICE_PER_MILLION}::DOUBLE AS price_per_million, {DAILY_VOLUME}::BIGINT AS daily_volume
  FROM canon GROUP BY batch_id)"""


_PER_DAY = "daily_volume::DOUBLE / greatest(item_count, 1)::DOUBLE"
SCENARIOS = f"""{totals()},
scenarios AS (
  SELECT batch_id, tokens_original, tokens_optimized, item_count, optimize_enabled, price_per_million,
         daily_volume, batch_id || '|' || price_per_million::VARCHAR || '|' || daily_volume AS scenario_id
  FROM (SELECT * EXCLUDE (price_per_million, daily_volume) FROM totals)
  CROSS JOIN (VALUES (0.0::DOUBLE), (0.27::DOUBLE), (2.5::DOUBLE), (3.0::DOUBLE)) p(price_per_million)
  CROSS JOIN (VALUES (0::BIGINT), (500::BIGINT), (10000::BIGINT), (1000000::BIGINT)) v(daily_volume))"""

REPORTS = f"""{phrase_table("report_phrases", inputs.REPORT_PHRASES)},
reports AS (
  SELECT conv_id * 1000 + turn AS report_id,
         CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN '  Falla  '
              WHEN conv_id % 11 = 5 AND turn = 0 THEN repeat(phrase || ' ' || text || ' ', 100)
              ELSE phrase || ' ' || text END AS mensaje,
         CASE conv_id % 5 WHEN 0 THEN ' User' || conv_id || '@Example.com ' WHEN 1 THEN 'bad mail@example.com'
              WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE 'u' || turn || '@host.org' END AS email,
         CASE WHEN conv_id % 13 = 4 THEN repeat('p', 210) WHEN conv_id % 2 = 0 THEN '#/analyze' END AS page,
         repeat('agent ', (turn * 30 + 1)::INT) AS user_agent,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn) AS ts
  FROM conversations JOIN report_phrases ON length(text) % {len(inputs.REPORT_PHRASES)} = slot
  WHERE role = 'user')"""

VALID = rf"""{REPORTS},
checked AS (
  SELECT report_id, {strip("mensaje")} AS mensaje, lower({nn(strip("email"))}) AS email,
         coalesce(page, '') AS page, substr(coalesce(user_agent, ''), 1, 300) AS user_agent, ts,
         CASE WHEN length(mensaje) < 10 OR length({strip("mensaje")}) < 10 THEN 'mensaje_too_short'
              WHEN length(mensaje) > 4000 THEN 'mensaje_too_long'
              WHEN length(page) > 200 THEN 'page_too_long'
              WHEN length({nn(strip("email"))}) > 254
                OR NOT regexp_matches({nn(strip("email"))}, '^[^\s@]+@[^\s@]+\.[^\s@]+$')
              THEN 'email_invalid' END AS reject_reason
  FROM reports)"""


def summary(c: str) -> str:
    pieces = [
        f"CASE WHEN contains({c}, {sep}) THEN {strip(f'split_part({c}, {sep}, 1)')} END"
        for sep in ("'. '", "'。'", "chr(10)")
    ]
    p1, p2, p3 = pieces
    piece = (
        f"coalesce(CASE WHEN length({p1}) >= 12 THEN {p1} END, CASE WHEN length({p2}) >= 12 THEN {p2} END,"
        f" {p3}, {p2}, {p1}, {c})"
    )
    return f"list_transform([{piece}], lambda p: {shortened('p')})[1]"


def summary_compact(c: str) -> str:
    piece = f"CASE WHEN instr({c}, '. ') > 13 THEN {strip(f'''split_part({c}, '. ', 1)''')} ELSE {c} END"
    return f"list_transform([{piece}], lambda p: {shortened('p')})[1]"


def severity(low: str, pack: str) -> str:
    critical, lower, _ = lists.PACKS[pack]
    return (
        f"CASE WHEN {found(low, critical)} > 0 THEN 'critica'"
        f" WHEN {found(low, lower)} > 0 THEN 'baja' ELSE 'media' END"
    )


def module(low: str, pack: str) -> str:
    whens = " ".join(f"WHEN contains({low}, {q(w)}) THEN {q(n)}" for w, n in lists.PACKS[pack][2])
    return f"CASE {whens} ELSE {q(lists.UNCLASSIFIED)} END"


TRIAGED = f"""{VALID},
good AS (
  SELECT *, mensaje AS texto_original, lower(mensaje) AS low FROM checked WHERE reject_reason IS NULL),
triaged AS (
  SELECT report_id, mensaje, coalesce(email, '') AS email, page, user_agent, texto_original,
         {severity("low", "full")} AS severidad, {module("low", "full")} AS modulo_probable,
         {summary("texto_original")} AS resumen, 'web' AS source,
         strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp
  FROM good)"""

PLAYS = f"""plays(number, name, steps) AS (VALUES {
    ", ".join(f"({i}, {q(name)}, {listed(steps)})" for i, (name, steps) in enumerate(book.PLAYBOOK))
})"""


def play_of(rows: str, out: str) -> str:
    """Adds playbook and steps to ``rows`` (with report_id and modulo_probable)."""
    return f"""{out} AS (
  SELECT r.*, (SELECT min_by(p.name, (p.name <> r.modulo_probable, p.number)) FROM plays p
               WHERE r.modulo_probable <> ''
                 AND (contains(p.name, r.modulo_probable) OR contains(r.modulo_probable, p.name))) AS playbook
  FROM {rows} r)"""


STEPS = f"coalesce((SELECT steps FROM plays WHERE name = playbook), {listed(book.GENERIC_STEPS)})"


def by_level(low: str, mid: str, other: str) -> str:
    return f"CASE severidad WHEN 'critica' THEN {q(low)} WHEN 'baja' THEN {q(mid)} ELSE {q(other)} END"


def models(columns: str) -> str:
    rows = ", ".join(f"({i}, {q(a)}, {q(b)}, {q(c)}, {p}::DOUBLE)" for i, (a, b, c, p) in enumerate(PRICES))
    return f"SELECT batch_id, id, model, provider, price_per_1m, number, {columns} FROM totals CROSS JOIN (VALUES {rows}) m(number, id, model, provider, price_per_1m)"


def batch_figures(keys: str) -> str:
    return f"""SELECT {keys}, item_count, tokens_original, tokens_optimized,
  greatest(tokens_original - tokens_optimized, 0)::BIGINT AS savings_tokens,
  {pct("greatest(tokens_original - tokens_optimized, 0)", "tokens_original", 2)} AS savings_pct,
  {rounded("tokens_original::DOUBLE / greatest(item_count, 1)::DOUBLE", 2)} AS avg_tokens_original,
  {rounded("tokens_optimized::DOUBLE / greatest(item_count, 1)::DOUBLE", 2)} AS avg_tokens_optimized,
  cost_original_usd, cost_optimized_usd,
  {rounded("cost_original_usd - cost_optimized_usd", 6)} AS cost_savings_usd"""


PRICED = f"""SELECT *, {cost("tokens_original", "price_per_million")} AS cost_original_usd,
  {cost("tokens_optimized", "price_per_million")} AS cost_optimized_usd"""

DAYS = f"""SELECT *, trunc(tokens_original * ({_PER_DAY}))::BIGINT AS day_o,
  trunc(tokens_optimized * ({_PER_DAY}))::BIGINT AS day_n"""

PROJECTED = f"""daily_volume, day_o AS tokens_day_original, day_n AS tokens_day_optimized,
  (day_o * 30)::BIGINT AS tokens_month_original, (day_n * 30)::BIGINT AS tokens_month_optimized,
  (day_o - day_n)::BIGINT AS savings_tokens_day, ((day_o - day_n) * 30)::BIGINT AS savings_tokens_month,
  {cost("day_o - day_n", "price_per_million")} AS savings_usd_day,
  {cost("(day_o - day_n) * 30", "price_per_million")} AS savings_usd_month"""

MEANS = """SELECT *, tokens_original::DOUBLE / greatest(item_count, 1)::DOUBLE AS mean_o,
  tokens_optimized::DOUBLE / greatest(item_count, 1)::DOUBLE AS mean_n"""
OVERHEAD = f"""SELECT *, greatest(trunc(mean_o * 0.15::DOUBLE)::BIGINT, 5)::BIGINT AS overhead,
  {cost("greatest(trunc(mean_o * 0.15::DOUBLE)::BIGINT, 5)", "price_per_million")} AS overhead_usd,
  {cost("greatest(mean_o - mean_n, 0::DOUBLE)", "price_per_million")} AS saved_usd,
  (mean_o - mean_n) / greatest(mean_o, 1::DOUBLE) AS frac"""
EVEN = f"""CASE WHEN saved_usd > 0 THEN greatest(1, trunc(overhead_usd / saved_usd)::BIGINT) END AS NAME,
  CASE WHEN saved_usd > 0 AND frac > 0 THEN trunc(overhead / frac)::BIGINT END AS tokens_per_item,
  saved_usd AS savings_per_item_usd, overhead_usd AS preprocess_cost_per_item_usd,
  CASE WHEN optimize_enabled AND tokens_original > tokens_optimized THEN {q(costs.ADVICE_SAVES)}
       WHEN NOT optimize_enabled THEN {q(costs.ADVICE_OFF)} ELSE {q(costs.ADVICE_NONE)} END AS recommendation"""


def core(optimize: bool = True) -> str:
    return f"""core AS (
  SELECT batch_id, tokens_original, tokens_optimized, tokens_original - tokens_optimized AS savings_tokens,
    {pct("tokens_original - tokens_optimized", "tokens_original", 2)} AS savings_pct, item_count, unique_count,
    {cost("tokens_original", "price_per_million")} AS cost_original_usd,
    {cost("tokens_optimized", "price_per_million")} AS cost_optimized_usd,
    {cost("tokens_original - tokens_optimized", "price_per_million")} AS cost_savings_usd,
    {str(optimize).lower()} AS optimize_tokens, price_per_million
  FROM totals)"""


def distribution(pack: Pack) -> str:
    return f"""{canon(pack)},
distribution AS (
  SELECT batch_id, {attr("rule", pack, pack.type_key)} AS type, sum(n_rows)::BIGINT AS n
  FROM canon GROUP BY ALL)"""


def table_rows(pack: Pack) -> str:
    keys = ", ".join(
        f"coalesce({result_key(pack, k, 'canon_text')}, '') AS {k}" for k in pack.result_keys
    )
    return f"""WITH {canon(pack)}
SELECT t.batch_id, t.row_no, t.source AS source_file, t.text AS texto_original,
  c.text_optimized AS texto_optimizado, c.tokens_original,
  c.tokens_optimized AS tokens_optimizado, c.tokens_original - c.tokens_optimized AS ahorro_tokens,
  {pct("c.tokens_original - c.tokens_optimized", "c.tokens_original", 1)} AS ahorro_pct,
  'si' AS optimizado, 'rules' AS metodo_clasificacion, {keys}
FROM texts t JOIN canon c USING (batch_id, key)"""


def classified(pack: Pack) -> str:
    keys = ", ".join(f"{result_key(pack, k, 'text')} AS {k}" for k in pack.result_keys)
    return f"""WITH {FEEDBACK}
SELECT batch_id, source, row_no, {keys}, 'rules' AS method, rule IS NOT NULL AS matched
FROM (SELECT *, {best("text", pack)} AS rule FROM feedback)"""


def wide_scores() -> str:
    """Score of every column of every wide file."""
    parts = []
    for table, columns in inputs.WIDE:
        for order, (column, header) in enumerate(columns.items()):
            head = f"lower(strip_accents({q(header)}))"
            parts.append(
                f"""SELECT {q(table)} AS source, {order} AS place, {q(header)} AS header,
  100 * (SELECT count(*) FROM (SELECT unnest({listed(HEADER_WORDS)}) AS w) WHERE contains({head}, w))
    + sum(length(cell))::DOUBLE / count(cell) AS score, count(cell) AS n
FROM (SELECT CASE WHEN {junk("c")} IS NULL THEN c END AS cell FROM (SELECT {clean(column)} AS c FROM {table}))"""
            )
    return "scored AS (" + " UNION ALL ".join(parts) + ")"


def detected() -> str:
    files = ", ".join(f"({q(table)})" for table, _ in inputs.WIDE)
    return f"""{wide_scores()},
detected AS (
  SELECT f.source, header AS column_detected, score, coalesce(n, 0)::BIGINT AS n_texts
  FROM (VALUES {files}) f(source) LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, place) AS rn
    FROM scored WHERE n > 0) s ON s.source = f.source AND rn = 1)"""


def all_cells() -> str:
    parts = [
        f"SELECT {q(table)} AS source, {column} AS cell FROM {table}"
        for table, columns in inputs.WIDE
        for column in columns
    ]
    parts.append("SELECT 'orders', strftime(o_orderdate, '%d/%m/%Y') FROM orders")
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


def wide_texts() -> str:
    parts = [
        f"SELECT {q(table)} AS source, {q(header)} AS header, {clean(column)} AS text FROM {table}"
        for table, columns in inputs.WIDE
        for column, header in columns.items()
    ]
    return "wide_texts AS (" + " UNION ALL ".join(parts) + ")"


CAPPED = f"""files AS (
  SELECT batch_id, source, count(*) AS n, least(count(*), {CAP}) AS capped FROM feedback GROUP BY ALL),
kept AS (
  SELECT batch_id, source, n, greatest(0, least(capped, {CAP} - coalesce(sum(capped) OVER (
    PARTITION BY batch_id ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS quota
  FROM files)"""


ANSWER = r"""replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r')"""
ANSWERS = f"""answers AS (
  SELECT conv_id * 1000 + turn AS report_id, text AS mensaje,
    CASE length(text) % 6
      WHEN 0 THEN '{{"severidad":"critica","modulo_probable":"Interfaz (UI)","resumen":"' || {ANSWER}
                  || '","texto_original":"' || {ANSWER} || '"}}'
      WHEN 1 THEN '{{"severidad":"","texto_original":"' || {ANSWER} || '"}}'
      WHEN 2 THEN text WHEN 3 THEN '{{}}' WHEN 4 THEN '[1, 2]' ELSE '' END AS raw
  FROM conversations WHERE role = 'user'),
parsed AS (
  SELECT *, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw->>'$.severidad' END AS s,
    CASE WHEN json_valid(raw) THEN raw->>'$.modulo_probable' END AS m,
    CASE WHEN json_valid(raw) THEN raw->>'$.resumen' ELSE substr(raw, 1, 120) END AS r,
    CASE WHEN json_valid(raw) THEN raw->>'$.texto_original' ELSE mensaje END AS t
  FROM answers)"""

NESTED = f"""{REPORTS},
nested AS (
  SELECT report_id, {strip("mensaje")} AS mensaje, lower(coalesce({strip("email")}, '')) AS email,
    CASE WHEN report_id % 2 = 0 THEN 'form' ELSE 'mobile' END AS source,
    strftime(ts, '%Y-%m-%d') AS timestamp, coalesce(page, '') AS page, lower({strip("mensaje")}) AS low
  FROM reports)"""


def reply_body() -> str:
    intro = by_level(book.INTRO_CRITICAL, book.INTRO_LOW, book.INTRO_OTHER)
    closing = by_level(book.CLOSING_CRITICAL, book.CLOSING_LOW.format(brand="Soporte"), book.CLOSING_OTHER)
    numbered = (
        f"array_to_string(list_transform({STEPS}, lambda s, i: i::VARCHAR || '. ' || s), chr(10))"
    )
    signature = [q(line.format(brand="Soporte")) for line in book.SIGNATURE]
    lines = [
        "'Hola,'", "''", intro, "''", "'Módulo detectado: ' || modulo_probable", "'Severidad: ' || severidad",
        "''", "'Tu mensaje:'", "CASE WHEN mensaje = '' THEN '—' ELSE mensaje END", "''", "'Pasos sugeridos:'",
        numbered, "''", closing, "''", *signature,
    ]
    return " || chr(10) || ".join(f"({line})" for line in lines)


LOT_ROWS = f"""SELECT batch_id, metrica, valor FROM (
  SELECT batch_id, unnest(['total_items', 'tokens_original', 'tokens_optimized', 'savings_tokens',
      'cost_original_usd', 'cost_optimized_usd', 'cost_savings_usd', 'elapsed_ms']) AS metrica,
    unnest([item_count::DOUBLE, tokens_original::DOUBLE, tokens_optimized::DOUBLE, savings_tokens::DOUBLE,
      cost_original_usd, cost_optimized_usd, cost_savings_usd, NULL::DOUBLE]) AS valor FROM core)"""


def _row_ids(body: str) -> str:
    return f"WITH {FEEDBACK} SELECT batch_id, source, row_no, {body} FROM feedback"


def sql() -> dict[str, str]:
    reviews_marks = ", ".join(
        f"struct_pack(type := {q(r.type)}, hits := {found('low', [k.lower() for k in r.keywords])}::INT)"
        for r in REVIEWS.rules
    )
    return {
        "clean_cell": f"SELECT doc_id, {clean('text')} AS text_clean FROM documents",
        "detect_text_column": f"WITH {detected()} SELECT * FROM detected",
        "union_lots": f"""WITH {detected()}, {wide_texts()}
SELECT w.source, count(*) AS n_texts, sum(length(text))::BIGINT AS n_chars
FROM wide_texts w JOIN detected d ON w.source = d.source AND w.header = d.column_detected
WHERE {junk("text")} IS NULL GROUP BY w.source""",
        "cap_rows": f"""WITH {FEEDBACK}, {CAPPED}
SELECT batch_id, source, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id, source ORDER BY row_no) AS rn FROM feedback)
JOIN kept USING (batch_id, source) WHERE rn <= quota""",
        "source_summary": f"""WITH {TEXTS}, counts AS (SELECT batch_id, source, count(*) AS n FROM texts GROUP BY ALL)
SELECT f.batch_id, f.source, coalesce(n, 0)::BIGINT AS row_count,
  CASE WHEN n > 0 THEN 'text' END AS column_detected,
  CASE WHEN coalesce(n, 0) = 0 THEN 'no text column found in ' || f.source END AS error,
  false AS truncated
FROM (SELECT DISTINCT batch_id, source FROM feedback) f LEFT JOIN counts USING (batch_id, source)""",
        **{
            f"read_back_{fmt}": f"WITH {FEEDBACK} SELECT batch_id AS lot, row_no AS doc_id, text FROM feedback"
            for fmt in ("csv", "json", "parquet")
        },
        "result_table": table_rows(REVIEWS),
        "result_table_contracts": table_rows(CONTRACTS),
        "lot_summary": f"WITH {totals()}, {core()} {LOT_ROWS}",
        "results_preview": f"""WITH {canon()},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY source, row_no)::INT AS position,
    count(*) OVER (PARTITION BY batch_id) AS results_total FROM texts)
SELECT t.batch_id, t.source, t.row_no, position, results_total, substr(t.text, 1, 300) AS text,
  substr(c.text_optimized, 1, 300) AS text_optimized, c.tokens_original, c.tokens_optimized,
  {attr("rule", REVIEWS, "error_type")} AS error_type
FROM placed t JOIN canon c USING (batch_id, key) WHERE position <= 50""",
        "junk_filter": f"""WITH {all_cells()}
SELECT source, coalesce({junk("c")}, 'usable') AS verdict, count(*) AS n_cells, sum(length(c))::BIGINT AS n_chars
FROM (SELECT source, {clean("cell")} AS c FROM cells) GROUP BY ALL""",
        "header_like": f"""WITH {all_cells()}
SELECT source, {header_like("c")} AS header_like, count(*) AS n_cells
FROM (SELECT source, {clean("cell")} AS c FROM cells) GROUP BY ALL""",
        "report_validate": f"""WITH {VALID}
SELECT report_id, mensaje, email, page, length(user_agent)::INT AS agent_chars, reject_reason FROM checked""",
        "scenario_check": f"""WITH {SCENARIOS}
SELECT scenario_id, CASE WHEN item_count < 1 THEN 'item_count below 1'
  WHEN price_per_million <= 0 THEN 'price_per_million not above 0'
  WHEN daily_volume < 1 THEN 'daily_volume below 1' END AS reject_reason FROM scenarios""",
        "exact_dedup": f"""WITH {TEXTS}
SELECT batch_id, source, row_no, first_value(source) OVER w AS canon_source,
  first_value(row_no) OVER w AS canon_row_no, row_number() OVER w = 1 AS is_canonical
FROM texts WINDOW w AS (PARTITION BY batch_id, key ORDER BY source, row_no)""",
        "dedup_stats": f"""WITH {TEXTS}
SELECT batch_id, count(*) AS input_items, count(DISTINCT key) AS canonical_items,
  count(*) - count(DISTINCT key) AS removed_or_merged,
  {pct("count(*) - count(DISTINCT key)", "count(*)", 2)} AS reduction_pct,
  {rounded("1::DOUBLE - count(DISTINCT key)::DOUBLE / count(*)::DOUBLE", 3)} AS dedup_ratio
FROM texts GROUP BY batch_id""",
        "dropped_duplicates": f"""WITH {TEXTS}
SELECT batch_id, source, row_no FROM texts
QUALIFY row_number() OVER (PARTITION BY batch_id, key ORDER BY source, row_no) > 1""",
        # Similar vectors come in pairs here, so the first similar row is always a kept one.
        "vector_dedup": """WITH given AS (
  SELECT CASE WHEN label % 2 = 0 THEN 'lot_even' ELSE 'lot_odd' END AS batch_id, vec_id, embedding FROM embeddings),
vecs AS (
  SELECT batch_id, vec_id AS row_no, embedding FROM given UNION ALL
  SELECT batch_id, vec_id + 100000, list_transform(embedding, lambda x: (x * 2)::FLOAT) FROM given),
firsts AS (
  SELECT a.batch_id, a.row_no, min(b.row_no) AS canon_row_no
  FROM vecs a JOIN vecs b ON a.batch_id = b.batch_id AND b.row_no <= a.row_no
   AND (a.row_no = b.row_no OR list_cosine_similarity(a.embedding, b.embedding) >= 0.92)
  GROUP BY ALL)
SELECT batch_id, 'vec' AS source, row_no, 'vec' AS canon_source, canon_row_no, row_no = canon_row_no AS is_canonical,
  'semantic' AS method FROM firsts""",
        "expand_results": f"""WITH {canon()}
SELECT t.batch_id, t.source, t.row_no, t.text, canon_source, canon_row_no,
  c.tokens_original, c.tokens_optimized, c.text_optimized
FROM texts t JOIN canon c USING (batch_id, key)""",
        "rule_match_long": f"""WITH {FEEDBACK}
SELECT batch_id, source, row_no, m.type AS type, m.hits AS hits FROM (
  SELECT batch_id, source, row_no, unnest([{reviews_marks}]) AS m
  FROM (SELECT *, lower(text) AS low FROM feedback)) WHERE m.hits > 0""",
        "rule_table_match": f"""WITH {FEEDBACK},
pack AS (
  SELECT p_type, min(p_size) AS size, dense_rank() OVER (ORDER BY p_type) AS place,
    substr(lower(p_type), 1, 2) AS word FROM part GROUP BY p_type)
SELECT batch_id, source, row_no, coalesce(arg_min(p_type, place), 'none') AS part_type,
  coalesce(arg_min(size::VARCHAR, place), 'low') AS severity
FROM feedback LEFT JOIN pack ON contains(lower(text), word) GROUP BY batch_id, source, row_no""",
        "rule_index_match": f"""WITH {FEEDBACK},
words AS (
  SELECT word, min(item_id) AS place FROM (
    SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) GROUP BY word),
rules AS (
  SELECT 'type_' || substr(word, 1, 2) AS type, list(word) AS words, min(place) AS place FROM words GROUP BY type),
hit AS (
  SELECT batch_id, source, row_no, type, place, len(list_filter(words, lambda w: contains(low, w))) AS hits
  FROM (SELECT *, lower(text) AS low FROM feedback), rules)
SELECT batch_id, source, row_no, type, hits FROM hit WHERE hits > 0
QUALIFY row_number() OVER (PARTITION BY batch_id, source, row_no ORDER BY hits DESC, place, type) = 1""",
        "playbook_join": f"""WITH {REPORTS}, {PLAYS},
named AS (
  SELECT report_id, CASE report_id % 3 WHEN 0 THEN substr(m, 1, 8) WHEN 1 THEN 'Módulo ' || m ELSE m END AS modulo_probable
  FROM (SELECT report_id, {module("lower(" + strip("mensaje") + ")", "full")} AS m FROM reports)),
{play_of("(SELECT report_id, trim(modulo_probable) AS modulo_probable, modulo_probable AS given FROM named)", "played")}
SELECT report_id, given AS modulo_probable, playbook, len({STEPS})::INT AS n_pasos,
  array_to_string({STEPS}, '|') AS pasos FROM played""",
        "normalize_text": f"""SELECT doc_id,
  {strip("lower(strip_accents(text))")} AS text_norm FROM documents""",
        "token_count": f"SELECT doc_id, {count_pieces('text')} AS tokens FROM documents",
        "dict_rewrite": _row_ids(f"{rewritten('text')} AS text_optimized"),
        "compress_text": rf"""SELECT doc_id, CASE WHEN length(t) <= 280 THEN t
  WHEN regexp_matches(substr(t, 142, 139), '\.') THEN regexp_extract(substr(t, 1, 280), '(?s)^.*\.')
  ELSE regexp_replace(substr(t, 1, 280), '\s+$', '') || '…' END AS text_short
FROM (SELECT doc_id, {clean("text")} AS t FROM documents)""",
        "rewrite_with": f"""WITH {TEXTS}
SELECT batch_id, source AS canon_source, row_no AS canon_row_no,
  replace(replace(replace(text, ' the ', ' '), ' de ', ' '), ' und ', ' ') AS text_optimized,
  'passthrough' AS optimize_method FROM texts
QUALIFY row_number() OVER (PARTITION BY batch_id, key ORDER BY source, row_no) = 1""",
        "row_savings": f"""WITH {TEXTS}
SELECT batch_id, source, row_no, o AS tokens_original, n AS tokens_optimized, o - n AS savings_tokens,
  {pct("o - n", "o", 1)} AS savings_pct
FROM (SELECT *, {count_pieces("text")} AS o, {count_pieces(rewritten("text"))} AS n FROM texts)""",
        "contract_hints": _row_ids(f"{amount('text')} AS amount_hint, {date('text')} AS date_hint"),
        "report_summary": f"""WITH {REPORTS}
SELECT report_id, {summary("t")} AS resumen, {summary_compact("t")} AS resumen_compact
FROM (SELECT report_id, {strip("mensaje")} AS t FROM reports)""",
        "triage_json": f"""WITH {ANSWERS}
SELECT report_id, coalesce({nn("s")}, 'media') AS severidad,
  coalesce({nn("m")}, {q(lists.UNCLASSIFIED)}) AS modulo_probable,
  coalesce({nn("r")}, substr({nn("t")}, 1, 120), '') AS resumen,
  coalesce({nn("t")}, mensaje) AS texto_original, 'ollama' AS via FROM parsed""",
        "html_escape": """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;') AS html_escaped FROM pages""",
        "auto_reply": f"""WITH {VALID}, {PLAYS},
marked AS (
  SELECT report_id, coalesce(email, '') AS email_usuario, mensaje,
    {severity("low", "full")} AS severidad, {module("low", "full")} AS modulo_probable
  FROM (SELECT *, lower(mensaje) AS low FROM checked)),
{play_of("marked", "played")}
SELECT report_id, email_usuario, contains(email_usuario, '@') AS tiene_email,
  {q(book.SUBJECT.format(brand="Soporte"))} || modulo_probable AS asunto_auto, {reply_body()} AS cuerpo_texto,
  CASE WHEN contains(email_usuario, '@') THEN 'pendiente_envio' ELSE 'sin_email' END AS auto_reply_estado
FROM played""",
        "classify_reviews": classified(REVIEWS),
        "classify_contracts": classified(CONTRACTS),
        "classify_incidents": classified(INCIDENTS),
        "rule_catalog": f"WITH {FEEDBACK} "
        + " UNION ALL ".join(
            f"SELECT {q(p.domain)} AS id, {q(p.label)} AS label, {q(p.description)} AS description,"
            f" {q(','.join(p.result_keys))} AS result_keys,"
            f" (SELECT count({best('text', p)}) FROM feedback) AS n_matched"
            for p in PACKS.values()
        ),
        "report_triage": f"""WITH {REPORTS}
SELECT report_id, {severity("low", "full")} AS severidad, {module("low", "full")} AS modulo_probable,
  {summary("t")} AS resumen, t AS texto_original
FROM (SELECT report_id, {strip("mensaje")} AS t, lower({strip("mensaje")}) AS low FROM reports)""",
        "report_triage_compact": f"""WITH {NESTED}
SELECT report_id, mensaje, email, source, timestamp, page, {severity("low", "compact")} AS severidad,
  {module("low", "compact")} AS modulo_probable, {summary_compact("mensaje")} AS resumen FROM nested""",
        "lot_core": f"WITH {totals()}, {core()} SELECT * FROM core",
        "lot_core_off": f"WITH {totals(False)}, {core(False)} SELECT * FROM core",
        "multi_model_costs": f"""WITH {totals()}
SELECT * EXCLUDE (number), row_number() OVER (PARTITION BY batch_id ORDER BY cost_usd, number)::INT AS position
FROM ({models("tokens_original AS tokens, " + cost("tokens_original", "price_per_1m") + " AS cost_usd")})""",
        "model_compare": f"""WITH {totals()}
SELECT batch_id, id, model, provider, price_per_1m, cost_original_usd, cost_optimized_usd,
  {rounded("cost_original_usd - cost_optimized_usd", 6)} AS savings_usd,
  row_number() OVER (PARTITION BY batch_id ORDER BY cost_optimized_usd, cost_original_usd, number)::INT AS position
FROM ({models(cost("tokens_original", "price_per_1m") + " AS cost_original_usd, " + cost("tokens_optimized", "price_per_1m") + " AS cost_optimized_usd")})""",
        "lot_batch": f"WITH {totals()} {batch_figures('batch_id')} FROM ({PRICED} FROM totals)",
        "projection": f"WITH {totals()} SELECT batch_id, {PROJECTED} FROM ({DAYS} FROM totals)",
        "projection_30d": f"""WITH {totals()}
SELECT batch_id, day, (day * daily)::BIGINT AS cumulative_savings_tokens,
  {cost("day * daily", "price_per_million")} AS cumulative_savings_usd
FROM (SELECT *, trunc(greatest(tokens_original - tokens_optimized, 0) * ({_PER_DAY}))::BIGINT AS daily FROM totals)
CROSS JOIN (SELECT unnest(generate_series(1, 30))::INT AS day)""",
        "break_even": f"""WITH {totals()}
SELECT batch_id, {EVEN.replace("NAME", "items")} FROM ({OVERHEAD} FROM ({MEANS} FROM totals))""",
        "assumptions": f"""WITH {totals()}
SELECT batch_id, price_per_million AS price_per_million_usd, daily_volume, 30::INT AS monthly_multiplier,
  'native' AS tokenizer, optimize_enabled, overhead AS preprocess_tokens_per_item_estimate,
  {q(costs.ASSUMPTION_NOTE)} AS note FROM ({OVERHEAD} FROM ({MEANS} FROM totals))""",
        "type_distribution": f"WITH {distribution(REVIEWS)} SELECT * FROM distribution",
        "type_distribution_contracts": f"WITH {distribution(CONTRACTS)} SELECT * FROM distribution",
        "type_distribution_incidents": f"WITH {distribution(INCIDENTS)} SELECT * FROM distribution",
        "top_types": f"""WITH {distribution(REVIEWS)}
SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, type)::INT AS position FROM distribution
QUALIFY position <= 10""",
        "feedback_csv": f"""WITH {FEEDBACK}
SELECT text, count(*) AS n_rows FROM (SELECT {clean("text")} AS text FROM feedback) WHERE {junk("text")} IS NULL GROUP BY text""",
        "feedback_headerless": f"""WITH items AS (
  SELECT text, {junk("text")} IS NULL AS good FROM (SELECT {clean("text")} AS text FROM benchmark))
SELECT CASE WHEN good THEN 'col_1' END AS column_detected, NULL AS text, count(*) AS n_rows FROM items GROUP BY good
UNION ALL SELECT NULL, text, count(*) FROM items WHERE good GROUP BY text""",
        "strategy_compare": f"WITH {canon()}{strategies('canon', 'exact')}",
        "strategy_compare_near": f"WITH {NEAR}{strategies('near', 'semantic')}",
        "lot_added": f"WITH {totals()}, {core()} SELECT * FROM core",
        "lot_core_near": f"""WITH {near_totals()}, {core()}
SELECT *, 'dictionary' AS optimize_method, 'Fallback diccionario (motor CT2 no disponible)' AS optimize_method_label,
  'semantic' AS dedup_method, 'reviews' AS domain FROM core""",
        "dedup_stats_near": f"""WITH {NEAR}
SELECT batch_id, sum(n_rows)::BIGINT AS input_items, count(*) AS canonical_items,
  (sum(n_rows) - count(*))::BIGINT AS removed_or_merged,
  {pct("(sum(n_rows) - count(*))", "sum(n_rows)", 2)} AS reduction_pct,
  {rounded("1::DOUBLE - count(*)::DOUBLE / sum(n_rows)::DOUBLE", 3)} AS dedup_ratio
FROM near GROUP BY batch_id""",
        "expand_near": f"""WITH {NEAR}
SELECT t.batch_id, t.source, t.row_no, c.canon_source, c.canon_row_no, c.tokens_original, c.tokens_optimized
FROM texts t JOIN moved m USING (batch_id, key)
JOIN canon c ON c.batch_id = t.batch_id AND (c.canon_source, c.canon_row_no) = m.kept""",
        "recalculate": f"""WITH {SCENARIOS}
SELECT * EXCLUDE (mean_o, mean_n, overhead, overhead_usd, saved_usd, frac, day_o, day_n), {EVEN.replace("NAME", "break_even_items")} FROM (
  {OVERHEAD} FROM ({MEANS} FROM (
    {batch_figures("batch_id, scenario_id, optimize_enabled, price_per_million, day_o, day_n")}, {PROJECTED} FROM (
      {DAYS} FROM ({PRICED} FROM scenarios WHERE price_per_million > 0 AND daily_volume >= 1)))))""",
        "stage_counts": f"""WITH {canon()},
used AS (
  SELECT batch_id, sum(n_rows) AS usable, count(*) AS unique_texts,
    sum(CASE WHEN rule IS NOT NULL THEN n_rows ELSE 0 END) AS matched FROM canon GROUP BY batch_id),
counted AS (SELECT batch_id, count(*) AS n FROM feedback GROUP BY batch_id)
SELECT batch_id, unnest(['read', 'usable', 'distinct', 'matched']) AS stage,
  unnest([n, coalesce(usable, 0), coalesce(unique_texts, 0), coalesce(matched, 0)])::BIGINT AS n_rows
FROM counted LEFT JOIN used USING (batch_id)""",
        "report_stream": f"WITH {TRIAGED} SELECT * FROM triaged",
        "report_routes": f"""WITH {TRIAGED}
SELECT 'tracker' AS route, report_id FROM triaged
UNION ALL SELECT 'alerts', report_id FROM triaged WHERE severidad = 'critica'
UNION ALL SELECT 'outbox', report_id FROM triaged WHERE contains(email, '@')
UNION ALL SELECT 'rejected', report_id FROM checked WHERE reject_reason IS NOT NULL""",
        "route_counts": f"""WITH {TRIAGED}
SELECT 'tracker' AS route, count(*) AS n_rows FROM triaged
UNION ALL SELECT 'alerts', count(*) FROM triaged WHERE severidad = 'critica'
UNION ALL SELECT 'outbox', count(*) FROM triaged WHERE contains(email, '@')
UNION ALL SELECT 'rejected', count(*) FROM checked WHERE reject_reason IS NOT NULL""",
        "rejected_reports": f"""WITH {VALID}
SELECT report_id, mensaje, reject_reason FROM checked WHERE reject_reason IS NOT NULL""",
        "junk_rows": f"""SELECT conv_id, turn, c AS text, {junk("c")} AS junk_reason
FROM (SELECT conv_id, turn, {clean("text")} AS c FROM conversations) WHERE {junk("c")} IS NOT NULL""",
        "lot_record": f"""WITH {totals()}, {core()}
SELECT *, 'dictionary' AS optimize_method, 'Fallback diccionario (motor CT2 no disponible)' AS optimize_method_label,
  'exact' AS dedup_method, 'reviews' AS domain FROM core""",
        "tracker_rows": f"""WITH {TRIAGED}
SELECT report_id, timestamp AS fecha, severidad, modulo_probable AS modulo, resumen, texto_original, source
FROM triaged""",
        "alert_text": f"""WITH {TRIAGED}
SELECT report_id, timestamp, '[Soporte][' || severidad || '] ' || modulo_probable AS mail_subject,
  '🚨 Soporte CRÍTICO' || chr(10) || 'Módulo: ' || modulo_probable || chr(10) || 'Resumen: ' || resumen
  || chr(10) || chr(10) || texto_original AS alert_text FROM triaged WHERE severidad = 'critica'""",
    }
