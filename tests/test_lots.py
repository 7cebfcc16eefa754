"""Ingest, dedup, near duplicates, costs and row tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlots.operators import costs, dedup, ingest, near_dup
from textlots.packs import CONTRACTS, REVIEWS
from textlots.plans import lots
from textlots.sources import files

LOT = "batch_id string, source string, row_no bigint, text string"


def lot(spark, rows):
    return spark.createDataFrame(rows, LOT)


def test_header_scores():
    assert ingest.header_score("mensaje_texto") == 400
    assert ingest.header_score("Reseña") == 100
    assert ingest.header_score("id") == 0


def test_detection_prefers_header_words_then_length_then_order(spark):
    rows = [("a", "Texto largo, con mucha información aquí.", "corto, sí señor", "x"), ("b", "12", "34", "5")]
    df = spark.createDataFrame(rows, "source string, otra string, comentario string, tercera string")
    found = {r.source: (r.column_detected, r.n_texts) for r in ingest.detect_text_column(df).collect()}
    assert found == {"a": ("comentario", 1), "b": (None, 0)}
    tie = spark.createDataFrame([("a", "igual de largo.", "igual de largo.")], "source string, p string, q string")
    assert ingest.detect_text_column(tie).first().column_detected == "p"


def test_caps_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for batch in ("x", "y"):
        for source in ("f1", "f2", "f3", "f4"):
            # Row numbers far apart, so that files span several ranges.
            numbers = sorted(rng.choice(100_000, size=int(rng.integers(1, 60)), replace=False).tolist())
            rows += [(batch, source, int(n), "t") for n in numbers]
    df = lot(spark, rows)
    for lot_cap, file_cap in ((50, None), (30, 10), (1000, None), (1, 1), (7, 1000)):
        kept = []
        for batch in ("x", "y"):
            left = lot_cap
            for source in ("f1", "f2", "f3", "f4"):
                own = [r for r in rows if r[:2] == (batch, source)][: file_cap or lot_cap][:left]
                kept += [r[:3] for r in own]
                left -= len(own)
        got = ingest.cap_rows(df, lot_cap, file_cap).select("batch_id", "source", "row_no").collect()
        assert sorted(map(tuple, got)) == sorted(kept)


def brute_dedup(rows):
    first = {}
    for batch, source, row_no, text in sorted(rows, key=lambda r: r[:3]):
        first.setdefault((batch, text.strip().lower()), (source, row_no))
    return sorted((b, s, n, *first[b, t.strip().lower()]) for b, s, n, t in rows)


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_exact_dedup_with_and_without_hot_keys(spark, hot_rows):
    rng = np.random.default_rng(12)
    words = ["Hola", "hola ", "HOLA", "otro", "único", " Otro"]
    rows = [
        (f"b{rng.integers(2)}", f"s{rng.integers(3)}", i, words[rng.choice(6, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1])])
        for i in range(400)
    ] + [("b0", "s9", 1000 + i, f"texto {i}") for i in range(100)]
    done = dedup.exact_dedup(lot(spark, rows), hot_rows=hot_rows)
    got = done.select("batch_id", "source", "row_no", "canon_source", "canon_row_no").collect()
    assert sorted(map(tuple, got)) == brute_dedup(rows)
    assert done.where("is_canonical").count() == len({r[0] + r[3].strip().lower() for r in rows})


def test_hot_rows_are_spread_over_partitions(spark):
    """The rows of one dominant text must not end in one task of the join."""
    rows = spark.range(40_000).select(
        F.lit("b").alias("batch_id"), F.lit("s").alias("source"), F.col("id").alias("row_no"),
        F.when(F.col("id") % 3 > 0, "igual").otherwise(F.col("id").cast("string")).alias("text"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = dedup.exact_dedup(rows, hot_rows=1000)
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / len(sizes)


def brute_near(vectors, threshold):
    kept, owner = [], []
    for i, v in enumerate(vectors):
        hit = next((k for k in kept if v @ vectors[k] >= threshold), None)
        owner.append(i if hit is None else hit)
        if hit is None:
            kept.append(i)
    return owner


def clusters(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    vectors = centres[rng.integers(10, size=n)] + rng.normal(scale=0.25, size=(n, dim))
    vectors[n // 2 :: 7] = vectors[0]
    return vectors.astype(np.float32)


@pytest.mark.parametrize("cell_rows,first", [(7, 1), (4096, 8), (25, 3)])
def test_near_dedup_equals_brute_force(spark, cell_rows, first):
    raw = {"a": clusters(1, 150), "b": clusters(2, 60), "small": clusters(3, 20)}
    rows = [(b, "v", i, [float(x) for x in v]) for b, m in raw.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "batch_id string, source string, row_no bigint, embedding array<float>")
    got = {}
    for r in near_dup.vector_dedup(df, cell_rows=cell_rows, first=first).collect():
        got.setdefault(r.batch_id, {})[r.row_no] = (r.canon_row_no, r.method, r.is_canonical)
    for batch, matrix in raw.items():
        unit = matrix.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        expected = brute_near(unit, 0.92)
        assert [got[batch][i] for i in range(len(matrix))] == [(e, "semantic", e == i) for i, e in enumerate(expected)]


def test_near_dedup_chain_keeps_first(spark):
    """a~b and b~c but not a~c: b goes to a, c stays."""
    turn = [0.0, 0.35, 0.70]
    rows = [("l", "v", i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(turn)]
    df = spark.createDataFrame(rows, "batch_id string, source string, row_no bigint, embedding array<float>")
    done = near_dup.vector_dedup(df).orderBy("row_no").collect()
    assert [r.canon_row_no for r in done] == [0, 0, 2]


def near_rows(spark, lots):
    """Kept row per lot and row of {lot: vectors}."""
    rows = [(b, "v", i, v if v is None else [float(x) for x in v]) for b, m in lots.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "batch_id string, source string, row_no bigint, embedding array<float>")


def kept_rows(df, **how):
    got = {}
    for r in near_dup.vector_dedup(df, **how).collect():
        got.setdefault(r.batch_id, {})[r.row_no] = r.canon_row_no
    return {lot: [rows[i] for i in range(len(rows))] for lot, rows in got.items()}


def expected(matrix):
    unit = np.asarray(matrix, dtype=np.float32).astype(np.float64)
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    return brute_near(unit / np.where(norms == 0, 1, norms), 0.92)


def turned(angles):
    return np.stack([np.cos(angles), np.sin(angles)], axis=1)


def test_near_dedup_of_pairs_chains_and_dense_clusters(spark):
    rng = np.random.default_rng(5)
    dense = np.concatenate([rng.normal(size=(3, 6))[rng.integers(3, size=120)] + rng.normal(scale=0.02, size=(120, 6)), rng.normal(size=(30, 6))])
    lots = {
        "pairs": np.repeat(rng.normal(size=(40, 8)), 2, axis=0) + rng.normal(scale=0.01, size=(80, 8)),
        "triples": np.tile(rng.normal(size=(20, 8)), (3, 1)) + rng.normal(scale=0.01, size=(60, 8)),
        "chain": turned(np.arange(16) * 0.35),
        "mixed chain": turned(rng.permutation(16) * 0.35),
        "dense": rng.permutation(dense),
    }
    df = near_rows(spark, lots)
    wanted = {lot: expected(matrix) for lot, matrix in lots.items()}
    assert kept_rows(df) == wanted
    assert kept_rows(df, cell_rows=10, first=2) == wanted


def test_near_dedup_of_odd_vectors(spark):
    odd = [[0, 0], [0, 0], None, None, [1, 0, 0], [1, 0], [2, 0], [float("nan"), 1], [1, 0, 0.1], [], [0.9, 0.1]]
    assert kept_rows(near_rows(spark, {"l": odd})) == {"l": [0, 0, 2, 2, 4, 5, 5, 7, 4, 9, 5]}
    assert kept_rows(near_rows(spark, {"l": [[1.0]]}).limit(0)) == {}


def test_near_dedup_rounds_do_not_grow_with_the_lot(spark, monkeypatch):
    """Comparisons and settling rounds of lots of a few hundred and of some thousand rows in many cells."""
    rounds = {}
    for n in (300, 2400):
        counts = rounds[n] = {"compared": 0, "settled": 0}

        def counted(name, function, counts=counts):
            def run(*args):
                counts[name] += 1
                return function(*args)

            return run

        with monkeypatch.context() as patch:
            patch.setattr(near_dup, "_listed", counted("compared", near_dup._listed))
            patch.setattr(near_dup, "_with_states", counted("settled", near_dup._with_states))
            matrix = np.random.default_rng(n).normal(size=(n // 3, 12)).repeat(3, axis=0)
            matrix += np.random.default_rng(n + 1).normal(scale=0.02, size=matrix.shape)
            assert kept_rows(near_rows(spark, {"l": matrix}), cell_rows=n // 12) == {"l": expected(matrix)}
    assert rounds[300] == rounds[2400] == {"compared": 1, "settled": 1}


def spread_vectors(n, dim=64):
    return np.random.default_rng(n).normal(size=(n, dim)).astype(np.float32)


def test_rows_without_neighbourhoods_travel_a_few_times_only(spark, monkeypatch):
    """Random vectors are guests of every cell, so a lot must have few cells."""
    copies = []
    listed = near_dup._listed

    def counted(rows, candidates, *args):
        copies.append(candidates.agg(F.sum(F.size("_cells"))).first()[0])
        return listed(rows, candidates, *args)

    monkeypatch.setattr(near_dup, "_listed", counted)
    n = 10_000
    done = near_dup.vector_dedup(near_rows(spark, {"l": spread_vectors(n)}))
    assert done.where("is_canonical").count() == n and copies == [n]


@pytest.mark.parametrize("cell_rows,dealt", [(20, True), (4096, False)])
def test_pairs_of_blocks_are_dealt_to_tasks_of_their_number(spark, cell_rows, dealt):
    """A cell of many blocks takes as many tasks, however few partitions a shuffle has."""
    by = ["batch_id", "_dim"]
    rows = near_rows(spark, {"l": spread_vectors(400, 8)}).select(
        "batch_id", F.lit(8).alias("_dim"), near_dup.vector_key(F.col("embedding")).alias("key"),
        F.col("source").alias("canon_source"), F.col("row_no").alias("canon_row_no"), "embedding",
        F.lit(0).alias("_home"), F.array(F.lit(0)).alias("_cells"),
    )
    found = near_dup._listed(rows, rows, "embedding", by, 0.92, 8, cell_rows)
    # 20 blocks of members by 5 of candidates.
    assert ("100), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()) == dealt
    assert found.count() == 400


def test_comparison_holds_small_products_and_is_exact_at_the_threshold():
    """Products of a block never stand whole in memory; single precision decides nothing near the threshold."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3_000, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    # Earlier rows within 1e-9 of the threshold, above and below, and one crowd of copies.
    cos = 0.92 + np.where(np.arange(3_000) % 2, 1e-9, -1e-9)[:, None]
    matrix = np.concatenate([cos * base + np.sqrt(1 - cos**2) * side, base, np.repeat(base[:1], 4_000, axis=0)])
    matrix *= rng.uniform(0.5, 2, size=(len(matrix), 1))
    place = rng.permutation(len(matrix))
    table = pa.table({
        "canon_source": ["v"] * len(matrix), "canon_row_no": np.arange(len(matrix)), "embedding": list(matrix),
    }).take(place)
    tracemalloc.start()
    found, counts = near_dup._earlier(table, table, "embedding", 0.92, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    got = np.split(table["canon_row_no"].to_numpy()[found], np.cumsum(counts)[:-1])
    for row, hits in zip(place, got):
        assert list(hits) == list(np.flatnonzero(unit[:row] @ unit[row] >= 0.92)[:3])


def totals(spark, tokens, optimized, items, price=2.5, volume=10_000, enabled=True):
    return spark.createDataFrame(
        [("l", tokens, optimized, items, enabled, price, volume)],
        "batch_id string, tokens_original bigint, tokens_optimized bigint, item_count bigint,"
        " optimize_enabled boolean, price_per_million double, daily_volume bigint",
    )


def test_projection_example(spark):
    row = costs.projection(totals(spark, 7159, 6040, 500)).first()
    assert (row.tokens_day_original, row.tokens_day_optimized) == (143180, 120800)
    assert (row.savings_tokens_day, row.savings_tokens_month) == (22380, 671400)
    days = costs.projection_30d(totals(spark, 7159, 6040, 500)).orderBy("day").collect()
    assert len(days) == 30 and days[29].cumulative_savings_tokens == 22380 * 30


def test_cost_example(spark):
    row = costs.lot_core(totals(spark, 1000, 0, 1).withColumn("unique_count", F.lit(1))).first()
    assert row.cost_savings_usd == 0.0025


def test_savings_are_clamped_only_in_the_batch_view(spark):
    worse = totals(spark, 100, 130, 10)
    assert costs.lot_core(worse.withColumn("unique_count", F.lit(1))).first().savings_tokens == -30
    batch = costs.lot_batch(worse).first()
    assert batch.savings_tokens == 0 and batch.cost_savings_usd < 0
    assert costs.projection(worse).first().savings_tokens_day == -30_000
    assert costs.projection_30d(worse).first().cumulative_savings_tokens == 0


def break_even(original, optimized, items, price):
    mean_o, mean_n = original / max(items, 1), optimized / max(items, 1)
    overhead = max(int(mean_o * 0.15), 5)
    cost = round(overhead / 1e6 * price, 6)
    saved = round(max(mean_o - mean_n, 0) / 1e6 * price, 6)
    if saved <= 0:
        return None, None
    share = (mean_o - mean_n) / max(mean_o, 1)
    return max(1, int(cost / saved)), int(overhead / share) if share > 0 else None


def test_break_even(spark):
    for case in ((7159, 6040, 500, 2.5), (7159, 7159, 500, 2.5), (100, 130, 10, 2.5), (90_000, 10_000, 7, 0.27), (0, 0, 1, 2.5)):
        row = costs.break_even(totals(spark, *case)).first()
        assert (row["items"], row.tokens_per_item) == break_even(*case)
    texts = [
        costs.break_even(totals(spark, 10, n, 1, enabled=e)).first().recommendation
        for n, e in ((5, True), (5, False), (10, True))
    ]
    assert texts == [costs.ADVICE_SAVES, costs.ADVICE_OFF, costs.ADVICE_NONE]


def test_models_are_ranked_by_cost(spark):
    rows = costs.model_compare(totals(spark, 7159, 6040, 500)).orderBy("position").collect()
    assert [r.id for r in rows][:2] == ["gemini-2-flash", "gpt-4o-mini"] and len(rows) == 6
    assert rows[0].cost_optimized_usd == round(6040 / 1e6 * 0.10, 6)
    none = costs.model_costs(totals(spark, 0, 0, 1)).orderBy("position").collect()
    assert [r.id for r in none] == [p[0] for p in costs.PRICES]


def test_bad_scenarios_are_refused(spark):
    good = totals(spark, 10, 5, 1).withColumn("scenario_id", F.lit("ok"))
    bad = totals(spark, 10, 5, 0).withColumn("scenario_id", F.lit("bad"))
    both = good.unionByName(bad)
    reasons = {r.scenario_id: r.reject_reason for r in costs.validate_scenarios(both).collect()}
    assert reasons == {"ok": None, "bad": "item_count below 1"}
    assert [r.scenario_id for r in costs.recalculate(both).collect()] == ["ok"]


ROWS = [
    ("l", "a", 1, "La app se cierra sola, siempre."),
    ("l", "a", 2, "LA APP SE CIERRA SOLA, SIEMPRE."),
    ("l", "b", 1, "El monto es 300 USD."),
    ("l", "b", 2, "ab"),
]


def test_result_table(spark):
    texts = lots.ingest(lot(spark, ROWS))
    for optimize, flag in ((True, "si"), (False, "no")):
        canon = lots.analyze(texts, CONTRACTS, optimize, with_text=True)
        rows = lots.result_rows(texts, canon, CONTRACTS, optimize)
        table = lots.result_table(rows, CONTRACTS).orderBy("source_file", "row_no").collect()
        assert [(r.source_file, r.row_no) for r in table] == [("a", 1), ("a", 2), ("b", 1)]
        assert table[1].texto_original == ROWS[1][3] and table[1].texto_optimizado == table[0].texto_optimizado
        assert table[0].tokens_original == table[1].tokens_original
        assert {r.optimizado for r in table} == {flag}
        assert (table[0].clause_type, table[0].amount_hint) == ("general", "")
        assert (table[2].clause_type, table[2].amount_hint) == ("payment", "300 USD")
        if not optimize:
            assert {r.ahorro_tokens for r in table} == {0} and {r.texto_optimizado for r in table} == {""}


def test_user_rewrite_gives_the_same_rows_by_the_other_way_round(spark):
    texts = lots.ingest(lot(spark, ROWS))

    def first_word(batch):
        return [t.split()[0] for t in batch]

    canon = lots.analyze(texts, REVIEWS, batch_fn=first_word, with_text=True)
    rows = lots.result_rows(texts, canon, REVIEWS).orderBy("source", "row_no").collect()
    assert [(r.text_optimized, r.tokens_optimized, r.optimize_method) for r in rows] == [
        ("La", 1, "ctranslate2"), ("La", 1, "ctranslate2"), ("El", 1, "ctranslate2"),
    ]
    native = lots.analyze(texts, REVIEWS).select("key", "tokens_original", "rule")
    assert sorted(map(repr, native.collect())) == sorted(
        map(repr, canon.select("key", "tokens_original", "rule").collect())
    )


def test_preview_is_cut_and_counted(spark):
    texts = lots.ingest(lot(spark, ROWS))
    rows = lots.preview(texts, REVIEWS, n=2).orderBy("position").collect()
    assert [(r.source, r.row_no, r.position, r.results_total) for r in rows] == [("a", 1, 1, 3), ("a", 2, 2, 3)]
    assert rows[0].classification.error_type == "crash"


def test_csv_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,comentario\n1,"La app falla, siempre."\n2,corto\n3,"Otra queja, de verdad."\n')
    (tmp_path / "b.csv").write_text('id,comentario\n9,"Un texto más, aquí."\n')
    (tmp_path / "broken.csv").write_text("id,nota\n1\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "broken.csv")]
    texts, found = files.read_feedback(spark, paths, "csv", "lot")
    got = [(r.source, r.text) for r in texts.orderBy("source", "row_no").collect()]
    assert got == [("a.csv", "La app falla, siempre."), ("a.csv", "Otra queja, de verdad."), ("b.csv", "Un texto más, aquí.")]
    columns = {r.source: r.column_detected for r in found.collect()}
    assert columns["a.csv"] == "comentario" and columns["broken.csv"] is None
    only = tmp_path / "bare.csv"
    only.write_text('"La única fila, sin cabecera."\n')
    texts, found = files.read_feedback(spark, [str(only)], "csv", "lot")
    assert [r.text for r in texts.collect()] == ["La única fila, sin cabecera."]
    assert found.first().column_detected == "col_0"


def test_rows_keep_file_order(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("comentario\n" + "".join(f'"Queja número {i}, con texto."\n' for i in range(20_000)))
    texts, _ = files.read_feedback(spark, [str(path)], "csv", "lot")
    order = [int(r.text.split()[2].rstrip(",")) for r in texts.orderBy("row_no").collect()]
    assert order == list(range(20_000))


def test_json_parquet_and_union(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"texto": "Un texto json, bueno.", "n": 1}\nroto{\n')
    texts, found = files.read_feedback(spark, [str(tmp_path / "j.json")], "json", "lot")
    assert [r.text for r in texts.collect()] == ["Un texto json, bueno."]
    spark.createDataFrame([("Texto parquet, también.",)], "nota string").write.parquet(str(tmp_path / "p"))
    more, _ = files.read_feedback(spark, [str(tmp_path / "p")], "parquet", "lot")
    assert files.unite(texts, more).count() == 2
    with pytest.raises(ValueError):
        files.read_feedback(spark, ["x"], "xlsx")


def test_admission(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("x")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "big.csv").write_text("y" * 50)
    (tmp_path / "doc.pdf").write_text("z")
    status = {r.source: r.error for r in files.admit_files(
        spark, str(tmp_path), [".csv"], 10, expected=["ok.csv", "none.csv"]).collect()}
    assert status["ok.csv"] is None and status["none.csv"].startswith("empty or missing")
    assert status["big.csv"].startswith("big.csv exceeds") and status["doc.pdf"].startswith("type not allowed")


def test_write_replaces_only_its_lots(spark, tmp_path):
    path = str(tmp_path / "out")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "batch_id string, n int")
    files.write_results(table, path)
    files.write_results(table.where("batch_id = 'b'").withColumn("n", F.lit(5)), path)
    assert sorted((r.batch_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5)]


def test_observed_counts(spark):
    df, observation = files.observed(spark.range(7), "seen")
    df.collect()
    assert observation.get == {"n_rows": 7}


def test_stage_counts_of_a_single_pass(spark):
    good = "La app se cierra sola al abrir la foto"
    rows = [("a", "f", i, text) for i, text in enumerate([good, good.upper(), "ab", None, "Texto neutro, nada más aquí", ""])]
    rows += [("junk", "f", 0, "12/05/2023"), ("junk", "g", None, None)]
    raw = spark.createDataFrame(rows, "batch_id string, source string, row_no bigint, text string")

    def counts(df):
        return {(r.batch_id, r.stage): r.n_rows for r in costs.stage_counts(lots.stages(df, REVIEWS)).collect()}

    assert counts(raw) == {
        ("a", "read"): 6, ("a", "usable"): 3, ("a", "distinct"): 2, ("a", "matched"): 2,
        ("junk", "read"): 2, ("junk", "usable"): 0, ("junk", "distinct"): 0, ("junk", "matched"): 0,
    }
    assert counts(raw.limit(0)) == {}
    repeated = raw.crossJoin(spark.range(50).select(F.lit("x").alias("source_file")))  # clashing extra columns
    assert counts(repeated)["a", "read"] == 300 and counts(repeated)["a", "distinct"] == 2
