"""The stored state of lots, and near duplicates inside a lot."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textlots.operators import costs, dedup
from textlots.packs import CONTRACTS, REVIEWS
from textlots.plans import lots, registry, state
from textlots.session import work_dir

SCHEMA = "batch_id string, source string, row_no bigint, text string"
ROWS = [
    ("m", "b.csv", 1, "La app se cierra sola al abrir la galería"),
    ("m", "b.csv", 2, "El cobro de la suscripción salió dos veces"),
    ("n", "b.csv", 1, "la app se cierra sola al abrir la galería"),
    ("m", "a.csv", 7, "  LA APP SE CIERRA SOLA AL ABRIR LA GALERÍA "),
    ("m", "a.csv", 8, "Se congela la pantalla y no responde"),
    (None, "a.csv", 1, "Se congela la pantalla y no responde"),
    ("m", None, 3, "El cobro de la suscripción salió dos veces"),
    ("m", "c.csv", 1, None), ("m", "c.csv", 2, ""), ("m", "c.csv", 2, "El cobro de la suscripción salió dos veces"),
]


def analyzed(spark, rows, **how):
    return lots.analyze(lots.ingest(spark.createDataFrame(rows, SCHEMA)), REVIEWS, **how)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("cuts", [(10,), (3, 6), (1, 2, 5, 9), (0, 10)])
def test_additions_equal_one_run(spark, cuts):
    path, start = work_dir(spark, "state"), 0
    for end in [*cuts, len(ROWS)]:
        state.add(analyzed(spark, ROWS[start:end]), path)
        start = end
    whole = analyzed(spark, ROWS)
    assert found(state.load(spark, path)) == found(whole)
    state.compact(spark, path)
    assert found(state.load(spark, path)) == found(whole)
    assert len(state._versions(spark, path)) == 1
    totals = costs.lot_totals(state.load(spark, path))
    assert found(costs.lot_core(totals)) == found(costs.lot_core(costs.lot_totals(whole)))


def test_only_committed_parts_are_read(spark):
    path = work_dir(spark, "state")
    with pytest.raises(ValueError, match="no lot was added"):
        state.load(spark, path)
    state.add(analyzed(spark, ROWS[:3]), path)
    before = found(state.load(spark, path))
    held = state.load(spark, path)
    # An addition that failed before its log entry leaves a part behind.
    analyzed(spark, ROWS[3:]).write.parquet(f"{path}/parts/lost")
    assert found(state.load(spark, path)) == before
    # Two writers cannot take the same version.
    with pytest.raises(Exception, match="(?i)exists"):
        state._commit(spark, path, 1, ["other"], "x")
    state.add(analyzed(spark, ROWS[3:]), path)
    state.compact(spark, path)
    assert found(held) == before
    with pytest.raises(ValueError, match="holds"):
        state.add(lots.analyze(lots.ingest(spark.createDataFrame(ROWS, SCHEMA)), CONTRACTS), path)


def test_totals_from_a_state_read_no_text(spark, small):
    registry.QUERIES["type_distribution"](spark, small)
    for name in ("lot_core", "type_distribution", "strategy_compare", "model_compare", "recalculate"):
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and "text:string" not in plan


def near(spark, moves):
    rows = [(b, s, n, ks, kn, (s, n) == (ks, kn), "semantic") for b, s, n, ks, kn in moves]
    return spark.createDataFrame(
        rows, "batch_id string, source string, row_no bigint, canon_source string, canon_row_no bigint, is_canonical boolean, method string"
    )


def test_near_duplicates_count_as_copies(spark):
    texts = [("m", "a", i, f"texto número {'x' * i} de la prueba") for i in range(6)]
    texts += [("m", "b", i, texts[i][3].upper()) for i in range(6)] + [("n", "a", 0, texts[0][3])]
    moves = near(spark, [("m", "a", 3, "a", 1), ("m", "a", 4, "a", 1), ("m", "a", 1, "a", 1), ("m", "a", 5, "a", 2), ("m", "z", 9, "a", 0)])
    canon = analyzed(spark, texts)
    merged = analyzed(spark, texts, near=moves)
    rows = {(r.batch_id, r.canon_row_no): r for r in merged.collect()}
    assert {place: r.n_rows for place, r in rows.items()} == {("m", 0): 2, ("m", 1): 6, ("m", 2): 4, ("n", 0): 1}
    own = {(r.batch_id, r.canon_row_no): r for r in canon.collect()}
    assert all(r.tokens_original == own[place].tokens_original and r.key == own[place].key for place, r in rows.items())
    stats = {r.batch_id: r for r in dedup.dedup_stats(merged).collect()}
    assert (stats["m"].input_items, stats["m"].canonical_items) == (12, 3)
    # Each exact text still finds its kept row.
    every = state.with_near(canon, moves)
    assert sorted((r.batch_id, r.n_rows, r.canon_row_no) for r in every.collect()) == sorted(
        [("m", 2, 0), ("m", 2, 1), ("m", 2, 2), ("m", 2, 1), ("m", 2, 1), ("m", 2, 2), ("n", 1, 0)]
    )
    assert every.columns == canon.columns and merged.columns == canon.columns
    unmoved = analyzed(spark, texts, near=moves.limit(0))
    assert found(unmoved) == found(canon)


def test_near_map_compares_first_rows_only(spark):
    texts = lots.ingest(spark.createDataFrame([("m", "a", i, f"un texto {'largo ' * (i % 3)}de prueba") for i in range(6)], SCHEMA))
    vectors = spark.createDataFrame(
        [("m", "a", i, [1.0, 0.01 * i]) for i in range(6)], "batch_id string, source string, row_no bigint, embedding array<double>"
    )
    rows = lots.near_map(texts, vectors).collect()
    assert sorted((r.row_no, r.canon_row_no) for r in rows) == [(0, 0), (1, 0), (2, 0)]
    compared = costs.strategy_compare(lots.analyze(texts, REVIEWS, near=lots.near_map(texts, vectors)), dedup_method="semantic")
    last = compared.where(F.col("strategy") == "c_semantic_dedup").first()
    assert (last.method, last.items_before, last.items_after, last.is_primary) == ("semantic", 6, 1, False)
    assert [r.strategy for r in compared.where("is_primary").collect()] == ["b_ctranslate2"]
    off = costs.strategy_compare(lots.analyze(texts, REVIEWS, optimize=False), optimize=False)
    assert off.where("is_primary").count() == 0 and off.where(F.col("note") == costs.NOTE_OFF).count() == 1
