"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlots.functions import text as tx
from textlots.functions.rewrite import dict_rewrite
from textlots.operators import classify as cl
from textlots.operators import costs, dedup, ingest, keyword_index, near_dup, reports, rewrite, tokens
from textlots.packs import CONTRACTS, INCIDENTS, PACKS, REVIEWS, Pack
from textlots.operators.joins import settled
from textlots.plans import inputs, lots, state
from textlots.session import work_dir
from textlots.sources import files
from textlots.streaming import epochs
from textlots.streaming import reports as stream

Query = Callable[[SparkSession, str], DataFrame]

# Rows of a lot that the cap query keeps: the usual limit of one upload.
LOT_ROWS = 50_000


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return lots.ingest(inputs.feedback(spark, d))


# Where the state of lots is stored, by session, table files and what was measured.
_STATES: dict[tuple, str] = {}


def _canon(spark: SparkSession, d: str, pack: Pack = REVIEWS, optimize: bool = True) -> DataFrame:
    """The lots' stored canonical rows: texts are measured once, and all totals derive from that.

    Measured again as soon as the files of the table, or their bytes, are others.
    """
    seen = _seen(spark, d, pack, optimize)
    if seen not in _STATES:
        path = work_dir(spark, "lot-state")
        state.add(lots.analyze(_texts(spark, d), pack, optimize), path)
        _STATES[seen] = path
    return state.load(spark, _STATES[seen])


def _seen(spark: SparkSession, d: str, pack: Pack, optimize: bool) -> tuple:
    given = spark.read.parquet(f"{d}/documents.parquet")
    size = str(given._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return spark.sparkContext.applicationId, tuple(sorted(given.inputFiles())), size, pack.domain, optimize


def _near(spark: SparkSession, d: str) -> DataFrame:
    """The lots' canonical rows after near duplicates of them are counted as copies."""
    near = lots.near_map(_texts(spark, d), inputs.text_vectors(spark, d))
    return settled(state.merged_near(_canon(spark, d), near))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    """From the stored state where there is one; else only what totals need is measured, without any rule."""
    stored = _seen(spark, d, REVIEWS, True) in _STATES
    return costs.lot_totals(_canon(spark, d) if stored else lots.analyze(_texts(spark, d), REVIEWS))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return inputs.table(spark, d, "documents")


# A. sources and sinks


def clean_cell(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", tx.clean(F.col("text")).alias("text_clean"))


def detect_text_column(spark: SparkSession, d: str) -> DataFrame:
    return ingest.detect_by_place(inputs.wide_cells(spark, d))


def union_lots(spark: SparkSession, d: str) -> DataFrame:
    """Usable texts per file after a union of files with different columns."""
    cells = inputs.wide_cells(spark, d)
    return ingest.pick_by_place(cells, ingest.detect_by_place(cells)).groupBy("source").agg(
        F.count("*").alias("n_texts"), F.sum(F.length("text")).alias("n_chars")
    )


def cap_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.feedback(spark, d).select("batch_id", "source", "row_no")
    return ingest.cap_rows(rows, LOT_ROWS)


def source_summary(spark: SparkSession, d: str) -> DataFrame:
    raw = inputs.feedback(spark, d)
    by = ["batch_id", "source"]
    detected = ingest.detect_text_column(raw, by, ["text"])
    return ingest.source_summary(ingest.drop_junk(raw), detected)


def _read_back(fmt: str) -> Query:
    """The lots written out as files of a format, and the cells that the reader finds in them."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        folder = work_dir(spark, f"lots-{fmt}")
        rows = inputs.feedback(spark, d).select(
            F.col("batch_id").alias("lot"), F.col("row_no").alias("doc"), F.col("text").alias("texto")
        )
        files.write_results(rows, folder, fmt, ["lot"])
        cells = files.read_cells(spark, [folder], fmt, "all")
        return cells.select("lot", F.col("doc").cast("bigint").alias("doc_id"), F.col("texto").alias("text"))

    return query


def feedback_csv(spark: SparkSession, d: str) -> DataFrame:
    """The lots as CSV files whose cells hold commas, quotes and line breaks, and the texts read from them."""
    folder = work_dir(spark, "feedback-csv")
    rows = inputs.feedback(spark, d).select("batch_id", F.col("row_no").alias("doc"), F.col("text").alias("texto"))
    files.write_results(rows, folder, "csv")
    texts, _ = files.read_feedback(spark, [folder])
    return texts.groupBy("text").agg(F.count("*").alias("n_rows"))


def feedback_headerless(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as one CSV file each, without a header: the only row is the data."""
    folder = work_dir(spark, "feedback-bare")
    items = inputs.table(spark, d, "benchmark").select("item_id", F.lit("7").alias("number"), "text").repartition("item_id")
    items.write.options(quoteAll=True, escape='"').partitionBy("item_id").csv(folder)
    texts, status = files.read_feedback(spark, [folder])
    columns = status.groupBy("column_detected", F.lit(None).cast("string").alias("text")).agg(F.count("*").alias("n_rows"))
    found = texts.groupBy(F.lit(None).cast("string").alias("column_detected"), "text").agg(F.count("*").alias("n_rows"))
    return columns.unionAll(found)


def result_table(spark: SparkSession, d: str) -> DataFrame:
    return _result_table(spark, d, REVIEWS)


def result_table_contracts(spark: SparkSession, d: str) -> DataFrame:
    return _result_table(spark, d, CONTRACTS)


def _result_table(spark: SparkSession, d: str, pack: Pack) -> DataFrame:
    texts = _texts(spark, d)
    rows = lots.result_rows(texts, lots.analyze(texts, pack, with_text=True), pack)
    return lots.result_table(rows, pack)


def lot_summary(spark: SparkSession, d: str) -> DataFrame:
    return lots.lot_summary(costs.lot_core(_totals(spark, d)))


def results_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = lots.preview(_texts(spark, d), REVIEWS)
    return rows.select(
        "batch_id", "source", "row_no", "position", "results_total", "text", "text_optimized",
        "tokens_original", "tokens_optimized", "classification.error_type",
    )


# B. predicates


def junk_filter(spark: SparkSession, d: str) -> DataFrame:
    cells = inputs.cells(spark, d).withColumnRenamed("cell", "text")
    return (
        ingest.with_junk_reason(cells)
        .groupBy("source", F.coalesce("junk_reason", F.lit("usable")).alias("verdict"))
        .agg(F.count("*").alias("n_cells"), F.sum(F.length("text")).alias("n_chars"))
    )


def junk_rows(spark: SparkSession, d: str) -> DataFrame:
    turns = inputs.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return ingest.junk_rows(turns).select("conv_id", "turn", "text", "junk_reason")


def header_like(spark: SparkSession, d: str) -> DataFrame:
    cells = inputs.cells(spark, d).select("source", tx.clean(F.col("cell")).alias("cell"))
    return cells.groupBy("source", tx.header_like(F.col("cell")).alias("header_like")).agg(
        F.count("*").alias("n_cells")
    )


def report_validate(spark: SparkSession, d: str) -> DataFrame:
    return reports.validate_reports(inputs.reports(spark, d)).select(
        "report_id", "mensaje", "email", "page", F.length("user_agent").alias("agent_chars"), "reject_reason"
    )


def rejected_reports(spark: SparkSession, d: str) -> DataFrame:
    return reports.rejected_reports(inputs.reports(spark, d)).select("report_id", "mensaje", "reject_reason")


def scenario_check(spark: SparkSession, d: str) -> DataFrame:
    checked = costs.validate_scenarios(inputs.scenarios(_totals(spark, d)))
    return checked.select("scenario_id", "reject_reason")


# C. dedup and joins


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_dedup(ingest.drop_junk(inputs.feedback(spark, d))).drop("text")


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_stats(dedup.canonical(_texts(spark, d)))


def dropped_duplicates(spark: SparkSession, d: str) -> DataFrame:
    mapped = dedup.exact_dedup(ingest.drop_junk(inputs.feedback(spark, d)))
    return mapped.where(~F.col("is_canonical")).select("batch_id", "source", "row_no")


def dedup_stats_near(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_stats(_near(spark, d))


def expand_near(spark: SparkSession, d: str) -> DataFrame:
    """Every row with the measures of the row that its near duplicates are kept as."""
    texts = _texts(spark, d)
    near = lots.near_map(texts, inputs.text_vectors(spark, d))
    canon = state.with_near(_canon(spark, d), near)
    payload = ["canon_source", "canon_row_no", "tokens_original", "tokens_optimized"]
    return lots.expand(texts, canon, payload).drop("key", "text")


def vector_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.vector_dedup(inputs.vectors(spark, d))


def expand_results(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    payload = ["canon_source", "canon_row_no", "tokens_original", "tokens_optimized", "text_optimized"]
    return lots.expand(texts, lots.analyze(texts, REVIEWS, with_text=True), payload).drop("key")


def rule_match_long(spark: SparkSession, d: str) -> DataFrame:
    return cl.match_rules(inputs.feedback(spark, d), REVIEWS)


def rule_table_match(spark: SparkSession, d: str) -> DataFrame:
    """A pack kept as a table: a rule per part type, found by the type's first letters."""
    parts = spark.read.parquet(f"{d}/part.parquet")
    # Each type has a rank of its own: how many types sort before it.
    types = parts.groupBy("p_type").agg(F.min("p_size").alias("p_size"))
    table = types.select(
        F.lit("parts").alias("domain"),
        F.dense_rank().over(Window.orderBy("p_type")).alias("rule_order"),
        F.col("p_type").alias("type"),
        F.substring(F.lower("p_type"), 1, 2).alias("keyword"),
        F.create_map(F.lit("severity"), F.col("p_size").cast("string")).alias("attrs"),
    )
    done = cl.classify_by_table(
        inputs.feedback(spark, d), table, "parts", "part_type", {"part_type": "none", "severity": "low"}
    )
    return done.select("batch_id", "source", "row_no", "classification.part_type", "classification.severity")


def rule_index_match(spark: SparkSession, d: str) -> DataFrame:
    """The winning type of each text by a table of thousands of keywords: the words of the benchmark."""
    words = inputs.table(spark, d, "benchmark").select(
        "item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("keyword")
    )
    table = words.groupBy("keyword").agg(F.min("item_id").alias("rule_order")).select(
        F.lit("benchmark").alias("domain"), "rule_order",
        F.concat(F.lit("type_"), F.substring("keyword", 1, 2)).alias("type"), "keyword",
    )
    matches = keyword_index.match_table(inputs.feedback(spark, d), table, "benchmark")
    return keyword_index.winners(matches)


def playbook_join(spark: SparkSession, d: str) -> DataFrame:
    triaged = reports.triage(inputs.reports(spark, d))
    # Every third module name is shortened, so that partial matches occur too.
    short = F.when(F.col("report_id") % 3 == 0, F.substring("modulo_probable", 1, 8)).when(
        F.col("report_id") % 3 == 1, F.concat(F.lit("Módulo "), F.col("modulo_probable"))
    )
    named = triaged.withColumn("modulo_probable", F.coalesce(short, "modulo_probable"))
    return reports.with_playbook(named).select(
        "report_id", "modulo_probable", "playbook", F.size("pasos").alias("n_pasos"),
        F.array_join("pasos", "|").alias("pasos"),
    )


# D. text


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", tx.normalize(F.col("text")).alias("text_norm"))


def token_count(spark: SparkSession, d: str) -> DataFrame:
    return tokens.with_tokens(_documents(spark, d), "text", "tokens").select("doc_id", "tokens")


def dict_rewrite_query(spark: SparkSession, d: str) -> DataFrame:
    return inputs.feedback(spark, d).select(
        "batch_id", "source", "row_no", dict_rewrite(F.col("text")).alias("text_optimized")
    )


def compress_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", tx.compress(F.col("text")).alias("text_short"))


def drop_fillers(texts: Sequence[str]) -> list[str]:
    """A user's batch function: leaves out some filler words."""
    return [t.replace(" the ", " ").replace(" de ", " ").replace(" und ", " ") for t in texts]


def rewrite_with(spark: SparkSession, d: str) -> DataFrame:
    firsts = dedup.canonical(_texts(spark, d), ["text"])
    done = rewrite.rewrite_with(firsts, "text", drop_fillers, method="passthrough")
    return done.select("batch_id", "canon_source", "canon_row_no", "text_optimized", "optimize_method")


def row_savings(spark: SparkSession, d: str) -> DataFrame:
    rows = lots.with_savings(lots.measure(_texts(spark, d), REVIEWS))
    return rows.select(
        "batch_id", "source", "row_no", "tokens_original", "tokens_optimized", "savings_tokens", "savings_pct"
    )


def contract_hints(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return inputs.feedback(spark, d).select(
        "batch_id", "source", "row_no",
        tx.amount_hint(text).alias("amount_hint"), tx.date_hint(text).alias("date_hint"),
    )


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    message = F.col("mensaje")
    return inputs.reports(spark, d).select(
        "report_id", tx.summary(message).alias("resumen"), tx.summary_compact(message).alias("resumen_compact")
    )


def triage_json(spark: SparkSession, d: str) -> DataFrame:
    return reports.parse_triage(inputs.model_answers(spark, d)).drop("response", "message", "mensaje")


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    pages = inputs.table(spark, d, "pages")
    return pages.select("page_id", tx.html_escape(F.col("html")).alias("html_escaped"))


def auto_reply(spark: SparkSession, d: str) -> DataFrame:
    replies = reports.compose_reply(reports.triage(reports.validate_reports(inputs.reports(spark, d))))
    return replies.select(
        "report_id", "email_usuario", "tiene_email", "asunto_auto", "cuerpo_texto", "auto_reply_estado"
    )


# E. classification


def _classify(pack: Pack) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        done = cl.classify(inputs.feedback(spark, d), pack)
        fields = [F.col(f"classification.{k}").alias(k) for k in pack.result_keys]
        return done.select(
            "batch_id", "source", "row_no", *fields,
            F.col("classification._method").alias("method"), F.col("classification._matched").alias("matched"),
        )

    return query


def rule_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The packs on offer, with how many of the texts each of them matches."""
    counts = []
    scored = inputs.feedback(spark, d)
    for domain, pack in PACKS.items():
        scored = cl.with_rule(scored, pack, out=f"rule_{domain}")
    totals = scored.agg(*[F.count(f"rule_{domain}").alias(domain) for domain in PACKS])
    counts = totals.unpivot([], list(PACKS), "id", "n_matched")
    shown = cl.catalog(spark).withColumn("result_keys", F.array_join("result_keys", ","))
    return shown.join(counts, "id")


def _triaged(pack: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        if pack == "compact":
            return reports.triage_compact(inputs.nested_reports(spark, d)).drop("texto_original")
        return reports.triage(inputs.reports(spark, d)).select(
            "report_id", "severidad", "modulo_probable", "resumen", "texto_original"
        )

    return query


# F. totals and costs


def lot_core(spark: SparkSession, d: str) -> DataFrame:
    return costs.lot_core(_totals(spark, d))


def lot_record(spark: SparkSession, d: str) -> DataFrame:
    return costs.lot_record(costs.lot_core(_totals(spark, d)), REVIEWS.domain)


def lot_core_near(spark: SparkSession, d: str) -> DataFrame:
    return costs.lot_record(costs.lot_core(costs.lot_totals(_near(spark, d))), REVIEWS.domain, dedup_method="semantic")


def lot_added(spark: SparkSession, d: str) -> DataFrame:
    """Totals of lots whose files come in three additions, the first two merged before the third."""
    path = work_dir(spark, "lot-added")
    texts = _texts(spark, d)
    for step in range(3):
        # Every source is a file, and belongs to one of the additions.
        some = texts.where(F.pmod(F.xxhash64("source"), F.lit(3)) == step)
        state.add(lots.analyze(some, REVIEWS), path)
        if step == 1:
            state.compact(spark, path)
    return costs.lot_core(costs.lot_totals(state.load(spark, path)))


def lot_core_off(spark: SparkSession, d: str) -> DataFrame:
    canon = lots.analyze(_texts(spark, d), REVIEWS, optimize=False)
    return costs.lot_core(costs.lot_totals(canon, optimize=False))


def multi_model_costs(spark: SparkSession, d: str) -> DataFrame:
    return costs.model_costs(_totals(spark, d))


def model_compare(spark: SparkSession, d: str) -> DataFrame:
    return costs.model_compare(_totals(spark, d))


def lot_batch(spark: SparkSession, d: str) -> DataFrame:
    return costs.lot_batch(_totals(spark, d))


def projection(spark: SparkSession, d: str) -> DataFrame:
    return costs.projection(_totals(spark, d))


def projection_30d(spark: SparkSession, d: str) -> DataFrame:
    return costs.projection_30d(_totals(spark, d))


def break_even(spark: SparkSession, d: str) -> DataFrame:
    return costs.break_even(_totals(spark, d))


def assumptions(spark: SparkSession, d: str) -> DataFrame:
    return costs.assumptions(_totals(spark, d))


def _distribution(pack: Pack) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return costs.type_distribution(_canon(spark, d, pack), pack)

    return query


def top_types(spark: SparkSession, d: str) -> DataFrame:
    return costs.top_types(_distribution(REVIEWS)(spark, d))


def strategy_compare(spark: SparkSession, d: str) -> DataFrame:
    return costs.strategy_compare(_canon(spark, d))


def strategy_compare_near(spark: SparkSession, d: str) -> DataFrame:
    return costs.strategy_compare(_near(spark, d), dedup_method="semantic")


def recalculate(spark: SparkSession, d: str) -> DataFrame:
    return costs.recalculate(inputs.scenarios(_totals(spark, d)))


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return costs.stage_counts(lots.stages(inputs.feedback(spark, d), REVIEWS))


# H. the report channel


def report_stream(spark: SparkSession, d: str) -> DataFrame:
    """Run the stream over the table to its end; then read what it wrote."""
    out = work_dir(spark, "report-stream")
    query = stream.start_triage(
        inputs.report_source(spark, d), f"{out}/table", f"{out}/checkpoint", available_now=True
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/table")


def _routed(spark: SparkSession, d: str) -> dict[str, str]:
    out = work_dir(spark, "report-routes")
    tables = {name: f"{out}/{name}" for name in stream.ROUTES}
    source = inputs.report_source(spark, d)
    stream.start_routes(source, tables, f"{out}/checkpoint", available_now=True).awaitTermination()
    return tables


def report_routes(spark: SparkSession, d: str) -> DataFrame:
    """Run the routing job to its end; then list which report reached which table."""
    tables = _routed(spark, d)
    epochs.compact(spark, tables["tracker"])
    parts = [
        epochs.read_epochs(spark, path).select(F.lit(name).alias("route"), "report_id")
        for name, path in tables.items()
    ]
    return files.unite(*parts)


def route_counts(spark: SparkSession, d: str) -> DataFrame:
    """Run the routing job to its end; then the rows that its epochs counted while they were written."""
    tables = _routed(spark, d)
    epochs.compact(spark, tables["tracker"])
    counts = [epochs.epoch_counts(spark, path).withColumn("route", F.lit(name)) for name, path in tables.items()]
    return files.unite(*counts).groupBy("route").agg(F.sum("n_rows").alias("n_rows"))


def tracker_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.tracker_rows(reports.submit(inputs.reports(spark, d)))


def alert_text(spark: SparkSession, d: str) -> DataFrame:
    triaged = reports.submit(inputs.reports(spark, d))
    return stream.route(triaged, "alerts", "Soporte")


QUERIES: dict[str, Query] = {
    "clean_cell": clean_cell,
    "detect_text_column": detect_text_column,
    "union_lots": union_lots,
    "cap_rows": cap_rows,
    "source_summary": source_summary,
    "read_back_csv": _read_back("csv"),
    "read_back_json": _read_back("json"),
    "read_back_parquet": _read_back("parquet"),
    "feedback_csv": feedback_csv,
    "feedback_headerless": feedback_headerless,
    "result_table": result_table,
    "result_table_contracts": result_table_contracts,
    "lot_summary": lot_summary,
    "results_preview": results_preview,
    "junk_filter": junk_filter,
    "junk_rows": junk_rows,
    "header_like": header_like,
    "report_validate": report_validate,
    "rejected_reports": rejected_reports,
    "scenario_check": scenario_check,
    "exact_dedup": exact_dedup,
    "dedup_stats": dedup_stats,
    "dropped_duplicates": dropped_duplicates,
    "dedup_stats_near": dedup_stats_near,
    "expand_near": expand_near,
    "vector_dedup": vector_dedup,
    "expand_results": expand_results,
    "rule_match_long": rule_match_long,
    "rule_table_match": rule_table_match,
    "rule_index_match": rule_index_match,
    "playbook_join": playbook_join,
    "normalize_text": normalize_text,
    "token_count": token_count,
    "dict_rewrite": dict_rewrite_query,
    "compress_text": compress_text,
    "rewrite_with": rewrite_with,
    "row_savings": row_savings,
    "contract_hints": contract_hints,
    "report_summary": report_summary,
    "triage_json": triage_json,
    "html_escape": html_escape,
    "auto_reply": auto_reply,
    "classify_reviews": _classify(REVIEWS),
    "classify_contracts": _classify(CONTRACTS),
    "classify_incidents": _classify(INCIDENTS),
    "rule_catalog": rule_catalog,
    "report_triage": _triaged("full"),
    "report_triage_compact": _triaged("compact"),
    "lot_core": lot_core,
    "lot_core_off": lot_core_off,
    "lot_core_near": lot_core_near,
    "lot_added": lot_added,
    "lot_record": lot_record,
    "multi_model_costs": multi_model_costs,
    "model_compare": model_compare,
    "lot_batch": lot_batch,
    "projection": projection,
    "projection_30d": projection_30d,
    "break_even": break_even,
    "assumptions": assumptions,
    "type_distribution": _distribution(REVIEWS),
    "type_distribution_contracts": _distribution(CONTRACTS),
    "type_distribution_incidents": _distribution(INCIDENTS),
    "top_types": top_types,
    "strategy_compare": strategy_compare,
    "strategy_compare_near": strategy_compare_near,
    "recalculate": recalculate,
    "stage_counts": stage_counts,
    "report_stream": report_stream,
    "report_routes": report_routes,
    "route_counts": route_counts,
    "tracker_rows": tracker_rows,
    "alert_text": alert_text,
}
