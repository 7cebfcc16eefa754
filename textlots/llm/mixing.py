"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is its weight's share of all words, at most ``MAX_REPEATS`` times its own
size; what exceeds that is shared again by weight. target / size is a whole number of full
passes over the source plus a fraction, and that fraction is the inclusion probability of
each of its documents in a further pass.

Flight phase: three undecided documents have one direction in which their probabilities can
move without changing the expected number of documents or of words (the null space of the
two totals). They move along it, forwards or backwards at random but without bias, until one
is decided. This runs in blocks of about ``BLOCK`` documents and leaves two of each at most;
those meet again in larger blocks until one block per source remains. Landing phase: its
last two documents are settled so that the words taken come nearest the target.

Random numbers come from hashes of the rows and blocks, so reruns agree.

Defined results: null and empty texts have no words; a null source is a source, the last
one; documents that repeat another row are decided one by one; an empty table gives no rows;
texts of any length are counted whole; extra columns of any name are left behind, or pass
through ``mixed``.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlots.llm.common import WORD, fresh, id_text, settled, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 2048
# Blocks of one level whose rests meet in one block of the next.
JOINED = 512
NEARLY = 1e-9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_no, source_size, n_docs, target), one row per source, of (source, size, copies) rows.

    All sources below their cap get the same words per weight. Sorted by cap per weight, the
    capped ones come first, so that level is found without trying in rounds.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    sources = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_docs")
    )
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("source_no"), F.lit(len(weights))))
    ranked = (
        sources.withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumns({"weight": weight, "cap": F.col("source_size") * repeats})
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumns({
        "place": F.row_number().over(by_cap),
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("level", F.col("left") / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    level = F.min(fits).over(everything)["level"]
    target = F.least(level * F.col("weight"), F.col("cap").cast("double"))
    return filled.withColumn("target", target).select("source", "source_no", "source_size", "n_docs", "target")


def _settle(p: np.ndarray, rows: list[int], direction: np.ndarray, u: float) -> None:
    """Move some probabilities along a direction until one of them is 0 or 1."""
    now = p[rows]
    moving = np.abs(direction) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(direction > 0, (1 - now) / direction, -now / direction)[moving].min()
        down = np.where(direction > 0, now / direction, (now - 1) / direction)[moving].min()
    step = up if u * (up + down) < down else -down
    moved = now + step * direction
    moved[moved < NEARLY] = 0.0
    moved[moved > 1 - NEARLY] = 1.0
    p[rows] = moved


def flight(p: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight phase: sum(p) and sum(p * sizes) stay, at most two are undecided."""
    p, rng = p.copy(), np.random.default_rng(seed)
    undecided = [int(row) for row in np.flatnonzero((p > 0) & (p < 1))][::-1]
    held: list[int] = []
    while True:
        while undecided and len(held) < 3:
            held.append(undecided.pop())
        if len(held) < 2:
            return p
        a, b = sizes[held[0]], sizes[held[1]]
        if a == b:
            rows, direction = held[:2], np.array([1.0, -1.0])
        elif len(held) == 3:
            c = sizes[held[2]]
            rows, direction = held, np.array([c - b, a - c, b - a], dtype=float)
            direction /= np.abs(direction).max()
        else:
            return p
        _settle(p, rows, direction, rng.random())
        held = [row for row in held if 0 < p[row] < 1]


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The few undecided documents become 0 or 1, so that their words come nearest the expected number."""
    p, rows = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    if len(rows):
        wanted_size, wanted = (p[rows] * sizes[rows]).sum(), p[rows].sum()
        p[rows] = min(
            product((0.0, 1.0), repeat=len(rows)),
            key=lambda picked: (abs(np.dot(picked, sizes[rows]) - wanted_size), abs(sum(picked) - wanted), picked),
        )
    return p


def _level(units: DataFrame, last: bool) -> DataFrame:
    """One round of the flight phase in every block, and the landing in the last one."""

    def decide(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["unit", "place"], kind="stable")
        seed = abs(hash((int(block["source_no"].iloc[0]), int(block["block"].iloc[0]), int(block["unit"].iloc[0]))))
        sizes = block["size"].to_numpy(dtype=float)
        p = flight(block["p"].to_numpy(dtype=float), sizes, seed)
        return block.assign(p=landing(p, sizes) if last else p)

    return units.groupBy("source_no", "block").applyInPandas(decide, units.schema)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, times) of every document.

    ``times`` is how often the mix takes the document, ``repeats`` at most.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", size_of(F.col("text")).alias("size"))
    rows = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "mix-rows")
    sources = settled(targets(rows, weights, repeats))
    unit = F.xxhash64(id_text(F.col("doc_id")), "text_hash")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = sources.select(
        F.col("source").alias("_source"), "source_no", ratio.alias("ratio"),
        F.ceil(F.col("n_docs") / block).alias("blocks"),
    )
    units = (
        rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("place", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id", "text_hash", "size", "source_no", unit.alias("unit"), "place",
            F.pmod(F.xxhash64(unit, "place"), "blocks").alias("block"),
            F.floor("ratio").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p"),
        )
    )
    most = sources.agg(F.max(F.ceil(F.col("n_docs") / block))).first()[0] or 0
    decided = None
    while True:
        units = stored(_level(units, last=most <= 1), "mix-level")
        done = units.where("p = 0 OR p = 1")
        decided = done if decided is None else decided.unionAll(done)
        if most <= 1:
            break
        units = units.where("p > 0 AND p < 1").withColumn("block", F.expr(f"block div {JOINED}"))
        most = -(-most // JOINED)
    return decided.join(sources, "source_no").select(
        "doc_id", "text_hash", "source", "size", "source_size", "target",
        (F.col("whole") + F.col("p")).cast("bigint").alias("times"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it.

    The takes of equal rows are handed out evenly among them.
    """
    takes = settled(
        mixture(docs, weights, repeats, block).groupBy("doc_id", "text_hash", "source")
        .agg(F.sum("times").alias("times"), F.count("*").alias("copies"))
    )
    known, mark, origin, times, copies, number = fresh(docs, "id", "hash", "origin", "times", "copies", "number")
    takes = takes.select(
        id_text(F.col("doc_id")).alias(known), F.col("text_hash").alias(mark), id_text(F.col("source")).alias(origin),
        F.col("times").alias(times), F.col("copies").alias(copies),
    ).where(F.col(times) > 0)
    keys = [known, mark, origin]
    rows = docs.withColumns(
        {known: id_text(F.col("doc_id")), mark: F.xxhash64("text"), origin: id_text(F.col("source"))}
    ).join(takes, keys)
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(known)))
    own = F.expr(f"`{times}` div `{copies}`") + (F.col(number) <= F.col(times) % F.col(copies)).cast("int")
    return rows.withColumn(number, F.explode(F.array_repeat(F.lit(0), own.cast("int")))).select(*docs.columns)
