"""Near duplicates by vector: keep a row unless an earlier kept row is similar enough.

Vectors are compared inside metric cells. Pivots are chosen from the data, far from each
other; a row is a member of the cell of its nearest pivot, and a guest of every other cell
in which, by the triangle inequality, a member could be within the threshold of it. Crowded
cells are split into blocks of members and blocks of candidates, so that no task compares
more than a bounded number of rows, and none of their pairs is written out: a task answers
each member with the first few earlier similar rows (``FIRST``). It multiplies small tiles in
single precision; products too near the threshold for that are computed again in double.

These short lists decide which rows stay. A row without an entry stays; a row whose first
entry that is not dropped stays itself is dropped for it. Lists point to earlier rows only,
and rows of one cell are settled together, so a round settles all chains inside cells; only
chains from cell to cell take further rounds. Rows whose whole list was dropped are compared
again with what is left. Neither depends on the size of a lot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlots.operators.dedup import BATCH, ORDER, canonical, with_canonical
from textlots.operators.joins import lookup_join, narrow_join, settled

# Fixed value: similarity from which two texts are the same.
THRESHOLD = 0.92

# Members of one block of a cell; a task compares them with at most four times as many rows. A row
# of a lot without neighbourhoods travels once per cell, so that cells are large: 64 floats a
# row, a block and its rows are 60 MB.
CELL_ROWS = 32_768
MAX_PIVOTS = 256
# Rows that are placed in cells together.
SLICE_ROWS = 16_384
# Rows and columns of one product of vectors, which stays in a core's cache.
TILE = 1_024
# Earlier similar rows that a comparison lists for a row.
FIRST = 8
# Open rows of one cell that are settled together.
SETTLE_ROWS = 50_000
SALTS = 64
# More than the rounding of distances of unit vectors.
SLACK = 1e-6

KEPT, DROPPED, OPEN = 1, -1, 0
PLACE = ("canon_source", "canon_row_no")


def vector_key(vec: Column) -> Column:
    joined = F.array_join(F.transform(vec, lambda x: x.cast("string")), ",")
    return F.coalesce(F.unhex(F.md5(joined)), F.lit(b""))


def _unit(vectors: pd.Series) -> np.ndarray:
    return _scaled(np.array(vectors.tolist(), dtype=np.float64))


def _scaled(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _single(matrix: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    unit = np.empty(matrix.shape, dtype=np.float32)
    for start in range(0, len(matrix), TILE):
        unit[start : start + TILE] = _scaled(matrix[start : start + TILE])
    return unit


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a table, all of one length, as given; a null component is NaN."""
    flat = pa.concat_arrays([chunk.flatten() for chunk in vectors.chunks])
    if not pa.types.is_floating(flat.type):
        flat = flat.cast(pa.float64())
    return flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of unit (or zero) vectors."""
    squares = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1) - 2 * (left @ right.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _reach(threshold: float) -> float:
    """Distance up to which unit vectors reach the threshold."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def _by_hash(rows: DataFrame, by: Sequence[str], n: Column) -> DataFrame:
    """The rows of each lot with the ``n`` smallest hashes, in two steps so that no task sees a whole lot."""
    marked = rows.select(*by, "key", F.xxhash64("key").alias("_hash"), n.alias("_n"))
    marked = marked.withColumn("_salt", F.pmod("_hash", F.lit(SALTS)))
    for part in ([*by, "_salt"], [*by]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy("_hash", "key"))
        marked = marked.withColumn("_place", place).where(F.col("_place") <= F.col("_n"))
    return marked.select(*by, "key")


def _far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Positions of up to ``n`` vectors, each the farthest from those before it."""
    chosen = [0]
    gap = _apart(vectors, vectors[:1])[:, 0]
    while len(chosen) < n and gap.max() > SLACK:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _apart(vectors, vectors[chosen[-1] :][:1])[:, 0])
    return np.array(chosen)


def _schema(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [f"`{field.name}` {field.dataType.simpleString()}" for field in df.select(*names).schema.fields]


def _pivots(rows: DataFrame, sizes: DataFrame, vec: str, by: Sequence[str]) -> DataFrame:
    """(by, pivot, vector) of lots with more than one cell: far-apart vectors of a sample of bounded size."""
    large = sizes.where("_pivots > 1")
    some = _by_hash(rows.join(large, list(by)), by, 4 * F.col("_pivots"))
    sample = rows.join(some, [*by, "key"], "left_semi").join(large, list(by)).select(*by, "key", vec, "_pivots")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key").reset_index(drop=True)
        group = group.iloc[_far_apart(_unit(group[vec]), int(group["_pivots"].iloc[0]))].reset_index(drop=True)
        group["_cell"] = np.arange(len(group), dtype=np.int32)
        return group[[*by, "_cell", vec]]

    schema = ", ".join([*_schema(rows, by), "_cell int", *_schema(rows, [vec])])
    return settled(sample.groupBy(*by).applyInPandas(choose, schema))


def _cells(
    rows: DataFrame, sizes: DataFrame, vec: str, by: Sequence[str], threshold: float, cell_rows: int
) -> DataFrame:
    """The rows with ``_home``, and ``_cells``: every cell in which a member could be similar, the own one included."""
    spread = 2 * _reach(threshold) + SLACK
    small = rows.join(sizes.where("_pivots <= 1").select(*by), list(by), "left_semi").withColumns(
        {"_home": F.lit(0), "_cells": F.array(F.lit(0))}
    )
    if sizes.where("_pivots > 1").isEmpty():
        return small
    pivots = _pivots(rows, sizes, vec, by)
    slices = sizes.where("_pivots > 1").select(*by, F.ceil(F.col("_rows") / SLICE_ROWS).alias("_slices"))
    sliced = rows.join(slices, list(by)).withColumn("_slice", F.pmod(F.xxhash64("key"), F.col("_slices"))).drop("_slices")
    copies = pivots.join(slices, list(by)).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1))
    )

    def place(some: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        heads = heads.sort_values("_cell").reset_index(drop=True)
        some = some.reset_index(drop=True).drop(columns="_slice")
        if not len(some):
            return some.assign(_home=pd.Series(dtype="int32"), _cells=pd.Series(dtype=object))
        far = _apart(_unit(some[vec]), _unit(heads[vec]))
        home = far.argmin(axis=1)
        near = far <= far[np.arange(len(far)), home][:, None] + spread
        near[np.arange(len(far)), home] = True
        return some.assign(_home=home.astype(np.int32), _cells=[np.flatnonzero(one).astype(np.int32) for one in near])

    schema = ", ".join([*_schema(rows, rows.columns), "_home int", "_cells array<int>"])
    placed = sliced.groupBy(*by, "_slice").cogroup(copies.groupBy(*by, "_slice")).applyInPandas(place, schema)
    return settled(small.unionByName(placed))


def _earlier(
    members: pa.Table, others: pa.Table, vec: str, threshold: float, first: int
) -> tuple[np.ndarray, np.ndarray]:
    """The first similar rows of an earlier place in the lot: positions in ``others`` member by member, and their counts."""
    # Both tables in lot order, a member before its own row among the others.
    places = pa.concat_tables([members.select(PLACE), others.select(PLACE)])
    order = pc.sort_indices(places, sort_keys=[(name, "ascending") for name in PLACE]).to_numpy()
    other = order >= len(members)
    # The lot's rows before each member: only these are looked at.
    before = np.empty(len(members), dtype=np.int64)
    before[order[~other]] = np.cumsum(other)[~other]
    order = order[other] - len(members)
    own, given = _matrix(members[vec]), _matrix(others[vec])[order]
    unit = _single(given)
    # More than the rounding of single products of unit vectors.
    slack = 2e-7 * (unit.shape[1] + 8)
    n_found = np.zeros(len(members), dtype=np.int64)
    found_rows, found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    in_turn = np.argsort(before, kind="stable")
    for start in range(0, len(in_turn), TILE):
        rows = in_turn[start : start + TILE]
        block, end = _single(own[rows]), before[rows[-1]]
        for left in range(0, end, TILE):
            near = block @ unit[left : min(left + TILE, end)].T
            row, at = np.divmod(np.flatnonzero(near >= threshold - slack), near.shape[1])
            doubtful = near[row, at] < threshold + slack
            at += left
            similar = at < before[rows[row]]
            unsure = np.flatnonzero(similar & doubtful)
            for some in np.split(unsure, range(TILE, len(unsure), TILE)):
                exact = (_scaled(own[rows[row[some]]]) * _scaled(given[at[some]])).sum(axis=1)
                similar[some] = exact >= threshold
            row, at = row[similar], at[similar]
            if not len(row):
                continue
            listed = np.arange(len(row)) - np.searchsorted(row, row) + n_found[rows[row]] < first
            found_rows.append(rows[row[listed]])
            found.append(at[listed])
            n_found += np.bincount(found_rows[-1], minlength=len(members))
            wanting = n_found[rows] < first
            rows, block = rows[wanting], block[wanting]
            if not len(rows):
                break
    by_row = np.argsort(np.concatenate(found_rows), kind="stable")
    return order[np.concatenate(found)[by_row]], n_found


def _listed(
    rows: DataFrame, candidates: DataFrame, vec: str, by: Sequence[str], threshold: float, first: int, cell_rows: int
) -> DataFrame:
    """(by, key, similar): up to ``first`` earlier similar candidates of each row, in lot order.

    A cell's members and candidates meet in blocks; each block pair is one bounded task.
    """
    at_home = rows.withColumn("_cell", F.col("_home")).drop("_cells", "_home")
    # Columns of its own, since both sides may come from one table.
    named = candidates.select(*[F.col(name).alias(name) for name in candidates.columns])
    present = named.withColumn("_cell", F.explode("_cells")).drop("_cells", "_home")
    cell = [*by, "_cell"]
    members = at_home.groupBy(*cell).agg(F.ceil(F.count("*") / cell_rows).alias("_m"))
    others = present.groupBy(*cell).agg(F.ceil(F.count("*") / (4 * cell_rows)).alias("_c"))
    blocks = settled(members.join(others, cell))

    def dealt(df: DataFrame, own: str, each: str) -> DataFrame:
        joined = narrow_join(df, blocks, cell)
        return joined.withColumn(own, F.pmod(F.xxhash64("key"), F.col(own))).withColumn(
            each, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(each) - 1))
        )

    def compare(some: pa.Table, against: pa.Table) -> pa.Table:
        found, counts = np.empty(0, dtype=np.int64), np.zeros(len(some), dtype=np.int64)
        if len(some) and len(against):
            found, counts = _earlier(some, against, vec, threshold, first)
        entries = pa.StructArray.from_arrays([against[name].combine_chunks().take(found) for name in PLACE], PLACE)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return some.select([*by, "key"]).append_column("similar", pa.ListArray.from_arrays(ends, entries))

    entry = ", ".join(name.replace("` ", "`: ") for name in _schema(rows, PLACE))
    schema = ", ".join([*_schema(rows, [*by, "key"]), f"similar array<struct<{entry}>>"])
    pair = [*cell, "_m", "_c"]
    sides = [dealt(at_home, "_m", "_c"), dealt(present, "_c", "_m")]
    # Crowded cells are work for a task by each pair of blocks, however few partitions a shuffle has.
    n = blocks.where("_m * _c > 1").agg(F.sum(F.col("_m") * F.col("_c"))).first()[0] or 0
    if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        sides = [side.repartition(n, *pair) for side in sides]
    found = sides[0].groupBy(*pair).cogroup(sides[1].groupBy(*pair)).applyInArrow(compare, schema)
    lists = F.array_sort(F.flatten(F.collect_list("similar")))
    return found.groupBy(*by, "key").agg(F.slice(lists, 1, first).alias("similar"))


def _verdicts(states: Sequence[int], full: bool) -> tuple[int, int]:
    """State of a row whose list has these states, and the position of the row that it is dropped for."""
    for at, state in enumerate(states):
        if state != DROPPED:
            return (DROPPED, at) if state == KEPT else (OPEN, -1)
    # All are dropped: the row stays if the list was whole, else it is compared again.
    return (OPEN if full else KEPT), -1


def _settle(by: Sequence[str], first: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Open rows of one cell in lot order: what is settled here settles later rows of the cell."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(PLACE), kind="stable").reset_index(drop=True)
        here: dict[tuple, int] = {}
        states, sources, numbers = [], [], []
        for source, number, similar in zip(group["canon_source"], group["canon_row_no"], group["similar"]):
            known = [here.get((one["canon_source"], one["canon_row_no"]), one["state"]) for one in similar]
            state, at = _verdicts(known, len(known) == first)
            here[source, number] = state
            states.append(state)
            sources.append(similar[at]["canon_source"] if at >= 0 else source)
            numbers.append(similar[at]["canon_row_no"] if at >= 0 else number)
        out = group[[*by, "key"]].assign(state=np.array(states, dtype=np.int32), kept_source=sources)
        return out.assign(kept_row_no=np.array(numbers, dtype=np.int64))

    return settle


def _resolved(waiting: DataFrame, known: DataFrame, by: Sequence[str], first: int) -> tuple[DataFrame, DataFrame]:
    """``known`` with all rows that the lists of the waiting rows settle, and the rows that still wait.

    A round tells every waiting row the states of the rows in its list. Both tables are settled.
    """
    ids = [*by, "key"]
    schema = ", ".join([*_schema(waiting, ids), "state int", *_schema(known, ["kept_source", "kept_row_no"])])
    while True:
        sizes = settled(waiting.groupBy(*by, "_home").agg(F.ceil(F.count("*") / SETTLE_ROWS).alias("_n")))
        if sizes.isEmpty():
            return known, waiting
        told = narrow_join(_with_states(waiting, known, by), sizes, [*by, "_home"])
        salted = told.withColumn("_salt", F.pmod(F.xxhash64("key"), F.col("_n")))
        done = salted.groupBy(*by, "_home", "_salt").applyInPandas(_settle(by, first), schema)
        fresh = settled(done.where(F.col("state") != OPEN))
        if fresh.isEmpty():
            return known, waiting
        named = fresh.join(waiting.select(*ids, *PLACE), ids).select(*known.columns)
        known = settled(known.unionByName(named))
        waiting = settled(waiting.join(fresh.select(*ids), ids, "left_anti"))


def _with_states(waiting: DataFrame, known: DataFrame, by: Sequence[str]) -> DataFrame:
    """The waiting rows, their lists with the state of each entry.

    The first row of a crowded neighbourhood stands in many lists: hot entries are looked up apart.
    """
    entries = waiting.select(*by, "key", F.posexplode("similar").alias("at", "one")).select(
        *by, "key", "at", "one.*", _place(F.col("one")).alias("place")
    )
    used = entries.groupBy(*by, "place").agg(F.count("*").alias("n"))
    states = known.select(*by, _place(F.struct(*PLACE)).alias("place"), "state")
    looked = lookup_join(
        entries, used.join(states, [*by, "place"]), [*by, "place"], ["state"], "n",
        F.concat(F.lit("!"), F.hex("key"), F.col("at").cast("string")),
    )
    told = F.struct("at", *PLACE, F.coalesce("state", F.lit(OPEN)).alias("state"))
    lists = looked.groupBy(*by, "key").agg(F.array_sort(F.collect_list(told)).alias("similar"))
    return waiting.drop("similar").join(lists, [*by, "key"])


def _place(one: Column) -> Column:
    """A row's place in its lot as one text, which begins with a digit or a minus sign."""
    return F.concat_ws("/", one["canon_row_no"], one["canon_source"])


def _owners(
    uniques: DataFrame, vec: str, by: Sequence[str], threshold: float, cell_rows: int, first: int
) -> DataFrame:
    """Map each distinct vector to its kept row: ``key`` to ``kept_source, kept_row_no``."""
    ids = [*by, "key"]
    rows = uniques.select(*ids, *PLACE, vec)
    sizes = settled(
        rows.groupBy(*by).agg(F.count("*").alias("_rows"))
        .withColumn("_pivots", F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("_rows") / cell_rows)).cast("int"))
    )
    open_rows = candidates = _cells(rows, sizes, vec, by, threshold, cell_rows)
    known = None
    while True:
        lists = _listed(open_rows, candidates, vec, by, threshold, first, cell_rows)
        listed = settled(open_rows.select(*ids, *PLACE, "_home").join(lists, ids))
        alone = listed.where(F.size("similar") == 0).select(
            *ids, *PLACE, F.lit(KEPT).alias("state"), F.col("canon_source").alias("kept_source"),
            F.col("canon_row_no").alias("kept_row_no"),
        )
        known = settled(alone if known is None else known.unionByName(alone))
        known, waiting = _resolved(listed.where(F.size("similar") > 0), known, by, first)
        if waiting.isEmpty():
            return known.select(*ids, "kept_source", "kept_row_no")
        # Rows all of whose list was dropped look for later ones; dropped rows are out of the way.
        open_rows = settled(open_rows.join(waiting.select(*ids), ids, "left_semi"))
        candidates = settled(candidates.join(known.where(F.col("state") == DROPPED).select(*ids), ids, "left_anti"))


def vector_dedup(
    df: DataFrame,
    vec: str = "embedding",
    threshold: float = THRESHOLD,
    by: Sequence[str] = BATCH,
    cell_rows: int = CELL_ROWS,
    first: int = FIRST,
) -> DataFrame:
    """Every row with the row it is kept as, by cosine similarity of its vector.

    A row is kept unless an earlier kept row reaches the threshold; otherwise it maps to
    the first such row. Lots of every size are compared. Vectors of different lengths, and
    vectors that are null, zero or hold a null or NaN, are similar to none; equal ones are
    copies all the same. A row without a source counts to the source named by an empty string.
    """
    rows = df.withColumns({"key": vector_key(F.col(vec)), "source": F.coalesce("source", F.lit(""))})
    inside = [*by, "_dim"]
    sized = rows.withColumn(vec, F.coalesce(vec, F.array().cast(rows.schema[vec].dataType)))
    uniques = settled(canonical(sized.withColumn("_dim", F.size(vec)), [vec], inside))
    owners = _owners(uniques, vec, inside, threshold, cell_rows, first)
    lookup = (
        uniques.select(*inside, "key", "n_rows", *PLACE)
        .join(owners.select(*inside, "key", "kept_source", "kept_row_no"), [*inside, "key"])
        .drop("_dim").withColumn("method", F.lit("semantic"))
    )
    mapped = with_canonical(
        rows.select(*by, *ORDER, "key"), lookup, ["kept_source", "kept_row_no", "method"], by
    )
    return mapped.select(
        *by,
        *ORDER,
        F.col("kept_source").alias("canon_source"),
        F.col("kept_row_no").alias("canon_row_no"),
        (
            (F.col("kept_source") == F.col("source")) & (F.col("kept_row_no") == F.col("row_no"))
        ).alias("is_canonical"),
        "method",
    )
