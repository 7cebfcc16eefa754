"""Source divergence audit: how far the word use of sources of one language is apart.

In-mapper stripes: every task folds whole documents into a hash table of stripes, one per
language and term, with the number of documents that hold the term and its occurrences per
source. A table that reaches its bound is spilled: its stripes leave the task, and folding
goes on with an empty one. Spark merges the stripes by key with sums, so that a term of
every document costs one row per spilled table and source, and stripes of fewer than
``MIN_DOCS`` documents end there.

Merged stripes are dealt to cells of bounded size, each of one language; beside them stand
the language's sources with their totals (a cogroup: nothing is broadcast or collected).
A cell turns its stripes directly into divergences: for every ordered pair of sources the
sum over its terms, and for every source its highest terms against the whole language.
Only these sums, and at most ``TOP_TERMS`` terms per source and cell, are shuffled again.

All arithmetic is in whole numbers: p = 1 + floor(10^9 (count + 1) / (N + V)), and a term
adds floor((p - q)^2 / q).

Defined results: a null text, language or source is an empty string; every language and
source that occurs is a group, with texts or without; without kept terms all pairs are 0
and no term is listed; rows of repeated documents count each; a long text is one document
of its own; ties are ordered by the item's code points; an empty table gives an empty
result. Other columns of the input, whatever their names, are ignored. Sums are exact as
long as a group has fewer than 9 * 10^15 occurrences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlots.llm.common import settled, slices, stored, text_bytes

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
# Terms that a task's hash table holds before it is spilled: about 100 MB.
STRIPES = 150_000
# Numbers (terms x sources) of one cell, 8 bytes each.
CELL_NUMBERS = 1 << 18
# Sources whose pairs with all others one cell adds up.
SOURCE_BLOCK = 256

# Letters A-Z, a-z and all signs beyond ASCII make terms; other bytes end them.
_TERM_BYTES = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte >= 128 else 32 for byte in range(256)
)

STRIPE = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"
ROW = "lang string, source string, part string, item string, value bigint"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _grouped(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("lang", "source", "text")])


def _spilled(tables: dict[str, dict[bytes, list]]) -> Iterator[pa.RecordBatch]:
    """The stripes of all languages; a stripe is [documents, {source: occurrences}]."""
    for lang, stripes in tables.items():
        ends = np.cumsum([0, *[len(counts) for _, counts in stripes.values()]])
        offsets = pa.array(ends, pa.int32())
        sources = pa.array([source for _, counts in stripes.values() for source in counts], pa.string())
        occurrences = pa.array([n for _, counts in stripes.values() for n in counts.values()], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang], pa.string()).take(pa.array(np.zeros(len(stripes), dtype=np.int32))),
                pa.array(stripes, pa.binary()).cast(pa.string()),
                pa.array([n for n, _ in stripes.values()], pa.int64()),
                pa.ListArray.from_arrays(offsets, sources),
                pa.ListArray.from_arrays(offsets, occurrences),
            ],
            ["lang", "term", "docs", "sources", "counts"],
        )


def partial_stripes(docs: DataFrame, bound: int = STRIPES) -> DataFrame:
    """(lang, term, docs, sources, counts) as tasks spill them; a key may come several times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict[bytes, list]] = {}
        held = 0
        for batch in batches:
            for part in slices(batch):
                rows = zip(
                    part.column("lang").to_pylist(), part.column("source").to_pylist(), text_bytes(part.column("text"))
                )
                for lang, source, text in rows:
                    stripes = tables.setdefault(lang, {})
                    held -= len(stripes)
                    for term, n in Counter(terms(text)).items():
                        stripe = stripes.get(term)
                        if stripe is None:
                            stripes[term] = [1, {source: n}]
                        else:
                            stripe[0] += 1
                            counts = stripe[1]
                            counts[source] = counts.get(source, 0) + n
                    held += len(stripes)
                    if held >= bound:
                        yield from _spilled(tables)
                        tables, held = {}, 0
        yield from _spilled(tables)

    return _grouped(docs).mapInArrow(work, STRIPE)


def stripes(docs: DataFrame, min_docs: int = MIN_DOCS, bound: int = STRIPES) -> DataFrame:
    """(lang, term, counts) of terms in enough documents; counts lists (source, n).

    The partial stripes travel once. Both sums then run on that partitioning; a merged
    stripe has at most as many entries as its language has sources.
    """
    dealt = partial_stripes(docs, bound).repartition("lang", "term")
    pairs = dealt.select("lang", "term", "docs", F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "one"))
    sums = pairs.groupBy("lang", "term", F.col("one.sources").alias("source")).agg(
        F.sum("one.counts").alias("n"),
        # The documents of a partial stripe stand with its first source.
        F.sum(F.when(F.col("at") == 0, F.col("docs")).otherwise(0)).alias("docs"),
    )
    merged = sums.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts")
    )
    return merged.where(F.col("docs") >= min_docs).select("lang", "term", "counts")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms): occurrences of kept terms in each group, kept terms of its language."""
    every = _grouped(docs).select("lang", "source").distinct()
    totals = (
        kept.select("lang", F.explode("counts").alias("one"))
        .groupBy("lang", F.col("one.source").alias("source")).agg(F.sum("one.n").alias("total"))
    )
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    return (
        every.join(totals, ["lang", "source"], "left").join(sizes, ["lang"], "left")
        .select("lang", "source", *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in ("total", "terms")])
    )


def shares(counts: np.ndarray, totals: np.ndarray | int, n_terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + terms)), by long division in three digits at a time."""
    below = np.maximum(np.asarray(totals, dtype=np.int64) + n_terms, 1)
    found, rest = np.divmod(counts + 1, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        found = found * 1000 + digits
    return found + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _matrix(cell: pa.Table, place: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Terms of a cell, and their occurrences by term and source."""
    counts = cell.column("counts").combine_chunks()
    lengths = counts.value_lengths().to_numpy(zero_copy_only=False)
    entries = counts.flatten()
    columns = np.array([place[source] for source in entries.field("source").to_pylist()], dtype=np.int64)
    matrix = np.zeros((cell.num_rows, len(place)), dtype=np.int64)
    matrix[np.repeat(np.arange(cell.num_rows), lengths), columns] = entries.field("n").to_numpy(zero_copy_only=False)
    return cell.column("term").to_pylist(), matrix


def _rows(lang: str, source: str, part: str, items: list[str], values: np.ndarray) -> pa.Table:
    n = len(items)
    texts = [pa.array([text] * n, pa.string()) for text in (lang, source, part)]
    return pa.table([*texts, pa.array(items, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])


def _cell_rows(cell: pa.Table, sources: pa.Table) -> Iterator[pa.Table]:
    """Pair sums and highest terms of the sources of one block over the terms of one cell."""
    order = sources.sort_by("source").to_pydict()
    names, n_terms = order["source"], order["terms"][0]
    items, counts = _matrix(cell, {name: at for at, name in enumerate(names)})
    total = np.array(order["total"], dtype=np.int64)
    lang, whole = order["lang"][0], int(order["lang_total"][0])
    p = shares(counts, total, n_terms)
    of_lang = shares(counts.sum(axis=1), whole, n_terms)
    for at in np.flatnonzero(order["own"]):
        others = [name for name in names if name != names[at]]
        sums = np.delete(_gap(p[:, at : at + 1], p).sum(axis=0), at)
        yield _rows(lang, names[at], "pair", others, sums)
        above = np.flatnonzero((counts[:, at] > 0) & (p[:, at] > of_lang))
        values = _gap(p[above, at], of_lang[above])
        ranked = sorted(zip((-values).tolist(), [items[row].encode() for row in above]))[:TOP_TERMS]
        yield _rows(lang, names[at], "term", [item.decode() for _, item in ranked], np.array([-v for v, _ in ranked], dtype=np.int64))


def _emitted(cell: pa.Table, sources: pa.Table) -> pa.Table:
    empty = _rows("", "", "", [], np.zeros(0, dtype=np.int64))
    if not cell.num_rows or not sources.num_rows:
        return empty
    return pa.concat_tables([empty, *_cell_rows(cell, sources)])


def divergences(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, bound: int = STRIPES,
    cell_numbers: int = CELL_NUMBERS, block: int = SOURCE_BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and the highest terms of each."""
    kept = stored(stripes(docs, min_docs, bound), "stripes")
    every = settled(groups(docs, kept))
    langs = every.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.count("*").alias("n"), F.max("terms").alias("n_terms")
    ).select(
        "lang", "lang_total",
        F.ceil(F.col("n_terms") * F.col("n") / cell_numbers).cast("int").alias("cells"),
        F.ceil(F.col("n") / block).cast("int").alias("blocks"),
    )
    langs = settled(langs)
    numbered = Window.partitionBy("lang").orderBy("source")
    rights = (
        every.withColumn("source_block", F.floor((F.row_number().over(numbered) - 1) / block).cast("int"))
        .join(langs, "lang").where("cells > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .select("lang", "cell", "block", "source", "total", "terms", "lang_total", (F.col("source_block") == F.col("block")).alias("own"))
    )
    lefts = (
        kept.join(langs, "lang")
        .withColumn("cell", F.pmod(F.xxhash64("term"), F.col("cells")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("lang", "cell", "block", "term", "counts")
    )
    key = ("lang", "cell", "block")
    found = stored(lefts.groupBy(*key).cogroup(rights.groupBy(*key)).applyInArrow(_emitted, ROW), "divergences")
    return _ranked(_pairs(every, found)).unionAll(
        _ranked(found.where("part = 'term'")).where(F.col("rank") <= top)
    )


def _pairs(every: DataFrame, found: DataFrame) -> DataFrame:
    """All ordered pairs of sources of a language with their sums, 0 without kept terms."""
    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # Languages without kept terms have no cell: their pairs are the result itself, each 0.
    bare = every.where("terms = 0").select("lang", "source")
    others = bare.select("lang", F.col("source").alias("item"))
    zero = bare.join(others, "lang").where("source <> item").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value")
    )
    return sums.unionAll(zero)


def _ranked(rows: DataFrame) -> DataFrame:
    order: list[Column] = [F.desc("value"), F.asc("item")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order)))
