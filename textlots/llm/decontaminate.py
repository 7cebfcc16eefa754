"""Benchmark decontamination: find benchmark word windows in documents, drop spans or documents.

A broadcast hash set of normalised benchmark windows meets every word window of every
document; a hit is verified by a digest of its words. Column expressions only.

Defined results: a null or empty text has no words and no hits; a null item id still hits
words but is not listed; repeated benchmark rows count once; repeated documents each keep
their row; an empty benchmark hits nothing; texts of any length are
scanned whole; extra columns of any name are left behind, or pass through
``without_documents``; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlots.llm.common import fresh, keyed, on_key, settled

# A word is a run of digits, letters a-z after lower-casing, and non-ASCII characters.
LOWERED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10

# Windows sent to every executor at once: fixed width, about 100 bytes each, so 20 MB.
# A larger benchmark is compared in several blocks, each a scan of the documents.
BLOCK_WINDOWS = 200_000

KEY = ("doc_id", "text_hash")


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    found = F.regexp_extract_all(lowered, F.lit(LOWERED_WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _digest(window: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(window, " "), 256))


def _fingerprint(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, start + i) for i in range(length)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, fingerprint, digest, item_id) of each window; a shorter item is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.lit(window), F.size("words"))
    starts = (
        items.withColumn("length", length)
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))))
    )
    fingerprint = F.coalesce(
        *[
            F.when(F.col("length") == n, _fingerprint(F.col("hashes"), F.col("start"), n))
            for n in range(window, 0, -1)
        ]
    )
    return starts.select(
        "length",
        fingerprint.alias("fingerprint"),
        _digest(F.slice("words", F.col("start") + 1, F.col("length"))).alias("digest"),
        "item_id",
    ).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(key, start, length, digest) wherever a document holds one of the settled windows."""
    distinct = settled(windows.select("length", "fingerprint", "digest").distinct())
    sizes = {row.length: row.n for row in distinct.groupBy("length").agg(F.count("*").alias("n")).collect()}
    blocks = max(1, -(-sum(sizes.values()) // block_windows))
    texts = keyed(docs).select(*KEY, words(F.col("text")).alias("words"))
    candidates = (
        texts.where(F.size("words") > 0)
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
    )
    each = [
        F.when(
            F.col("start") + n <= F.size("words"),
            F.struct(F.lit(n).alias("length"), _fingerprint(F.col("hashes"), F.col("start"), n).alias("print")),
        )
        for n in sorted(sizes) or [WINDOW]
    ]
    if len(each) > 1:
        candidates = candidates.withColumn("window", F.explode(F.array(*each)))
    else:
        candidates = candidates.withColumn("window", each[0])
    hits = None
    for block in range(blocks):
        part = distinct.where(F.pmod("fingerprint", F.lit(blocks)) == block)
        part = part.withColumnsRenamed({"length": "_length"})
        found = candidates.join(
            F.broadcast(part),
            (F.col("window.print") == F.col("fingerprint"))
            & (F.col("window.length") == F.col("_length"))
            & (_digest(F.slice("words", F.col("start") + 1, F.col("_length"))) == F.col("digest")),
        ).select(*KEY, "start", F.col("_length").alias("length"), "digest")
        hits = found if hits is None else hits.unionAll(found)
    return hits


def _merged(windows: Column) -> Column:
    """Sorted (start, length) windows as disjoint (start, end) word spans."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(spans: Column, window: Column) -> Column:
        last = F.get(spans, F.size(spans) - 1)
        end = window["start"] + window["length"]
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
        fresh = F.struct(window["start"].alias("start"), end.alias("end"))
        head = F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0)))
        joins = (F.size(spans) > 0) & (window["start"] <= last["end"])
        return F.when(joins, F.concat(head, F.array(longer))).otherwise(F.concat(spans, F.array(fresh)))

    return F.aggregate(F.array_sort(windows), empty, step)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: word count, hit words, hit spans (in words) and the items that hit it."""
    windows = settled(benchmark_windows(benchmark, window))
    hits = settled(window_hits(docs, windows).distinct())
    spans = hits.groupBy(*KEY).agg(F.collect_list(F.struct("start", "length")).alias("windows"))
    spans = spans.select(*KEY, _merged(F.col("windows")).alias("spans"))
    owners = windows.select("digest", F.col("item_id").cast("string").alias("item")).distinct()
    items = (
        hits.select(*KEY, "digest").distinct().join(owners, "digest").groupBy(*KEY)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    every = keyed(docs).select(
        *KEY,
        F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("bigint").alias("n_words"),
    )
    empty_spans = F.array().cast("array<struct<start:int,end:int>>")
    joined = on_key(every, on_key(spans, items))
    spans_of = F.coalesce("spans", empty_spans)
    hit = F.aggregate(spans_of, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return joined.select(
        *KEY,
        "n_words",
        hit.alias("n_hit"),
        spans_of.alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, in which no benchmark window occurs."""
    windows = settled(benchmark_windows(benchmark, window))
    hit_id, hit_hash = fresh(docs, "hit_id", "hit_hash")
    hit = settled(window_hits(docs, windows).select(*KEY).distinct()).toDF(hit_id, hit_hash)
    same = F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64("text") == F.col(hit_hash))
    return docs.join(hit, same, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text): the documents with every hit word cut out, all other characters kept."""
    found = contamination(docs, benchmark, window).where("n_hit > 0").select(*KEY, "spans").distinct()
    joined = on_key(keyed(docs), found)
    parts = F.split("text", ANY_CASE_WORD, -1)
    kept = F.transform(
        F.regexp_extract_all("text", F.lit(ANY_CASE_WORD), F.lit(0)),
        lambda w, i: F.when(
            F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])), F.lit("")
        ).otherwise(w),
    )
    rebuilt = F.array_join(F.flatten(F.zip_with(parts, kept, lambda p, w: F.array(p, F.coalesce(w, F.lit(""))))), "")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rebuilt).alias("text"))
