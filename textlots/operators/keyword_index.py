"""Rule tables of any size: keywords found through an index of letter groups.

Every keyword is filed under one of its groups of three letters: the one that the fewest
texts hold. A text is looked up word by word, each by its own distinct groups, so that only
keywords whose rarest group a word holds are tried, and a search in the word decides. A task
remembers what it found for a word. Keywords that hold white space are looked up in the whole
text. The work follows the hits rather than keywords times texts. Keywords of one or two
letters are filed under themselves.

The index goes to all tasks in blocks of counted size; more keywords take more passes. Texts
are looked up where they are read: a text's counts by type are one row, and no text travels.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlots.operators.joins import BROADCAST_ROWS, settled

GROUP = 3
IDS = ("batch_id", "source", "row_no")
# Texts whose hits are handed on together.
ROWS = 256
# Words that a task remembers, and their length; a longer word is looked up each time.
WORDS = 400_000
WORD_CHARS = 64


def _filed(keyword: Column) -> Column:
    """The groups that a keyword can be filed under."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(keyword) - (GROUP - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(keyword, at, F.lit(GROUP))))


def _held(text: str, sizes: Sequence[int]) -> set[str]:
    """All groups of these sizes under which a keyword of the text could be filed."""
    if 0 in sizes:
        return {""}.union(_held(text, [size for size in sizes if size]))
    return {text[at : at + size] for size in sizes for at in range(len(text) - size + 1)}


def _open(keyword: str) -> bool:
    """Whether a keyword may reach beyond one word."""
    return keyword.split() != [keyword]


_NONE: frozenset = frozenset()


class _Words(dict):
    """What a function finds in each word, remembered for short words."""

    def __init__(self, find: Callable[[str], set]):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> set:
        found = self.find(word) or _NONE
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> set:
        """All that is found in the words of a text."""
        return set().union(*map(self.__getitem__, set(text.split())))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column("_low").to_pylist()


def keywords_of(table: DataFrame, domain: str) -> DataFrame:
    """(type, rule_order, keyword): distinct lower-case keywords of each type, with the type's place."""
    rows = table.where((F.col("domain") == domain) & F.col("keyword").isNotNull())
    places = rows.groupBy("type").agg(F.min("rule_order").alias("rule_order"))
    return rows.select("type", F.lower("keyword").alias("keyword")).distinct().join(places, "type")


def _holders(texts: DataFrame, block: DataFrame) -> DataFrame:
    """(group, n): the texts that hold each of the block's groups, counted in every task."""
    wanted = {row.group for row in block.collect()}
    inside, across = ({g for g in wanted if _open(g) == beyond} for beyond in (False, True))
    known = texts.sparkSession.sparkContext.broadcast([(part, sorted(set(map(len, part)))) for part in (inside, across)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (groups, sizes), (across, wide) = known.value
        words = _Words(lambda word: _held(word, sizes) & groups)
        counts: Counter = Counter()
        for _, lowered in _texts(batches):
            for text in lowered:
                if text is not None:
                    counts.update(words.of(text))
                    if across:
                        counts.update(_held(text, wide) & across)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["group", "n"]
        )

    return texts.mapInArrow(work, "group string, n bigint").groupBy("group").agg(F.sum("n").alias("n"))


def index(keywords: DataFrame, df: DataFrame, text: str = "text", block: int = BROADCAST_ROWS) -> DataFrame:
    """(group, keyword): every distinct keyword under its group that occurs in the fewest texts. Settled."""
    options = settled(keywords.select("keyword").distinct().select("keyword", F.explode(_filed(F.col("keyword"))).alias("group")))
    known = settled(options.select("group").distinct())
    texts = df.select(F.lower(F.col(text)).alias("_low"))
    held = None
    for part in _blocks(known, "group", block):
        counts = _holders(texts, part)
        held = counts if held is None else held.unionAll(counts)
    rarest = F.min_by("group", F.struct(F.coalesce("n", F.lit(0)), "group"))
    return settled(options.join(held, "group", "left").groupBy("keyword").agg(rarest.alias("group")))


def _blocks(table: DataFrame, key: str, block: int) -> list[DataFrame]:
    """A settled table in parts that may be broadcast."""
    n = max(1, -(-table.count() // block))
    return [table.where(F.pmod(F.xxhash64(key), F.lit(n)) == part) for part in range(n)]


def candidates(df: DataFrame, filed: DataFrame, ids: Sequence[str] = IDS, text: str = "text", block: int = BROADCAST_ROWS) -> DataFrame:
    """(ids, keyword) where a text holds the group under which a keyword is filed."""
    rows = filed.select("keyword", "group", F.col("keyword").alias("name"))
    found = _looked_up(df, settled(rows), ids, text, block, search=False)
    return found.select(*ids, F.explode("hits").alias("hit")).select(*ids, F.col("hit.name").alias("keyword"))


def _looked_up(df: DataFrame, rows: DataFrame, ids: Sequence[str], text: str, block: int, search: bool = True) -> DataFrame:
    """(ids, hits) of texts with hits, a row per text and block: how many keywords of each name the text holds.

    ``rows`` holds keyword, group and the columns that make a name; without ``search`` the
    keywords of every group that a text holds are counted.
    """
    names = [name for name in rows.columns if name not in ("keyword", "group")]
    texts = df.select(*ids, F.lower(F.col(text)).alias("_low"))
    kinds = [field.type for field in rows.select(*names).limit(0).toArrow().schema]
    hit = ", ".join(f"{name}: {rows.schema[name].dataType.simpleString()}" for name in names)
    schema = ", ".join([*(f"`{name}` {texts.schema[name].dataType.simpleString()}" for name in ids), f"hits array<struct<{hit}, hits: bigint>>"])
    found = None
    for part in _blocks(rows, "keyword", block):
        hits = _hits(texts, part, ids, names, kinds, schema, search)
        found = hits if found is None else found.unionAll(hits)
    return found


def _hits(
    texts: DataFrame, part: DataFrame, ids: Sequence[str], names: Sequence[str], kinds: Sequence[pa.DataType], schema: str, search: bool
) -> DataFrame:
    known: dict[tuple, int] = {}
    owners: dict[str, list[int]] = defaultdict(list)
    # Keywords by group: those inside a word, and those that may reach beyond it.
    filed = (defaultdict(set), defaultdict(set))
    for row in part.collect():
        owners[row.keyword].append(known.setdefault(tuple(row[name] for name in names), len(known)))
        filed[_open(row.keyword)][row.group].add(row.keyword)
    indexes = [(dict(one), sorted(set(map(len, one)))) for one in filed]
    given = texts.sparkSession.sparkContext.broadcast((indexes, dict(owners), list(known)))

    def finder(index: dict[str, set[str]], sizes: list[int]) -> Callable[[str], set]:
        def find(text: str) -> set[str]:
            groups = _held(text, sizes) & index.keys()
            return {keyword for group in groups for keyword in index[group] if not search or keyword in text}

        return find

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, owners, known = given.value
        inside, across = (finder(*one) for one in indexes)
        words = _Words(inside)
        for part, lowered in _texts(batches):
            at, ends, found, counts = [], [0], [], []
            for row, text in enumerate(lowered):
                if text is None:
                    continue
                hits: dict[int, int] = {}
                for keyword in words.of(text) | across(text) if indexes[1][0] else words.of(text):
                    for owner in owners[keyword]:
                        hits[owner] = hits.get(owner, 0) + 1
                if hits:
                    at.append(row)
                    found.extend(hits)
                    counts.extend(hits.values())
                    ends.append(len(found))
            columns = [pa.array([known[one][place] for one in found], kind) for place, kind in enumerate(kinds)]
            entries = pa.StructArray.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, "hits"])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
            own = part.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(name) for name in ids), listed], [*ids, "hits"])

    return texts.mapInArrow(work, schema)


def match_table(
    df: DataFrame, table: DataFrame, domain: str, ids: Sequence[str] = IDS, text: str = "text", block: int = BROADCAST_ROWS
) -> DataFrame:
    """Long form: (ids, type, rule_order, hits), a row per text and type with keywords in it.

    ``ids`` name a row of ``df``; rows that share them count together.
    """
    keywords = settled(keywords_of(table, domain))
    filed = index(keywords, df, text, block)
    # A keyword may belong to several types.
    typed = settled(keywords.join(filed, "keyword").select("keyword", "group", "type", "rule_order"))
    # Dealt out by ids once: the counts per type, and the winners, need no further shuffle.
    found = _looked_up(df, typed, ids, text, block).repartition(*ids).select(*ids, F.explode("hits").alias("_hit"))
    each = found.select(*ids, "_hit.type", "_hit.rule_order", "_hit.hits")
    return each.groupBy(*ids, "type", "rule_order").agg(F.sum("hits").alias("hits"))


def winners(matches: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """(ids, type, hits): the type with most keywords, the first by rule order, then by name."""
    best = F.min(F.struct((-F.col("hits")).alias("less"), "rule_order", "type"))
    return matches.groupBy(*ids).agg(best.alias("_best")).select(
        *ids, F.col("_best.type").alias("type"), (-F.col("_best.less")).alias("hits")
    )
