from __future__ import annotations

import random
import re

from textlots.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + at % 2) for at, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    spans = [
        (m.start(), number, m.end())
        for number, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def found(docs, **how):
    rows = pii.personal_data(docs, **how)
    return rows.select("doc_id", pii.listed(rows.base).alias("base"), pii.listed(rows.found).alias("found")).collect()


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = found(docs)
    assert len(rows) == len(texts)
    for row in rows:
        assert row.base == base(texts[row.doc_id])
        assert set(filter(None, row.base.split(","))) <= set(filter(None, row.found.split(",")))


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(8)
    signs = [*"0123456789" * 2, *"..@@--  ++()_%ab é😀\n", "4111111111111111", "1.2.3.4", "a.b@c.de", "+1 (234) 555-6789"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(80)))) for i in range(4000)]
    got = {r.doc_id: r.base for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {i: base(t) for i, t in rows}


def runs(n):
    return ["1" * n, "a." * n, "1." * n, "1-" * n, "+1" + "(" * n, "x" * n + "@" + "a.b" * n, "+1 " * n, "@." * n]


def test_long_runs(spark):
    """Runs that the plain patterns need quadratic time for, or a deep stack."""
    texts = runs(300)
    got = {r.doc_id: r.base for r in found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    long = {r.doc_id: r.base for r in found(spark.createDataFrame(list(enumerate(runs(100_000))), "doc_id long, text string"))}
    assert {i for i in long if long[i]} == {i for i in got if got[i]}


def test_contexts_of_seeds_find_new_identifiers(spark):
    rng = random.Random(4)
    phone = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows = [(i, f"Please call {phone()} today") for i in range(40)]
    rows += [(100, "Please call 0049-171-55512 today"), (101, "Please read 0049-171-99999 today"), (102, "Version 22 call")]
    rows += [(200 + i, f"room {i} is free") for i in range(30)]
    got = {r.doc_id: r for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[100].base == "" and got[100].found == "phone:12:26"
    assert all(got[i].found == got[i].base for i in got if i != 100)


def test_planted_identifiers(spark):
    """Precision and recall of added spans, with chains of contexts longer than any fixed number of rounds."""
    rng = random.Random(11)
    phone = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows, planted = [], set()

    def add(before, value, unseen):
        text = f"{word()} {before}{value} {word()}"
        at = text.index(value)
        if unseen:
            planted.add((len(rows), f"phone:{at}:{at + len(value)}"))
        rows.append((len(rows), text))

    links = ["my phone is ", "dial the line ", "reach the desk under ", "fax goes over ", "extension via ", "pager with code "]
    for _ in range(150):
        add(links[0], phone(), False)
    # Numbers of a form that no pattern knows: a few are new in each context, among those that earlier ones made known.
    made = [f"{rng.randrange(100, 999)}-77-{n:03d}" for n in range(36)]
    for value in made:
        add(links[0], value, True)
    for step, context in enumerate(links[1:], 1):
        made += [f"{rng.randrange(100, 999)}-7{step}-{n:03d}" for n in range(9)]
        for value in made:
            add(context, value, True)
    for _ in range(200):
        add("room ", str(rng.randrange(10, 99)), False)
        add("version ", f"{rng.randrange(9)}.{rng.randrange(9)}", False)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    added = {
        (r.doc_id, span) for r in found(docs) for span in set(r.found.split(",")) - set(r.base.split(","))
    }
    right = len(added & planted)
    print(f"added {len(added)}, planted {len(planted)}, right {right}")
    assert right == len(added) and right >= 0.95 * len(planted)


def test_contexts_are_the_last_two_words_of_any_length(spark):
    long = "x" * 500
    docs = spark.createDataFrame([(1, f"a {long} {'y' * 200}:  77"), (2, "12 77"), (3, "uno: 77")], "doc_id long, text string")
    contexts = {(r.doc_id, r.context) for r in pii.occurrences(pii.spans_of(docs)).collect()}
    assert contexts == {(1, f"{'y' * 200}|: "), (1, f"{long} {'y' * 200}|: "), (3, "uno|: ")}


def test_edge_cases(edges, edge_rows, no_docs):
    got = sorted(((r.doc_id, r.base) for r in found(edges)), key=repr)
    assert got == sorted(((r[0], base(r[1])) for r in edge_rows), key=repr)
    assert found(no_docs) == []
