from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from public_tokenizers import path

from textlots.llm import token_files
from textlots.session import work_dir

FILE = path("byte_bpe_50k.json")


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer, start, result = Tokenizer.from_file(FILE), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        result.append((doc_id, start, len(ids), crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return result


def written(docs):
    folder = work_dir(docs.sparkSession, "token-files")
    token_files.write_token_files(docs, folder, FILE)
    return folder


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 15), (2000, 7)])
def test_documents_round_trip(spark, some, monkeypatch, limits):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", limits[0])
    monkeypatch.setattr(token_files, "SEGMENT_DOCS", limits[1])
    docs, rows = some
    folder = written(docs)
    got = token_files.documents_of(token_files.read_segments(spark, folder)).collect()
    assert sorted(tuple(r) for r in got) == expected(sorted(rows))
    texts = dict(rows)
    some_ids = [3, 77, 150, 10**9]
    found = {r.doc_id: r.ids for r in token_files.read_documents(spark, folder, some_ids).collect()}
    assert set(found) == {3, 77, 150} & set(texts)
    for i, ids in found.items():
        assert (len(ids), crc32(np.array(ids, dtype="<u4").tobytes())) == expected([(i, texts[i])])[0][2:]


def test_edge_cases(spark, edges, edge_rows, no_docs):
    got = token_files.documents_of(token_files.read_segments(spark, written(edges))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, n, c) for i, _, n, c in expected([(r[0], r[1]) for r in edge_rows]) if i is not None
    )
    by_start = sorted(got, key=lambda r: r.start)
    assert len(by_start) == len(edge_rows)
    assert [r.start for r in by_start] == [sum(q.n_tokens for q in by_start[:k]) for k in range(len(by_start))]
    assert [r.doc_id for r in by_start] == sorted((r.doc_id for r in by_start), key=lambda i: (i is not None, i))
    assert token_files.documents_of(token_files.read_segments(spark, written(no_docs))).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 50, 4000])
def test_index_is_minimal_and_perfect(n):
    ids = [None, None, *range(0, 7 * n, 7)][:n]
    hashes = token_files.key_hashes(ids)
    slots = token_files.find_slots(hashes, token_files.build_index(hashes), n)
    assert sorted(slots.tolist()) == list(range(n))


def test_remembered_parts_keep_their_ids():
    from textlots.llm import pretokens

    held = pretokens.payloads(FILE, 10**9)
    texts = ["one two, three. one two three", "\n", "a\nb c", " x  y", "naïve Ünï, cödé! don't 漢字\nx", "x, x; x x! x:", "foo### *** bar%%%, it's 'tis x'y a<|endoftext|>b <|endoftext|> ñ### Ñandú. \nÑandú \nfoo# a_b x_",
             "--- |> <| ## '' \n## \n... don't, o'clock!"]
    for text in [*texts, *texts]:
        assert b"".join(held[part] for part in pretokens.cut(text)) == np.array(token_ids(text)[:-1], "<u4").tobytes()


def test_keyed_access_uses_the_index_alone(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_DOCS", 5)
    docs = spark.createDataFrame(
        [(i // 2, f"text number {i}") for i in range(40)] + [(None, "no id"), (500, None)], "doc_id long, text string"
    )
    folder = written(docs)
    # Files whose id lists are gone still answer by key.
    bare = work_dir(spark, "bare")
    token_files.read_segments(spark, folder).withColumn("doc_ids", token_files.F.lit(None).cast("array<bigint>")).write.parquet(bare)
    found = token_files.read_documents(spark, bare, [0, 7, 7, 19, 20, 500, -3]).collect()
    assert sorted(r.doc_id for r in found) == [0, 0, 7, 7, 19, 19, 500]
    assert {tuple(r.ids) for r in found if r.doc_id == 7} == {
        tuple(token_ids(f"text number {i}")) for i in (14, 15)
    }
    assert token_files.read_documents(spark, bare, []).collect() == []


def token_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids, 0]
