from __future__ import annotations

import random

import pytest
from public_tokenizers import path

from textlots.llm import pretokens, tokens

FILE = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def expected(tokenizer, rows):
    return sorted(
        ((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows),
        key=repr,
    )


def test_parts_encode_like_the_whole_text(tokenizer):
    rng = random.Random(3)
    signs = [*"ab Z.,'\n\t é…1漢😀ś \x1c\r", "<|endoftext|>", "  ", "'s", "'ll", " <|endoftext|> ", "\n\n", "word", " and"]
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        parts = pretokens.cut(text)
        assert "".join(map(pretokens.part_text, parts)) == text
        encoder = pretokens.encoder(FILE)
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert [i for part in parts for i in encoder.ids(part)] == want
        assert sum(map(encoder.count, parts)) == len(want)


@pytest.mark.parametrize("common", [0, 50, tokens.COMMON])
def test_counts_of_documents(some, tokenizer, common):
    docs, rows = some
    got = tokens.token_counts(docs, FILE, common)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(tokenizer, rows)


def test_edge_cases(edges, edge_rows, no_docs, tokenizer):
    got = tokens.token_counts(edges, FILE).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(tokenizer, [(r[0], r[1]) for r in edge_rows])
    assert tokens.token_counts(no_docs, FILE).collect() == []


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        pretokens.Encoder(path("word_bpe_49k.json"))
