"""A model without a pre-tokenizer compiles into tables, but doesn't encode whole texts."""

import json

import pytest

from tidemark.llm import bpe


def test_model_alone_has_tables_but_no_words():
    rules = json.loads(open(bpe.public_vocabulary(), "rb").read())
    assert bpe.unmet({k: v for k, v in rules.items() if k != "pre_tokenizer"}) == []
    assert bpe.unmet(rules | {"pre_tokenizer": None}) != []
    spec = json.dumps({"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]]}}).encode()
    assert bpe.Automaton(spec).encode_words([b"abb"]) == [[2, 1]]
    with pytest.raises(ValueError):
        bpe.Codec(spec)
