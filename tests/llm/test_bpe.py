"""Forced-boundary BPE against the tokenizers library."""

import random

import pytest
from tokenizers import Tokenizer

from veridect.llm.bpe import bpe, decode_documents, encode_documents, round_trip
from veridect.llm.frames import ByteBoundCache
from veridect.llm.tokens import tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TEXTS = [
    "",
    " ",
    "a <|endoftext|> b<|startoftext|>x <|endoftext|><|endoftext|>",
    "it's WE'LL don't 'S 're4l İ ΑΣ Σ ŉ ǅ ½ x² é é ́x ẛ̣",
    "\x1c\x1d\x85\xa0 　​﻿ a\x0bb\x00c",
    "</w> w> <w/>",
    "汉字 漢字かな 한국어 \U0001f600\U0001f468‍\U0001f469 ไทย देवनागरी",
    "x" * 5000,
    "ab1" * 3000 + "\n" * 50,
    "--==~~" * 200,
]


def library(name, texts):
    tool = Tokenizer.from_file(tokenizer_path(name))
    tool.no_truncation()
    tool.no_padding()
    ids = [tool.encode(t or "", add_special_tokens=False).ids for t in texts]
    return [(i, tool.decode(i, skip_special_tokens=False)) for i in ids]


def own(name, texts):
    tool = bpe(tokenizer_path(name))
    coded = tool.encode(texts)
    return [(memoryview(c).cast("I").tolist(), tool.decode(c)) for c in coded]


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    assert own(name, TEXTS) == library(name, TEXTS)


@pytest.mark.parametrize("name", FILES)
def test_random_texts(name):
    rng = random.Random(3)
    kinds = [list(map(chr, range(32, 127))), list("abcdeéüß '\n"), [chr(c) for c in range(1, 0x2100)], list("́̈aeiouAEIOU Å각")]
    texts = ["".join(rng.choices(kinds[i % 4], k=rng.randint(1, 300))) for i in range(800)]
    assert own(name, texts) == library(name, texts)


def test_documents(spark, docs):
    path = tokenizer_path(FILES[0])
    rows = decode_documents(encode_documents(docs, path), path).select("text", "ids", "n_tokens", "decoded").collect()
    want = library(FILES[0], [r["text"] for r in rows])
    assert [(memoryview(bytes(r["ids"])).cast("I").tolist(), r["decoded"]) for r in rows] == want
    assert [r["n_tokens"] for r in rows] == [len(i) for i, _ in want]


def test_odd_rows(spark, odd, empty):
    path = tokenizer_path(FILES[0])
    done = decode_documents(encode_documents(odd.withColumnRenamed("piece", "ids"), path), path)
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "words", "score", "ids", "n_tokens", "decoded"]
    rows = done.collect()
    want = library(FILES[0], [r["text"] for r in rows])
    assert [(memoryview(bytes(r["ids"])).cast("I").tolist(), r["decoded"]) for r in rows] == want
    assert len(rows) == odd.count()
    at_once = round_trip(odd.withColumnRenamed("piece", "ids"), path)
    assert at_once.columns == done.columns and sorted(map(str, at_once.collect())) == sorted(map(str, rows))
    assert decode_documents(encode_documents(empty, path), path).collect() == []


def test_cuts_are_at_pairs_that_no_token_holds():
    tool = bpe(tokenizer_path(FILES[0]))
    tokens = [t.removesuffix("</w>") for t in tool.spelled]
    word = "qzxjq"  # letters of one byte each
    _, _, start = tool.cuts([word.encode()])
    inside = {i for i in range(1, len(word)) if not any(word[i - 1 : i + 1] in t for t in tokens)}
    assert inside and inside <= set(start.tolist())
    assert len(tool.cuts([b"running"])[2]) == 1


def test_cache_holds_its_bound_and_what_is_asked_for():
    cache = ByteBoundCache(100_000)
    for i in range(5000):
        assert cache.unknown({f"key{i}", "often"}) == [f"key{i}"] or i == 0
        cache |= {f"key{i}": b"x" * 20, "often": b"y"}
        if i % 100 == 0:
            cache.settle()
            assert cache.held <= 50_000 and cache.held == sum(len(k) + len(v) + cache.OVERHEAD for k, v in cache.items())
            assert len(cache.back) <= 400
    assert cache["key4999"] == b"x" * 20 and cache.unknown({"key0", "often"}) == ["key0"]
