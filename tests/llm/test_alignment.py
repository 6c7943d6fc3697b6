"""The alignment against one token at a time, with both libraries."""

import hashlib
from collections import Counter
from functools import lru_cache

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from veridect.llm import alignment
from veridect.llm.alignment import RESULTS, align_documents
from veridect.llm.bpe import byte_letters

FIRST, SECOND = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LETTERS = {c: b for b, c in enumerate(byte_letters())}


@lru_cache(maxsize=1)
def libraries():
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=SECOND)


def tokens(texts):
    """(id, start, end) of both tokenizers per text, or none."""
    a, b = libraries()
    out = []
    for text in texts:
        sides = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            sides.append([(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in ids])
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
        if not text or any(b"".join(d for _, d in side) != (" " + text).encode() for side in sides):
            out.append(([], []))
            continue
        placed = []
        for side in sides:
            at, row = 0, []
            for i, data in side:
                row.append((i, at, at + len(data)))
                at += len(data)
            placed.append(row)
        out.append(tuple(placed))
    return out


def plain(texts):
    coded = tokens(texts)
    links = []
    for a, b in coded:
        own, j = [], 0
        for i, start, end in a:
            while b[j][2] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][1] < end:
                own.append((i, b[k][0]))
                k += 1
        links.append(own)
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for (a, b), own in zip(coded, links, strict=True):
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        parts, low = [], 0
        for cut in cuts:
            side = [",".join(str(i) for i, s, e in x if low <= s and e <= cut) for x in (a, b)]
            parts.append("|".join(side))
            low = cut
        groups = ";".join(parts)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        rows.append((len(a), len(b), len(cuts), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), digest, groups))
    return rows


def check(spark, frame):
    rows = frame.collect()
    done = align_documents(frame, FIRST, SECOND)
    got = sorted((str(r["doc_id"]), *(r[c] for c in RESULTS)) for r in done.collect())
    want = sorted((str(r["doc_id"]), *p) for r, p in zip(rows, plain([r["text"] for r in rows]), strict=True))
    assert got == want
    return done


def test_documents(spark, docs):
    check(spark, docs.filter("length(text) < 20000").limit(120))


def test_odd_rows(spark, odd):
    more = [(i, t, "en", "s", 1, "x", 2.0, "y") for i, t in [(20, "▁"), (21, "a ▁b"), (22, "   "), (23, " x  \n\n y \n"), (24, "<s><0x0A></s>"), (25, "\U0001f468‍\U0001f469\x00é"), (26, "\n")]]
    frame = odd.filter("length(text) < 20000 OR text IS NULL").union(spark.createDataFrame(more, odd.schema)).withColumnRenamed("score", "n_best").withColumnRenamed("piece", "slice")
    done = check(spark, frame)
    assert done.columns == ["doc_id", "lang", "source", "n_chars", "words", "slice", *RESULTS]


def test_small_slices_and_batches(spark, docs, monkeypatch):
    import sys

    assert sys.modules[align_documents.__module__] is alignment
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3000)
    some = docs.filter("length(text) < 5000").limit(40).select("doc_id", "text").coalesce(1)
    check(spark, some)


def test_empty(spark, empty):
    assert align_documents(empty, FIRST, SECOND).collect() == []


SOME = "ab eé's l'x  \n.,;-'\"12½_中\t▁"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=SOME, min_size=1, max_size=30))
def test_stretches_equal_whole_texts(text):
    """Ids by certain cuts are those of the whole text."""
    tool, ((a, b),) = alignment.aligner(FIRST, SECOND), tokens([text])
    got = [memoryview(side[0]).cast("I").tolist() for side in tool.encode([text])]
    assert got == [[i for i, *_ in a], [i for i, *_ in b]]


@pytest.mark.parametrize("text", ["It's a l'été, isn't it?\n\n\nYes: 12,5 (x_y) ok.", "don't\n'tis", "a\u0301b c\u0301", "ÀÖ ×÷ ɏɐ", "x\n\ny\nz"])
def test_stretches_of_sentences(text):
    tool, ((a, b),) = alignment.aligner(FIRST, SECOND), tokens([text])
    got = [memoryview(side[0]).cast("I").tolist() for side in tool.encode([text])]
    assert got == [[i for i, *_ in a], [i for i, *_ in b]]
