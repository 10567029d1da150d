"""Packing against best-fit decreasing one document at a time, and ids against the tokenizer library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from loomframe.llm import byte_bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def library(special=True):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = not special
    return found


def one_by_one(lengths, limit):
    """Remaining capacities after best-fit decreasing, item by item."""
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= length]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= length
        else:
            left.append(limit - length)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_plan_equals_one_by_one(limit, data):
    lengths = data.draw(st.lists(st.integers(1, limit), max_size=120))
    runs, used = packing.plan(Counter(lengths), limit)
    content = defaultdict(list)
    for length, _, pieces, first, each, offset in runs.tolist():
        for k in range(pieces):
            content[first + k // each].append((offset + k % each * length, length))
    assert len(content) == used
    for held in content.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(limit - sum(n for _, n in held) for held in content.values()) == one_by_one(lengths, limit)


def test_plan_stays_small():
    runs, used = packing.plan({n: 10**12 + n for n in range(1, 1025)}, 1024)
    assert len(runs) < 10_000 and used >= sum((10**12 + n) * n for n in range(1, 1025)) // 1024


def test_tightest_finds_the_smallest_open_capacity():
    draw, found = random.Random(1), packing.OpenSequences(100)
    held = Counter()
    for k in range(2000):
        c = draw.randint(0, 100)
        if held[c] and draw.random() < 0.5:
            found.take(c)
            held[c] -= 1
        else:
            found.put(c, k, 1)
            held[c] += 1
        length = draw.randint(1, 100)
        assert found.tightest(length) == min((x for x in held if held[x] and x >= length), default=None)


ALPHABET = "abcXYZ019 \n\t  ''sdmtrvl,.!<|>é漢😀́▁\xa0 \x00"


@pytest.mark.parametrize("special", [True, False])
def test_ids_equal_the_library(special):
    prepared, draw = byte_bpe.prepare(PATH), random.Random(5)
    assert prepared.ordered
    own, whole = byte_bpe.ByteBpe(prepared, special), library(special)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 50))) + draw.choice(["", "<|endoftext|>", " <|endoftext|> a"]) for _ in range(5000)]
    texts += [" " * 300_000, "x" * 300_000, "word <|endoftext|> " * 60_000, "\n" * 100_000 + " a", " " * 2_000_000 + "a"]
    for text in texts:
        assert own.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_segments_give_the_ids_of_the_whole():
    draw, own, whole = random.Random(6), byte_bpe.ByteBpe(byte_bpe.prepare(PATH), True), library()
    for _ in range(500):
        text = "".join(draw.choices(ALPHABET + "     <|endoftext|>", k=draw.randint(0, 200)))
        parts = list(byte_bpe.segments(text, 10))
        assert "".join(parts) == text
        assert [i for p in parts for i in own.ids(p).tolist()] == whole.encode(text, add_special_tokens=False).ids


def check(rows, found, limit):
    whole, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert Counter(i for i, _ in rows).keys() == by_doc.keys()
    lengths = []
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: (r.piece, r.sequence_id, r.offset))
        copies = sum(1 for i, _ in rows if i == doc_id)
        assert len(pieces) % copies == 0
        at = 0
        for k, r in enumerate(pieces[::copies]):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= limit and (k == 0 or r.length == limit)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
            lengths.append(r.length)
        assert at == len(ids)
    for held in by_sequence.values():
        held.sort()
        ends = np.cumsum([n for _, n in held])
        assert [o for o, _ in held] == [0, *ends[:-1].tolist()] and ends[-1] <= limit
    assert len(by_sequence) == len(one_by_one(lengths, limit))


def test_odd_texts(spark):
    texts = [None, "", " ", "a", "b " * 5000, "x" * 200_000, "é<|endoftext|>😀", *["same text here"] * 300, "w " * 1023, "w " * 1024]
    rows = [*enumerate(texts), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"piece": F.lit("x"), "length": F.lit(None), "offset": F.lit(1)})
    check(rows, packing.pack(df.repartition(7), PATH, 2).collect(), 1024)
    assert packing.pack(df.limit(0), PATH, 2).count() == 0


def test_whole_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in df.collect()], packing.pack(df, PATH, 2).collect(), 1024)
