"""Alignment of tokenizers: fragments compose like the whole, results equal a plain version."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from loomframe.llm import align

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
PAIR = align.prepare(FIRST, SECOND)
OWN = align.Aligner(PAIR)
ALPHABET = "abc  xyz\n\té漢😀́\xa0.,!?<s>019 "


def plain_groups(text):
    """Groups of a text, straight from the libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not plain_groups.__dict__:
        plain_groups.a, plain_groups.b = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
        plain_groups.a.encode_special_tokens = True
        marks = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in marks]
        plain_groups.of = {chr(b): b for b in marks} | {chr(256 + k): b for k, b in enumerate(rest)}
    if not text:
        return []
    sides = []
    ids = plain_groups.a.encode(" " + text, add_special_tokens=False).ids
    sides.append([(i, bytes(plain_groups.of[c] for c in plain_groups.a.id_to_token(i))) for i in ids])
    model = plain_groups.b
    pieces = [(i, model.id_to_piece(i)) for i in model.encode(text)]
    sides.append([(i, bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
    if any(b"".join(b for _, b in side) != (" " + text).encode() for side in sides):
        return []
    ends = []
    for side in sides:
        at, own = 0, []
        for i, b in side:
            at += len(b)
            own.append((at, i))
        ends.append(own)
    common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
    groups = [([], []) for _ in common]
    for side, own in enumerate(ends):
        for e, i in own:
            groups[bisect.bisect_left(common, e)][side].append(i)
    return groups


def plain(texts):
    groups = [plain_groups(t) for t in texts]
    counts = Counter((a[-1], b[-1]) for own in groups for a, b in own)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for own in groups:
        found = [(a[-1], b[-1]) for a, b in own]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        yield (
            sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(found), sum(counts[p] == best[p[1]] for p in found),
            sum(counts[p] for p in found), hashlib.sha256(text.encode()).hexdigest() if own else "",
        )


def parts_of(text, chunk, reach):
    return [OWN.fragment(window, skip, size) for _, size, window, skip in align.ranges(" " + text, chunk, reach)]


def same(x, y):
    return align._to_row(x) == align._to_row(y)


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, min_size=1, max_size=300), st.integers(3, 60))
def test_fragments_give_the_whole(text, chunk):
    whole = OWN.fragment(" " + text, 0, len(text) + 1)
    parts = parts_of(text, chunk, 50)
    total = align.Fragment()
    for part in parts:
        total = total + part
    assert OWN.finished(1, total) == OWN.finished(1, whole)


def test_composition_is_associative_with_a_neutral_element():
    draw, open_sides = random.Random(3), 0
    for _ in range(200):
        text = "".join(draw.choices(["international ", "counterexample ", "é漢 ", "aaa", "x y ", "\n"], k=30))
        parts = parts_of(text, 7, 40)
        open_sides += sum(len(p.tail[0]) + len(p.tail[1]) > 0 or not p.closes for p in parts)
        for x, y, z in zip(parts, parts[1:], parts[2:]):
            assert same((x + y) + z, x + (y + z))
        assert same(align.Fragment() + parts[0], parts[0]) and same(parts[-1] + align.Fragment(), parts[-1])
    assert open_sides > 500  # ranges do end inside groups


def test_every_blank_behind_text_is_a_safe_cut():
    assert PAIR.cuts
    draw = random.Random(9)
    for _ in range(300):
        text = "".join(draw.choices(ALPHABET, k=120))
        whole = OWN.second.encode(text)
        at = [m.start() for m in align._CUT.finditer(" " + text)]
        cut = [i for a, b in zip([0, *at], [*at, None]) for i in OWN.second.encode((" " + text)[a:b][1:]) or [OWN.blank] * (a > 0)]
        assert cut == whole


TEXTS = [
    None, "", " ", "  a  b  ", "a\n\nb\tc", "▁x", "a ▁ b", "<s> </s><unk><|endoftext|>", "<0x41>", "a\x00b", "é é ﬁ 漢字 😀",
    "same words again", "same words again", "word " * 20_000, "x" * 100_000, "international " * 8_000 + "z" * 9000 + " tail" * 9000,
]


@pytest.mark.parametrize("chunk", [50, align.CHUNK])
def test_equals_plain(spark, chunk):
    texts = TEXTS if chunk > 50 else [t for t in TEXTS if not t or len(t) < 50_000] + ["counterexample of international words " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"row": F.lit(1), "number": F.lit("x"), "unit": F.lit(None)})
    found = align.scored(align.align(df.repartition(3), PAIR, chunk, chunk)).collect()
    expected = {i: x for i, x in enumerate(plain(texts))}
    assert {r.doc_id: tuple(r)[1:] for r in found} == expected and len(found) == len(texts)


def test_whole_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = df.collect()
    found = align.scored(align.align(df, PAIR, 2000)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == dict(zip([r.doc_id for r in rows], plain([r.text for r in rows])))


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some words here " * 10), (1, "some words here " * 10), (None, "other")], "doc_id bigint, text string")
    found = sorted(tuple(r) for r in align.scored(align.align(df, PAIR, 40)).filter("doc_id = 1").collect())
    assert len(found) == 2 and found[0] == found[1]
    empty = align.scored(align.align(df.limit(0), PAIR))
    assert empty.count() == 0 and empty.columns == align._names(align.RESULT)
