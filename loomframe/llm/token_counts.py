"""Exact token counts of byte-level BPE, mostly without merging.

Offline step: each vocabulary string is run through the merges alone; those that come out as one
token are the proven whole tokens. A text is cut into pre-tokens; a proven one counts one, and only
the rest is merged. Special strings inside a text are tokens of their own, as the library has it.

Missing texts count as empty: no bytes, no tokens. Texts may have any length: pre-tokens are read
one after the other. Rows are independent, so repeated rows and ties need no rule; an empty table
gives an empty result. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the pre-token pattern of byte-level BPE. White space is Unicode's property.
PRE_TOKENS = (
    r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
REMEMBERED = 600_000  # merged pre-tokens that a worker remembers at once
PIECE = 1 << 20  # longer texts are read pre-token by pre-token


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class WholeTokens:
    """A tokenizer file's text with its proven whole tokens and special strings: all a worker needs."""

    tokenizer: str
    whole: frozenset[str]
    special: tuple[str, ...]


def prove(path: str) -> WholeTokens:
    """Read a tokenizer file on the driver and prove which vocabulary strings are one token alone."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    kind = spec.get("pre_tokenizer") or {}
    if kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is counted")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take their surroundings are not counted")
    model, of = Tokenizer.from_str(text).model, {c: b for b, c in enumerate(byte_letters())}
    whole = set()
    for word in spec["model"]["vocab"]:
        if all(c in of for c in word) and len(model.tokenize(word)) == 1:
            try:
                whole.add(bytes(of[c] for c in word).decode())
            except UnicodeDecodeError:  # part of a character: never a whole pre-token
                continue
    return WholeTokens(text, frozenset(whole), tuple(a["content"] for a in spec["added_tokens"]))


class Counter:
    """Counts the tokens of texts; one per worker."""

    def __init__(self, proof: WholeTokens):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(proof.tokenizer).model
        self.whole = proof.whole
        self.merged: dict[str, int] = {}
        self.pattern = regex.compile(PRE_TOKENS)
        special = sorted(proof.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = dict(enumerate(byte_letters()))

    def merge(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            if len(piece) < 100:
                self.merged[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total, whole, merge = len(parts) - 1, self.whole, self.merge
        for part in parts:
            if len(part) > PIECE:
                total += sum(1 if m[0] in whole else merge(m[0]) for m in self.pattern.finditer(part))
            else:
                pieces = self.pattern.findall(part)
                rest = [p for p in pieces if p not in whole]
                total += len(pieces) - len(rest) + sum(map(merge, rest))
        return total


_COUNTERS: dict[int, tuple[WholeTokens, Counter]] = {}


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """The input with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    spark = docs.sparkSession
    proof = spark.sparkContext.broadcast(prove(path))  # as large as the vocabulary, whatever the input
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    kept = [c for c in docs.columns if c not in added]
    schema = T.StructType([f for f in docs.schema if f.name in kept] + [T.StructField(k, v) for k, v in added.items()])
    source = docs.select(*[docs[c] for c in kept], docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = proof.value
        if id(value) not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[id(value)] = (value, Counter(value))
        counter = _COUNTERS[id(value)][1]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes, counts = [], []
            for x in texts:
                word = x.as_py() or ""
                sizes.append(len(word.encode()))
                counts.append(counter.count(word))
            made = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *added])

    return source.mapInArrow(run, schema)
