"""Token ids of byte-level BPE, as the tokenizer library gives them, for texts of any length.

Where a file's merges stand in the order of their ids, merging by id is merging by rank, and a faster
library gives the same ids; ``prepare`` proves that on the driver. Texts that the faster library
refuses, such as millions of blanks in a row, and files without that order go to the tokenizer library.

A long text is read in segments. A segment ends after a character that is no white space, before a
blank: no pre-token, special string or merge crosses that place, so segments give the ids of the whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from loomframe.llm.token_counts import byte_letters

SEGMENT = 1 << 18  # characters read at once, and on to the next safe cut
# Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"(?<=\S) ")


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts of ``size`` characters and on to the next safe cut."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@dataclass(frozen=True)
class Prepared:
    """A tokenizer file's text, the bytes of each id, and whether its merges stand in id order."""

    tokenizer: str
    token_bytes: tuple[bytes, ...]
    special: tuple[tuple[str, int], ...]
    ordered: bool


def prepare(path: str) -> Prepared:
    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    before = spec.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take their surroundings")
    model, special = spec["model"], {a["content"]: a["id"] for a in spec["added_tokens"]}
    of = {c: b for b, c in enumerate(byte_letters())}
    table = [b""] * (max([*model["vocab"].values(), *special.values()]) + 1)
    for word, number in model["vocab"].items():
        table[number] = word.encode() if word in special else bytes(of[c] for c in word)
    for word, number in special.items():
        table[number] = word.encode()
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ordered = [model["vocab"].get(m) for m in joined] == list(range(256, 256 + len(joined))) and not model.get("ignore_merges")
    return Prepared(text, tuple(table), tuple(special.items()), ordered)


class ByteBpe:
    """Encoder of one worker. ``special``: special strings in a text become their token, else they are plain text."""

    def __init__(self, prepared: Prepared, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task a core
        self.special, self.prepared, self.slow, self.fast = special, prepared, None, None
        if prepared.ordered:
            from tiktoken import Encoding

            named = dict(prepared.special)
            ranks = {b: i for i, b in enumerate(prepared.token_bytes) if i not in named.values()}
            self.fast = Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=named)

    def _part(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all" if self.special else set(), disallowed_special=())
            except ValueError:  # its pattern search gives up on very long runs
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.prepared.tokenizer)
            self.slow.encode_special_tokens = not self.special
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        parts = [self._part(part) for part in segments(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)
