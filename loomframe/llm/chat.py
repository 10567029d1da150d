"""Chat formatting: records of any known layout become canonical turns, then marked text with a loss mask.

A record is JSON text. Its nested field paths are hashed to a fingerprint, which selects a mapping
from a table; a mapping only states where turns, roles and texts lie. Each turn is formatted by
itself, so a conversation of any length spreads over tasks: its text is its segments in order.

The template marks every turn as ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and
texts get one more backslash after their first character, which is undone exactly when read back.

Missing records, and records without a mapping, give no turns (``unmapped`` lists the latter, and with them
records that are no JSON, nest too deeply, hold half a character or a turn that is no object); a missing role or text is empty. Repeated rows stay repeated. Columns of the input other than the
record are kept; one named like an output column is replaced by it. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, HEAD, TAIL, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, END, HEAD, TAIL, "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_TAILS = "|".join(sorted((re.escape(c[1:]) for c in CONTROLS), key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
SEGMENT = re.compile(rf"{re.escape(BEGIN + HEAD)}(.*?){re.escape(TAIL)}(.*){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


@dataclass(frozen=True)
class Mapping:
    """Where one layout keeps its turns.

    ``turns`` is the path of a list with ``role`` and ``text`` fields in each item. Without it,
    ``fields`` lists (field path, role): each named field is one turn, in this order; further
    fields of the same role are joined by an empty line. ``roles`` renames what ``role`` holds.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


PERSONS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("chatgpt", "assistant"))
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), "messages"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=PERSONS),
    Mapping("turns", ("dialog.turns[].speaker", "dialog.turns[].text"), "dialog.turns", "speaker", "text", roles=PERSONS),
    Mapping("prompt", ("prompt",), fields=(("prompt", "user"),)),
    Mapping("completion", ("completion",), fields=(("completion", "assistant"),)),
    Mapping("prompt_completion", ("completion", "prompt"), fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("question_answer", ("answer", "question"), fields=(("question", "user"), ("answer", "assistant"))),
    Mapping("instruction", ("instruction", "output"), fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping(
        "instruction_input",
        ("input", "instruction", "output"),
        fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")),
    ),
    Mapping("system", ("system",), fields=(("system", "system"),)),
)


_HALF = re.compile(r"\\u[dD][89a-fA-F]")  # an escape of half a character, paired or not


def field_paths(value: Any, at: str = "") -> Iterator[str]:
    """Nested paths of all leaves; list items share one path."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from field_paths(inner, f"{at}.{key}" if at else key)
    elif isinstance(value, list):
        for inner in value:
            yield from field_paths(inner, f"{at}[]")
    else:
        yield at


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _at(value: Any, path: str) -> Any:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: Any, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of one record."""
    if mapping.turns:
        names = dict(mapping.roles)
        pairs = [(_text(x.get(mapping.role)), _text(x.get(mapping.text))) for x in _at(record, mapping.turns) or []]
        return [(names.get(role, role), text) for role, text in pairs]
    out: list[tuple[str, str]] = []
    for path, role in mapping.fields:
        text = _text(_at(record, path))
        if out and out[-1][0] == role:
            out[-1] = (role, f"{out[-1][1]}\n\n{text}" if text else out[-1][1])
        else:
            out.append((role, text))
    return out


def _parsed(record: str | None) -> Any:
    """The record's value; None where there is none, where it nests too deeply, or where an escape gives half a character."""
    try:
        value = None if record is None else json.loads(record)
        if value is not None and _HALF.search(record):
            json.dumps(value, ensure_ascii=False).encode()
        return value
    except (ValueError, RecursionError):  # what cannot be encoded is a ValueError too
        return None


def layout_of(value: Any) -> list[str]:
    """Sorted distinct field paths of a parsed record."""
    try:
        return ["(no JSON)"] if value is None else sorted(set(field_paths(value)))
    except RecursionError:
        return ["(too deep)"]


def _fits(value: Any, mapping: Mapping) -> bool:
    """Empty lists and objects have no paths: every turn must be an object all the same."""
    found = _at(value, mapping.turns) if mapping.turns else []
    return isinstance(found, list) and all(isinstance(x, dict) for x in found)


def canonical_turns(records: DataFrame, record: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """One row per turn: the other input columns, ``layout``, ``part`` (place in its record), ``role``, ``text``."""
    table = {fingerprint(m.paths): m for m in mappings}
    added = {"layout": T.StringType(), "part": T.LongType(), "role": T.StringType(), "text": T.StringType()}
    kept = [c for c in records.columns if c != record and c not in added]
    schema = T.StructType([records.schema[c] for c in kept] + [T.StructField(k, v) for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], {k: [] for k in added}
            for i, raw in enumerate(batch.column(batch.num_columns - 1)):
                value = _parsed(raw.as_py())
                mapping = table.get(fingerprint(layout_of(value)))
                for part, (role, text) in enumerate(turns_of(value, mapping) if mapping and _fits(value, mapping) else ()):
                    rows.append(i)
                    for name, cell in zip(added, (mapping.name, part, role, text), strict=True):
                        made[name].append(cell)
            left = batch.take(pa.array(rows, pa.int64())).columns[:-1]
            right = [pa.array(made[k], pa.int64() if k == "part" else pa.string()) for k in added]
            yield pa.RecordBatch.from_arrays([*left, *right], names=[*kept, *added])

    return records.select(*kept, F.col(record).alias("_record")).mapInArrow(run, schema)


def unmapped(records: DataFrame, record: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Count of records by fingerprint for which no mapping is known, with one sample layout."""
    known = {fingerprint(m.paths): m for m in mappings}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str]] = []
            for raw in batch.column(0):
                value = _parsed(raw.as_py())
                paths = layout_of(value)
                mapping = known.get(fingerprint(paths))
                if mapping is None or not _fits(value, mapping):
                    found.append((fingerprint(paths), " ".join(paths)))
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["fingerprint", "paths"])

    odd = records.select(record).mapInArrow(run, "fingerprint string, paths string")
    return odd.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"), F.min("paths").alias("paths"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Add ``segment`` (the marked turn) and the loss mask [``loss_start``, ``loss_end``) in its code points.

    The mask covers the escaped text of an assistant's turn and nothing else.
    """
    added = {"segment": T.StringType(), "loss_start": T.LongType(), "loss_end": T.LongType()}
    kept = [c for c in turns.columns if c not in added]
    schema = T.StructType([turns.schema[c] for c in kept] + [T.StructField(k, v) for k, v in added.items()])
    at_role, at_text = kept.index("role"), kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, starts, ends = [], [], []
            for role, text in zip(batch.column(at_role), batch.column(at_text), strict=True):
                head = BEGIN + HEAD + escape(role.as_py() or "") + TAIL
                body = escape(text.as_py() or "")
                segments.append(head + body + END)
                starts.append(len(head))
                ends.append(len(head) + (len(body) if role.as_py() == "assistant" else 0))
            made = [pa.array(segments, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*kept, *added])

    return turns.select(*kept).mapInArrow(run, schema)


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


class _Digest:
    """What one conversation's segments add up to; holds no text."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, end: int) -> None:
        role, text = read_back(segment)
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{role}\n{text}\n".encode())
        masked = unescape(segment[start:end])
        self.loss += len(masked)
        self.masked.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def digests(formatted: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per ``conv_id``, read back from the formatted segments in ``order``.

    A digest needs a conversation's turns in order, so they stream through one task; it keeps a
    running hash, never the text.
    """
    parts = formatted.select("conv_id", *order, "segment", "loss_start", "loss_end").repartition("conv_id")
    parts = parts.sortWithinPartitions("conv_id", *order).select("conv_id", "segment", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Digest | None = None
        for batch in batches:
            done = []
            for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state.conv != conv:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(conv)
                state.add(segment, start, end)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), DIGEST, strict=True)], schema=DIGEST)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(state.row(), DIGEST, strict=True)], schema=DIGEST)

    return parts.mapInArrow(
        run,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
