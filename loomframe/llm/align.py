"""Alignment of two tokenizers by the bytes of their tokens, over documents of any length.

Byte offsets where tokens of both end cut a document into groups; the last tokens of a group are
linked. A byte range of a document gives a fragment: the open prefix (tokens up to the first common
end), the closed groups, and the open suffix (tokens after the last one); a token belongs to the range
it ends in. Fragments compose associatively: the suffix of one and the prefix of the next close a group,
or stay open where the range has no common end. Documents longer than CHUNK are cut into byte ranges
wherever they fall; their fragments are made in tasks of their own and composed as a tree of
shuffles, FAN at a time. A short document is one fragment.

A range is tokenized in a window that reaches out to the next safe cuts, a blank behind a character
that is no white space: no token of either side crosses that place, which ``prepare`` proves from the
vocabulary. Where no safe cut lies within REACH, the ranges on both sides stay one.

How often an id pair is linked is counted over all documents in a Spark table. Units of documents of
bounded size ask it for their distinct pairs by join, so nothing of it is collected or broadcast and
a frequent pair is asked for once a unit.

Missing and empty texts, and texts whose tokens do not give their bytes back, have no tokens: zeros and ''.
Repeated rows count as often as they stand; ties for the highest count are all highest. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm import byte_bpe
from loomframe.llm.words import slices
from loomframe.session import materialize

CHUNK = 1 << 15  # characters of a byte range
REACH = 1 << 12  # characters from the end of a range to a safe cut, at most
FAN = 16  # fragments composed by one task
UNIT = 1 << 21  # links that are looked up at once
BYTES = 1 << 21  # bytes of rows that a worker holds as Python objects
BLOCK = 1 << 20  # marked ids that are written as text at once
_CUT = re.compile(r"(?<=\S) ")


@dataclass(frozen=True)
class Pair:
    """Both tokenizers: the first as prepared file, the second as path with the bytes of each id.

    ``lossless``: the first has every byte as a token, so its tokens always give a text back; ``cuts``: blanks are safe cuts.
    """

    first: byte_bpe.Prepared
    second: str
    second_bytes: tuple[bytes, ...]
    lossless: bool
    cuts: bool


def prepare(first: str, second: str) -> Pair:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=second)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = tuple(bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces))
    # Merges only make pieces: a place inside no piece is never crossed. Blanks must also come through unchanged.
    probe = "  a  b \n c  "
    kept = b"".join(table[i] for i in model.encode(probe)) == b" " + probe.encode()
    cuts = kept and not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not model.is_control(i))
    own = byte_bpe.prepare(first)
    return Pair(own, second, table, {bytes([b]) for b in range(256)} <= set(own.token_bytes), cuts)


_NONE = np.empty(0, np.uint32)
SECOND, LAST = np.uint32(1 << 31), np.uint32(1 << 30)  # marks of a code: id of the second tokenizer; last of its side in a group
ID = np.uint32((1 << 30) - 1)


@dataclass
class Fragment:
    """What a byte range says of a document's groups.

    Without a common end (``closes`` false) all its tokens are in the open prefix. ``groups`` has the closed groups
    between the first and the last common end, as marked ids: the first side of a group, then its second.
    """

    closes: bool = False
    head: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)
    groups: np.ndarray = field(default_factory=lambda: _NONE)
    tail: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)
    tokens: tuple[int, int] = (0, 0)
    whole: bool = True

    def __add__(self, other: Fragment) -> Fragment:
        tokens, whole = (self.tokens[0] + other.tokens[0], self.tokens[1] + other.tokens[1]), self.whole and other.whole
        if not self.closes:
            return Fragment(other.closes, _after(self.head, other.head), other.groups, other.tail, tokens, whole)
        if not other.closes:
            return Fragment(True, self.head, self.groups, _after(self.tail, other.head), tokens, whole)
        groups = np.concatenate([self.groups, _group(*_after(self.tail, other.head)), other.groups])
        return Fragment(True, self.head, groups, other.tail, tokens, whole)


def _after(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])


def _group(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One group as marked ids."""
    return _groups(a, b, np.array([0, len(a)]), np.array([0, len(b)]))


def _groups(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> np.ndarray:
    """Groups as marked ids; ``to_a`` and ``to_b`` say where each group ends, and start with 0."""
    codes = np.empty(len(a) + len(b), np.uint32)
    mine = np.arange(len(a)) + np.repeat(to_b[:-1], np.diff(to_a))
    yours = np.arange(len(b)) + np.repeat(to_a[1:], np.diff(to_b))
    codes[mine], codes[yours] = a, b | SECOND
    codes[mine[to_a[1:] - 1]] |= LAST
    codes[yours[to_b[1:] - 1]] |= LAST
    return codes


class Aligner:
    """Tokenizes ranges with both tokenizers; one per worker."""

    def __init__(self, pair: Pair):
        from sentencepiece import SentencePieceProcessor

        self.first = byte_bpe.ByteBpe(pair.first, special=False)
        self.second = SentencePieceProcessor(model_file=pair.second)
        self.blank = self.second.piece_to_id("▁")
        self.bytes = (pair.first.token_bytes, pair.second_bytes)
        self.sizes = tuple(np.array([len(b) for b in table], np.int64) for table in self.bytes)
        # Ids as text with what follows them: a comma, or at the end of a group a bar (first) or semicolon (second).
        kinds = len(self.bytes[0]), len(self.bytes[1])
        self.words = [f"{i}{mark}" for n, marks in zip(kinds, (",|", ",;"), strict=True) for i in range(n) for mark in marks]
        self.checked = [k for k in (0, 1) if k or not pair.lossless]

    def fragment(self, window: str, skip: int, size: int) -> Fragment:
        """Fragment of ``size`` characters of a window from ``skip`` on; the window starts with a blank."""
        second = self.second.encode(window[1:], num_threads=1) if len(window) > 1 else [self.blank]  # it adds no blank to nothing
        ids = [self.first.ids(window), np.array(second, np.uint32)]
        raw = window.encode()
        if any(b"".join(map(self.bytes[k].__getitem__, ids[k].tolist())) != raw for k in self.checked):
            return Fragment(whole=False)
        ends = [np.cumsum(sizes[own]) for sizes, own in zip(self.sizes, ids, strict=True)]
        if skip or size < len(window):
            low = len(window[:skip].encode())
            high = low + len(window[skip : skip + size].encode())
            span = [slice(*np.searchsorted(e, (low, high), "right").tolist()) for e in ends]
            ids, ends = [x[s] for x, s in zip(ids, span, strict=True)], [e[s] for e, s in zip(ends, span, strict=True)]
        (a, b), tokens = ids, (len(ids[0]), len(ids[1]))
        place = np.searchsorted(ends[1], ends[0])
        common = np.flatnonzero(ends[1][np.minimum(place, len(b) - 1)] == ends[0]) if len(b) else place[:0]
        if not len(common):
            return Fragment(False, (a, b), tokens=tokens)
        to_a, to_b = common + 1, place[common] + 1
        head, tail = (a[: to_a[0]], b[: to_b[0]]), (a[to_a[-1] :], b[to_b[-1] :])
        groups = _groups(a[to_a[0] : to_a[-1]], b[to_b[0] : to_b[-1]], to_a - to_a[0], to_b - to_b[0])
        return Fragment(True, head, groups, tail, tokens, True)

    def digest(self, groups: np.ndarray) -> str:
        """Hash of groups as text, read in blocks."""
        found = hashlib.sha256()
        for at in range(0, len(groups), BLOCK):
            part = groups[at : at + BLOCK]
            word = (part & ID).astype(np.int64) * 2 + (part & LAST != 0) + np.where(part & SECOND, 2 * len(self.bytes[0]), 0)
            text = "".join(map(self.words.__getitem__, word.tolist()))
            found.update((text if at + BLOCK < len(groups) else text[:-1]).encode())  # nothing follows the last group
        return found.hexdigest()

    def finished(self, doc_id: int | None, found: Fragment) -> tuple:
        """Result of a document from its whole fragment: the open prefix is its first group."""
        if not found.whole or not found.closes:
            return doc_id, 0, 0, 0, "", b""
        groups = np.concatenate([_group(*found.head), found.groups])
        last = groups[groups & LAST != 0] & ID  # of the first side, of the second, and so on
        return doc_id, *found.tokens, len(last) // 2, self.digest(groups), last.astype("<u4").tobytes()


_ALIGNERS: dict[int, tuple[Pair, Aligner]] = {}


def aligner(pair: Pair) -> Aligner:
    """The worker's aligner, made once."""
    if id(pair) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[id(pair)] = (pair, Aligner(pair))
    return _ALIGNERS[id(pair)][1]


# --- fragments as rows

_ROW = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, unit bigint"
_CHUNK = "doc_id bigint, row bigint, unit bigint, number bigint, window string, skip int, size int"
_FRAGMENT = (
    "doc_id bigint, row bigint, unit bigint, number bigint, closes boolean, head_a binary, head_b binary, groups binary, "
    "tail_a binary, tail_b binary, n_a bigint, n_b bigint, whole boolean"
)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=_names(schema))


def _to_row(found: Fragment) -> tuple:
    sides = [x.astype("<u4").tobytes() for x in (*found.head, found.groups, *found.tail)]
    return found.closes, *sides, *found.tokens, found.whole


def _from_row(r: dict) -> Fragment:
    of = {c: np.frombuffer(r[c], "<u4") for c in ("head_a", "head_b", "groups", "tail_a", "tail_b")}
    return Fragment(r["closes"], (of["head_a"], of["head_b"]), of["groups"], (of["tail_a"], of["tail_b"]), (r["n_a"], r["n_b"]), r["whole"])


def ranges(raw: str, chunk: int, reach: int) -> Iterator[tuple[int, int, str, int]]:
    """(number, size, window, skip): ranges of about ``chunk`` characters with the windows they are tokenized in."""
    cuts = [(0, 0, 0)]  # where a range starts, and the safe cuts before and after
    for at in range(chunk, len(raw), chunk):
        left = next((i for i in range(at, max(at - reach, 0), -1) if raw[i] == " " and not raw[i - 1].isspace()), None)
        right = _CUT.search(raw, at, at + reach)
        if left is not None and right:
            cuts.append((at, left, right.start()))
    cuts.append((len(raw), len(raw), len(raw)))
    for number, ((start, left, _), (stop, _, right)) in enumerate(zip(cuts, cuts[1:])):
        yield number, stop - start, raw[left:right], start - left


def align(docs: DataFrame, pair: Pair, chunk: int = CHUNK, reach: int = REACH, text: str = "text") -> DataFrame:
    """Per document _ROW: counts, digest of its groups, its links (pairs of little-endian 32-bit ids), and the unit it is looked up in."""
    shared = docs.sparkSession.sparkContext.broadcast(pair)  # as large as the vocabularies, whatever the input
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    long = (F.char_length("text") > chunk) & F.lit(pair.cuts)

    def short_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unit, held = aligner(shared.value), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, BYTES):
                texts = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                rows = [(*own.finished(i, own.fragment(" " + t, 0, len(t) + 1) if t else Fragment()), unit) for i, t in texts]
                held += sum(r[3] for r in rows)
                if held > UNIT:
                    unit, held = unit + 1, 0
                yield _batch(rows, _ROW)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held = TaskContext.get().partitionId() << 40, 0
        unit = -1 - (TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, size, window, skip in ranges(" " + t.as_py(), chunk, reach):
                    yield _batch([(doc_id, row, unit, n, window, skip, size)], _CHUNK)
                    held += size
                row += 1
                if held > 2 * UNIT:
                    unit, held = unit - 1, 0

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(shared.value)
        for batch in batches:
            for part in slices(batch, BYTES):
                rows = [(r["doc_id"], r["row"], r["unit"], r["number"], *_to_row(own.fragment(r["window"], r["skip"], r["size"]))) for r in part.to_pylist()]
                yield _batch(rows, _FRAGMENT)

    def compose(group: pa.Table) -> tuple[dict, Fragment]:
        rows = sorted(group.to_pylist(), key=lambda r: r["number"])
        return rows[0], reduce(Fragment.__add__, map(_from_row, rows))

    def step(group: pa.Table) -> pa.Table:
        first, found = compose(group)
        return pa.Table.from_batches([_batch([(*(first[c] for c in ("doc_id", "row", "unit")), first["number"] // FAN, *_to_row(found))], _FRAGMENT)])

    def finish(group: pa.Table) -> pa.Table:
        first, found = compose(group)
        return pa.Table.from_batches([_batch([(*aligner(shared.value).finished(first["doc_id"], found), first["unit"])], _ROW)])

    short = plain.filter(~long).mapInArrow(short_ones, _ROW)
    if not pair.cuts:
        return short
    longest = plain.agg(F.max(F.char_length("text"))).first()[0] or 0
    tree = plain.filter(long).mapInArrow(cut, _CHUNK).repartition("row", "number").mapInArrow(fragments, _FRAGMENT)
    most = longest // chunk + 1  # fragments of a document
    while most > FAN:
        above = tree.withColumn("_above", F.expr(f"number div {FAN}")).groupBy("row", "_above")
        tree, most = above.applyInArrow(lambda group: step(group.drop_columns(["_above"])), _FRAGMENT), -(-most // FAN)
    return short.unionByName(tree.groupBy("unit", "row").applyInArrow(finish, _ROW))


# --- counts over all documents


def _pairs(links: pa.Array) -> Iterable[np.ndarray]:
    """The links of each row as one 64-bit number per link."""
    for x in links:
        ids = np.frombuffer(x.as_buffer() or b"", "<u4").astype(np.int64)
        yield (ids[::2] << 32) | ids[1::2]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, count), added up whenever UNIT links have gathered."""
    held, size = [], 0

    def made() -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(counts[at : at + 100_000])], names=["pair", "count"])
        held.clear()

    for batch in batches:
        for found in _pairs(batch.column(0)):
            held.append(found)
            size += len(found)
            if size > UNIT:
                yield from made()
                size = 0
    if held:
        yield from made()


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each run of rows of one unit."""
    unit, held = None, []

    def made() -> Iterator[pa.RecordBatch]:
        keys = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
        for at in range(0, len(keys), 100_000):
            part = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), unit, np.int64)), pa.array(part)], names=["unit", "pair"])

    for batch in batches:
        for own, found in zip(batch.column(0).to_pylist(), _pairs(batch.column(1)), strict=True):
            if own != unit:
                yield from made()
                unit, held = own, []
            held.append(found)
    yield from made()


def _summed(rows: pa.Table, answers: pa.Table) -> pa.Table:
    keys, counts, best = (answers.column(c).to_numpy() for c in ("pair", "count", "best"))
    by = np.argsort(keys)
    keys, counts, best = keys[by], counts[by], best[by]
    sums, bests = [], []
    for chunk in rows.column("links").chunks:
        for found in _pairs(chunk):
            at = np.searchsorted(keys, found)
            sums.append(int(counts[at].sum()) if len(found) else 0)
            bests.append(int(best[at].sum()) if len(found) else 0)
    kept = rows.select(["doc_id", "n_a", "n_b", "n_groups"])
    made = [rows.column("n_groups"), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), rows.column("groups_sha256")]
    return pa.Table.from_arrays([*kept.columns, *made], names=_names(RESULT))


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how often each id pair is linked, and whether its second id is linked no oftener otherwise."""
    counts = materialize(aligned.select("links").mapInArrow(_counted, "pair bigint, count bigint").groupBy("pair").agg(F.sum("count").alias("count")), "pairs")
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(second.alias("b")).agg(F.max("count").alias("highest"))  # one row an id of the vocabulary
    return counts.withColumn("b", second).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def scored(aligned: DataFrame) -> DataFrame:
    """RESULT of aligned documents."""
    units = materialize(aligned, "aligned")
    wanted = units.select("unit", "links").mapInArrow(_wanted, "unit bigint, pair bigint")
    answers = wanted.join(pair_counts(units), "pair")
    return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_summed, RESULT)
