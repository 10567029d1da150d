"""The Merkle manifest against a plain-Python tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomframe.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, low=False):
    doc_id, text, lang, source, n_chars = row
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {lang: levels_of([leaf_of(r) for r in groups[lang]]) for lang in langs}
    top = levels_of([trees[lang][-1][0] for lang in langs])
    for at, lang in enumerate(langs):
        for i, row in enumerate(groups[lang]):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded, proof = leaf_of(row, changed), ""
            for levels, place in ((trees[lang], i), (top, at)):
                for level in levels[:-1]:
                    first = place // 8 * 8
                    left, right = level[first:place], level[place + 1 : first + 8]
                    proof += "".join(left + right)
                    folded, place = digest(*left, folded, *right), place // 8
            yield row[0], leaf_of(row), trees[lang][-1][0], top[-1][0], digest(proof), folded, folded == top[-1][0]


def texts(n, langs):
    draw = random.Random(n)
    return [(i, draw.choice([None, "", f"Ab É{i}", "X"]), draw.choice(langs), draw.choice([None, "s"]), draw.choice([None, i])) for i in range(n)]


CASES = {
    "nulls, repeated rows, a lone group": [*texts(300, [None, "en", "de", ""]), *[(None, "A", "en", None, None)] * 3, *[(5, "B", "en", "s", 1)] * 20, (7, "Q", "lone", None, 2)],
    "groups of one": [(i, "T", f"l{i}", "s", 1) for i in range(70)],
    "one row": [(1, "Long " * 100_000, "a", None, 1)],
    "one group, last run of one": texts(9, ["a"]),
    "a run exactly": texts(8, ["a"]),
}


@pytest.mark.parametrize("case", CASES)
def test_equals_plain_tree(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit(1), "leaf": F.lit("x"), "tree": F.lit(None)})
    found = [tuple(r) for r in merkle.manifest(df).collect()]
    assert sorted(found, key=str) == sorted(expected(rows), key=str)
    assert any(r[-1] for r in found) or case in ("one row",)


def test_empty_table(spark):
    found = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.count() == 0


def test_row_limit_of_recursion_is_put_back(spark):
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    merkle.manifest(spark.createDataFrame(texts(20, ["a"]), SCHEMA))
    assert spark.conf.get(name, None) == before


def test_places_of_a_busy_group(spark):
    """Equal rows fill several ranges and still get every place once."""
    df = spark.range(5000).select(F.when(F.col("id") < 4500, "hot").otherwise("b").alias("g"), F.lit(1).alias("k"))
    found = merkle.placed(df, ["g"], ["k"]).collect()
    assert sorted(r.place for r in found if r.g == "hot") == list(range(4500))
    assert {r.n for r in found if r.g == "b"} == {500}
