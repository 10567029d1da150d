"""Operators for training corpora against brute force, and their results for odd inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import (
    bits,
    chat,
    components,
    cross_entropy,
    line_blocks,
    minmax_dedup,
    mixing,
    quality_rules,
    queries,
    string_tiling,
    token_counts,
    toxicity,
    url_lists,
    words,
)

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "Aa  b\x0bc\n\nc", "x" * 300_000, "é 😀\x00 z", "word " * 50_000]


def docs_of(spark, texts, extra=False):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.withColumns({"score": F.lit("kept?"), "size": F.lit("s"), "row": F.lit(1)}) if extra else df


def all_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- words, bits, components


def test_hashes_follow_words():
    texts = [*ODD, "A b a B", "x" * (words.BLOCK + 5) + " y " + "X" * (words.BLOCK + 5)]
    found, at = words.hash_words(pa.array(texts), words.blank_separated(lower=True))
    expected = [all_words(lower(t)) for t in texts]
    assert list(np.diff(at)) == [len(w) for w in expected]
    of: dict[str, int] = {}
    for word, h in zip([w for ws in expected for w in ws], found.tolist(), strict=True):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)
    part, _ = words.hash_words(pa.array(texts).slice(4, 2), words.blank_separated(lower=True))
    assert part.tolist() == found[at[4] : at[6]].tolist()


def test_windows_shorter_than_their_size():
    w = np.arange(3, dtype=np.uint64)
    assert len(words.windows(w, 2)) == 2 and len(words.windows(w, 5)) == 1 and len(words.windows(w[:0], 2)) == 0


def test_bit_filter_has_no_false_negatives(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("h")).unionByName(spark.createDataFrame([(None,)], "h bigint"))
    known = np.array([r.h for r in df.dropna().collect()]).view(np.uint64)
    found = bits.bit_filter(df, "h")
    assert found.holds(known).all()
    assert found.holds(words.mixed(np.arange(100_000, dtype=np.uint64))).mean() < 0.01


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    expected = {i: 1 for i in range(2, 61)} | {k: 100 for k in range(101, 140)}
    assert {r.node: r.component for r in found.collect()} == expected
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1


def test_url_lists_as_of(spark):
    entries = [
        ("spam", "domain", "bad.org", "add", date(2024, 1, 1)),
        ("spam", "domain", "bad.org", "add", date(2024, 1, 5)),
        ("spam", "domain", "bad.org", "remove", date(2024, 1, 10)),
        ("spam", "domain", "bad.org", "add", date(2024, 2, 1)),
        ("spam", "domain", "bad.org", "add", date(2024, 2, 1)),
        ("odd", "host", "x.net", "add", date(2024, 1, 1)),
        ("odd", "host", "x.net", "remove", date(2024, 1, 1)),
        ("page", "url", "ok.com/a", "add", date(2024, 1, 3)),
        (None, "url", "ok.com/a", "add", date(2024, 1, 3)),
    ]
    listed = spark.createDataFrame(entries, "list string, kind string, value string, action string, day date")
    captures = [
        (0, "http://www.BAD.org:80/x", date(2024, 1, 1)), (1, "http://bad.org", date(2024, 1, 9)),
        (2, "http://bad.org", date(2024, 1, 10)), (3, "https://u@bad.org/", date(2024, 3, 1)), (4, "http://notbad.org", date(2024, 3, 1)),
        (5, "http://x.net/", date(2024, 1, 2)), (6, "http://ok.com/a/?q#f", date(2024, 1, 3)), (7, "http://ok.com/a", date(2024, 1, 2)),
        (8, None, date(2024, 1, 2)), (9, "", date(2024, 1, 2)), (10, "http://bad.org", None), (1, "http://bad.org", date(2024, 1, 9)),
        (11, "http://" + "a." * 200_000, date(2024, 1, 9)), (12, "http://" + "a." * 200_000 + "bad.org/x", date(2024, 1, 9)),
        (13, "http://bad.org\\\\ok.com/a", date(2024, 1, 9)), (14, "http://www.bad.org./", date(2024, 1, 9)), (15, "http://org/", date(2024, 1, 9)),
    ]
    df = spark.createDataFrame(captures, "page_id int, url string, day date").withColumn("lists", F.lit("old"))
    found = sorted((r.page_id, tuple(r.lists), r.rejected) for r in url_lists.filter_urls(df, listed).collect())
    hit = {0: ("spam",), 1: ("spam",), 3: ("spam",), 6: ("page",), 12: ("spam",), 13: ("spam",), 14: ("spam",)}
    assert found == sorted((c[0], hit.get(c[0], ()), c[0] in hit) for c in captures)
    assert url_lists.filter_urls(df, listed.limit(0)).filter("rejected").count() == 0
    assert url_lists.filter_urls(df.limit(0), listed).count() == 0


# --- 2


def brute_quality(text):
    w = all_words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if all_words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_measures(spark):
    texts = [*ODD, "a b c d e f g h " * 2, "l\nl\nm\n \nl", "p q " * 9 + "z", "#|x <b> &"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    df = docs_of(spark, texts).withColumn("n_words", F.lit("old"))
    for r in quality_rules.judge(df).collect():
        counts = brute_quality(texts[r.doc_id])
        assert counts == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.doc_id
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_agrees_with_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "base_failed", "kept").collect()
    assert {(r.kept, labels[r.doc_id]) for r in judged if r.doc_id in labels and not r.base_failed} == {(True, 1), (False, 0)}


def test_quality_keep_leaves_rows_as_they_are(spark):
    good = "The cat and the dog sat on the mat with a hat for the day as it was in that place.\n" * 1 + "More of this text is here to read."
    df = docs_of(spark, [good, "!!", None, good], extra=True)
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3]


# --- 3


def test_cross_entropy_prefers_the_target(spark):
    good = [f"the cat sat on mat number {i % 5}" for i in range(40)]
    noise = [f"zz{i} qq{i} xx yy xx yy" for i in range(40)]
    df = docs_of(spark, [*good, *noise, None, ""], extra=True)
    model = cross_entropy.fit(df, np.arange(20))
    rows = {r.doc_id: r for r in cross_entropy.score(df, model).collect()}
    assert min(rows[i].score for i in range(40)) > max(rows[i].score for i in range(40, 80))
    assert (rows[80].n_words, rows[80].score, rows[81].score) == (0, 0.0, 0.0) and rows[0].n_words == 7
    size = len(model.vocabulary) + 1
    kept = {b: 2.0 ** model.pair_logs[model.pairs // size == b] for b in set((model.pairs // size).tolist())}
    for before, chances in kept.items():  # pairs and what is left to single words add up to one
        after = (model.pairs % size)[model.pairs // size == before]
        free = np.ones(size, bool)
        free[after] = False
        rest = (2.0 ** model.rest_logs[before]) * (2.0**model.word_logs)[free].sum(axis=0)
        assert np.allclose(chances.sum(axis=0) + rest, 1)
    nothing = cross_entropy.fit(df.limit(0), np.empty(0, np.int64))
    assert cross_entropy.score(df.limit(0), nothing).count() == 0


def test_cross_entropy_counts_are_those_of_the_words(spark):
    texts = ["a b a", "B c", None, "a"]
    shared = spark.sparkContext.broadcast(np.array([0, 2]))
    counted = cross_entropy._counted(docs_of(spark, texts), shared, lambda w, row: (w.view(np.int64), row)).collect()
    assert sorted((r.target, r.total) for r in counted) == [(0, 1), (1, 2), (2, 3)]


def test_cross_entropy_keeps_rare_words_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(cross_entropy, "CHUNK", 1)
    texts = ["rare pair here", "Rare pair here again", "noise of words", None, "", *["noise of other words"] * 30]
    df, targets = docs_of(spark, texts), [0, 1]
    model = cross_entropy.fit(df, np.array(targets))
    split = [all_words(lower(t)) for t in texts]
    single, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for i, found in enumerate(split):
        for k in (0, 1) if i in targets else (1,):
            single[k].update(found)
            pairs[k].update(zip([None, *found], found, strict=False))
    size = len(single[1]) + 1

    def loss(k, a, b):
        context = sum(n for (x, _), n in pairs[k].items() if x == a)
        kinds = sum(x == a for x, _ in pairs[k])
        chance = (single[k][b] + 0.5) / (sum(single[k].values()) + 0.5 * size)
        rest = (0.75 * kinds + 0.5) / (context + 0.5) if context else 1.0
        return -math.log2(max(pairs[k][a, b] - 0.75, 0) / (context + 0.5) + rest * chance)

    rows = {r.doc_id: r for r in cross_entropy.score(df, model).collect()}
    for i, found in enumerate(split):
        both = [sum(loss(k, a, b) for a, b in zip([None, *found], found, strict=False)) / max(1, len(found)) for k in (0, 1)]
        assert (rows[i].target_loss, rows[i].background_loss) == pytest.approx(tuple(both))
    fresh = cross_entropy.score(docs_of(spark, ["unseen rare words"]), model).collect()[0]
    assert fresh.background_loss == pytest.approx((loss(1, None, "unseen") + loss(1, "unseen", "rare") + loss(1, "rare", "words")) / 3)
    assert model.counts.filter("before <> 0").count() == len(pairs[1])


@pytest.mark.parametrize("chunk, bucket", [(1, 1 << 30), (2000, 300), (1 << 20, 1)])
def test_cross_entropy_difference_is_fit_and_score(spark, chunk, bucket):
    texts = [" ".join(f"w{(i * j * j + j) % (7 + i)}" if j % 3 else "the" for j in range(i)) for i in range(60)]
    texts += [None, "", " \n ", "the", "the the the the", *["one hot text of copies"] * 50, "w " * 5000]
    df = docs_of(spark, texts, extra=True).repartition(3)
    df = df.unionByName(df.filter("doc_id IN (5, 70)")).unionByName(df.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("bigint")))
    targets = spark.createDataFrame([(i,) for i in range(0, 110, 3)] + [(None,)], "doc_id bigint")
    want = cross_entropy.score(df, cross_entropy.fit(df, targets))
    got = cross_entropy.difference(df, targets, chunk=chunk, bucket=bucket)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: (str(r.doc_id), r.n_words, r.score)
    got, want = sorted(got.select(*want.columns).collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want) == df.count()
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.text, g.n_words) == (w.doc_id, w.text, w.n_words)
        assert (g.target_loss, g.background_loss, g.score) == pytest.approx((w.target_loss, w.background_loss, w.score), abs=1e-9)
    slim = cross_entropy.difference(df.limit(0), targets, columns=["doc_id"])
    assert slim.columns == ["doc_id", "n_words", "target_loss", "background_loss", "score"] and slim.count() == 0


def test_cross_entropy_has_no_bounded_table(spark):
    n = 1200
    df = docs_of(spark, [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(n)])  # 600,000 words, each once
    model = cross_entropy.fit(df, np.arange(1))
    assert model.size - 1 == n * 500 > 2**19


def test_cross_entropy_takes_all_target_ids(spark):
    labels = spark.range(250_000).selectExpr("id AS doc_id", "1 AS quality").union(spark.range(5).selectExpr("id", "0"))
    ids = cross_entropy.target_ids(labels.union(labels))
    assert ids.count() == 250_000
    docs = spark.createDataFrame([(249_999, "a b"), (7, "a"), (250_000, "a"), (None, "a"), (7, "a")], "doc_id bigint, text string")
    assert cross_entropy.fit(docs, ids).total.tolist() == [4, 6]


# --- 4

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="ad">Buy</div>%s<form><input name=q>Search</form><div class="sidebar">Side</div>
<div class="comments"><p>Nice post!</p></div><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', "<article>%s"])
def test_main_text(wrap):
    body = "<h1>Head &amp; all</h1><p>One <b>two</b>\n  three<p>Fo&uuml;r <a href=x>link</a> five, a longer line of text.</p><!-- <p>no</p> --><p>End.</p>"
    assert line_blocks.main_text(PAGE % (wrap % body)) == "Head & all\nOne two three\nFoür link five, a longer line of text.\nEnd."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>'])
def test_main_text_keeps_link_lines(wrap):
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(5))
    long = "A long text of many words. " * 40
    body = f'<h1><a href="/">Title</a></h1><p>{long}</p><ul>{links}</ul><p>Short.</p><p><a href="/more">Read more</a></p>'
    expected = ["Title", long.strip(), *(f"Link {i}" for i in range(5)), "Short.", "Read more"]
    assert line_blocks.main_text(PAGE % (wrap % body)).split("\n") == expected


def test_main_text_of_links_only():
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(5))
    assert line_blocks.main_text(PAGE % f"<article><ul>{links}</ul></article>") == "\n".join(f"Link {i}" for i in range(5))
    menu = "".join(f'<div><a href="/{i}">Menu {i}</a></div>' for i in range(9))
    assert line_blocks.main_text(PAGE % menu) == ""


def test_main_text_of_odd_pages(spark):
    rows = [(0, "u", None), (1, None, ""), (2, "u", "plain text"), (3, "u", "<p>" + "x " * 200_000 + "</p>"), (4, "u", "<div><"), (2, "u", "plain text")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("n_chars", F.lit("old"))
    found = sorted((r.page_id, r.n_chars) for r in line_blocks.extract(df).collect())
    assert found == [(0, 0), (1, 0), (2, 10), (2, 10), (3, 399_999), (4, 1)]
    assert line_blocks.extract(df.limit(0)).count() == 0


# --- 5


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = all_words(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def near_texts(seed=3):
    rng = np.random.default_rng(seed)
    pool = [f"w{k}" for k in range(400)]
    texts = [*ODD[:5], "a", "A"]
    for group in range(6):
        base = rng.choice(pool, 80).tolist()
        for _ in range(12):
            copy = list(base)
            for at in rng.choice(80, rng.integers(0, 8), replace=False):
                copy[at] = f"n{rng.integers(1000)}"
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(pool, 40).tolist())
    texts += [passage + " " + " ".join(rng.choice(pool, 60).tolist()) for _ in range(30)]
    return texts


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minmax_dedup, "BLOCK", block)
    texts = near_texts()
    found = minmax_dedup.near_duplicates(docs_of(spark, texts, extra=True), 2, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(texts, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_links_within_joins_components_only():
    sets = [np.arange(0, 10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    parts = np.array([b"a", b"b", b"c"], object)
    assert len(minmax_dedup._links_within(sets, parts, np.zeros(3), False, 80)) == 1


def test_dropping_keeps_one_of_each_group(spark):
    texts = near_texts()
    df = docs_of(spark, texts, extra=True)
    df = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("bigint")).filter("doc_id IS NULL AND text = 'a'").limit(1))
    kept = minmax_dedup.drop_near_duplicates(df, 2, 80)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(texts, 2, 80)})
    lone = spark.createDataFrame([(None, "p q r"), (None, "p q r"), (None, "s t u")], "doc_id bigint, text string")
    assert minmax_dedup.drop_near_duplicates(lone, 2, 80).count() == 2
    assert minmax_dedup.drop_near_duplicates(df.limit(0), 2, 80).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    close = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = minmax_dedup.signature(pool[:270]), minmax_dedup.signature(pool[30:])
        close.append((a == b).mean())
    assert abs(np.mean(close) - 0.8) < 0.01


# --- 6


def brute_tiles(item, text, least):
    """Greedy string tiling as first stated: the longest free common stretch, again and again."""
    free_i, free_t, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and free_i[p + n] and free_t[t + n] and item[p + n] == text[t + n]:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < least:
            return total
        total += n
        free_i[p : p + n] = [False] * n
        free_t[t : t + n] = [False] * n


def test_tiling_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(150):
        item = rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64)
        text = rng.integers(0, 6, rng.integers(0, 60)).astype(np.uint64)
        if len(item) > 12:
            at = rng.integers(0, len(text) + 1)
            text = np.concatenate([text[:at], item[6:], item[:6], text[at:]])
        tiles = string_tiling.tile(item, text, 3, 8)
        assert sum(n for n, _, _ in tiles) == brute_tiles(item.tolist(), text.tolist(), 3)
        marked = [p + k for n, p, _ in tiles for k in range(n)]
        assert len(marked) == len(set(marked))


def test_leaks(spark):
    passage = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu."
    w = passage.split()
    texts = [
        passage, "x y z " * 2000 + passage.upper() + " q" * 30, " ".join(w[6:] + ["and"] + w[:6]), " ".join(w[:5]), None, "", passage,
        "alpha gamma beta delta " * 9,
    ]
    items = spark.createDataFrame([(0, passage), (1, None), (2, "too short"), (3, "other words here that nobody has used at all")], "item_id int, text string")
    df = docs_of(spark, texts, extra=True)
    found = string_tiling.contaminated(df, items).collect()
    assert sorted((r.doc_id, r.item_id, r.tiles, r.coverage) for r in found) == [(0, 0, 1, 1.0), (1, 0, 1, 1.0), (2, 0, 2, 1.0), (6, 0, 1, 1.0)]
    left = string_tiling.drop_contaminated(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7]
    assert string_tiling.contaminated(df.limit(0), items).count() == 0
    assert string_tiling.drop_contaminated(df, items.limit(0)).count() == len(texts)


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(0, "Two plus two"), (1, "yes"), (2, "one two three four"), (3, "")], "item_id int, text string")
    texts = ["two, plus TWO!", "two plus two is four", "yes", "Yes.", "no", "two three four", "one two three four", "plus two two", "", None]
    found = string_tiling.contaminated(docs_of(spark, texts), items).collect()
    assert sorted((r.doc_id, r.item_id, r.tiles, r.coverage) for r in found) == [(0, 0, 1, 1.0), (2, 1, 1, 1.0), (3, 1, 1, 1.0), (6, 2, 1, 1.0)]


# --- 7


def test_toxicity_on_held_out_rows(spark):
    found = queries.op7_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = [r for r in found.collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.7 * sum(r.toxic for r in rows) and hit >= 0.6 * sum(r.predicted for r in rows)


def test_shared_backoff_adds_up():
    counts = Counter(g for w in ("cat", "cart", "dog", "cat") for g in toxicity.grams_of(w))
    shared = toxicity._Shared(dict(counts))
    letters = {g[-1] for g in counts}
    for before in ("", "c", toxicity.START, toxicity.START + "ca"):
        total = sum(shared.chance(before + x) for x in letters)
        assert total <= 1 + 1e-9 and total > 0.9


def test_word_ratios_follow_grams():
    counts = {}
    for w, pair in (("cat", (5, 1)), ("scum", (0, 7)), ("the", (9, 8))):
        for g in toxicity.grams_of(w):
            a, b = counts.get(g, (0, 0))
            counts[g] = (a + pair[0], b + pair[1])
    model = toxicity.ratios(counts)
    of = dict(zip(model.keys.tolist(), model.values.tolist(), strict=True))
    others = dict(zip(model.other_keys.tolist(), model.others.tolist(), strict=True))
    asked = ["cat", "scum", "scuba", "zebra", "a"]
    for word, value in zip(asked, toxicity.word_ratios(asked, model), strict=True):
        expected = 0.0
        for g in toxicity.grams_of(word):
            key, before = int(toxicity.gram_hash([g])[0]), int(toxicity.gram_hash([g[:-1]])[0])
            expected += of.get(key, others.get(before, 0.0))
        assert math.isclose(value, expected, abs_tol=1e-5)
    assert toxicity.word_ratios(["scum"], model)[0] > 1 > toxicity.word_ratios(["cat"], model)[0]


def test_toxicity_of_odd_inputs(spark):
    df = docs_of(spark, ODD, extra=True)
    labels = spark.createDataFrame([(0, 1), (3, None), (None, 1), (99, 0), (4, 0), (4, 1)], "doc_id bigint, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.score(df, toxicity.fit(df, known), 0.3).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), labels), 0.3).count() == 0


# --- 8


def test_water_fill(spark):
    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), ("c", 1000, 1.0), (None, 0, 5.0)], "source string, size bigint, weight double")
    got = {r.source: r.target for r in mixing.water_fill(sources, 900, 2).collect()}
    assert got == {"a": 20.0, None: 0.0, "b": pytest.approx(880 * 2 / 3), "c": pytest.approx(880 / 3)}
    full = {r.source: r.target for r in mixing.water_fill(sources, 1e9, 2).collect()}
    assert full == {"a": 20.0, "b": 2000.0, "c": 2000.0, None: 0.0}
    assert mixing.water_fill(sources.limit(0), 10, 2).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["a", "b", "c", None][int(k)], "w " * int(n)) for i, (k, n) in enumerate(zip(rng.choice(4, 400, p=[0.6, 0.2, 0.1, 0.1]), rng.integers(0, 60, 400), strict=True))]
    rows += [(None, "a", None), (5, "b", rows[5][2]), (5, "b", rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("size", F.lit("old"))
    mixed = mixing.take(df, mixing.cycled_weights(df, (5.0, 2.0, 1.0)), 1.5, 2, 7).collect()
    assert len(mixed) == len(rows) and all(r.taken <= 2 * r.size for r in mixed)
    for source in ("a", "b", "c", None):
        own = [r for r in mixed if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
    again = mixing.take(df, mixing.cycled_weights(df, (5.0, 2.0, 1.0)), 1.5, 2, 7).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in mixed)
    assert mixing.take(df.limit(0), mixing.cycled_weights(df.limit(0), (1.0,)), 1.5, 2, 7).count() == 0


@pytest.mark.parametrize("copies", [3, mixing.COPIES])
def test_equal_rows_are_parted_at_the_cut(spark, monkeypatch, copies):
    monkeypatch.setattr(mixing, "COPIES", copies)
    rows = [(1, "a", "w " * 10, {"k": "v"})] * 400 + [(i, "b", "w " * 5, None) for i in range(300)] + [(2, None, "x y z", None)] * 7
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tags map<string, string>")
    df = df.withColumn("seen", F.when(F.col("source").isNull(), F.monotonically_increasing_id()).otherwise(0))
    rows_of = mixing.take(df, mixing.cycled_weights(df, (5.0, 2.0, 1.0)), 0.5, 2, 7)
    assert [c for c in rows_of.columns if c in df.columns] == df.columns
    mixed = rows_of.collect()
    assert len(mixed) == len(rows) and sum(r.tags == {"k": "v"} for r in mixed) == 400
    for source, size in (("a", 10), ("b", 5), (None, 3)):
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= size / 2
        assert all(r.size == size and r.taken <= 2 * size for r in own)
    again = mixing.take(df, mixing.cycled_weights(df, (5.0, 2.0, 1.0)), 0.5, 2, 7).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in mixed)


# --- 9


def test_token_counts_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, "it's we'll 'S", "a<|endoftext|> b<|endoftext|>", "\x1c\x85\xa0 　x", "１２３ ² ½ Ⅷ", "\r\n\r\n  end  "]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    df = docs_of(spark, texts, extra=True).withColumn("n_tokens", F.lit("old"))
    for r in token_counts.count_tokens(df, path, 10).collect():
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 10)
    assert token_counts.count_tokens(df.limit(0), path, 10).count() == 0


def test_whole_tokens_are_proven():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library, proof = Tokenizer.from_file(path), token_counts.prove(path)
    assert len(proof.whole) > 40_000
    pieces = [w for w in sorted(proof.whole)[::97] if w not in proof.special and len(token_counts.regex.findall(token_counts.PRE_TOKENS, w)) == 1]
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in pieces)


# --- 10


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]<s><\\<s>", "<<SYS>>\\", "a\n[/INST]b</s>", "<|im_\\end|><|im_end|>"])
def test_escaping_is_reversible(text):
    inside = chat.escape(text)
    assert chat.unescape(inside) == text and not any(c in inside for c in chat.CONTROLS)
    assert chat.read_back(chat.BEGIN + chat.HEAD + chat.escape(text) + chat.TAIL + inside + chat.END) == (text, text)


def test_layouts_become_turns(spark):
    records = [
        (1, '{"messages": [{"role": "system", "content": "s"}, {"content": null, "role": "user"}]}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (3, '{"output": "o", "instruction": "i", "input": "more"}'),
        (4, '{"instruction": "i", "input": "", "output": "o"}'),
        (5, '{"dialog": {"turns": [{"speaker": "bot", "text": "t"}]}}'),
        (6, '{"prompt": "p", "response": "r"}'),
        (7, '{"unknown": 1}'), (8, None), (9, "no json"), (6, '{"prompt": "p", "response": "r"}'),
    ]
    df = spark.createDataFrame(records, "id int, record string").withColumn("role", F.lit("old"))
    turns = sorted((r.id, r.part, r.layout, r.role, r.text) for r in chat.canonical_turns(df, "record").collect())
    assert turns == sorted([
        (1, 0, "messages", "system", "s"), (1, 1, "messages", "user", ""),
        (2, 0, "conversations", "user", "q"), (2, 1, "conversations", "assistant", "a"),
        (3, 0, "instruction_input", "user", "i\n\nmore"), (3, 1, "instruction_input", "assistant", "o"),
        (4, 0, "instruction_input", "user", "i"), (4, 1, "instruction_input", "assistant", "o"),
        (5, 0, "turns", "assistant", "t"),
        *[(6, 0, "prompt_response", "user", "p"), (6, 1, "prompt_response", "assistant", "r")] * 2,
    ])
    odd = {r.paths: r.records for r in chat.unmapped(df, "record").collect()}
    assert odd == {"unknown": 1, "(no JSON)": 2}
    assert chat.canonical_turns(df.limit(0), "record").count() == 0


def test_chat_digests(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    expected = {}
    for conv in {r[0] for r in rows}:
        own = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        said = "".join(t for role, t in own if role == "assistant")
        every = "".join(f"{role}\n{t}\n" for role, t in own)
        expected[conv] = (len(own), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    found = queries.op10_chat_formatting(spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == expected


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), stage(spark, kept, SF).schema)
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before and after
        if name != "mixing":
            assert kept.columns == docs.columns and kept.count() == len(after)
        if name == "quality rules":
            assert all(brute_quality(texts[i])[0] >= 20 for i in after)
        if name == "near duplicates":
            ids = sorted(before)
            roots = brute_components([texts[i] for i in ids], 5, 80)
            assert after == {ids[c] for _, _, c in roots}
    sizes = {i: len(all_words(t)) for i, t in texts.items()}
    taken = Counter(r.doc_id for r in kept.collect())
    assert max(taken.values()) <= 2 and sum(sizes[i] * n for i, n in taken.items()) > 0
    assert corpus_pipeline.run(spark, SF).columns == [*docs.columns, "epoch"]


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, None, None, None, None)] * 2 + [(1, "", None, None, None)], schema)
    for _, stage in corpus_pipeline.STAGES:
        for rows in (odd, odd.limit(0), odd.withColumns({"score": F.lit(1), "size": F.lit("x"), "row": F.lit(2)})):
            assert stage(spark, rows, SF).count() >= 0


def test_pipeline_drops_all_that_is_called_toxic(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = queries.op7_toxicity(spark, sf).filter("predicted = 1").select("doc_id")
    kept = corpus_pipeline.remove_toxic(spark, docs, sf)
    assert kept.count() > 0 and kept.join(toxic, "doc_id", "left_semi").isEmpty()
