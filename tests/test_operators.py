"""Operators against plain Python on small fixtures, busy keys included."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomframe.functions import casts, geo, where
from loomframe.functions import text as X
from loomframe.operators import aggregates as A
from loomframe.operators import claims as C
from loomframe.operators import drift as D
from loomframe.operators import entities as N
from loomframe.operators import events as E
from loomframe.operators import graph as G
from loomframe.operators import joins as J
from loomframe.operators import profiling as P
from loomframe.operators import skew as K
from loomframe.operators import transforms as T
from loomframe.operators import udf as U
from loomframe.operators import windows as W
from loomframe.operators import writeback as WB
from loomframe.operators.asof import asof_join
from loomframe.operators.search import apply_policy
from loomframe.sources import incremental as I
from loomframe.streaming.streams import classify_events


def busy_rows(n=3000, seed=1):
    """(key, t, id) where one key holds a third of the rows and times repeat."""
    rng = random.Random(seed)
    return [(0 if i % 3 == 0 else rng.randrange(40), rng.randrange(500), i) for i in range(n)]


def test_row_numbers_of_busy_keys(spark):
    rows = busy_rows()
    df = spark.createDataFrame(rows, "k int, t int, id int")
    for order, key in ((["t", "id"], lambda r: (r[1], r[2])), (["-t", "id"], lambda r: (-r[1], r[2]))):
        got = {r.id: r.rn for r in K.row_numbers(df, ["k"], order, "rn", task_rows=200).collect()}
        groups = defaultdict(list)
        for r in rows:
            groups[r[0]].append(r)
        expected = {r[2]: i for g in groups.values() for i, r in enumerate(sorted(g, key=key), 1)}
        assert got == expected


def test_row_numbers_where_one_value_fills_most_slices(spark):
    rng = random.Random(4)
    rows = [(0, None if i % 5 == 0 else "same" if i % 2 else f"v{rng.randrange(9)}", i * 31 % 2003) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v string, id int")
    low = lambda v: (v is not None, v or "")
    for order, first, second in ((["v", "id"], 1, 1), (["-v", "id"], -1, 1), (["v", "-id"], 1, -1), (["-v", "-id"], -1, -1)):
        ranked = sorted(rows, key=lambda r: second * r[2])
        ranked.sort(key=lambda r: low(r[1]), reverse=first < 0)
        got = {r.id: r.rn for r in K.row_numbers(df, ["k"], order, "rn", task_rows=125).collect()}
        assert got == {r[2]: i for i, r in enumerate(ranked, 1)}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert K.ranges(df, ["k"], ["v", "id"]).groupBy("_slice").count().agg(F.max("count")).first()[0] < 2 * 2000 / parts


def test_row_numbers_of_text_with_a_common_beginning(spark):
    rows = [(0, f"Customer#{i * 7919 % 4000:012d}") for i in range(4000)] + [(k, f"Customer#{i:012d}") for k in range(1, 9) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, v string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = K.ranges(df.filter("k = 0"), ["k"], ["v"]).groupBy("_slice").count().agg(F.count("*"), F.max("count")).first()
    assert cut[0] >= parts // 2 and cut[1] < 2 * 4000 / parts
    got = {(r.k, r.v): r.rn for r in K.row_numbers(df, ["k"], ["v"], "rn", task_rows=100).collect()}
    assert got == {(k, f"Customer#{i:012d}"): i + 1 for k in range(9) for i in range(4000 if k == 0 else 101)}


def test_ranges_follow_the_rows_of_busy_groups(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 0 ELSE id END AS k", "id % 977 AS v", "id")
    busy = K.busy_groups(df, ["k"], 100)
    assert [(r._n,) for r in busy.collect()] == [(4000,)] and K.busy_groups(df, ["k"], 4000) is None
    n = K.slices_for(busy, 100)
    assert n == 80 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in K.ranges(df.filter("k = 0"), ["k"], ["v", "id"], n).groupBy("_slice").count().collect()]
    assert len(sizes) > 60 and max(sizes) <= 100
    got = {r.id: r.n for r in K.row_numbers(df, ["k"], ["v", "id"], "n", task_rows=100).filter("k = 0").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(4000), key=lambda i: (i % 977, i)), 1)}


def test_sums_of_doubles_on_both_sides_of_the_switch(spark):
    df = spark.createDataFrame([(i % 2, i, i * 0.25) for i in range(1000)], "k int, t int, v double")
    one, two = (
        {r.t: r.x for r in K.running_before(df, ["k"], ["t"], F.col("v"), "sum", "x", task_rows=n).collect()} for n in (100, 10_000)
    )
    assert one == two


def test_neighbours_reach_beyond_a_run(spark):
    df = spark.createDataFrame([(0, i) for i in range(35)], "k int, id int")
    got = {r.id: (r.p, r.n) for r in W.neighbours(df, ["k"], ["id"], {"p": "lag(id, 15)", "n": "lead(id, 12)"}, 15, 12, chunk=10).collect()}
    assert got == {i: (i - 15 if i > 14 else None, i + 12 if i < 23 else None) for i in range(35)}


def test_row_functions_see_missing_values_and_whole_integers(spark):
    df = spark.createDataFrame([(1, 2**60 + 1), (2, None)], "id int, n bigint")
    got = U.map_rows(df, lambda r: {"id": r["id"], "n": r["n"], "none": r["n"] is None}, "id int, n bigint, none boolean").collect()
    assert sorted((r.id, r.n, r.none) for r in got) == [(1, 2**60 + 1, False), (2, None, True)]


def test_event_that_comes_twice_at_one_time(spark):
    df = spark.createDataFrame([("e", "a", 1, 5), ("e", "a", 1, 5), ("f", "a", 2, 6)], "event string, agg string, seq int, at int")
    got = classify_events(df, "event", "agg", "seq", "at").collect()
    assert sorted((r.event, r.status) for r in got) == [("e", "duplicate"), ("e", "processed"), ("f", "processed")]


def test_full_join_is_left_join_and_the_rest(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z"), (3, "y")], "k int, v string")
    got = sorted(map(str, J.join(left, right, ["k"], how="full").collect()))
    assert got == sorted(map(str, left.join(right.withColumnRenamed("v", "right_v"), "k", "full").collect()))
    named = right.withColumnsRenamed({"k": "j", "v": "w"})
    got = sorted(map(str, J.join(left, named, ["k"], ["j"], how="full").collect()))
    assert got == sorted(map(str, left.join(named, left.k == named.j, "full").collect()))


def test_links_after_patches(spark):
    ops = "array<struct<field:string,value:string>>"
    base = spark.createDataFrame([(1, "f", "x"), (1, "f", "y"), (2, "f", "x"), (3, "g", "z")], "id int, field string, target string")
    rows = [(1, 1, ([("f", "n")], [("f", "x")], False)), (1, 2, ([("f", "x")], [("f", "n")], False)), (2, 3, ([("f", "q")], [], True))]
    patches = spark.createDataFrame(rows, f"id int, seq int, patch struct<link_add:{ops},link_remove:{ops},delete:boolean>")
    got = {tuple(r) for r in WB.merge_links(base, patches, "id", "seq", "patch").collect()}
    assert got == {(1, "f", "x"), (1, "f", "y"), (3, "g", "z")}
    later = {tuple(r) for r in WB.merge_links(base, patches, "id", "seq", "patch", above=2).collect()}
    assert later == {(1, "f", "x"), (1, "f", "y"), (3, "g", "z")}


def test_masks_keep_the_type(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    masked = apply_policy(df, mask=["id", "name"], mask_value=0)
    assert masked.dtypes == df.dtypes and tuple(masked.first()) == (0, "0")


def test_row_numbers_with_missing_keys_and_times(spark):
    rows = [(None, 1, 1), (None, None, 2), (5, None, 3), (5, 7, 4)]
    df = spark.createDataFrame(rows, "k int, t int, id int")
    assert {r.id: r.rn for r in K.row_numbers(df, ["k"], ["t", "id"], "rn", task_rows=1).collect()} == {2: 1, 1: 2, 3: 1, 4: 2}


def test_neighbours_cross_runs(spark):
    rows = busy_rows(600)
    df = spark.createDataFrame(rows, "k int, t int, id int")
    calls = {"p": "lag(id, 2)", "n": "lead(id)", "s": "sum(id) | ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"}
    got = {r.id: (r.p, r.n, r.s) for r in W.neighbours(df, ["k"], ["t", "id"], calls, 2, 1, chunk=7).collect()}
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[r[0]].append(r[2])
    for ids in groups.values():
        for i, one in enumerate(ids):
            expected = (ids[i - 2] if i > 1 else None, ids[i + 1] if i + 1 < len(ids) else None, sum(ids[max(0, i - 2) : i + 2]))
            assert got[one] == expected
    assert len(got) == len(rows)


@pytest.mark.parametrize("how", ["max", "sum", "last"])
def test_running_values_cross_slices(spark, how):
    rows = [(k, i, (i * 7919) % 101 if i % 4 else None) for i, (k, _, _) in enumerate(busy_rows())]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    got = {r.t: r.x for r in K.running_before(df, ["k"], ["t"], F.col("v"), how, "x", task_rows=100).collect()}
    seen = defaultdict(list)
    for k, t, v in rows:
        past = [p for p in seen[k] if p is not None]
        assert got[t] == ((max(past) if how == "max" else sum(past) if how == "sum" else past[-1]) if past else None)
        seen[k].append(v)


def test_chunked_lists_split_large_keys(spark):
    rows = [(1, i) for i in range(1000)] + [(2, 5), (2, 5), (3, None)]
    lists = K.chunked_lists(spark.createDataFrame(rows, "k int, v int"), ["k"], "v", "vs", 100).collect()
    assert sorted(v for r in lists if r.k == 1 for v in r.vs) == list(range(1000))
    assert max(len(r.vs) for r in lists) < 300
    assert [(r.chunk, r.vs) for r in lists if r.k == 2] == [(0, [5])]


def test_link_rows_have_no_size_switch(spark):
    links = spark.createDataFrame([(1, i) for i in range(20_001)] + [(2, 5), (2, 5), (3, None), (9, 1)], "src int, dst int")
    sources = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string")
    rows = J.link_rows(sources, links, "id", "src", "dst", "knows", "Person")
    assert rows.columns == ["id", "link", "target_type", "target"]
    assert sorted((r.id, r.target) for r in rows.collect()) == [(1, i) for i in range(20_001)] + [(2, 5)]
    refs = N.reverse_link_rows(sources, "id", links, "dst", "src", "Person")
    assert refs.count() == 20_002 and refs.filter("id = 2").first().ref == "Person/5"
    assert J.link_rows(sources.limit(0), links, "id", "src", "dst", "knows", "Person").count() == 0


def test_run_changelog_keeps_the_watermark(spark):
    delta = spark.createDataFrame([("added", 5), ("deleted", 3), ("other", None)], "change_type string, at int")

    def run(rows, before):
        return tuple(I.run_changelog(rows, watermark="at", before=before).first())

    assert run(delta, None) == (1, 0, 1, 2, None, 5)
    assert run(delta, 9) == (1, 0, 1, 2, 9, 9)
    assert run(delta.limit(0), 4) == (0, 0, 0, 0, 4, 4)
    assert run(delta.limit(0), None) == (0, 0, 0, 0, None, None)


def asof_by_hand(left, right, reach, direction):
    """(left id → right id) by looking at every pair."""
    out = {}
    for k, lt, lid in left:
        options = []
        for rk, rt, rid in right:
            if rk != k:
                continue
            if lt is None or rt is None:
                late = rt is None
                by_time = {"backward": (late, -(rt or 0)), "forward": (late, rt or 0), "symmetric": ()}[direction]
                options.append((1, 0, by_time, rid))
                continue
            gap = {"backward": lt - rt, "forward": rt - lt, "symmetric": abs(lt - rt)}[direction]
            if 0 <= gap <= reach:
                options.append((0, gap, (), rid))
        if options:
            out[lid] = min(options)[3]
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "symmetric"])
def test_asof_matches_all_pairs(spark, direction):
    rng = random.Random(7)

    def side(n, start):
        return [(0 if i % 3 == 0 else rng.randrange(6), None if rng.random() < 0.05 else rng.randrange(400), start + i) for i in range(n)]

    left, right = side(300, 0), side(200, 1000)
    frames = [
        spark.createDataFrame(rows, f"k int, t int, {i} int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
        for rows, i in ((left, "lid"), (right, "rid"))
    ]
    joined = asof_join(
        *frames, ["k"], "ts", "ts", "lid", "rid", lateness=9, left_cache=50, right_cache=20, direction=direction, task_rows=40
    ).collect()
    expected = asof_by_hand(left, right, 9, direction)
    assert {r.lid: r.rid for r in joined if r.lid is not None and r.rid is not None} == expected
    assert {r.lid for r in joined if r.rid is None} == {r[2] for r in left} - set(expected)
    assert {r.rid for r in joined if r.lid is None} == {r[2] for r in right} - set(expected.values())


def test_join_names_and_errors(spark):
    left = spark.createDataFrame([(1, "a")], "id int, v string")
    right = spark.createDataFrame([(1, "b", "c")], "id int, v string, right_v string")
    assert J.join(left, right, ["id"]).columns == ["id", "v", "right_v__1", "right_v"]
    assert J.join(left, right.withColumnRenamed("id", "rid"), ["id"], ["rid"]).columns[-1] == "right_v"
    with pytest.raises(ValueError):
        J.join(left, right, ["id"], ["id", "v"])


def test_parameters_are_quoted(spark):
    df = spark.createDataFrame([("O'Neil",), ("x",)], "name string")
    assert T.where(df, "name = $who", {"who": "O'Neil"}).count() == 1
    assert T.where(df, "name = {{ who }}", {"who": "x' OR '1'='1"}).count() == 0


def test_split_has_a_third_branch(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    assert [b.count() for b in T.split_branches(df, "v > 0")] == [1, 1, 1]


@pytest.mark.parametrize(
    "raw,value",
    [
        ("(1,234.5)", -1234.5),
        ("$1,234.50", 1234.5),
        ("1.234,56", 1234.56),
        ("1,5", 1.5),
        ("EUR 12", 12.0),
        ("45 %", 45.0),
        ("1.234.567", 1234567.0),
        ("- 7", -7.0),
        ("1 234", 1234.0),
        ("12a", None),
        ("", None),
        (None, None),
    ],
)
def test_locale_numbers(spark, raw, value):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(casts.parse_decimal(F.col("s"))).first()[0] == value


@pytest.mark.parametrize(
    "raw,value,unclear",
    [
        ("2024-02-29", "2024-02-29 00:00:00", False),
        ("2023-02-29", None, False),
        ("2024/3/5 7:08", "2024-03-05 07:08:00", False),
        ("2024-03-05T07:08:09.5+02:00", "2024-03-05 05:08:09", False),
        ("20240305", "2024-03-05 00:00:00", False),
        ("03/04/2024", "2024-03-04 00:00:00", True),
        ("13/04/2024", "2024-04-13 00:00:00", False),
        ("04-13-2024", "2024-04-13 00:00:00", False),
        ("2024-03-05 07:08:09 UTC", "2024-03-05 07:08:09", False),
        ("soon", None, False),
    ],
)
def test_dates(spark, raw, value, unclear):
    df = spark.createDataFrame([(raw,)], "s string").select(casts.parse_datetime(F.col("s")).alias("r"))
    row = df.select(F.date_format("r.value", "yyyy-MM-dd HH:mm:ss"), "r.is_ambiguous").first()
    assert tuple(row) == (value, unclear)


def test_ambiguous_dates_can_be_refused(spark):
    df = spark.createDataFrame([("03/04/2024",)], "s string")
    assert df.select(casts.parse_datetime(F.col("s"), False)["value"]).first()[0] is None


def test_masking(spark):
    digest = hashlib.sha256(b"01012345678").hexdigest()[:10]
    mail = hashlib.sha256(b"a.b@ex.com").hexdigest()[:10]
    cases = {
        "call 010-1234-5678 now": f"call <number:{digest}> now",
        "to a.b@ex.com.": f"to <email:{mail}>.",
        "at 2018-01-01T12:34:56 or 31.01.2018": "at 2018-01-01T12:34:56 or 31.01.2018",
        "id 550e8400-e29b-41d4-a716-446655440000": "id 550e8400-e29b-41d4-a716-446655440000",
        "12345678.99": "12345678.99",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", X.mask_personal_data(F.col("s"))).collect()} == cases
    assert df.select(X.mask_personal_data(F.lit("abcdef"), 4)).first()[0] == "abc…"


def geohash_by_bisection(lat, lon, size):
    ranges, letters, bits = {"x": [-180.0, 180.0], "y": [-90.0, 90.0]}, "", []
    while len(bits) < size * 5:
        axis, v = ("x", lon) if len(bits) % 2 == 0 else ("y", lat)
        middle = sum(ranges[axis]) / 2
        bits.append(v >= middle)
        ranges[axis][0 if bits[-1] else 1] = middle
    for i in range(0, len(bits), 5):
        letters += geo.GEOHASH_ALPHABET[int("".join("01"[b] for b in bits[i : i + 5]), 2)]
    return letters


def test_geohash(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    points += [(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (45.0, -90.0), (57.64911, 10.40744)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for size in (1, 7, 12):
        for r in df.select("lat", "lon", geo.geohash(F.col("lat"), F.col("lon"), size).alias("g")).collect():
            assert r.g == geohash_by_bisection(r.lat, r.lon, size)
    outside = spark.createDataFrame([(91.0, 0.0), (None, 0.0), (float("nan"), 0.0)], "lat double, lon double")
    assert all(r[0] is None for r in outside.select(geo.geohash(F.col("lat"), F.col("lon"))).collect())


def test_ring_against_polygon(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rings = {
        "inside": [(1, 1), (2, 1), (2, 2), (1, 1)],
        "around": [(-1, -1), (9, -1), (9, 9), (-1, 9), (-1, -1)],
        "across": [(-1, 2), (5, 2), (5, 3), (-1, 2)],
        "apart": [(6, 6), (7, 6), (7, 7), (6, 6)],
        "near corner": [(5, 3), (5, 5), (3, 5), (5, 3)],
    }
    rows = [(n, [(float(x), float(y)) for x, y in ring]) for n, ring in rings.items()]
    df = spark.createDataFrame(rows, "n string, ring array<struct<lon:double,lat:double>>")
    hit = {r[0]: r[1] for r in df.select("n", where.intersects_polygon(F.col("ring"), square)).collect()}
    assert hit == {"inside": True, "around": True, "across": True, "apart": False, "near corner": True}


def windows_by_hand(words, terms, max_gaps, ordered):
    places = [[i for i, w in enumerate(words) if w == t] for t in terms]

    def search(chosen, rest):
        if not rest:
            return max(chosen) - min(chosen) + 1 - len(terms) <= max_gaps or max_gaps < 0
        return any(search([*chosen, p], rest[1:]) for p in rest[0] if not ordered or not chosen or p > chosen[-1])

    return search([], places)


def test_word_intervals(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcde") for _ in range(9)) for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for terms in ("a b", "a b c"):
        for gaps in (-1, 0, 2):
            for ordered in (True, False):
                found = where.interval(where.match(F.col("t"), terms, gaps, ordered))
                parts = where.all_of([where.word(F.col("t"), w) for w in terms.split()], gaps, ordered)
                for r in df.select("t", found.alias("a"), where.interval(parts).alias("b")).collect():
                    expected = windows_by_hand(r.t.split(), terms.split(), gaps, ordered)
                    assert r.a == expected
                    assert r.b <= expected if ordered else True


def test_histogram_edges(spark):
    constant = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert [(r.bin, r.start, r.end, r["count"]) for r in A.histogram(constant, "v").collect()] == [(0, 5.0, 5.0, 4)]
    few = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "v double")
    assert sorted((r.bin, r["count"]) for r in A.histogram(few, "v").collect()) == [(0, 1), (1, 1), (2, 1)]
    assert A.histogram(few.filter("v > 9"), "v").count() == 0


def test_union_modes(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    assert W.union(a, b, "pad").columns == ["x", "y", "z"]
    assert W.union(a, b, "common_only").columns == ["x"]
    with pytest.raises(ValueError):
        W.union(a, b)


def test_audit_chain_of_a_true_log(spark):
    rows, previous = [], None
    for i in range(50):
        body = f"entry {i}"
        digest = hashlib.sha256(((previous or "") + "\n" + body).encode()).hexdigest()
        rows.append(("p", i, body, previous, digest))
        previous = digest
    schema = "p string, seq int, body string, prev string, digest string"
    assert E.broken_chain(spark.createDataFrame(rows, schema), "p", "seq", "body", "prev", "digest").count() == 0
    rows[20] = (*rows[20][:2], "forged", *rows[20][3:])
    del rows[30]
    broken = E.broken_chain(spark.createDataFrame(rows, schema), "p", "seq", "body", "prev", "digest").collect()
    assert {(r.seq, r.reason) for r in broken} == {(20, "hash"), (31, "link")}


def test_components_against_reachability(spark):
    rng = random.Random(11)
    edges = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(45)]
    reach = defaultdict(set)
    for a, b in edges:
        reach[a].add(b)
        reach[b]
    for _ in range(30):
        for a in list(reach):
            reach[a] |= {c for b in reach[a] for c in reach[b]}
    expected = {a: min([a, *[b for b in reach[a] if a in reach[b]]]) for a in reach}
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.node: r.component for r in G.components(df).collect()} == expected


def test_instance_id_equals_name_based_uuid(spark):
    import uuid

    df = spark.createDataFrame([("7",)], "k string")
    made = N.instance_ids(df, "Thing", N.row_key(["k"]), "seed", 3).first().instance_id
    assert made == "thing_" + uuid.uuid5(uuid.NAMESPACE_URL, "objectify:seed:3:target:7").hex[:12]


@pytest.mark.parametrize(
    "raw,kind,value",
    [
        ("€ 1.234,50", "decimal", 1234.5),
        ("(12)", "integer", -12),
        ("3,000", "integer", 3000),
        ("1.5", "integer", None),
        ("50%", "decimal", 50.0),
        ("1200원", "integer", 1200),
        ("USD 3", "integer", 3),
        ("yes", "boolean", True),
        ('{"a":1}', "json", '{"a":1}'),
        ("{a", "json", None),
        ("  ", "string", None),
    ],
)
def test_cell_coercion(spark, raw, kind, value):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(N.coerce(F.col("s"), kind)).first()[0] == value


def test_dangling_links_can_fail(spark):
    rows = spark.createDataFrame([(1, 5)], "a int, b int")
    with pytest.raises(ValueError):
        N.build_links(rows, "a", "b", "p", spark.createDataFrame([(6,)], "k int"), "k", "FAIL")


def test_run_mode_falls_back():
    assert N.run_mode(True, False, "incremental") == "incremental"
    assert N.run_mode(False, True, "incremental") == "full"
    assert N.run_mode(False, True, "delta") == "delta"


def test_row_function_schema(spark):
    df = spark.range(3)
    with pytest.raises(Exception, match="row fields"):
        U.map_rows(df, lambda r: {"x": 1}, "y int").collect()
    assert U.map_rows(df, lambda r: None, "y int").count() == 0


def test_lossless_normalizations(spark):
    df = spark.createDataFrame([(" 007.500 ",)], "s string")
    rules = ["trim", "strip_leading_zeros", "strip_trailing_zeros", "normalize_decimal"]
    assert df.select(C.normalized(F.col("s"), rules)).first()[0] == "7.5"
    with pytest.raises(ValueError):
        C.normalized(F.col("s"), ["round"])


def test_drift_of_schemas():
    changes = D.schema_changes({"user_id": "string", "n": "integer"}, {"n": "decimal", "x": "string"}, [r"_id$"])
    assert [(c["change"], c["impact"]) for c in changes] == [("column_removed", "data_loss"), ("column_added", "none"), ("type_changed", "none")]


def test_references_by_name():
    found = {c: (t, p) for c, t, p in P.references_by_name(["customer_id", "created_at", "zone_fk", "name"], ["customers"])}
    assert found == {"customer_id": ("customers", 0.9), "zone_fk": (None, 0.76)}


def test_nested_groups_keep_the_largest(spark):
    rows = [(a, b) for a, n in (("x", 5), ("y", 3), ("z", 1)) for b in "pqr"[:n] for _ in range(n)]
    kept = A.group_nested(spark.createDataFrame(rows, "a string, b string"), ["a", "b"], 2).collect()
    assert Counter(r.a for r in kept) == {"x": 2, "y": 2}
