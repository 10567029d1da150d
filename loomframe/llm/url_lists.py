"""URL filters as a temporal list join.

Dated list entries (``add`` or ``remove`` on a day) become validity intervals; every capture is
judged by the entries active on the day it was fetched, through an as-of join on distinct
(key, day) pairs. Captures of one host on one day are asked for once, so a host with a third of
all captures costs one pair per day, and no window holds more rows than a key has days.

Kinds: ``domain`` matches a host and its subdomains, ``host`` the host alone, ``url`` the host and
path without query, fragment and closing slash. An entry counts from its day on; an entry added and
removed on one day is removed; repeated entries change nothing. Hosts of any length are judged: of
a host only those endings are looked up that have as many labels as some listed domain. URLs without a host, missing URLs
and captures without a day match nothing. Repeated captures each get their row; extra columns are
kept, those named like an output column are replaced by it. Empty lists reject nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.session import materialize


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; missing if there is none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    bare = F.rtrim(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.lower(F.regexp_replace(bare, r"\.$", ""))
    return F.when(host != "", host)


def page_of(url: Column) -> Column:
    """Host and path, without query, fragment and closing slashes."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, r"/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, action, day) to (list, kind, value, valid_from, valid_until); open ends are missing."""
    key = ["list", "kind", "value"]
    known = entries.dropna(subset=[*key, "day"])
    daily = known.groupBy(*key, "day").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    ends = F.lead("day").over(Window.partitionBy(*key).orderBy("day"))
    spans = daily.withColumn("valid_until", ends).filter(F.col("on") == 1)
    return spans.select(*key, F.col("day").alias("valid_from"), "valid_until")


def active_on(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """As-of join: ``lists`` (sorted) that hold (kind, value) on ``day``, for distinct probes; others are left out."""
    listed = spans.select("list", "kind", "value").distinct()
    asked = probes.join(listed, ["kind", "value"]).withColumns({"from": F.lit(None).cast("date"), "until": F.lit(None).cast("date")})
    known = spans.withColumn("day", F.col("valid_from")).withColumnsRenamed({"valid_from": "from", "valid_until": "until"})
    columns = ["list", "kind", "value", "day", "from", "until"]
    both = known.select(*columns, F.lit(0).alias("asks")).unionByName(asked.select(*columns, F.lit(1).alias("asks")))
    past = Window.partitionBy("list", "kind", "value").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("asks") == 0, F.struct("from", "until")), ignorenulls=True).over(past)
    found = both.withColumn("span", latest).filter((F.col("asks") == 1) & F.col("span").isNotNull())
    held = found.filter(F.col("span.until").isNull() | (F.col("day") < F.col("span.until")))
    return held.groupBy("kind", "value", "day").agg(F.array_sort(F.collect_set("list")).alias("lists"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """The captures with ``host``, ``lists`` (active lists that name the URL, sorted) and ``rejected``."""
    spans = materialize(intervals(entries), "url-spans")
    made = ("host", "lists", "rejected")
    rows = captures.select(*[c for c in captures.columns if c not in made]).withColumns({
        "host": host_of(F.col(url)), "_page": page_of(F.col(url)), "_day": F.col(day),
    })
    known = F.col("_page").isNotNull() & F.col("_day").isNotNull()
    asked = materialize(rows.filter(known).select("host", F.col("_page").alias("page"), F.col("_day").alias("day")).distinct(), "url-asked")
    hosts = asked.select("host", "day").distinct()
    labels = F.split("host", r"\.")
    # Distinct label counts of listed domains: no more than the longest of them has labels.
    depths = spans.filter("kind = 'domain'").agg(F.collect_set(F.size(F.split("value", r"\."))).alias("depths"))
    fitting = F.filter(F.col("depths"), lambda n: n <= F.size(labels))
    tails = F.transform(fitting, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    keys = F.concat(
        F.transform(tails, lambda t: F.struct(F.lit("domain").alias("kind"), t.alias("value"))),
        F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value"))),
    )
    host_keys = hosts.withColumn("depths", depths.scalar()).select("host", "day", F.explode(keys).alias("k")).select("host", "day", "k.kind", "k.value")
    pages = asked.select(F.lit("url").alias("kind"), F.col("page").alias("value"), "day").distinct()
    probes = host_keys.select("kind", "value", "day").distinct().unionByName(pages)
    held = materialize(active_on(probes, spans), "url-held")
    by_host = host_keys.join(held, ["kind", "value", "day"]).groupBy("host", "day").agg(F.flatten(F.collect_list("lists")).alias("by_host"))
    by_page = held.filter("kind = 'url'").select(F.col("value").alias("page"), "day", F.col("lists").alias("by_page"))
    none = F.array().cast("array<string>")
    lists = F.array_sort(F.array_union(F.coalesce("by_host", none), F.coalesce("by_page", none)))
    answers = asked.join(by_host, ["host", "day"], "left").join(by_page, ["page", "day"], "left")
    answers = answers.filter("by_host IS NOT NULL OR by_page IS NOT NULL").select(
        F.col("page").alias("_p"), F.col("day").alias("_d"), lists.alias("lists")
    )
    # A page names its host, so (page, day) has one answer and captures meet it in one join.
    out = rows.join(answers, (F.col("_page") == F.col("_p")) & (F.col("_day") == F.col("_d")), "left")
    out = out.withColumn("lists", F.coalesce("lists", none)).withColumn("rejected", F.size("lists") > 0)
    return out.drop("_p", "_d", "_page", "_day")
