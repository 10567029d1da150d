"""Quality rules: a threshold table compiled into one projection of ratios.

Every measure is a Spark expression over the whole text; nothing shuffles and nothing leaves the
JVM. Missing texts count as empty, have no words and fail the length rule. Repeated rows and ties
do not matter, since each row is judged by itself; an empty table gives an empty result. Input
columns are kept; one that has the name of a measure is replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is it that for on with as was are be this from at by an or not
der die das und in zu den mit von ist nicht ein eine auf sich dem des im für sie
le la les de des et en un une que qui dans du pour pas sur est au avec par elle il
el los las y del se que por con para una su es al lo como más
""".split()


@dataclass(frozen=True)
class Rule:
    """Reject when ``measure`` leaves [low, high]; a missing bound is open, a missing measure passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        value = F.col(self.measure)
        tests = [value < F.lit(self.low)] if self.low is not None else []
        tests += [value > F.lit(self.high)] if self.high is not None else []
        if not tests:
            raise ValueError(f"rule {self.name} has no bound")
        return F.coalesce(tests[0] | tests[-1], F.lit(False))


# Ratios are per word or per line with a word.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 16.0),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("stop_words", "stop_word_ratio", 0.04, None),
    Rule("stuttering", "same_word_ratio", None, 0.3),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("short_lines", "words_per_line", 1.5, None),
    Rule("cut_lines", "ellipsis_line_ratio", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def _repeated(words: str) -> Column:
    """Words inside windows of WINDOW words that occur at least twice in the text."""
    spots = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.array_sort(spots)
    return F.when(F.size("_windows") == F.size(F.array_distinct("_windows")), F.lit(None)).otherwise(ordered)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with the counts and ratios that rules may use."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(whole, F.lit(BLANKS))
    step = docs.withColumns({
        "_hashes": F.transform(
            F.when(bare != "", F.split(bare, BLANK + "+")).otherwise(F.array().cast("array<string>")), lambda w: F.xxhash64(w)
        ),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: F.translate(x, BLANKS, "") != ""),
        "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint"),
    })
    stops = [F.xxhash64(F.lit(x)) for w in STOP_WORDS for x in (w, w.capitalize())]
    starts = F.slice("_hashes", 1, F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0)))
    step = step.withColumns({
        "n_words": F.size("_hashes").cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "_windows": F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get("_hashes", i + k) for k in range(1, WINDOW)])),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_stops": F.size(F.filter("_hashes", lambda h: h.isin(stops))),
        "_same": F.size(F.filter("_hashes", lambda h, i: (i > 0) & (h == F.get("_hashes", i - 1)))),
        "_cut": F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    })
    step = step.withColumn("_spots", _repeated("_windows"))
    # Equal neighbours in hash order are windows found again; back in text order their union is measured.
    again = F.filter(
        "_spots",
        lambda s, k: F.coalesce(s["h"] == F.get(F.col("_spots"), k - 1)["h"], F.lit(False))
        | F.coalesce(s["h"] == F.get(F.col("_spots"), k + 1)["h"], F.lit(False)),
    )
    step = step.withColumn("_again", F.array_sort(F.transform(again, lambda s: s["i"])))
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct(
            (i + WINDOW).cast("int").alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).cast("int").alias("n")
        ),
        lambda a: a["n"],
    )
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return step.withColumns({
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("_stops") / words,
        "same_word_ratio": F.col("_same") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "words_per_line": F.col("n_words") / lines,
        "ellipsis_line_ratio": F.col("_cut") / lines,
    }).drop("_lines", "_windows", "_spots", "_again", "_stops", "_cut", "_same", "_hashes")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The input with its measures, ``base_failed``, the names of broken rules and ``kept``."""
    broken = [F.when(r.failed(), F.lit(r.name)) for r in rules]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measured(docs, text).withColumns({"base_failed": base, "broken_rules": F.array_compact(F.array(*broken))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, columns as given.

    A filter would be pushed below the measures, with all of them written out inside it again and
    again; unpacking a row or nothing leaves the projections as they are.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return judge(whole, rules).select(F.inline(F.when(F.col("kept"), F.array("row"))))
