"""Statistics of a text as column expressions, shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import SPACE, let

WINDOW = 5


def _covered(windows: Column) -> Column:
    """Words in windows that occur more than once: windows is the array of the windows' hashes.
    Sorted with their places, equal ones are neighbours; sorted by place again, each window
    covers up to WINDOW words until the next one begins."""
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def flagged(s: Column) -> Column:
        same = lambda a, j: F.coalesce(a["x"] == F.get(s, j)["x"], F.lit(False))
        return F.filter(F.transform(s, lambda a, j: F.when(same(a, j - 1) | same(a, j + 1), a["i"])), lambda i: i.isNotNull())

    def cover(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.get(places, k + 1) - p)), F.lit(0), lambda a, b: a + b)

    return let(placed, lambda s: let(F.sort_array(flagged(s)), cover))


def add_words(df: DataFrame) -> DataFrame:
    """Adds _text (never null) and _words."""
    df = df.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    return df.withColumn("_words", F.filter(F.split("_text", f"[{SPACE}]+"), lambda w: w != ""))


def add_base(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, over add_words()."""
    at = lambda i, k: F.get("_words", i + k)
    windows = F.when(
        F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.length("_text") - F.regexp_count("_text", F.lit(f"[{SPACE}]"))).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        "_windows": windows,
    })
    return df.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(_covered(F.col("_windows"))).cast("long"),
    }).drop("_lines", "_windows")


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def counted(pattern: str) -> Column:
    return F.regexp_count("_text", F.lit(pattern))


def shares() -> dict[str, Column]:
    """Ratios over a text with _text and _words; 0 where there is nothing to divide by."""
    n = F.size("_words")
    letters = counted(r"\p{L}")
    return {
        "upper_share": ratio(counted(r"\p{Lu}"), letters),
        "shout_share": ratio(counted("!"), n),
        "pipe_share": ratio(counted(r"(?<![^ \n])\|(?![^ \n])"), n),
        "symbol_share": ratio(counted(r"[#*$%&<>]"), n),
        "short_share": ratio(F.size(F.filter("_words", lambda w: F.length(w) <= 3)), n),
        "stutter_share": ratio(F.size(F.filter(F.transform("_words", lambda w, i: (i > 0) & (w == F.get("_words", i - 1))), lambda x: x)), n),
        "word_length": ratio(F.length("_text") - counted(r"\s"), n),
    }
