"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Frequent function words of the languages served.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his are this or at from",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y a los del se las por un para con no una su al lo como",
}

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keep a document only while low <= metric <= high (a null bound is open)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Thresholds of the method. Ratios are per word, per line or per word
#: character; documents that a rule cannot judge (ratio null) pass it.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("shouting", "upper_ratio", None, 0.30),
    Rule("exclamation", "exclamation_ratio", None, 0.10),
    Rule("stop_words", "stop_ratio", 0.03, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50),
    Rule("repetition", "repeat_ratio", None, 0.45),
)


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios of each text; no shuffle and no user function.

    Counts are longs: n_words, word_chars (code points in words), n_symbols,
    n_lines (lines with a word), n_dup_lines (those equal to an earlier one),
    n_repeat_words (words in 3-word windows that the text holds twice or
    more), n_upper, n_exclamations, n_stop_words. Null and blank texts have 0
    everywhere and null ratios. Columns of these names are replaced.
    """
    own = F.coalesce(df[text], F.lit(""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    out = df.withColumns(
        {
            "_words": common.words(df[text]),
            "_lines": F.filter(F.split(own, "\n"), lambda x: F.btrim(x, F.lit(common.SPACES)) != ""),
            "word_chars": F.length(F.translate(own, common.SPACES, "")).cast("long"),
            "n_symbols": _count_of(own, SYMBOLS).cast("long"),
            "n_upper": (F.length(own) - F.length(F.regexp_replace(own, r"\p{Lu}", ""))).cast("long"),
            "n_exclamations": _count_of(own, "!").cast("long"),
        }
    )
    words = F.col("_words")
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long"),
            # one hash for each window of three words, by its first word
            "_windows": F.transform(
                F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
            ),
        }
    ).drop("_lines")
    windows = F.col("_windows")
    # windows sorted by hash, then place; only of texts that repeat one
    out = out.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    ordered = F.col("_sorted")
    same = lambda x, i, by: F.coalesce(F.get(ordered, i + by)["h"] == x["h"], F.lit(False))
    out = out.withColumn("_places", F.sort_array(F.transform(F.filter(ordered, lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1))), lambda x: x["i"])))
    places = F.col("_places")
    covered = F.aggregate(
        F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_words", "_windows", "_sorted", "_places")
    # a row id that is used keeps Catalyst from moving a caller's filter below
    # these projections, where it would evaluate each expression at every use
    out = out.withColumn("_row", F.monotonically_increasing_id()).where("_row >= 0").drop("_row")
    per = lambda n, d: F.try_divide(F.col(n).cast("double"), F.col(d))
    return out.withColumns(
        {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "upper_ratio": per("n_upper", "word_chars"),
            "exclamation_ratio": per("n_exclamations", "n_words"),
            "stop_ratio": per("n_stop_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "repeat_ratio": per("n_repeat_words", "n_words"),
        }
    )


def verdict(rules=RULES) -> Column:
    """The rules as one expression: the names of those that a row breaks."""
    broken = []
    for r in rules:
        m = F.col(r.metric)
        tests = [t for t in (None if r.low is None else m < r.low, None if r.high is None else m > r.high) if t is not None]
        broken.append(F.when(reduce(lambda a, b: a | b, tests), F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def apply_rules(df: DataFrame, text: str = "text", rules=RULES, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """``measure`` plus base_failed (fewer words than ``min_words``, or over
    ``max_repeat`` of them repeated), broken_rules and kept."""
    out = measure(df, text)
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.withColumns({"base_failed": base, "broken_rules": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def passing(df: DataFrame, **options) -> DataFrame:
    """The rows that ``apply_rules`` keeps, columns as they were."""
    return apply_rules(df, **options).where("kept").select(*df.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; empty and null texts fail the base."""
    return apply_rules(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
