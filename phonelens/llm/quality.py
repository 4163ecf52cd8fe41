"""Operator 4: quality rules.

A table of thresholds is compiled into one Spark projection of built-in
expressions over whole texts: length, symbol, stop-word, repetition and line
ratios.  No user function runs and no row moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "was", "for", "on", "as", "at", "by",
    "der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "ein", "eine", "nicht", "auf", "des",
    "le", "la", "les", "et", "de", "un", "une", "est", "que", "en", "du", "pour", "dans", "au",
    "el", "los", "las", "y", "que", "se", "por", "con", "una", "del", "al", "su",
)


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; NULL measures pass.  ``from_words``:
    the rule speaks only for texts with at least so many words."""

    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


DEFAULT_RULES = (
    Rule("mean_word_chars", 1.5, 15.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("dup_line_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", None, 0.3),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("stop_word_ratio", 0.02, None, from_words=100),
)


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the columns of ``carry``, the counts and the ratios.

    Words are runs of non-white-space; NULL, empty and blank texts have no
    word, zero counts and NULL ratios.  ``n_repeat_words`` counts the words
    covered by ``window``-word windows that occur twice or more in the text.
    Repeated rows are measured one by one; other columns are not read."""
    kept_columns = ["doc_id", *(f"`{c}`" for c in carry)]
    d = docs.select("doc_id", *kept_columns[1:], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    words = F.array_remove(F.split(F.translate("t", "\t\n\x0b\x0c\r", "     "), " "), "")
    d = d.select(*kept_columns, "t", words.alias("w"),
                 F.filter(F.split("t", "\n"), lambda x: F.length(_removed(x, " \t\x0b\x0c\r")) > 0).alias("lines"))
    # a window is named by its 64-bit hash; hashes of one text are compared
    # (the window's words side by side as one struct: one lambda call each, no slice() per window)
    at = F.sequence(F.lit(0), F.size("w") - window)
    side = F.arrays_zip(*[F.slice("w", k + 1, F.size("w") - (window - 1)).alias(f"w{k}") for k in range(window)])
    seen = F.when(F.size("w") >= window, F.transform(side, lambda x: F.xxhash64(x)))
    d = d.withColumn("h", seen)
    pairs = F.sort_array(F.zip_with("h", at, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    same = lambda i: F.get(F.col("p"), i)["h"] == F.get(F.col("p"), i + 1)["h"]
    n = F.size("p")
    again = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.when(i > 0, same(i - 1)).otherwise(False)
                     | F.when(i < n - 1, same(i)).otherwise(False))
    d = d.withColumn("r", F.when(F.col("p").isNotNull(), F.sort_array(F.transform(again, lambda i: F.get(F.col("p"), i)["i"]))))
    steps = F.zip_with("r", F.slice("r", 2, F.size("r")), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0))
    n_words, n_lines = F.size("w").cast("long"), F.size("lines")
    known = sorted({v for x in STOP_WORDS for v in (x, x.capitalize())})
    stops = F.size(F.filter("w", lambda x: x.isin(*known)))
    starts = lambda *marks: F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin(*marks)))
    counts = {
        "n_words": n_words, "word_chars": F.length(_removed(F.col("t"), " \t\n\x0b\x0c\r")),
        "n_symbols": F.length("t") - F.length(_removed(F.col("t"), SYMBOLS)),
        "n_dup_lines": n_lines - F.size(F.array_distinct("lines")), "n_repeat_words": repeated,
        "n_lines": n_lines, "n_stop_words": stops, "n_bullet_lines": starts("-", "*", "•"),
        "n_ellipsis_lines": F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    }
    # inline() keeps later filters from being pushed below, where they would repeat the counting
    d = d.select(*kept_columns, F.inline(F.array(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return d.select("*", ratio("word_chars", "n_words").alias("mean_word_chars"),
                    ratio("n_symbols", "word_chars").alias("symbol_ratio"),
                    ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
                    ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
                    ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
                    ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"))


def compile_rules(rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """One boolean expression: every rule of the table holds."""
    ok = F.lit(True)
    for r in rules:
        x = F.col(r.measure)
        holds = F.lit(True)
        if r.low is not None:
            holds = holds & (x >= F.lit(r.low))
        if r.high is not None:
            holds = holds & (x <= F.lit(r.high))
        ok = ok & F.coalesce(holds | (F.col("n_words") < r.from_words), F.lit(True))
    return ok


def quality(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, min_words: int = 10,
            max_repeat_percent: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Measures plus ``base_failed`` (too few words, or too large a share of
    words in repeated windows) and ``kept`` (not base_failed, and every rule
    of the table holds).  A text without words fails the base rule."""
    m = measures(docs, carry=carry)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))
