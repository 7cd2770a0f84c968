"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built-in column functions: length, symbol, stop-word and line
ratios of each whole text, then the table's comparisons. No shuffle, no user
function.

Defined cases: a null or blank text has no words and fails the base rule; a
ratio without a denominator is 0; repeated rows are judged alike; an empty table
gives an empty result; columns of the input that share a name with a measure are
replaced by ``quality_rules`` and untouched by ``keep_good``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from neardup.llm.common import SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the languages the corpus is known to hold.
STOP_WORDS = {
    "en": ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that",
           "the", "this", "to", "was", "with"],
    "fr": ["au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour",
           "que", "qui", "sur", "un", "une"],
    "de": ["als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit",
           "nicht", "sich", "und", "von", "zu"],
    "es": ["al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se",
           "su", "un", "una", "y"],
}


class Rule(NamedTuple):
    """``low <= over / under <= high``; a bound of None is open."""

    name: str
    over: str
    under: str | None
    low: float | None
    high: float | None


RULES = [
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("stop_words", "n_stop_words", None, 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*BASE, "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines"]


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    Window hashes tell at once that most texts repeat nothing. Otherwise equal
    neighbours of the sorted (hash, place) list are compared word by word, and
    the overlap of kept windows is counted once.
    """
    def window(p: Column) -> Column:
        return F.slice(words, p + 1, WINDOW)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda p: F.xxhash64(window(p)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(
            F.least(F.lit(WINDOW), p - F.get(places, i - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(found: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & (window(x["p"]) == window(y["p"])), F.lit(False))
        twice = F.filter(found, lambda x, i: same(x, F.get(found, i - 1)) | same(x, F.get(found, i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def count(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(paired, places), covered))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, count))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES."""
    t = F.coalesce(F.col(text), F.lit(""))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = docs.drop(*MEASURES).withColumns({"_words": words_of(F.col(text)), "_lines": lines})
    w, n = F.col("_words"), F.col("_lines")
    out = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size(n) - F.size(F.array_distinct(n)),
        "n_repeat_words": _repeated(w),
        "n_lines": F.size(n),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(stops))),
        "n_bullet_lines": F.size(F.filter(n, lambda x: x.rlike("^[ \\t]*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(n, lambda x: x.rlike("(\\.\\.\\.|…)[ \\t\\r]*$"))),
    }
    return df.withColumns({k: c.cast("bigint") for k, c in out.items()}).drop("_words", "_lines")


def compiled(rules: list[Rule]) -> dict[str, Column]:
    """For each rule the condition that a good text meets."""
    out = {}
    for r in rules:
        x = F.col(r.over).cast("double")
        if r.under:
            x = F.when(F.col(r.under) > 0, x / F.col(r.under)).otherwise(F.lit(0.0))
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (x >= r.low)
        if r.high is not None:
            ok = ok & (x <= r.high)
        out[r.name] = ok
    return out


def quality_rules(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES, base_failed, failed_rules (names) and kept."""
    df = measure(docs.drop("base_failed", "failed_rules", "kept"), text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in compiled(rules).items()]))
    df = df.withColumns({"base_failed": base, "failed_rules": failed})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with their own columns only."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")
    judged = quality_rules(docs.select(own, F.col(text).alias("_text")), rules, "_text")
    # a filter isn't pushed below a column that isn't deterministic; pushed down, it would hold
    # the measures once for each use and compute them anew for each
    judged = judged.withColumn("_at", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_at") >= 0)).select("_own.*")
