"""Quality rules: a threshold table compiled into one projection.

Every measure is an expression of built-in functions over one text, so the whole
operator is a chain of projections above the scan: no shuffle, no user function.

Defined cases: a null or empty text has no words, so all measures are 0 and the
text fails on its length. A ratio with the denominator 0 is 0. Null ids and
repeated rows give a row each. Columns of the input whose names clash with the
measures are replaced; others pass through only by `apply_rules`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import pinned, shingle_hashes, whole, words

# Frequent function words of four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by",
    "on", "not", "he", "his", "are", "this", "at", "from", "or", "have", "an", "they", "which", "you", "were",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "sich", "auf", "für",
    "im", "dem", "des", "als", "auch", "es", "er", "sie", "wir",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "qui", "dans", "pour", "est", "pas", "au",
    "sur", "par", "avec", "ne", "se", "plus", "elle", "il", "ce",
    "el", "los", "las", "y", "en", "no", "con", "su", "por", "lo", "como", "más", "pero", "sus", "al", "del",
)


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [least, most]; None leaves a side open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Limits as published for web text: word count, mean word length, symbols to words,
#: function words, share of repeated lines, bullet and ellipsis lines, words with a letter.
DEFAULT_RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=2, most=12),
    Rule("symbol_ratio", most=0.1),
    Rule("n_stop_words", least=2),
    Rule("dup_line_ratio", most=0.3),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
    Rule("letter_word_ratio", least=0.8),
    Rule("repeat_word_ratio", most=0.5),
)


#: A whole word without a letter.
_LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))


#: Ratios by name, over the counted columns.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
    "letter_word_ratio": ("n_letter_words", "n_words"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
}
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines",
    "n_stop_words", "n_letter_words", "n_repeat_words",
)


def measured(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and COUNTS of each text, one row per row of df.

    n_repeat_words counts the words in any 3-word window that is found twice or more
    in the text. Windows are compared by a 64-bit hash: positions sorted by hash
    bring equal windows together, n log n in the words of one text.
    """
    keep = list(df.columns) if keep is None else keep
    kept = [F.col(f"`{c}`") for c in keep if c not in COUNTS]
    base = df.select(*kept, whole(F.col(f"`{text_col}`")).alias("__t"))
    base = base.select("*", words(F.col("__t")).alias("__w"))
    base = base.select(
        "*",
        F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        shingle_hashes("__w", 3, short_whole=False).alias("__h"),
    )
    # Most texts repeat no window, which a hash set tells sooner than a sort.
    placed = F.sort_array(F.transform(F.col("__h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.select(
        "*",
        F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed)
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("__g"),
    )
    g = F.col("__g")
    twice = F.transform(
        F.filter(
            g,
            lambda x, k: F.coalesce(x["h"] == F.get(g, k - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(g, k + 1)["h"], F.lit(False)),
        ),
        lambda x: x["i"],
    )
    base = base.select("*", F.sort_array(twice).alias("__p"))
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    n = lambda c: pinned(c.cast("bigint"))
    return base.select(
        *kept,
        n(F.size("__w")).alias("n_words"),
        n(F.char_length(F.array_join("__w", ""))).alias("word_chars"),
        n(F.regexp_count("__t", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        n(F.size("__lines")).alias("n_lines"),
        n(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        n(F.size(F.filter("__lines", lambda x: x.rlike(r"^\s*[-*•]\s")))).alias("n_bullet_lines"),
        n(F.size(F.filter("__lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$")))).alias("n_ellipsis_lines"),
        n(F.size(F.filter("__w", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS))))).alias("n_stop_words"),
        n(F.size("__w") - F.regexp_count("__t", F.lit(_LETTERLESS))).alias("n_letter_words"),
        n(covered).alias("n_repeat_words"),
    )


def verdict(rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """The table compiled into one boolean expression over COUNTS."""
    out = F.lit(True)
    for r in rules:
        value = _ratio(*RATIOS[r.measure]) if r.measure in RATIOS else F.col(r.measure)
        if r.least is not None:
            out = out & (value >= r.least)
        if r.most is not None:
            out = out & (value <= r.most)
    return out


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(
    df: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = DEFAULT_RULES
) -> DataFrame:
    """The kept columns, COUNTS, base_failed and kept (false where base_failed, else the table's verdict)."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("base_failed", "kept")]
    out = measured(df, text_col, keep)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
