"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Defined cases: a null, empty or blank text has no words and fails the base rules; texts of any length are taken
whole; repeated rows are judged alike; every other column, whatever its name, passes through ``annotate`` untouched
(its own columns live in one struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.llm.common import SPACE, let, where_whole, window_hashes, words_of

WINDOW = 8

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the", "and", "of", "to", "in", "that", "is", "it", "for", "with",
    "der", "die", "das", "und", "den", "ist", "von", "nicht", "ein", "für",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "en",
    "el", "los", "las", "del", "y", "se", "por", "con", "no", "un",
)

#: (measure, least, most): a text is kept when every measure lies within its bounds; null is no bound.
RULES = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("dup_line_ratio", None, 0.50),
    ("pipe_ratio", None, 0.25),
    ("upper_ratio", None, 0.60),
    ("stop_ratio", 0.02, None),
)


def repeated_words(words: Column) -> Column:
    """Number of words inside ``WINDOW``-word windows that occur twice or more.

    Only where a hash occurs twice, equal windows (two hashes, 96 bits) become neighbours by sorting, and the covered
    words are the union of their intervals.
    """
    marked = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.hash(F.slice(words, i + 1, WINDOW)).alias("g"), i.alias("p"))))
    same = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
    # Each window that equals the next one in order names both places.
    twice = lambda r: F.array_sort(F.array_distinct(F.flatten(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda x, y: F.when(
        same(x, y), F.array(x["p"], y["p"])).otherwise(F.array().cast("array<int>"))))))
    covered = lambda places: F.aggregate(places, F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last")), lambda acc, p: F.struct(
        (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total"), p.alias("last")), lambda acc: acc["total"])
    return let(window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(marked(h), lambda r: covered(twice(r)))).otherwise(F.lit(0).cast("long")))


def annotate(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` (any columns, ``text``) plus a struct ``quality`` with the measures, base_failed and kept."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    by_words = let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).alias("n_stop")))
    by_lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")), lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    parts = docs.select(whole, by_words.alias("w"), by_lines.alias("l"), count(r"[^#*$%&|<>]+").alias("n_symbols"), count(r"[^|]+").alias("n_pipes"), count(r"[^A-Z]+").alias("n_upper"))
    n, chars = F.col("w.n_words"), F.nullif(F.col("w.word_chars"), F.lit(0))
    measures = {"n_words": n, "mean_word_chars": chars / n, "symbol_ratio": F.col("n_symbols") / chars, "dup_line_ratio": F.col("l.n_dup_lines") / F.greatest("l.n_lines", F.lit(1)),
                "pipe_ratio": F.col("n_pipes") / F.nullif(n, F.lit(0)), "upper_ratio": F.col("n_upper") / chars, "stop_ratio": F.col("w.n_stop") / F.nullif(n, F.lit(0))}
    failed = (n < 20) | (100 * F.col("w.n_repeat_words") > 30 * n)
    within = F.lit(True)
    for name, least, most in rules:
        for bound in ([measures[name] >= least] if least is not None else []) + ([measures[name] <= most] if most is not None else []):
            within = within & F.coalesce(bound, F.lit(False))
    return parts.select("row", F.struct(
        n.alias("n_words"), "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", *[c.alias(name) for name, c in measures.items() if name != "n_words"],
        failed.alias("base_failed"), (~failed & within).alias("kept")).alias("quality"))


def measure(docs: DataFrame, rules=RULES) -> DataFrame:
    """Doc_id, the base counts, base_failed and kept of every row."""
    q = annotate(docs.select("doc_id", "text"), rules)
    return q.select("row.doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """Rows of ``docs`` that pass, with their own columns."""
    return where_whole(annotate(docs, rules), F.col("quality.kept")).select("row.*")
