"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, table

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = tuple(
    "the of and to in a is that for it as was with be by on are this an or from "
    "de la le et les des en un du une que est pour qui dans sur au par "
    "der die und das von zu den mit ist im dem ein "
    "el los se del las con su al es una no lo".split()
)
STOP_FORMS = tuple(dict.fromkeys(f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())))


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= metric <= high (a missing bound is open)."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Word-count bounds lie in the base rule. Ratios are per word, per character or per line with a word.
DEFAULT_RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_word_ratio", None, 0.3),
    Rule("bang_word_ratio", None, 0.3),
    Rule("upper_char_ratio", None, 0.5),
    Rule("alpha_char_ratio", 0.6, None),
    Rule("stop_word_count", 2.0, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", None, 0.3),
    Rule("bullet_line_ratio", None, 0.9),
)

SYMBOL = r"[#*$%&|<>]"


def _count(text: Column, pattern: str) -> Column:
    """Matches of a one-character class, as characters lost when they are removed."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeat_words(ws: Column) -> Column:
    """Words that lie in a three-word window found at least twice.

    Windows are compared by a 64-bit hash of their words. Windows are sorted with their positions, those
    equal to a neighbour are kept, and the union of their spans is measured in one pass: n log n, no pairs.
    """
    n = F.size(ws)
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.struct(F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)).alias("h"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == b["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"]))

    def span(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"]).cast("long")).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(let(F.sort_array(windows), repeated), span))


def measure(docs: DataFrame) -> DataFrame:
    """Adds the metrics of every row: one narrow projection, no shuffle."""
    # Names of the words' and lines' arrays that no column of the input has.
    w, li = (next(n for n in (f"{stem}{'_' * k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for stem in ("_w", "_l"))
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    share = lambda xs, keep: F.size(F.filter(xs, keep)) / F.greatest(F.size(xs), F.lit(1))
    per_word = lambda n: n / F.greatest(F.size(w), F.lit(1))
    per_char = lambda n: n / F.greatest(F.col("word_chars"), F.lit(1))
    cols = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": _count(text, SYMBOL),
        "n_dup_lines": (F.size(li) - F.size(F.array_distinct(li))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(w)),
        "bang_word_ratio": per_word(F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("!")))),
        "stop_word_count": F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_FORMS)))).cast("double"),
        "ellipsis_line_ratio": share(F.col(li), lambda x: x.rlike(r"(\.\.\.|…)\s*$")),
        "bullet_line_ratio": share(F.col(li), lambda x: x.rlike(r"^\s*[-*•‣]")),
    }
    wide = docs.withColumns({w: ws, li: lines}).withColumns(cols)
    letters = lambda kind: F.length(text) - F.length(F.regexp_replace(text, kind, ""))
    return wide.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
            "symbol_word_ratio": per_word(F.col("n_symbols")),
            "upper_char_ratio": per_char(letters(r"\p{Lu}+")),
            "alpha_char_ratio": per_char(letters(r"\p{L}+")),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size(li), F.lit(1)),
        }
    ).drop(w, li)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one array of names of failed rules."""
    failed = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (F.col(r.metric) > F.lit(float(r.high)))
        failed.append(F.when(bad, F.lit(r.metric)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """All rows and columns of ``docs`` plus the metrics, ``base_failed``, ``failed_rules`` and ``kept``.

    Null text counts as empty (no words: base_failed). Texts of any length are measured whole. Rows are judged one by
    one, so repeated rows give repeated results, an empty table an empty one; columns of ``docs`` that clash with
    a metric are replaced, all others kept, whatever their names.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        measure(docs)
        .withColumn("base_failed", base)
        .withColumn("failed_rules", compile_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every row of ``documents``; edge cases as for ``apply_rules``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOPS = ", ".join(f"'{w}'" for w in STOP_FORMS)
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         (length(t) - length(replace(t, '!!', '!'))) / greatest(len(w), 1) AS bang,
         len(list_intersect(list_distinct(w), [{_STOPS}])) AS stops,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) / greatest(len(l), 1) AS ell,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•‣]'))) / greatest(len(l), 1) AS bul,
         length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS up,
         length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS alpha, len(l) AS n_lines
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15 AND n_symbols / greatest(n_words, 1) <= 0.3
         AND bang <= 0.3 AND up / greatest(word_chars, 1) <= 0.5 AND alpha / greatest(word_chars, 1) >= 0.6
         AND stops >= 2 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND ell <= 0.3 AND bul <= 0.9 AS kept
FROM b"""
