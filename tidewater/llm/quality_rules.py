"""Quality rules: one threshold table compiled into one Spark projection.

Each rule is a row `(metric, relation, numerator weight, denominator, bound)`; all metrics are computed
in a single projection of built-in functions (no Python, no shuffle), and the rules become one Boolean
expression over them. Comparisons are cross-multiplied integers, so no rounding decides a document.

Defined results: a null or empty text has no words, fails the length rule and is not kept; a text of one
very long word is one word; repeated rows are scored one by one; an empty table gives an empty result;
`metrics` and `judge` replace input columns that have the name of a metric, of `base_failed` or of `kept`;
`filter_documents` returns every input column untouched, whatever its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE_CLASS, let

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Frequent function words of the corpus languages, compared exactly as written.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this or from an a "
    "de la le et les des en un une du dans est pour que qui par sur au pas avec "
    "der die und den von zu das mit sich auf für ist nicht ein eine dem "
    "el los las y del se por con para una su al es lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document is rejected when `scale * metric  <relation>  bound * per` holds; `per` is a metric name or 1."""

    metric: str
    relation: str
    bound: int
    per: str | None = None
    scale: int = 100


#: The contract's own rules.
BASE_RULES = (
    Rule("n_words", "<", 50, None, 1),
    Rule("n_repeat_words", ">", 50, "n_words"),
)

#: The verdict's rules: mean word length, symbols per word, lines repeated, stop words among words.
VERDICT_RULES = (
    Rule("word_chars", "<", 200, "n_words"),
    Rule("word_chars", ">", 1500, "n_words"),
    Rule("n_symbols", ">", 20, "n_words"),
    Rule("n_dup_lines", ">", 50, "n_lines"),
    Rule("n_stop_words", "<", 5, "n_words"),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def repeated_window_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the same text, the first one included.

    Windows are compared by a chained 64-bit hash. Texts without a repeated window stop after a distinct
    count; the others sort (hash, position) pairs, so the cost is n log n in the text's words.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda p: F.filter(
                F.transform(
                    p,
                    lambda x, k: F.when(
                        (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        return F.aggregate(
            F.sort_array(twice),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("free")),
            lambda a, i: F.struct(
                (a["n"] + i + 3 - F.greatest(i, a["free"])).alias("n"), (i + 3).alias("free")
            ),
            lambda a: a["n"].cast("long"),
        )

    def of_windows(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        repeated = let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(repeated)

    return let(words, of_windows)


def _fails(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(False)
    for r in rules:
        left = F.lit(r.scale) * F.col(r.metric)
        right = F.lit(r.bound) * (F.col(r.per) if r.per else F.lit(1))
        out = out | ((left < right) if r.relation == "<" else (left > right))
    return out


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the metric columns; every other column stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    with_arrays = docs.withColumns({"__words": words_of(text), "__lines": lines})
    w, ls = F.col("__words"), F.col("__lines")
    long = lambda c: c.cast("long")
    return with_arrays.withColumns(
        {
            "n_words": long(F.size(w)),
            "word_chars": long(F.length(F.translate(text, BLANKS, ""))),
            "n_symbols": long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
            "n_lines": long(F.size(ls)),
            "n_dup_lines": long(F.size(ls) - F.size(F.array_distinct(ls))),
            "n_repeat_words": repeated_window_words(w),
            "n_stop_words": long(F.size(F.filter(w, lambda x: x.isin(STOP_WORDS)))),
        }
    ).drop("__words", "__lines")


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the metrics, `base_failed` and `kept`."""
    return (
        metrics(docs, text_col)
        .withColumn("base_failed", _fails(BASE_RULES))
        .withColumn("kept", ~F.col("base_failed") & ~_fails(VERDICT_RULES))
    )


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents kept, with their own columns only (computed columns never shadow an input column)."""
    keep = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    judged = judge(docs.select(keep, F.col(f"`{text_col}`").alias("__text")), "__text")
    return judged.filter("kept").select("__row.*")
