"""Quality rules: one table of thresholds, compiled into one projection.

Everything is row-local and made of built-in functions, so the plan is a scan
and a projection: no shuffle, no Python, and a document of any length costs
O(n log n) in its own words.  Only the arrays of one document are in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh, let, table

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages; each also counts with a capital.
_LOW = (
    "the of and to in that is was for on with as at by from or a an be this it "
    "der die das und zu von mit ist im in den ein eine auf nicht "
    "le la les de des et en un une du dans que est pour sur au "
    "el los las y del por con una se al no su para lo"
).split()
STOP_WORDS = sorted({*_LOW, *(w.capitalize() for w in _LOW)})


@dataclass(frozen=True)
class Rule:
    """A document fails if ``ratio`` (a name in :func:`ratios`) lies outside [low, high], among those of min_words or more."""

    ratio: str
    low: float = float("-inf")
    high: float = float("inf")
    min_words: int = 0


#: The production table.  Length bounds catch junk tokens, symbols catch markup
#: residue, stop words catch lists that aren't prose, lines catch repetition
#: (by their number and by their characters), lists and text cut short.
RULES = (
    Rule("mean_word_chars", low=2.0, high=20.0),
    Rule("symbols_per_word", high=0.25),
    Rule("stop_word_share", low=0.01, min_words=80),
    Rule("dup_line_share", high=0.5),
    Rule("dup_line_char_share", high=0.5),
    Rule("bullet_line_share", high=0.9),
    Rule("ellipsis_line_share", high=0.5),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


#: A window's hash and its place share a long: so many bits are the place's.
PLACE_BITS = 21


def _covered(p: Column) -> Column:
    """Words in the 3-word windows that start at the ascending places p."""
    return F.aggregate(F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.lit(3), F.get(p, k + 1) - x)).otherwise(3)), F.lit(0), lambda a, x: a + x)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are sorted as longs of hash and place.  Neighbours with one hash are
    compared as words; where any differ, or a text has 2**21 words or more, its
    windows are sorted as strings instead, so the count is exact in every case.
    """
    last = lambda w: F.sequence(F.lit(0), F.size(w) - 3)

    def by_strings(w: Column) -> Column:
        win = F.sort_array(F.transform(last(w), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("w"), i.alias("i"))))
        same = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))), lambda x: x["i"]))
        return let(let(win, same), _covered)

    def by_longs(w: Column) -> Column:
        place = (1 << PLACE_BITS) - 1
        packed = F.sort_array(F.transform(last(w), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~place)).bitwiseOR(i)))
        differ = lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) != 0
        at = lambda x: x.bitwiseAND(F.lit(place)).cast("int")
        again = lambda s: F.exists(F.zip_with(s, F.slice(s, 2, 1 << 30), differ), lambda x: x == F.lit(False))
        same = lambda s: F.filter(s, lambda x, k: ~F.coalesce(differ(F.get(s, k - 1), x), F.lit(True)) | ~F.coalesce(differ(F.get(s, k + 1), x), F.lit(True)))
        unequal = lambda i, j: (w[i] != w[j]) | (w[i + 1] != w[j + 1]) | (w[i + 2] != w[j + 2])
        mixed = lambda r: F.size(F.filter(r, lambda x, k: F.when((k > 0) & ~differ(F.get(r, k - 1), x), let(F.struct(at(F.get(r, k - 1)).alias("i"), at(x).alias("j")), lambda y: unequal(y["i"], y["j"]))).otherwise(False))) > 0
        counted = lambda r: F.when(F.size(r) == 0, 0).when(mixed(r), by_strings(w)).otherwise(let(F.sort_array(F.transform(r, at)), _covered))
        return let(packed, lambda s: F.when(again(s), let(same(s), counted)).otherwise(0))

    return let(words, lambda w: F.when(F.size(w) < 4, 0).when(F.size(w) >= 1 << PLACE_BITS, by_strings(w)).otherwise(by_longs(w))).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the ratios are made of; null text counts as empty."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(WORD))
    w, x_ = fresh(docs, "words", "lines")
    d = docs.withColumn(w, words_of(raw)).withColumn(x_, lines)
    chars = lambda c: F.length(c).cast("long")
    return d.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": chars(F.array_join(w, "")),
        "n_symbols": chars(F.regexp_replace(raw, f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size(x_).cast("long"),
        "n_dup_lines": (F.size(x_) - F.size(F.array_distinct(x_))).cast("long"),
        "line_chars": chars(F.array_join(x_, "")),
        "dup_line_chars": chars(F.array_join(x_, "")) - chars(F.array_join(F.array_distinct(x_), "")),
        "n_bullet_lines": F.size(F.filter(x_, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(x_, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long"),
        "n_repeat_words": repeat_words(F.col(w)),
    }).drop(w, x_)


def ratios() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "dup_line_char_share": per("dup_line_chars", "line_chars"),
        "bullet_line_share": per("n_bullet_lines", "n_lines"),
        "ellipsis_line_share": per("n_ellipsis_lines", "n_lines"),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if no rule fails."""
    value, ok = ratios(), F.lit(True)
    for r in rules:
        inside = value[r.ratio].between(r.low, r.high) if r.low > float("-inf") and r.high < float("inf") else value[r.ratio] >= r.low if r.low > float("-inf") else value[r.ratio] <= r.high
        ok = ok & (inside | (F.col("n_words") < r.min_words))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base_failed and kept for each row of docs.

    Null or empty text: no words, so it fails.  Repeated rows are judged alike,
    each on its own.  Columns of docs that are named like a result are replaced.
    An empty table gives an empty result.
    """
    return measured(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet,
         len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
         length(array_to_string(ls, '')) AS line_chars, length(array_to_string(ls, '')) - length(array_to_string(list_distinct(ls), '')) AS dup_line_chars,
         len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS n_stop
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 20
       AND n_symbols / greatest(n_words, 1) <= 0.25 AND (n_words < 80 OR n_stop / greatest(n_words, 1) >= 0.01)
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND dup_line_chars / greatest(line_chars, 1) <= 0.5
       AND n_bullet / greatest(n_lines, 1) <= 0.9 AND n_ellipsis / greatest(n_lines, 1) <= 0.5 AS kept
FROM b
"""
