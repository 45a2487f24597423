"""Quality rules: a threshold table compiled into one Spark projection.

Everything here is built-in column expressions, so the rules run in the scan's own stage, without a shuffle and without
Python. Only a text that holds a five-word window twice pays for locating its repeated words.

Defined results: a null text counts as empty; an empty text has no words, fails the base rule and is not kept; repeated
rows get equal rows; an empty table gives an empty result; extra input columns are carried by ``judge`` under their own
names unless they clash with a measure, in which case the measure replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: Stop words of the four languages of the corpus, as text.
STOP_WORDS = (
    "the of and to a in is it that for was on are with as be this by from at or an "
    "de la le les et des en un une du que est pour qui dans sur par pas au avec "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch "
    "el los las y del se por con para una su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if ratio lies outside [least, most]. Documents under from_words words aren't held to it."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The threshold table. Ratios are the names in RATIOS.
RULES = (
    Rule("mean_word", "mean_word_length", 1.5, 20.0, 10),
    Rule("symbols", "symbols_per_word", None, 0.3, 10),
    Rule("upper_case", "upper_share", None, 0.6, 20),
    Rule("stop_words", "stop_word_share", 0.02, None, 30),
    Rule("duplicate_lines", "duplicate_line_share", None, 0.5, 10),
)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(words: Column, of) -> Column:
    """of(five neighbouring words) for every window, as an array; empty for fewer than five words."""
    at = lambda i: of(*(F.get(words, i + k) for k in range(WINDOW)))
    return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), at))


def _repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more: equal windows are neighbours once sorted, and the sorted starts give the covered words."""
    n = F.size(words) - WINDOW + 1
    marked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.concat_ws(" ", *(F.get(words, i + k) for k in range(WINDOW))).alias("w"), i.alias("i")))

    def starts(rows: Column) -> Column:
        same = lambda j: (F.get(rows, j)["w"] == F.get(rows, j - 1)["w"]) | (F.get(rows, j)["w"] == F.get(rows, j + 1)["w"])
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(same(j), F.lit(False))), lambda j: F.get(rows, j)["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    return _let(F.sort_array(marked), lambda rows: _let(starts(rows), covered))


def _has_twins(hashes: Column) -> Column:
    """Whether an array of numbers holds a value twice."""
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def measures(df: DataFrame, text: str = "text", once: Column | None = None) -> DataFrame:
    """df with the counts of its texts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters, n_stop_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_words": F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), "_lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))})
    df = df.withColumn("_windows", _windows(F.col("_words"), lambda *w: F.xxhash64(*w)))
    words, lines = F.col("_words"), F.col("_lines")
    ascii_letters = F.length(F.regexp_replace(body, "[^A-Za-z]", ""))
    df = df.withColumns(
        {
            **({} if once is None else {"_once": once}),
            "n_words": F.size(words).cast("bigint"),
            "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("bigint"),
            "n_lines": F.size(lines).cast("bigint"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "n_repeat_words": F.when(_has_twins(F.col("_windows")), _repeated_words(words)).otherwise(F.lit(0)).cast("bigint"),
            "n_upper": F.length(F.regexp_replace(body, "[^A-Z]+", "")).cast("bigint"),
            "n_letters": ascii_letters.cast("bigint"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        }
    )
    return df.drop("_words", "_lines", "_windows")


def ratios() -> dict[str, Column]:
    """The ratios a rule may name, from the columns of ``measures``; null where there is nothing to divide by."""
    per = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return {
        "mean_word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "upper_share": per("n_upper", "n_letters"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "duplicate_line_share": per("n_dup_lines", "n_lines"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the broken rules, as one array column over the columns of ``measures``."""
    known = ratios()

    def broken(rule: Rule) -> Column:
        value = known[rule.ratio]
        outside = [value < rule.least] * (rule.least is not None) + [value > rule.most] * (rule.most is not None)
        return F.when((F.col("n_words") >= rule.from_words) & reduce(Column.__or__, outside), F.lit(rule.name))

    return F.array_compact(F.array(*map(broken, rules)))


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that are kept, with df's columns. The measures stand beside a partition number, which is not deterministic, so that the
    optimizer computes them once and filters afterwards instead of writing their expressions into the filter again and again."""
    names = df.columns
    judged = _judged(measures(df.select(F.col(text).alias("_text"), F.struct(*names).alias("_row")), "_text", F.spark_partition_id()), rules)
    return judged.filter(F.col("kept") & (F.col("_once") >= 0)).select("_row.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with its measures, base_failed, broken (names of the broken rules) and kept."""
    return _judged(measures(df, text), rules)


def _judged(measured: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    out = measured.withColumns({"base_failed": base_failed(), "broken": compile_rules(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*names)


def _sql() -> str:
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    value = {
        "mean_word_length": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "upper_share": "n_upper / nullif(n_letters, 0)",
        "stop_word_share": "n_stop_words / n_words", "duplicate_line_share": "n_dup_lines / nullif(n_lines, 0)",
    }

    def passes(r: Rule) -> str:
        parts = [f"{value[r.ratio]} < {r.least}"] * (r.least is not None) + [f"{value[r.ratio]} > {r.most}"] * (r.most is not None)
        return f"NOT coalesce(n_words >= {r.from_words} AND ({' OR '.join(parts)}), false)"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 3, 1))) AS i, words FROM w),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM k WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
        len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {" AND ".join(map(passes, RULES))}) AS kept FROM b"""


OP9_SQL = _sql()
