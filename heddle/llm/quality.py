"""Quality rules: a table of thresholds compiled into one projection.

Every feature is a built-in expression over the whole text and every rule is a range
that a feature (or a ratio of two features) must lie in, so the verdict is computed where the
row is read: there is no shuffle, no user function and no state beyond the row.

Defined results: a null text counts as empty; an empty text has no words and fails; a long text is read whole, its windows
sorted in one row; repeated rows and rows with null ids are each judged on their own; other columns pass
through unless they have the name of an output column, in which case the output column wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import SPACES, table, text_of, unused, words_of

SYMBOLS = "#*$%&|<>"
LIST_MARKS = ("-", "*", "•", "‣")

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by are this or an at from not have "
    "le la les de des et un une que en du dans pour est pas qui sur il au ne "
    "der die das und den von zu mit ist ein eine nicht auch es auf im dem sich "
    "el los las y por con para se del lo como su al no"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= feature / per <= high``; ``per`` is 1 if not named, and a ratio over nothing is 0."""

    name: str
    feature: str
    low: float | None = None
    high: float | None = None
    per: str | None = None

    def passes(self) -> Column:
        value = F.col(self.feature).cast("double")
        if self.per:
            value = F.when(F.col(self.per) > 0, value / F.col(self.per)).otherwise(F.lit(0.0))
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= F.lit(float(self.low)))
        if self.high is not None:
            ok = ok & (value <= F.lit(float(self.high)))
        return ok


#: The production thresholds.
RULES = (
    Rule("enough words", "n_words", low=50),
    Rule("repeated three-word windows", "n_repeat_words", high=0.5, per="n_words"),
    Rule("mean word length", "word_chars", low=2, high=15, per="n_words"),
    Rule("symbols", "n_symbols", high=0.25, per="n_words"),
    Rule("digits", "n_digits", high=0.3, per="word_chars"),
    Rule("repeated lines", "n_dup_lines", high=0.5, per="n_lines"),
    Rule("lines that start as list items", "n_list_lines", high=0.9, per="n_lines"),
    Rule("lines that end in dots", "n_dots_lines", high=0.5, per="n_lines"),
    Rule("stop words", "n_stop_words", low=0.02, per="n_words"),
)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the features that rules can name, all of type long."""
    text, words, windows, lines, places = unused(docs, "text", "words", "windows", "lines", "places")
    base = docs.withColumn(text, text_of(docs, text_col)).withColumn(words, words_of(F.col(text)))
    # Windows sorted with their places: equal windows are neighbours.
    window = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(
            F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")
        ),
    )
    line = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    sorted_ = base.withColumns({windows: F.sort_array(window), lines: line})
    beside = lambda x, i: F.coalesce(F.get(windows, i)["w"] == x["w"], F.lit(False))
    repeated = F.filter(windows, lambda x, i: beside(x, i - 1) | beside(x, i + 1))
    found = sorted_.withColumn(places, F.sort_array(F.transform(repeated, lambda x: x["i"])))
    # A repeated window adds its three words, less those that the next one adds again.
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    starts = F.transform(lines, lambda x: F.substring(F.ltrim(x), 1, 1))
    counted = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, SPACES, "")),
        "n_symbols": _count(F.col(text), SYMBOLS),
        "n_digits": _count(F.col(text), "0123456789"),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_list_lines": F.size(F.filter(starts, lambda c: c.isin(*LIST_MARKS))),
        "n_dots_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_repeat_words": covered,
    }
    # A generator of one row: filters on features stay above it, where each is computed once.
    one = F.inline(F.array(F.struct(*[v.cast("long").alias(k) for k, v in counted.items()])))
    return found.select(*[docs[c] for c in docs.columns if c.lower() not in counted], one)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the features, ``failed_rules`` (names, in the table's order) and ``passed``."""
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    judged = features(docs, text_col).withColumn("failed_rules", failed)
    return judged.withColumn("passed", F.size("failed_rules") == 0)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.col("passed") & ~base_failed).alias("kept"),
    )


def _oracle() -> str:
    """SQL for the query's rows, with the rules of the table."""
    value = lambda r: f"CASE WHEN {r.per} > 0 THEN {r.feature} / {r.per}::DOUBLE ELSE 0 END" if r.per else f"{r.feature}::DOUBLE"
    checks = [f"{value(r)} >= {float(r.low)}" for r in RULES if r.low is not None] + [f"{value(r)} <= {float(r.high)}" for r in RULES if r.high is not None]
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS s FROM documents),
w AS MATERIALIZED (
  SELECT rid, doc_id, t, s, list_filter(string_split(translate(t, s, '     '), ' '), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || s, '')) > 0) AS l FROM d),
g AS (
  SELECT rid, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 3)),
r AS (SELECT rid, k FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([k, k + 1, k + 2]) AS p FROM r) GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, ' ' || s, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, length(t) - length(translate(t, '0123456789', '')) AS n_digits,
    len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(list_filter(l, lambda x: substr(ltrim(x, ' '), 1, 1) IN ({quoted(LIST_MARKS)}))) AS n_list_lines,
    len(list_filter(l, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS n_dots_lines,
    len(list_filter(w, lambda x: lower(x) IN ({quoted(STOP_WORDS)}))) AS n_stop_words, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(checks)} AS kept FROM b
"""


ORACLE_SQL = _oracle()
