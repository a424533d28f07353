"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items.

An item's windows are its runs of ``WINDOW`` words (a shorter item is one window). A window is the set
of its shingles of ``SHINGLE`` words with their places, and a document contains it where all of them
follow in place. Containment must be complete, so the necessary prefix of a window's shingles, ordered by
rarity over all documents, is its rarest shingle alone:

1. One pass over the documents finds the shingles that any window has (the item side is
   broadcast where its counted rows are few). These hits are written, with a row for each document, so the
   texts are cut once, for the counts and for the join.
2. Hits are counted per shingle over all documents, which orders each window's shingles by rarity.
3. The prefix join: hits of a window's rarest shingle are candidates, if the window fits between the document's
   first and last word (length and positional bounds).
4. A candidate is verified by the shingles at the window's two ends, which together are all its
   words; shingles are compared as text, so the verdict is exact.
5. Items meet verified windows last, so a window of many items is no list anywhere.

Everything is a DataFrame expression. Texts are keyed by id and digest, so copies
only meet as counts.

Defined results: null and empty texts have no words and no hits; items without words are ignored; repeated
items count once; items without an id are one item, its id written as nothing; repeated documents, and documents
with null ids, are judged on their own; a long text is cut whole, in one row's array; ties in rarity go to the first place; an
empty table on either side gives no hits; other columns, whatever their names, are dropped by
``contamination`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import few, passing, settle, table, text_of, unused

WINDOW = 10
SHINGLE = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that separate words: all but digits and letters.
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Words of digits, ASCII letters (lower-cased) and any other non-ASCII characters."""
    plain = F.translate(text, _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles(found: Column, size: int) -> Column:
    """All runs of ``size`` words as text, at their places."""
    n = F.greatest(F.size(found) - (size - 1), F.lit(0))
    return F.transform(F.slice(found, 1, n), lambda w, i: F.concat_ws(" ", w, *[F.get(found, i + k) for k in range(1, size)]))


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, window, n_words, size`` and the place ``at`` and text ``shingle`` of each of its shingles."""
    held = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item_id"), words(text_of(items)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    cut = held.select(
        "item_id",
        F.explode(F.transform(F.slice("w", 1, F.size("w") - n + 1), lambda _, i: F.slice("w", i + 1, n))).alias("ws"),
    )
    sized = cut.distinct().select("item_id", "ws", F.size("ws").alias("n_words"), F.least(F.size("ws"), F.lit(shingle)).alias("size"))
    text = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - F.col("size")),
        lambda i: F.concat_ws(" ", F.slice("ws", i + 1, F.col("size"))),
    )
    named = sized.withColumn("window", F.concat_ws(" ", "ws"))
    return named.select("item_id", "window", "n_words", "size", F.posexplode(text).alias("at", "shingle"))


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text_col: str = "text"
) -> DataFrame:
    """One row per distinct ``(doc_id, text)``: ``doc_id, digest, n_words, n_hit, n_items, item_ids`` and ``copies``, the rows it stands for."""
    with passing() as keep:
        return keep(_contamination(docs, items, window, shingle, text_col))


def _contamination(docs: DataFrame, items: DataFrame, window: int, shingle: int, text_col: str) -> DataFrame:
    cut = settle(windows(items, window, shingle))
    sizes = settle(cut.select("size", "shingle").distinct())
    short = sorted(r["size"] for r in sizes.select("size").distinct().collect())  # at most `shingle` rows

    text = text_of(docs, text_col)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), words(text).alias("w"))

    # One array of shingles with their places; place -1 is the row that stands for the document.
    def placed(k: int) -> Column:
        return F.transform(
            shingles(F.col("w"), k), lambda s, i: F.struct(i.alias("at"), F.lit(k).alias("size"), s.alias("shingle"))
        )

    mark = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit("").alias("shingle")))
    # Counted below the explosion, so that the words themselves are not copied to each of its rows.
    counted = rows.withColumn("n_words", F.size("w"))
    each = counted.select("doc_id", "digest", "n_words", F.explode(F.concat(mark, *map(placed, short))).alias("s")).select(
        "doc_id", "digest", "n_words", "s.*"
    )
    wanted = settle(sizes.union(docs.sparkSession.range(1).select(F.lit(0).alias("size"), F.lit("").alias("shingle"))))
    hits = settle(each.join(few(wanted), ["size", "shingle"]).select("doc_id", "digest", "n_words", "at", "size", "shingle"))
    whole = hits.filter("at = -1").groupBy("doc_id", "digest", "n_words").agg(F.count("*").alias("copies"))
    found = hits.filter("at >= 0")

    rarity = found.groupBy("size", "shingle").agg(F.count("*").alias("seen"))
    # Items with equal windows share one.
    each_window = cut.select("window", "n_words", "size", "at", "shingle").distinct()
    ranked = each_window.join(rarity, ["size", "shingle"])  # a window with a shingle that no document has drops out below
    probe = ranked.groupBy("window", "n_words", "size").agg(
        F.count("*").alias("seen"), F.min(F.struct("seen", "at", "shingle")).alias("rarest"),
        F.min_by("shingle", "at").alias("first"), F.max_by("shingle", "at").alias("last"),
    )
    probe = settle(probe.filter(F.col("seen") == F.col("n_words") - F.col("size") + 1).select(
        "window", "size", "rarest.shingle", F.col("n_words").alias("length"), F.col("rarest.at").alias("offset"), "first", "last"
    ))
    start = F.col("at") - F.col("offset")
    possible = (
        found.join(few(probe), ["size", "shingle"])
        .withColumn("start", start)
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .select("doc_id", "digest", "size", "start", "length", "first", "last", "window")
    )
    place = found.select("doc_id", "digest", "size", F.col("at").alias("_at"), F.col("shingle").alias("_s")).distinct()

    def standing(df: DataFrame, at: Column, text: str) -> DataFrame:
        beside = place.alias("p")
        same = [F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("d.digest") == F.col("p.digest"), F.col("d.size") == F.col("p.size")]
        return df.alias("d").join(beside, [*same, at == F.col("p._at"), F.col(f"d.{text}") == F.col("p._s")], "left_semi")

    verified = standing(possible, F.col("d.start"), "first")
    verified = standing(verified, F.col("d.start") + F.col("d.length") - F.col("d.size"), "last")
    verified = settle(verified.select("doc_id", "digest", "start", "length", "window").distinct())
    hit = (
        verified.select("doc_id", "digest", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word"))
        .distinct()
        .groupBy("doc_id", "digest")
        .agg(F.count("*").alias("n_hit"))
    )
    named = (
        verified.select("doc_id", "digest", "window").distinct()
        .join(cut.select("window", "item_id").distinct(), "window")
        .groupBy("doc_id", "digest")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    both = hit.join(named, hit["doc_id"].eqNullSafe(named["doc_id"]) & (hit["digest"] == named["digest"])).select(
        hit["doc_id"].alias("_doc"), hit["digest"].alias("_digest"), "n_hit", "item_ids"
    )
    return whole.join(both, whole["doc_id"].eqNullSafe(F.col("_doc")) & (whole["digest"] == F.col("_digest")), "left").select(
        "doc_id", "digest", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "copies",
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of any item."""
    with passing() as keep:
        judged = contamination(docs, items, text_col=text_col)
        bad = keep(judged.filter("n_hit > 0").select("digest").distinct())
    (name,) = unused(docs, "digest")
    keyed = docs.withColumn(name, F.unhex(F.md5(text_of(docs, text_col).cast("binary"))))
    return keyed.join(few(bad), keyed[name] == bad["digest"], "left_anti").select(*docs.columns)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = contamination(docs, table(spark, sf_dir, "benchmark"))
    judged = judged.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))  # a row for each row of the table
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || (SELECT string_agg(chr(c::INT), '' ORDER BY c) FROM range(1, 128) t(c)
      WHERE NOT regexp_matches(chr(c::INT), '[0-9A-Za-z]')),
    'abcdefghijklmnopqrstuvwxyz' || repeat(' ', 65)), ' '), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, list_filter(string_split(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || (SELECT string_agg(chr(c::INT), '' ORDER BY c) FROM range(1, 128) t(c)
      WHERE NOT regexp_matches(chr(c::INT), '[0-9A-Za-z]')),
    'abcdefghijklmnopqrstuvwxyz' || repeat(' ', 65)), ' '), lambda x: x <> '') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rid, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT rid, k, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM m) GROUP BY rid),
t AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
