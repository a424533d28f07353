r"""Chat formatting in budgeted windows, as DataFrame expressions.

A turn is written ``### role: text</turn>`` and a line feed. Inside texts and roles ``\`` becomes
``\\``, ``#`` becomes ``\#`` and ``</turn>`` becomes ``<\/turn>`` (in roles also ``:`` becomes
``\:``), so no control string can stand inside one, and dropping each escaping backslash restores the text.

Windows come from prefix sums of the turns' token estimates. The prefix axis of a conversation
is ruled in strides; a turn belongs to the span of the stride it starts in, and one that runs over the stride's
end by more than the slack is a span of its own. Spans are thus whole turns and need no walk along
the conversation: each turn finds its span alone. A window is a span after the first system turn and as many
of the turns before the span as fit the history allowance. Repeated turns are not under the
loss mask; each assistant text is, in the one window whose span holds it.

    stride + slack + history + system turn <= budget

Only a single turn longer than stride and slack, or a system turn over half the budget, goes over it.

Prefix sums are taken in blocks of turn numbers and the blocks' totals are added, so a conversation that
holds a third of all turns is spread out. Spans, system turns and history are chosen on rows of numbers; heads and bodies
are fetched once for the turns of each window. Defined results: null roles and texts are empty; turns are ordered by number (null
first), then role, then text; repeated rows are turns of their own; rows without conversation id
form one; a turn is never cut, however long its text; other columns, whatever their names, are dropped; an empty table has no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import passing, settle, table

BUDGET = 2048
LOSS_ROLE = "assistant"
SYSTEM_ROLE = "system"
BLOCK_TURNS = 256

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """Estimated tokens of a turn: one for four bytes, and four for its marks."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


#: A conversation: its id (0 where it has none) and whether it has none.
CONVERSATION = ["conv", "none"]


def _turns(rows: DataFrame, budget: int, loss_role: str, block_turns: int) -> tuple[DataFrame, DataFrame]:
    """Each turn by conversation and place ``pos``: its ``head`` and ``body``, and in numbers alone its token range ``c0 c1``,
    its span, whether its text is masked, and the place of the conversation's system turn."""
    text = lambda c: F.coalesce(rows[c].cast("string"), F.lit(""))
    conv, turn = rows["conv_id"].cast("long"), rows["turn"].cast("long")
    turns = rows.select(
        F.coalesce(conv, F.lit(0)).alias("conv"), conv.isNull().alias("none"), turn.alias("turn"),
        text("role").alias("role"), text("text").alias("text"),
        F.coalesce(F.floor(turn / block_turns), F.lit(-(1 << 62))).alias("block"),
    )
    cut = turns.withColumns({
        "head": F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(MIDDLE)),
        "body": escape(F.col("text")),
        "tok": tokens(F.col("text")),
    }).drop("text")
    inside = Window.partitionBy(*CONVERSATION, "block").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    ranked = cut.withColumns({"pos": F.row_number().over(inside), "c1": F.sum("tok").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    sizes = cut.groupBy(*CONVERSATION, "block").agg(F.sum("tok").alias("tok"), F.count("*").alias("n"))
    along = Window.partitionBy(*CONVERSATION).orderBy("block")
    before = sizes.select(
        *CONVERSATION, "block", (F.sum("tok").over(along) - F.col("tok")).alias("_tok"), (F.sum("n").over(along) - F.col("n")).alias("_n")
    )
    placed = settle(ranked.join(before, [*CONVERSATION, "block"]).select(
        *CONVERSATION, (F.col("pos") + F.col("_n")).alias("pos"), (F.col("c1") + F.col("_tok")).alias("c1"), "tok", "role", "head", "body"
    ))
    system = settle(
        placed.filter(F.col("role") == SYSTEM_ROLE)
        .groupBy(*CONVERSATION)
        .agg(F.min(F.struct("pos", "tok")).alias("system"))
    )
    known = placed.select(
        *CONVERSATION, "pos", (F.col("c1") - F.col("tok")).alias("c0"), "c1", (F.col("role") != loss_role).cast("int").alias("masked")
    ).join(system, CONVERSATION, "left")
    stride = F.greatest(
        F.lit(budget - budget // 4 - budget // 8) - F.coalesce(F.col("system.tok"), F.lit(0)), F.lit(budget // 8)
    ).cast("long")
    start, end = F.expr("c0 div stride"), F.expr("(c1 - 1) div stride")
    over = (start != end) & (F.col("c1") - (start + 1) * F.col("stride") > budget // 4)
    spanned = known.withColumn("stride", stride).withColumn("span", start * 2 + over.cast("long"))
    return placed.select(*CONVERSATION, "pos", "head", "body"), spanned.select(*CONVERSATION, "pos", "c0", "c1", "masked", "span", F.col("system.pos").alias("spos"))


def windows(
    rows: DataFrame, budget: int = BUDGET, loss_role: str = LOSS_ROLE, block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """``conv_id, window, n_repeated, n_new, formatted, loss``: the mask as ranges of code points, end exclusive."""
    with passing() as keep:
        return keep(_windows(rows, budget, loss_role, block_turns))


def _windows(rows: DataFrame, budget: int, loss_role: str, block_turns: int) -> DataFrame:
    history, span = budget // 8, [*CONVERSATION, "span"]
    placed, turns = _turns(rows, budget, loss_role, block_turns)
    turns = settle(turns)
    spans = settle(turns.groupBy(*span).agg(F.min("c0").alias("from"), F.min("pos").alias("first"), F.max("spos").alias("spos")))
    own = turns.select(*span, "pos", F.col("masked").alias("repeated"), F.lit(1).alias("new"))
    # A stride is at least as long as the history, so history reaches back four spans at most.
    near = turns.filter(F.col("pos") != F.coalesce("spos", F.lit(-1))).select(
        *CONVERSATION, F.explode(F.sequence(F.col("span") + 1, F.col("span") + 4)).alias("span"), "c0", "c1", "pos"
    )
    past = near.join(spans.select(*span, "from"), span).filter((F.col("c1") <= F.col("from")) & (F.col("c0") >= F.col("from") - history))
    repeated = past.select(*span, "pos", F.lit(2).alias("repeated"), F.lit(0).alias("new"))
    system = spans.filter(F.col("spos") < F.col("first")).select(*span, F.col("spos").alias("pos"), F.lit(2).alias("repeated"), F.lit(0).alias("new"))
    chosen = own.union(repeated).union(system).join(placed, [*CONVERSATION, "pos"])
    joined = chosen.groupBy(*span).agg(
        F.sort_array(F.collect_list(F.struct("pos", "repeated", "head", "body"))).alias("items"), F.sum("new").alias("n_new")
    )
    line = lambda x: F.concat(x["head"], x["body"], F.lit(TAIL))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["head"])
        end = at + F.length(x["body"])
        mark = F.array(F.struct(at.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            (end + len(TAIL)).cast("long").alias("at"),
            F.when(x["repeated"] == 0, F.concat(acc["loss"], mark)).otherwise(acc["loss"]).alias("loss"),
        )

    walk = F.aggregate("items", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("loss")), step, lambda acc: acc["loss"])
    return joined.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), F.col("span").alias("window"),
        (F.size("items") - F.col("n_new")).alias("n_repeated"), "n_new",
        F.array_join(F.transform("items", line), "").alias("formatted"), walk.alias("loss"),
    )


def read_back(written: DataFrame) -> DataFrame:
    """Per window, from its text and mask alone: the new ``turns`` (role, text) and the ``loss_text``."""
    lines = F.split("formatted", TAIL)
    new = F.slice(lines, F.col("n_repeated").cast("int") + 1, F.col("n_new").cast("int"))
    role = lambda x: F.substring_index(x, MIDDLE, 1)
    turn = F.transform(
        new,
        lambda x: F.struct(
            unescape(F.substring(role(x), len(HEAD) + 1, 1 << 30)).alias("role"),
            unescape(F.substring(x, F.length(role(x)) + len(MIDDLE) + 1, F.length(x))).alias("text"),
        ),
    )
    marked = F.transform(
        "loss", lambda m: F.substring("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
    )
    return written.select(
        "conv_id", "window", F.length("formatted").alias("formatted_chars"), turn.alias("turns"),
        unescape(F.array_join(marked, "")).alias("loss_text"),
    )


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(windows(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select(
        "conv_id", "formatted_chars", F.size("turns").alias("n"), F.length("loss_text").alias("loss_chars"),
        F.struct("window", told.alias("told"), "loss_text").alias("part"),
    )
    # A digest over a whole conversation needs its text in one row; nothing else does.
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("loss_chars").alias("loss_chars"), F.sum("formatted_chars").alias("formatted_chars"),
    )
    digest = lambda field: F.sha2(F.array_join(F.transform("parts", lambda p: p[field]), ""), 256)
    return whole.select(
        "conv_id", "n_turns", digest("told").alias("turns_sha256"), "loss_chars",
        digest("loss_text").alias("loss_sha256"), "formatted_chars",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS body,
    ceil(strlen(text) / 4)::BIGINT + 4 AS tok FROM t),
p AS (
  SELECT *, length('### ') + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:'))
      + 2 + length(body) + 8 AS chars,
    row_number() OVER w AS pos, sum(tok) OVER w::BIGINT AS c1 FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING)),
s AS (SELECT conv_id, min(pos) AS spos, arg_min(tok, pos) AS stok, arg_min(chars, pos) AS schars FROM p WHERE role = 'system' GROUP BY conv_id),
q AS (SELECT p.*, c1 - tok AS c0, spos, schars, greatest(1280 - coalesce(stok, 0), 256) AS stride FROM p LEFT JOIN s USING (conv_id)),
r AS (SELECT *, (c0 // stride) * 2 + CASE WHEN c0 // stride <> (c1 - 1) // stride AND c1 - (c0 // stride + 1) * stride > 512 THEN 1 ELSE 0 END AS span FROM q),
spans AS (SELECT conv_id, span, min(c0) AS f, min(pos) AS first, any_value(spos) AS spos, any_value(schars) AS schars FROM r GROUP BY ALL),
past AS (
  SELECT a.conv_id, sum(b.chars) AS chars FROM spans a JOIN r b ON a.conv_id = b.conv_id AND b.c1 <= a.f AND b.c0 >= a.f - 256
    AND b.pos <> coalesce(b.spos, -1) GROUP BY 1),
sys AS (SELECT conv_id, sum(schars) AS chars FROM spans WHERE spos < first GROUP BY 1),
own AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
  (own.chars + coalesce(past.chars, 0) + coalesce(sys.chars, 0))::BIGINT AS formatted_chars
FROM own LEFT JOIN past USING (conv_id) LEFT JOIN sys USING (conv_id)
"""
