"""Phrase collocation mining by hierarchical pair naming.

Texts become blocks of some ``BLOCK`` bytes: the block's different words and, position by position, their numbers
in that list. Words are counted by block and added up in Spark; those found ``LEAST`` times or more get an id, which is
joined back to the blocks' lists. A block then keeps the numbers of its frequent words alone. For k = 2 up to ``longest``:

1. Two neighbouring numbers are a pair, the k-gram that starts there. Each block lists its different pairs with their counts
   and deals them, by a hash of both ids, to parts: one row for each block and part. A part adds up the counts of
   all blocks and names the pairs that are frequent; it puts out their names and, for each block, which of its pairs they are.
2. Each block replaces every position by the number of the frequent pair that starts there, or by nothing.

A named pair holds the ids of its two parents, the k-gram without its last word and the one without its first, so the
counts of all parts into which a candidate can be cut, and of all candidates within a longer one, are found by following ids. A
longer candidate is never more frequent than what it holds, so if any longer one makes a phrase redundant, one that is longer by one
word does: the phrase is one of its two parents.

A word or pair of a third of all positions is one entry of each block before anything is shuffled; the number of parts grows
with the positions, so a part holds some ``PART`` pairs. No table of names is broadcast unless Spark finds it small. Long texts are cut
into several blocks, which repeat the words after the cut as far as a phrase reaches (they start no phrase there).

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows, null and equal ids count each on
their own; ties are ordered by phrase, so the result is one; an empty table gives no rows; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import drop, passing, settle, table, text_of

LEAST = 30
LONGEST = 4
TOP = 2000
#: A candidate goes if a longer one has so many hundredths of its occurrences.
SHARE = 80
SCALE = 2_000_000
BLOCK = 12 << 20
#: Pairs that a part is meant to hold.
PART = 1 << 21

#: What ends a piece, what separates words.
ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"

_KIND = np.zeros(256, "u1")
_KIND[list(GAPS)] = 1
_KIND[list(ENDS)] = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

NONE = -1


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.view("u1").reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1").reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _parts(text: bytes, size: int, reach: int):
    """``text`` in parts of some ``size`` bytes: (bytes, end of the part's own bytes); the rest repeats what ``reach`` words after it may need."""
    at = 0
    while at < len(text):
        end = _gap(text, at + size)
        more = end
        for _ in range(reach):
            more = _gap(text, _word(text, more))
        yield text[at:more], end - at
        at = end


def _gap(text: bytes, at: int) -> int:
    """The first place from ``at`` on that is no part of a word."""
    while at < len(text) and not _KIND[text[at]]:
        at += 1
    return min(at, len(text))


def _word(text: bytes, at: int) -> int:
    """The first place from ``at`` on that is part of a word or ends a piece; after such an end, the place behind it."""
    while at < len(text) and _KIND[text[at]] == 1:
        at += 1
    return min(at + (at < len(text) and _KIND[text[at]] == 2), len(text))


def _words(data: bytes, own: list[tuple[int, int]]):
    """Words as an Arrow array, each one's place among words and piece ends, whether it stands in bytes of ``own``, and all places.

    Between two words of different pieces there is a place of no word.
    """
    raw = np.frombuffer(data, "u1")
    kind = _KIND[raw]
    inside = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    start, size = edge[:, 0], edge[:, 1] - edge[:, 0]
    offsets = np.zeros(len(start) + 1, "i4")
    np.cumsum(size, out=offsets[1:])
    letters = np.ascontiguousarray(raw[inside[1:-1]])
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    piece = np.cumsum(kind == 2, dtype="i4")[start] if len(start) else np.zeros(0, "i4")
    fresh = np.zeros(len(start), "i8")
    fresh[1:] = piece[1:] != piece[:-1]
    place = np.arange(len(start)) + np.cumsum(fresh)
    begins, ends = np.array(own, "i8").reshape(-1, 2).T
    which = np.searchsorted(begins, start, "right") - 1
    return words, place, start < ends[which], int(place[-1]) + 1 if len(place) else 0


def blocks(docs: DataFrame, size: int = BLOCK, longest: int = LONGEST) -> DataFrame:
    """``words, seq, own``: a block's different (lang, word) with their counts, and the place of each position's word in that list.

    ``seq`` (packed i4) has NONE where a piece ends; ``own`` (packed bits) tells at which positions phrases start.
    """
    word = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def block(texts: list[tuple[str, bytes, int]]):
        """A block of (lang, bytes, own bytes)."""
        lists, seqs, owns, first = [], [], [], 0
        by_lang: dict[str, list] = {}
        for lang, *rest in texts:
            by_lang.setdefault(lang, []).append(rest)
        for lang, parts in by_lang.items():
            data, own, at = [], [], 0
            for text, end in parts:
                data.append(text)
                own.append((at, at + end))
                at += len(text) + 1
            words, place, mine, places = _words(b"\n".join(data), own)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy()
            seq = np.full(places + 1, NONE, "<i4")
            seq[place] = code + first
            starts = np.zeros(places + 1, bool)
            starts[place] = mine
            n = np.bincount(code[mine], minlength=len(coded.dictionary))
            lists.append(pa.StructArray.from_arrays(
                [pa.array([lang] * len(n), pa.string()), coded.dictionary, pa.array(n, pa.int64())], fields=list(word)
            ))
            seqs.append(seq)
            owns.append(starts)
            first += len(n)
        if not lists:
            return None
        held = pa.concat_arrays(lists)
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
                pa.array([_pack(np.concatenate(seqs))], pa.binary()),
                pa.array([_pack(np.packbits(np.concatenate(owns)))], pa.binary()),
            ],
            names=["words", "seq", "own"],
        )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                text = text.as_py().encode().translate(_LOWER)
                for part, end in _parts(text, size, longest - 1) if len(text) > size else [(text, len(text))]:
                    held.append((lang, part, end))
                    n += len(part) + 1
                    if n >= size:
                        if (made := block(held)) is not None:
                            yield made
                        held, n = [], 0
        if held and (made := block(held)) is not None:
            yield made

    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und"))
    named = docs.select(lang.alias("lang"), text_of(docs, "text").alias("text"))
    cut = named.mapInArrow(run, "words array<struct<lang:string,word:string,n:long>>, seq binary, own binary")
    return cut.withColumn("block", F.monotonically_increasing_id())


class State:
    """A block's positions at one level: ``seq`` has numbers in ``ids`` or NONE, ``own`` tells at which positions phrases start."""

    def __init__(self, seq: np.ndarray, own: np.ndarray, ids: np.ndarray):
        self.seq, self.own, self.ids = seq, own, ids

    def pairs(self):
        """Where pairs start, each one's number in the list of the block's different pairs, and that list: left, right, count."""
        m = max(1, len(self.ids))
        valid = np.flatnonzero((self.seq[:-1] >= 0) & (self.seq[1:] >= 0))
        both, place = np.unique(self.seq[valid].astype("i8") * m + self.seq[valid + 1], return_inverse=True)
        count = np.bincount(place[self.own[valid]], minlength=len(both))
        return valid, place, self.ids[both // m] if len(both) else self.ids[:0], self.ids[both % m] if len(both) else self.ids[:0], count

    @classmethod
    def read(cls, row: dict) -> State:
        seq = _unpack(row["seq"], "<i4")
        own = np.unpackbits(_unpack(row["own"], "u1"), count=len(seq)).view(bool)
        return cls(seq, own, _unpack(row["ids"], "<i8") if "ids" in row else np.zeros(0, "<i8"))

    def replaced(self, at: np.ndarray, entry: np.ndarray, entries: int, code: np.ndarray, ids: np.ndarray) -> State:
        """The next level: position ``at[i]`` has entry ``entry[i]`` of a list; entries ``code`` of it are frequent and have ``ids``."""
        number = np.full(entries + 1, NONE, "<i4")
        number[code] = np.arange(len(code))
        seq = np.full(len(self.seq), NONE, "<i4")
        seq[at] = number[entry]
        return State(seq, self.own, ids)

    def table(self, block: int) -> pa.Table:
        n = int((self.seq >= 0).sum())
        row = [_pack(self.seq), _pack(np.packbits(self.own)), _pack(self.ids.astype("<i8")), n, block]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, STATE, strict=True)], schema=STATE)


STATE = pa.schema([("seq", pa.binary()), ("own", pa.binary()), ("ids", pa.binary()), ("n", pa.int64()), ("block", pa.int64())])
STATE_SQL = "seq binary, own binary, ids binary, n long, block long"


def _word_state(cut: DataFrame, frequent: DataFrame) -> DataFrame:
    """The first level; ``frequent``: ``of`` (a block), ``code`` (place in its list of words), ``id``."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return STATE.empty_table()
        row = left.to_pylist()[0]
        state = State.read(row)
        at = np.flatnonzero(state.seq >= 0)
        entries = int(state.seq.max(initial=-1)) + 1
        return state.replaced(at, state.seq[at], entries, right["code"].to_numpy(), right["id"].to_numpy()).table(row["block"])

    sides = cut.select("block", "seq", "own").groupBy("block").cogroup(frequent.groupBy("of"))
    return sides.applyInArrow(step, STATE_SQL)


def _part(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    x = left.astype("u8") * np.uint64(0x9E3779B97F4A7C15) ^ right.astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(parts)).astype("i8")


def _pair_names(state: DataFrame, parts: int, least: int) -> DataFrame:
    """``names`` (array of id, l, r, f) of a part's frequent pairs, or ``of`` (a block) with packed ``code, id`` of those it has."""

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, left, right, n = State.read(row).pairs()
                part = _part(left, right, parts)
                order = np.argsort(part, kind="stable")
                part = part[order]
                edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts)).tolist()
                for a, b in zip(edges, edges[1:], strict=False):
                    p, some = int(part[a]), order[a:b]
                    packed = [_pack(x[some].astype("<i8")) for x in (left, right, n)] + [_pack(some.astype("<i4"))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x]) for x in (p, row["block"], *packed)], names=["part", "block", "l", "r", "n", "code"]
                    )

    dealt = state.select("seq", "own", "ids", "block").mapInArrow(deal, "part long, block long, l binary, r binary, n binary, code binary")
    name = pa.struct([("id", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("f", pa.int64())])
    schema = pa.schema([("names", pa.list_(name)), ("of", pa.int64()), ("code", pa.binary()), ("id", pa.binary())])

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        part = rows[0]["part"]
        left, right, n = (np.concatenate([_unpack(x[c], "<i8") for x in rows]) for c in ("l", "r", "n"))
        order = np.lexsort((right, left))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
        first = np.flatnonzero(fresh)
        total = np.add.reduceat(n[order], first)
        keep = total >= least
        ids = np.where(keep, (part << 36) + np.cumsum(keep) - 1, NONE)
        own = np.empty(len(order), "i8")
        own[order] = ids[np.cumsum(fresh) - 1]
        one = order[first[keep]]
        names = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (ids[keep], left[one], right[one], total[keep])], fields=list(name))
        out = [([x.as_py() for x in names], None, None, None)] if len(names) else []
        at = 0
        for row in rows:
            code = _unpack(row["code"], "<i4")
            mine = own[at : at + len(code)]
            at += len(code)
            if (mine >= 0).any():
                out.append((None, row["block"], _pack(code[mine >= 0]), _pack(mine[mine >= 0].astype("<i8"))))
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return dealt.groupBy("part").applyInArrow(count, "names array<struct<id:long,l:long,r:long,f:long>>, of long, code binary, id binary")


def _pair_state(state: DataFrame, frequent: DataFrame) -> DataFrame:
    """The next level; ``frequent``: ``of`` (a block), packed ``code`` (places in its list of pairs) and ``id``."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return STATE.empty_table()
        row, found = left.to_pylist()[0], right.to_pylist()
        state = State.read(row)
        at, entry, pairs, _, _ = state.pairs()
        code = np.concatenate([_unpack(x["code"], "<i4") for x in found] or [np.zeros(0, "<i4")])
        ids = np.concatenate([_unpack(x["id"], "<i8") for x in found] or [np.zeros(0, "<i8")])
        return state.replaced(at, entry, len(pairs), code, ids).table(row["block"])

    sides = state.select("seq", "own", "ids", "block").groupBy("block").cogroup(frequent.groupBy("of"))
    return sides.applyInArrow(step, STATE_SQL)


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = BLOCK, pairs: int = PART) -> DataFrame:
    """``lang, words, a, firsts, lasts, inside, n``: each phrase of 2 to ``longest`` words found ``least`` times or more.

    ``firsts`` and ``lasts`` have the counts of its first and last 1, 2, ... words (the last is its own), ``inside`` the greatest
    count of a candidate longer by one word that holds it (null: none), ``n`` the words of its language.
    """
    with passing() as keep:
        cut = settle(blocks(docs, size, longest))
        single = cut.select(F.inline("words"))
        counted = single.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        words = settle(counted.withColumn("id", F.monotonically_increasing_id()))  # read from the written table only
        total = settle(single.groupBy("lang").agg(F.sum("n").alias("n")))
        listed = cut.select(F.col("block").alias("of"), F.posexplode("words").alias("code", "x"))
        listed = listed.select("of", "code", F.col("x.lang").alias("lang"), F.col("x.word").alias("word"))
        state = settle(_word_state(cut, listed.join(words.select("lang", "word", "id"), ["lang", "word"]).select("of", "code", "id")))
        drop(cut)
        grams = words.select("id", "lang", F.array("word").alias("words"), F.array("f").alias("firsts"), F.array("f").alias("lasts"))
        levels = []
        for k in range(2, longest + 1):
            held = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            named = settle(_pair_names(state, max(8, -(-held // pairs)), least))
            if k < longest:
                before, state = state, settle(_pair_state(state, named.filter("of IS NOT NULL").select("of", "code", "id")))
                drop(before)
            names = settle(named.filter("of IS NULL").select(F.inline("names")))
            drop(named)
            # A pair's parents give the counts of its parts.
            left = grams.select(F.col("id").alias("l"), "lang", "words", "firsts")
            right = grams.select(F.col("id").alias("r"), F.element_at("words", -1).alias("last"), "lasts")
            grams = settle(names.join(left, "l").join(right, "r").select(
                "id", "lang", F.concat("words", F.array("last")).alias("words"), F.concat("firsts", F.array("f")).alias("firsts"),
                F.concat("lasts", F.array("f")).alias("lasts"),
            ))
            holders = names.select(F.explode(F.array("l", "r")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("inside"))
            if k > 2:
                levels[-1] = levels[-1].join(holders, "id", "left")
            levels.append(grams)
        levels[-1] = levels[-1].withColumn("inside", F.lit(None).cast("long"))
        found = levels[0]
        for more in levels[1:]:
            found = found.unionByName(more)
        # Languages are few beside phrases.
        found = found.withColumn("a", F.element_at("firsts", -1)).join(total, "lang").drop("id")
        return keep(found)


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def rank(found: DataFrame, top: int = TOP, share: int = SHARE, scale: int = SCALE) -> DataFrame:
    """The best ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``. Products are decimals and quotients whole, so nothing is rounded."""
    a = F.col("a")
    kept = found.filter(F.col("inside").isNull() | (F.lit(100) * _exact(F.col("inside")) < F.lit(share) * _exact(a)))
    parts = F.transform(
        F.slice("firsts", 1, F.size("firsts") - 1), lambda f, k: F.struct(f.alias("l"), F.get("lasts", F.size("lasts") - 2 - k).alias("r"))
    )
    score = lambda x: F.call_function("div", F.lit(scale) * _exact(a), _exact(x["l"]) + _exact(x["r"]))
    cut = F.array_min(F.transform(parts, lambda x, k: F.struct(score(x).alias("score"), k.alias("k"), x["l"].alias("l"), x["r"].alias("r"))))
    scored = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", cut.alias("cut"), "n")
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each part of a language first, so a language never meets as a whole.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return rank(phrases(table(spark, sf_dir, "documents")))


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9),
      'abcdefghijklmnopqrstuvwxyz.........' || ' '), '.') AS pieces FROM documents),
p AS (SELECT d, lang, generate_subscripts(pieces, 1) AS p, unnest(pieces) AS piece FROM d),
s AS (SELECT d, lang, p, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM p),
w AS MATERIALIZED (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM (SELECT d, lang, p, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM s) WINDOW o AS (PARTITION BY d, p ORDER BY i)),
t AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, [w1] AS ws, count(*) AS f FROM w GROUP BY lang, w1
  UNION ALL SELECT lang, [w1, w2], count(*) FROM w WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM w WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM w WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, ws, f AS a FROM f WHERE len(ws) >= 2),
k AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM c),
v AS (
  SELECT c.lang, c.ws, c.a, c.k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM k c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:c.k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[c.k + 1:len(c.ws)]),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
u AS (
  SELECT lang, ws[i:i + m - 1] AS ws, max(a) AS longer
  FROM (SELECT lang, ws, a, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(ws))) AS m FROM c)) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN u ON u.lang = b.lang AND u.ws = b.ws WHERE u.longer IS NULL OR 100::HUGEINT * u.longer < {SHARE}::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank,
  array_to_string(ws, ' ') AS phrase, a, l, r, n, score
FROM o JOIN t USING (lang) QUALIFY rank <= {TOP}
"""
