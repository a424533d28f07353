r"""Personal data: patterns for what is personal by form, co-occurrence for what reveals it.

Four kinds are found by form (e-mail addresses, IP addresses, card numbers, phone numbers). Each
distinct value found is a protected entity. Around an entity's occurrences (``NEAR`` words on either side) other
terms may give it away: the pointwise mutual information of a term and an entity, estimated over
all documents, says how many bits of the entity's own information the term carries:

    PMI(t; e) = log2(N * n(t near e) / (n(t) * n(e)))      IC(e) = log2(N / n(e))

with N, n(e), n(t) and n(t near e) numbers of documents, without smoothing or a least number of documents. A term with
PMI >= ``DISCLOSE`` * IC is a span of its own where it stands near the entity; so for an entity of one document any term
in up to N ** (1 - DISCLOSE) documents is one. An entity of all documents has no information to disclose. Sanitising
replaces the four kinds by placeholders, removes terms over ``REMOVE`` * IC and generalises the others to a class of words of like length (``CLASSES``). A class
that n(c) documents get carries log2(N / n(c)) bits of any entity at most; where that is no less than ``DISCLOSE`` * IC, as
the class is too rare, the term is removed as well. So nothing that stands in a term's place discloses what the term did.

Terms are letter sequences of at least three letters, lower-cased. Only documents with an entity send rows on;
term counts are summed per worker before they are shuffled. A hot entity meets as sums.

Defined results: null texts are empty and stay null; offsets are code points; rows that repeat wholly give equal rows; equal or null
ids with other texts are documents of their own; a long text is searched whole, in time that grows with its length
and its entities; an empty table gives no rows; ``find`` drops other columns, ``sanitise`` keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import few, passing, settle, table, text_of, unused

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 8
DISCLOSE = 0.8
REMOVE = 0.95
#: What terms of up to so many letters become.
CLASSES = ((5, "[SHORT WORD]"), (8, "[WORD]"), (None, "[LONG WORD]"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits are taken whole: a match cannot start inside one that fails at its start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

ENTITIES = "doc_id long, digest string, entity string"


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            free = tail.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of personal data by form, in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(kind: int, value: str) -> str:
    plain = value.lower() if kind == 0 else value if kind == 1 else "".join(c for c in value if c.isdigit())
    return f"{KINDS[kind]}:{plain}"


def near_terms(text: str, spans: list[tuple[int, int, int]], near: int = NEAR) -> dict[str, list[tuple[str, int, int]]]:
    """For each entity of a text the terms beside its occurrences, with their places."""
    taken: list[list[int]] = []
    for s, _, e in spans:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    opened = [s for s, _ in taken]
    words = [m.span() for m in _TERM.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    found: dict[str, dict] = {}
    for start, kind, end in spans:
        # A word that an entity cuts counts with the letters that are left, if these are enough.
        k, j = bisect_left(starts, start), bisect_right(ends, end)
        before = [(s, min(e, start)) for s, e in words[max(0, k - near - 1) : k]]
        after = [(max(s, end), e) for s, e in words[j : j + near + 1]]
        before, after = ([(s, e) for s, e in side if e - s >= 3] for side in (before, after))
        held = found.setdefault(_entity(kind, text[start:end]), {})
        for s, e in before[-near:] + after[:near]:
            t = bisect_left(opened, e) - 1
            if t < 0 or taken[t][1] <= s:
                held[s] = (text[s:e].lower(), s, e)
    return {k: list(v.values()) for k, v in found.items()}


def _named(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))


def _digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def _find(near: int):
    term = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            digests, spans, terms, entities = [], [], [], []
            for text in batch["text"].to_pylist():
                base = base_spans(text)
                beside = near_terms(text, base, near) if base else {}
                digests.append(_digest(text))
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                terms.append([{"entity": x, "term": t, "start": s, "end": e} for x, ts in beside.items() for t, s, e in ts])
                entities.append(list(beside))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(digests), pa.array(spans, pa.list_(span)), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(term))],
                names=["doc_id", "digest", "spans", "entities", "terms"],
            )

    return run


FOUND = (
    "doc_id long, digest string, spans array<struct<start:bigint,kind:int,end:bigint>>, entities array<string>, "
    "terms array<struct<entity:string,term:string,start:bigint,end:bigint>>"
)


def _count_terms(most: int = 200_000):
    """Documents per term, summed over what a worker reads until ``most`` terms are held."""

    def run(batches):
        held: dict[str, int] = {}

        def put():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch["text"].to_pylist():
                for t in {w.lower() for w in _TERM.findall(text)}:
                    held[t] = held.get(t, 0) + 1
                if len(held) > most:
                    yield put()
                    held = {}
        if held:
            yield put()

    return run


def find(docs: DataFrame, near: int = NEAR, disclose: float = DISCLOSE, text_col: str = "text") -> DataFrame:
    """``doc_id, digest, spans, terms`` per row: personal data by form, and the terms that reveal it, with their share of its information
    and that information in bits (of several entities the greatest share and the fewest bits)."""
    with passing() as keep:
        named = _named(docs, text_col)
        found = keep(named.mapInArrow(_find(near), FOUND))
        total = found.agg(F.count("*").alias("n_all"))  # one row
        pairs = found.select(F.explode(F.array_distinct(F.transform("terms", lambda x: F.struct(x["entity"], x["term"])))).alias("x"))
        joint = settle(pairs.groupBy("x.entity", "x.term").agg(F.count("*").alias("n_both")))
        entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
        # Summed before any join: a join with the terms beside an entity gives a row for each of them and each task, and both grow with the input.
        terms = named.mapInArrow(_count_terms(), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
        known = joint.join(entities, "entity").join(terms, "term").join(F.broadcast(total)).filter("n_entity < n_all")
        pmi = F.log2(F.col("n_all") * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
        share = pmi / F.log2(F.col("n_all") / F.col("n_entity"))
        bits = F.log2(F.col("n_all") / F.col("n_entity"))
        telling = settle(known.select("entity", "term", share.alias("share"), bits.alias("bits")).filter(F.col("share") >= disclose))
        # A text's terms are the same in all its copies, so they go by its digest.
        places = found.select("digest", F.explode("terms").alias("x")).select("digest", "x.*").join(telling, ["entity", "term"])
        shown = keep(
            places.groupBy("digest", "start", "end").agg(F.max("share").alias("share"), F.min("bits").alias("bits"))
            .groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end", "share", "bits"))).alias("told"))
            .select(F.col("digest").alias("_digest"), "told")
        )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,share:double,bits:double>>")
    told = found.join(shown, F.col("digest") == F.col("_digest"), "left")
    return told.select("doc_id", "digest", "spans", F.coalesce("told", empty).alias("terms"))


def _class(size: Column) -> Column:
    """The number of the class of terms of ``size`` letters."""
    number = F.lit(len(CLASSES) - 1)
    for i in range(len(CLASSES) - 2, -1, -1):
        number = F.when(size <= CLASSES[i][0], i).otherwise(number)
    return number


def sanitise(docs: DataFrame, remove: float = REMOVE, disclose: float = DISCLOSE, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with personal data replaced by placeholders such as ``[EMAIL]``, revealing terms by their class or nothing."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    with passing() as keep:
        found = find(docs, disclose=disclose, text_col=text_col, **options)
        told = settle(found.filter((F.size("spans") > 0) | (F.size("terms") > 0)).dropDuplicates(["digest"]).select("digest", "spans", "terms"))
        n_all = docs.count()
        # A row for each class; texts with copies count once, which makes a class seem rarer than it is.
        general = told.select("digest", F.explode("terms").alias("t")).filter(F.col("t.share") < remove)
        kinds = general.select("digest", _class(F.col("t.end") - F.col("t.start")).alias("class")).distinct()
        held = {r["class"]: math.log2(n_all / r["n"]) for r in kinds.groupBy("class").agg(F.count("*").alias("n")).collect()}

        def mark(t: Column) -> Column:
            number, out = _class(t["end"] - t["start"]), F.lit("")
            for i, bits in held.items():
                out = F.when((number == i) & (F.lit(bits) < disclose * t["bits"]), CLASSES[i][1]).otherwise(out)
            return F.when(t["share"] >= remove, "").otherwise(out)

        cut = F.concat(
            F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(marks, s["kind"] + 1).alias("mark"))),
            F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), mark(t).alias("mark"))),
        )
        told = keep(told.select("digest", F.sort_array(cut).alias("cut")))
    digest, cuts = unused(docs, "digest", "cut")
    keyed = docs.withColumn(digest, F.md5(text_of(docs, text_col).cast("binary")))
    joined = keyed.join(few(told).select(F.col("digest").alias(f"{digest}_told"), F.col("cut").alias(cuts)), F.col(digest) == F.col(f"{digest}_told"), "left")
    text = F.col(f"`{text_col}`")
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        # Where spans overlap the later one only adds its mark.
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], s["start"]), s["mark"])).alias("out")
        )

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), piece(acc["at"], F.length(text).cast("long")))
    clean = F.when(F.col(cuts).isNotNull(), F.aggregate(cuts, start, step, rest)).otherwise(text)
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end")))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(told(F.col("spans")), 256).alias("base_sha256"),
        told(F.sort_array(F.concat("spans", terms))).alias("spans"),
    )
