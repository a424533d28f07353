"""SimHash near-duplicates by a self-join of binary tries over the fingerprints.

A fingerprint has 64 binary digits, each the majority of that digit in the XXH64 hashes of a text's word
shingles. Equal fingerprints are one class before anything else, so exact copies never meet. To find
classes within ``budget`` digits the digits are parted into ``budget + 1`` stretches; two such fingerprints
agree wholly on one of them. There is one trie per stretch, with that stretch at its top, and its self-join
starts from the pairs (node, same node) below it.

The join walks pairs of nodes together: a pair's children are paired, differing digits add up and a
pair over the budget is dropped. While a node holds more than ``leaf`` fingerprints the walk is a Spark
join of node tables (nodes and counts, never their fingerprints), so a node that holds a third of all
fingerprints becomes many pairs of small ones; a node of one key with many ids is dealt out to blocks by a hash
of the id. Each remaining pair is one unit of at most ``2 * leaf`` rows, walked to its end in one task; there, pairs of nodes that are already one component are
skipped and only the links that join components are put out. Components then settle across units.

``keep_one`` judges likeness, not digits of one fingerprint: at a Jaccard similarity of 0.8 two texts differ in
10 of 64 digits on average, and a budget that wide prunes nothing. It takes ``WORDS`` fingerprints side by side,
each from the hashes of the different shingles mixed anew (repeats don't count, as in the Jaccard similarity). Two texts are candidates if some fifth of some word is equal, that word
differs in at most ``WORD_BUDGET`` digits and all words together in at most ``WIDE_BUDGET``. There is one trie per
word and fifth, joined as above. Each link that the walk puts out is a pair of candidates, and links only if the
sets of the two texts' shingles have a Jaccard similarity of ``LIKENESS`` or more. A walk joins rows by links not yet
judged and skips pairs that hang together already, so a link that fails may have hidden others. Each such link has
a failed one at the edge of the group of either end: all groups with a failed link are walked again, from the groups
found so far and without the pairs that failed, until a walk finds nothing new.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows, equal
ids and null ids are documents of their own (a component without any id has a null one); long texts are hashed whole; an empty table
gives no rows; other columns are dropped, but for ``keep_one``, which keeps them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import few, forgetting, passing, settle, table, text_of, texts_at_once, unused
from heddle.llm.components import components

BITS = 64
SHINGLE = 4
BUDGET = 4
LEAF = 2048
#: Likeness of 0.8 in word shingles: fingerprints side by side, differing digits in one and in all of them.
WORDS = 6
WORD_BUDGET = 20
WIDE_BUDGET = 70
WIDE_LEAF = 4096
#: Jaccard similarity of the shingle sets from which two texts are near-duplicates.
LIKENESS = 0.8
#: Pairs for each row of a unit that a second or later walk puts out before it joins rows by them, so that few walks do.
SPARE = 4
#: Digits by which the walk in Spark goes down at once.
STEP = 3
#: Units of up to so many rows are compared side by side with others.
DENSE = 64


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (u64) of each word shingle, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return np.zeros(0, "u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text; no words: zero."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(BITS, "i8")
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def wide_fingerprint(text: str, shingle: int, words: int = WORDS) -> bytes:
    """``words`` fingerprints in a row, 8 bytes each, from independent mixes of the different shingle hashes; no words: zeros."""
    return _wide(shingle_set(text, shingle), words)


def _wide(hashes: np.ndarray, words: int) -> bytes:
    counts = np.zeros(BITS * words, "i8")
    for at in range(0, len(hashes), 255 * 16):
        mixed = hashes[at : at + 255 * 16, None] + np.arange(words, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(mixed.view("u1"), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # up to 255 ones fit a byte
            counts += bits[part : part + 255].sum(0, dtype="u1")
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame, shingle: int, words: int = WORDS, text_col: str = "text") -> DataFrame:
    """``doc_id, row, id, more, wide`` of each row: ``row`` a digest of its id and text, ``id`` and ``more`` 64 bits each of a hash of its set of shingles."""

    def run(batches):
        import xxhash

        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["text"].to_pylist()]
            found = [_wide(x, words) for x in sets]
            both = b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets)
            halves = np.frombuffer(both, "<i8").reshape(-1, 2)
            columns = [batch["doc_id"], batch["row"], pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "id", "more", "wide"])

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _row_key(docs, text_col).alias("row"), text_of(docs, text_col).alias("text"))
    return named.mapInArrow(forgetting(run), "doc_id long, row binary, id long, more long, wide binary")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint's digits as a signed long."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], names=["doc_id", "fp"])

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return named.mapInArrow(forgetting(run), "doc_id long, fp long")


def stretches(budget: int) -> list[tuple[int, int]]:
    """(first digit, digits) of each of the ``budget + 1`` stretches, from the top."""
    edges = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _rotated(fp: Column, by: int) -> Column:
    if not by:
        return fp
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _top(key: Column, depth: Column | int) -> Column:
    """The first ``depth`` (1 to 64) digits of a key as a number."""
    return F.call_function("shiftrightunsigned", key, (F.lit(BITS) - depth).cast("int"))


def tries(fps: DataFrame, budget: int) -> DataFrame:
    """``trie, key, top, id`` of each fingerprint in each trie; ``top`` digits of the key are the trie's stretch."""
    cut = [F.struct(F.lit(t).alias("trie"), _rotated(F.col("fp"), a).alias("key"), F.lit(n).alias("top")) for t, (a, n) in enumerate(stretches(budget))]
    return settle(fps.select(F.col("fp").alias("id"), F.explode(F.array(*cut)).alias("x")).select("x.*", "id"))


def wide_tries(classes: DataFrame, words: int = WORDS) -> DataFrame:
    """``trie, key, top`` and the columns of ``classes``: a trie for each fifth of each word."""
    cut = []
    for w in range(words):
        word = F.conv(F.hex(F.substring("wide", 8 * w + 1, 8)), 16, -10).cast("long")  # any fixed order of digits will do
        for a, n in stretches(4):
            cut.append(F.struct(F.lit(len(cut)).alias("trie"), _rotated(word, a).alias("key"), F.lit(n).alias("top")))
    return classes.select(*classes.columns, F.explode(F.array(*cut)).alias("x")).select("x.*", *classes.columns)


def crowds(leaves: DataFrame, leaf: int) -> DataFrame:
    """The tops of more than ``leaf`` leaves (``trie, depth, a, n``); there is at most one for each ``leaf`` rows."""
    node = _top(F.col("key"), F.col("top"))
    return settle(leaves.groupBy("trie", F.col("top").alias("depth"), node.alias("a")).agg(F.count("*").alias("n")).filter(F.col("n") > leaf))


def units(leaves: DataFrame, tops: DataFrame, budget: int, leaf: int) -> DataFrame:
    """The pairs that remain below crowded ``tops`` (``trie, depth, a, b, differ`` and ``parts`` and ``block`` of each side).

    A node of more than ``leaf`` leaves that has used up all digits (many ids with one key) is dealt out to ``parts``
    blocks by a hash of the id, half of ``leaf`` each on average, and its blocks are paired. Other nodes are one block.
    """
    keep = ["trie", "depth", "a", "b", "differ"]
    open_ = tops.select("trie", "depth", "a", F.col("a").alias("b"), F.lit(0).alias("differ"))
    pairs = settle(open_.withColumns({"n_a": F.lit(0).cast("long"), "n_b": F.lit(0).cast("long")}).limit(0))
    while not open_.isEmpty():
        heads = open_.select("trie", "depth", "a").union(open_.select("trie", "depth", "b")).distinct()
        down = F.least(F.col("depth") + STEP, F.lit(BITS))
        # The children of the nodes that are still too large, and how many fingerprints they hold.
        depths = [r[0] for r in heads.select("depth").distinct().collect()]  # a few numbers up to 64
        nodes = None
        for d in depths:
            below = min(d + STEP, BITS)
            some = leaves.select("trie", "key", _top(F.col("key"), d).alias("a")).join(heads.filter(F.col("depth") == d), ["trie", "a"], "left_semi")
            counted = some.groupBy("trie", F.col("a").alias("parent"), _top(F.col("key"), below).alias("node")).agg(F.count("*").alias("n"))
            counted = counted.withColumn("depth", F.lit(d))
            nodes = counted if nodes is None else nodes.union(counted)
        nodes = settle(nodes)
        left = nodes.select("trie", "depth", F.col("parent").alias("a"), F.col("node").alias("na"), F.col("n").alias("n_a"))
        right = nodes.select("trie", "depth", F.col("parent").alias("b"), F.col("node").alias("nb"), F.col("n").alias("n_b"))
        paired = open_.join(left, ["trie", "depth", "a"]).join(right, ["trie", "depth", "b"]).filter("a < b OR na <= nb")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), (down - F.col("depth")).cast("int")) - 1  # the new digits
        differ = F.col("differ") + F.bit_count(F.col("na").bitwiseXOR(F.col("nb")).bitwiseAND(mask)).cast("int")
        paired = paired.withColumn("differ", differ).filter(F.col("differ") <= budget)
        paired = paired.filter("na <> nb OR n_a > 1").withColumn("depth", down)
        grown = settle(paired.select("trie", "depth", F.col("na").alias("a"), F.col("nb").alias("b"), "differ", "n_a", "n_b"))
        small = (F.col("n_a") <= leaf) & (F.col("n_b") <= leaf) | (F.col("depth") == BITS)
        pairs = pairs.union(grown.filter(small).select(*keep, "n_a", "n_b"))
        open_ = grown.filter(~small).select(*keep)
    parts = lambda n: F.when(F.col(n) > leaf, F.ceil(2 * F.col(n) / leaf)).otherwise(1).cast("int")
    dealt = pairs.select("trie", "depth", "a", "b", "differ", parts("n_a").alias("parts_a"), parts("n_b").alias("parts_b"))
    dealt = dealt.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
    least = F.when(F.col("a") == F.col("b"), F.col("block_a")).otherwise(0)
    return settle(dealt.withColumn("block_b", F.explode(F.sequence(least, F.col("parts_b") - 1))))


#: What tells one unit below a crowded top from another.
UNIT = ["trie", "depth", "a", "b", "block_a", "block_b"]


def unit_rows(leaves: DataFrame, pairs: DataFrame) -> DataFrame:
    """The leaves of each of the ``pairs``: the columns of ``UNIT`` and ``side, differ, id, key`` and ``wide, root, barred`` as far as given."""
    also = [c for c in ("wide", "root", "barred") if c in leaves.columns]
    alone = (F.col("a") == F.col("b")) & (F.col("block_a") == F.col("block_b"))
    one = pairs.withColumn("alone", alone)
    end = lambda x, side: one.filter(f"NOT alone OR {side} = 0").select(
        *UNIT, F.col(x).alias("node"), F.col(f"parts_{x}").alias("parts"), F.col(f"block_{x}").alias("block"), "differ", F.lit(side).alias("side")
    )
    ends = end("a", 0).union(end("b", 1))
    depths = sorted(r[0] for r in pairs.select("depth").distinct().collect())  # a few numbers up to 64
    deep = F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")).alias("depth")
    each = leaves.select("trie", "key", "top", "id", *also, deep).filter("depth >= top")
    each, place = each.withColumn("node", _top(F.col("key"), F.col("depth"))), ["trie", "depth", "node"]
    parted = ends.filter("parts > 1").select(*place, "parts").distinct()
    if not parted.isEmpty():  # nodes of one key each; there is at most one for each `leaf` rows
        block = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")
        each, place = each.join(parted, place, "left").withColumn("block", block).drop("parts"), [*place, "block"]
    return each.join(ends, place).select(*UNIT, "side", "differ", "id", "key", *also)


def walk(
    keys_a: np.ndarray,
    keys_b: np.ndarray | None,
    depth: int,
    differ: int,
    budget: int,
    wide: np.ndarray | None = None,
    wide_budget: int = WIDE_BUDGET,
    group: np.ndarray | None = None,
    barred: np.ndarray | None = None,
    spare: int = 0,
) -> np.ndarray:
    """Walks a pair of nodes to the end; the pairs of rows (of ``a``, then of ``b``) whose links join rows.

    Keys (u64) are sorted; ``keys_b`` is None where a node is paired with itself. Rows of ``wide`` (u64) in
    the order of all keys, if given, must agree within ``wide_budget`` too. Rows of one ``group`` are joined from the
    start, and ``barred`` pairs (rows of two, each both ways round) are not linked. The first ``spare`` pairs are put out without joining rows.
    """
    keys = keys_a if keys_b is None else np.concatenate([keys_a, keys_b])
    n, m = len(keys_a), len(keys)
    label = np.arange(m)
    if group is not None:
        _, first, place = np.unique(group, return_index=True, return_inverse=True)
        label = first[place]
    pairs = []

    def join(i: int, j: int) -> None:
        if label[i] != label[j]:
            pairs.append((i, j))
            if len(pairs) > spare:
                low, high = sorted((label[i], label[j]))
                label[label == high] = low

    def split(lo: int, hi: int, at: int) -> int:
        bit = np.uint64(1 << (BITS - 1 - at))
        # within a node all digits above are equal, so the ones at this digit come last
        return lo + int(np.searchsorted((keys[lo:hi] & bit).astype(bool), True)) if hi - lo > 8 else lo + int(np.sum((keys[lo:hi] & bit) == 0))

    todo = [(0, n, *((0, n) if keys_b is None else (n, m)), depth, differ)]
    while todo:
        a0, a1, b0, b1, at, bad = todo.pop()
        if a0 == b0 and a1 - a0 < 2:
            continue
        first = label[a0]
        if (label[a0:a1] == first).all() and (label[b0:b1] == first).all():
            continue
        if (a1 - a0) * (b1 - b0) > 4096 and at == BITS:  # one key on either side, so halves of rows
            ac, bc = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2
            below = [(a0, ac, bc, b1), (ac, a1, bc, b1), (a0, ac, b0, bc)]
            if a0 != b0:
                below.append((ac, a1, b0, bc))
            todo += [(p, q, r, s, at, bad) for p, q, r, s in below if p < q and r < s]
            continue
        if (a1 - a0) * (b1 - b0) <= 4096:
            near = np.bitwise_count(keys[a0:a1, None] ^ keys[None, b0:b1]) <= budget
            if a0 == b0:
                np.fill_diagonal(near, False)
            if wide is not None and near.any():
                i, j = np.nonzero(near)
                apart = np.bitwise_count(wide[a0 + i] ^ wide[b0 + j]).sum(1, dtype="i8")
                near[i, j] = apart <= wide_budget
            if barred is not None and len(barred):
                here = barred[(a0 <= barred[:, 0]) & (barred[:, 0] < a1) & (b0 <= barred[:, 1]) & (barred[:, 1] < b1)]
                near[here[:, 0] - a0, here[:, 1] - b0] = False
            if len(pairs) < spare:
                near &= label[a0:a1, None] != label[None, b0:b1]
                if a0 == b0:
                    near = np.triu(near)
            rows = np.flatnonzero(near.any(1))
            if near.sum() <= max(4 * sum(near.shape), spare - len(pairs)):
                for i, j in zip(*np.nonzero(near), strict=True):
                    join(a0 + i, b0 + j)
                continue
            while len(rows):  # a part of the block that hangs together, from row to columns to rows
                held, across, new = np.zeros(near.shape[0], bool), np.zeros(near.shape[1], bool), rows[:1]
                held[new] = True
                while len(new):
                    cols = np.flatnonzero(near[new].any(0) & ~across)
                    if not len(cols):
                        break
                    for j, i in zip(cols, new[near[np.ix_(new, cols)].argmax(0)], strict=True):
                        join(a0 + i, b0 + j)
                    across[cols] = True
                    new = np.flatnonzero(near[:, cols].any(1) & ~held)
                    for i, j in zip(new, cols[near[np.ix_(new, cols)].argmax(1)], strict=True):
                        join(a0 + i, b0 + j)
                    held[new] = True
                rows = rows[~held[rows]]
            continue
        ac = split(a0, a1, at)
        bc = ac if a0 == b0 else split(b0, b1, at)
        below = [(a0, ac, b0, bc, 0), (ac, a1, bc, b1, 0), (a0, ac, bc, b1, 1)]
        if a0 != b0:
            below.append((ac, a1, b0, bc, 1))
        todo += [(p, q, r, s, at + 1, bad + x) for p, q, r, s, x in below if p < q and r < s and bad + x <= budget]
    return np.array(pairs, "i8").reshape(-1, 2)


def _solve(part: dict[str, np.ndarray], n: int, depth: int, differ: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of one unit, its first ``n`` rows one side (all: a node paired with itself), each side sorted by key."""
    key, ids = part["key"].view("u8"), part["id"]
    barred = None
    if "barred" in part and any(map(len, part["barred"])):
        place = {x: i for i, x in enumerate(ids.tolist())}
        found = [(i, place[x]) for i, them in enumerate(part["barred"]) for x in them if x in place]
        barred = np.array(found + [(j, i) for i, j in found], "i8").reshape(-1, 2)
    spare = SPARE * len(key) if "root" in part else 0
    joined = walk(key[:n], None if n == len(key) else key[n:], depth, differ, budget, part.get("wide"), group=part.get("root"), barred=barred, spare=spare)
    return ids[joined[:, 0]], ids[joined[:, 1]]


def _dense(rows: dict[str, np.ndarray], cuts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of all units of up to ``DENSE`` rows at once (``cuts`` are the units' edges), without those between rows that hang together."""
    sizes = np.diff(cuts)
    ends = np.repeat(np.where(sizes <= DENSE, cuts[1:], cuts[:-1]), sizes)
    key, wide = rows["key"].view("u8"), rows.get("wide")
    found, at = [], np.arange(cuts[0], cuts[-1])
    ends = np.concatenate([np.zeros(cuts[0], "i8"), ends])
    for apart in range(1, DENSE):
        at = at[at + apart < ends[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(key[at] ^ key[at + apart]) <= budget]
        if wide is not None and len(near):
            near = near[np.bitwise_count(wide[near] ^ wide[near + apart]).sum(1, dtype="i8") <= WIDE_BUDGET]
        found.append(np.stack([near, near + apart], 1))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := parent.get(x, x)) != x:
            parent[x] = x = parent.get(above, above)
        return x

    joined = []
    for i, j in np.concatenate(found).tolist() if found else []:
        i_root, j_root = root(i), root(j)
        if i_root != j_root:
            parent[max(i_root, j_root)] = min(i_root, j_root)
            joined.append((i, j))
    pairs = np.array(joined, "i8").reshape(-1, 2)
    return rows["id"][pairs[:, 0]], rows["id"][pairs[:, 1]]


def _by_unit(batches, edges, solve, dense=None):
    """Links of the units in sorted rows; ``edges`` tells for each row but the first whether another unit begins.
    ``dense``, if given, solves all units of up to ``DENSE`` rows together."""

    def columns(batch):
        now = {}
        for name in batch.schema.names:
            if name == "wide":
                now[name] = np.frombuffer(b"".join(batch[name].to_pylist()), "<u8").reshape(len(batch), -1)
            elif name == "barred":
                now[name] = np.empty(len(batch), object)
                now[name][:] = batch[name].to_pylist()
            else:
                now[name] = batch[name].to_numpy(zero_copy_only=False)
        return now

    def put(found):
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held, found = None, []
    for batch in batches:
        if not len(batch):
            continue
        now = columns(batch)
        if held is not None:
            now = {k: np.concatenate([held[k], now[k]]) for k in now}
        cuts = np.concatenate([[0], np.flatnonzero(edges(now)) + 1])
        if dense is not None and len(cuts) > 1:
            found.append(dense(now, cuts))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > (1 if dense is None else DENSE):
                found.append(solve({k: v[a:b] for k, v in now.items()}))
        held = {k: v[cuts[-1] :] for k, v in now.items()}
        if sum(len(u) for u, _ in found) > 50_000:
            yield put(found)
            found = []
    if held is not None and len(held["id"]) > 1:
        found.append(solve(held))
    if found:
        yield put(found)


def links(leaves: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """Links ``u, v`` (ids) between distinct ``leaves``, each within ``budget``, with the components of all such pairs.

    Leaves of one ``root``, if they have that column, hang together already; those in each other's ``barred`` don't link.
    A top of up to ``leaf`` leaves is a unit of its own, and its rows meet by (trie, top) in one shuffle. Only
    crowded tops are walked down in Spark first.
    """
    also = [c for c in ("wide", "root", "barred") if c in leaves.columns]
    top_of = {r["trie"]: r["top"] for r in leaves.select("trie", "top").distinct().collect()}  # a row for each trie
    tops = crowds(leaves, leaf)
    node = _top(F.col("key"), F.col("top"))
    crowded = not tops.isEmpty()
    calm = leaves
    if crowded:
        named = tops.select(F.col("trie").alias("_trie"), F.col("a").alias("_a"))
        calm = leaves.join(few(named), (F.col("trie") == F.col("_trie")) & (node == F.col("_a")), "left_anti")

    def run_tops(batches):
        shift = np.array([BITS - top_of.get(t, BITS) for t in range(max(top_of, default=0) + 1)], "u8")

        def edges(now):
            prefix = now["key"].view("u8") >> shift[now["trie"]]
            return (np.diff(now["trie"]) != 0) | (prefix[1:] != prefix[:-1])

        solve = lambda part: _solve(part, len(part["id"]), top_of[int(part["trie"][0])], 0, budget)
        return _by_unit(batches, edges, solve, None if "root" in also else lambda rows, cuts: _dense(rows, cuts, budget))

    dealt = calm.select("trie", "key", "id", *also, node.alias("node")).repartition("trie", "node").sortWithinPartitions("trie", "key").drop("node")
    found = dealt.mapInArrow(forgetting(run_tops), "u long, v long")
    if not crowded:
        return found

    def run_units(batches):
        def edges(now):
            return np.any([now[c][1:] != now[c][:-1] for c in UNIT], axis=0)

        def solve(part):
            order = np.lexsort((part["key"].view("u8"), part["side"]))  # first the rows of one side, then those of the other
            part = {k: v[order] for k, v in part.items()}
            return _solve(part, int((part["side"] == 0).sum()), int(part["depth"][0]), int(part["differ"][0]), budget)

        return _by_unit(batches, edges, solve)

    low = leaves.join(few(named), (F.col("trie") == F.col("_trie")) & (node == F.col("_a")), "left_semi")
    rows = unit_rows(low, units(low, tops, budget, leaf))
    return found.union(rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(forgetting(run_units), "u long, v long"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, leaf: int = LEAF, text_col: str = "text"
) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``."""
    with passing() as keep:
        prints = keep(fingerprints(docs, shingle, text_col))
        classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
        roots = components(links(tries(classes.select("fp"), budget), budget, leaf))
        rooted = settle(classes.join(roots, classes["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
        # Written before it is joined, so that a root of many classes can be split.
        least = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
        named = keep(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def alike(links: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``u, v, ok`` for each link: whether the Jaccard similarity of the shingle sets of ``texts`` (``id, text``) is ``least``."""

    def run(batches):
        known, one = None, None
        for batch in batches:
            ok = []
            for u, a, b in zip(batch["u"].to_pylist(), batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                if u != known:
                    known, one = u, shingle_set(a, shingle)
                other = shingle_set(b, shingle)
                both = len(np.intersect1d(one, other, assume_unique=True))
                ok.append(both >= least * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    ends = texts.select(F.col("id").alias("v"), F.col("text").alias("b"))
    both = links.join(ends, "v").join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(forgetting(run), "u long, v long, ok boolean")


def _row_key(docs: DataFrame, text_col: str) -> Column:
    """A digest of a row's id and text."""
    named = F.concat(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")), F.lit(":"), text_of(docs, text_col))
    return F.unhex(F.md5(named.cast("binary")))


def _judged(found: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, likeness: float, text_col: str) -> DataFrame:
    """``u, v, ok`` of the links ``found``. One text of each class at a link's end is looked up, and no other text moves
    as long as these ends are ``few``."""
    with passing() as keep:
        ends = found.select(F.col("u").alias("id")).union(found.select("v")).distinct()
        chosen = settle(ends.join(classes, "id").select("id", F.col("one.row").alias("row")))
        named = docs.select(_row_key(docs, text_col).alias("row"), text_of(docs, text_col).alias("text"))
        texts = settle(named.join(few(chosen), "row").select("id", "text"))
        with texts_at_once(docs.sparkSession):
            return keep(alike(found, texts, shingle, likeness).groupBy("u", "v").agg(F.first("ok").alias("ok")))


def alike_roots(docs: DataFrame, classes: DataFrame, shingle: int, leaf: int, likeness: float, text_col: str = "text") -> DataFrame:
    """``u, root`` for each class that is linked to one of a lower id by verified links (see above)."""
    spark = classes.sparkSession
    near = spark.createDataFrame([], "u long, v long")
    apart, roots, walked = near, near.withColumnRenamed("v", "root"), classes.select("id", "wide")
    while True:
        with passing() as keep:
            found = keep(links(wide_tries(walked), WORD_BUDGET, leaf).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if found.isEmpty():
            return roots
        judged = _judged(found, docs, classes, shingle, likeness, text_col)
        near = near.union(judged.filter("ok").select("u", "v"))
        failed = judged.filter("NOT ok").select("u", "v")
        roots = components(near)
        apart = apart.union(failed)
        if failed.isEmpty():
            return roots
        named = settle(classes.select("id", "wide").join(roots, F.col("id") == F.col("u"), "left").select("id", "wide", F.coalesce("root", "id").alias("root")))
        edge = failed.select(F.col("u").alias("id")).union(failed.select("v"))
        open_ = settle(named.select("id", "root").join(edge, "id", "left_semi").select("root").distinct())
        shut = apart.groupBy(F.col("u").alias("id")).agg(F.collect_set("v").alias("barred"))
        again = named.join(open_, "root", "left_semi").join(shut, "id", "left")
        walked = settle(again.select("id", "wide", "root", F.coalesce("barred", F.array().cast("array<long>")).alias("barred")))


def _classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``prints`` with an id for each set of shingles, and ``id, wide, one`` of each. Sets that share 64 bits of their hash but not all 128 get ids anew."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    group = lambda df: settle(df.groupBy("id").agg(
        F.min("wide").alias("wide"), F.min(row).alias("one"), F.min("more").alias("least"), F.max("more").alias("greatest")
    ))
    classes = group(prints)
    mixed = settle(classes.filter("least <> greatest").select(F.col("id").alias("_id")))
    if not mixed.isEmpty():
        marked = prints.join(few(mixed), F.col("id") == F.col("_id"), "left")
        anew = F.when(F.col("_id").isNull(), F.col("id")).otherwise(F.xxhash64("id", "more"))
        prints = settle(marked.select("doc_id", "row", anew.alias("id"), "more", "wide"))
        classes = group(prints)
    return prints, classes.drop("least", "greatest")


def _likeness(docs: DataFrame, shingle: int, leaf: int, text_col: str, likeness: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, id`` of each row, and ``id, one, root`` of each class; ``one`` is its least row, without an id last."""
    with texts_at_once(docs.sparkSession):
        prints = settle(wide_fingerprints(docs, shingle, text_col=text_col))
    prints, classes = _classes(prints)
    roots = alike_roots(docs, classes, shingle, leaf, likeness, text_col)
    rooted = classes.join(roots, classes["id"] == roots["u"], "left").select("id", "one", F.coalesce("root", "id").alias("root"))
    return prints.select("doc_id", "id"), settle(rooted)


def near_copies(
    docs: DataFrame, shingle: int, leaf: int = WIDE_LEAF, text_col: str = "text", likeness: float = LIKENESS
) -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs``, by likeness (see above).

    Texts of one set of shingles (they go by a 128-bit hash of it) have the same Jaccard similarity to all others, so one of
    them is compared. Texts that only have the same wide fingerprint are compared like any other candidates.
    """
    with passing() as keep:
        prints, rooted = _likeness(docs, shingle, leaf, text_col, likeness)
        least = settle(rooted.groupBy("root").agg(F.min("one").alias("least")))
        named = rooted.join(least, "root").select("id", F.col("least.doc_id").alias("component_id"))
        return keep(prints.join(named, "id").select("doc_id", "component_id"))


def keep_one(docs: DataFrame, shingle: int, text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least id (null last), then of the least digest.

    Of rows that share both, which are copies, any one stays, so rows that repeat wholly, without an id too, leave one.
    """
    with passing() as keep:
        _, rooted = _likeness(docs, shingle, WIDE_LEAF, text_col, LIKENESS)
        kept = keep(rooted.groupBy("root").agg(F.min("one").alias("one")).select(F.col("one.row").alias("row")))
    (name,) = unused(docs, "row")
    # Both steps go by the row's digest, so the texts move once; repeated rows meet as one from each task.
    single = docs.withColumn(name, _row_key(docs, text_col)).dropDuplicates([name])
    return single.join(kept, single[name] == kept["row"], "left_semi").select(*docs.columns)
