"""Suffix-array dedup: bytes covered by a long string that starts anywhere else are removed.

Which strings of ``length`` bytes occur twice is read off sorted suffixes. Not every suffix of the corpus need be
sorted: every such string holds an anchor, the string of ``GRAM`` bytes in it whose hash is least (the first of equals),
and equal strings have equal anchors at equal places. So strings are gathered by anchor:

1. Each text is cut into runs, the start places of strings with one anchor. A run's context is the bytes
   its strings cover. Runs are counted by (anchor, context) in Spark, with partial sums, so a
   passage in a third of all documents meets as a count. A context found twice repeats
   whole; an anchor with a single context, found once, has nothing that repeats.
2. Where an anchor has several contexts, one of each goes to the sort. The suffixes that start at the
   anchor, and the reversed texts before it, are put in order by deep-shallow sorting: multikey
   quicksort (on eight bytes at a time) to a shallow depth, then blind tries for the groups that still agree.
   In each order neighbours' common prefixes tell which contexts agree to a given depth. The
   string that starts l bytes before the anchor occurs elsewhere exactly if another context
   agrees in l bytes before and in ``length - l`` bytes from the anchor on.
3. Spans return to their texts by digest; repeated texts are cut once.

An anchor with over ``HOT`` contexts is parted by slices of l and the bytes that all strings of a slice
share, which keeps strings that could be equal together. What the slices of a key hold is counted in Spark first:
a slice found twice repeats whole, and one of each goes on. Keys that still have over ``HOT`` different slices are parted
again by narrower ones, down to single strings, where equal ones are one slice. So no task sorts more than ``HOT`` rows of a key.

Contexts and slices are compared as digests (64 bits of the anchor's hash and 64 of the context's, or 128 bits), never sent as a whole
to be counted; contexts that are sorted are compared as bytes.

Defined results: null and empty texts have no bytes; texts under ``length`` bytes keep all; long texts are
cut in pieces of ``CHUNK`` bytes that overlap; repeated rows, equal
and null ids are documents of their own (whole copies remove each other); an empty table gives
no rows; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import passing, settle, table, text_of

LENGTH = 400
GRAM = 128
SHALLOW = 64
HOT = 256
SLICES = 8
#: Bytes of text that are hashed together.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """Random values of bytes, and powers of an odd number and of its inverse modulo 2**64."""
    rng = np.random.default_rng(20240501)
    value = rng.integers(0, 1 << 63, 256, dtype="u8") * 2 + 1
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)

    def powers(x: int) -> np.ndarray:
        out = np.full(2 * CHUNK + 4 * LENGTH, x, "u8")
        out[0] = 1
        return np.multiply.accumulate(out)

    return value, powers(base), powers(inverse)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of the texts ``data[starts:ends]``: text number, first and last string start, anchor place,
    anchor hash and context hash. Strings that would cross from one text to the next are left out."""
    value, power, inverse = _tables()
    x = value[np.frombuffer(data, "u1")]
    prefix = np.zeros(len(x) + 1, "u8")
    np.cumsum(x * power[: len(x)], out=prefix[1:])
    grams = _mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(x) - gram + 1])
    width = length - gram + 1
    low = np.uint64((1 << 22) - 1)
    key = grams & ~low | np.arange(len(grams), dtype="u8")
    rows = -(-len(key) // width)
    block = np.full(rows * width, ~np.uint64(0))
    block[: len(key)] = key
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - length + 1
    anchor = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype("i8")
    last = ends - length  # last string start of each text
    text = np.searchsorted(starts, np.arange(n), "right") - 1
    valid = np.arange(n) <= last[text]
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh & valid)
    if not len(first):
        return None
    final = np.append(first[1:], n) - 1
    final = np.minimum(final, last[text[first]])
    q = anchor[first]
    whole = (prefix[final + length] - prefix[first]) * inverse[first]
    shape = (q - first).astype("u8") * np.uint64(0x9E3779B1) + (final - first).astype("u8") * np.uint64(0x85EBCA77C2B2AE63)
    return text[first], first, final, q, grams[q], _mix(whole ^ _mix(shape))


def deep_shallow(data: np.ndarray, group: np.ndarray, at: np.ndarray, depth: int, shallow: int = SHALLOW):
    """Order of the strings ``data[at : at + depth]`` within their groups, and each one's common prefix with the one before it.

    ``data`` is padded with ``depth + 8`` bytes. The first of a group has common prefix -1.
    """
    order = np.argsort(group, kind="stable")
    part = group[order]  # strings still alike, by number
    known = np.full(len(at), -1, "i8")
    part = np.concatenate([[0], np.cumsum(part[1:] != part[:-1])]) if len(part) else part
    weights = np.arange(8)
    active = np.arange(len(order))
    for d in range(0, min(shallow, depth), 8):
        # Multikey quicksort on eight bytes: parts are ordered by them, and parted where they differ.
        wide = min(8, depth - d)
        window = data[(at[order[active]] + d)[:, None] + weights]
        window = np.where(weights < wide, window, 0).astype("u1")
        key = window.view(">u8").ravel().astype("u8")
        sub = np.lexsort((key, part[active]))
        order[active], key, window = order[active][sub], key[sub], window[sub]
        p = part[active]
        same_part = p[1:] == p[:-1]
        cut = same_part & (key[1:] != key[:-1])
        if cut.any():
            where = np.flatnonzero(cut) + 1
            known[active[where]] = d + (window[where] != window[where - 1]).argmax(1)
            bump = np.zeros(len(order), "i8")
            bump[active[where]] = 1
            part = part + np.cumsum(bump)
        lone = np.ones(len(order), bool)
        alike = part[1:] == part[:-1]
        lone[1:] &= ~alike
        lone[:-1] &= ~alike
        active = active[~lone[active]]
        if not len(active):
            break
    if len(active):
        done = min(shallow, depth)
        for few in np.split(active, np.flatnonzero(np.diff(part[active])) + 1):
            strings = [data[a : a + depth].tobytes() for a in at[order[few]]]
            placed, common = blind_trie(strings, done)
            order[few] = order[few][placed]
            known[few[1:]] = common[1:]
    return order, known


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings of one length that agree up to ``start``."""
    if a[start:] == b[start:]:
        return len(a)
    lo, hi = start, len(a)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(strings: list[bytes], start: int) -> tuple[list[int], list[int]]:
    """Orders strings that agree up to ``start``; their order and common prefixes with the one before.

    A node is ``[depth, {byte: child}]`` and a leaf a list of equal strings' numbers. An insertion goes down
    blindly, by the branching bytes alone, compares once with a string found there, and branches at the
    first difference.
    """
    root: list = [len(strings[0]), [0]]
    for number, s in enumerate(strings[1:], 1):
        node = root
        while isinstance(node[1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        at = _common(s, other, start)
        if at == len(s):
            node[1].append(number)
            continue
        above, node = None, root
        while node[0] < at:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node[1], dict) and node[0] == at:
            node[1][s[at]] = [len(s), [number]]
            continue
        branch = [at, {other[at]: node, s[at]: [len(s), [number]]}]
        if above is None:
            root = branch
        else:
            above[1][s[above[0]]] = branch
    order: list[int] = []
    common: list[int] = []
    todo = [(root, -1)]
    while todo:
        node, shared = todo.pop()
        if isinstance(node[1], dict):
            children = [node[1][b] for b in sorted(node[1])]
            todo += [(c, node[0]) for c in reversed(children[1:])]
            todo.append((children[0], shared))
        else:
            order += node[1]
            common += [shared] + [node[0]] * (len(node[1]) - 1)
    return order, common


def repeated(contexts: list[bytes], group: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH):
    """For contexts with anchors at ``q`` and strings that start ``low`` to ``high`` bytes before them:
    pairs (context number, l) of strings that another context of the group holds too."""
    m = len(contexts)
    pad = length + 8
    # Ahead: from the anchor on. Behind: the bytes before it, reversed. Padding never reaches a string's bytes.
    sizes = np.fromiter(map(len, contexts), "i8", m)
    data = np.frombuffer(b"".join(contexts) + bytes(pad), "u1")
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if m else np.zeros(0, "i8")
    turned = np.frombuffer(b"".join(c[:k][::-1] for c, k in zip(contexts, q.tolist(), strict=True)) + bytes(pad), "u1")
    turned_base = np.concatenate([[0], np.cumsum(q)[:-1]]) if m else np.zeros(0, "i8")
    ahead_order, ahead = deep_shallow(data, group, base + q, length)
    behind_order, behind = deep_shallow(turned, group, turned_base, length)
    found_context, found_l = [], []
    right, left = np.empty(m, "i8"), np.empty(m, "i8")
    for l in range(int(low.min(initial=length)), int(high.max(initial=-1)) + 1):
        live = (low <= l) & (l <= high)
        right[ahead_order] = np.cumsum(ahead < length - l)
        left[behind_order] = np.cumsum(behind < l) if l else group[behind_order]
        pair = (right * (m + 1) + left)[live]
        _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(live)[counts[inverse] > 1]
        found_context.append(hit)
        found_l.append(np.full(len(hit), l))
    if not found_context:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    return np.concatenate(found_context), np.concatenate(found_l)


def _cut_runs(length: int, gram: int):
    def run(batches):
        for batch in batches:
            buffer, size, names = [], 0, []
            rows: list[list[np.ndarray]] = []

            def flush():
                nonlocal buffer, size, names
                if not buffer:
                    return
                sizes = np.array([len(b) for b, _, _ in buffer])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                found = runs(b"".join(b for b, _, _ in buffer), starts, ends, length, gram)
                if found is not None:
                    text, first, final, q, anchor, context = found
                    shift = starts[text] - np.array([o for _, _, o in buffer])[text]
                    digests = np.array([d for _, d, _ in buffer], dtype=object)[text]
                    rows.append([digests, anchor.view("i8"), context.view("i8"), first - shift, final - shift, q - shift])
                buffer, size = [], 0

            for text in batch["text"].to_pylist():
                raw = text.encode()
                if len(raw) < length:
                    continue
                digest = hashlib.md5(raw).digest()
                for at in range(0, len(raw) - length + 1, CHUNK):
                    piece = raw[at : at + CHUNK + length - 1]
                    buffer.append((piece, digest, at))
                    size += len(piece)
                    if size >= CHUNK:
                        flush()
            flush()
            if rows:
                digest, *rest = (np.concatenate(c) for c in zip(*rows, strict=True))
                arrays = [pa.array(digest, pa.binary()), *map(pa.array, rest[:2]), *(pa.array(c.astype("i4")) for c in rest[2:])]
                yield pa.RecordBatch.from_arrays(arrays, names=["digest", "anchor", "context", "a", "b", "q"])

    return run


def _sort_contexts(length: int):
    """Rows sorted by ``key``: contexts of one key are compared; spans of their repeated strings come out."""

    def run(batches):
        names = ["key", "digest", "a", "low", "high", "q", "bytes"]
        held: dict[str, list] = {n: [] for n in names}

        def solve(rows: dict[str, list]):
            keys = rows["key"]
            change = np.array([0] + [int(x != y) for x, y in zip(keys[1:], keys[:-1], strict=True)])
            group = np.cumsum(change)
            context, l = repeated(rows["bytes"], group, np.array(rows["q"]), np.array(rows["low"]), np.array(rows["high"]), length)
            if not len(context):
                return None
            start = np.array(rows["a"])[context] + np.array(rows["q"])[context] - l
            by = np.lexsort((start, context))
            context, start = context[by], start[by]
            new = np.ones(len(context), bool)
            new[1:] = (context[1:] != context[:-1]) | (start[1:] > start[:-1] + 1)
            first = np.flatnonzero(new)
            final = np.append(first[1:], len(new)) - 1
            digest = [rows["digest"][i] for i in context[first]]
            return pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), pa.array(start[first].astype("i4")), pa.array((start[final] + length).astype("i4"))],
                names=["digest", "start", "end"],
            )

        for batch in batches:
            for at in range(0, len(batch), 4096):
                piece = batch.slice(at, 4096)
                for n in names:
                    held[n] += piece[n].to_pylist()
                last = len(held["key"])
                while last and held["key"][last - 1] == held["key"][-1]:
                    last -= 1
                if last:
                    found = solve({n: held[n][:last] for n in names})
                    held = {n: held[n][last:] for n in names}
                    if found is not None:
                        yield found
        if held["key"]:
            found = solve(held)
            if found is not None:
                yield found

    return run


def _slices(raw: bytes, anchor: bytes, start: int, q: int, low: int, high: int, length: int, step: int):
    """Rows ``key, a, low, high, q, bytes`` of the strings that start ``low`` to ``high`` bytes before place ``q`` of ``raw``,
    by slices of ``step`` values. ``start`` is the place of ``raw`` in its text."""
    for s in range(low // step, high // step + 1):
        lo, hi = s * step, min((s + 1) * step - 1, length)
        # All strings of the slice hold the bytes from lo before the anchor.
        core = hashlib.blake2b(raw[q - lo : q + length - hi], digest_size=16).digest()
        least, most = max(lo, low), min(hi, high)
        first = q - most
        yield anchor + step.to_bytes(2) + s.to_bytes(2) + core, start + first, least, most, most, raw[first : q - least + length]


def _table(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), *[pa.int32()] * 4, pa.binary(), pa.int32()]
    names = ["key", "digest", "a", "low", "high", "q", "bytes", "step"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _contexts(length: int, slices: int):
    """Texts with the runs of theirs that are to be compared, to one row per context (and slice, for hot anchors)."""
    step = -(-length // slices)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for digest, text, wanted in zip(
                batch["digest"].to_pylist(), batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True
            ):
                raw = text.encode()
                for r in wanted:
                    a, b, q, anchor = r["a"], r["b"], r["q"], r["anchor"].to_bytes(8, "little", signed=True)
                    if not r["hot"]:
                        out.append((anchor, digest, a, q - b, q - a, q - a, raw[a : b + length], 0))
                        continue
                    for key, *rest in _slices(raw, anchor, 0, q, q - b, q - a, length, step):
                        out.append((key, digest, *rest, step))
            if out:
                yield _table(out)

    return run


def _narrower(length: int, slices: int):
    """Slices of keys that hold too many, to narrower ones."""

    def run(batches):
        names = ["key", "digest", "a", "low", "high", "q", "bytes", "step"]
        for batch in batches:
            out: list[tuple] = []
            for key, digest, a, low, high, q, raw, step in zip(*(batch[n].to_pylist() for n in names), strict=True):
                step = -(-step // slices)
                out += [(k, digest, *rest, step) for k, *rest in _slices(raw, key[:8], a, q, low, high, length, step)]
            if out:
                yield _table(out)

    return run


RUNS = "digest binary, anchor long, context long, a int, b int, q int"
CONTEXTS = "key binary, digest binary, a int, low int, high int, q int, bytes binary, step int"


def _runs_to_compare(docs: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """``digest, start, end`` of runs whose context repeats whole, and ``digest, runs`` to be compared."""
    with passing() as keep:
        cut = settle(docs.select("text").mapInArrow(_cut_runs(length, gram), RUNS))
        # Copies of a text give the same runs; `copies` of a context counts them all.
        counts = settle(cut.groupBy("anchor", "context").agg(
            F.count("*").alias("copies"), F.min(F.struct("digest", "a", "b", "q")).alias("one")
        ))
        again = counts.filter("copies > 1").select("anchor", "context")
        whole = cut.join(again, ["anchor", "context"]).select("digest", F.col("a").alias("start"), (F.col("b") + length).alias("end"))
        whole = keep(whole.distinct())
        several = settle(counts.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1"))
        some = counts.join(several, "anchor").select(
            "one.digest", F.struct("one.a", "one.b", "one.q", "anchor", (F.col("contexts") > hot).alias("hot")).alias("run")
        )
        return whole, keep(some.groupBy("digest").agg(F.collect_list("run").alias("runs")))


def _hot_slices(rows: DataFrame, length: int, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spans of slices that repeat whole, and the slices to be sorted, ``hot`` of a key at most."""
    spans, sorted_ = [], []
    content = F.md5(F.concat(F.encode(F.concat_ws(",", "low", "high", F.lit("")), "UTF-8"), "bytes"))
    while not rows.isEmpty():
        rows = rows.withColumn("content", F.unhex(content))
        one = F.struct("digest", "a", "low", "high", "q", "bytes", "step")
        counts = settle(rows.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(one).alias("one")))
        again = counts.filter("copies > 1").select("key", "content")
        end = F.col("a") + F.col("high") - F.col("low") + length
        spans.append(settle(rows.join(again, ["key", "content"]).select("digest", F.col("a").alias("start"), end.alias("end"))))
        sizes = settle(counts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        left = settle(counts.join(sizes, "key").select("key", "one.*", "n"))
        sorted_.append(left.filter(F.col("n") <= hot).drop("n"))
        rows = settle(left.filter(F.col("n") > hot).drop("n").mapInArrow(_narrower(length, SLICES), CONTEXTS))
    return spans, sorted_


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``digest, spans``: for distinct texts (``docs`` has ``digest`` and ``text``) the byte ranges to remove."""
    with passing() as keep:
        whole, wanted = _runs_to_compare(docs, length, gram, hot)
        texts = docs.select("digest", "text").dropDuplicates(["digest"])
        rows = settle(texts.join(wanted, "digest").select("digest", "text", "runs").mapInArrow(_contexts(length, SLICES), CONTEXTS))
        spans, sorted_ = _hot_slices(rows.filter("step > 0"), length, hot)
        few_ = rows.filter("step = 0")
        for more in sorted_:
            few_ = few_.unionByName(more)
        compared = few_.drop("step").repartition("key").sortWithinPartitions("key", "digest", "a").mapInArrow(
            _sort_contexts(length), "digest binary, start int, end int"
        )
        both = settle(compared)
        for more in [whole, *spans]:
            both = both.union(more)
        return keep(both.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")))


def dedup(docs: DataFrame, length: int = LENGTH, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` and, if asked for, the ``kept`` bytes."""
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    keyed = named.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    with passing() as keep:
        spans = repeated_spans(keyed, length)
        copies = keyed.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1")
        known = keep(spans.join(copies, "digest", "full").withColumnRenamed("digest", "_digest"))

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text, found, copies_ in zip(
                batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), batch["copies"].to_pylist(), strict=True
            ):
                raw = text.encode()
                merged: list[list[int]] = [[0, len(raw)]] if (copies_ or 1) > 1 and len(raw) >= length else []
                for s in found or [] if not merged else []:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), merged, left))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            count = len(names) - (not keep_text)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns[:count], kinds[:count], strict=True)], names=names[:count]
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    joined = keyed.join(known, F.col("digest") == F.col("_digest"), "left").select("doc_id", "text", "spans", "copies")
    return joined.mapInArrow(cut, schema + (", kept binary" if keep_text else ""))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
