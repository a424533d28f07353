"""Each operator against its SQL or a brute-force version, and the edge cases its docstring defines."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import same_rows  # noqa: E402

from heddle.llm import (  # noqa: E402
    chat, chunks, components, decontaminate, packing, pii, quality, registry, simhash, suffixes, tokens, urls, wavelet,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, digest string, n_words int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, None, "en", "x", 1), (2, "", None, None, None), (None, "a b c d e f", "en", "x", 2), (None, "a b c d e f", "en", "x", 2),
        (3, "word " * 60_000, "en", "x", 3), (4, "same text here " * 40, "en", "x", 4), (5, "same text here " * 40, "de", "y", 5),
        (5, "same text here " * 40, "de", "y", 5), (-9, "\x1c odd space <|endoftext|> ÄÖ \U0001f600", "fr", "z", 6),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    same_rows(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_odd_rows_have_defined_results(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "")], "item_id long, text string")
    none = items.limit(0)
    assert [quality.judge(d).count() for d in (odd, empty)] == [9, 0]
    assert [suffixes.dedup(d).count() for d in (odd, empty)] == [9, 0]
    assert [simhash.near_duplicates(d).count() for d in (odd, empty)] == [9, 0]
    assert [pii.find(d).count() for d in (odd, empty)] == [9, 0]
    assert [pii.sanitise(d).count() for d in (odd, empty)] == [9, 0]
    assert [chunks.dedup(d).count() for d in (odd, empty)] == [9, 0]
    hit = decontaminate.contamination(odd, items)
    assert hit.count() == 7  # one row for each distinct id and text
    assert [(r.doc_id, r.n_hit) for r in hit.filter("n_hit > 0").collect()] == [(None, 6)]
    assert decontaminate.contamination(empty, items).count() == decontaminate.contamination(odd, none).filter("n_hit > 0").count() == 0
    assert decontaminate.clean(odd, items).count() == 7
    assert packing.pack(empty).count() == 0
    packed = packing.pack(odd)
    assert packed.select("doc_id", "start").count() == packed.count() >= 9
    shards = wavelet.write_shards(odd)
    assert wavelet.read_shards(shards).count() == 9
    assert wavelet.read_shards(wavelet.write_shards(empty)).count() == 0


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, pos int"
    rows = [(None, None, None, None, 1), (None, None, None, None, 1), (1, 0, "a:b", "\\### x</turn>\n", 1), (1, 0, "a:b", "y", 2)]
    rows += [(2, i, "system" if i == 0 else "assistant", "t" * 400 + str(i), 0) for i in range(700)]
    back = chat.read_back(chat.windows(spark.createDataFrame(rows, schema), budget=512)).collect()
    said = defaultdict(list)
    for r in sorted(back, key=lambda r: r.window):
        said[r.conv_id] += [tuple(t) for t in r.turns]
    assert said == {None: [("", "")] * 2, 1: [("a:b", "\\### x</turn>\n"), ("a:b", "y")], 2: [(r[2], r[3]) for r in rows[4:]]}
    assert "".join(r.loss_text for r in sorted(back, key=lambda r: r.window) if r.conv_id == 2) == "".join(r[3] for r in rows[5:])
    written = chat.windows(spark.createDataFrame(rows, schema), budget=512).filter("conv_id = 2")
    assert all(r.formatted.startswith("### system: ") and len(r.formatted) <= 512 * 4 for r in written.collect())
    assert chat.windows(spark.createDataFrame([], schema)).count() == 0


def test_url_graph(spark, tmp_path):
    pages = [
        ("http://good.org/fr/a", '<a href="http://Friend.com/x"> <a href=//spam.com/>'), ("http://friend.com/", None),
        ("http://spam.com/x", '<a href="http://bad.net/">' * 3), ("http://bad.net/", None), (None, "x"), ("nourl", '<a href="http://q.com">'),
        ("HTTP://A.COM?x", ""), ("http://liker.com/q#f", '<img src="http://spam.com/i.png">'), ("http://bad.net", None),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    df.toPandas().to_parquet(tmp_path / "pages.parquet")
    found = urls.op3_url_filters(spark, str(tmp_path))
    same_rows(found, urls.ORACLE_SQL, str(tmp_path))
    verdict = {r.page_id: r.verdict for r in found.collect()}
    assert [verdict[i] for i in range(9)] == ["allow", "allow", "block", "block", "allow", "allow", "allow", "block", "block"]
    assert urls.judge(df.limit(0)).count() == 0


def _removed(texts: list[bytes], length: int):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))
        out.append((len(t), sum(hit), spans, hashlib.sha256(bytes(c for c, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [256, 3])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, hot):
    rnd = random.Random(5)
    base = [bytes(rnd.randrange(97, 123) for _ in range(rnd.randint(300, 1500))) for _ in range(12)]
    texts = [b"", b"a" * 900, b"ab" * 450, b"y" * 400, b"y" * 401, b"x" * 399]
    for k in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            s, n = rnd.choice(base), rnd.randint(50, 900)
            a = rnd.randrange(len(s))
            parts.append(s[a : a + n])
        t = bytearray(base[0] if k % 3 == 0 else b"".join(parts))
        if k % 3 == 0:
            t[rnd.randrange(len(t))] = 65
        texts.append(bytes(t))
    texts.append(texts[-1])
    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (suffixes.LENGTH, suffixes.GRAM, hot))
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = suffixes.dedup(df, keep_text=False).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found] == _removed(texts, 400)


def test_deep_shallow_sorts():
    rnd = random.Random(1)
    for _ in range(60):
        depth = rnd.choice([5, 30, 70])
        strings = [bytes(rnd.choice(b"ab") if rnd.random() < 0.05 else 97 for _ in range(depth)) for _ in range(rnd.randint(0, 40))]
        strings += strings[:9]
        group = np.array([rnd.randint(0, 2) for _ in strings], "i8")
        data = np.frombuffer(b"".join(strings) + bytes(depth + 8), "u1")
        order, known = suffixes.deep_shallow(data, group, np.arange(len(strings)) * depth, depth, shallow=16)
        placed = [(group[i], strings[i]) for i in order]
        assert placed == sorted(placed)
        for k, (a, b) in enumerate(zip(placed, placed[1:], strict=False), 1):
            shared = next((i for i in range(depth) if a[1][i] != b[1][i]), depth)
            assert known[k] == (shared if a[0] == b[0] else -1)


@pytest.mark.parametrize("leaf", [16, 4096])
def test_trie_join_matches_brute_force(spark, leaf):
    rnd, made = random.Random(3), set()
    centres = [rnd.getrandbits(64) for _ in range(20)]
    for k in range(900):
        c = centres[0] if k % 3 == 0 else rnd.choice(centres)
        for _ in range(rnd.randint(0, 5)):
            c ^= 1 << rnd.randrange(64)
        made.add(c)
    fps = np.array(sorted(made), "u8").view("i8")
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    root = {r.u: r.root for r in components.components(simhash.links(simhash.tries(df, 4), 4, leaf)).collect()}
    label = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps.view("u8") ^ fps.view("u8")[i]) <= 4):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
    parts = lambda labels: {frozenset(v) for v in _groups(labels).values()}
    assert parts([root.get(int(x), int(x)) for x in fps]) == parts(label.tolist())


def _groups(labels):
    out = defaultdict(list)
    for i, x in enumerate(labels):
        out[x].append(i)
    return out


def test_fingerprint_matches_definition():
    import xxhash

    for text in ("", "One", "a b c", "A b c D e\tf\n\x0bg É é", "x " * 9):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        h = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))] if words else []
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_match_patterns():
    rnd = random.Random(1)
    for _ in range(20_000):
        letters = rnd.choice(["a@.b_1-", "0123456789. -", "+0 1(2)-.3", "4111 1-", "a@b.c d9"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == _base(text), text


def test_terms_that_reveal(spark):
    rows = [(i, f"the zorblax met bob@x.org near the river {i}") for i in range(4)] + [(9 + i, "the river was near the town") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df).filter("doc_id < 9").collect()
    assert all([rows[r.doc_id][1][t.start : t.end] for t in r.terms] == ["zorblax", "met"] for r in found)
    assert pii.sanitise(df).filter("doc_id = 0").first().text == "the   [EMAIL] near the river 0"


def test_chunks_resist_shifts(spark):
    rnd = random.Random(2)
    shared = "".join(rnd.choice("abcdefghij klmnop") for _ in range(2000))
    other = ["".join(rnd.choice("abcdefghij klmnop") for _ in range(500)) for _ in range(2)]
    df = spark.createDataFrame([(1, other[0] + shared), (2, "x" + other[1] + shared), (3, other[0][:100])], "doc_id long, text string")
    found = {r.doc_id: r for r in chunks.dedup(df).collect()}
    assert found[1].n_removed == 0 and found[1].n_repeated >= 1900
    assert 1900 <= found[2].n_removed <= 2000 and bytes(found[2].kept).startswith(b"x")
    assert found[3].n_removed == 0
    data = shared.encode()
    gear = chunks._gear()
    for i in (0, 5, 31, 32, 700):
        value = sum(int(gear[data[i - j]]) << j for j in range(min(16, i + 1))) % (1 << 16)
        assert chunks.gear_hashes(data)[i] == value


def test_packing_is_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(120):
        cap = rnd.choice([7, 10, 64, 100])
        lengths = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 200))]
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in bins if r >= n]
            if fits:
                bins.remove(min(fits))
            bins.append((min(fits) if fits else cap) - n)
        used, ranks = defaultdict(list), Counter()
        for n, rank, count, first, offset in packing.plan(Counter(lengths), cap):
            assert rank == ranks[n]
            ranks[n] += count
            for k in range(count):
                used[first + k].append((offset, n))
        assert ranks == Counter(lengths)
        left = []
        for parts in used.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
            left.append(cap - ends[-1])
        assert sorted(left) == sorted(bins)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_ids_are_the_library_s(name):
    rnd = random.Random(4)
    encoder = tokens.Encoder(name, limit=50)
    texts = ["", " ", "a  b", "x \n\ny", "it's they'sα 'ſ", "<|endoftext|> b", "a\x1cb", "É é ²3 ½x", "\n\nA\n", "don't!!'s"]
    texts += ["".join(rnd.choice("ab 'sé,.\n1²α_́Ж<|!\t ") for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    wanted = encoder.whole.encode_batch(texts, add_special_tokens=False)
    for text, got, want in zip(texts, encoder.encode(texts), wanted, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_go_straight_to_the_library_s_merging(name, monkeypatch):
    encoder = tokens.Encoder(name, limit=3)
    texts = ["Übung macht den Meister", "wörter ÀÉÎ ßß  zwei\nzeilen Nur Ñandú", "x" * 300 + " kurz, lang"] * 2
    wanted = [e.ids for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]
    sent, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda ts: sent.extend(ts) or encode(ts))
    assert [np.frombuffer(encoder.encode([t])[0], "<u4").tolist() for t in texts] == wanted
    assert sent and not [t for t in sent if t.strip().isalpha() and not t.startswith(("\n", "  "))]


def test_pieces_and_places(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.place(packing.pieces(docs, keep_ids=True).cache())
    whole = tokens.encoder(packing.VOCABULARY).whole
    text = {r.doc_id: r.text for r in docs.collect()}
    by = defaultdict(list)
    for r in rows.orderBy("piece").collect():
        by[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32
    for doc, parts in by.items():
        ids = np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist()
        assert ids == whole.encode(text[doc], add_special_tokens=False).ids + [2]
        assert all(p.length == packing.CAPACITY for p in parts[1:]) and [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
    assert set(by) == set(text)
    lengths = packing.sequences(rows).selectExpr("sequence_id", "length(ids) / 4 AS n").collect()
    assert max(r.n for r in lengths) <= packing.CAPACITY and sum(r.n for r in lengths) == sum(p.length for v in by.values() for p in v)


def test_wavelet_shards(spark):
    x = np.random.default_rng(0).integers(0, 49_000, 5000)
    x[::7] = 5
    shard = wavelet.Shard(wavelet.build([1, None], [2000, 3000], x))
    assert shard.doc_ids == [1, None] and (shard.ids() == x).all()
    assert all(shard.access(i) == x[i] for i in range(0, 5000, 37))
    assert shard.count(5) == (x == 5).sum() and shard.count(5, 100, 2011) == (x[100:2011] == 5).sum()
    assert all(shard.find(5, k) == np.flatnonzero(x == 5)[k] for k in range(0, 700, 50)) and shard.find(5, 10**6) is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = wavelet.read_shards(wavelet.write_shards(docs.repartition(4), shard_ids=5000)).orderBy("doc_id").collect()
    at = 0
    whole = tokens.encoder(wavelet.VOCABULARY).whole
    for r, d in zip(found, docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array(whole.encode(d.text, add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def _quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_features(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    for r in quality.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _quality(r.text or "")


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == sizes[-1]


@pytest.mark.parametrize("leaf", [8, simhash.WIDE_LEAF])
def test_likeness_keeps_one_of_each_group(spark, leaf):
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(30_000)}"
    texts = []
    for _ in range(60):
        text = [word() for _ in range(int(rng.integers(60, 400)))]
        texts.append(text)
        # up to a sixtieth: alike; a forty-fifth: at the edge, so that links fail and groups are walked again; an eighth: not
        for changes in (0, 1, len(text) // 60, len(text) // 45, len(text) // 45, len(text) // 8):
            other = list(text)
            for at in rng.integers(0, len(text), changes):
                other[at] = word()
            texts.append(other)
    texts += [["same", "few", "words"]] * 3 + [[]] * 2
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    wide = np.array([np.frombuffer(simhash.wide_fingerprint(t, 5), "<u8") for _, t in rows])
    apart = np.bitwise_count(wide[:, None] ^ wide[None])
    words = apart <= simhash.WORD_BUDGET
    rotations = [np.uint64((1 << n) - 1) << np.uint64(64 - a - n) for a, n in simhash.stretches(4)]
    stored = wide.byteswap()  # the stretches are cut from the stored bytes in a row
    agree = np.any([(stored[:, None] ^ stored[None]) & m == 0 for m in rotations], axis=0)
    near = (words & agree).any(2) & (apart.sum(2, dtype="i8") <= simhash.WIDE_BUDGET)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    near &= np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    root = np.arange(len(rows))
    while True:
        least = np.where(near, root[None], len(rows)).min(1)
        if (least == root).all():
            break
        root = least
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(df, 5, leaf).collect()}
    assert found == dict(enumerate(root.tolist()))
    for at in range(0, 420, 7):
        assert found[at] == found[at + 1] == found[at + 2] == at
        assert found[at + 6] == at + 6
    missed = sum(found[at + 3] != at for at in range(0, 420, 7))
    assert missed <= 6
    kept = {r.doc_id for r in simhash.keep_one(df, 5).collect()}
    assert kept == set(root.tolist())


def test_likeness_of_odd_rows(spark, odd, empty):
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(odd, 5).collect()), key=repr)
    assert found == [(-9, -9), (1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (5, 4), (None, None), (None, None)]
    kept = simhash.keep_one(odd, 5)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [-9, 1, 3, 4, None]
    assert simhash.keep_one(empty, 5).count() == 0


def _prose(rnd, n):
    return [f"w{rnd.randrange(30_000)}" for _ in range(n)]


def test_unlike_texts_of_one_fingerprint_both_stay(spark):
    rnd = random.Random(11)
    phrase = _prose(rnd, 5)
    texts = [" ".join(body + phrase * 400) for body in (_prose(rnd, 1000), _prose(rnd, 1000))]
    hashes = [simhash.shingle_hashes(t, 5) for t in texts]
    assert len(np.intersect1d(*hashes)) < 0.01 * len(np.union1d(*hashes))
    texts += [texts[0], texts[0].upper(), texts[1].replace(" ", "\n")]  # equal sets of shingles
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(df, 5).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}


def test_near_copies_recall_with_repeated_lines(spark):
    rnd = random.Random(12)
    texts = []
    for k in range(40):
        body, line = _prose(rnd, 300), _prose(rnd, 5)
        texts += [body, body + line * 8, body[:150] + line * (3 + k % 9) + body[150:]]
    texts = [" ".join(t) for t in texts]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) >= 120
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(df, 5).collect()}
    assert sum(found[i] == found[j] for i, j in pairs) == len(pairs)


def test_one_key_of_many_ids_is_parted(spark):
    rnd, leaf = random.Random(13), 64
    other = [rnd.getrandbits(64 * 5) for _ in range(2)]  # two groups that agree in one word alone
    rows = []
    for i in range(900):
        x = other[i % 3 == 0]
        for at in rnd.sample(range(64 * 5), 12):
            x ^= 1 << at
        rows.append((i, bytearray(b"12345678" + x.to_bytes(40, "little"))))
    leaves = simhash.wide_tries(spark.createDataFrame(rows, "id long, wide binary"))
    tops = simhash.crowds(leaves, leaf)
    sizes = simhash.unit_rows(leaves, simhash.units(leaves, tops, simhash.WORD_BUDGET, leaf)).groupBy(*simhash.UNIT).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 2 * leaf
    root = {r.u: r.root for r in components.components(simhash.links(leaves, simhash.WORD_BUDGET, leaf)).collect()}
    assert [root.get(i, i) for i in range(900)] == [0 if i % 3 == 0 else 1 for i in range(900)]


def test_walk_pairs_many_rows_of_one_key():
    key = np.full(500, 7, "u8")
    wide = np.zeros((500, 6), "u8")
    wide[200:300] = ~np.uint64(0)
    for a, b in ((key, None), (key[:220], key[220:])):
        label = np.arange(500)
        for i, j in simhash.walk(a, b, 64, 0, 20, wide):
            label[label == max(label[i], label[j])] = min(label[i], label[j])
        assert (label[:200] == 0).all() and (label[300:] == 0).all() and (label[200:300] == 200).all()


def test_terms_of_few_documents_reveal(spark):
    rows = [(i, f"the zorblax met bob@x.org near the river {i}") for i in range(2)] + [(9 + i, "they met near the river in the town") for i in range(30)]
    rows += [(99, "the quux wrote " + "7 " * 20_000 + "to ann@x.org " + "7 " * 20_000 + "near the river")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [rows[i][1][t.start : t.end] for t in r.terms] for i, r in enumerate(pii.find(df).orderBy("doc_id").collect())}
    assert found[0] == found[1] == ["zorblax"]
    assert found[99] == ["quux", "wrote"]
    one = pii.find(df.filter("doc_id = 0")).first()  # an entity of all documents
    assert len(one.spans) == 1 and one.terms == []


def test_near_terms_match_a_plain_scan():
    rnd = random.Random(14)
    for _ in range(3000):
        text = "".join(rnd.choice(["é", "ab", "abc ", " ", "1", "a@b.c", "@", "défg ", "x.y ", "1.2.3.4"]) for _ in range(rnd.randint(0, 40)))
        spans, wanted = pii.base_spans(text), defaultdict(dict)
        for start, kind, end in spans:
            near = wanted[pii._entity(kind, text[start:end])]
            before, after = list(pii._TERM.finditer(text, 0, start))[-3:], list(pii._TERM.finditer(text, end))[:3]
            for m in before + after:
                if not any(m.start() < e and s < m.end() for s, _, e in spans):
                    near[m.start()] = (m[0].lower(), m.start(), m.end())
        found = {k: set(v) for k, v in pii.near_terms(text, spans, 3).items()}
        assert found == {k: set(v.values()) for k, v in wanted.items()}, text


def test_decontamination_has_a_row_for_each_row(spark, tmp_path):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "other words"), (3, "other words"), (3, "other words"), (None, "odd"), (None, "odd")]
    rows += [(1, "b c d e f of one id"), (None, "q w e r t and others"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    items = [(1, "b c d e f"), (2, "B-C d e f"), (2, "b c d e f"), (None, "q w e r t"), (None, "others"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").toPandas().astype({"item_id": "Int64"}).to_parquet(tmp_path / "benchmark.parquet")
    same_rows(decontaminate.op7_decontamination(spark, str(tmp_path)), decontaminate.ORACLE_SQL, str(tmp_path))


def test_hot_slices_are_parted(spark):
    rnd, length, hot = random.Random(15), 400, 8
    letters = "abcdefghijklmnopqrstuvwxyz "
    shared = "".join(rnd.choice(letters) for _ in range(1500))
    some = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(20, 300)))
    texts = [some() + shared + some() for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = df.selectExpr("doc_id", "text", "unhex(md5(text)) AS digest")
    _, wanted = suffixes._runs_to_compare(keyed, length, suffixes.GRAM, hot)
    rows = keyed.join(wanted, "digest").select("digest", "text", "runs").mapInArrow(suffixes._contexts(length, suffixes.SLICES), suffixes.CONTEXTS)
    assert rows.filter("step > 0").groupBy("key").count().agg({"count": "max"}).first()[0] > hot
    _, parted = suffixes._hot_slices(rows.filter("step > 0"), length, hot)
    assert max(p.groupBy("key").count().agg({"count": "max"}).first()[0] or 0 for p in parted) <= hot
    found = suffixes.repeated_spans(keyed.select("digest", "text"), length, suffixes.GRAM, hot)
    removed = {bytes(r.digest): r.spans for r in found.collect()}
    for (n, size, _, _), t in zip(_removed([t.encode() for t in texts], length), texts, strict=True):
        hit = bytearray(n)
        for a, b in removed[hashlib.md5(t.encode()).digest()]:
            hit[a:b] = b"\1" * (b - a)
        assert sum(hit) == size


def test_sets_that_share_half_a_hash_stay_apart(spark):
    rows = [(1, b"a", 7, 1, b"w"), (2, b"b", 7, 2, b"x"), (3, b"c", 7, 1, b"w"), (4, b"d", 8, 1, b"y")]
    prints, classes = simhash._classes(spark.createDataFrame(rows, "doc_id long, row binary, id long, more long, wide binary"))
    of = {r.doc_id: r.id for r in prints.collect()}
    assert of[1] == of[3] != of[2] and of[4] == 8 and len(set(of.values())) == 3
    assert sorted((r.id, r.one.doc_id) for r in classes.collect()) == sorted([(of[1], 1), (of[2], 2), (8, 4)])
    alone = simhash._classes(spark.createDataFrame(rows[:1] + rows[3:], prints.schema))[1]
    assert sorted(r.id for r in alone.collect()) == [7, 8] and alone.columns == ["id", "wide", "one"]


def test_chunks_match_brute_force(spark, odd):
    rnd = random.Random(16)
    parts = ["".join(rnd.choice("abcdefghij klmnopß") for _ in range(rnd.randint(5, 900))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 5)))) for i in range(60)]
    rows += rows[:2] + [(None, rows[3][1]), (3, parts[0] * 3), (None, None), (7, "z" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    gear, held, places = [int(g) for g in chunks._gear()], {}, defaultdict(list)
    for doc, text in rows:
        raw, value, start, cut = (text or "").encode(), 0, 0, []
        for i, c in enumerate(raw):
            value = (value * 2 + gear[c]) % (1 << 16)
            if i + 1 - start == chunks.LARGEST or i + 1 - start >= chunks.SMALLEST and value >> (16 - chunks.MASK_BITS) == 0:
                cut.append((start, i + 1))
                start = i + 1
        cut += [(start, len(raw))] * (start < len(raw))
        long = lambda a, b: b - a >= chunks.RUN
        ends = [b for _, b in cut]
        spans = {(a, next(b for b in ends if long(a, b))) for a, _ in cut if long(a, len(raw))}
        spans |= {(max(a for a, _ in cut if long(a, b)), b) for b in ends if long(0, b)}
        held[doc, text] = spans
        for a, b in spans:
            places[raw[a:b]].append((-(1 << 63) if doc is None else doc, hashlib.md5(raw).digest(), a))
    wanted = Counter()
    for doc, text in rows:
        raw = (text or "").encode()
        whose = (-(1 << 63) if doc is None else doc, hashlib.md5(raw).digest())
        seen, first, later = set(), set(), set()
        for a, b in held[doc, text]:
            if len(places[raw[a:b]]) > 1:
                seen |= set(range(a, b))
                (first if min(places[raw[a:b]]) == (*whose, a) else later).update(range(a, b))
        out = later - first
        left = bytes(c for i, c in enumerate(raw) if i not in out)
        n_spans = sum(i - 1 not in out for i in out)
        wanted[doc, len(raw), len(seen), len(out), n_spans, hashlib.sha256(left).hexdigest()] += 1
    found = chunks.dedup(docs, keep_text=False).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_repeated, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == wanted


def test_chunks_remove_only_what_stands_elsewhere(spark):
    """On texts whose short phrases all repeat, every byte removed lies in a string of RUN bytes that another place holds."""
    rnd = random.Random(19)
    phrases = [" ".join(_prose(rnd, 5)) for _ in range(40)]  # some 30 bytes each, repeated everywhere
    texts = [" ".join(rnd.choice(phrases) for _ in range(rnd.randint(20, 60))).encode() for _ in range(80)]
    texts += [t[200:900] for t in texts[:10]]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = Counter(t[i : i + chunks.RUN] for t in texts for i in range(len(t) - chunks.RUN + 1))
    for r in chunks.dedup(df, keep_text=False).collect():
        raw = texts[r.doc_id]
        known = set()
        for i in range(len(raw) - chunks.RUN + 1):
            if seen[raw[i : i + chunks.RUN]] > 1:
                known |= set(range(i, i + chunks.RUN))
        for a, b in r.removed:
            assert set(range(a, b)) <= known
    assert chunks.minus([[0, 10], [20, 30]], [[2, 4], [8, 22], [29, 40]]) == [[0, 2], [4, 8], [22, 29]]
    assert chunks.union([(0, 5), (5, 7), (6, 6), (9, 10)]) == [[0, 7], [9, 10]]


def test_chunks_find_short_passages(spark):
    rnd, texts, sizes = random.Random(17), [], []
    for k in range(300):
        passage = _prose(rnd, 51 + k % 50)
        texts += [" ".join(_prose(rnd, 60) + passage + _prose(rnd, 60)) for _ in range(2)]
        sizes.append(len(" ".join(passage)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in chunks.dedup(df, keep_text=False).collect()}
    caught = [found[2 * k].n_repeated > 0 and found[2 * k + 1].n_removed > 0 for k in range(300)]
    assert sum(caught) >= 0.97 * 300
    assert sum(found[2 * k + 1].n_removed for k in range(300)) >= 0.8 * sum(sizes)


#: Names that operators use inside or give to what they return.
INNER = (
    "digest digest_told row id one wide root least component_id fp u v ok trie key top node a b spans terms told cut share entity term "
    "n_both n_term chunk start size part parts _doc _digest _doc_ _text _words words windows lines places text_ w window item_id items at n_hit "
    "shingle hits copies runs bytes step content head body tok pos c0 c1 span conv none piece length offset sequence_id ids image rank "
    "n_words n_symbols kept passed failed_rules _bucket _rank host path rule its rules verdict trust distrust n_chars lang source"
).split()


@pytest.fixture(scope="module")
def crowded(spark):
    """A column of every inner name, and nulls, empties, ties, repeated rows and a text of 5 MB."""
    rnd = random.Random(18)
    texts = [None, "", "same words " * 60, "same words " * 60, "write to ann@x.org or 1.2.3.4 now " + " ".join(_prose(rnd, 60))]
    texts += [" ".join(_prose(rnd, 700_000)), "a b c d e f " + " ".join(_prose(rnd, 80))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, texts[2]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in INNER}).repartition(2).cache()


def test_inner_names_and_long_texts(spark, crowded):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").withColumns({c: F.lit(1) for c in INNER if c != "item_id"})
    own = lambda df: df.select(*INNER).distinct().collect() == [tuple(f"own {c}" for c in INNER)]
    n = crowded.count()
    judged = quality.judge(crowded)
    assert judged.count() == n and judged.select("_text", "words").distinct().collect() == [("own _text", "own words")]
    kept = simhash.keep_one(crowded, 5)
    assert kept.columns == crowded.columns and own(kept) and sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == [0, 2, 4, 5, 6]
    clean = decontaminate.clean(crowded, items)
    assert clean.columns == crowded.columns and own(clean) and clean.count() == n - 1
    safe = pii.sanitise(crowded)
    assert safe.columns == crowded.columns and own(safe) and safe.count() == n
    assert safe.filter("text like '%[EMAIL]%[IP]%'").count() == 2 and safe.filter("text like '%ann@x.org%'").count() == 0
    assert suffixes.dedup(crowded, keep_text=False).count() == chunks.dedup(crowded, keep_text=False).count() == n
    assert decontaminate.contamination(crowded, items).agg(F.sum("copies")).first()[0] == n
    assert simhash.near_duplicates(crowded).count() == n and packing.pack(crowded).select("doc_id").distinct().count() == 8
    assert wavelet.read_shards(wavelet.write_shards(crowded)).count() == n
    pages = crowded.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/fr/x").alias("url"), F.col("text").alias("html"), *INNER)
    sites = urls.judge(pages.union(pages))
    assert sites.count() == 2 * n and sites.select("host", "path", "rule", "verdict", "rules").distinct().collect() == [("a.org", "/fr/x", "org/fr/", "allow", "own rules")]
    turns = crowded.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text", *INNER)
    assert chat.windows(turns).agg(F.sum("n_new")).first()[0] == n


def test_pipeline_stages_on_odd_and_empty_tables(spark, crowded, tmp_path):
    from pyspark.sql import functions as F

    import corpus_pipeline

    spark.createDataFrame([(1, "a the b the c the d the e the f")], "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    # Words of letters with stop words between them, so that the rules leave the shorter texts.
    plain = crowded.withColumn("text", F.replace(F.translate("text", "0123456789", "abcdefghij"), F.lit(" "), F.lit(" the ")))
    for docs, sizes in ((plain, (3, 2, 1, 1)), (plain.limit(0), (0, 0, 0, 0))):
        columns = docs.columns
        for (name, stage), size in zip(corpus_pipeline.STAGES, sizes, strict=False):
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert docs.columns == columns and docs.count() == size, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == sizes[-1]


def test_near_duplicates_do_not_keep_what_other_steps_remember(spark):
    """Workers that encoded texts are used again; their encoders are gone by the time near-duplicates have been judged in them."""
    docs = spark.createDataFrame([(i, f"text {i} " * 60) for i in range(64)], "doc_id long, text string").repartition(32)

    def encoders(batches):
        import pyarrow as pa

        from heddle.llm import tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens.encoder.cache_info().currsize])], names=["n"])

    held = lambda: sum(r["n"] for r in docs.mapInArrow(encoders, "n long").collect())
    assert packing.pieces(docs).count() >= 64
    assert held() > 0
    assert simhash.near_copies(docs, 5).count() == 64
    assert held() == 0


def test_texts_at_once(spark):
    """Texts reach Python in small batches within the block, and the session's own number holds after it."""
    from heddle.llm.common import texts_at_once

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(2500, numPartitions=1)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    most = lambda: max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect())
    before = spark.conf.get(name, None)
    with texts_at_once(spark):
        assert most() == 1000
    assert spark.conf.get(name, None) == before and most() == 2500
    spark.conf.set(name, "300")
    try:
        with texts_at_once(spark):
            assert most() == 300
        assert spark.conf.get(name) == "300"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
