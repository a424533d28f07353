"""Phrase collocations, periodic runs and packing by powers of two, against brute force and on odd rows."""

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

from heddle.llm import collocations, decompose, periodic  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n long, id long, words string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that the operators use inside."""
    rows = [
        (1, None, "en", 1, 1, "x"), (2, "", None, None, None, None), (None, "a b c a b c a b c a b c", "en", 1, 1, "x"),
        (None, "a b c a b c a b c a b c", "en", 1, 1, "x"), (3, "Word " * 60_000, "en", 2, 2, "y"), (4, "same text, here\x0b" * 40, None, 3, 3, "z"),
        (4, "same text, here\x0b" * 40, None, 3, 3, "z"), (5, "Ä ä\tÄ A.B,,c \x85 d", "de", 4, 4, ""), (6, " \n\t", "de", 4, 4, ""),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def _phrases(docs, least, top=2000, share=80):
    """Plain Python from the definition."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= share * f[p[i : i + k]]:
                        gone.add(p[i : i + k])
        rows = []
        for p, a in cands.items():
            if p not in gone:
                cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("size", "top"), [(1 << 20, 2000), (150, 2000), (60, 7)])
def test_phrases_match_plain_counting(spark, size, top):
    rnd = random.Random(3)
    words = ["a", "b", "C", "é", "dd", "the", "of"]
    docs = []
    for i in range(60):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", " ", ", ", "\n"]) for _ in range(rnd.randint(0, 60)))
        docs.append((i % 7, rnd.choice(["en", "de", None]), text + " new york city hall" * rnd.randint(0, 2)))
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(5)
    found = collocations.rank(collocations.phrases(df, least=4, size=size, pairs=50), top=top)
    assert sorted(map(tuple, found.collect())) == _phrases([x[1:] for x in docs], 4, top)


def test_phrases_of_odd_rows(spark, odd):
    found = sorted(map(tuple, collocations.rank(collocations.phrases(odd, least=3, size=4096)).collect()))
    assert found == _phrases([(r.lang, r.text) for r in odd.collect()], 3)
    assert [r[3:5] for r in found if r[2] == "word word word word"] == [(59_997, 60_000)]
    assert collocations.rank(collocations.phrases(odd.limit(0))).count() == 0


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", ["x", "y"], [big, big - 1], [big, big - 1], None, big), ("en", ["u", "v"], [10, 5], [7, 5], 4, big), ("en", ["u", "w"], [10, 6], [7, 6], 4, big)]
    schema = "lang string, words array<string>, firsts array<long>, lasts array<long>, inside long, n long"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "element_at(firsts, -1) AS a")
    got = {r.phrase: (r.rank, r.score) for r in collocations.rank(df).collect()}
    assert got == {"x y": (1, 2_000_000 * (big - 1) // (2 * big)), "u w": (2, 2_000_000 * 6 // 17)}  # "u v" goes: 4 of 5 are inside a longer one
    assert collocations.rank(df.filter("a < 100"), top=1).count() == 1


def _runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_match_a_scan():
    rnd = random.Random(1)
    for _ in range(800):
        n, k = rnd.randint(0, 90), rnd.choice([1, 2, 2, 3, 5])
        code = [rnd.randrange(k) for _ in range(n)]
        if n > 5 and rnd.random() < 0.6:
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // 2))
            code = [*code[:a], *(code[a + (i - a) % p] for i in range(a, n))]
        assert periodic.find_runs(np.array(code, "i4")).tolist() == [list(r) for r in _runs(code)]


def test_runs_when_hashes_say_nothing(monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(periodic, "_value", lambda code: np.zeros(len(code), "u8"))  # all words hash alike
    monkeypatch.setattr(periodic, "SLICE", 7)
    for _ in range(100):
        code = [rnd.randrange(2) for _ in range(rnd.randint(0, 60))]
        assert periodic.find_runs(np.array(code, "i4")).tolist() == [list(r) for r in _runs(code)]


def test_long_runs_are_not_looked_at_again():
    code = np.concatenate([np.zeros(200_000, "i4"), np.arange(50_000), np.tile(np.arange(7), 40_000)]).astype("i4")
    assert periodic.find_runs(code).tolist() == [[0, 200_001, 1], [250_000, 280_000, 7]]


def _judged(doc, text, prepare):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if prepare and words and doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        n = len(words)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _runs(words) if len(words) < 20_000 else [(0, len(words), 1)]  # the long text of the fixture is one word again and again
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digest = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, digest(listed.encode()), digest(left))


@pytest.mark.parametrize("prepare", [None, periodic.plant])
def test_runs_of_rows(spark, odd, prepare):
    rnd = random.Random(4)
    more = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 120)))) for i in range(150)]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + more
    df = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    found = periodic.detect(df, prepare=prepare)
    assert found.columns == [c.split()[0] for c in periodic.SCHEMA.split(", ")]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(_judged(*r, prepare)) for r in rows)
    assert periodic.detect(df.limit(0), prepare=prepare).count() == 0


def test_runs_and_text_are_kept(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 4 + "y"), (2, None)], "doc_id long, text string")
    kept = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic.detect(df, keep=True).collect()}
    assert kept == {1: ([(1, 12, 3)], "x a b c y"), 2: ([], "")}


def test_planted_runs_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: tuple(r) for r in periodic.op12_periodic_runs(spark, SF).collect()}
    assert sorted(found) == sorted(texts)
    for doc, text in texts.items():
        if len(text) < 2_000:
            assert found[doc] == _judged(doc, text, True)


def test_lengths():
    assert [decompose.lengths(n, 8) for n in (0, 1, 7, 8, 21)] == [[], [1], [4, 2, 1], [8], [8, 8, 4, 1]]
    with pytest.raises(ValueError, match="power of two"):
        decompose.pieces(None, 12)


@pytest.mark.parametrize("capacity", [2048, 8])
def test_pieces_give_the_ids_back(spark, odd, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(decompose.VOCABULARY))
    wanted = Counter()
    for r in odd.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, decompose.END]
        at = 0
        for n in decompose.lengths(len(ids), capacity):
            raw = np.array(ids[at : at + n], "<u4").tobytes()
            wanted[r.doc_id, at, n, zlib.crc32(raw), len(ids), raw] += 1
            at += n
        assert at == len(ids)
    rows = decompose.pack(odd, capacity, keep_ids=True).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in rows) == wanted
    by_id = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in by_id] == list(range(len(rows)))
    assert [r.length for r in by_id] == sorted((r.length for r in rows), reverse=True)
    assert {r.offset for r in rows} == {0}
    assert decompose.pack(odd.limit(0)).count() == 0


def test_buckets_on_disk(spark, odd, tmp_path):
    packed = decompose.pack(odd, 64, keep_ids=True)
    decompose.write_buckets(packed, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.filter("length(ids) <> 4 * bucket OR bucket <> length").count() == 0
    assert back.count() == packed.count()


def test_query_of_power_packing(spark):
    rows = decompose.op13_power_packing(spark, SF).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for parts in by_doc.values():
        ends = [0, *(s + n for s, n, _ in sorted(parts))]
        assert [s for s, _, _ in sorted(parts)] == ends[:-1] and ends[-1] == parts[0][2]
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows) and len({r.sequence_id for r in rows}) == len(rows)


def test_phrases_match_sql(spark):
    same_rows(collocations.op11_phrase_collocations(spark, SF), collocations.ORACLE_SQL, SF)
