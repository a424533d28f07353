"""Which terms disclose an entity, span by span against plain counting, and what stands in their place."""

import math
import random
from collections import Counter, defaultdict

import pytest

from heddle.llm import pii


def _plain(texts, near, disclose):
    """Plain Python from the definition: spans of terms for each text, and those too close to the threshold to tell."""
    scanned = []
    for text in texts:
        spans, by_entity = pii.base_spans(text), defaultdict(set)
        for start, kind, end in spans:
            before, after = list(pii._TERM.finditer(text, 0, start))[-near:], list(pii._TERM.finditer(text, end))[:near]
            for m in before + after:
                if not any(m.start() < e and s < m.end() for s, _, e in spans):
                    by_entity[pii._entity(kind, text[start:end])].add((m[0].lower(), m.start(), m.end()))
            by_entity.setdefault(pii._entity(kind, text[start:end]), set())
        scanned.append(by_entity)
    n = len(texts)
    n_entity = Counter(e for x in scanned for e in x)
    n_term = Counter(t for text in texts for t in {w.lower() for w in pii._TERM.findall(text)})
    n_both = Counter((e, t) for x in scanned for e, found in x.items() for t in {f[0] for f in found})
    told, unsure = [], []
    for x in scanned:
        mine, close = {}, set()
        for e, found in x.items():
            for t, a, b in found:
                if n_entity[e] < n:
                    share = math.log2(n * n_both[e, t] / (n_term[t] * n_entity[e])) / math.log2(n / n_entity[e])
                    if abs(share - disclose) < 1e-9:
                        close.add((a, b))
                    elif share >= disclose:
                        mine[a, b] = max(share, mine.get((a, b), 0))
        told.append(mine)
        unsure.append(close)
    return told, unsure


@pytest.mark.parametrize("seed", range(6))
def test_decision_matches_plain_counting(spark, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.choice([8, 60]))]
    mails = [f"m{i}@x.org" for i in range(6)] + ["1.2.3.4", "+49 (30) 123-456-78"]
    texts = []
    for _ in range(rnd.choice([5, 70])):
        parts = [rnd.choice(words) if rnd.random() < 0.85 else rnd.choice(mails) for _ in range(rnd.randint(0, 40))]
        texts.append(" ".join(parts))
    texts += texts[:2] + [""]  # copies count each
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    disclose = rnd.choice([0.3, 0.6, 0.8])
    told, unsure = _plain(texts, 3, disclose)
    for r in pii.find(df, near=3, disclose=disclose).collect():
        found = {(t.start, t.end): t.share for t in r.terms}
        for span in unsure[r.doc_id]:
            found.pop(span, None)
            told[r.doc_id].pop(span, None)
        assert found == pytest.approx(told[r.doc_id]), (seed, r.doc_id)


def test_classes_disclose_less_than_the_terms(spark):
    word = lambda i, n: "".join(chr(97 + i // 26**k % 26) for k in range(n))
    texts = []
    for i in range(60):  # a word of two documents beside an address of one: 0.85 of its information
        texts.append(f"so {word(i // 2, 7)} q wrote to user{i}@x.org and so on")
    texts += [f"so extraordinary q wrote to last{i}@x.org and so on" for i in range(2)]  # the only two of their class
    texts += ["so someone q wrote to nobody and so on"] * 140
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, cut string")
    safe = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert {safe[i] for i in range(60)} == {"so [WORD] q wrote to [EMAIL] and so on"}
    assert {safe[i] for i in (60, 61)} == {"so  q wrote to [EMAIL] and so on"}
    assert {safe[i] for i in range(62, 202)} == {texts[-1]}
    n, bits = len(texts), math.log2(len(texts))
    assert math.log2(n / 60) < pii.DISCLOSE * bits <= math.log2(n / 2)  # why one class stays and the other goes


def test_terms_are_summed_before_they_are_joined(spark, monkeypatch):
    plans = []
    settle = pii.settle

    def seen(df):
        plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return settle(df)

    monkeypatch.setattr(pii, "settle", seen)
    docs = spark.createDataFrame([(i, f"rare{chr(97 + i)}xx word a{i}@b.org common") for i in range(6)], "doc_id long, text string")
    assert pii.find(docs).count() == 6
    (plan,) = [p for columns, p in plans if columns == ["entity", "term", "share", "bits"]]
    # Joined to entities, terms and the number of documents, and nothing else.
    assert plan.count("Join ") == 3
