import random
import re
from itertools import permutations

import numpy as np
import pytest

from frameprobe.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "ABCDE"


def brute(docs, labels):
    """Every document through every order."""
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)),
                 doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)]
        own = [x for x in labels if x[0] is not None and x[0] == doc_id]
        rows.append((lang or "", {c for c, f in zip(LETTERS, fails) if f},
                     any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations(LETTERS)):
            left = [r for r in rows if r[0] == part]
            n = len(left)
            for step, c in enumerate(order, 1):
                lost = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                every = [r for r in rows if r[0] == part and c in r[1]]
                out[part, order, step] = [len(left), len(lost), len(every) - len(lost), sum(r[1] == {c} for r in every),
                                          sum(r[2] for r in lost), sum(r[3] for r in lost)]
                shapley[part, c] = shapley.get((part, c), 0) + len(lost)
            assert n >= len(left)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_positional_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 7, 8, 100, 5000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        want = [int(((words >> b) & 1).sum()) for b in range(32)]
        assert audit.positional_popcount(words).tolist() == want
    assert audit.positional_popcount(np.full(1000, 0xFFFFFFFF, np.uint32)).tolist() == [1000] * 32


def documents():
    r = random.Random(4)
    docs = []
    for i in range(150):
        n = r.choice([3, 150, 199, 200, 201, 260])
        pool = [f"w{j}" for j in range(r.choice([30, 99, 100, 101, 400]))]
        words = [r.choice(pool) for _ in range(n)]
        if r.random() < 0.4:
            words = [w.upper() if r.random() < 0.06 else w for w in words]
        if r.random() < 0.3:
            words[0] += r.choice("#$%&*|")
        docs.append((i, r.choice([" ", "\t", "\n", "\x0b", "  "]).join(words), r.choice(["en", "de", None, ""])))
    docs += [(200 + i, docs[i % 7][1], "fr") for i in range(60)]
    docs += [(3, docs[3][1], "en"), (3, docs[3][1], "en"), (None, docs[5][1], "en"), (None, None, None), (None, None, None),
             (301, None, "de"), (302, "", "de"), (303, None, "xx"), (304, "É" * 97 + "ABC", "de"), (305, "É" * 95 + "ABC", "de"),
             (306, "x\x1cy " * 400, "en"), (307, " \n", "de"), (-5, docs[9][1], "en")]
    return docs


@pytest.mark.parametrize("share", [1_000, 1])
def test_interactions_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(audit, "HOT_SHARE", share)  # copies by broadcast, or all by shuffle
    docs = documents()
    r = random.Random(5)
    labels = [(d[0], r.choice([0, 1, None]), r.choice([0, 1, None])) for d in docs if r.random() < 0.7] + [(None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, quality int, part string").repartition(5)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = found(audit.interactions(frame, marks))
    want = brute(docs, labels)
    assert len(want) == 600 * len({d[2] or "" for d in docs})
    assert got == want
    assert frame.count() == sum(v[0] + v[1] for k, v in got.items() if k[1] == "ABCDE" and k[2] == 1)


def test_long_texts_are_counted_alike(monkeypatch):
    for text in (b"", b" ", b"a b\na \x0bc", "é ü\tÉ é".encode() * 30):
        want = audit.failed(text), audit._words(text)
        monkeypatch.setattr(audit, "LISTED_BYTES", -1)
        assert (audit.failed(text), audit._words(text)) == want
        monkeypatch.undo()


def test_tables_without_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.interactions(empty, labels).collect() == []
    got = found(audit.interactions(awkward.withColumnRenamed("source", "lang"), labels))
    assert all(v[4] == v[5] == 0 for v in got.values())
