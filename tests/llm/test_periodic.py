import hashlib
import random
import re
import zlib

import numpy as np

from frameprobe.llm import periodic, queries


def brute(words):
    """Runs by trying every period and stretch."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and j > i and (start, length) not in found:
                found[start, length] = q  # a larger period of the same stretch is not its smallest
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items()
                  if not any(words[s:s + n][d:] == words[s:s + n][:-d] for d in range(1, q)))


def sequences():
    r = random.Random(8)
    out = [[], [1], [1] * 5, [1] * 6, [1] * 50, [1, 2] * 3 + [1], [1, 2] * 4, [1, 1, 2] * 4, [1, 2, 3] * 20 + [1, 2],
           [1] * 7 + [2] * 7 + [1] * 7, ([1] * 6 + [2]) * 5, [0, 1, 0, 0, 1, 0, 1, 0] * 8, list(range(40))]
    for _ in range(600):
        words = []
        while len(words) < r.randrange(5, 120):
            block = [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(r.randrange(1, 9))]
            words += (block * r.randrange(1, 8))[:r.randrange(1, 60)]
        out.append(words)
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a  # Fibonacci words
    return [*out, b, [x for x in b for _ in range(4)]]


def test_runs_against_brute_force():
    some = 0
    for words in sequences():
        want = brute(words)
        assert periodic.runs_of(words) == want, words
        some += len(want)
    assert some > 500


def test_stretches_hold_every_run():
    found = sequences()
    texts = [" ".join(map(str, w)).encode() for w in found]
    for words, (runs, _) in zip(found, periodic._found(texts), strict=True):
        assert runs == brute(words), words
    codes = np.arange(5000)
    assert len(periodic.where_to_look(codes, np.array([0, 5000]))[0]) == 0


def test_long_sequence_in_little_time():
    words = [1, 2, 3, 4, 5] * 8000 + list(range(10, 20000)) + [7] * 20000
    assert periodic.runs_of(words) == [(0, 40000, 5), (40000 + 19990, 20000, 1)]


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_rows(spark, awkward, nothing):
    docs = awkward.drop("size").unionByName(spark.createDataFrame(
        [(50, "\x0bha ha\tha ha ha ha\x1cx ha", None, None, None)], awkward.drop("size").schema))
    rows = periodic.periodic_runs(docs).collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    for r in rows:
        options = []
        for t in texts[r.doc_id]:
            words = [w.decode() for w in t.split()]
            options.append(([tuple(x) for x in brute(words)], collapsed(words, brute(words))))
        assert ([tuple(x) for x in r.runs], r.collapsed) in options
    assert any(r.runs for r in rows)
    assert periodic.periodic_runs(nothing).collect() == []


def plain(doc_id, text):
    """The query's row, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), collapsed(words, runs))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(2)
    docs = [(i, " ".join(f"w{r.randrange(r.choice([3, 50]))}" for _ in range(r.randrange(1, 150)))) for i in range(300)]
    docs += [(None, "a " * 9), (400, None), (401, ""), (402, "é " * 20), (402, "é\n" * 20), (0, " ".join("abcdefghij" * 3))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain(*d)) for d in docs)
    assert sum(x.n_runs > 0 for x in got) >= 15
