import hashlib
import random
import zlib

import pytest

from frameprobe.llm import arrays, repeats

from .conftest import prose


def brute(rows, match):
    """rows: (doc_id, bytes); windows at smaller (doc_id, start) are earlier, equal places are not."""
    first = {}
    for d, b in rows:
        for p in range(len(b) - match + 1):
            w = b[p:p + match]
            first[w] = min((d, p), first.get(w, (d, p)))
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - match + 1):
            if first[b[p:p + match]] < (d, p):
                gone[p:p + match] = b"\1" * match
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not h for g, h in zip(gone, bytes([0]) + bytes(gone)))
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(df, match=100):
    rows = [(repeats.LAST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in df.collect()]
    got = sorted((repeats.LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)
                 for r in repeats.deduplicated(df, match).collect())
    assert got == brute(rows, match)


def test_awkward_rows(awkward, nothing):
    check(awkward)
    assert repeats.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("chunk, held, hot", [(1 << 20, 16 << 20, 64), (700, 1500, 64), (5000, 9000, 2)])
def test_shared_passages(spark, monkeypatch, chunk, held, hot):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "HELD_BYTES", held)
    monkeypatch.setattr(repeats, "HOT_HERE", hot)
    monkeypatch.setattr(repeats, "HOT_IN_ALL", hot)
    r = random.Random(4)
    passages = [prose(100 + i, 40) for i in range(6)]
    rows = []
    for i in range(60):
        text = " ".join(r.choice([prose(i * 7 + k, r.randrange(1, 60)), r.choice(passages), "ab" * r.randrange(90)]) for k in range(6))
        rows.append((r.randrange(50), text[r.randrange(20):]))
    rows += [(70, "z" * 5000), (71, rows[0][1]), (71, rows[1][1])]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_span_hashes_depend_on_content_only():
    import numpy as np
    data = np.frombuffer(b"abcdabcdabcx" * 9, np.uint8)
    h = arrays.SpanHash(data, 5)
    a, b = np.array([0, 4, 12]), np.array([4, 8, 16])
    assert len(set(h.of(a, b).tolist())) == 1
    assert h.of(np.array([8]), np.array([12]))[0] != h.of(a, b)[0]


def test_rows_of_one_id_are_judged_each(spark):
    """Also where a check sum of 26 bits, as an earlier version kept, agrees."""
    passage = prose(1, 40)[:160]
    seen, pair = {}, None
    for i in range(200_000):
        for text in (f"{passage} {i}", f"{prose(2, 40)[:160]} {i}"):
            other = seen.setdefault(zlib.crc32(text.encode()) & ((1 << 26) - 1), text)
            if other[:160] != text[:160]:
                pair = other, text
        if pair:
            break
    rows = [(1, passage), (2, pair[0]), (2, pair[1]), *[(None, f"{passage} {i}") for i in range(40)], *[(None, pair[0])] * 9]
    rows += [(3, prose(9, 40)), (3, prose(9, 40)), (3, "x" + prose(9, 40)), (4, None), (4, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_marks_tell_texts_apart(spark):
    rows = [(i % 7 if i % 3 else None, f"t{i % 11}") for i in range(200)]
    keyed, size = repeats._keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    got = keyed.collect()
    assert size == sum(len(t) for _, t in rows) and len(got) == 200
    assert len({(r.doc, r.mark) for r in got}) == len({(r.doc, r.mark, r.text) for r in got}) == len(set(rows))
