import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from frameprobe.llm import simhash

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(prints):
    names = list(prints)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in names}


def test_awkward_rows_match_brute_force(awkward, nothing):
    rows = awkward.collect()
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(awkward).collect())
    prints = {brute(r.text) for r in rows}
    root = component_of(prints)
    least = {}
    for r in rows:
        if r.doc_id is not None:
            c = root[brute(r.text)]
            least[c] = min(r.doc_id, least.get(c, r.doc_id))
    want = sorted((r.doc_id is None, r.doc_id, f"{brute(r.text):016x}", least.get(root[brute(r.text)])) for r in rows)
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("block", [1_000, 3])
def test_links_connect_all_that_brute_force_connects(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    r = random.Random(5)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(r.choice([1, 1, 2, 3])):
                x ^= 1 << r.randrange(64)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    want = component_of(prints)
    classes = {}
    for p, s in zip(prints, signed):
        classes.setdefault(want[p], set()).add(found.get(s, s))
    assert all(len(c) == 1 for c in classes.values())
    assert len(set().union(*classes.values())) == len(classes)


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 60)}


def test_one_row_of_each_component_stays(awkward, nothing):
    out = simhash.representatives(awkward)
    assert out.columns == awkward.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 11} <= set(ids) and not {2, 5, 6} & set(ids)
    assert simhash.representatives(nothing).count() == 0
