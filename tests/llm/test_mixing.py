import re

import pytest

from frameprobe.llm import mixing

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, total = {}, set(names), share * sum(sizes.values())
    while left:
        rest = total - sum(target.values())
        part = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if part[s] >= most * sizes[s]}
        if not over:
            return target | part
        target |= {s: most * sizes[s] for s in over}
        left -= over
    return target


def test_targets_follow_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 400, "c": 900, None: 77}, {"a": 1000, "b": 1}, {"z": 5}, {"a": 0, "b": 8, "c": 9, "d": 3}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows, (5, 2, 1), 1.5, 2.0).collect()}
        assert got == pytest.approx(filled(sizes))


def test_mix_of_awkward_rows(awkward):
    got = mixing.mixed(awkward.drop("size")).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or ""))
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        assert r.copies - r.rate < 1 and r.rate - r.copies < 1
    again = mixing.mixed(awkward.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted((key(r), r.copies) for r in got) == sorted((key(r), r.copies) for r in again)


def test_emitted_rows_keep_their_columns(awkward, nothing):
    copies = sum(r.copies for r in mixing.mixed(awkward).collect())
    out = mixing.emitted(awkward)
    assert out.columns == awkward.columns and out.count() == copies
    assert mixing.emitted(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * (1 + i % 50), "s%d" % (i % 3)) for i in range(6000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.05)
