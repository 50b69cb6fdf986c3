import random

from frameprobe.llm import toxicity

from .conftest import prose


def test_unseen_misspellings_and_long_texts(spark):
    r = random.Random(1)
    bad = ["grumblesnout", "vilepotato", "mudlicker"]

    def text(i, toxic, n=60):
        found = prose(i, n).split()
        for _ in range(3 * toxic):
            found.insert(r.randrange(len(found)), r.choice(bad))
        return " ".join(found)

    rows = [(i, text(i, i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    rows += [(1000, prose(5, 4000) + " grumblesnouts vilepotatoo mudlickerr", 1), (1001, prose(6, 4000), 0), (1002, None, None), (1003, "", None),
             (None, "x", None), (3, rows[3][1], 1)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:600]], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    truth = dict((i, y) for i, _, y in rows[:600])
    out = [x for x in got if x.held_out and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in out) >= 0.95 * len(out) and len(out) > 60
    by_id = {x.doc_id: x.predicted for x in got}
    assert by_id[1000] == 1 and by_id[1001] == 0 and by_id[1003] == 0


def test_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {x.predicted for x in toxicity.scored(docs, labels).collect()} == {0}
    assert toxicity.scored(docs.limit(0), labels.limit(0)).count() == 0


def test_passages_anywhere_in_whole_texts_train(spark):
    rows = [(i, prose(i, 5000) + f" vilepotato{i % 7} mudlicker{i % 5} grumblesnout" * (i % 3 == 0), int(i % 3 == 0)) for i in range(60)]
    assert all(len(t) > 20_100 for _, t, _ in rows)
    rows += [(100, prose(200, 40) + " vilepotato1 mudlicker2 grumblesnout", -1), (101, prose(201, 40), -1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y >= 0], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels).collect()}
    assert got[100] == 1 and got[101] == 0


def test_every_short_passage_lies_in_one_stretch():
    scorer = toxicity.Scorer([0.0], 0.0)
    scorer.known = {"a": 0.0, "b": 1.0}
    for n in (0, 1, 15, 32, 33, 40, 64, 100):
        covered = set()
        for k in toxicity.starts(n).tolist():
            covered |= set(range(k, min(n, k + toxicity.STRETCH)))
        assert covered == set(range(n))
    for at in range(90):
        found = ["a"] * at + ["b"] * 10 + ["a"] * (100 - at)
        assert round(scorer.stretches(found).max() * toxicity.STRETCH) == 10
        assert toxicity.highest(scorer, found, 1)[0].count("b") == 10


def test_first_rows_are_not_the_lowest_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word number {i}") for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "FIRST_ROWS", 20)
    monkeypatch.setattr(toxicity.Model, "fit", lambda self, bags, labels, steps, weight: seen.append(len(bags.length)))
    texts = toxicity.sample(docs, labels)
    toxicity.trained(texts, rounds=0)
    low = [r.text for r in texts.orderBy("place").where("toxic = 1").limit(20).collect()]
    assert seen == [40] and max(int(t.split()[-1]) for t in low) > 100
