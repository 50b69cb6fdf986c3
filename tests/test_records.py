import csv as plain
import io
import random

import numpy as np
import pytest

from frameprobe.sources import csv, records


@pytest.fixture
def tiny_splits(spark):
    """File splits of 40 bytes, so that cells cross them."""
    keys = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(r):
    kind = r.randrange(8)
    if kind == 0:
        return '"' + "".join(r.choice(["a", '""', "\n", ",", "\n\n", "é", "x" * 30, "\r\n", " ", '""\n']) for _ in range(r.randrange(6))) + '"'
    if kind == 1:
        return r.choice(['5" pipe', 'a"b"c', 'x""', "it's", "12'6\""])
    return r.choice(["abc", "7", "-1.5", "word " * 3, "z"])


def content(r, rows, end="\n"):
    lines = ["id,a,b" + end]
    for i in range(rows):
        lines.append(f"{i},{cell(r)},{cell(r)}" + end)
        if r.random() < 0.05:
            lines.append(r.choice([end, "  " + end]))
    return "".join(lines)


def expected(text):
    rows = list(plain.reader(io.StringIO(text, newline="")))
    return [r for r in rows if any(c.strip() for c in r)]


@pytest.mark.parametrize("seed", range(4))
def test_records_over_split_borders(spark, tmp_path, tiny_splits, seed):
    r = random.Random(seed)
    want = []
    for n in range(3):
        text = content(r, 40, "\r\n" if seed == 3 else "\n")
        (tmp_path / f"{n}.csv").write_bytes(text.encode())
        want += expected(text)[1:]
    header, rows = records.read_records(spark, str(tmp_path / "*.csv"), ",", "UTF-8")
    assert header == "id,a,b"
    raw = csv.read_text_table(spark, str(tmp_path / "*.csv"), ",", "UTF-8", True)
    assert raw.rdd.getNumPartitions() > 20
    got = [[r.id, r.a, r.b] for r in raw.collect()]
    assert sorted(got, key=repr) == sorted([[c or None for c in row] for row in want], key=repr)
    places = rows.collect()
    assert len({(r.file, r.block, r.at) for r in places}) == len(places) == len(want)


def test_places_follow_the_file(spark, tmp_path, tiny_splits):
    text = content(random.Random(9), 60)
    (tmp_path / "a.csv").write_bytes(text.encode())
    df = csv.load_csv(spark, str(tmp_path / "a.csv"), max_rows=17)
    assert sorted(r.id for r in df.collect()) == list(range(17))


def test_one_cell_over_many_splits(spark, tmp_path, tiny_splits):
    long = "line of text, and more\n" * 40
    (tmp_path / "a.csv").write_text(f'id,a\n1,"{long}"\n2,x\n3,"{long}y"\n4,z\n')
    got = sorted((r.id, r.a) for r in csv.load_csv(spark, str(tmp_path / "a.csv")).collect())
    assert got == [(1, long), (2, "x"), (3, long + "y"), (4, "z")]


def test_header_over_several_lines_and_open_end(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text('\n  \n"id\nnumber, and a long name over splits","b"\n1,2\n3,"never closed\n4,5\n')
    df = csv.load_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id\nnumber, and a long name over splits", "b"]
    assert sorted((r[0], r[1].strip()) for r in df.collect()) == [(1, "2"), (3, "never closed\n4,5")]


def test_stray_quotes_keep_the_plain_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,a\n1,5" pipe\n2,"quoted, whole"\n3,3" x 4"\n')
    lines = spark.read.text(str(tmp_path / "a.csv"))
    assert not csv.detect_layout(lines).multi_line
    assert sorted((r.id, r.a) for r in csv.load_csv(spark, str(tmp_path / "a.csv")).collect()) == [
        (1, '5" pipe'), (2, "quoted, whole"), (3, '3" x 4"')]


def test_latin_1_with_line_breaks(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_bytes('id,a\n1,"Renée\nElève"\n2,"é;"\n'.encode("latin-1"))
    assert sorted((r.id, r.a) for r in csv.load_csv(spark, str(tmp_path / "a.csv")).collect()) == [(1, "Renée\nElève"), (2, "é;")]


def test_states_against_plain_steps():
    r = random.Random(1)
    for _ in range(300):
        n = r.randrange(1, 12)
        opens, stays = ([r.random() < 0.4 for _ in range(n)] for _ in range(2))
        for inside in (False, True):
            now, want = inside, []
            for o, s in zip(opens, stays):
                now = s if now else o
                want.append(now)
            assert records.states(np.array(opens), np.array(stays), inside).tolist() == want


def test_long_lines_of_many_cells(spark):
    line = ",".join(['"a""b, c"', "plain", ""] * 40_000)
    df = spark.createDataFrame([(line,), (line + ',"open',), (line + ',"open""',), (line + ',"shut"',)], "value string")
    assert [r[0] for r in df.select(records.opens_quote(df.value, ",")).collect()] == [False, True, True, False]
