import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from frameprobe.functions.names import collision_key, safe_folder, safe_stem, without_extension
from frameprobe.operators import paths


def apply(spark, expression, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    return [r.x for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_safe_stems(spark):
    cases = {
        "": "item", "   ...   ": "item", "???:::***": "item", "Salary.": "Salary", "Salary ": "Salary",
        "Customer/Name": "Customer_Name", "Customer:Name": "Customer_Name", "a  b__c": "a_b_c", "_x_": "x",
        "con": "con_", "CON": "CON_", "COM1": "COM1_", "lpt9": "lpt9_", "COM10": "COM10", "On-site": "On-site",
        "München_Temperatur": "München_Temperatur", "東京 支社": "東京_支社", "x²": "x²", "café": "café",
    }
    assert apply(spark, safe_stem, cases) == list(cases.values())


def test_long_names_keep_a_prefix_and_a_hash(spark):
    import hashlib
    names = ["VERY_LONG_" * 8 + "ALPHA", "VERY_LONG_" * 8 + "BETA", "A" * 56, "A" * 55]
    found = apply(spark, safe_stem, names)
    for name, stem in zip(names[:3], found):
        assert stem.endswith("_..._" + hashlib.sha256(name.encode()).hexdigest()[:4].upper())
        assert len(stem) <= 55
    assert found[0] != found[1] and found[2] == "A" * 46 + found[2][46:] and found[3] == "A" * 55


def test_safe_folders(spark):
    cases = {r"folder\subfolder//": "folder/subfolder", "": "plots", "../a/./b": "a/b", "/": "plots",
             "CON/x y": "CON_/x_y", "a/?": "a/plots", " a / b": "a/b"}
    assert apply(spark, safe_folder, cases) == list(cases.values())


def test_collision_keys_and_extensions(spark):
    assert apply(spark, collision_key, ["Salary.png", "café", "café", "Straße"]) == [
        "salary.png", "café", "café", "strasse"]
    assert apply(spark, lambda c: without_extension(c, ".png"), ["a.PNG", "b.png.png", "c"]) == ["a", "b.png", "c"]


def sequential(items):
    """The rule, one name after the other."""
    taken, out = set(), []
    fold = lambda t: unicodedata.normalize("NFC", t).casefold()
    for folder, stem in items:
        number, mark = 1, "" if stem.endswith("_") else "_"
        while True:
            path = f"{folder}/{stem}{'' if number == 1 else f'{mark}{number}'}.png"
            if fold(path) not in taken:
                break
            number += 1
        taken.add(fold(path))
        out.append(path)
    return out


def assigned(spark, items, **options):
    df = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(items)],
                               "position long, folder string, name string").repartition(5)
    return [r.path for r in paths.unique_paths(df, **options).orderBy("position").collect()]


def test_unique_paths_examples(spark):
    assert assigned(spark, [("01_dists", n) for n in ("Salary", "salary", "SALARY")]) == [
        "01_dists/Salary.png", "01_dists/salary_2.png", "01_dists/SALARY_3.png"]
    assert assigned(spark, [("x", "a"), ("x", "a_2"), ("x", "a"), ("y", "a"), ("x", "a.png")]) == [
        "x/a.png", "x/a_2.png", "x/a_3.png", "y/a.png", "x/a_4.png"]
    assert assigned(spark, [("s", "CON"), ("s", "con")]) == ["s/CON_.png", "s/con_2.png"]
    assert assigned(spark, [("x", "café"), ("x", "café")]) == ["x/café.png", "x/café_2.png"]


@pytest.mark.parametrize("family_rows", [50_000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_unique_paths_equal_the_sequential_rule(spark, family_rows, seed):
    """family_rows=0 sends every family through the distributed rounds."""
    rng = random.Random(seed)
    names = ["a", "A", "a_2", "a_3", "A_2", "a_2_2", "b", "b_2", "con", "CON_2"]
    items = [("f" if rng.random() < 0.8 else "g", rng.choice(names)) for _ in range(120)]
    expected = sequential([(f, {"con": "con_"}.get(n, n)) for f, n in items])
    assert assigned(spark, items, family_rows=family_rows) == expected


def test_hot_name_is_numbered_across_partitions(spark):
    df = spark.range(6_000).selectExpr(
        "id AS position", "'f' AS folder",
        "CASE WHEN id % 3 = 0 THEN 'Salary' WHEN id = 4 THEN 'salary_2' ELSE concat('c', id, 'x') END AS name")
    found = paths.unique_paths(df, family_rows=100).orderBy("position").collect()
    assert len({r.path for r in found}) == 6_000
    hot = [r.path for r in found if r.name == "Salary"]
    # Position 3 comes before the natural salary_2 at position 4 and takes that path.
    assert hot[:3] == ["f/Salary.png", "f/Salary_2.png", "f/Salary_3.png"] and hot[-1] == "f/Salary_2000.png"
    assert [r.path for r in found if r.name == "salary_2"] == ["f/salary_2_2.png"]


def test_audit_rules(spark):
    broken = {
        " ": "blank", "a\\b.png": "backslash", "/a.png": "leading_slash", "x/" + "a" * 200: "too_long",
        "a//b.png": "empty_part", "a/./b.png": "empty_part", "a/../b.png": "parent_part", "a /b.png": "trailing_space",
        "a./b.png": "trailing_dot", "a/b .png": "stem_trailing_space", "a/score..png": "stem_trailing_dot",
        "a/ b.png": "leading_space", "a/b?.png": "invalid_character", "a/b\x01.png": "invalid_character",
        "01_dists/CON.png": "reserved_name", "a/lpt1.tar.gz": "reserved_name", "com3/x.png": "reserved_name",
    }
    df = spark.createDataFrame([(p,) for p in broken], "path string")
    found = {}
    for r in paths.path_audit(df).collect():
        found.setdefault(r.path, set()).add(r.rule)
    for path, rule in broken.items():
        assert rule in found[path], path


def test_audit_duplicates(spark):
    df = spark.createDataFrame([("d/Salary.png",), ("d/salary.png",), ("e/x.png",), ("e/x.png",), ("ok/y.png",), ("dir/",)],
                               "path string")
    assert sorted(tuple(r) for r in paths.path_audit(df).collect()) == [
        ("d/Salary.png", "folded_duplicate"), ("d/salary.png", "folded_duplicate"), ("e/x.png", "exact_duplicate")]


def test_check_paths(spark):
    empty = spark.createDataFrame([], "path string")
    paths.check_paths(empty, allow_empty=True)
    with pytest.raises(ValueError, match="empty"):
        paths.check_paths(empty)
    with pytest.raises(ValueError, match="too_long"):
        paths.check_paths(spark.createDataFrame([("folder/" + "a" * 200 + ".png",)], "path string"), max_path_len=100)
    paths.check_paths(spark.createDataFrame([("a/b.png",)], "path string"))


@pytest.mark.parametrize("family_rows", [50_000, 3])
def test_equal_positions_get_a_path_each(spark, family_rows):
    rows = [("p", "a", 1), ("p", "a", 1), ("p", "a_2", 1), ("p", "a", 2), ("p", "b", None), ("p", "b", None), ("p", "b", 7)]
    df = spark.createDataFrame(rows, "folder string, name string, position int")
    out = paths.unique_paths(df, family_rows=family_rows).collect()
    assert len(out) == len(rows) and len({r.path for r in out}) == len(rows)
    assert {r.path for r in out if r.name == "b"} == {"p/b.png", "p/b_2.png", "p/b_3.png"}
    assert [r.path for r in out if r.position == 7] == ["p/b_3.png"]
