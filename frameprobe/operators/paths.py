"""Output paths: unique assignment and audit of a whole table of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from frameprobe.functions.names import (
    INVALID_CHARACTERS, RESERVED_NAMES, STEM_FALLBACK, STEM_LENGTH, collision_key, safe_folder,
    safe_stem, without_extension)
from frameprobe.session import ensure_checkpoint_dir

DEFAULT_EXTENSION = ".png"
MAX_PATH_LENGTH = 180
# Colliding families up to this size are settled in one task each, larger ones in rounds.
FAMILY_ROWS = 50_000


def safe_names(df: DataFrame, name: str, max_len: int = STEM_LENGTH,
               fallback: str = STEM_FALLBACK) -> DataFrame:
    """The table with a ``safe`` stem for its name column."""
    return df.withColumn("safe", safe_stem(F.col(name), max_len, fallback))


def safe_paths(df: DataFrame, folder: str = "folder", name: str = "name",
               extension: str = DEFAULT_EXTENSION, max_len: int = STEM_LENGTH) -> DataFrame:
    """The table with ``safe_folder`` and ``stem``; names lose an extension they already carry."""
    bare = df.withColumn("__bare", without_extension(F.coalesce(F.col(name), F.lit("")), extension))
    return (bare.withColumn("safe_folder", safe_folder(F.coalesce(F.col(folder), F.lit(""))))
            .withColumn("stem", safe_stem(F.col("__bare"), max_len)).drop("__bare"))


# --- unique paths ------------------------------------------------------------------------------

def ranged(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows ranged by key and order, with their partition number ``part`` as data.

    A hot key spreads over many partitions. The rows are checkpointed, because the partition number
    is used more than once and must not change in between.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df.repartitionByRange(*keys, order).withColumn("part", F.spark_partition_id())
            .checkpoint())


def running(rows: DataFrame, keys: list[str], order: str, name: str, combine, value: Column) -> DataFrame:
    """``combine`` (F.sum or F.max) of ``value`` over the earlier and own rows of the key.

    Each range partition runs over its own rows and takes over what the partitions before it hold of
    the same key. Only a partition's first key can start in an earlier one, so no more rows than
    partitions are broadcast.
    """
    valued = rows.withColumn("__value", value)
    own = combine("__value").over(Window.partitionBy("part", *keys).orderBy(order))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (valued.groupBy(*keys, "part").agg(combine("__value").alias("__total"))
               .withColumn("__before", combine("__total").over(before))
               .filter(F.col("__before").isNotNull()).drop("__total"))
    both = (F.coalesce("__before", F.lit(0)) + F.col("__own") if combine is F.sum
            else F.greatest("__before", "__own"))
    return (valued.withColumn("__own", own)
            .join(F.broadcast(earlier), [*keys, "part"], "left")
            .withColumn(name, both).drop("__value", "__own", "__before"))


def unique_paths(df: DataFrame, folder: str = "folder", name: str = "name", position: str = "position",
                 extension: str = DEFAULT_EXTENSION, max_len: int = STEM_LENGTH,
                 family_rows: int = FAMILY_ROWS) -> DataFrame:
    """The table with a ``path`` of its own for every row.

    In order of ``position`` a row takes folder/stem, or the first of stem_2, stem_3, ... that no
    earlier row has, where paths that differ only in case or Unicode form count as equal. Rows can
    only compete when their stems agree up to trailing digits and underscores: such families are
    settled independently. A family over ``family_rows`` is never brought into one task. Rows of one
    position follow each other in the order in which they are read, once; those without one come first.
    """
    safe = safe_paths(df, folder, name, extension, max_len)
    ensure_checkpoint_dir(df.sparkSession)
    keyed = safe.select(
        "*", collision_key(F.col("safe_folder")).alias("__folder"),
        collision_key(F.col("stem")).alias("__stem")
    ).withColumn("__family", F.regexp_replace("__stem", "[_0-9]+$", "")).withColumn(
        "__row", F.monotonically_increasing_id()).checkpoint()
    work = keyed.select("__folder", "__family", "__stem",
                        F.struct(F.col(position).cast("bigint").alias("at"), F.col("__row").alias("row")).alias("position"))
    family = ["__folder", "__family"]
    sizes = work.groupBy(*family).agg(F.count("*").alias("n")).filter(F.col("n") > family_rows)
    if sizes.isEmpty():
        settled = _settle_families(work)
    else:
        large = sizes.select(*family)
        settled = _settle_families(work.join(large, family, "left_anti")).unionByName(
            _settle_rounds(work.join(large, family, "left_semi")))
    suffix = _suffix(F.col("stem"), F.col("__number"))
    return (keyed.join(settled, "__row")
            .withColumn("path", F.concat("safe_folder", F.lit("/"), "stem", suffix, F.lit(extension)))
            .drop("__folder", "__stem", "__family", "__row", "__number", "safe_folder", "stem"))


def _suffix(stem: Column, number: Column) -> Column:
    """'' for the first, then _2, _3, ...; no second underscore after a stem that ends in one."""
    mark = F.when(stem.endswith("_"), F.lit("")).otherwise(F.lit("_"))
    return F.when(number == 1, F.lit("")).otherwise(F.concat(mark, number.cast("string")))


def _settle_families(work: DataFrame) -> DataFrame:
    """(__row, __number) of families that each fit a task.

    A family of one stem, or of stems that do not repeat, is numbered by windows alone. Only where
    copies meet other stems (``a``, ``a``, ``a_2``) does the outcome hang on the sequence.
    """
    family = ["__folder", "__family"]
    whole = Window.partitionBy(*family)
    counted = (
        work.repartition(*family)
        .withColumn("__number", F.row_number().over(
            Window.partitionBy(*family, "__stem").orderBy("position")).cast("bigint"))
        .withColumn("__rows", F.count("*").over(whole))
        .withColumn("__stems", F.count_if(F.col("__number") == 1).over(whole)))
    plain = (F.col("__stems") == 1) | (F.col("__stems") == F.col("__rows"))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "row"], na_position="first")
        taken: set[str] = set()
        reached: dict[str, int] = {}
        numbers = []
        for stem in rows["__stem"]:
            mark = "" if stem.endswith("_") else "_"
            # Taken paths stay taken, so the search goes on where the last equal stem ended.
            number = reached.get(stem, 0) + 1
            while (stem if number == 1 else f"{stem}{mark}{number}") in taken:
                number += 1
            taken.add(stem if number == 1 else f"{stem}{mark}{number}")
            reached[stem] = number
            numbers.append(number)
        return pd.DataFrame({"__row": rows["row"].to_numpy(), "__number": numbers})

    mixed = counted.filter(~plain).select(*family, "__stem", "position.at", "position.row").groupBy(*family).applyInPandas(
        settle, "__row long, __number long")
    return counted.filter(plain).select(F.col("position.row").alias("__row"), "__number").unionByName(mixed)


def _settle_rounds(work: DataFrame) -> DataFrame:
    """(__row, __number) of large families, by rounds over all rows.

    Every row asks for its next candidate: the n-th row of a stem starts with the n-th, as the rows
    before it hold the others. A path asked for by several rows goes to the first; the others move
    on, and push the later rows of their stem along. A refused path stays with an earlier row, so
    the rounds end with the sequential assignment.
    """
    stem = ["__folder", "__stem"]
    rows = ranged(work.select("__folder", "__stem", "position"), stem, "position")
    rows = running(rows, stem, "position", "nth", F.sum, F.lit(1)).withColumn("__number", F.col("nth"))
    while True:
        asked = rows.withColumn("__path", F.concat(
            "__stem", _suffix(F.col("__stem"), F.col("__number"))))
        winners = asked.groupBy("__folder", "__path").agg(
            F.min("position").alias("__winner"), F.count("*").alias("__asked")).filter("__asked > 1")
        judged = asked.join(winners, ["__folder", "__path"], "left").select(
            "__folder", "__stem", "position", "part", "nth",
            (F.col("__number") + F.coalesce((F.col("position") != F.col("__winner")).cast("int"), F.lit(0)))
            .alias("__number"),
            F.coalesce(F.col("position") != F.col("__winner"), F.lit(False)).alias("lost")).checkpoint()
        if judged.filter("lost").isEmpty():
            return judged.select(F.col("position.row").alias("__row"), "__number")
        ahead = running(judged, stem, "position", "ahead", F.max, F.col("__number") - F.col("nth"))
        rows = ahead.select("__folder", "__stem", "position", "part", "nth",
                            (F.col("nth") + F.col("ahead")).alias("__number"))


# --- audit -------------------------------------------------------------------------------------

def path_audit(df: DataFrame, path: str = "path", max_path_len: int = MAX_PATH_LENGTH) -> DataFrame:
    """(path, rule): one row per distinct path and rule it breaks; empty for a sound table.

    Equal paths collapse before anything is compared, so a path that repeats a billion times is one
    row with a count.
    """
    p = F.col("path")
    distinct = df.select(F.coalesce(F.col(path), F.lit("")).alias("path")).groupBy("path").agg(
        F.count("*").alias("copies"))
    keyed = distinct.withColumn("key", collision_key(p))
    clashing = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    folded = keyed.join(clashing, "key", "left_semi").select("path", F.lit("folded_duplicate").alias("rule"))

    blank = p.rlike(r"^\s*$")
    part = F.col("part")
    stem = F.regexp_replace(part, r"\.[^.]*$", "")
    dotted = part.contains(".")
    hollow = part.isin("", ".", "..")
    device = F.upper(F.substring_index(part, ".", 1)).isin(RESERVED_NAMES) | F.upper(part).isin(RESERVED_NAMES)
    whole_rules = F.array(
        F.when(F.col("copies") > 1, "exact_duplicate"),
        F.when(blank, "blank"),
        F.when(~blank & p.contains("\\"), "backslash"),
        F.when(~blank & p.startswith("/"), "leading_slash"),
        F.when(F.length(p) > max_path_len, "too_long"))
    part_rules = F.array(
        F.when(part.isin("", "."), "empty_part"),
        F.when(part == "..", "parent_part"),
        F.when(~hollow & part.endswith(" "), "trailing_space"),
        F.when(~hollow & part.endswith("."), "trailing_dot"),
        F.when(~hollow & dotted & stem.endswith(" "), "stem_trailing_space"),
        F.when(~hollow & dotted & stem.endswith("."), "stem_trailing_dot"),
        F.when(~hollow & part.startswith(" "), "leading_space"),
        F.when(part.rlike(INVALID_CHARACTERS), "invalid_character"),
        F.when(device, "reserved_name"))
    whole = distinct.select("path", F.explode(F.array_compact(whole_rules)).alias("rule"))
    inner = F.regexp_replace(p, "/$", "")
    parts = (distinct.filter(~blank).select("path", F.explode(F.split(inner, "/")).alias("part"))
             .select("path", F.explode(F.array_compact(part_rules)).alias("rule")).distinct())
    return whole.unionByName(folded).unionByName(parts)


def check_paths(df: DataFrame, path: str = "path", max_path_len: int = MAX_PATH_LENGTH,
                allow_empty: bool = False) -> None:
    """Raise ValueError for an empty table or at the first path that breaks a rule."""
    if not allow_empty and df.isEmpty():
        raise ValueError("No output paths: the table is empty.")
    broken = path_audit(df, path, max_path_len).first()
    if broken is not None:
        raise ValueError(f"Output path '{broken.path}' breaks rule {broken.rule}.")
