"""Safe output names as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

# Names that Windows reserves for devices, and characters it refuses in a name.
RESERVED_NAMES = (
    ["CON", "PRN", "AUX", "NUL", "CLOCK$", "CONIN$", "CONOUT$"]
    + [f"COM{i}" for i in range(10)] + [f"LPT{i}" for i in range(10)])
INVALID_CHARACTERS = r'[\x00-\x1f\x7f<>:"/\\|?*]'
STEM_LENGTH = 55
FOLDER_LENGTH = 40
TITLE_LENGTH = 60
STEM_FALLBACK = "item"
FOLDER_FALLBACK = "plots"
TRUNCATION_MARK = "_..._"


def _normal_udf():
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.pandas_udf(normal, "string")


def _fold_udf():
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")

    return F.pandas_udf(fold, "string")


def nfc(text: Column) -> Column:
    """Unicode NFC form; no built-in function offers it."""
    return _normal_udf()(text)


def collision_key(path: Column) -> Column:
    """NFC and case folding: paths that one file system would confuse share a key."""
    return _fold_udf()(path)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def stem_of_normal(raw: Column, normal: Column, max_len: int, fallback: str, bind=_let) -> Column:
    """A safe stem from a name and its NFC form."""
    blank = F.coalesce(raw, F.lit("")) == ""
    name = F.when(blank, F.lit(fallback)).otherwise(raw)
    spelled = F.when(blank, F.lit(fallback)).otherwise(normal)
    keep = max(1, max_len - len(TRUNCATION_MARK) - 4)

    def shortened(clean: Column) -> Column:
        mark = F.concat(F.lit(TRUNCATION_MARK), F.upper(F.left(F.sha2(name, 256), F.lit(4))))
        head = F.left(clean, F.lit(keep))
        short = F.regexp_replace(head, r"[._]+$", "")
        cut = F.concat(F.when(short == "", head).otherwise(short), mark)
        return F.when(F.length(clean) > max_len, cut).otherwise(clean)

    def unreserved(trimmed: Column) -> Column:
        clean = F.when(trimmed == "", F.lit(fallback)).otherwise(trimmed)
        return F.when(F.upper(clean).isin(RESERVED_NAMES), F.concat(clean, F.lit("_"))).otherwise(clean)

    kept = F.btrim(F.regexp_replace(spelled, r"[^\p{L}\p{N}\-]+", "_"), F.lit("_"))
    return bind(bind(kept, unreserved), shortened)


def safe_stem(name: Column, max_len: int = STEM_LENGTH, fallback: str = STEM_FALLBACK) -> Column:
    """A file stem that every common file system accepts, cut with a hash mark when too long."""
    return stem_of_normal(name, nfc(name), max_len, fallback)


def folder_parts(folder: Column) -> Column:
    """The parts of a folder path without empty, '.' and '..' ones."""
    whole = F.btrim(F.replace(folder, F.lit("\\"), F.lit("/")), F.lit("/ "))
    return F.filter(F.split(whole, "/"), lambda p: ~p.isin("", ".", ".."))


def safe_folder(folder: Column, max_len: int = FOLDER_LENGTH, fallback: str = FOLDER_FALLBACK) -> Column:
    """A safe folder path: every part is a safe stem; the fallback when no part is left."""
    # Normalising first keeps the Python step outside the array expression; '/' and '.' are ASCII
    # and survive it. The hash mark needs the parts as they were written. Folder parts are short
    # and already inside an array function, so steps are not bound again.
    parts, normal = folder_parts(folder), folder_parts(nfc(folder))
    safe = F.transform(F.arrays_zip(parts.alias("raw"), normal.alias("normal")),
                       lambda p: stem_of_normal(p["raw"], p["normal"], max_len, fallback,
                                                bind=lambda value, use: use(value)))
    return F.when(F.size(F.coalesce(parts, F.array().cast("array<string>"))) == 0, F.lit(fallback)
                  ).otherwise(F.array_join(safe, "/"))


def without_extension(name: Column, extension: str) -> Column:
    """The name without an extension it already carries, in any case."""
    if not extension:
        return name
    carries = F.lower(F.right(name, F.lit(len(extension)))) == extension.lower()
    return F.when(carries, F.left(name, F.length(name) - len(extension))).otherwise(name)
