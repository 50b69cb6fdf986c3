"""The same results in plain SQL, written independently of the operators."""

from __future__ import annotations

import json

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
EVENTS_NUM = ["event_id", "user_id", "value"]
CUSTOMER_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]

ORDERS_GAPS = """(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
    CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate,
    nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)"""


def long(source: str, columns: list[str]) -> str:
    """(column, pos, v) for every non-null numeric value."""
    return "(" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS pos, CAST({c} AS DOUBLE) AS v FROM {source} t{i} "
        f"WHERE {c} IS NOT NULL" for i, c in enumerate(columns)) + ")"


def describe(source: str, columns: list[str]) -> str:
    return f"""SELECT "column", count(v) AS count, round(avg(v), 6) AS mean,
        round(CASE WHEN min(v) = max(v) THEN 0 ELSE stddev_samp(v) END, 6) AS std, min(v) AS min,
        round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
        round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max,
        round(CASE WHEN min(v) = max(v) THEN 0 ELSE skewness(v) END, 6) AS skewness,
        round(CASE WHEN min(v) = max(v) THEN 0 ELSE kurtosis(v) END, 6) AS kurtosis
        FROM {long(source, columns)} GROUP BY "column" """


def box_stats(source: str, columns: list[str]) -> str:
    return f"""(SELECT "column", q25, q50, q75, n, lo, hi, mean, sd,
        q25 - 1.5 * (q75 - q25) AS lower_fence, q75 + 1.5 * (q75 - q25) AS upper_fence
        FROM (SELECT "column", quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
            quantile_cont(v, 0.75) AS q75, count(*) AS n, min(v) AS lo, max(v) AS hi,
            avg(v) AS mean, stddev_samp(v) AS sd
            FROM {long(source, columns)} GROUP BY "column"))"""


def histogram(source: str, columns: list[str]) -> str:
    return f"""WITH b AS (
        SELECT "column", lo, hi, CAST(greatest(1, ceil((hi - lo) / least(
            greatest(2 * (q75 - q25) * pow(n, -1.0 / 3), (hi - lo) / sqrt(n) / 2),
            (hi - lo) / (log2(n) + 1)))) AS INT) AS k
        FROM {box_stats(source, columns)}),
    e AS (SELECT "column", lo, hi, k, (hi - lo) / k AS step, unnest(range(k))::INT AS bin FROM b),
    edges AS (SELECT "column", bin, lo + bin * step AS lo,
        CASE WHEN bin = k - 1 THEN hi ELSE lo + (bin + 1) * step END AS hi, bin = k - 1 AS last FROM e)
    SELECT e."column", e.bin, round(e.lo, 6) AS lo, round(e.hi, 6) AS hi, count(x.v) AS count
    FROM edges e LEFT JOIN (SELECT "column", v FROM {long(source, columns)}) x
        ON x."column" = e."column" AND x.v >= e.lo AND (x.v < e.hi OR (e.last AND x.v <= e.hi))
    GROUP BY ALL"""


def kde(source: str, column: str) -> str:
    return f"""WITH s AS (SELECT min({column}) AS lo, max({column}) AS hi, count({column}) AS n,
        stddev_samp({column}) * pow(count({column}), -0.2) AS h FROM {source}),
    g AS (SELECT unnest(range(200))::INT AS grid, * FROM s),
    x AS (SELECT grid, CASE WHEN grid = 199 THEN hi ELSE lo + grid * ((hi - lo) / 199) END AS x, n, h
        FROM g),
    d AS (SELECT {column} AS v, count(*) AS c FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)
    SELECT '{column}' AS "column", grid, round(x, 6) AS x,
        round(sum(c * exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi())), 6) AS density
    FROM x, d GROUP BY grid, x, n, h"""


def box(source: str, columns: list[str]) -> str:
    return f"""SELECT b."column", b.n AS count, round(q25, 6) AS q25, round(q50, 6) AS q50,
        round(q75, 6) AS q75, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
        round(min(v) FILTER (v >= lower_fence), 6) AS whisker_lo,
        round(max(v) FILTER (v <= upper_fence), 6) AS whisker_hi,
        count(*) FILTER (v < lower_fence OR v > upper_fence) AS outliers
        FROM {box_stats(source, columns)} b JOIN {long(source, columns)} x ON x."column" = b."column"
        GROUP BY b."column", b.n, q25, q50, q75, lower_fence, upper_fence"""


def outliers(source: str, columns: list[str]) -> str:
    return f"""SELECT b."column", round(lower_fence, 6) AS lower_fence,
        round(upper_fence, 6) AS upper_fence, count(*) FILTER (v < lower_fence) AS below,
        count(*) FILTER (v > upper_fence) AS above,
        count(*) FILTER (v < lower_fence OR v > upper_fence) AS outliers
        FROM {box_stats(source, columns)} b JOIN {long(source, columns)} x ON x."column" = b."column"
        GROUP BY b."column", lower_fence, upper_fence"""


def fliers(source: str, columns: list[str]) -> str:
    return f"""SELECT b."column", v AS value FROM {box_stats(source, columns)} b
        JOIN {long(source, columns)} x ON x."column" = b."column"
        WHERE v < lower_fence OR v > upper_fence"""


WIDTH = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8, "boolean": 1}
FAMILY = {"bigint": "numeric", "int": "numeric", "double": "numeric", "timestamp_ntz": "datetime",
          "boolean": "boolean", "string": "string"}
BOOLEAN_WORDS = "('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n')"

EVENTS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
          ("event_type", "string"), ("value", "double"), ("props", "string")]
DOCUMENTS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
             ("n_chars", "bigint")]
CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("c_mktsegment", "string")]
PART = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
        ("p_size", "int"), ("p_retailprice", "double")]
ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
          ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
TYPED = [("order_id", "bigint"), ("is_final", "int"), ("final_count", "int"), ("final", "boolean"),
         ("large", "string"), ("ordered_on", "string"), ("o_orderdate", "timestamp_ntz"),
         ("o_totalprice", "double"), ("o_orderpriority", "string"), ("reference", "string")]
ORDERS_TYPED = f"""(SELECT o_orderkey AS order_id, CAST(o_orderstatus = 'F' AS INT) AS is_final,
    CAST(o_orderstatus = 'F' AS INT) AS final_count, o_orderstatus = 'F' AS final,
    CASE WHEN o_totalprice > 200000 THEN ' Yes' ELSE 'no' END AS large,
    strftime(o_orderdate, '%Y-%m-%d') AS ordered_on, o_orderdate, o_totalprice, o_orderpriority,
    'ref ' || o_orderkey || '/' || o_custkey AS reference FROM {ORDERS_GAPS})"""


def size_bytes(columns) -> str:
    return "CAST(" + " + ".join(
        f"count({c}) * {WIDTH[t]}" if t in WIDTH else f"coalesce(sum(strlen({c})), 0)"
        for c, t in columns) + " AS BIGINT)"


def table_profile(source: str, columns) -> str:
    names = ", ".join(c for c, _ in columns)
    return f"""SELECT rows, {len(columns)}::BIGINT AS columns, size_bytes,
        round_even(size_bytes / 1048576, 2) AS size_mb,
        rows - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source} d)) AS duplicate_rows
        FROM (SELECT count(*) AS rows, {size_bytes(columns)} AS size_bytes FROM {source} s)"""


def missing(source: str, columns, keep_all: bool) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
        f"round_even((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct FROM {source} t{i}"
        for i, (c, _) in enumerate(columns))
    return f"SELECT * FROM ({each})" + ("" if keep_all else " WHERE missing > 0")


def column_profile(source: str, columns) -> str:
    parts = []
    for i, (c, t) in enumerate(columns):
        family = FAMILY[t]
        lower = c.lower()
        flag_name = lower.startswith(("is_", "has_", "flag_")) or lower in ("active", "enabled", "selected")
        id_name = lower.endswith("_id") or lower in ("id", "identifier")
        if family == "numeric":
            typed = (f"CASE WHEN {flag_name} AND min({c}) = 0 AND max({c}) = 1 "
                     f"AND count(DISTINCT {c}) = 2 THEN 'boolean' ELSE 'numeric' END")
        elif family == "string":
            typed = f"""CASE WHEN bool_and(lower(trim({c})) IN {BOOLEAN_WORDS}) THEN 'boolean'
                WHEN bool_and(regexp_matches({c}, '[-/:]') AND try_strptime({c}, '%Y-%m-%d') IS NOT NULL)
                THEN 'datetime'
                WHEN count(DISTINCT {c}) <= 10 OR count(DISTINCT {c}) / count({c}) <= 0.5
                THEN 'categorical' ELSE 'high_cardinality_text' END"""
        else:
            typed = f"'{family}'"
        parts.append(f"""SELECT '{c}' AS "column", {i} AS position, '{t}' AS physical_type,
            CASE WHEN count({c}) = 0 THEN 'high_cardinality_text' ELSE {typed} END AS semantic_type,
            count(DISTINCT {c}) AS d, count(*) AS n, count(*) - count({c}) AS missing,
            {id_name} AS id_name FROM {source} t{i}""")
    return f"""SELECT "column", position, physical_type, semantic_type,
        CASE WHEN semantic_type <> 'datetime' THEN d END AS n_unique, missing,
        round_even(missing / n * 100, 2) AS missing_pct,
        (semantic_type = 'high_cardinality_text' AND d / n > 0.95)
            OR (id_name AND semantic_type <> 'datetime' AND d / n > 0.9) AS is_id
        FROM ({" UNION ALL ".join(parts)})"""


def group_columns(source: str, columns, most: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, count(DISTINCT {c}) AS n_unique, "
        f"{t == 'boolean'} AS always FROM {source} t{i}"
        for i, (c, t) in enumerate(columns) if t in ("string", "boolean"))
    return f"""SELECT "column", position, n_unique FROM ({parts})
        WHERE always OR n_unique BETWEEN 2 AND {most}"""


KIND_COUNTS = """count(*) FILTER (semantic_type = 'numeric') AS numeric_columns,
    count(*) FILTER (semantic_type IN ('categorical', 'boolean') AND NOT is_id) AS categorical_columns"""


def frequencies(source: str, columns: list[tuple[str, str]], most: int) -> str:
    """columns: (name, text expression)."""
    each = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {e} AS value, count(*) AS count,
        sum(count(*)) OVER () AS total, (SELECT count(*) - count({c}) FROM {source} m) AS missing,
        row_number() OVER (ORDER BY count(*) DESC, {e})::INT AS rank,
        least(count(*) OVER (), {most}) AS shown
        FROM {source} t{i} WHERE {c} IS NOT NULL GROUP BY {e}""" for i, (c, e) in enumerate(columns))
    return f"""SELECT "column", value, count, round(count / total * 100, 6) AS pct, rank, missing, shown
        FROM ({each}) WHERE rank <= {most}"""


def crosstab(source: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col1, '{b}' AS col2, {a} AS value1, {b} AS value2, count(*) AS count
        FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"""


def cramers(source: str, pairs: list[tuple[str, str]]) -> str:
    """Full-table chi-square over all cells, the empty ones too."""
    parts = []
    for i, (a, b) in enumerate(pairs):
        rows = f"(SELECT {a} AS a, {b} AS b FROM {source} s WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        parts.append(f"""SELECT {i} AS ord, '{a}' AS col1, '{b}' AS col2, n, r, k, chi2 FROM (
            SELECT max(n) AS n, count(DISTINCT ra.a) AS r, count(DISTINCT cb.b) AS k,
                sum(pow(coalesce(o, 0) - rt * ct / n, 2) / (rt * ct / n)) AS chi2
            FROM (SELECT a, count(*) AS rt FROM {rows} GROUP BY a) ra
            CROSS JOIN (SELECT b, count(*) AS ct FROM {rows} GROUP BY b) cb
            CROSS JOIN (SELECT count(*) AS n FROM {rows})
            LEFT JOIN (SELECT a, b, count(*) AS o FROM {rows} GROUP BY a, b) x
                ON x.a = ra.a AND x.b = cb.b)""")
    return f"""SELECT ord, col1, col2, n, round(chi2, 6) AS chi2,
        CASE WHEN n < 5 OR least(r, k) < 2 THEN -1.0::DOUBLE
        ELSE round(least(1, sqrt(chi2 / (n * (least(r, k) - 1)))), 6) END AS v
        FROM ({" UNION ALL ".join(parts)})"""


GRADES = ["l_returnflag", "l_linestatus", *(f"g{k}" for k in range(20))]


def cramers_of_many() -> str:
    """All pairs of GRADES over rows in long form, chi-square over the whole tables."""
    cells = ", ".join(
        f"CASE WHEN l_partkey % {11 + k} <> 0 THEN 'g' || ((l_orderkey * {k + 3} + l_suppkey + l_linenumber * {k}) % {2 + k % 8}) END"
        for k in range(20))
    return f"""WITH s AS (SELECT row_number() OVER () AS id, [l_returnflag, l_linestatus, {cells}] AS vs FROM lineitem),
    l AS (SELECT id, unnest(range(1, 23)) AS pos, unnest(vs) AS v FROM s),
    o AS (SELECT a.pos AS pa, b.pos AS pb, a.v AS va, b.v AS vb, count(*) AS o FROM l a JOIN l b ON a.id = b.id
          AND a.pos < b.pos AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL),
    r AS (SELECT pa, pb, va, sum(o) AS rt FROM o GROUP BY ALL), c AS (SELECT pa, pb, vb, sum(o) AS ct FROM o GROUP BY ALL),
    t AS (SELECT pa, pb, sum(o) AS n, count(DISTINCT va) AS rows, count(DISTINCT vb) AS cols FROM o GROUP BY ALL),
    x AS (SELECT pa, pb, any_value(n)::BIGINT AS n, any_value(least(rows, cols)) AS k,
                 sum(pow(coalesce(o, 0) - rt * ct / n, 2) / (rt * ct / n)) AS chi2
          FROM r JOIN c USING (pa, pb) JOIN t USING (pa, pb) LEFT JOIN o USING (pa, pb, va, vb) GROUP BY ALL)
    SELECT {GRADES}[pa] AS col1, {GRADES}[pb] AS col2, n, round(chi2, 6) AS chi2,
        round(least(1, sqrt(chi2 / (n * (k - 1)))), 6) AS v FROM x"""


WIDE_LINEITEM = "(SELECT {} FROM lineitem)".format(", ".join(
    [f"(l_partkey % {k + 7} + l_linenumber * {k})::DOUBLE AS n{k}" for k in range(30)]
    + [f"l_quantity * {k} + l_suppkey % {k} AS n{k}" for k in range(30, 50)]))


def report_rows() -> str:
    """Rows of each table of the report on lineitem: two flags, no gaps."""
    n = len(LINEITEM_NUM)
    pairs = n * (n - 1) // 2
    numbers = {"summary": n, "curves": 200 * n, "markers": n, "boxplots": n, "cats": "a + b", "corr": pairs + n,
               "scatters": pairs, "scatter_points": f"{pairs} * sampled", "scatter_bands": 100 * pairs, "cat_num": 2 * n,
               "cat_num_boxes": f"{n} * (a + b)", "cat_cat": 1, "cat_cat_cells": "a * b", "columns": n + 3, "overview": 1,
               "manifest": 2 + 2 * n + 2 + pairs + 2 * n + 1}
    parts = [f"SELECT '{name}' AS name, ({value})::BIGINT AS rows FROM f" for name, value in numbers.items()]
    parts.append(f"SELECT 'dists', count(*) FROM ({histogram('lineitem', LINEITEM_NUM)})")
    return f"""WITH f AS (SELECT count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b,
        least(count(*), 1500) AS sampled FROM lineitem) {" UNION ALL ".join(parts)}"""


TREND_BAND = """WITH s AS (SELECT p_retailprice::DOUBLE AS x, p_partkey::DOUBLE AS y FROM part
        WHERE p_retailprice IS NOT NULL AND p_partkey IS NOT NULL),
    h AS (SELECT x, y, ('0x' || substr(md5('p_retailprice|p_partkey|' || x || '|' || y), 1, 16))::UBIGINT AS h FROM s),
    a AS (SELECT x, y, draw, ((h::UHUGEINT + draw::UHUGEINT * 11400714819323198485) % 18446744073709551616)::UBIGINT AS z
          FROM h, (SELECT unnest(range(1001)) AS draw)),
    b AS (SELECT x, y, draw, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929) % 18446744073709551616)::UBIGINT AS z FROM a),
    c AS (SELECT x, y, draw, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931) % 18446744073709551616)::UBIGINT AS z FROM b),
    k AS (SELECT k, sum(exp(-1) / factorial(k::INTEGER)) OVER (ORDER BY k) AS chance FROM (SELECT unnest(range(20)) AS k)),
    w AS (SELECT x, y, draw, CASE WHEN draw = 0 THEN 1 ELSE len(list_filter((SELECT list(chance) FROM k),
              lambda q: q <= xor(z, z >> 31)::DOUBLE / 18446744073709551616)) END AS w FROM c),
    m AS (SELECT draw, sum(w)::DOUBLE AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
          FROM w GROUP BY draw),
    l AS (SELECT draw, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS slope, sx, sy, n FROM m),
    g AS (SELECT unnest(range(100))::INTEGER AS grid, min(x) AS lo, max(x) AS hi FROM s),
    f AS (SELECT draw, grid, lo + grid * (hi - lo) / 99 AS x,
                 (sy - slope * sx) / n + slope * (lo + grid * (hi - lo) / 99) AS fit FROM l, g)
    SELECT 'p_retailprice' AS col1, 'p_partkey' AS col2, grid, round(any_value(x), 4) AS x,
           round(max(fit) FILTER (draw = 0), 4) AS y, round(quantile_cont(fit, 0.025) FILTER (draw > 0), 4) AS lower,
           round(quantile_cont(fit, 0.975) FILTER (draw > 0), 4) AS upper FROM f GROUP BY grid"""

LINEITEM_TYPES = [["l_orderkey", "bigint"], ["l_partkey", "bigint"], ["l_suppkey", "bigint"], ["l_linenumber", "int"],
                  ["l_quantity", "double"], ["l_extendedprice", "double"], ["l_discount", "double"], ["l_tax", "double"],
                  ["l_returnflag", "string"], ["l_linestatus", "string"], ["l_shipdate", "timestamp_ntz"]]


def fingerprint() -> str:
    text = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c, _ in LINEITEM_TYPES)
    lanes = " || '|' || ".join(
        f"(sum(('0x' || substr(d, {1 + 16 * k}, 16))::UBIGINT) % 18446744073709551616::HUGEINT)::VARCHAR" for k in range(4))
    return f"""SELECT sha256({lanes} || '|' || count(*) || '|' || '{json.dumps(LINEITEM_TYPES)}' || '|lineitem') AS fingerprint
        FROM (SELECT sha256({text}) AS d FROM lineitem)"""


def eta(source: str, cats: list[str], nums: list[str]) -> str:
    parts = []
    for i, c in enumerate(cats):
        for j, x in enumerate(nums):
            rows = (f"(SELECT {c} AS g, CAST({x} AS DOUBLE) AS v FROM {source} s "
                    f"WHERE {c} IS NOT NULL AND {x} IS NOT NULL)")
            parts.append(f"""SELECT {i} AS cat, {j} AS num, '{c}' AS cat_col, '{x}' AS num_col,
                (SELECT count(*) FROM {rows}) AS n,
                CASE WHEN (SELECT count(*) < 5 OR count(DISTINCT g) < 2 FROM {rows}) THEN -1.0
                WHEN (SELECT min(v) = max(v) FROM {rows}) THEN 0.0
                ELSE (SELECT sum(k * pow(m - (SELECT avg(v) FROM {rows}), 2)) FROM
                    (SELECT count(*) AS k, avg(v) AS m FROM {rows} GROUP BY g))
                    / (SELECT var_pop(v) * count(*) FROM {rows}) END AS score""")
    return f"(SELECT cat, num, cat_col, num_col, n, score FROM ({' UNION ALL '.join(parts)}))"


def grouped_box(source: str, pairs: list[tuple[str, str]]) -> str:
    parts = []
    for c, x in pairs:
        parts.append(f"""SELECT '{c}' AS cat_col, '{x}' AS num_col, b.value, b.rank, b.n AS count, q25,
            q50, q75, lower_fence, upper_fence, min(v) FILTER (v >= lower_fence) AS whisker_lo,
            max(v) FILTER (v <= upper_fence) AS whisker_hi,
            count(*) FILTER (v < lower_fence OR v > upper_fence) AS outliers
            FROM (SELECT *, q25 - 1.5 * (q75 - q25) AS lower_fence, q75 + 1.5 * (q75 - q25) AS upper_fence
                FROM (SELECT {c} AS value, count(*) AS n, quantile_cont({x}, 0.25) AS q25,
                    quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75,
                    row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank
                    FROM {source} s WHERE {c} IS NOT NULL AND {x} IS NOT NULL GROUP BY {c})
                WHERE rank <= 8) b
            JOIN (SELECT {c} AS g, {x} AS v FROM {source} y WHERE {x} IS NOT NULL) r ON r.g = b.value
            GROUP BY ALL""")
    return f"""SELECT cat_col, num_col, value, rank, count, round(q25, 6) AS q25, round(q50, 6) AS q50,
        round(q75, 6) AS q75, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
        round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi, outliers
        FROM ({" UNION ALL ".join(parts)})"""


def pairs_of(source: str, columns: list[str], diagonal: bool) -> str:
    """Regression terms of every pair x = columns[i], y = columns[j], i > j (or >=)."""
    parts = []
    for i, x in enumerate(columns):
        for j, y in enumerate(columns[:i + 1] if diagonal else columns[:i]):
            parts.append(f"""SELECT {i} AS pos1, {j} AS pos2, '{x}' AS col1, '{y}' AS col2,
                CAST(regr_count({y}, {x}) AS BIGINT) AS n,
                CASE WHEN min({x}) FILTER ({y} IS NOT NULL) = max({x}) FILTER ({y} IS NOT NULL)
                    OR min({y}) FILTER ({x} IS NOT NULL) = max({y}) FILTER ({x} IS NOT NULL) THEN NULL
                    WHEN {i} = {j} THEN 1.0::DOUBLE
                    ELSE regr_sxy({y}, {x}) / sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})) END AS r,
                CASE WHEN min({x}) FILTER ({y} IS NOT NULL) < max({x}) FILTER ({y} IS NOT NULL)
                    THEN regr_slope({y}, {x}) END AS slope,
                CASE WHEN min({x}) FILTER ({y} IS NOT NULL) < max({x}) FILTER ({y} IS NOT NULL)
                    THEN regr_intercept({y}, {x}) END AS intercept
                FROM {source} t WHERE {x} IS NOT NULL AND {y} IS NOT NULL""")
    return "(" + " UNION ALL ".join(parts) + ")"


def correlation(source: str, columns: list[str]) -> str:
    return f"""SELECT col1, col2, n, round(r, 6) AS r FROM {pairs_of(source, columns, True)}"""


TREND = """round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r * r, 6) AS r2"""
ORDERS_COSTLY = f"(SELECT *, o_totalprice > 300000 AS costly FROM {ORDERS_GAPS})"
COSTLY_TEXT = "CASE WHEN costly THEN 'True' ELSE 'False' END"
ORDERS_CORR = f"""(SELECT o_orderkey, o_custkey, o_totalprice, length(o_orderpriority) AS width,
    CASE WHEN o_totalprice IS NULL THEN 0.1 END AS mark, 0.1 AS flat FROM {ORDERS_GAPS})"""


def draw(*texts: str) -> str:
    return (f"('0x' || substr(md5(concat_ws('|', {', '.join(texts)}, '42')), 1, 13))::BIGINT"
            " / 4503599627370496.0::DOUBLE")


PART_DRAW = draw("p_partkey::VARCHAR", "p_size::VARCHAR", "round(p_retailprice * 100)::BIGINT::VARCHAR")
PART_SAMPLE = f"(SELECT * FROM part ORDER BY {PART_DRAW}, p_partkey, p_size, p_retailprice LIMIT 1500)"


def delimiters(lines: str) -> str:
    """Scores over a query that yields the lines as ``value``."""
    each = " UNION ALL ".join(
        f"""SELECT {i} AS choice, '{d}' AS delimiter, length(u) - length(replace(u, '{d}', '')) AS hits
        FROM (SELECT regexp_replace(value, '"[^"]*"', '', 'g') AS u FROM ({lines}) WHERE trim(value) <> '')"""
        for i, d in enumerate([",", ";", "\t", "|"]))
    return f"""WITH c AS (SELECT choice, delimiter, hits, count(*) AS n,
            sum(count(*)) OVER (PARTITION BY choice) AS total FROM ({each}) GROUP BY choice, delimiter, hits),
        b AS (SELECT choice, delimiter, max(total) AS total, max(n) FILTER (hits > 0) AS n,
            max_by(hits, n * 1000000 + hits) FILTER (hits > 0) AS hits FROM c GROUP BY choice, delimiter)
        SELECT delimiter, CAST(coalesce(hits + 1, 1) AS INT) AS fields,
            coalesce(round(n / total, 6), 0)::DOUBLE AS share,
            row_number() OVER (ORDER BY coalesce(n / total, 0) DESC, choice)::INT AS rank FROM b"""


RESERVED = ("('CON','PRN','AUX','NUL','CLOCK$','CONIN$','CONOUT$',"
            + ",".join(f"'{p}{i}'" for p in ("COM", "LPT") for i in range(10)) + ")")


def safe(name: str, most: int, fallback: str) -> str:
    """Safe stem of a SQL text expression."""
    kept = (f"trim(regexp_replace(nfc_normalize({name}), '[^\\p{{L}}\\p{{N}}-]+', '_', 'g'), '_')")
    clean = f"coalesce(nullif({kept}, ''), '{fallback}')"
    clean = f"CASE WHEN upper({clean}) IN {RESERVED} THEN {clean} || '_' ELSE {clean} END"
    return f"""CASE WHEN length({clean}) > {most} THEN
        regexp_replace(left({clean}, {most - 9}), '[._]+$', '') || '_..._' ||
        upper(left(sha256({name}), 4)) ELSE {clean} END"""


def audit(paths: str, most: int) -> str:
    part_rules = [
        ("empty_part", "part IN ('', '.')"), ("parent_part", "part = '..'"),
        ("trailing_space", "part NOT IN ('', '.', '..') AND part LIKE '% '"),
        ("trailing_dot", "part NOT IN ('', '.', '..') AND part LIKE '%.'"),
        ("stem_trailing_space", "part NOT IN ('', '.', '..') AND regexp_matches(part, ' \\.[^.]*$')"),
        ("stem_trailing_dot", "part NOT IN ('', '.', '..') AND regexp_matches(part, '\\.\\.[^.]*$')"),
        ("leading_space", "part NOT IN ('', '.', '..') AND part LIKE ' %'"),
        ("invalid_character", "regexp_matches(part, '[\\x00-\\x1f\\x7f<>:\"/\\\\|?*]')"),
        ("reserved_name", f"upper(split_part(part, '.', 1)) IN {RESERVED} OR upper(part) IN {RESERVED}")]
    parts = " UNION ".join(f"SELECT path, '{r}' AS rule FROM parts WHERE {w}" for r, w in part_rules)
    return f"""WITH p AS ({paths}), d AS (SELECT path, count(*) AS copies FROM p GROUP BY path),
        parts AS (SELECT path, unnest(string_split(regexp_replace(path, '/$', ''), '/')) AS part FROM d
            WHERE trim(path) <> '')
        SELECT path, 'exact_duplicate' AS rule FROM d WHERE copies > 1
        UNION SELECT path, 'blank' FROM d WHERE trim(path) = ''
        UNION SELECT path, 'folded_duplicate' FROM d WHERE lower(path) IN
            (SELECT lower(path) FROM d GROUP BY 1 HAVING count(*) > 1)
        UNION SELECT path, 'backslash' FROM d WHERE contains(path, chr(92))
        UNION SELECT path, 'leading_slash' FROM d WHERE path LIKE '/%'
        UNION SELECT path, 'too_long' FROM d WHERE length(path) > {most}
        UNION {parts}"""


TEXT_ORDERS = f"""(SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey,
    o_orderstatus, o_totalprice::VARCHAR AS o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority,
    CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'false' END AS closed,
    CASE WHEN o_totalprice < 20000 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END
        AS mostly_date,
    CASE WHEN o_totalprice < 100000 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END
        AS partly_date, o_orderkey || 'd' AS with_unit,
    CASE WHEN o_orderstatus = 'F' THEN 'N/A' ELSE o_custkey::VARCHAR END AS half FROM {ORDERS_GAPS})"""


def csv_types(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN count(v) = 0 THEN 'double'
        WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN
            CASE WHEN count(v) = count(*) THEN 'bigint' ELSE 'double' END
        WHEN bool_and(regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')) THEN 'double'
        WHEN bool_and(v IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')) THEN 'boolean'
        WHEN count(v) >= 5 AND count(try_strptime(v, '%Y-%m-%d %H:%M:%S')) / count(v) >= 0.9 THEN 'timestamp'
        ELSE 'string' END AS verdict
        FROM (SELECT CASE WHEN {c} NOT IN ('', 'NA', 'N/A') THEN {c} END AS v FROM {source} s)"""
        for c in columns)


URL_PARTS = "list_filter(string_split(trim(url, '/ '), '/'), lambda p: p NOT IN ('', '.', '..'))"


SECTIONS = [("summary", "00_summary"), ("missing", "00_summary"),
            ("dists", "01_univariate_numeric_distributions"), ("boxplots", "02_outlier_boxplots"),
            ("cats", "03_categorical_distributions"), ("corr", "04_correlation_heatmap"),
            ("scatters", "05_numeric_relationships"), ("cat_num", "06_cat_vs_numeric"),
            ("cat_cat", "07_cat_vs_cat")]


def manifest(source: str, nums: list[str], cats: list[str], cap: int) -> str:
    """Manifest of a table whose names are safe and whose text columns all group."""
    items = ["SELECT 0 AS s, 0 AS i, 'summary_statistics_table' AS name, 'Summary Statistics Table' AS title, "
             "'summary_statistics' AS download"]
    every = ", ".join(nums + cats)
    items.append(f"""SELECT 1, 0, 'missing_values_breakdown', 'Missing Values Breakdown (%)', 'missing_values'
        WHERE EXISTS (SELECT * FROM {source} m WHERE concat_ws('', {every}) IS NULL OR
            {" OR ".join(f"{c} IS NULL" for c in nums + cats)})""")
    for i, c in enumerate(nums):
        items.append(f"SELECT 2, {i}, 'dist_{c}', 'Distribution: {c}', 'distribution_{c}'")
        items.append(f"SELECT 3, {i}, 'boxplot_{c}', 'Boxplot: {c}', 'boxplot_{c}'")
    for i, c in enumerate(cats):
        items.append(f"""SELECT 4, {i}, 'cat_distribution_{i + 1}', 'Frequency: {c} (Top ' || least(15, count(DISTINCT {c}))
            || CASE WHEN count({c}) < count(*) THEN ', ' || (count(*) - count({c})) || ' missing' ELSE '' END || ')',
            'cat_dist_{i + 1}' FROM {source} c{i}""")
    items.append("SELECT 5, 0, 'correlation_matrix', 'Correlation Matrix', 'correlation_heatmap'")
    items.append(f"""SELECT 6, k, 'scatter_pair_' || k, format('{{}} vs {{}} (r = {{:+.2f}})', col1, col2, r),
        'scatter_pair_' || k FROM (SELECT *, row_number() OVER (ORDER BY abs(round(r, 12)) DESC, pos1, pos2)::INT AS k
            FROM {pairs_of(source, nums, False)} WHERE r IS NOT NULL) WHERE k <= 50""")
    items.append(f"""SELECT 7, k, 'cat_num_' || num_col || '_by_' || cat_col,
        format('{{}} by {{}} (η² = {{:.2f}})', num_col, cat_col, score), 'cat_num_' || num_col || '_by_' || cat_col
        FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, cat, num)::INT AS k
            FROM {eta(source, cats, nums)} WHERE score >= 0) WHERE k <= 60""")
    pairs = [(a, b) for i, a in enumerate(cats) for b in cats[i + 1:]]
    items.append(f"""SELECT 8, k, 'cat_cat_' || col1 || '_vs_' || col2,
        format('{{}} vs {{}} (Cramér''s V = {{:.2f}})', col1, col2, v), 'cat_cat_' || col1 || '_vs_' || col2
        FROM (SELECT *, row_number() OVER (ORDER BY round(v, 12) DESC, ord)::INT AS k FROM ({cramers(source, pairs)})
            WHERE v >= 0) WHERE k <= 30""")
    sections = ", ".join(f"({i}, '{s}', '{f}')" for i, (s, f) in enumerate(SECTIONS))
    return f"""SELECT ordinal, section, folder, name, title, download, folder || '/' || name || '.png' AS path
        FROM (SELECT *, row_number() OVER (ORDER BY s, i)::INT AS ordinal FROM ({" UNION ALL ".join(items)}))
        JOIN (VALUES {sections}) AS x(number, section, folder) ON number = s WHERE ordinal <= {cap}"""


def build() -> dict[str, str]:
    return {
        "describe_lineitem": describe("lineitem", LINEITEM_NUM),
        "describe_orders_gaps": describe(ORDERS_GAPS, ORDERS_NUM),
        "hist_lineitem": histogram("lineitem", LINEITEM_NUM),
        "hist_orders_gaps": histogram(ORDERS_GAPS, ORDERS_NUM),
        "markers_orders": f"""SELECT "column", round(mean, 6) AS mean, round(q50, 6) AS median
            FROM {box_stats("orders", ORDERS_NUM)}""",
        "kde_lineitem_quantity": kde("lineitem", "l_quantity"),
        "kde_customer": kde("customer", "c_acctbal"),
        "box_lineitem": box("lineitem", LINEITEM_NUM),
        "outliers_events": outliers("events", EVENTS_NUM),
        "fliers_events": fliers("events", EVENTS_NUM),
        "fliers_customer": fliers("customer", CUSTOMER_NUM),
        "table_profile_events": table_profile("events", EVENTS),
        "table_profile_documents": table_profile("documents", DOCUMENTS),
        "missing_orders_nulls": missing(ORDERS_GAPS, ORDERS, False),
        "missing_counts_orders": missing(ORDERS_GAPS, ORDERS, True),
        "duplicate_rows_labels": """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM
            (SELECT DISTINCT quality, toxic FROM labels)) AS duplicate_rows FROM labels""",
        "duplicate_rows_lineitem": """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM
            (SELECT DISTINCT l_quantity, l_discount, l_tax, nullif(l_returnflag, 'N'),
            nullif(l_linestatus, 'F') FROM lineitem)) AS duplicate_rows FROM lineitem""",
        "column_profile_customer": column_profile("customer", CUSTOMER),
        "column_profile_documents": column_profile("documents", DOCUMENTS),
        "column_profile_events": column_profile("events", EVENTS),
        "column_profile_orders_typed": column_profile(ORDERS_TYPED, TYPED),
        "id_columns_part": f"""SELECT "column", position FROM ({column_profile("part", PART)})
            WHERE is_id""",
        "id_columns_events": f"""SELECT "column", position FROM ({column_profile("events", EVENTS)})
            WHERE is_id""",
        "group_columns_lineitem": group_columns(
            "lineitem", [("l_returnflag", "string"), ("l_linestatus", "string")], 25
        ).replace("0 AS position", "8 AS position").replace("1 AS position", "9 AS position"),
        "group_columns_part": group_columns(
            "(SELECT *, p_retailprice > 1000 AS costly FROM part)", [*PART, ("costly", "boolean")], 30),
        "numeric_columns_lineitem": """SELECT "column", pos AS position, count(*) AS non_null FROM """
            + long("lineitem", LINEITEM_NUM) + """ GROUP BY "column", pos""",
        "complete_rows_orders": f"""SELECT * FROM {ORDERS_GAPS}
            WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL""",
        "exclude_ids_events": f"""SELECT "column", position, semantic_type FROM
            ({column_profile("events", EVENTS)}) WHERE NOT is_id""",
        "overview_orders": f"""SELECT rows, columns, numeric_columns, categorical_columns, size_bytes,
            size_mb, duplicate_rows FROM ({table_profile("orders", ORDERS)}),
            (SELECT {KIND_COUNTS} FROM ({column_profile("orders", ORDERS)}))""",
        "category_freq_lineitem": frequencies(
            "lineitem", [("l_returnflag", "l_returnflag"), ("l_linestatus", "l_linestatus")], 15),
        "category_freq_events": frequencies("events", [("event_type", "event_type")], 15),
        "category_freq_orders_gaps": frequencies(
            ORDERS_COSTLY, [("o_orderstatus", "o_orderstatus"), ("o_orderpriority", "o_orderpriority"),
                            ("costly", COSTLY_TEXT)], 3),
        "crosstab_lineitem": crosstab("lineitem", "l_returnflag", "l_linestatus"),
        "crosstab_part_names": crosstab("part", "p_name", "p_brand"),
        "crosstab_pct_documents": """SELECT 'lang' AS col1, 'source' AS col2, value1, value2,
            count(text) AS count, round(count(text) / sum(count(text)) OVER (PARTITION BY value1) * 100, 6)
            AS pct FROM (SELECT DISTINCT lang AS value1 FROM documents)
            CROSS JOIN (SELECT DISTINCT source AS value2 FROM documents)
            LEFT JOIN documents ON lang = value1 AND source = value2 GROUP BY value1, value2""",
        "cramers_lineitem": f"""SELECT col1, col2, n, chi2, v FROM
            ({cramers("lineitem", [("l_returnflag", "l_linestatus")])})""",
        "cramers_rank_orders": f"""SELECT col1, col2, n, chi2, v,
            row_number() OVER (ORDER BY round(v, 12) DESC, ord)::INT AS rank FROM
            ({cramers(ORDERS_COSTLY, [("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "costly"),
                                      ("o_orderpriority", "costly")])})""",
        "cramers_many_lineitem": cramers_of_many(),
        "distinct_states_orders": " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS exact, true AS held
            FROM orders""" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")),
        "markers_wide_lineitem": f"""SELECT "column", round(mean, 6) AS mean, round(q50, 6) AS median
            FROM {box_stats(WIDE_LINEITEM, [f"n{k}" for k in range(50)])}""",
        "written_report_lineitem": report_rows(),
        "csv_headers_orders": """SELECT o_orderkey AS key, o_custkey AS x, o_orderstatus AS x_2, o_orderpriority AS x_1,
            o_totalprice AS "Unnamed: 4" FROM orders""",
        "trend_band_retail": TREND_BAND,
        "fingerprint_lineitem": fingerprint(),
        "eta_lineitem": f"""SELECT cat_col, num_col, n, round(score, 6) AS score FROM
            {eta("lineitem", ["l_returnflag", "l_linestatus"], LINEITEM_NUM)}""",
        "eta_many_lineitem": f"""SELECT cat_col, num_col, n, round(score, 6) AS score FROM {eta(
            """(SELECT *, l_linenumber::VARCHAR AS line, month(l_shipdate)::VARCHAR AS month,
            day(l_shipdate)::VARCHAR AS day FROM lineitem)""",
            ["l_returnflag", "l_linestatus", "line", "month", "day"],
            ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])}""",
        "eta_rank_orders": f"""SELECT cat_col, num_col, n, round(score, 6) AS score,
            row_number() OVER (ORDER BY round(score, 12) DESC, cat, num)::INT AS rank FROM
            {eta(ORDERS_COSTLY, ["o_orderstatus", "o_orderpriority", "costly"], ORDERS_NUM)}""",
        "eta_rank_part": f"""SELECT cat_col, num_col, n, round(score, 6) AS score,
            row_number() OVER (ORDER BY round(score, 12) DESC, cat, num)::INT AS rank FROM
            {eta("part", ["p_type"], ["p_partkey", "p_size", "p_retailprice"])}""",
        "grouped_box_lineitem": grouped_box(
            "lineitem", [("l_returnflag", "l_extendedprice"), ("l_linestatus", "l_quantity")]),
        "grouped_box_part": grouped_box("part", [("p_brand", "p_retailprice")]),
        "corr_lineitem": correlation("lineitem", LINEITEM_NUM),
        "corr_orders_gaps": correlation(
            ORDERS_CORR, ["o_orderkey", "o_custkey", "o_totalprice", "width", "mark", "flat"]),
        "corr_topvar_lineitem": f"""WITH v AS (SELECT "column" AS c,
                row_number() OVER (ORDER BY var_samp(v) DESC, pos) AS k
                FROM {long("lineitem", LINEITEM_NUM)} GROUP BY "column", pos)
            SELECT CASE WHEN a.k >= b.k THEN col1 ELSE col2 END AS col1,
                CASE WHEN a.k >= b.k THEN col2 ELSE col1 END AS col2, n, round(r, 6) AS r
            FROM {pairs_of("lineitem", LINEITEM_NUM, True)} p JOIN v a ON a.c = col1 JOIN v b ON b.c = col2
            WHERE a.k <= 4 AND b.k <= 4""",
        "top_variance_lineitem": f"""SELECT "column", pos AS position,
            round(var_samp(v), 4) AS variance FROM {long("lineitem", LINEITEM_NUM)}
            GROUP BY "column", pos ORDER BY var_samp(v) DESC LIMIT 5""",
        "pair_rank_lineitem": f"""SELECT col1, col2, n, round(r, 6) AS r, {TREND},
            row_number() OVER (ORDER BY abs(round(r, 12)) DESC, pos1, pos2)::INT AS rank
            FROM {pairs_of("lineitem", LINEITEM_NUM, False)}""",
        "trend_lineitem": f"""SELECT col1, col2, n, round(r, 6) AS r, {TREND}
            FROM {pairs_of("lineitem", LINEITEM_NUM, False)}""",
        "sample_orders": f"""SELECT * FROM orders ORDER BY {draw(
            "o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus",
            "round(o_totalprice * 100)::BIGINT::VARCHAR", "o_orderpriority")},
            o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority LIMIT 60""",
        "scatter_part": " UNION ALL ".join(
            f"SELECT '{x}' AS col1, 'p_partkey' AS col2, round({x}::DOUBLE, 6) AS x, p_partkey::DOUBLE AS y "
            f"FROM {PART_SAMPLE}" for x in ("p_retailprice", "p_size")),
        "csv_roundtrip_orders": f"SELECT * FROM {ORDERS_GAPS}",
        "csv_roundtrip_customer": """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
            c_acctbal, c_mktsegment FROM customer""",
        "csv_roundtrip_documents": "SELECT * FROM documents",
        "csv_latin1_customer": """SELECT c_custkey, c_name || ' Renée' AS c_name,
            CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
        "csv_max_rows_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 700",
        "csv_guards_orders": """SELECT input, CASE input WHEN 'sound' THEN n = 0 WHEN 'surplus' THEN odd > 0
            ELSE n > 0 END AS refused FROM (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS odd
            FROM orders), (SELECT unnest(['sound', 'headers', 'surplus', 'blank', 'no_rows', 'size']) AS input)""",
        "datetime_formats_orders": """SELECT o_orderkey, moment AS iso_utc, moment - INTERVAL 2 HOUR AS iso_offset,
            date_trunc('minute', moment) AS half_day, date_trunc('day', moment) AS short_year,
            moment + INTERVAL 500 MILLISECOND AS tenths, date_trunc('day', moment) AS named_month,
            date_trunc('minute', moment) AS slashed_minutes,
            TIMESTAMP '1970-01-01' + (moment - date_trunc('day', moment)) AS clock
            FROM (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS moment FROM orders)""",
        "csv_types_orders": csv_types(TEXT_ORDERS, [
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
            "closed", "mostly_date", "partly_date", "with_unit", "half"]),
        "datetime_probe_orders": f"""SELECT o_orderkey::BIGINT AS o_orderkey,
            try_strptime(mostly_date, '%Y-%m-%d %H:%M:%S') AS mostly_date FROM {TEXT_ORDERS}""",
        "delimiter_pick": delimiters("""SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey,
            l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
            strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS value FROM lineitem"""),
        "delimiter_pick_documents": delimiters(
            "SELECT unnest(string_split(text, chr(10))) AS value FROM documents"),
        "safe_names_pages": f"SELECT page_id, url AS input, {safe('url', 55, 'item')} AS safe FROM pages",
        "safe_names_documents": f"SELECT doc_id, {safe('text', 55, 'item')} AS safe FROM documents",
        "safe_folders_pages": f"""SELECT page_id, string_agg(safe, '/' ORDER BY place) AS safe_folder
            FROM (SELECT page_id, place, {safe("part", 40, "plots")} AS safe FROM (
                SELECT page_id, unnest({URL_PARTS}) AS part, unnest(range(len({URL_PARTS}))) AS place
                FROM pages)) GROUP BY page_id""",
        "unique_paths_part": f"""SELECT position, folder, name, folder || '/' || stem ||
            CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.png' AS path FROM (
                SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY position) AS n FROM (
                    SELECT p_partkey AS position, p_type AS folder, p_name AS name,
                        {safe("p_name", 55, "item")} AS stem FROM part))""",
        "path_audit_pages": audit("SELECT regexp_replace(url, '^https?:', '') AS path FROM pages", 40),
        "path_audit_part": audit("""SELECT CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END
            || '/' || p_brand || CASE WHEN p_size < 5 THEN '.' WHEN p_size = 7 THEN ' ' ELSE '.png' END
            AS path FROM part""", 180),
        "report_manifest_lineitem": manifest("lineitem", LINEITEM_NUM, ["l_returnflag", "l_linestatus"], 100),
        "report_manifest_orders_capped": manifest(
            ORDERS_GAPS, ORDERS_NUM, ["o_orderstatus", "o_orderpriority"], 12),
        "written_report_orders": frequencies(
            ORDERS_GAPS, [("o_orderstatus", "o_orderstatus"), ("o_orderpriority", "o_orderpriority")], 15),
        "kind_counts_orders_typed": f"SELECT {KIND_COUNTS} FROM ({column_profile(ORDERS_TYPED, TYPED)})",
    }
