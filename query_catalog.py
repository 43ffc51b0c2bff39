"""Queries over the test tables, each a blueprint configuration with its SQL counterpart.

A configuration names its tables as parquet files in the given folder, exactly as a
user's configuration would; ``tablewright.transform`` turns it into a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tablewright
from tablewright.plans.pipeline import run
from tablewright.sources import storage
from tablewright.sources.tables import read_table
from tablewright.spec import FileOptions, load

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


CATALOG: dict[str, Query] = {}


# --- configuration shorthand -----------------------------------------------------


def pred(left: str, operator: str, right: Any = None, column: bool = False) -> dict[str, Any]:
    if right is None:
        return {"left": left, "operator": operator}
    return {"left": left, "operator": operator, "right": right, "right_type": "column" if column else "literal"}


def key(left: str, right: str) -> dict[str, Any]:
    return pred(left, "==", right, column=True)


def group(logic: str, *conditions: dict[str, Any]) -> dict[str, Any]:
    return {"logic": logic, "conditions": list(conditions)}


def expr(text: str) -> dict[str, Any]:
    return {"type": "expression", "value": text}


def column(target: str, source: str, cast_to: str = "str", **more: Any) -> dict[str, Any]:
    """A mapping; whether it is direct, derived or an expression shows in the source."""
    kind = "EXPRESSION"
    if tablewright.names.is_config_column_reference(source):
        kind = "DERIVED" if source.startswith("deriv.") else "DIRECT"
    return {
        "target_column": target,
        "source_type": kind,
        "source_value": source,
        "cast_to": cast_to,
        "is_nullable": True,
        **more,
    }


def join(kind: str, table: str, alias: str, *conditions: dict[str, Any], **more: Any) -> dict[str, Any]:
    return {
        "join_type": kind,
        "connection_ref": "lake",
        "file_name": f"{table}.parquet",
        "alias": alias,
        "conditions": list(conditions),
        **more,
    }


def compute(name: str, expression: str) -> dict[str, Any]:
    return {"variable_name": name, "transform_type": "EXPRESSION", "expression": expression}


def config(folder: str, root: str, alias: str, mappings: list, joins: list = (), **steps: Any) -> dict[str, Any]:
    return {
        "migration_id": "catalog",
        "client_id": "catalog",
        "version": "1.0.0",
        "connections": {
            "lake": {
                "type": "LOCAL_FILE_DIRECTORY",
                "base_path": folder,
                "target_path": storage.join_path(folder, "unused-output"),
                "file_options": {"format": "PARQUET"},
            }
        },
        "blueprints": [
            {
                "sequence_order": 1,
                "blueprint_id": "query",
                "sources": {
                    "root_table": {"connection_ref": "lake", "file_name": f"{root}.parquet", "alias": alias},
                    "joins": list(joins),
                },
                "target": {"connection_ref": "lake", "file_name": "result.parquet"},
                "mappings": mappings,
                **steps,
            }
        ],
    }


def add(name: str, sql: str | None, root: str, alias: str, mappings: list, joins: list = (), **steps: Any) -> None:
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return tablewright.transform(spark, config(folder, root, alias, mappings, joins, **steps))

    CATALOG[name] = Query(build, sql)


# --- scans and filters -------------------------------------------------------------

add(
    "scan_map_direct",
    "SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment FROM customer",
    "customer",
    "c",
    [
        column("customer_id", "c.c_custkey", "int64"),
        column("name", "c.c_name"),
        column("segment", "c.c_mktsegment"),
    ],
)

ORDER_COLUMNS = [
    column("order_id", "o.o_orderkey", "int64"),
    column("status", "o.o_orderstatus"),
    column("priority", "o.o_orderpriority"),
    column("total", "o.o_totalprice", "float64"),
]
ORDER_SELECT = (
    "SELECT o_orderkey AS order_id, o_orderstatus AS status, o_orderpriority AS priority, "
    "o_totalprice AS total FROM orders"
)
for _name, _condition, _where in (
    ("eq", pred("o.o_orderstatus", "==", "F"), "o_orderstatus = 'F'"),
    ("ne", pred("o.o_orderpriority", "!=", "5-LOW"), "o_orderpriority <> '5-LOW'"),
    ("lt", pred("o.o_totalprice", "<", 100000), "o_totalprice < 100000"),
    ("le", pred("o.o_totalprice", "LE", 50000.5), "o_totalprice <= 50000.5"),
    ("gt", pred("o.o_totalprice", ">", 400000), "o_totalprice > 400000"),
    ("ge", pred("o.o_totalprice", ">=", 250000), "o_totalprice >= 250000"),
):
    add(
        f"filter_compare_{_name}",
        f"{ORDER_SELECT} WHERE {_where}",
        "orders",
        "o",
        ORDER_COLUMNS,
        pre_filters=[_condition],
    )
for _name, _condition, _where in (
    ("in", pred("o.o_orderstatus", "IN", ["F", "P"]), "o_orderstatus IN ('F', 'P')"),
    (
        "not_in",
        pred("o.o_orderpriority", "NOT IN", ["1-URGENT", "2-HIGH"]),
        "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
    ),
    ("in_numbers", pred("o.o_custkey", "IN", [1, 2, 3, 5, 8, 13.0, 21.5, "34"]), "o_custkey IN (1, 2, 3, 5, 8, 13)"),
    ("family_mismatch_eq", pred("o.o_custkey", "==", "1"), "FALSE"),
    ("family_mismatch_ne", pred("o.o_custkey", "!=", "1"), "TRUE"),
    ("like_number", pred("o.o_totalprice", "LIKE", "1%.5"), "CAST(o_totalprice AS VARCHAR) LIKE '1%.5'"),
    ("timestamp_literal", pred("o.o_orderdate", ">=", "1998-03-15"), "o_orderdate >= TIMESTAMP '1998-03-15'"),
    (
        "nested_groups",
        group(
            "AND",
            pred("o.o_orderstatus", "==", "F"),
            group(
                "OR",
                pred("o.o_totalprice", ">", 400000),
                group(
                    "AND",
                    pred("o.o_orderpriority", "LIKE", "%URGENT"),
                    pred("o.o_custkey", "NOT_IN", [7, 8, 9]),
                ),
            ),
        ),
        "o_orderstatus = 'F' AND (o_totalprice > 400000 OR "
        "(o_orderpriority LIKE '%URGENT' AND o_custkey NOT IN (7, 8, 9)))",
    ),
):
    add(
        f"filter_{_name}",
        f"{ORDER_SELECT} WHERE {_where}",
        "orders",
        "o",
        ORDER_COLUMNS,
        pre_filters=[_condition],
    )

add(
    "filter_sequence",
    f"{ORDER_SELECT} WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 100000 AND 200000 AND o_custkey <> 11",
    "orders",
    "o",
    ORDER_COLUMNS,
    pre_filters=[
        pred("o.o_orderstatus", "EQ", "O"),
        expr("100000 <= o.o_totalprice <= 200000"),
        pred("o.o_custkey", "<>", 11),
    ],
)
add(
    "filter_column_column",
    "SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, l_partkey AS part_id, l_suppkey AS supplier_id "
    "FROM lineitem WHERE l_partkey < l_suppkey",
    "lineitem",
    "li",
    [
        column("order_id", "li.l_orderkey", "int64"),
        column("line", "li.l_linenumber", "int64"),
        column("part_id", "li.l_partkey", "int64"),
        column("supplier_id", "li.l_suppkey", "int64"),
    ],
    pre_filters=[pred("li.l_partkey", "<", "li.l_suppkey", column=True)],
)
PART_COLUMNS = [column("part_id", "p.p_partkey", "int64"), column("name", "p.p_name")]
for _name, _pattern, _where in (
    ("like", ("LIKE", "red%"), "p_name LIKE 'red%'"),
    ("not_like", ("NOT LIKE", "%ing"), "p_name NOT LIKE '%ing'"),
    ("like_any_character", ("LIKE", "s_all%i_g"), "p_name LIKE 's_all%i_g'"),
):
    add(
        f"filter_{_name}",
        f"SELECT p_partkey AS part_id, p_name AS name FROM part WHERE {_where}",
        "part",
        "p",
        PART_COLUMNS,
        pre_filters=[pred("p.p_name", *_pattern)],
    )

# --- missing values -----------------------------------------------------------------

LABELLED = [join("LEFT", "labels", "lb", key("d.doc_id", "lb.doc_id"))]
DOC_COLUMNS = [column("doc_id", "d.doc_id", "int64"), column("quality", "lb.quality", "float64")]
DOC_SELECT = "SELECT d.doc_id AS doc_id, lb.quality::DOUBLE AS quality FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id"
for _name, _condition, _where in (
    ("filter_nulls_is_null", expr("quality.isna()"), "lb.quality IS NULL"),
    ("filter_nulls_is_not_null", pred("quality", "IS NOT NULL"), "lb.quality IS NOT NULL"),
    ("null_eq_drops_nulls", pred("quality", "==", 1), "lb.quality = 1"),
    ("null_ne_keeps_nulls", pred("quality", "!=", 1), "lb.quality IS DISTINCT FROM 1"),
    ("null_not_in_keeps_nulls", expr("quality not in [1, 2]"), "lb.quality NOT IN (1, 2) OR lb.quality IS NULL"),
    ("null_in_list", pred("quality", "IN", [0, None]), "lb.quality = 0 OR lb.quality IS NULL"),
    ("null_negation", expr("not (quality > 0)"), "NOT coalesce(lb.quality > 0, FALSE)"),
    ("null_not_like_keeps_nulls", pred("quality", "NOT LIKE", "1%"), "lb.quality IS DISTINCT FROM 1"),
):
    add(_name, f"{DOC_SELECT} WHERE {_where}", "documents", "d", DOC_COLUMNS, LABELLED, post_filters=[_condition])

# --- joins --------------------------------------------------------------------------

PAIR_COLUMNS = [
    column("doc_id", "d.doc_id", "float64"),
    column("labelled_id", "lb.doc_id", "float64"),
    column("lang", "d.lang"),
    column("toxic", "lb.toxic", "float64"),
]
PAIR_SELECT = (
    "SELECT d.doc_id::DOUBLE AS doc_id, lb.doc_id::DOUBLE AS labelled_id, d.lang AS lang, lb.toxic::DOUBLE AS toxic "
    "FROM documents d {kind} JOIN labels lb ON {on}"
)
for _kind, _sql_kind in (("LEFT", "LEFT"), ("INNER", "INNER"), ("RIGHT", "RIGHT"), ("OUTER", "FULL")):
    # Labels are filtered on both sides, so that each side has rows without a partner.
    add(
        f"join_{_kind.lower()}",
        "WITH d AS (SELECT * FROM documents WHERE lang <> 'fr') "
        + PAIR_SELECT.format(kind=_sql_kind, on="d.doc_id = lb.doc_id").replace("documents d", "d"),
        "documents",
        "d",
        PAIR_COLUMNS,
        [join(_kind, "labels", "lb", key("d.doc_id", "lb.doc_id"))],
        pre_filters=[pred("d.lang", "!=", "fr")],
    )
add(
    "join_multi_key",
    "SELECT a.l_orderkey AS order_id, a.l_linenumber::BIGINT AS line, b.l_extendedprice AS price "
    "FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber "
    "WHERE a.l_returnflag = 'R' AND b.l_quantity > 10",
    "lineitem",
    "a",
    [
        column("order_id", "a.l_orderkey", "int64"),
        column("line", "a.l_linenumber", "int64"),
        column("price", "b.l_extendedprice", "float64"),
    ],
    [
        join(
            "INNER",
            "lineitem",
            "b",
            group("AND", key("a.l_orderkey", "b.l_orderkey"), key("b.l_linenumber", "a.l_linenumber")),
            pre_filters=[pred("b.l_quantity", ">", 10)],
        )
    ],
    pre_filters=[pred("a.l_returnflag", "==", "R")],
)


def _null_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Missing keys on both sides: every document against the first document of its quality."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    labelled = documents.join(labels, "doc_id", "left").select(F.col("doc_id").alias("a__id"), F.col("quality").alias("a__quality"))
    first = labelled.groupBy(F.col("a__quality").alias("b__quality")).agg(F.min("a__id").alias("b__id"))
    equal = list(load(config(folder, "x", "a", [column("id", "a.id")], [join("LEFT", "y", "b", key("a.quality", "b.quality"))])).blueprint().joins[0].conditions)
    joined = tablewright.apply_join(labelled, first, "LEFT", equal)
    return joined.select(F.col("a__id").alias("doc_id"), F.col("b__id").alias("first_id"))


CATALOG["join_null_keys"] = Query(
    _null_keys,
    "WITH a AS (SELECT d.doc_id, lb.quality FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id) "
    "SELECT doc_id, min(doc_id) OVER (PARTITION BY quality) AS first_id FROM a",
)
add(
    "join_residual_after_left",
    PAIR_SELECT.format(kind="LEFT", on="d.doc_id = lb.doc_id") + " WHERE lb.quality = 1",
    "documents",
    "d",
    PAIR_COLUMNS,
    [join("LEFT", "labels", "lb", key("d.doc_id", "lb.doc_id"), pred("lb.quality", "==", 1))],
)
add(
    "join_residual_or_group",
    PAIR_SELECT.format(kind="LEFT", on="d.doc_id = lb.doc_id")
    + " WHERE (lb.quality IS NULL OR d.n_chars > 500) AND d.doc_id = lb.doc_id",
    "documents",
    "d",
    PAIR_COLUMNS,
    [
        join(
            "LEFT",
            "labels",
            "lb",
            group(
                "AND",
                key("d.doc_id", "lb.doc_id"),
                group("OR", pred("lb.quality", "IS_NULL"), pred("d.n_chars", ">", 500)),
            ),
        )
    ],
)
add(
    "join_pre_filter",
    PAIR_SELECT.format(kind="LEFT", on="d.doc_id = lb.doc_id AND lb.quality = 1"),
    "documents",
    "d",
    PAIR_COLUMNS,
    [join("LEFT", "labels", "lb", key("d.doc_id", "lb.doc_id"), pre_filters=[pred("lb.quality", "==", 1)])],
)
add(
    "join_chain",
    "SELECT o_orderkey AS order_id, c_name AS customer, n_name AS nation, r_name AS region "
    "FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey "
    "LEFT JOIN region ON n_regionkey = r_regionkey",
    "orders",
    "o",
    [
        column("order_id", "o.o_orderkey", "int64"),
        column("customer", "c.c_name"),
        column("nation", "n.n_name"),
        column("region", "r.r_name"),
    ],
    [
        join("LEFT", "customer", "c", key("o.o_custkey", "c.c_custkey")),
        join("LEFT", "nation", "n", key("c.c_nationkey", "n.n_nationkey")),
        join("LEFT", "region", "r", key("n.n_regionkey", "r.r_regionkey")),
    ],
)


_HOT_CUSTOMERS = "SELECT * FROM customer WHERE c_nationkey <> 3"
_HOT_ORDERS = "SELECT * FROM orders WHERE o_totalprice > 100000"


def _hot_join(kind: str) -> Build:
    """A join whose keys, most of them hot, are split over many parts.

    The filters leave rows without a partner on either side, as every customer has orders
    and every order a customer; all rows that pass them are joined.
    """

    def build(spark: SparkSession, folder: str) -> DataFrame:
        customers = spark.read.parquet(f"{folder}/customer.parquet").where("c_nationkey <> 3")
        customers = customers.select(F.col("c_custkey").alias("c__id"))
        orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_totalprice > 100000")
        orders = orders.select(F.col("o_orderkey").alias("o__id"), F.col("o_custkey").alias("o__customer"))
        match = load(
            config(folder, "customer", "c", [column("id", "c.id")], [join(kind, "orders", "o", key("c.id", "o.customer"))])
        )
        conditions = list(match.blueprint().joins[0].conditions)
        sides = (orders, customers) if kind == "RIGHT" else (customers, orders)
        return tablewright.apply_join(*sides, kind, conditions, rows_per_part=3).select(
            F.col("c__id").alias("customer_id"), F.col("o__id").alias("order_id")
        )

    return build


for _kind, _sql_kind in (("LEFT", "LEFT"), ("RIGHT", "LEFT"), ("OUTER", "FULL")):
    CATALOG[f"join_hot_keys_{_kind.lower()}"] = Query(
        _hot_join(_kind),
        f"SELECT c_custkey AS customer_id, o_orderkey AS order_id FROM ({_HOT_CUSTOMERS}) "
        f"{_sql_kind} JOIN ({_HOT_ORDERS}) ON c_custkey = o_custkey",
    )

# --- derivations --------------------------------------------------------------------

LINE_KEYS = [column("order_id", "li.l_orderkey", "int64"), column("line", "li.l_linenumber", "int64")]
LINE_SELECT = "SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, "
add(
    "derive_expression",
    LINE_SELECT + "l_extendedprice * (1 - l_discount) AS net, "
    "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem",
    "lineitem",
    "li",
    [*LINE_KEYS, column("net", "deriv.net", "float64"), column("gross", "deriv.gross", "float64")],
    derivations=[
        compute("net", "li.l_extendedprice * (1 - li.l_discount)"),
        compute("gross", "deriv.net * (1 + li.l_tax)"),
    ],
)
add(
    "derive_regexp_replace",
    "SELECT c_custkey AS customer_id, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, "
    r"regexp_replace(c_name, '^(\w+)#0*(\d+)$', '\2 $ \1', 'g') AS swapped, "
    "regexp_replace(CAST(c_acctbal AS VARCHAR), '^-', 'minus ', 'g') AS balance FROM customer",
    "customer",
    "c",
    [
        column("customer_id", "c.c_custkey", "int64"),
        column("digits", "deriv.digits"),
        column("swapped", "deriv.swapped"),
        column("balance", "deriv.balance"),
    ],
    derivations=[
        {
            "variable_name": name,
            "transform_type": "REGEXP_REPLACE",
            "source": source,
            "pattern": pattern,
            "replacement": replacement,
        }
        for name, source, pattern, replacement in (
            ("digits", "c.c_name", "[^0-9]", ""),
            ("swapped", "c.c_name", r"^(?P<kind>\w+)#0*(\d+)$", r"\2 $ \g<kind>"),
            ("balance", "c.c_acctbal", "^-", "minus "),
        )
    ],
)
add(
    "derive_case",
    "SELECT o_orderkey AS order_id, "
    "CASE WHEN o_orderpriority = '1-URGENT' OR o_totalprice > 400000 THEN 'HOT' "
    "WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'F' THEN 'N/A' ELSE o_orderstatus END AS bucket, "
    "CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_orderstatus = 'P' THEN o_totalprice * 2 END AS amount FROM orders",
    "orders",
    "o",
    [
        column("order_id", "o.o_orderkey", "int64"),
        column("bucket", "deriv.bucket"),
        column("amount", "deriv.amount", "float64"),
    ],
    derivations=[
        {
            "variable_name": "bucket",
            "transform_type": "CASE",
            "branches": [
                {
                    "when": group("OR", pred("o.o_orderpriority", "==", "1-URGENT"), pred("o.o_totalprice", ">", 400000)),
                    "then": "HOT",
                },
                {
                    "when": group("AND", pred("o.o_orderpriority", "==", "2-HIGH"), pred("o.o_orderstatus", "!=", "F")),
                    "then": "N/A",
                },
            ],
            "else": "o.o_orderstatus",
        },
        {
            "variable_name": "amount",
            "transform_type": "CASE",
            "branches": [
                {"when": pred("o.o_totalprice", "<", 1000), "then": 0},
                {"when": pred("o.o_orderstatus", "==", "P"), "then": "o.o_totalprice * 2"},
            ],
        },
    ],
)

# --- expressions --------------------------------------------------------------------

add(
    "expr_arith",
    LINE_SELECT + "-l_quantity + l_linenumber * 3 - 0.5 AS mixed, (l_linenumber * l_linenumber - 7)::BIGINT AS whole, "
    "(l_linenumber * l_linenumber * l_linenumber)::BIGINT AS cube, "
    "l_returnflag || l_linestatus AS flags FROM lineitem",
    "lineitem",
    "li",
    [
        *LINE_KEYS,
        column("mixed", "-li.l_quantity + li.l_linenumber * 3 - 0.5", "float64"),
        column("whole", "li.l_linenumber * li.l_linenumber - 7", "int64"),
        column("cube", "li.l_linenumber ** 3", "int64"),
        column("flags", "li.l_returnflag + li.l_linestatus"),
    ],
)
add(
    "expr_div_mod",
    "SELECT o_orderkey AS order_id, "
    "CASE WHEN o_custkey % 5 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice / (o_custkey % 5) END AS share, "
    "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE (o_custkey % 5)::DOUBLE / (o_custkey % 5) END AS one, "
    "floor(-o_orderkey / 7.0)::BIGINT AS floored, ((-o_orderkey % 7 + 7) % 7)::BIGINT AS rest, "
    "floor(o_totalprice / 1000) AS thousands FROM orders",
    "orders",
    "o",
    [
        column("order_id", "o.o_orderkey", "int64"),
        column("share", "o.o_totalprice / (o.o_custkey % 5)", "float64"),
        column("one", "(o.o_custkey % 5) / (o.o_custkey % 5)", "float64"),
        column("floored", "-o.o_orderkey // 7", "int64"),
        column("rest", "-o.o_orderkey % 7", "int64"),
        column("thousands", "o.o_totalprice // 1000", "float64"),
    ],
)
add(
    "expr_bool_chain",
    LINE_SELECT + "l_quantity AS quantity FROM lineitem WHERE (10 < l_quantity AND l_quantity <= 20 "
    "AND NOT l_returnflag = 'A') OR (l_tax = 0 AND l_discount IN (0.05, 0.07)) "
    "OR (l_linenumber NOT IN (1, 2, 3, 4, 5) AND l_linestatus <> 'F')",
    "lineitem",
    "li",
    [*LINE_KEYS, column("quantity", "li.l_quantity", "float64")],
    pre_filters=[
        expr(
            "(10 < li.l_quantity <= 20 and not li.l_returnflag == 'A') | "
            "(li.l_tax == 0 & li.l_discount in [0.05, 0.07]) | "
            "(li.l_linenumber not in [1, 2, 3, 4, 5] and li__l_linestatus != 'F')"
        )
    ],
)
_MATH_SQL = {
    "sqrt": "sqrt(l_quantity)",
    "exp": "exp(l_discount)",
    "expm1": "exp(l_discount) - 1",
    "log": "ln(l_quantity)",
    "log1p": "ln(1 + l_tax)",
    "log10": "log10(l_extendedprice)",
    "sin": "sin(l_quantity)",
    "cos": "cos(l_quantity)",
    "tan": "tan(l_tax)",
    "arcsin": "asin(l_discount)",
    "arccos": "acos(l_discount)",
    "arctan": "atan(l_quantity)",
    "sinh": "(exp(l_tax) - exp(-l_tax)) / 2",
    "cosh": "(exp(l_tax) + exp(-l_tax)) / 2",
    "tanh": "(exp(l_tax) - exp(-l_tax)) / (exp(l_tax) + exp(-l_tax))",
    "arcsinh": "ln(l_quantity + sqrt(l_quantity * l_quantity + 1))",
    "arccosh": "ln(l_quantity + sqrt(l_quantity * l_quantity - 1))",
    "arctanh": "ln((1 + l_discount) / (1 - l_discount)) / 2",
}
_MATH_ARGUMENT = {
    "sqrt": "quantity", "exp": "discount", "expm1": "discount", "log": "quantity", "log1p": "tax",
    "log10": "extendedprice", "sin": "quantity", "cos": "quantity", "tan": "tax", "arcsin": "discount",
    "arccos": "discount", "arctan": "quantity", "sinh": "tax", "cosh": "tax", "tanh": "tax",
    "arcsinh": "quantity", "arccosh": "quantity", "arctanh": "discount",
}
add(
    "expr_math",
    LINE_SELECT
    + ", ".join(f"round_even(({sql}) * 1e8, 0) / 1e8 AS f_{name}" for name, sql in _MATH_SQL.items())
    + ", round_even(atan2(l_quantity, l_tax) * 1e8, 0) / 1e8 AS f_arctan2, abs(l_quantity - 25) AS f_abs, "
    "floor(l_extendedprice) AS f_floor, ceil(l_extendedprice) AS f_ceil FROM lineitem",
    "lineitem",
    "li",
    [
        *LINE_KEYS,
        *(
            column(f"f_{name}", f"{name}(li.l_{argument}).round(8)", "float64")
            for name, argument in _MATH_ARGUMENT.items()
        ),
        column("f_arctan2", "arctan2(li.l_quantity, li.l_tax).round(8)", "float64"),
        column("f_abs", "abs(li.l_quantity - 25)", "float64"),
        column("f_floor", "floor(li.l_extendedprice)", "float64"),
        column("f_ceil", "ceil(li.l_extendedprice)", "float64"),
    ],
)
add(
    "expr_math_out_of_domain",
    "SELECT c_custkey AS customer_id, CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS root, "
    "CASE WHEN c_custkey = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE round_even(ln(c_custkey) * 1e8, 0) / 1e8 END AS log "
    "FROM customer",
    "customer",
    "c",
    [
        column("customer_id", "c.c_custkey", "int64"),
        column("root", "sqrt(c.c_acctbal)", "float64"),
        column("log", "log(c.c_custkey).round(8)", "float64"),
    ],
)
add(
    "expr_where_fillna_mask",
    "SELECT d.doc_id AS doc_id, CASE WHEN lb.quality > 0 THEN lb.quality::DOUBLE END AS good, "
    "coalesce(lb.quality, -1)::DOUBLE AS filled, CASE WHEN lb.toxic = 1 THEN 9 ELSE lb.quality::DOUBLE END AS masked, "
    "coalesce(lb.quality, d.n_chars)::DOUBLE AS combined, CAST(NULL AS VARCHAR) AS nothing, 'fixed' AS constant, "
    "CASE WHEN d.lang = 'fr' THEN 'french' ELSE d.lang END AS language FROM documents d "
    "LEFT JOIN labels lb ON d.doc_id = lb.doc_id",
    "documents",
    "d",
    [
        column("doc_id", "d.doc_id", "int64"),
        column("good", "lb.quality.where(lb.quality > 0)", "float64"),
        column("filled", "lb.quality.fillna(-1)", "float64"),
        column("masked", "lb.quality.mask(lb.toxic == 1, 9)", "float64"),
        column("combined", "lb.quality.combine_first(d.n_chars)", "float64"),
        column("nothing", "d.n_chars.where(d.n_chars < 0)"),
        column("constant", "'fixed'"),
        column("language", "d.lang.replace('fr', 'french')"),
    ],
    LABELLED,
)
add(
    "expr_methods",
    LINE_SELECT + "round_even(l_extendedprice * 10, 0) / 10 AS rounded, round_even(l_quantity / 10, 0) * 10 AS tens, "
    "greatest(least(l_quantity, 40.0), 10.0) AS clipped, abs(l_quantity - 25) AS distance, "
    "(l_quantity + l_linenumber) * 2 AS chained, l_quantity - 10 * floor(l_quantity / 10) AS rest FROM lineitem "
    "WHERE l_quantity BETWEEN 5 AND 45 AND l_returnflag IN ('A', 'N') AND l_tax IS NOT NULL",
    "lineitem",
    "li",
    [
        *LINE_KEYS,
        column("rounded", "li.l_extendedprice.round(1)", "float64"),
        column("tens", "li.l_quantity.round(-1)", "float64"),
        column("clipped", "li.l_quantity.clip(10, 40)", "float64"),
        column("distance", "li.l_quantity.sub(25).abs()", "float64"),
        column("chained", "li.l_quantity.add(li.l_linenumber).mul(2)", "float64"),
        column("rest", "li.l_quantity.mod(10)", "float64"),
    ],
    pre_filters=[
        expr("li.l_quantity.between(5, 45) and li.l_returnflag.isin(['A', 'N']) and li.l_tax.notna()")
    ],
)
add(
    "expr_astype",
    "SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) || o_orderstatus AS code, "
    "CAST(o_custkey AS DOUBLE) AS number FROM orders",
    "orders",
    "o",
    [
        column("order_id", "o.o_orderkey", "int64"),
        column("code", "o.o_custkey.astype('str') + o.o_orderstatus"),
        column("number", "o.o_custkey.astype('str').astype('float64')", "float64"),
    ],
)
add(
    "expr_whole_column_agg",
    f"{ORDER_SELECT} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "orders",
    "o",
    ORDER_COLUMNS,
    pre_filters=[expr("o.o_totalprice > o.o_totalprice.mean()")],
)
add(
    "expr_agg_functions",
    "WITH a AS (SELECT sum(l_linenumber)::BIGINT AS total, min(l_extendedprice) AS low, max(l_shipdate) AS last, "
    "count(l_orderkey) AS n, count(DISTINCT l_partkey) AS parts, round_even(stddev_samp(l_quantity) * 1e6, 0) / 1e6 AS spread, "
    "round_even(var_samp(l_quantity) * 1e6, 0) / 1e6 AS variance, median(l_extendedprice) AS middle, "
    "quantile_cont(l_extendedprice, 0.9) AS high FROM lineitem) "
    "SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, a.total, a.low, a.last, a.n, a.parts, a.spread, "
    "a.variance, a.middle, a.high FROM lineitem, a",
    "lineitem",
    "li",
    [
        *LINE_KEYS,
        column("total", "li.l_linenumber.sum()", "int64"),
        column("low", "li.l_extendedprice.min()", "float64"),
        column("last", "li.l_shipdate.max()", "datetime64[ns]"),
        column("n", "li.l_orderkey.count()", "int64"),
        column("parts", "li.l_partkey.nunique()", "int64"),
        column("spread", "li.l_quantity.std().round(6)", "float64"),
        column("variance", "li.l_quantity.var().round(6)", "float64"),
        column("middle", "li.l_extendedprice.median()", "float64"),
        column("high", "li.l_extendedprice.quantile(0.9)", "float64"),
    ],
)
add(
    "expr_rank",
    "SELECT c_custkey AS customer_id, rank() OVER (ORDER BY c_nationkey) "
    "+ (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS by_nation, "
    "rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS by_balance FROM customer",
    "customer",
    "c",
    [
        column("customer_id", "c.c_custkey", "int64"),
        column("by_nation", "c.c_nationkey.rank()", "float64"),
        column("by_balance", "c.c_acctbal.rank()", "float64"),
    ],
)

# --- post-filters -------------------------------------------------------------------

add(
    "post_filter_text",
    "SELECT p_partkey AS part_id, p_name AS name, p_brand AS brand FROM part WHERE upper(p_name) LIKE 'RED%' "
    "OR (regexp_matches(p_brand, '#1[0-5]$') AND length(p_name) > 10) OR (p_name LIKE '%ring' AND "
    "replace(p_brand, 'Brand#', '') = '7') OR lpad(trim(p_brand, 'Bran#d'), 4, '0') = '0021'",
    "part",
    "p",
    [*PART_COLUMNS, column("brand", "p.p_brand")],
    post_filters=[
        expr(
            "name.str.upper().str.startswith('RED') or "
            "(brand.str.contains('#1[0-5]$') and name.str.len() > 10) or "
            "(name.str.endswith('ring') and brand.str.replace('Brand#', '') == '7') or "
            "brand.str.strip('Bran#d').str.zfill(4) == '0021'"
        )
    ],
)
add(
    "post_filter_title_case",
    "SELECT c_custkey AS customer_id, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "customer",
    "c",
    [column("customer_id", "c.c_custkey", "int64"), column("segment", "c.c_mktsegment")],
    post_filters=[expr("segment.str.title() in ['Building', 'Machinery']")],
)
add(
    "post_filter_dates",
    "SELECT o_orderkey AS order_id, o_orderdate AS ordered FROM orders WHERE "
    "(year(o_orderdate) = 1998 AND quarter(o_orderdate) >= 2 AND isodow(o_orderdate) - 1 < 5) "
    "OR o_orderdate = TIMESTAMP '1996-02-29' OR (month(o_orderdate) = 12 AND day(o_orderdate) > 24 "
    "AND o_orderdate < TIMESTAMP '1997-01-01')",
    "orders",
    "o",
    [column("order_id", "o.o_orderkey", "int64"), column("ordered", "o.o_orderdate", "datetime64[ns]")],
    post_filters=[
        expr(
            "(ordered.dt.year == 1998 and ordered.dt.quarter >= 2 and ordered.dt.dayofweek < 5) "
            "or ordered == '1996-02-29' or (ordered.dt.month == 12 and ordered.dt.day > 24 "
            "and ordered < '1997-01-01')"
        )
    ],
)
add(
    "post_filter_times",
    "SELECT event_id, ts AS at FROM events WHERE hour(ts) BETWEEN 9 AND 16 AND minute(ts) < 30 AND second(ts) <> 0 "
    "AND CAST(ts AS DATE) <> DATE '2024-01-06'",
    "events",
    "e",
    [column("event_id", "e.event_id", "int64"), column("at", "e.ts", "datetime64[ns]")],
    post_filters=[
        expr("at.dt.hour.between(9, 16) and at.dt.minute < 30 and at.dt.second != 0"),
        expr("at.dt.date != '2024-01-06'"),
    ],
)

# --- mappings -----------------------------------------------------------------------

add(
    "map_default",
    "SELECT d.doc_id AS doc_id, coalesce(lb.quality, 0)::BIGINT AS quality, "
    "coalesce(CAST(lb.toxic AS VARCHAR), 'unlabelled') AS toxic, coalesce(CAST(lb.quality AS VARCHAR), '') AS blank "
    "FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id",
    "documents",
    "d",
    [
        column("doc_id", "d.doc_id", "int64"),
        column("quality", "lb.quality", "int64", default_value=0, is_nullable=False),
        column("toxic", "lb.toxic", default_value="unlabelled", is_nullable=False),
        column("blank", "lb.quality", default_value=""),
    ],
    LABELLED,
)
add(
    "map_casts",
    "SELECT o_orderkey AS order_id, o_custkey::DOUBLE AS number, floor(o_totalprice)::BIGINT AS whole, "
    "o_orderdate AS ordered, o_custkey AS from_text, o_totalprice AS price, "
    "TIMESTAMP '1970-01-01' + to_microseconds(o_orderkey) AS epoch FROM orders",
    "orders",
    "o",
    [
        column("order_id", "o.o_orderkey.astype('str')", "int64"),
        column("number", "o.o_custkey", "float64"),
        column("whole", "floor(o.o_totalprice)", "int64"),
        column("ordered", "o.o_orderdate.astype('str')", "datetime64[ns]"),
        column("from_text", "o.o_custkey.astype('float64').astype('str')", "int64"),
        column("price", "o.o_totalprice.astype('str')", "float64"),
        column("epoch", "o.o_orderkey * 1000", "datetime64[ns]"),
    ],
)
add(
    "map_text_render",
    LINE_SELECT + "CAST(l_linenumber AS VARCHAR) AS line_text, CAST(l_extendedprice AS VARCHAR) AS price, "
    "CASE WHEN l_quantity > 20 THEN 'True' ELSE 'False' END AS many, strftime(l_shipdate, '%Y-%m-%d') AS shipped, "
    "CAST(l_extendedprice * 1000000 AS VARCHAR) AS large, CAST(l_quantity * 1e20 AS VARCHAR) AS huge, "
    "CAST(l_discount / 1000 AS VARCHAR) AS small FROM lineitem",
    "lineitem",
    "li",
    [
        *LINE_KEYS,
        column("line_text", "li.l_linenumber"),
        column("price", "li.l_extendedprice"),
        column("many", "li.l_quantity > 20"),
        column("shipped", "li.l_shipdate"),
        column("large", "li.l_extendedprice * 1000000"),
        column("huge", "li.l_quantity * 1e20"),
        column("small", "li.l_discount / 1000"),
    ],
)
add(
    "map_text_timestamps",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events",
    "events",
    "e",
    [column("event_id", "e.event_id", "int64"), column("at", "e.ts")],
)


# --- several outputs, gates, audit, files ---------------------------------------------


def _split_config(folder: str) -> dict[str, Any]:
    """One source, two targets."""
    first = config(
        folder,
        "customer",
        "c",
        [column("customer_id", "c.c_custkey", "int64"), column("name", "c.c_name")],
        post_filters=[expr("customer_id >= 10")],
    )
    second = config(
        folder,
        "customer",
        "c",
        [column("customer_id", "c.c_custkey", "int64"), column("balance", "c.c_acctbal", "float64")],
        pre_filters=[pred("c.c_acctbal", ">", 0)],
    )
    first["blueprints"][0] |= {"blueprint_id": "split_a"}
    second["blueprints"][0] |= {
        "blueprint_id": "split_b",
        "sequence_order": 2,
        "target": {"connection_ref": "lake", "file_name": "result_b.parquet"},
    }
    first["blueprints"] += second["blueprints"]
    return first


for _name, _sql in (
    ("split_a", "SELECT c_custkey AS customer_id, c_name AS name FROM customer WHERE c_custkey >= 10"),
    ("split_b", "SELECT c_custkey AS customer_id, c_acctbal AS balance FROM customer WHERE c_acctbal > 0"),
):
    CATALOG[_name] = Query(
        lambda spark, folder, name=_name: tablewright.transform(spark, _split_config(folder), name), _sql
    )


def _gate_config(folder: str) -> dict[str, Any]:
    return config(
        folder,
        "documents",
        "d",
        [
            column("doc_id", "d.doc_id", "int64", is_nullable=False),
            column("quality", "lb.quality", "int64"),
            column("lang", "d.lang", "float64"),
            column("toxic", "lb.toxic", "str", is_nullable=False),
        ],
        LABELLED,
        pre_filters=[pred("d.lang", "!=", "de")],
        post_filters=[pred("quality", "IS NOT NULL")],
    )


CATALOG["gate_report"] = Query(
    lambda spark, folder: tablewright.plan(spark, _gate_config(folder)).gate_report(),
    "WITH j AS (SELECT d.doc_id, d.lang, lb.quality, lb.toxic FROM documents d LEFT JOIN labels lb "
    "ON d.doc_id = lb.doc_id WHERE d.lang <> 'de') "
    "SELECT 'doc_id' AS target_column, count(*) AS row_count, count(doc_id) AS source_values, "
    "0::BIGINT AS cast_failures, 0::BIGINT AS null_values FROM j UNION ALL "
    "SELECT 'quality', count(*), count(quality), count(*) - count(quality), count(*) - count(quality) FROM j UNION ALL "
    "SELECT 'lang', count(*), count(lang), count(lang), count(*) FROM j UNION ALL "
    "SELECT 'toxic', count(*), count(toxic), 0, count(*) - count(toxic) FROM j",
)


def _failing_config(folder: str) -> dict[str, Any]:
    """Expressions with rows that have no result; no mapping uses the first two."""
    return config(
        folder,
        "documents",
        "d",
        [column("doc_id", "d.doc_id", "int64"), column("whole", "(lb.quality / 4).astype('int64') + 1", "int64")],
        LABELLED,
        derivations=[
            compute("number", "d.source.astype('int64')"),
            compute("seventh", "(d.doc_id - 7) ** 7"),
            {
                "variable_name": "grade",
                "transform_type": "CASE",
                "branches": [{"when": pred("d.lang", "==", "de"), "then": "2 ** (3 - d.doc_id % 5)"}],
                "else": 0,
            },
        ],
        post_filters=[pred("doc_id", "<", 10)],
    )


CATALOG["gate_report_expressions"] = Query(
    lambda spark, folder: tablewright.plan(spark, _failing_config(folder)).gate_report(),
    "WITH j AS (SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id), "
    "n AS (SELECT count(*) AS n, count(quality) AS known, count_if(abs(doc_id - 7) >= 512)::BIGINT AS large, "
    "count_if(doc_id % 5 = 4)::BIGINT AS negative FROM j) "
    "SELECT 'doc_id' AS target_column, n AS row_count, n AS source_values, 0::BIGINT AS cast_failures, 0::BIGINT AS null_values FROM n UNION ALL "
    "SELECT 'whole', n, known, n - known, n - known FROM n UNION ALL "
    "SELECT 'deriv__number', n, NULL, n, NULL FROM n UNION ALL SELECT 'deriv__seventh', n, NULL, large, NULL FROM n UNION ALL "
    "SELECT 'deriv__grade', n, NULL, negative, NULL FROM n UNION ALL SELECT 'whole', n, NULL, n - known, NULL FROM n",
)


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    settings = config(
        folder,
        "orders",
        "o",
        [*ORDER_COLUMNS, column("segment", "c.c_mktsegment")],
        [
            join(
                "INNER",
                "customer",
                "c",
                key("o.o_custkey", "c.c_custkey"),
                pre_filters=[pred("c.c_mktsegment", "==", "BUILDING")],
            )
        ],
        pre_filters=[pred("o.o_orderstatus", "==", "O")],
        post_filters=[expr("total > 100000")],
    )
    outcome = run(spark, settings, dry_run=True)
    return outcome.audit(spark).select("position", "step", "rows_before", "rows_after")


CATALOG["audit_rows"] = Query(
    _audit,
    "WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'O'), "
    "b AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'), "
    "j AS (SELECT f.o_totalprice FROM f JOIN b ON f.o_custkey = b.c_custkey), "
    "n AS (SELECT (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM j) AS j, "
    "(SELECT count(*) FROM j WHERE o_totalprice > 100000) AS p) "
    "SELECT 0 AS position, 'pre_filters' AS step, NULL::BIGINT AS rows_before, f AS rows_after FROM n UNION ALL "
    "SELECT 1, 'pre_filters c', NULL, b FROM n UNION ALL SELECT 2, 'join c', f, j FROM n UNION ALL "
    "SELECT 3, 'mappings', j, j FROM n UNION ALL SELECT 4, 'post_filters', j, p FROM n",
)


def _csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as delimited text by a run, then read and typed again."""
    scratch = storage.scratch_folder(spark)
    settings = config(
        folder,
        "orders",
        "o",
        [
            column("order_id", "o.o_orderkey", "int64", is_nullable=False),
            column("customer_id", "o.o_custkey", "int64"),
            column("status", "o.o_orderstatus"),
            column("total", "o.o_totalprice", "float64"),
            column("ordered", "o.o_orderdate", "datetime64[ns]"),
            column("quoted", "o.o_orderpriority + '| \"' + o.o_orderstatus + '\"'"),
            column("empty", "o.o_orderstatus.where(o.o_orderstatus == 'P')"),
        ],
    )
    text = {"format": "CSV", "delimiter": "|"}
    settings["connections"]["text"] = {
        "type": "LOCAL_FILE_DIRECTORY",
        "base_path": scratch,
        "target_path": scratch,
        "file_options": text,
    }
    settings["blueprints"][0]["target"] = {"connection_ref": "text", "file_name": "orders.csv"}
    run(spark, settings)
    return read_table(spark, storage.join_path(scratch, "orders.csv"), FileOptions(**text))


CATALOG["csv_round_trip"] = Query(
    _csv_round_trip,
    "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS total, "
    "strftime(o_orderdate, '%Y-%m-%d') AS ordered, o_orderpriority || '| \"' || o_orderstatus || '\"' AS quoted, "
    "CASE WHEN o_orderstatus = 'P' THEN 'P' END AS empty FROM orders",
)

def _csv_without_header(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as text without a header, with fields that stand for missing values, read again."""
    scratch = storage.scratch_folder(spark)
    settings = config(
        folder,
        "orders",
        "o",
        [
            column("order_id", "o.o_orderkey", "int64"),
            column("status", "o.o_orderstatus.replace('F', 'NA').replace('P', 'null')"),
            column("priority", "o.o_orderpriority.where(o.o_orderstatus != 'O', '#N/A')"),
        ],
    )
    text = {"format": "CSV", "header_row": False}
    settings["connections"]["text"] = {
        "type": "LOCAL_FILE_DIRECTORY",
        "base_path": scratch,
        "target_path": scratch,
        "file_options": text,
    }
    settings["blueprints"][0]["target"] = {"connection_ref": "text", "file_name": "orders.csv"}
    run(spark, settings)
    found = read_table(spark, storage.join_path(scratch, "orders.csv"), FileOptions(**text))
    return found.toDF("order_id", "status", "priority")


CATALOG["csv_without_header"] = Query(
    _csv_without_header,
    "SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'O' THEN 'O' END AS status, "
    "CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS priority FROM orders",
)


def _two_blueprints(spark: SparkSession, folder: str) -> DataFrame:
    """A run of two blueprints, in order; what it reports beside what its targets hold."""
    scratch = storage.scratch_folder(spark)
    settings = _split_config(folder)
    settings["connections"]["out"] = {
        "type": "LOCAL_FILE_DIRECTORY",
        "base_path": scratch,
        "target_path": scratch,
        "file_options": {"format": "PARQUET"},
    }
    for number, blueprint in enumerate(settings["blueprints"]):
        blueprint["target"] = {"connection_ref": "out", "file_name": f"part{number}"}
    reported = run(spark, settings).table(spark).select("target", F.col("row_count").alias("reported_rows"))
    held = [
        spark.read.parquet(storage.join_path(scratch, f"part{number}")).agg(F.count(F.lit(1)).alias("held_rows")).withColumn("target", F.lit(f"part{number}"))
        for number in range(len(settings["blueprints"]))
    ]
    return reported.join(reduce(DataFrame.union, held), "target").select("target", "reported_rows", "held_rows")


CATALOG["run_two_blueprints"] = Query(
    _two_blueprints,
    "SELECT 'part0' AS target, count(*) AS reported_rows, count(*) AS held_rows FROM customer WHERE c_custkey >= 10 "
    "UNION ALL SELECT 'part1', count(*), count(*) FROM customer WHERE c_acctbal > 0",
)

add(
    "expr_power",
    LINE_SELECT + "(x * x * x * x * x * x * x * x * x)::BIGINT AS ninth, (n ** 12)::BIGINT AS twelfth, (n ** n)::BIGINT AS own "
    "FROM (SELECT *, (l_linenumber + 90)::HUGEINT AS x, l_linenumber AS n FROM lineitem)",
    "lineitem",
    "li",
    [
        *LINE_KEYS,
        column("ninth", "(li.l_linenumber + 90) ** 9", "int64"),
        column("twelfth", "li.l_linenumber ** 12", "int64"),
        column("own", "li.l_linenumber ** li.l_linenumber", "int64"),
    ],
)
add(
    "expr_div_pow_strip",
    "SELECT c_custkey AS id, c_acctbal / 4 AS quarter, (c_nationkey * c_nationkey * c_nationkey)::BIGINT AS cube, "
    "lower(c_mktsegment) AS lower_segment, c_name || ' ' AS left_stripped, ' ' || c_name AS right_stripped FROM customer",
    "customer",
    "c",
    [
        column("id", "c.c_custkey", "int64"),
        column("quarter", "c.c_acctbal.div(4)", "float64"),
        column("cube", "c.c_nationkey.pow(3)", "int64"),
        column("lower_segment", "c.c_mktsegment.str.lower()"),
        column("left_stripped", "(' ' + c.c_name + ' ').str.lstrip()"),
        column("right_stripped", "(' ' + c.c_name + ' ').str.rstrip()"),
    ],
)
add(
    "derive_constant",
    "SELECT c_custkey AS id, 'batch 7' AS batch, 42::BIGINT AS answer FROM customer",
    "customer",
    "c",
    [column("id", "c.c_custkey", "int64"), column("batch", "deriv.batch"), column("answer", "deriv.answer", "int64")],
    derivations=[compute("batch", "'batch 7'"), compute("answer", "6 * 7")],
)
add(
    "filter_text_order",
    "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_mktsegment > 'BUILDING' AND c_mktsegment <= 'HOUSEHOLD'",
    "customer",
    "c",
    [column("id", "c.c_custkey", "int64"), column("segment", "c.c_mktsegment")],
    pre_filters=[pred("c.c_mktsegment", ">", "BUILDING"), pred("c.c_mktsegment", "<=", "HOUSEHOLD")],
)

# --- the flagship ---------------------------------------------------------------------


add(
    "order_lines_enriched",
    "SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, p_name AS part, c_name AS customer, n_name AS nation, "
    "l_extendedprice * (1 - l_discount) AS net, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FAST' "
    "WHEN l_quantity >= 40 THEN 'BULK' ELSE 'NORMAL' END AS tier, regexp_replace(c_name, '[^0-9]', '', 'g') AS customer_no, "
    "o_orderdate AS ordered FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey "
    "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey "
    "LEFT JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND l_quantity > 5 "
    "AND l_extendedprice * (1 - l_discount) > 1000",
    "lineitem",
    "li",
    [
        *LINE_KEYS,
        column("part", "p.p_name"),
        column("customer", "c.c_name"),
        column("nation", "n.n_name"),
        column("net", "deriv.net", "float64", is_nullable=False),
        column("tier", "deriv.tier", is_nullable=False),
        column("customer_no", "deriv.customer_no"),
        column("ordered", "o.o_orderdate", "datetime64[ns]"),
    ],
    [
        join("LEFT", "orders", "o", key("li.l_orderkey", "o.o_orderkey")),
        join("LEFT", "customer", "c", key("o.o_custkey", "c.c_custkey")),
        join("LEFT", "nation", "n", key("c.c_nationkey", "n.n_nationkey")),
        join("LEFT", "part", "p", key("li.l_partkey", "p.p_partkey")),
    ],
    pre_filters=[pred("li.l_returnflag", "!=", "R"), pred("li.l_quantity", ">", 5)],
    derivations=[
        compute("net", "li.l_extendedprice * (1 - li.l_discount)"),
        {
            "variable_name": "tier",
            "transform_type": "CASE",
            "branches": [
                {"when": pred("o.o_orderpriority", "IN", ["1-URGENT", "2-HIGH"]), "then": "FAST"},
                {"when": pred("li.l_quantity", ">=", 40), "then": "BULK"},
            ],
            "else": "NORMAL",
        },
        {
            "variable_name": "customer_no",
            "transform_type": "REGEXP_REPLACE",
            "source": "c.c_name",
            "pattern": "[^0-9]",
            "replacement": "",
        },
    ],
    post_filters=[expr("net > 1000")],
)
FLAGSHIP = "order_lines_enriched"
