"""Queries over predicate trees: each order asks whether a tree of the rule file covers its customer's parcel on its day."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees as tr
from ..sources.readers import table
from ..sources.views import SQL_VIEWS, parcels
from .catalogue import query


def _leaf(fact: str, op: str, value: object) -> dict:
    return {"fact": fact, "op": op, "value": value}


_back = lambda n: {tr.RELATIVE: n}
#: The rule file: trees of every kind of leaf, three and four levels deep, some malformed.
RULE_FILE: dict[int, object] = {
    0: None,
    1: {"all": [_leaf("units", ">=", 4), _leaf("year_built", "<", 1990)]},
    2: {"any": [_leaf("units", ">", 5), {"not": _leaf("year_built", ">=", 1975)}]},
    3: {"all": [_leaf("units", ">=", 3), _leaf("owner_occupied", "!=", True), _leaf("owner_type", "not_in", ["natural person", "trust"])]},
    4: _leaf("year_built", "<", _back(45)),
    5: {"all": [{"any": [_leaf("units", "in", [2, 3, 4]), _leaf("use_description", "==", " Building ")]}, {"not": {"all": [_leaf("year_built", ">=", 1980), _leaf("units", "<", 4)]}}]},
    6: {"any": [_leaf("certificate_of_occupancy_date", "<", "1979-10-01"), {"all": [_leaf("tenancy_months", ">=", 12), _leaf("units", ">=", 2)]}]},
    7: {"all": [_leaf("certificate_of_occupancy_date", "<=", _back(30)), {"not": _leaf("dormitory_or_institutional", "==", True)}]},
    8: {"any": [_leaf("use_description", "in", ["HOUSEHOLD", "machinery"]), _leaf("year_built", "==", "1978-10-01")]},
    9: {"all": [_leaf("units", "like", 4), {"any": []}, _leaf("roof", "==", "flat"), "all"]},
    10: {"all": [_leaf("subject_to_local_rent_control", "==", True), {"any": [_leaf("units", "!=", 1), {"not": {"all": [_leaf("units", "<=", 1), _leaf("year_built", ">", 1960)]}}]}]},
    11: {"not": {"any": [{"all": [_leaf("units", "==", 1), _leaf("year_built", "not_in", [1980, 1981])]}, _leaf("use_description", "not_in", ["FURNITURE", "AUTOMOBILE", "BUILDING"])]}},
    12: {"all": [_leaf("units", ">=", _back(3)), _leaf("year_built", "in", 1980), _leaf("year_built", "==", _back(3))]},
}


def _rule_file(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(tr.node_rows({k: json.dumps(t) if t else None for k, t in RULE_FILE.items()}), f"tree int, nodes array<{tr.NODE}>")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """``(o_orderkey, as_of, tree, nodes, facts...)``; the rule file is a constant of this module, the parcels are joined by key."""
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("use_description"))
    known = parcels(spark, sf).join(customer, F.col("address_id") == F.col("c_custkey")).drop("c_custkey")
    key = F.col("o_orderkey")
    asked = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("address_id"), (key % len(RULE_FILE)).cast("int").alias("tree"), F.when(key % 10 != 0, F.date_add(F.col("o_orderdate").cast("date"), 9000)).alias("as_of"),
    )
    asked = asked.join(known, "address_id").withColumn("control", F.when(F.col("address_id") % 4 == 0, True).when(F.col("address_id") % 4 == 1, False))
    return asked.join(_rule_file(spark), "tree")


def _facts() -> tr.Facts:
    return tr.Facts(F.col("units_min"), F.col("units_max"), F.col("year_built"), F.col("use_description"), F.col("control"))


# The same trees written out as SQL, for an engine that has no such operator: (value, names missing, used, presumed) of each node.


def _sql_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]::VARCHAR[]"


def _sql_interval(op: str, low: str, high: str, value: object) -> str:
    if op in ("in", "not_in"):
        numbers = [float(v) for v in (value if isinstance(value, list) else [value])]
        point = " OR ".join(f"{low} = {v}" for v in numbers)
        inside = " OR ".join(f"(coalesce({v} >= {low}, true) AND coalesce({v} <= {high}, true))" for v in numbers)
        yes, no = (2, 0) if op == "in" else (0, 2)
        return f"CASE WHEN coalesce({low} = {high}, false) THEN CASE WHEN {point} THEN {yes} ELSE {no} END WHEN NOT ({inside}) THEN {no} ELSE 1 END"
    if op in ("==", "!="):
        yes, no = (2, 0) if op == "==" else (0, 2)
        return f"CASE WHEN {low} = {high} THEN CASE WHEN {low} = {value} THEN {yes} ELSE {no} END WHEN {value} < {low} OR {value} > {high} THEN {no} ELSE 1 END"
    opposite = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}[op]
    sure, never = (high, low) if op[0] == "<" else (low, high)
    return f"CASE WHEN {sure} {op} {value} THEN 2 WHEN {never} {opposite} {value} THEN 0 ELSE 1 END"


def _sql_leaf(node: dict, lenient: bool) -> tuple[str, str, str, str]:
    fact, op, value = node["fact"], node["op"], node["value"]
    none, own = _sql_list([]), _sql_list([fact])
    wait = lambda v: f"CASE WHEN ({v}) = 1 THEN {own} ELSE {none} END"
    back = value[tr.RELATIVE] if isinstance(value, dict) else None
    before = lambda cutoff: f"CASE WHEN year_built < {cutoff} THEN {2 if op[0] == '<' else 0} WHEN year_built > {cutoff} THEN {0 if op[0] == '<' else 2} ELSE 1 END"
    if fact == "units":
        v = _sql_interval(op, "units_min", "units_max", value)
        return v, wait(v), f"CASE WHEN units_min IS NULL AND units_max IS NULL THEN {none} ELSE {own} END", none
    if fact == "year_built" and back:
        v = before(f"(year(as_of) - {back})")
        return v, wait(v), f"CASE WHEN year_built IS NULL OR as_of IS NULL THEN {none} ELSE {own} END", none
    if fact == "year_built":
        v = "1" if isinstance(value, str) else _sql_interval(op, "year_built", "year_built", value)
        return v, f"CASE WHEN year_built IS NULL THEN {own} ELSE {none} END", f"CASE WHEN year_built IS NULL THEN {none} ELSE {own} END", none
    if fact == "certificate_of_occupancy_date":
        v = before(f"(year(as_of) - {back})" if back else str(value)[:4])
        can = "as_of IS NOT NULL" if back else "true"
        missing = f"CASE WHEN ({v}) <> 1 THEN {none} WHEN year_built IS NULL AND {can} THEN {_sql_list([fact, 'year_built'])} ELSE {own} END"
        return v, missing, f"CASE WHEN year_built IS NOT NULL AND {can} THEN {_sql_list(['year_built'])} ELSE {none} END", none
    if fact == "use_description":
        among = ", ".join(f"'{str(x).strip().lower()}'" for x in (value if isinstance(value, list) else [value]))
        v = f"CASE WHEN (lower(trim(use_description)) IN ({among})) = {str(op in ('in', '==')).lower()} THEN 2 ELSE 0 END"
        return v, none, own, none
    if fact == tr.LOCAL_CONTROL:
        v = f"CASE WHEN control IS NULL THEN 1 WHEN control = {str(value).lower()} THEN 2 ELSE 0 END"
        return v, wait(v), f"CASE WHEN control IS NULL THEN {none} ELSE {own} END", none
    if lenient:
        return str(2 if op in ("!=", "not_in") or value is False else 0), none, none, own
    return "1", own, none, none


def _sql_node(node: dict, lenient: bool) -> tuple[str, str, str, str]:
    if "not" in node:
        v, *names = _sql_node(node["not"], lenient)
        return (f"2 - ({v})", *names)
    for kind, fold in (("all", "least"), ("any", "greatest")):
        if kind in node:
            kids = [_sql_node(k, lenient) for k in node[kind]]
            value = f"{fold}({', '.join(f'({k[0]})' for k in kids)})"
            merged = [f"flatten([{', '.join(f'CASE WHEN ({k[0]}) = {value} THEN {k[at]} ELSE {_sql_list([])} END' for k in kids)}])" for at in (1, 2, 3)]
            return (value, *merged)
    return _sql_leaf(node, lenient)


def _named(node: object) -> set[str]:
    if not isinstance(node, dict):
        return set()
    return {node["fact"]} if "fact" in node else set().union(*[_named(k) for kids in node.values() for k in (kids if isinstance(kids, list) else [kids])])


def _sql_joined(names: str) -> str:
    return f"array_to_string(list_sort(list_distinct({names})), ',')"


def _sql_coverage(number: int, tree: dict | None) -> str:
    """Rows of one tree, its nodes' values in columns of their own."""
    source = f"SELECT *, {number} AS t FROM asked WHERE tree = {number}"
    if not tree:
        return f"SELECT o_orderkey, 2 AS value, '' AS presumed, '' AS missing, '' AS used, '' AS referenced FROM ({source})"
    names = ",".join(sorted(_named(tree)))
    if any(n["fault"] for n in tr.nodes_of(tree)):
        return f"SELECT o_orderkey, 1, '', '{names}', '', '{names}' FROM ({source})"
    s, sm, su, _ = _sql_node(tree, False)
    v, lm, lu, lp = _sql_node(tree, True)
    rows = f"SELECT o_orderkey, {s} AS s, {sm} AS sm, {su} AS su, {v} AS l, {lm} AS lm, {lu} AS lu, {lp} AS lp FROM ({source})"
    return f"""SELECT o_orderkey, CASE WHEN s = 1 AND l = 2 THEN 2 ELSE s END, CASE WHEN s = 1 AND l = 2 THEN {_sql_joined('lp')} ELSE '' END,
        CASE WHEN s <> 1 OR l = 2 THEN '' WHEN len(lm) + len(lp) > 0 THEN {_sql_joined('list_concat(lm, lp)')} ELSE {_sql_joined('sm')} END,
        CASE WHEN s = 1 AND l = 2 THEN {_sql_joined('lu')} ELSE {_sql_joined('su')} END, '{names}' FROM ({rows})"""


SQL_ASKED = SQL_VIEWS + f""",
asked AS (SELECT o_orderkey, o_custkey AS address_id, CAST(o_orderkey % {len(RULE_FILE)} AS INTEGER) AS tree, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) + 9000 END AS as_of, p.* EXCLUDE (address_id),
    c_mktsegment AS use_description, CASE address_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS control FROM orders JOIN parcels p ON o_custkey = address_id JOIN customer ON c_custkey = o_custkey)
"""


@query(SQL_ASKED + "SELECT o_orderkey, CAST(value AS INTEGER) AS value, presumed, missing, used, referenced FROM (" + " UNION ALL ".join(_sql_coverage(k, t) for k, t in RULE_FILE.items()) + ")")
def tree_coverage(spark, sf):
    """Value of a tree of any depth, with what it presumed, waits for, used and names."""
    found = _questions(spark, sf).select("o_orderkey", tr.coverage(F.col("nodes"), _facts(), F.col("as_of")).alias("c"))
    return found.select("o_orderkey", "c.value", *[F.array_join(f"c.{x}", ",").alias(x) for x in ("presumed", "missing", "used", "referenced")])


def _sql_by_tree(texts: dict[int, str]) -> str:
    return " ".join(f"WHEN {k} THEN '{x}'" for k, x in texts.items())


_FAULTS = {9: "$.all[0]: no such operator: like|$.all[1].any: must be a non-empty list|$.all[2]: no such fact: roof|$.all[3]: not an object", 12: "$.all[0]: units is no date, so it takes no years|$.all[1]: in takes a list|$.all[2]: == takes no years"}
_FAULTS[9] = _FAULTS[9].replace("$.all[1].any:", "$.all[1]:")
_NUMBERS = {1: "4,1990", 2: "5,1975", 3: "3", 4: "45", 5: "2,3,4,1980,4", 6: "1979,12,2", 7: "30", 8: "1978", 9: "4", 10: "1,1,1960", 11: "1,1980,1981", 12: "3,1980,3"}


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(RULE_FILE)} {_sql_by_tree(_FAULTS)} ELSE '' END AS faults FROM orders")
def tree_faults(spark, sf):
    """What is wrong with the tree that an order asks about, by path."""
    return _questions(spark, sf).select("o_orderkey", F.array_join(tr.faults(F.col("nodes")), "|").alias("faults"))


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(RULE_FILE)} {_sql_by_tree(_NUMBERS)} ELSE '' END AS numbers FROM orders")
def tree_numbers(spark, sf):
    """The numbers that a tree states, in its order, against which a quote is checked."""
    return _questions(spark, sf).select("o_orderkey", F.array_join(tr.numbers_stated(F.col("nodes")), ",").alias("numbers"))


_BASIS = (1, 2, 5)  # trees that cities use for their own rent control; none names that fact


@query(SQL_ASKED + f""",
basis AS (SELECT c_custkey AS address_id, b.tree, p.units_min, p.units_max, p.year_built, c_mktsegment AS use_description, NULL::BOOLEAN AS control, NULL::DATE AS as_of, c_custkey AS o_orderkey
    FROM customer JOIN parcels p ON p.address_id = c_custkey CROSS JOIN (VALUES {', '.join(f'({k})' for k in _BASIS)}) b(tree)
    WHERE p.city IS NOT NULL AND p.confidence <> 'low' AND (c_nationkey + b.tree) % 3 <> 0),
stage AS ({' UNION ALL '.join(f"SELECT address_id, {_sql_node(RULE_FILE[k], False)[0]} AS v FROM basis WHERE tree = {k}" for k in _BASIS)}),
derived AS (SELECT address_id, CASE WHEN max(v) = 2 THEN true WHEN max(v) = 0 THEN false END AS control FROM stage GROUP BY address_id),
again AS (SELECT a.* EXCLUDE (control), d.control FROM asked a LEFT JOIN derived d USING (address_id) WHERE tree = 10)
SELECT o_orderkey, control, CAST({_sql_node(RULE_FILE[10], False)[0]} AS INTEGER) AS value FROM again""")
def derived_rent_control(spark, sf):
    """Two stages: a city's own rules tell whether its rent control covers a parcel, then trees that ask for that are evaluated.

    A rule that rests on the derived fact is no basis for it, so two stages are enough.
    """
    facts = _facts()
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("use_description"))
    known = parcels(spark, sf).join(customer, F.col("address_id") == F.col("c_custkey")).where("city IS NOT NULL AND confidence <> 'low'")
    basis = known.withColumn("tree", F.explode(F.array(*map(F.lit, _BASIS)))).where((F.col("c_nationkey") + F.col("tree")) % 3 != 0).withColumn("control", F.lit(None).cast("boolean")).join(_rule_file(spark), "tree")
    value = tr.coverage(F.col("nodes"), facts, F.lit(None).cast("date"))["value"]
    derived = basis.select("address_id", value.alias("value")).groupBy("address_id").agg(tr.rent_control(F.lit(True), F.col("value")).alias("control"))
    asked = _questions(spark, sf).where("tree = 10").drop("control").join(derived, "address_id", "left")
    return asked.select("o_orderkey", "control", tr.coverage(F.col("nodes"), facts, F.col("as_of"))["value"].alias("value"))


