"""Queries over the test tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiverlog.engine import Engine
from quiverlog.errors import EngineError
from quiverlog.operators import fixpoint, policy
from quiverlog.sources.shared import local_table, shared_folder, write_table
from quiverlog.sources.tables import graph, node, table
from quiverlog.streaming.normalizer import Normalizers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _program(name: str, parts: str, program: str, oracle: str, principal: str | None = None, setup: str | None = None, **options) -> None:
    """A query that is one program over some mappings; ``setup`` asserts first, ``principal`` reads; options of the engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(graph(spark, sf_dir, *parts.split()), **options)
        if setup:
            engine.query(setup)
        return engine.read_as(principal, program) if principal else engine.query(program)

    QUERIES[name], ORACLES[name] = run, oracle


def _function(oracle: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


# --- scans, projection, filters ---

_program("edge_scan_all", "nation_name region_name nation_region", 'Edge(s, "name", o)?', "SELECT 'nation/'||n_nationkey AS s, n_name AS o FROM nation UNION ALL SELECT 'region/'||r_regionkey, r_name FROM region")
_program("edge_point_subject", "order_customer order_status", 'Edge("order/7", p, o)?', "SELECT 'placed_by' AS p, 'customer/'||o_custkey AS o FROM orders WHERE o_orderkey=7 UNION ALL SELECT 'status', o_orderstatus FROM orders WHERE o_orderkey=7")
_program("edge_point_object", "order_customer", 'Edge(s, "placed_by", "customer/7")?', "SELECT 'order/'||o_orderkey AS s FROM orders WHERE o_custkey=7")
_program("edge_object_any_predicate", "customer_nation supplier_nation nation_region", 'Edge(s, p, "nation/3")?', "SELECT 'customer/'||c_custkey AS s, 'in_nation' AS p FROM customer WHERE c_nationkey=3 UNION ALL SELECT 'supplier/'||s_suppkey, 'in_nation' FROM supplier WHERE s_nationkey=3")
_program("edge_anon_bag", "customer_nation", 'Edge(_, "in_nation", n)?', "SELECT 'nation/'||c_nationkey AS n FROM customer")
_program("edge_supplies", "supplies", 'Edge(s, "supplies", p)?', "SELECT DISTINCT 'supplier/'||l_suppkey AS s, 'part/'||l_partkey AS p FROM lineitem")
_program("edge_user_event", "user_event", 'Edge(u, "did", t)?', "SELECT DISTINCT 'user/'||user_id AS u, event_type AS t FROM events")
_program("edge_page_links", "links", 'Edge(p, "links_to", h)?', "SELECT DISTINCT 'page/'||page_id AS p, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages")
_program("edge_repeated_variable", "nation_name", 'Edge("nation/1", "next", "nation/1"). Edge("nation/1", "next", "nation/2"). Edge(x, "next", x)?', "SELECT 'nation/1' AS x")
_program("edge_bound_atom_filter", "nation_region region_name", 'Edge("nation/0", "in_region", "region/0"), Edge(r, "name", n)?', "SELECT 'region/'||r_regionkey AS r, r_name AS n FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey=0 AND n_regionkey=0) AND r_name <> ''")
_program("edge_variable_predicate_join", "nation_region nation_name region_name", 'Edge("nation/4", p, x), Edge(x, q, y)?', "SELECT 'in_region' AS p, 'region/'||n_regionkey AS x, 'name' AS q, r_name AS y FROM nation JOIN region ON r_regionkey=n_regionkey WHERE n_nationkey=4")
_program("undefined_predicate", "nation_name", "Nowhere(x, y)?", "SELECT n_name AS x, n_name AS y FROM nation WHERE false")

# --- joins ---

_program("edge_two_hop", "customer_nation nation_region", 'Edge(c, "in_nation", n), Edge(n, "in_region", r)?', "SELECT 'customer/'||c_custkey AS c, 'nation/'||n_nationkey AS n, 'region/'||n_regionkey AS r FROM customer JOIN nation ON c_nationkey=n_nationkey")
_program("edge_star_join", "order_customer order_status customer_nation nation_name", 'Edge(o, "status", "F"), Edge(o, "placed_by", c), Edge(c, "in_nation", n), Edge(n, "name", name)?', "SELECT 'order/'||o_orderkey AS o, 'customer/'||c_custkey AS c, 'nation/'||n_nationkey AS n, n_name AS name FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE o_orderstatus='F'")
_program("edge_cross_product", "region_name ring", 'Edge(r, "name", _), Edge(n, "next", _)?', "SELECT 'region/'||r_regionkey AS r, 'nation/'||n_nationkey AS n FROM region, nation")
_program("edge_triangle", "customer_nation supplier_nation buys", 'Edge(c, "in_nation", n), Edge(s, "in_nation", n), Edge(c, "buys_from", s)?', "SELECT DISTINCT 'customer/'||c_custkey AS c, 'nation/'||c_nationkey AS n, 'supplier/'||s_suppkey AS s FROM customer JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON s_suppkey=l_suppkey AND s_nationkey=c_nationkey")

# --- rules ---

_program("rule_co_supply", "supplies", 'Co(a, b) :- Edge(a, "supplies", p), Edge(b, "supplies", p). Co(a, b)?', "SELECT DISTINCT 'supplier/'||a.l_suppkey AS a, 'supplier/'||b.l_suppkey AS b FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) b USING (l_partkey)")
_program("rule_union", "customer_nation supplier_nation", 'At(x, n) :- Edge(x, "in_nation", n). At("anyone", n) :- Edge(_, "in_nation", n). At(x, n)?', "SELECT 'customer/'||c_custkey AS x, 'nation/'||c_nationkey AS n FROM customer UNION SELECT 'supplier/'||s_suppkey, 'nation/'||s_nationkey FROM supplier UNION SELECT 'anyone', 'nation/'||c_nationkey FROM customer UNION SELECT 'anyone', 'nation/'||s_nationkey FROM supplier")
_program("rule_head_constant", "order_status", 'Mark(o, "open") :- Edge(o, "status", "O"). Mark(o, "done") :- Edge(o, "status", "F"). Mark(o, m)?', "SELECT 'order/'||o_orderkey AS o, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'done' END AS m FROM orders WHERE o_orderstatus IN ('O','F')")
_program("rule_hidden_dedup", "customer_nation", 'Used(n) :- Edge(_, "in_nation", n). Used(n)?', "SELECT DISTINCT 'nation/'||c_nationkey AS n FROM customer")
_program("rule_chain", "customer_nation nation_region region_name", 'In(c, r) :- Edge(c, "in_nation", n), Edge(n, "in_region", r). Named(c, m) :- In(c, r), Edge(r, "name", m). Named(c, m)?', "SELECT 'customer/'||c_custkey AS c, r_name AS m FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
_program("rule_predicate_join", "supplies part_brand", 'Brand(s, b) :- Edge(s, "supplies", p), Edge(p, "brand", b). Both(b) :- Brand("supplier/1", b), Brand("supplier/2", b). Both(b)?', "SELECT p_brand AS b FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_suppkey=1 INTERSECT SELECT p_brand FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_suppkey=2")
_program("rule_wide_union", "nation_name", "".join(f'Edge("hub", "m{i}", "leaf/{i}"). Any(x) :- Edge("hub", "m{i}", x). ' for i in range(1, 301)) + "Any(x)?", "SELECT 'leaf/'||i AS x FROM range(1, 301) t(i)")
_program("rule_unused_ignored", "ring nation_name", 'Loop(x, y) :- Edge(x, "next", y). Loop(x, z) :- Loop(x, y), Loop(y, z). Name(n) :- Edge(_, "name", n). Name(n)?', "SELECT DISTINCT n_name AS n FROM nation")

# --- recursion ---

_CLOSE = "WITH RECURSIVE e AS ({e}), r(x, y) AS (SELECT s, o FROM e UNION SELECT r.x, e.o FROM r JOIN e ON e.s=r.y) SELECT {out} FROM r{where}"
_LOCATED = "SELECT 'customer/'||c_custkey s, 'nation/'||c_nationkey o FROM customer UNION SELECT 'supplier/'||s_suppkey, 'nation/'||s_nationkey FROM supplier UNION SELECT 'nation/'||n_nationkey, 'region/'||n_regionkey FROM nation"
_TURN = "SELECT 'turn/'||a.conv_id||':'||a.turn s, 'turn/'||b.conv_id||':'||b.turn o FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1"
_RING = "SELECT 'nation/'||n_nationkey s, 'nation/'||((n_nationkey+1)%25) o FROM nation"

_program("tc_located_in", "customer_nation supplier_nation nation_region", 'L(x, y) :- Edge(x, "in_nation", y). L(x, y) :- Edge(x, "in_region", y). L(x, z) :- L(x, y), Edge(y, "in_region", z). L(x, y)?', _CLOSE.format(e=_LOCATED, out="x, y", where=""))
_program("tc_turns_nonlinear", "turns", 'T(x, y) :- Edge(x, "next", y). T(x, z) :- T(x, y), T(y, z). T(x, y)?', _CLOSE.format(e=_TURN, out="x, y", where=""))
_program("tc_turns_right_linear", "turns", 'T(x, y) :- Edge(x, "next", y). T(x, z) :- Edge(x, "next", y), T(y, z). T(x, y)?', _CLOSE.format(e=_TURN, out="x, y", where=""))
_program("tc_ring_cycle", "ring", 'N(x, y) :- Edge(x, "next", y). N(x, z) :- N(x, y), N(y, z). N(x, y)?', _CLOSE.format(e=_RING, out="x, y", where=""))
_program("tc_bound_forward", "ring", 'N(x, y) :- Edge(x, "next", y). N(x, z) :- N(x, y), N(y, z). N("nation/3", y)?', _CLOSE.format(e=_RING, out="y", where=" WHERE x='nation/3'"))
_program("tc_bound_backward", "customer_nation nation_region", 'L(x, y) :- Edge(x, "in_nation", y). L(x, y) :- Edge(x, "in_region", y). L(x, z) :- L(x, y), L(y, z). L(x, "region/1")?', "SELECT 'customer/'||c_custkey AS x FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=1 UNION SELECT 'nation/'||n_nationkey FROM nation WHERE n_regionkey=1")
_program("mutual_even_odd", "turns", 'Odd(x, y) :- Edge(x, "next", y). Even(x, z) :- Odd(x, y), Edge(y, "next", z). Odd(x, z) :- Even(x, y), Edge(y, "next", z). Even(x, y)?', f"WITH RECURSIVE e AS ({_TURN}), r(x, y, odd) AS (SELECT s, o, true FROM e UNION SELECT r.x, e.o, NOT r.odd FROM r JOIN e ON e.s=r.y) SELECT x, y FROM r WHERE NOT odd")
_TURNS_TWICE = 'T(x, y) :- Edge(x, "next", y). T(x, z) :- T(x, y), T(y, z). T(x, y)?'
_program("tc_turns_nonlinear_in_memory", "turns", _TURNS_TWICE, _CLOSE.format(e=_TURN, out="x, y", where=""), small_graphs=True)
_program("tc_bound_forward_in_memory", "ring", 'N(x, y) :- Edge(x, "next", y). N(x, z) :- N(x, y), N(y, z). N("nation/3", y)?', _CLOSE.format(e=_RING, out="y", where=" WHERE x='nation/3'"), small_graphs=True)
_program("mutual_even_odd_in_memory", "turns", 'Odd(x, y) :- Edge(x, "next", y). Even(x, z) :- Odd(x, y), Edge(y, "next", z). Odd(x, z) :- Even(x, y), Edge(y, "next", z). Even(x, y)?', f"WITH RECURSIVE e AS ({_TURN}), r(x, y, odd) AS (SELECT s, o, true FROM e UNION SELECT r.x, e.o, NOT r.odd FROM r JOIN e ON e.s=r.y) SELECT x, y FROM r WHERE NOT odd", small_graphs=True)
_program("tc_from_derived_seed", "nation_region customer_nation", 'S(x, y) :- Edge(x, "in_nation", y). S(x, y) :- Edge(x, "in_region", y). R(x, y) :- S(x, y). R(x, z) :- R(x, y), S(y, z). R(x, y)?', _CLOSE.format(e="SELECT 'customer/'||c_custkey s, 'nation/'||c_nationkey o FROM customer UNION SELECT 'nation/'||n_nationkey, 'region/'||n_regionkey FROM nation", out="x, y", where=""))
_program("same_generation", "nation_region customer_nation", 'Up(x, y) :- Edge(x, "in_nation", y). Up(x, y) :- Edge(x, "in_region", y). Same(x, y) :- Edge(x, "in_region", r), Edge(y, "in_region", r). Under(x, r) :- Up(x, r). Under(x, r) :- Up(x, y), Under(y, r). Pair(x, r) :- Same("nation/0", x), Under(x, r). Pair(x, r)?', "SELECT 'nation/'||b.n_nationkey AS x, 'region/'||b.n_regionkey AS r FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey=0".replace("b.n_regionkey", "n_regionkey"))

# --- options that keep edges near ---

_program("cached_star_join", "customer_nation nation_name order_status", 'Edge(c, "in_nation", n), Edge(n, "name", m)?', "SELECT 'customer/'||c_custkey AS c, 'nation/'||n_nationkey AS n, n_name AS m FROM customer JOIN nation ON c_nationkey=n_nationkey", cache_rows=1_000_000)
_program("cached_too_large", "customer_nation nation_name", 'Edge(c, "in_nation", n), Edge(n, "name", m)?', "SELECT 'customer/'||c_custkey AS c, 'nation/'||n_nationkey AS n, n_name AS m FROM customer JOIN nation ON c_nationkey=n_nationkey", cache_rows=10)
_program("held_point_lookup", "nation_name nation_region", 'Edge("nation/4", p, o)?', "SELECT 'name' AS p, n_name AS o FROM nation WHERE n_nationkey=4 UNION ALL SELECT 'in_region', 'region/'||n_regionkey FROM nation WHERE n_nationkey=4", held_rows=10_000)

# --- language ---

_program("comments_and_escapes", "", '% first\nEdge("a\\n\\"b\\\\c", "p", "it\'s % no comment"). % last\nEdge(x, "p", y)? % end', "SELECT 'a'||chr(10)||'\"b\\c' AS x, 'it''s % no comment' AS y")
_program("cid_literal", "", 'DefCompound("Pair", "k", "0", "liquid/string"). Pair@(cid="Pair@(k=\'v\')", k="v"). Pair@(cid=c, k=k)?', "SELECT 'Pair@(k=''v'')' AS c, 'v' AS k")


_REFUSED = {
    "atom_of_another_predicate": 'Nothing("a").', "cid_of_another_compound": 'DefCompound("Pair", "k", "0", "liquid/string"). Pair@(cid="other", k="v").', "compound_with_a_role_too_many": 'ReadCompound@(principal="p", compound_type="t", more="m").', "cross_reference_without_binding": 'Edge(x, "p", "o").',
    "no_output": 'Edge("a", "p", "b")?', "not_a_program": "Edge(", "unknown_compound": 'Nothing@(k="v").', "unsafe_rule": 'R(x, y) :- Edge(x, "p", _). R(x, y)?',
}


@_function("SELECT * FROM (VALUES ('atom_of_another_predicate', '42601'), ('cid_of_another_compound', '22000'), ('compound_with_a_role_too_many', '22023'), ('cross_reference_without_binding', '42601'), ('empty_principal', '22023'), ('no_output', '22023'), ('not_a_program', '42601'), ('read_only', '42501'), ('too_many_columns', '42804'), ('too_many_rounds', '54000'), ('unknown_compound', '22023'), ('unsafe_rule', '42601'), ('edges_left_by_all_these', '0'), ('program_without_query', 'no answer')) t(what, result)")
def errors_and_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, with its SQLSTATE, and that a refused call leaves nothing behind."""
    engine = Engine(graph(spark, sf_dir, "ring"))
    before = engine.store.live().count()
    calls = {name: lambda t=text: engine.query(t) for name, text in _REFUSED.items()}
    calls |= {
        "empty_principal": lambda: engine.query_as("", 'Edge(x, "p", y)?'),
        "read_only": lambda: engine.read_as("me", 'Edge("a", "p", "b"). Edge(x, "p", y)?'),
        "too_many_columns": lambda: engine.query('Edge("a", "p", "b"). Edge(x, "p", y)?', ["one", "two", "three"]),
        "too_many_rounds": lambda: _limited(engine),
    }
    found = []
    for name, call in calls.items():
        try:
            call()
            found.append((name, "no error"))
        except EngineError as e:
            found.append((name, e.sqlstate))
    found.append(("edges_left_by_all_these", str(engine.store.live().count() - before)))
    found.append(("program_without_query", "no answer" if engine.query('Edge("a", "p", "b").') is None else "an answer"))
    return local_table(spark, found, ["what", "result"])


def _limited(engine: Engine) -> None:
    """Two rounds are too few for the ring; the limit is the language's, lowered here."""
    most, fixpoint.MOST_ROUNDS = fixpoint.MOST_ROUNDS, 2
    try:
        engine.query('Edge("more", "next", "nation/0"). N(x, y) :- Edge(x, "next", y). N(x, z) :- N(x, y), N(y, z). N(x, y)?')
    finally:
        fixpoint.MOST_ROUNDS = most


# --- schema as data ---

_program("schema_def_pred", "", 'DefPred("nick", "1", "liquid/node", "0", "liquid/string"). DefPred("nick", sc, st, oc, ot)?', "SELECT '1' AS sc, 'liquid/node' AS st, '0' AS oc, 'liquid/string' AS ot")
_program("schema_def_compound", "", 'DefCompound("Trip", "from", "0", "liquid/node"). DefCompound("Trip", "to", "1", "liquid/string"). DefCompound("Trip", p, oc, ot)?', "SELECT 'from' AS p, '0' AS oc, 'liquid/node' AS ot UNION ALL SELECT 'to', '1', 'liquid/string'")
_program("schema_type_cardinality", "", 'DefPred("nick", "1", "liquid/node", "0", "liquid/string"). Smeta@(cid=m, liquid/subject_meta="nick"), TypeAndCardinality(m, t, c)?', "SELECT 'Smeta@(liquid/subject_meta=''nick'')' AS m, 'liquid/node' AS t, '1' AS c")
_program("schema_object_meta", "", 'DefPred("nick", "1", "liquid/node", "0", "liquid/string"). Ometa@(cid=m, liquid/object_meta="nick")?', "SELECT 'Ometa@(liquid/object_meta=''nick'')' AS m")
_program("schema_bootstrap", "", 'Edge("ReadTriple", "liquid/compound_predicate", r)?', "SELECT unnest(['principal', 'user', 'subject', 'predicate', 'object']) AS r")

# --- assertions ---

_program("assert_then_query", "nation_name", 'Edge("nation/0", "capital", "Algiers"). Edge("nation/0", "capital", "Algiers"). Edge(n, "capital", c), Edge(n, "name", m)?', "SELECT 'nation/0' AS n, 'Algiers' AS c, n_name AS m FROM nation WHERE n_nationkey=0")
_program("assert_compound_clause", "", 'DefCompound("Film", "actor", "0", "liquid/string"). DefCompound("Film", "title", "0", "liquid/string"). Film@(cid=f, actor="O\'Neil", title="A"), Edge(f, "kind", "drama"). Film@(cid=c, actor=a), Edge(c, "kind", k)?', "SELECT 'Film@(actor=''O''''Neil'', title=''A'')' AS c, 'O''Neil' AS a, 'drama' AS k")


@_function("SELECT 'nation/'||n_nationkey AS s, n_name AS o FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey = 4")
def tombstone_and_reactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = graph(spark, sf_dir, "nation_name")
    even = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(node("nation", "n_nationkey").alias("subject"), F.lit("name").alias("predicate"), F.col("n_name").alias("object"))
    store.tombstone(even)
    store.insert(even.filter("subject = 'nation/4'"))
    return Engine(store).query('Edge(s, "name", o)?')


# --- compounds and normalizers ---

_ORDER = 'DefCompound("Order", "id", "0", "liquid/string"). DefCompound("Order", "customer", "0", "liquid/string"). DefCompound("Order", "status", "0", "liquid/string").'
_CID = "'Order@(customer=''customer/'||o_custkey||''', id=''order/'||o_orderkey||''', status='''||o_orderstatus||''')'"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), node("order", "o_orderkey").alias("id"), node("customer", "o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))


def _order_store(spark: SparkSession, rows: DataFrame, roles: str = "id customer status") -> tuple[Engine, Normalizers]:
    engine = Engine(graph(spark, ""))
    engine.query(_ORDER)
    normalizers = Normalizers(engine.store)
    normalizers.create("orders", rows, "order", "Order", {r: r for r in roles.split()}, ["key"])
    return engine, normalizers


@_function(f"SELECT {_CID} AS c, 'order/'||o_orderkey AS i, 'customer/'||o_custkey AS u, o_orderstatus AS s FROM orders")
def compound_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_store(spark, _orders(spark, sf_dir))[0].query("Order@(cid=c, id=i, customer=u, status=s)?")


@_function("SELECT 'customer/'||o_custkey AS u, o_orderstatus AS s FROM orders")
def compound_subset_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_store(spark, _orders(spark, sf_dir))[0].query("Order@(customer=u, status=s)?")


@_function(f"SELECT {_CID} AS c FROM orders WHERE o_orderstatus='P'")
def compound_constant_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_store(spark, _orders(spark, sf_dir))[0].query('Order@(cid=c, status="P")?')


@_function("SELECT 'order/'||o_orderkey AS i, 'customer/'||o_custkey AS c, 'nation/'||c_nationkey AS x, n_name AS n FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE o_orderstatus='P'")
def compound_edge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _order_store(spark, _orders(spark, sf_dir))
    for part in ("customer_nation", "nation_name"):
        engine.store.insert(graph(spark, sf_dir, part).live())
    return engine.query('Order@(id=i, customer=c, status="P"), Edge(c, "in_nation", x), Edge(x, "name", n)?')


@_function("SELECT 'order/'||o_orderkey AS i, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0")
def normalizer_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    engine, normalizers = _order_store(spark, rows)
    old = rows.filter("key % 3 = 0")
    normalizers.apply_changes("orders", old, old.withColumn("status", F.lit("X")))
    normalizers.apply_changes("orders", rows.withColumn("status", F.when(F.col("key") % 3 == 0, "X").otherwise(F.col("status"))).filter("key % 5 = 0"), None)
    return engine.query("Order@(id=i, status=s)?")


@_function("SELECT DISTINCT 'customer/'||o_custkey AS u, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 1")
def normalizer_shared_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows support one compound; it lives until the last goes."""
    engine = Engine(graph(spark, ""))
    engine.query('DefCompound("Mood", "customer", "0", "liquid/string"). DefCompound("Mood", "status", "0", "liquid/string").')
    normalizers, rows = Normalizers(engine.store), _orders(spark, sf_dir)
    normalizers.create("orders", rows, "mood", "Mood", {"customer": "customer", "status": "status"}, ["key"])
    normalizers.apply_changes("orders", rows.filter("key % 2 = 0"), None)
    return engine.query("Mood@(customer=u, status=s)?")


@_function("SELECT 'order/'||o_orderkey AS i, o_orderstatus AS s FROM orders WHERE o_orderkey % 4 <> 0")
def normalizer_null_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("customer", F.when(F.col("key") % 4 != 0, F.col("customer")))
    return _order_store(spark, rows)[0].query("Order@(id=i, status=s)?")


@_function("SELECT 'order/'||o_orderkey AS i FROM orders")
def normalizer_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    engine, normalizers = _order_store(spark, rows)
    engine.store.tombstone(engine.store.live().filter("predicate = 'id' and subject like 'Order@(%'"))
    normalizers.rebuild("orders", "order", rows)
    return engine.query("Order@(id=i)?")


@_function("SELECT 'order/'||o_orderkey AS i FROM orders")
def normalizer_drop_keeping_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, normalizers = _order_store(spark, _orders(spark, sf_dir))
    normalizers.drop("orders", "order", purge=False)
    return engine.query("Order@(id=i)?")


@_function("SELECT 'order/'||o_orderkey AS i, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0")
def normalizer_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates and deletes through Structured Streaming."""
    rows = _orders(spark, sf_dir)
    engine, normalizers = _order_store(spark, rows)
    after = F.when(F.col("key") % 7 != 0, F.struct("key", "id", "customer", F.when(F.col("key") % 2 == 0, "Z").otherwise(F.col("status")).alias("status")))
    folder = write_table(rows.filter("key % 2 = 0 or key % 7 = 0").select(F.struct("key", "id", "customer", "status").alias("before"), after.alias("after")), "stream")
    changes = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    changes.writeStream.foreachBatch(normalizers.change_sink("orders")).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    return engine.query("Order@(id=i, status=s)?")


@_function("SELECT 'order/'||o_orderkey AS i, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders")
def normalizer_after_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations, ledger and edges are saved and loaded; changes go on."""
    rows = _orders(spark, sf_dir)
    engine, normalizers = _order_store(spark, rows)
    folder = f"{shared_folder(spark)}/quiverlog-graph/saved-{uuid.uuid4().hex}"
    engine.store.save(folder, normalizers)
    again = Normalizers.load(spark, folder)
    old = rows.filter("key % 3 = 0")
    again.apply_changes("orders", old, old.withColumn("status", F.lit("X")))
    return Engine(again.store).query("Order@(id=i, status=s)?")


@_function(f"SELECT {_CID} AS cid, unnest(['customer', 'id', 'status']) AS role, unnest(['customer/'||o_custkey, 'order/'||o_orderkey, o_orderstatus]) AS value FROM orders")
def project_compound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(graph(spark, ""))
    engine.query(_ORDER)
    return engine.project_compound_edges("Order", _orders(spark, sf_dir), {r: r for r in ("id", "customer", "status")})


@_function("SELECT 'order/'||o_orderkey AS i FROM orders WHERE false")
def normalizer_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, normalizers = _order_store(spark, _orders(spark, sf_dir))
    normalizers.drop("orders", "order")
    return engine.query("Order@(id=i)?")


# --- visibility ---

_STATUS_OF = "SELECT 'order/'||o_orderkey AS s, o_orderstatus AS o FROM orders"
_program("cls_by_subject", "order_customer order_status", 'Edge(s, "status", o)?', f"{_STATUS_OF} WHERE o_custkey=7", "customer/7", 'PredicateReadBySubject@(predicate="status", relation="placed_by").')
_program("cls_by_subject_legacy", "order_customer order_status", 'Edge(s, "status", o)?', f"{_STATUS_OF} WHERE o_custkey=7", "customer/7", 'Edge("status", "liquid/readable_if_subject_has", "placed_by").')
_program("cls_by_object", "order_customer customer_nation", 'Edge(s, "placed_by", o)?', "SELECT 'order/'||o_orderkey AS s, 'customer/'||o_custkey AS o FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey=3", "nation/3", 'PredicateReadByObject@(predicate="placed_by", relation="in_nation").')
_program("cls_by_object_legacy", "order_customer customer_nation", 'Edge(s, "placed_by", o)?', "SELECT 'order/'||o_orderkey AS s, 'customer/'||o_custkey AS o FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey=3", "nation/3", 'Edge("placed_by", "liquid/readable_if_object_has", "in_nation").')
_program("cls_read_predicate", "nation_name nation_region", 'Edge(s, p, o), Edge(s, "name", _)?', "SELECT 'nation/'||n_nationkey AS s, 'name' AS p, n_name AS o FROM nation", "agent:a", 'ReadPredicate@(principal="agent:a", predicate="name").')
_program("cls_read_predicate_legacy", "nation_name nation_region", 'Edge(s, "name", o)?', "SELECT 'nation/'||n_nationkey AS s, n_name AS o FROM nation", "agent:a", 'Edge("agent:a", "liquid/can_read_predicate", "name").')
_program("cls_read_triple", "nation_region", 'Edge(s, "in_region", o)?', "SELECT 'nation/0' AS s, 'region/0' AS o FROM nation WHERE n_nationkey=0 AND n_regionkey=0", "agent:t", 'ReadTriple@(principal="x", user="agent:t", subject="nation/0", predicate="in_region", object="region/0").')
_program("cls_acts_for_chain", "nation_name", 'Edge(s, "name", o)?', "SELECT 'nation/'||n_nationkey AS s, n_name AS o FROM nation", "agent:b", 'Edge("agent:b", "liquid/acts_for", "team:m"). Edge("team:m", "liquid/acts_for", "agent:a"). Edge("agent:a", "liquid/acts_for", "agent:b"). ReadPredicate@(principal="agent:a", predicate="name").')
_program("cls_untrusted", "nation_name", 'Edge(s, "name", o)?', "SELECT n_name AS s, n_name AS o FROM nation WHERE false", "stranger", 'ReadPredicate@(principal="agent:a", predicate="name").')
_program("cls_rule_recursion", "nation_region customer_nation", 'L(x, y) :- Edge(x, "in_nation", y). L(x, y) :- Edge(x, "in_region", y). L(x, z) :- L(x, y), L(y, z). L(x, y)?', "SELECT 'nation/'||n_nationkey AS x, 'region/'||n_regionkey AS y FROM nation", "agent:a", 'ReadPredicate@(principal="agent:a", predicate="in_region").')


_program("cls_acts_for_by_joins", "nation_name", 'Edge(s, "name", o)?', "SELECT 'nation/'||n_nationkey AS s, n_name AS o FROM nation", "agent/0", "".join(f'Edge("agent/{i}", "liquid/acts_for", "agent/{i + 1}"). ' for i in range(4)) + 'ReadPredicate@(principal="agent/4", predicate="name").')


def _by_joins(run: Query) -> Query:
    def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
        most, policy.SMALL_ACTS = policy.SMALL_ACTS, 1
        try:
            return run(spark, sf_dir)
        finally:
            policy.SMALL_ACTS = most

    return limited


QUERIES["cls_acts_for_by_joins"] = _by_joins(QUERIES["cls_acts_for_by_joins"])


@_function(f"{_STATUS_OF} WHERE o_custkey=7")
def query_as_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program asserts, then reads as another principal than the session's."""
    engine = Engine(graph(spark, sf_dir, "order_customer", "order_status"), principal="stranger")
    return engine.query_as("customer/7", 'PredicateReadBySubject@(predicate="status", relation="placed_by"). Edge(s, "status", o)?')


def _visible_orders(spark: SparkSession, sf_dir: str, grant: str, principal: str, program: str) -> DataFrame:
    engine, _ = _order_store(spark, _orders(spark, sf_dir))
    engine.query(grant)
    return engine.read_as(principal, program)


@_function("SELECT 'order/'||o_orderkey AS i, o_orderstatus AS s FROM orders")
def cls_read_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible_orders(spark, sf_dir, 'ReadCompound@(principal="agent:a", compound_type="Order").', "agent:a", "Order@(id=i, status=s)?")


@_function("SELECT 'order/'||o_orderkey AS i, o_orderstatus AS s FROM orders WHERE o_custkey=7")
def cls_compound_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible_orders(spark, sf_dir, 'CompoundReadByRole@(compound_type="Order", role="customer").', "customer/7", "Order@(id=i, status=s)?")


@_function("SELECT 'order/'||o_orderkey AS i, o_orderstatus AS s FROM orders WHERE o_custkey=7")
def cls_compound_by_role_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible_orders(spark, sf_dir, 'Edge("Order", "liquid/readable_compound_if_role_has", "customer").', "customer/7", "Order@(id=i, status=s)?")


@_function("SELECT 'order/'||o_orderkey AS i, o_orderstatus AS s FROM orders")
def cls_read_compound_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible_orders(spark, sf_dir, 'Edge("agent:a", "liquid/can_read_compound", "Order").', "agent:a", "Order@(id=i, status=s)?")


@_function("SELECT 'order/'||o_orderkey AS s, o_orderstatus AS o FROM orders WHERE false")
def cls_hidden_role_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible_orders(spark, sf_dir, 'CompoundReadByRole@(compound_type="Order", role="customer").', "customer/7", 'Edge(s, "status", o)?')


@_function(f"SELECT {_CID} AS c, o_orderstatus AS s FROM orders")
def cls_compound_by_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All role edges that the atom names are visible, others need not be."""
    return _visible_orders(spark, sf_dir, 'ReadPredicate@(principal="agent:a", predicate="status").', "agent:a", "Order@(cid=c, status=s)?")


# --- around a query: what host SQL adds ---


@_function("SELECT 'nation/'||c_nationkey AS n, count(*)::BIGINT AS customers FROM customer GROUP BY 1")
def aggregate_over_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(graph(spark, sf_dir, "customer_nation")).query('Edge(_, "in_nation", n)?').groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


@_function("SELECT s, p FROM (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS k FROM (SELECT DISTINCT 'supplier/'||l_suppkey AS s, 'part/'||l_partkey AS p FROM lineitem)) WHERE k <= 3")
def top_k_over_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the first three parts of each supplier."""
    found = Engine(graph(spark, sf_dir, "supplies")).query('Edge(s, "supplies", p)?')
    return found.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("p"))).filter("k <= 3").drop("k")


@_function("SELECT p AS reached, count(*)::BIGINT AS sources FROM (SELECT 'region/'||n_regionkey AS p FROM customer JOIN nation ON c_nationkey=n_nationkey) GROUP BY 1")
def sql_around_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(graph(spark, sf_dir, "customer_nation", "nation_region"))
    engine.register("reached_regions", 'Edge(c, "in_nation", n), Edge(n, "in_region", r)?', ["c", "n", "r"])
    return spark.sql("SELECT r AS reached, count(*) AS sources FROM reached_regions GROUP BY r")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tc_located_in"](spark, sf_dir)
