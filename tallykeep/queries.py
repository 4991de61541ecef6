"""The engine's queries over the test tables, and the SQL that recomputes each result from scratch.

Maintained results go all the way: seed, change stream, certificates, deltas, merge. Their SQL aggregates the
tables as they are after the changes.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import design as D
from .functions import values as V
from .functions.synthetic import MUTATED_ORDERS, SHIFT, as_events, changed_orders, order_events, orders, read
from .operators import advisor as A
from .operators import joins as J
from .operators.certify import certify, certify_sql, with_latch
from .operators.extremum import best_window, extremum, merge_multiset, multiset, window_decisions
from .operators.maintain import apply_changes, from_group_state, maintain, maintain_or_rebuild
from .operators.store import effective_counts, receipts
from .plans.admission import parse_join_sql, parse_sql
from .plans.shapes import JoinClause, JoinShape, Predicate, QueryShape, cold_state, displayed, group_state_sql, join_sql
from .sources.cdc import decode_records, encode_debezium, encode_wal2json_v1, encode_wal2json_v2
from .streaming.transactions import assemble
from .streaming.workloads import policy_sweep

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLE_SQL: dict[str, str] = {}
MONEY = "decimal(38,2)"


def query(name: str, sql: str | None = None):
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL for a table of fixed values."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _shape(sql: str) -> QueryShape:
    got = parse_sql(sql)
    if not got.is_supported:
        raise ValueError(f"{got.reason}: {sql}")
    return got.shape


def _named(df: DataFrame, *names: str) -> DataFrame:
    for i, n in enumerate(names):
        df = df.withColumnRenamed(f"g{i}", n)
    return df


def _customers(s: SparkSession, d: str) -> int:
    return read(s, d, "customer").count()


def _events(s: SparkSession, d: str) -> DataFrame:
    return order_events(orders(s, d), _customers(s, d))


SUM_BY_STATUS = "SELECT o_orderstatus, SUM(o_totalprice) FROM orders GROUP BY o_orderstatus"
WITH = f"WITH {MUTATED_ORDERS}"

# ---------------------------------------------------------------- cold results


@query("cold_sum_by_status", "SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total FROM orders GROUP BY 1")
def _(s, d):
    return _named(cold_state(_shape(SUM_BY_STATUS), orders(s, d)), "o_orderstatus").select("o_orderstatus", F.col("sum_val").cast(MONEY).alias("total"))


@query("cold_count_star", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return _named(cold_state(_shape("SELECT o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority"), orders(s, d)), "o_orderpriority").select("o_orderpriority", F.col("rows").alias("n"))


NULLED = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END"


@query("cold_count_col_nulls", f"SELECT o_orderstatus, COUNT({NULLED}) AS n, COUNT(*) AS n_rows FROM orders GROUP BY 1")
def _(s, d):
    rows = orders(s, d).withColumn("price", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    state = cold_state(_shape("SELECT o_orderstatus, COUNT(price) FROM orders GROUP BY o_orderstatus"), rows)
    return _named(state, "o_orderstatus").select("o_orderstatus", "n", F.col("rows").alias("n_rows"))


@query("cold_avg", "SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS avg_price FROM orders GROUP BY 1")
def _(s, d):
    shape = _shape("SELECT o_orderpriority, AVG(o_totalprice) FROM orders GROUP BY o_orderpriority")
    return _named(cold_state(shape, orders(s, d)), "o_orderpriority").select("o_orderpriority", displayed("avg").alias("avg_price"))


@query("cold_ungrouped_empty", "SELECT COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total FROM orders WHERE o_orderstatus = 'none'")
def _(s, d):
    state = cold_state(_shape("SELECT SUM(o_totalprice) FROM orders WHERE o_orderstatus = 'none'"), orders(s, d))
    return state.select(F.col("rows").alias("n"), displayed("sum").cast(MONEY).alias("total"))


for _name, _op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _where = f"o_totalprice {_op} 1000.50 AND o_orderstatus <> 'P'" if _name != "eq" else "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"

    @query(f"predicate_{_name}", f"SELECT COUNT(*) AS n FROM (SELECT CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderstatus, o_orderpriority FROM orders) WHERE {_where}")
    def _(s, d, where=_where):
        return cold_state(_shape(f"SELECT COUNT(*) FROM orders WHERE {where}"), orders(s, d)).select(F.col("rows").alias("n"))


# ---------------------------------------------------------------- maintained results, one table


def _maintained(s, d, sql: str) -> DataFrame:
    shape = _shape(sql)
    return maintain(shape, cold_state(shape, orders(s, d)), _events(s, d))[1]


@query("ivm_sum_after_cdc", f"{WITH} SELECT o_orderstatus, CAST(SUM(o_totalprice) AS DECIMAL(38,2)) AS total, COUNT(*) AS n FROM mutated GROUP BY 1")
def _(s, d):
    return _named(_maintained(s, d, SUM_BY_STATUS), "o_orderstatus").select("o_orderstatus", F.col("sum_val").cast(MONEY).alias("total"), F.col("rows").alias("n"))


@query("ivm_count_after_cdc", f"{WITH} SELECT o_orderstatus, COUNT(*) AS n FROM mutated WHERE o_totalprice > 1000 GROUP BY 1")
def _(s, d):
    return _named(_maintained(s, d, "SELECT o_orderstatus, COUNT(*) FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus"), "o_orderstatus").select("o_orderstatus", F.col("rows").alias("n"))


@query("ivm_avg_after_cdc", f"{WITH} SELECT o_orderpriority, CAST(SUM(o_totalprice) AS DOUBLE) / COUNT(*) AS avg_price FROM mutated GROUP BY 1")
def _(s, d):
    return _named(_maintained(s, d, "SELECT o_orderpriority, AVG(o_totalprice) FROM orders GROUP BY o_orderpriority"), "o_orderpriority").select("o_orderpriority", displayed("avg").alias("avg_price"))


@query("ivm_multi_group_after_cdc", f"{WITH} SELECT o_orderstatus, o_orderpriority, CAST(SUM(o_totalprice) AS DECIMAL(38,2)) AS total FROM mutated WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def _(s, d):
    out = _maintained(s, d, "SELECT o_orderstatus, o_orderpriority, SUM(o_totalprice) FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus, o_orderpriority")
    return _named(out, "o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority", F.col("sum_val").cast(MONEY).alias("total"))


@query("ivm_group_eviction", f"{WITH} SELECT o_custkey, COUNT(*) AS n FROM mutated GROUP BY 1")
def _(s, d):
    return _named(_maintained(s, d, "SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey"), "o_custkey").select("o_custkey", F.col("rows").alias("n"))


@query("source_after_cdc", f"{WITH} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM mutated")
def _(s, d):
    return apply_changes(orders(s, d), _events(s, d), "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


FLIP = "o_orderkey % 23 = 0 AND o_orderstatus IN ('F', 'O')"
EVENT_KINDS = f"""
WITH e AS (
  SELECT 'DELETE' AS op, o_orderstatus AS s, 1 AS x FROM orders WHERE o_orderkey % 19 = 0
  UNION ALL SELECT 'UPDATE:' || CASE WHEN {FLIP} THEN 'group' WHEN o_orderkey % 17 = 0 THEN 'value' ELSE 'other' END, o_orderstatus, 1 FROM orders
    WHERE o_orderkey % 19 <> 0 AND (o_orderkey % 17 = 0 OR o_orderkey % 23 = 0 OR o_orderkey % 29 = 0)
  UNION ALL SELECT 'INSERT', o_orderstatus, 1 FROM orders WHERE o_orderkey % 31 = 0
)"""


@query(
    "decision_counts_single",
    EVENT_KINDS
    + """, r AS (SELECT CASE op WHEN 'DELETE' THEN 'repair' WHEN 'INSERT' THEN 'repair' WHEN 'UPDATE:other' THEN 'preserve' ELSE 'repair' END AS decision,
  CASE op WHEN 'DELETE' THEN 'delete' WHEN 'INSERT' THEN 'insert' WHEN 'UPDATE:group' THEN 'group_move' WHEN 'UPDATE:value' THEN 'value_change' ELSE 'disjoint_columns' END AS reason FROM e)
SELECT decision, reason, COUNT(*) AS n FROM r GROUP BY ALL""",
)
def _(s, d):
    return certify(_events(s, d), _shape(SUM_BY_STATUS)).groupBy("decision", "reason").agg(F.count("*").alias("n"))


@query(
    "latch_decisions",
    """WITH e AS (SELECT event_id AS seq, user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events),
l AS (SELECT bad, coalesce(max(bad) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM e)
SELECT CASE WHEN late = 1 OR bad = 1 THEN 'invalidate' ELSE 'repair' END AS decision,
  CASE WHEN late = 1 THEN 'cache_requires_rebuild' WHEN bad = 1 THEN 'truncate_event' ELSE 'insert' END AS reason, COUNT(*) AS n FROM l GROUP BY ALL""",
)
def _(s, d):
    e = read(s, d, "events")
    row = V.image(e, {"event_type": F.col("event_type"), "user_id": F.col("user_id")})
    bad = F.col("event_type") == "error"
    ev = as_events(e, "events", F.col("event_id"), F.when(bad, "TRUNCATE").otherwise("INSERT"), F.lit(None).cast(V.IMAGE), F.when(~bad, row))
    ev = ev.drop("stream_id").join(e.select(F.col("event_id").alias("_e"), F.col("user_id").cast("string").alias("stream_id")), F.col("seq") == F.col("_e"))
    c = certify(ev, QueryShape("events", "count_star", None, ("event_type",), name="by_type"))
    return with_latch(c, ["stream_id"]).groupBy("decision", "reason").agg(F.count("*").alias("n"))


@query(
    "toast_decisions",
    """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'missing_evidence_for_repair' WHEN o_orderkey % 3 = 1 THEN 'disjoint_columns' ELSE 'value_change' END AS reason, COUNT(*) AS n
FROM orders GROUP BY 1""",
)
def _(s, d):
    o = orders(s, d)
    k = F.col("o_orderkey") % 3
    old = V.image(o, {c: c for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")})
    new = V.image(o.withColumn("p", F.col("o_totalprice") + F.when(k == 1, 0).otherwise(1)), {"o_orderkey": F.col("o_orderkey"), "o_orderstatus": F.col("o_orderstatus"), "o_totalprice": F.col("p"), "o_orderpriority": F.lit("x")})
    o = o.withColumn("p", F.col("o_totalprice") + F.when(k == 1, 0).otherwise(1))
    new = V.image(o, {"o_orderkey": F.col("o_orderkey"), "o_orderstatus": F.col("o_orderstatus"), "o_totalprice": F.col("p"), "o_orderpriority": F.lit("x")})
    new = F.when(k == 0, F.map_filter(new, lambda c, _: c != "o_totalprice")).otherwise(new)
    gone = F.when(k == 0, F.array(F.lit("o_totalprice")))
    ev = as_events(o.withColumn("_gone", gone), "orders", F.col("o_orderkey"), F.lit("UPDATE"), old, new).drop("unavailable_cols")
    ev = ev.withColumn("unavailable_cols", F.when(F.col("seq") % 3 == 0, F.array(F.lit("o_totalprice"))))
    return certify(ev, _shape(SUM_BY_STATUS)).groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- joins


KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey"}
JOIN_SQL = "SELECT customer.c_mktsegment, SUM(orders.o_totalprice) FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_mktsegment"
SNOWFLAKE_SQL = (
    "SELECT region.r_name, SUM(orders.o_totalprice) FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey "
    "JOIN nation ON customer.c_nationkey = nation.n_nationkey JOIN region ON nation.n_regionkey = region.r_regionkey WHERE orders.o_orderstatus <> 'P' GROUP BY region.r_name"
)
LEFT_SQL = "SELECT customer.c_mktsegment, COUNT(*) FROM orders LEFT JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_mktsegment"


def _join_shape(sql: str) -> JoinShape:
    got = parse_join_sql(sql, primary_keys=KEYS)
    if not got.is_supported:
        raise ValueError(f"{got.reason}: {sql}")
    return got.shape


def _tables(s, d) -> dict[str, DataFrame]:
    return {"orders": orders(s, d), "customer": read(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "nation": read(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "region": read(s, d, "region").select("r_regionkey", "r_name")}


def _total(state: DataFrame, name: str) -> DataFrame:
    return state.select(F.col("g0").alias(name), F.col("sum_val").cast(MONEY).alias("total"), F.col("rows").alias("n"))


PRICE = "CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total, COUNT(*) AS n"
SNOW_FROM = "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("join_inner_cold", f"SELECT c_mktsegment, {PRICE} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    return _total(J.cold_join_state(_join_shape(JOIN_SQL), _tables(s, d)), "c_mktsegment")


@query("join_left_cold", "SELECT c_mktsegment, COUNT(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    t = _tables(s, d)
    t["customer"] = t["customer"].where("c_custkey % 7 <> 0")
    return J.cold_join_state(_join_shape(LEFT_SQL), t).select(F.col("g0").alias("c_mktsegment"), F.col("rows").alias("n"))


@query("snowflake_cold", f"SELECT r_name, {PRICE} FROM orders {SNOW_FROM} WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(s, d):
    return _total(J.cold_join_state(_join_shape(SNOWFLAKE_SQL), _tables(s, d)), "r_name")


@query("join_multiplicity", "SELECT c_custkey AS key, COUNT(o_orderkey) AS facts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    return J.join_multiplicity(_join_shape(JOIN_SQL), _tables(s, d), "customer")


@query("ivm_join_fact_cdc", f"{WITH} SELECT c_mktsegment, CAST(SUM(o_totalprice) AS DECIMAL(38,2)) AS total, COUNT(*) AS n FROM mutated JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    shape, t = _join_shape(JOIN_SQL), _tables(s, d)
    return _total(J.maintain_join(shape, t, J.cold_join_state(shape, t), _events(s, d))[1], "c_mktsegment")


def _customer_moves(s, d) -> DataFrame:
    c = _tables(s, d)["customer"].where("c_custkey % 11 = 0").withColumn("to", (F.col("c_nationkey") + 1) % 25)
    old = V.image(c, {x: x for x in ("c_custkey", "c_nationkey", "c_mktsegment")})
    new = V.image(c, {"c_custkey": F.col("c_custkey"), "c_nationkey": F.col("to").cast("int"), "c_mktsegment": F.col("c_mktsegment")})
    return as_events(c, "customer", F.col("c_custkey") + 1_000_000_000, F.lit("UPDATE"), old, new)


MOVED = "moved AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS c_nationkey FROM customer)"


@query(
    "ivm_join_dim_cdc",
    f"{WITH}, {MOVED} SELECT r_name, CAST(SUM(o_totalprice) AS DECIMAL(38,2)) AS total, COUNT(*) AS n FROM mutated JOIN moved ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def _(s, d):
    shape, t = _join_shape(SNOWFLAKE_SQL), _tables(s, d)
    return _total(J.maintain_join(shape, t, J.cold_join_state(shape, t), _events(s, d).union(_customer_moves(s, d)))[1], "r_name")


@query("ivm_snowflake_root_cdc", f"SELECT CASE WHEN r_regionkey = 1 THEN 'RENAMED' ELSE r_name END AS r_name, {PRICE} FROM orders {SNOW_FROM} WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(s, d):
    shape, t = _join_shape(SNOWFLAKE_SQL), _tables(s, d)
    r = t["region"].where("r_regionkey = 1")
    ev = as_events(r, "region", F.lit(1), F.lit("UPDATE"), V.image(r, {c: c for c in r.columns}), V.image(r, {"r_regionkey": F.col("r_regionkey"), "r_name": F.lit("RENAMED")}))
    return _total(J.maintain_join(shape, t, J.cold_join_state(shape, t), ev)[1], "r_name")


def _customer_deletes(s, d) -> DataFrame:
    c = _tables(s, d)["customer"].where("c_custkey % 13 = 0")
    return as_events(c, "customer", F.col("c_custkey"), F.lit("DELETE"), V.image(c, {x: x for x in c.columns}), F.lit(None).cast(V.IMAGE))


@query("ivm_left_join_dim_delete", "SELECT c_mktsegment, COUNT(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 13 <> 0) ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    shape, t = _join_shape(LEFT_SQL), _tables(s, d)
    return J.maintain_join(shape, t, J.cold_join_state(shape, t), _customer_deletes(s, d))[1].select(F.col("g0").alias("c_mktsegment"), F.col("rows").alias("n"))


@query(
    "decision_counts_join",
    """WITH f AS (SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 13 = 0 GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'preserve' ELSE 'repair' END AS decision, CASE WHEN n = 0 THEN 'zero_join_multiplicity' ELSE 'dimension_delete' END AS reason, COUNT(*) AS n FROM f GROUP BY 1, 2""",
)
def _(s, d):
    out, _ = J.certify_join(_join_shape(LEFT_SQL), _tables(s, d), _customer_deletes(s, d))
    return out.groupBy("decision", "reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- extremum


def _price_shape(fn: str) -> QueryShape:
    return QueryShape("orders", fn, "o_totalprice", ("o_orderstatus",), name=fn)


@query("extremum_min", "SELECT o_orderstatus, MIN(CAST(o_totalprice AS DECIMAL(12,2))) AS value FROM orders GROUP BY 1")
def _(s, d):
    return _named(extremum(multiset(_price_shape("min"), orders(s, d)), "min"), "o_orderstatus")


@query("extremum_max_after_cdc", f"{WITH} SELECT o_orderstatus, CAST(MAX(o_totalprice) AS DECIMAL(12,2)) AS value FROM mutated GROUP BY 1")
def _(s, d):
    shape, ev = _price_shape("max"), _events(s, d)
    side = lambda img, sign: ev.where(F.col(img).isNotNull()).select(F.col(img)["o_orderstatus"]["v"].alias("g0"), F.col(img)["o_totalprice"]["v"].cast("decimal(12,2)").alias("v"), F.lit(sign).cast("long").alias("cnt"))
    return _named(extremum(merge_multiset(multiset(shape, orders(s, d)), side("old", -1).union(side("new", 1))), "max"), "o_orderstatus")


@query(
    "topk_window",
    """SELECT o_orderstatus, p AS v, COUNT(*) AS cnt FROM (
  SELECT o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS p, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_totalprice AS DECIMAL(12,2)) DESC) AS r FROM orders) WHERE r <= 10 GROUP BY 1, 2""",
)
def _(s, d):
    return _named(best_window(multiset(_price_shape("max"), orders(s, d)), "max", 10), "o_orderstatus")


@query("extremum_window_decisions")
def _(s, d):
    o = orders(s, d)
    key = F.pmod(F.xxhash64("o_custkey"), F.lit(64)).cast("string")
    row = F.create_map(F.lit("o_orderstatus"), F.col("o_orderstatus"), F.lit("o_totalprice"), F.col("o_totalprice").cast("string"))
    rows = o.select(key.alias("stream_id"), row.alias("row"))
    ev = o.where("o_orderkey % 3 = 0").select(key.alias("stream_id"), F.col("o_orderkey").alias("seq"), F.lit("orders").alias("relation"), F.lit("DELETE").alias("op"), row.alias("old"), F.lit(None).cast("map<string,string>").alias("new"))
    return window_decisions(_price_shape("max"), rows, ev, 8).groupBy("decision", "reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- change formats and transactions


def _wire(s, d) -> DataFrame:
    o = orders(s, d)
    return as_events(o, "orders", F.col("o_orderkey"), F.lit("INSERT"), F.lit(None).cast(V.IMAGE), V.image(o, {c: c for c in o.columns}))


BACK = "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice FROM orders"


def _back(records: DataFrame) -> DataFrame:
    at = lambda c, kind: F.col("new")[c]["v"].cast(kind).alias(c)
    return records.where("op = 'INSERT' and relation = 'public.orders'").select(at("o_orderkey", "long"), at("o_orderstatus", "string"), at("o_totalprice", "decimal(12,2)"))


@query("wal_debezium_roundtrip", BACK)
def _(s, d):
    return _back(decode_records(encode_debezium(_wire(s, d))))


@query("wal2json_v2_roundtrip", BACK)
def _(s, d):
    return _back(decode_records(encode_wal2json_v2(_wire(s, d))))


@query("wal2json_v1_roundtrip", BACK)
def _(s, d):
    return _back(decode_records(encode_wal2json_v1(_wire(s, d))))


def _transactions(s, d) -> DataFrame:
    """Inserts of every order in transactions of a hundred keys; each tenth is rolled back."""
    ev = _wire(s, d).withColumn("tx_id", F.floor(F.col("seq") / 100).cast("string"))
    data = encode_debezium(ev).withColumn("tx", F.floor(F.col("seq") / 100)).select(F.concat(F.lit("s"), F.floor(F.col("tx") / 10).cast("string")).alias("stream_id"), (F.col("seq") + F.col("tx") * 2 + 1).alias("seq"), "value")
    tx = ev.groupBy(F.floor(F.col("seq") / 100).alias("tx")).agg(F.count("*").alias("n"))
    stream = F.concat(F.lit("s"), F.floor(F.col("tx") / 10).cast("string"))
    mark = lambda status, at, n: tx.select(stream.alias("stream_id"), at.cast("long").alias("seq"), F.concat(F.lit('{"payload":{"status":"'), status, F.lit('","id":"'), F.col("tx").cast("string"), F.lit('"'), n, F.lit("}}")).alias("value"))
    end = F.when(F.col("tx") % 10 == 9, "ROLLBACK").otherwise("END")
    return data.union(mark(F.lit("BEGIN"), F.col("tx") * 102, F.lit(""))).union(mark(end, F.col("tx") * 102 + 101, F.concat(F.lit(',"event_count":'), F.col("n").cast("string"))))


@query("txn_commit_rollback", "SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total, COUNT(*) AS n FROM orders WHERE (o_orderkey // 100) % 10 <> 9 GROUP BY 1")
def _(s, d):
    released = assemble(decode_records(_transactions(s, d))).where("decision is null")
    shape = QueryShape("public.orders", "sum", "o_totalprice", ("o_orderstatus",))
    none = cold_state(shape, orders(s, d).where("false"))
    return _named(maintain(shape, none, released)[1], "o_orderstatus").select("o_orderstatus", F.col("sum_val").cast(MONEY).alias("total"), F.col("rows").alias("n"))


@query(
    "schema_drift_decisions",
    """WITH k AS (SELECT o_orderkey, o_orderkey % 50 AS g FROM orders), x AS (SELECT g, max(o_orderkey) AS last FROM k GROUP BY g HAVING count(*) > 1)
SELECT 'schema_evolution' AS reason, COUNT(*) AS n FROM x UNION ALL SELECT 'insert', COUNT(*) FROM k""",
)
def _(s, d):
    o = orders(s, d)
    g = F.concat(F.lit("s"), (F.col("o_orderkey") % 50).cast("string"))
    last = o.groupBy(g.alias("stream_id")).agg(F.max("o_orderkey").alias("last"))
    lines = encode_debezium(_wire(s, d)).drop("stream_id").withColumn("stream_id", F.concat(F.lit("s"), (F.col("seq") % 50).cast("string"))).join(last, "stream_id")
    more = F.regexp_replace("value", r'"after":\{', '"after":{"added":1,')
    lines = lines.select("stream_id", "seq", F.when(F.col("seq") == F.col("last"), more).otherwise(F.col("value")).alias("value"))
    released = assemble(decode_records(lines)).where("decision is null")
    shape = QueryShape("public.orders", "sum", "o_totalprice", ("o_orderstatus",))
    return certify(released, shape).groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- advisor


def _advised(s, d) -> tuple[DataFrame, list[QueryShape]]:
    """Updates of the events table that change value, event_type or props by key, against four shapes."""
    e = read(s, d, "events").select("event_id", "user_id", "event_type", F.col("value").cast("decimal(12,2)").alias("value"), "props")
    k = F.col("event_id") % 4
    e = e.withColumn("v2", F.when(k == 0, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(12,2)")).withColumn("t2", F.when(k == 1, F.lit("other")).otherwise(F.col("event_type"))).withColumn("p2", F.when(k >= 2, F.lit("{}")).otherwise(F.col("props")))
    cols = ("event_id", "user_id", "event_type", "value", "props")
    old = V.image(e, {c: c for c in cols})
    new = V.image(e, {"event_id": F.col("event_id"), "user_id": F.col("user_id"), "event_type": F.col("t2"), "value": F.col("v2"), "props": F.col("p2")})
    shapes = [
        QueryShape("events", "sum", "value", ("event_type",), name="sum_by_type"),
        QueryShape("events", "count_star", None, ("event_type",), name="types"),
        QueryShape("events", "sum", "value", (), name="total"),
        QueryShape("events", None, None, (), projection_cols=frozenset(["props"]), name="props"),
    ]
    return as_events(e, "events", F.col("event_id"), F.lit("UPDATE"), old, new), shapes


HITS = """WITH k AS (SELECT event_id, event_id % 4 AS k FROM events),
h AS (SELECT event_id, 'sum_by_type' AS shape, CASE k WHEN 0 THEN 'value' ELSE 'event_type' END AS col FROM k WHERE k IN (0, 1)
  UNION ALL SELECT event_id, 'types', 'event_type' FROM k WHERE k = 1
  UNION ALL SELECT event_id, 'total', 'value' FROM k WHERE k = 0
  UNION ALL SELECT event_id, 'props', 'props' FROM k WHERE k >= 2)"""


@query("advisor_false_invalidation", HITS + ", t AS (SELECT count(*) * 4 AS t FROM k), n AS (SELECT count(*) AS n FROM h) SELECT t AS table_invalidations, n AS shape_invalidations, (t - n) / t * 100.0::DOUBLE AS avoided_pct FROM t, n")
def _(s, d):
    return A.report(A.decisions(*_advised(s, d)))


@query("advisor_gravity_wells", HITS + " SELECT 'events.' || col AS \"column\", COUNT(*) AS hits, COUNT(DISTINCT shape) AS shapes FROM h GROUP BY 1")
def _(s, d):
    return A.gravity_wells(A.decisions(*_advised(s, d)))


@query(
    "advisor_coinvalidation",
    HITS + " SELECT a.shape AS a, b.shape AS b, COUNT(*) AS total, COUNT(*) AS both_repair, CAST(0 AS BIGINT) AS both_invalidate, CAST(0 AS BIGINT) AS mixed FROM h a JOIN h b ON a.event_id = b.event_id AND a.shape < b.shape GROUP BY 1, 2",
)
def _(s, d):
    return A.co_invalidation(A.decisions(*_advised(s, d)))


@query("advisor_entropy", HITS + ", n AS (SELECT shape, count(*) AS c FROM h GROUP BY 1), p AS (SELECT c / (SELECT sum(c) FROM n) AS p FROM n) SELECT round(-sum(p * log2(p)), 9) AS entropy FROM p")
def _(s, d):
    return A.entropy(A.decisions(*_advised(s, d))).select(F.round("entropy", 9).alias("entropy"))


@query("matrix_pair_counts", HITS + " SELECT a.shape AS a, b.shape AS b, COUNT(*) AS events FROM h a JOIN h b ON a.event_id = b.event_id AND a.shape <= b.shape GROUP BY 1, 2")
def _(s, d):
    return A.pair_counts(A.intersections(*_advised(s, d)))


TOPOLOGY_SQL = """WITH c AS (SELECT count(*) FILTER (event_id % 4 = 0) AS a, count(*) FILTER (event_id % 4 = 1) AS b, count(*) FILTER (event_id % 4 >= 2) AS p FROM events),
m AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, p::DOUBLE AS p, (2 * a + 2 * b + p)::DOUBLE AS trace FROM c),
e AS (SELECT unnest([(a + b + sqrt((a - b) * (a - b) + a * b)) / trace, (a + b - sqrt((a - b) * (a - b) + a * b)) / trace, p / trace]) AS l FROM m)
SELECT 0 AS beta1, 1 AS components, 1 AS isolated, round(100.0 / 3, 9) AS coupling_pct, round(1.0 / 3 + 0.75, 9) AS score, round(sum(l * l), 9) AS purity, round(-sum(l * log2(l)), 9) AS entropy, round(max(l), 9) AS lambda1 FROM e"""


@query("advisor_topology", TOPOLOGY_SQL)
def _(s, d):
    events, shapes = _advised(s, d)
    t = A.workload_score(events, shapes)
    pairs = [tuple(r) for r in A.pair_counts(A.intersections(events, shapes)).collect()]  # pairs of shapes
    m = A.density(pairs, [x.name for x in shapes])
    exact = [round(float(x), 9) for x in (t["coupling_pct"], t["score"], m["purity"], m["entropy"], m["lambda1"])]
    return s.createDataFrame([(t["beta1"], t["components"], t["isolated"], *exact)], "beta1 int, components int, isolated int, coupling_pct double, score double, purity double, entropy double, lambda1 double")


@query(
    "receipts_effective_counts",
    EVENT_KINDS + """, r AS (SELECT 'by_status' AS shape, CASE WHEN op = 'UPDATE:other' THEN 'preserve' ELSE 'invalidate' END AS effective FROM e
  UNION ALL SELECT 'count_all', CASE WHEN op LIKE 'UPDATE%' THEN 'preserve' ELSE 'invalidate' END FROM e)
SELECT shape, effective, COUNT(*) AS events FROM r GROUP BY ALL""",
)
def _(s, d):
    shapes = [QueryShape("orders", "sum", "o_totalprice", ("o_orderstatus",), name="by_status"), QueryShape("orders", "count_star", name="count_all")]
    return effective_counts(receipts(_events(s, d), shapes))


# ---------------------------------------------------------------- design


@query("fd_check_on_data", "SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY 1 HAVING COUNT(DISTINCT o_orderpriority) > 1")
def _(s, d):
    return D.fd_violations(orders(s, d), D.FD.of("o_custkey -> o_orderpriority"))


@query("lossless_join_check", "SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM nation)) AS n_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT a.n_nationkey, a.n_name, b.n_regionkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey)) AS n_joined")
def _(s, d):
    return D.lossless_on_data(read(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), [["n_nationkey", "n_name"], ["n_nationkey", "n_regionkey"]])


@query("fd_group_reduction", "SELECT n_nationkey, n_name, n_regionkey, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3")
def _(s, d):
    rows = read(s, d, "customer").join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return D.reduced_group_by(rows, ["n_nationkey", "n_name", "n_regionkey"], [D.FD.of("n_nationkey -> n_name, n_regionkey")], [F.count("*").alias("n")])


def _denormalised() -> D.Relation:
    return D.Relation(
        "orders_wide", frozenset(["o_orderkey", "o_custkey", "o_totalprice", "c_nationkey", "c_mktsegment", "n_name"]),
        ["o_orderkey -> o_custkey, o_totalprice", "o_custkey -> c_nationkey, c_mktsegment", "c_nationkey -> n_name"], {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "decimal", "c_nationkey": "int"},
    )


#: Derived by hand from the dependencies: transitive ones leave the wide table in 2NF.
NORMAL_FORMS = [
    ("orders_wide", "2NF", "c_mktsegment,c_nationkey,n_name,o_custkey,o_orderkey,o_totalprice"), ("orders_wide_3nf_1", "BCNF", "c_nationkey,n_name"), ("orders_wide_3nf_2", "BCNF", "c_mktsegment,c_nationkey,o_custkey"),
    ("orders_wide_3nf_3", "BCNF", "o_custkey,o_orderkey,o_totalprice"), ("orders_wide_1", "BCNF", "c_nationkey,n_name"), ("orders_wide_2_1", "BCNF", "c_mktsegment,c_nationkey,o_custkey"), ("orders_wide_2_2", "BCNF", "o_custkey,o_orderkey,o_totalprice"),
]


@query("normal_form_report", _values("relation, highest, attributes", NORMAL_FORMS))
def _(s, d):
    r = _denormalised()
    rows = [(x.name, D.classify(x)["highest"], ",".join(sorted(x.attributes))) for x in [r, *D.synthesize(r), *D.decompose_bcnf(r)[0]]]
    return s.createDataFrame(rows, "relation string, highest string, attributes string")


def _ddl_rows() -> list[tuple]:
    """The statements as they have to be, on one line each."""
    out = []
    for dialect, text, money in (("postgres", "TEXT", "NUMERIC(38, 6)"), ("mssql", "NVARCHAR(450)", "DECIMAL(38, 6)")):
        out += [
            (dialect, 0, f"CREATE TABLE orders_wide_3nf_1 ( c_nationkey BIGINT NOT NULL, n_name {text}, PRIMARY KEY (c_nationkey) )"),
            (dialect, 1, f"CREATE TABLE orders_wide_3nf_2 ( o_custkey BIGINT NOT NULL, c_mktsegment {text}, c_nationkey BIGINT, PRIMARY KEY (o_custkey), FOREIGN KEY (c_nationkey) REFERENCES orders_wide_3nf_1 (c_nationkey) )"),
            (dialect, 2, f"CREATE TABLE orders_wide_3nf_3 ( o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_totalprice {money}, PRIMARY KEY (o_orderkey), FOREIGN KEY (o_custkey) REFERENCES orders_wide_3nf_2 (o_custkey) )"),
            (dialect, 3, "CREATE INDEX ix_orders_wide_3nf_2_c_nationkey ON orders_wide_3nf_2 (c_nationkey)"),
            (dialect, 4, "CREATE INDEX ix_orders_wide_3nf_3_o_custkey ON orders_wide_3nf_3 (o_custkey)"),
        ]
    return out


@query("ddl_bundle", _values("dialect, place, statement", _ddl_rows()))
def _(s, d):
    tables = D.synthesize(_denormalised())
    return s.createDataFrame([(k, i, " ".join(t.split())) for k in ("postgres", "mssql") for i, t in enumerate(D.ddl(tables, k))], "dialect string, place int, statement string")


#: Statements, and the reason for which each must be refused (none where it is admitted).
ADMISSION = [
    (SUM_BY_STATUS, ""), ("SELECT o_custkey, COUNT(*) FROM orders WHERE o_totalprice >= 10.5 GROUP BY o_custkey", ""), ("select avg(o.o_totalprice) from shop.orders as o where 5 < o.o_custkey;", ""),
    ("", "EmptyStatement"), ("SELECT SUM(a) FROM t -- x", "Comment"), ("SELECT SUM(a) FROM t /* x */", "Comment"), ('SELECT SUM("a") FROM t', "QuotedIdentifier"), ("SELECT SUM(a) FROM t; SELECT 1", "MultiStatement"),
    ("UPDATE t SET a = 1", "Update"), ("SELECT SUM(a) FROM t HAVING SUM(a) > 1", "Having"), ("SELECT DISTINCT a FROM t", "Distinct"), ("SELECT a FROM t ORDER BY a", "Order"), ("SELECT a FROM t LIMIT 1", "Limit"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "With"), ("SELECT SUM(a) FROM t WHERE b LIKE 'x%'", "Like"), ("SELECT SUM(a) FROM t WHERE b BETWEEN 1 AND 2", "Between"), ("SELECT SUM(a) FROM t WHERE a = 1 OR b = 2", "Or"),
    ("SELECT SUM(a) FROM t WHERE NOT a = 1", "Not"), ("SELECT SUM(a) FROM t WHERE a IN (1, 2)", "In"), ("SELECT SUM(a) FROM t WHERE a IS NULL", "Is"), ("SELECT SUM(a) OVER () FROM t", "Window"), ("SELECT COUNT(1) FROM t", "Literal"),
    ("SELECT SUM(DISTINCT a) FROM t", "AggregateModifier"), ("SELECT SUM(a), COUNT(*) FROM t", "MultipleAggregates"), ("SELECT MIN(a) FROM t", "Min"), ("SELECT SUM(a * 2) FROM t", "Mul"), ("SELECT a, SUM(b) FROM t", "UngroupedProjectionInAggregate"),
    ("SELECT a FROM t GROUP BY a", "GroupWithoutAggregate"), ("SELECT SUM(a) FROM t GROUP BY 1", "GroupModifier"), ("SELECT SUM(a) FROM t GROUP BY ROLLUP(a)", "GroupModifier"), ("SELECT SUM(a) FROM (SELECT 1)", "Subquery"), ("SELECT * FROM t", "Star"),
    ("SELECT SUM(a) FROM t WHERE a = b", "NonColumnComparison"), ("SELECT SUM(a) FROM t WHERE a = @x", "Parameter"), ("SELECT UPPER(a) FROM t", "Anonymous"), ("SELECT SUM(x.a) FROM t", "UnknownTableQualifier"), ("SELECT a FROM t UNION SELECT a FROM u", "Union"),
]
JOIN_ADMISSION = [
    (JOIN_SQL, ""), (SNOWFLAKE_SQL, ""), (LEFT_SQL, ""), ("SELECT COUNT(*) FROM a CROSS JOIN b", "CrossJoin"), ("SELECT COUNT(*) FROM a RIGHT JOIN b ON a.x = b.id", "UnsupportedJoin:right"), ("SELECT COUNT(*) FROM a JOIN b USING (id)", "Join_using"),
    ("SELECT COUNT(*) FROM a JOIN b ON a.x > b.id", "NonEquiJoin"), ("SELECT COUNT(*) FROM a JOIN b ON a.x = b.y", "RightJoinKeyNotPrimaryKey"), ("SELECT COUNT(*) FROM a JOIN a ON a.x = a.id", "DuplicateJoinQualifier"), ("SELECT COUNT(*) FROM a JOIN b ON x = b.id", "UnqualifiedJoinColumn"), ("SELECT COUNT(*) FROM a JOIN b", "MissingJoinOn"),
]


@query("join_admission_report", _values("sql, admitted, reason", [(t, not r, r) for t, r in JOIN_ADMISSION]))
def _(s, d):
    return s.createDataFrame([(t, (r := parse_join_sql(t, primary_keys=KEYS)).is_supported, r.reason) for t, _ in JOIN_ADMISSION], "sql string, admitted boolean, reason string")


@query("admission_report", _values("sql, admitted, reason", [(t, not r, r) for t, r in ADMISSION]))
def _(s, d):
    return s.createDataFrame([(t, (r := parse_sql(t)).is_supported, r.reason) for t, _ in ADMISSION], "sql string, admitted boolean, reason string")


@query("retention_sweep")
def _(s, d):
    return policy_sweep(s)


@query("cms_estimate", "SELECT event_type, COUNT(*) AS n, TRUE AS covered FROM events GROUP BY 1")
def _(s, d):
    from .streaming.retention import FrequencySketch

    def run(pdf):
        import pandas as pd

        sketch = FrequencySketch(width=4096, depth=4, most=1 << 30)
        n = pdf["event_type"].value_counts()
        for t in pdf["event_type"]:
            sketch.add(t)
        return pd.DataFrame([(t, int(c), sketch.estimate(t)) for t, c in n.items()], columns=["event_type", "n", "estimate"])

    e = read(s, d, "events").withColumn("shard", F.pmod(F.xxhash64("event_id"), F.lit(16)))
    return e.select("shard", "event_type").groupBy("shard").applyInPandas(run, "event_type string, n long, estimate long").groupBy("event_type").agg(F.sum("n").alias("n"), (F.sum("estimate") >= F.sum("n")).alias("covered"))


# ---------------------------------------------------------------- evidence at its own scale, and what fails closed

TINY = "CAST(0.0000001 AS DECIMAL(8,7))"
LONG_KEY = "CAST('1' || lpad(CAST({} AS STRING), 34, '0') AS DECIMAL(38,0))"


@query(
    "ivm_exact_decimals",
    f"{WITH} SELECT {LONG_KEY.format('o_custkey').replace('STRING', 'VARCHAR')} AS k, CAST(SUM(o_totalprice * {TINY}) AS DECIMAL(38,9)) AS total FROM mutated WHERE o_orderkey < {SHIFT} GROUP BY 1",
)
def _(s, d):
    c = changed_orders(orders(s, d), _customers(s, d))
    c = c.withColumns({f"{p}k": F.expr(LONG_KEY.format(f"{p}o_custkey")) for p in ("", "n_")} | {f"{p}v": F.expr(f"CAST({p}o_totalprice * {TINY} AS DECIMAL(20,9))") for p in ("", "n_")})
    some = c.where("what is not null")
    new = F.when(F.col("what") == "UPDATE", V.image(some, {"id": "o_orderkey", "k": "n_k", "v": "n_v"}))
    ev = as_events(some, "tiny", F.col("o_orderkey"), F.col("what"), V.image(some, {"id": "o_orderkey", "k": "k", "v": "v"}), new)
    shape = QueryShape("tiny", "sum", "v", ("k",))
    return _named(maintain(shape, cold_state(shape, c), ev)[1], "k").select("k", F.col("sum_val").alias("total"))


@query(
    "exact_evidence_decisions",
    """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'value_change' WHEN 1 THEN 'disjoint_columns' ELSE 'invalid_evidence_type' END AS reason, COUNT(*) AS n FROM orders GROUP BY 1""",
)
def _(s, d):
    """The seventh place counts, zeros behind the point don't, and what a sum can't hold is refused."""
    o = orders(s, d)
    price = F.col("o_totalprice").cast("string")
    more = F.when(F.col("o_orderkey") % 4 == 0, "00001").when(F.col("o_orderkey") % 4 == 1, "000000000000000000000").when(F.col("o_orderkey") % 4 == 2, "00000000000000000001").otherwise("E+2")
    img = lambda v: F.create_map(F.lit("o_totalprice"), F.struct(F.lit("dec").alias("t"), v.alias("v")))
    ev = as_events(o, "orders", F.col("o_orderkey"), F.lit("UPDATE"), img(price), img(F.concat(price, more)))
    return certify(ev, QueryShape("orders", "sum", "o_totalprice")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "join_evidence_decisions",
    "SELECT CASE WHEN o_orderkey % 4 = 3 THEN 'insert' ELSE 'invalid_evidence_type' END AS reason, COUNT(*) AS n FROM orders GROUP BY 1",
)
def _(s, d):
    """Texts, a third place and keys of 30 digits are no evidence for a join over money and whole keys."""
    o = orders(s, d)
    k = F.col("o_orderkey") % 4
    new = V.image(o, {c: c for c in o.columns})
    swap = lambda name, tag, v: F.transform_values(new, lambda c, x: F.when(c == name, F.struct(F.lit(tag).alias("t"), v.alias("v"))).otherwise(x))
    price = F.col("o_totalprice").cast("string")
    new = F.when(k == 0, swap("o_totalprice", "str", F.lit("abc"))).when(k == 1, swap("o_totalprice", "dec", F.concat(price, F.lit("5")))).when(k == 2, swap("o_custkey", "int", F.lit("9" * 30))).otherwise(new)
    new = F.transform_values(new, lambda c, x: F.when(c == "o_orderkey", F.struct(x["t"].alias("t"), (x["v"].cast("long") + SHIFT).cast("string").alias("v"))).otherwise(x))
    ev = as_events(o, "orders", F.col("o_orderkey"), F.lit("INSERT"), F.lit(None).cast(V.IMAGE), new).withColumn("stream_id", F.col("event_id"))
    out, _ = J.certify_join(_join_shape(JOIN_SQL), _tables(s, d), ev)
    return out.groupBy("reason").agg(F.count("*").alias("n"))


@query("ivm_from_group_state", f"{WITH} SELECT o_orderstatus, CAST(SUM(o_totalprice) AS DECIMAL(38,2)) AS total, COUNT(*) AS n FROM mutated GROUP BY 1")
def _(s, d):
    shape = _shape(SUM_BY_STATUS)
    stored = orders(s, d).groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("sum"), F.count("o_totalprice").alias("non_null_count"), F.count("*").alias("row_count"))
    out = maintain(shape, from_group_state(shape, stored), _events(s, d))[1]
    return _named(out, "o_orderstatus").select("o_orderstatus", F.col("sum_val").cast(MONEY).alias("total"), F.col("rows").alias("n"))


@query("rebuild_after_schema_change", "SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total, TRUE AS rebuilt FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def _(s, d):
    shape, o = _shape(SUM_BY_STATUS), orders(s, d)
    ddl = as_events(s.range(1), "orders", F.lit(-5), F.lit("SCHEMA_CHANGE"), F.lit(None).cast(V.IMAGE), F.lit(None).cast(V.IMAGE))
    _, out, rebuilt = maintain_or_rebuild(shape, cold_state(shape, o), _events(s, d).union(ddl), o.where("o_orderkey % 2 = 0"))
    return _named(out, "o_orderstatus").select("o_orderstatus", F.col("sum_val").cast(MONEY).alias("total"), F.lit(rebuilt).alias("rebuilt"))


_BEGIN, _END, _BACK = ('{"payload":{"status":"%s","id":"%%s"%s}}' % x for x in (("BEGIN", ""), ("END", ""), ("ROLLBACK", "")))
_ROW = '{"payload":{"op":"c","after":{"a":1},"source":{"table":"t"},"transaction":{"id":"%s"}}}'
#: Records of a stream each, and what must come of them in order.
STREAMS = {
    "commit": ([_BEGIN % 1, _ROW % 1, '{"payload":{"status":"END","id":"1","event_count":1}}'], ["INSERT"]),
    "no_begin": ([_END % 1], ["transaction_boundary_violation"]),
    "empty": ([_BEGIN % 2, _END % 2], ["empty_transaction"]),
    "other_id": ([_BEGIN % 3, _ROW % 4], ["transaction_boundary_violation"]),
    "rollback": ([_BEGIN % 5, _ROW % 5, _BACK % 5], ["transaction_rollback"]),
    "open": ([_BEGIN % 6, _ROW % 6], ["uncommitted_transaction_discarded"]),
    "nested": ([_BEGIN % 7, _BEGIN % 8], ["transaction_boundary_violation"]),
    "count": ([_BEGIN % 9, _ROW % 9, '{"payload":{"status":"END","id":"9","event_count":2}}'], ["transaction_boundary_violation"]),
    "drift": (['{"payload":{"op":"c","after":{"a":1},"source":{"table":"t"}}}', '{"payload":{"op":"c","after":{"a":1,"b":2},"source":{"table":"t"}}}'], ["INSERT", "SCHEMA_CHANGE", "INSERT"]),
    "ddl": (['{"ddl":"ALTER TABLE shop.orders ADD x INT"}'], ["SCHEMA_CHANGE"]),
    "garbage": (["{", "[1]"], ["unknown_operation", "unknown_operation"]),
}


@query("stream_reason_codes", _values("stream_id, outcomes", [(k, ",".join(o)) for k, (_, o) in STREAMS.items()]))
def _(s, d):
    lines = s.createDataFrame([(k, i, x) for k, (lines, _) in STREAMS.items() for i, x in enumerate(lines)], "stream_id string, seq long, value string")
    got = assemble(decode_records(lines)).withColumn("outcome", F.coalesce("reason", "op"))
    drift = F.when(F.col("event_id").endswith(":drift"), 0).otherwise(1)
    return got.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", drift.alias("late"), "outcome"))).alias("o")).select("stream_id", F.array_join(F.col("o.outcome"), ",").alias("outcomes"))


#: Records of the change formats, and relation, operation, columns without a value, and one column's value.
RECORDS = [
    ('{"payload":{"op":"u","before":{"a":1},"after":{"a":"__debezium_unavailable_value","b":1.5},"source":{"schema":"S","table":"T","lsn":5}}}', "b", "s.t", "UPDATE", "a", "float:1.5"),
    ('{"schema":{"fields":[{"field":"after","fields":[{"field":"m","type":"struct","name":"VariableScaleDecimal"}]}]},"payload":{"op":"c","after":{"m":{"scale":2,"value":"AfQ="}},"source":{"table":"t"}}}', "m", "t", "INSERT", "", "dec:5.00"),
    ('{"action":"U","schema":"p","table":"t","columns":[{"name":"id","type":"bigint","value":"4"},{"name":"big","type":"text"}],"identity":[{"name":"id","type":"bigint","value":4}]}', "id", "p.t", "UPDATE", "big", "int:4"),
    ('{"action":"I","schema":"p","table":"t","columns":[{"name":"n","type":"numeric(10,2)","value":"1.50"}]}', "n", "p.t", "INSERT", "", "dec:1.50"),
    ('{"action":"T","schema":"p","table":"t"}', "x", "p.t", "TRUNCATE", "", None),
    ('{"nextlsn":"9","change":[{"kind":"delete","schema":"p","table":"t","oldkeys":{"keynames":["id"],"keyvalues":[7],"keytypes":["integer"]}}]}', "id", "p.t", "DELETE", "", None),
    ('{"payload":{"op":"c","after":{"big":12345678901234567890123},"source":{"table":"t"}}}', "big", "t", "INSERT", "", "int:12345678901234567890123"),
    ('{"ddl":"DROP TABLE IF EXISTS shop.items"}', "x", "shop.items", "SCHEMA_CHANGE", "", None),
    ('{"tableChanges":[{"id":"\\"shop\\".\\"orders\\""}],"source":{"table":"z"}}', "x", "shop.orders", "SCHEMA_CHANGE", "", None),
]


@query("change_format_report", _values("place, relation, op, gone, value", [(i, *r[2:]) for i, r in enumerate(RECORDS)]))
def _(s, d):
    lines = s.createDataFrame([("s", i, r[0]) for i, r in enumerate(RECORDS)], "stream_id string, seq long, value string")
    column = F.create_map(*[x for i, r in enumerate(RECORDS) for x in (F.lit(i), F.lit(r[1]))])
    got = decode_records(lines).withColumn("place", F.floor(F.col("seq") / 1000).cast("int")).withColumn("x", F.expr("new").getItem(column[F.col("place")]))
    return got.select("place", "relation", "op", F.coalesce(F.array_join("unavailable_cols", ","), F.lit("")).alias("gone"), F.concat("x.t", F.lit(":"), "x.v").alias("value"))


# ---------------------------------------------------------------- SQL text of shapes, and decisions straight from SQL

FILTERED_SQL = "SELECT o_orderstatus, COUNT(*) FROM orders WHERE o_totalprice > 1000.5 AND o_orderpriority <> 'it''s' GROUP BY o_orderstatus"


@query("group_state_by_sql", group_state_sql(_shape(FILTERED_SQL)))
def _(s, d):
    out = cold_state(_shape(FILTERED_SQL), orders(s, d))
    return _named(out, "o_orderstatus").select("o_orderstatus", F.lit(0).alias("__sum_val"), F.col("n").alias("__non_null_count"), F.col("rows").alias("__row_count"))


_COUNTED = SNOWFLAKE_SQL.replace("SUM(orders.o_totalprice)", "COUNT(*)")


@query("join_by_sql", f"SELECT r_name, n FROM ({join_sql(_join_shape(_COUNTED))}) t(r_name, n)")
def _(s, d):
    shape = _join_shape(join_sql(_join_shape(_COUNTED)))  # read back from its own text
    return J.cold_join_state(shape, _tables(s, d)).select(F.col("g0").alias("r_name"), F.col("rows").alias("n"))


@query("decisions_from_sql", EVENT_KINDS + " SELECT 'MIN' AS statement, 'unsupported' AS decision, COUNT(*) AS n FROM e UNION ALL SELECT 'COUNT', CASE WHEN op LIKE 'UPDATE%' THEN 'preserve' ELSE 'repair' END, COUNT(*) FROM e GROUP BY 2")
def _(s, d):
    ev = _events(s, d)
    count = lambda name, sql: certify_sql(ev, sql).groupBy(F.lit(name).alias("statement"), "decision").agg(F.count("*").alias("n"))
    return count("MIN", "SELECT MIN(o_totalprice) FROM orders").union(count("COUNT", "SELECT COUNT(*) FROM orders"))
