"""The maintenance engine: certification rules, deltas, joins, formats, transactions, design, retention."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallykeep.functions import design as D
from tallykeep.functions import values as V
from tallykeep.operators import joins as J
from tallykeep.operators.certify import certify
from tallykeep.operators.extremum import ExtremumWindow
from tallykeep.operators.maintain import apply_changes, from_group_state, maintain, maintain_or_rebuild
from tallykeep.operators.store import MemoryStore, RedisStore, StoreApplicationError
from tallykeep.plans.admission import parse_join_sql, parse_sql
from tallykeep.plans.shapes import JoinClause, JoinShape, Predicate, QueryShape, cold_state
from tallykeep.sources.cdc import decode, decode_pgoutput, decode_wal2json_v1, tag
from tallykeep.streaming.retention import Budget, FrequencySketch
from tallykeep.streaming.transactions import TransactionMachine, assemble, assemble_stream
from tallykeep.streaming.workloads import policy_sweep, run, shapes, snowflake_stream

SHAPE = QueryShape("orders", "sum", "amount", ("region",), Predicate((("status", "=", "paid"),)), security_cols=frozenset(["tenant"]), name="s")


def img(**row):
    from decimal import Decimal

    return {k: tag(Decimal(v[1:]) if isinstance(v, str) and v.startswith("$") else v) for k, v in row.items()}


def events(spark, rows):
    names = [p.split(" ")[0] for p in V.EVENT_SCHEMA.replace(V.IMAGE, "x").split(", ")]
    base = dict.fromkeys(names) | {"stream_id": "s", "relation": "orders"}
    return spark.createDataFrame([tuple((base | {"seq": i, "event_id": f"e{i}"} | r)[n] for n in names) for i, r in enumerate(rows)], V.EVENT_SCHEMA)


FULL = {"region": "us", "status": "paid", "amount": 5, "tenant": "t"}
CASES = [
    ({"schema_change": True}, "invalidate", "schema_evolution"),
    ({"schema_change": True, "relation": "other"}, "preserve", "unrelated_relation"),
    ({"schema_change": True, "relation": "x.orders"}, "invalidate", "ambiguous_relation"),
    ({"op": "TX_VIOLATION", "relation": "*"}, "invalidate", "transaction_boundary_violation"),
    ({"relation": "*", "new": img(**FULL)}, "invalidate", "ambiguous_relation"),
    ({"relation": "a.orders", "new": img(**FULL)}, "invalidate", "ambiguous_relation"),
    ({"relation": "customers", "new": img(**FULL)}, "preserve", "unrelated_relation"),
    ({"op": "TRUNCATE"}, "invalidate", "truncate_event"),
    ({"op": "UNKNOWN"}, "invalidate", "unknown_operation"),
    ({"op": "MERGE"}, "invalidate", "unsupported_event_operation"),
    ({"old": img(**FULL), "new": img(**{**FULL, "amount": 1.5})}, "invalidate", "invalid_evidence_type"),
    ({"old": img(**FULL), "new": img(**{**FULL, "region": True})}, "invalidate", "invalid_evidence_type"),
    ({"old": img(**FULL), "new": img(**{**FULL, "note": [1]})}, "invalidate", "unsupported_row_value"),
    ({"old": img(**FULL), "new": img(**FULL), "old_complete": True, "new_complete": False}, "invalidate", "incomplete_update_images"),
    ({"old": img(**FULL), "new": img(**FULL), "old_complete": True, "new_complete": True, "changed_complete": False}, "invalidate", "unknown_changed_columns"),
    ({"old": img(region="us"), "new": img(**FULL), "old_complete": True, "new_complete": True}, "invalidate", "missing_evidence_old"),
    ({"op": "INSERT", "new": img(**FULL), "new_complete": False}, "invalidate", "incomplete_or_conflicting_insert_image"),
    ({"old": img(**FULL), "new": img(**FULL), "unavailable_cols": ["tenant"]}, "invalidate", "security_column_changed"),
    ({"old": img(**FULL), "new": img(**FULL), "unavailable_cols": ["amount"]}, "invalidate", "missing_evidence_for_repair"),
    ({"op": "INSERT", "old": img(**FULL), "new": img(**FULL)}, "invalidate", "invalid_event_payload"),
    ({"op": "UPDATE", "new": img(**FULL)}, "invalidate", "missing_evidence_for_repair"),
    ({"old": img(**FULL), "new": img(**{**FULL, "amount": 6}), "changed_cols": ["region"]}, "invalidate", "changed_cols_mismatch"),
    ({}, "invalidate", "missing_evidence_for_repair"),
    ({"old": img(**FULL, note="a"), "new": img(**FULL, note="b")}, "preserve", "disjoint_columns"),
    ({"old": img(**FULL), "new": img(**{**FULL, "tenant": "u"})}, "invalidate", "security_column_changed"),
    ({"old": img(amount=5), "new": img(amount=6)}, "invalidate", "missing_evidence_for_repair"),
]
PLAIN = QueryShape("orders", "sum", "amount", ("region",), Predicate((("status", "=", "paid"),)), name="p")
PLAIN_CASES = [
    ({"old": img(**{**FULL, "status": "new"}), "new": img(**{**FULL, "status": "new", "amount": 9})}, "preserve", "noop_update"),
    ({"old": img(**{**FULL, "status": "new"}), "new": img(**FULL)}, "repair", "predicate_entry"),
    ({"old": img(**FULL), "new": img(**{**FULL, "status": "new"})}, "repair", "predicate_exit"),
    ({"old": img(**FULL), "new": img(**{**FULL, "region": None})}, "repair", "group_move"),
    ({"old": img(**FULL), "new": img(**{**FULL, "amount": "$5.00"})}, "preserve", "disjoint_columns"),
    ({"old": img(**FULL), "new": img(**{**FULL, "amount": None})}, "repair", "value_change"),
    ({"new": img(**{**FULL, "status": "new"})}, "repair", "insert"),
    ({"old": img(**FULL)}, "repair", "delete"),
    ({"old": img(**FULL), "new": img(**{**FULL, "status": 3})}, "invalidate", "invalid_evidence_type"),
]


@pytest.mark.parametrize("shape,cases", [(SHAPE, CASES), (PLAIN, PLAIN_CASES)])
def test_rules(spark, shape, cases):
    got = [(r["decision"], r["reason"]) for r in certify(events(spark, [c[0] for c in cases]), shape).orderBy("seq").collect()]
    assert got == [c[1:] for c in cases]


def test_unsupported_and_projection(spark):
    one = events(spark, [{"old": img(**FULL), "new": img(**{**FULL, "region": "eu"})}])
    reason = lambda s: certify(one, s).first()["reason"]
    assert reason(QueryShape("orders", "max", "amount")) == "min_max_requires_auxiliary_state"
    assert reason(QueryShape("orders", None, projection_cols=frozenset(["region"]))) == "shape_intersected"
    assert reason(QueryShape("orders", "sum", "amount", ("region",), predicate_cols=frozenset(["status"]))) == "missing_evidence_for_repair"


def test_certify_has_no_python(spark):
    plan = certify(events(spark, [{}]), PLAIN)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_random_streams(spark):
    """Repairs equal recomputation; evidence taken away never repairs."""
    rng = random.Random(5)
    rows = {i: {"id": i, "region": rng.choice(["us", "eu", None, ""]), "status": rng.choice(["paid", "new", None]), "amount": rng.choice([None, 0, 7, -3])} for i in range(30)}
    schema = "id long, region string, status string, amount decimal(12,2)"
    seed = spark.createDataFrame([(r["id"], r["region"], r["status"], None) for r in rows.values()], schema).drop("amount").join(spark.createDataFrame([(i, r["amount"]) for i, r in rows.items()], "id long, amount int"), "id").select("id", "region", "status", F.col("amount").cast("decimal(12,2)").alias("amount"))
    changes = []
    for n in range(80):
        kind = rng.choice(["INSERT", "DELETE", "UPDATE", "UPDATE"])
        if kind == "INSERT":
            r = {"id": 100 + n, "region": rng.choice(["us", "ap"]), "status": "paid", "amount": rng.randrange(9)}
            rows[r["id"]] = r
            changes.append({"op": kind, "new": img(**r)})
        else:
            k = rng.choice(sorted(rows))
            old = dict(rows[k])
            if kind == "DELETE":
                del rows[k]
                changes.append({"op": kind, "old": img(**old)})
            else:
                rows[k] = {**old, rng.choice(["region", "status"]): "paid", "amount": rng.choice([None, 1, 2])}
                changes.append({"op": kind, "old": img(**old), "new": img(**rows[k])})
    ev = events(spark, changes)
    for fn, col in (("sum", "amount"), ("count", "amount"), ("count_star", None), ("avg", "amount")):
        shape = QueryShape("orders", fn, col, ("region",), Predicate((("status", "=", "paid"),)))
        after = apply_changes(seed, ev, "id")
        got, want = maintain(shape, cold_state(shape, seed), ev)[1], cold_state(shape, after)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for c in ("region", "status", "amount"):
        less = ev.withColumns({s: F.map_filter(s, lambda k, v: k != c) for s in ("old", "new")})
        shape = QueryShape("orders", "sum", "amount", ("region",), Predicate((("status", "=", "paid"),)))
        assert certify(less, shape).where("decision = 'repair'").isEmpty()
    _, again, rebuilt = maintain_or_rebuild(PLAIN, cold_state(PLAIN, seed), ev.union(events(spark, [{"op": "TRUNCATE", "seq": 500}])), seed.limit(0))
    assert rebuilt and again.isEmpty()


def test_ungrouped_keeps_its_row_and_state_is_checked(spark):
    shape = QueryShape("orders", "sum", "amount")
    none = spark.createDataFrame([], "amount decimal(12,2)")
    state = cold_state(shape, none)
    assert maintain(shape, state, events(spark, []))[1].collect()[0]["rows"] == 0
    with pytest.raises(ValueError):
        from_group_state(shape, spark.createDataFrame([(1, 5, 2)], "sum int, n int, rows int"))
    with pytest.raises(ValueError):
        cold_state(PLAIN, none)


REJECTED = {
    "": "EmptyStatement", "SELECT SUM(a) FROM t -- x": "Comment", "SELECT SUM(a) FROM t /* x */": "Comment", 'SELECT SUM("a") FROM t': "QuotedIdentifier", "SELECT SUM(a) FROM t; SELECT 1": "MultiStatement",
    "UPDATE t SET a = 1": "Update", "SELECT SUM(a) FROM t HAVING SUM(a) > 1": "Having", "SELECT DISTINCT a FROM t": "Distinct", "SELECT a FROM t ORDER BY a": "Order", "SELECT a FROM t LIMIT 1": "Limit",
    "WITH x AS (SELECT 1) SELECT * FROM x": "With", "SELECT SUM(a) FROM t WHERE b LIKE 'x%'": "Like", "SELECT SUM(a) FROM t WHERE b BETWEEN 1 AND 2": "Between", "SELECT SUM(a) FROM t WHERE a = 1 OR b = 2": "Or",
    "SELECT SUM(a) FROM t WHERE NOT a = 1": "Not", "SELECT SUM(a) FROM t WHERE a IN (1, 2)": "In", "SELECT SUM(a) FROM t WHERE a IS NULL": "Is", "SELECT SUM(a) OVER () FROM t": "Window", "SELECT COUNT(1) FROM t": "Literal",
    "SELECT SUM(DISTINCT a) FROM t": "AggregateModifier", "SELECT SUM(a), COUNT(*) FROM t": "MultipleAggregates", "SELECT MIN(a) FROM t": "Min", "SELECT SUM(a * 2) FROM t": "Mul", "SELECT a, SUM(b) FROM t": "UngroupedProjectionInAggregate",
    "SELECT a FROM t GROUP BY a": "GroupWithoutAggregate", "SELECT SUM(a) FROM t GROUP BY 1": "GroupModifier", "SELECT SUM(a) FROM t GROUP BY ROLLUP(a)": "GroupModifier", "SELECT SUM(a) FROM (SELECT 1)": "Subquery", "SELECT * FROM t": "Star",
    "SELECT SUM(a) FROM t WHERE a = b": "NonColumnComparison", "SELECT SUM(a) FROM t WHERE a = @x": "Parameter", "SELECT UPPER(a) FROM t": "Anonymous", "SELECT SUM(x.a) FROM t": "UnknownTableQualifier", "SELECT SUM(a) FROM a.b.c": "catalog",
    "SELECT a FROM t UNION SELECT a FROM u": "Union", "SELECT CASE WHEN a = 1 THEN 2 END FROM t": "Case", "SELECT SUM(a) FROM t WHERE COALESCE(a, 1) = 1": "Coalesce", "SELECT SUM(a) FROM t JOIN u ON t.a = u.id": "joins",
}


def test_admission():
    for sql, reason in REJECTED.items():
        got = parse_sql(sql)
        assert (got.is_supported, got.reason) == (False, reason), sql
    s = parse_sql("select o.Region, sum(o.amount) from shop.orders AS o where 5 < o.amount and status = 'it''s' group by region;").shape
    assert (s.relation, s.agg_fn, s.group_cols, s.predicate.terms) == ("shop.orders", "sum", ("region",), (("amount", ">", 5), ("status", "=", "it's")))
    assert parse_sql("SELECT * FROM t", schema={"t": ["a", "b"]}).shape.projection_cols == {"a", "b"}
    ok = "SELECT c.tier, COUNT(*) FROM orders o LEFT JOIN customers c ON o.customer_id = c.id WHERE o.status = 'paid' GROUP BY c.tier"
    assert parse_join_sql(ok).shape.joins[0].kind == "left"
    for sql, reason in {
        "SELECT COUNT(*) FROM a CROSS JOIN b": "CrossJoin", "SELECT COUNT(*) FROM a RIGHT JOIN b ON a.x = b.id": "UnsupportedJoin:right", "SELECT COUNT(*) FROM a JOIN b USING (id)": "Join_using",
        "SELECT COUNT(*) FROM a JOIN b ON a.x > b.id": "NonEquiJoin", "SELECT COUNT(*) FROM a JOIN b ON a.x = b.y": "RightJoinKeyNotPrimaryKey", "SELECT COUNT(*) FROM a JOIN a ON a.x = a.id": "DuplicateJoinQualifier",
        "SELECT COUNT(*) FROM a JOIN b ON x = b.id": "UnqualifiedJoinColumn", "SELECT COUNT(*) FROM a JOIN b": "MissingJoinOn",
    }.items():
        assert parse_join_sql(sql).reason == reason, sql


def test_join_decisions(spark):
    shape = JoinShape("orders", "id", (JoinClause("customers", "id", ("orders", "cid"), "left"),), "sum", ("orders", "amount"), (("customers", "tier"),))
    seeds = {"orders": spark.createDataFrame([(1, 1, 5), (2, 1, 7), (3, 9, 2)], "id long, cid long, amount long"), "customers": spark.createDataFrame([(1, "a"), (2, "b")], "id long, tier string")}
    order, cust = (lambda i, c, a: img(id=i, cid=c, amount=a)), (lambda i, t: img(id=i, tier=t))
    cases = [
        ({"old": order(1, 1, 5), "new": order(1, 1, 6)}, "repair", "value_change"),
        ({"old": order(1, 1, 6), "new": order(1, 2, 6)}, "repair", "foreign_key_reparent"),
        ({"relation": "customers", "old": cust(1, "a"), "new": cust(1, "z")}, "repair", "dimension_update"),
        ({"relation": "customers", "op": "INSERT", "new": cust(9, "n")}, "repair", "dimension_insert"),
        ({"relation": "customers", "op": "INSERT", "new": cust(20, "n")}, "preserve", "zero_join_multiplicity"),
        ({"op": "INSERT", "new": order(4, 9, 1)}, "repair", "insert"),
        ({"old": order(4, 9, 1)}, "repair", "delete"),
        ({"old": order(2, 1, 7), "new": {**order(2, 1, 7), "note": tag("x")}}, "preserve", "disjoint_columns"),
        ({"old": order(2, 1, 99), "new": order(2, 1, 8)}, "invalidate", "stale_join_auxiliary_state"),
        ({"old": order(2, 1, 7), "new": order(2, 1, 8)}, "invalidate", "missing_join_auxiliary_state"),
    ]
    ev = events(spark, [c[0] for c in cases])
    got, _ = J.certify_join(shape, seeds, ev)
    assert [(r["decision"], r["reason"]) for r in got.orderBy("seq").collect()] == [c[1:] for c in cases]
    state = J.maintain_join(shape, seeds, J.cold_join_state(shape, seeds), ev.where("seq < 8"))[1]
    assert {r["g0"]: int(r["sum_val"]) for r in state.collect()} == {"b": 6, "z": 7, "n": 2}
    with pytest.raises(ValueError):
        J.check_keys(shape, {**seeds, "customers": spark.createDataFrame([(1, "a"), (1, "b")], "id long, tier string")})


def test_extremum_window():
    w = ExtremumWindow(QueryShape("t", "max", "v", ("g",)), 2)
    row = lambda v: {"g": "x", "v": v}
    assert w.process("t", "INSERT", None, row(1)) == ("invalidate", "missing_aggregate_state")
    w.seed([row(v) for v in (1, 5, 9, 7)])
    assert w.value(("x",)) == 9
    assert w.process("t", "DELETE", row(1), None) == ("repair", "delete")
    assert w.process("t", "UPDATE", row(9), row(8)) == ("repair", "value_change") and w.value(("x",)) == 8
    assert w.process("t", "UPDATE", row(8), {"g": "x", "v": 8, "n": 1}) == ("preserve", "disjoint_columns")
    assert w.process("t", "DELETE", row(8), None) == ("repair", "delete")
    assert w.process("t", "DELETE", row(7), None) == ("invalidate", "extremum_window_exhausted")
    assert w.process("u", "DELETE", row(7), None, True) == ("invalidate", "schema_evolution")


def test_formats():
    d = decode({"payload": {"op": "u", "before": {"a": 1}, "after": {"a": "__debezium_unavailable_value", "b": 1.5}, "source": {"schema": "S", "table": "T", "lsn": 5}, "transaction": {"id": "x"}}})[0]
    assert (d["relation"], d["op"], d["unavailable_cols"], d["new"]["b"]["t"], d["tx_id"]) == ("s.t", "UPDATE", ["a"], "float", "x")
    assert decode({"payload": {"status": "END", "id": "1", "event_count": 2}})[0]["record_kind"] == "COMMIT"
    assert decode({"ddl": "ALTER TABLE shop.orders ADD x INT"})[0]["relation"] == "shop.orders"
    v2 = decode({"action": "U", "schema": "p", "table": "t", "columns": [{"name": "id", "type": "bigint", "value": "4"}, {"name": "big", "type": "text"}], "identity": [{"name": "id", "type": "bigint", "value": 4}]})[0]
    assert v2["unavailable_cols"] == ["big"] and v2["new"]["id"] == {"t": "int", "v": "4"}
    with pytest.raises(ValueError):
        decode_wal2json_v1({"change": [{"kind": "insert", "schema": "p", "table": "t", "columnnames": ["a"], "columnvalues": []}]})
    assert decode_wal2json_v1({"change": [{"kind": "insert", "schema": "q", "table": "t", "columnnames": ["a"], "columnvalues": [1]}]}, "p") == []
    assert decode_pgoutput("T", "delete", {"a": 1}, None)["op"] == "DELETE"
    var = decode({"schema": {"fields": [{"field": "after", "fields": [{"field": "m", "type": "struct", "name": "VariableScaleDecimal"}]}]}, "payload": {"op": "c", "after": {"m": {"scale": 2, "value": "AfQ="}}, "source": {"table": "t"}}})[0]
    assert var["new"]["m"] == {"t": "dec", "v": "5.00"}


def test_transactions(spark):
    rec = lambda kind, tx=None, **k: {"record_kind": kind, "tx_id": tx, "relation": "t", "seq": 0, **k}
    reasons = lambda rows: [r.get("reason") or r.get("op") for r in rows]
    m = TransactionMachine()
    assert m.step(rec("BEGIN", "1")) == [] and m.step(rec("DATA", "1", op="INSERT", new={"a": 1})) == []
    assert reasons(m.step(rec("COMMIT", "1", expected_events=1))) == ["INSERT"]
    assert reasons(m.step(rec("COMMIT", "1"))) == ["transaction_boundary_violation"]
    m.step(rec("BEGIN", "2"))
    assert reasons(m.step(rec("COMMIT", "2"))) == ["empty_transaction"]
    m.step(rec("BEGIN", "3"))
    assert reasons(m.step(rec("DATA", "4", op="INSERT"))) == ["transaction_boundary_violation"]
    m.step(rec("BEGIN", "5"))
    assert reasons(m.step(rec("ROLLBACK", "5"))) == ["transaction_rollback"]
    assert reasons(m.step(rec("DATA", op="INSERT", new={"a": 1, "b": 2}))) == ["SCHEMA_CHANGE", "INSERT"]
    m.step(rec("BEGIN", "6"))
    assert reasons(m.finish(rec("BEGIN", "6"))) == ["uncommitted_transaction_discarded"]
    assert reasons(TransactionMachine(strict=True).step(rec("DATA", op="INSERT"))) == ["transaction_boundary_violation"]


def test_assemble_holds_no_whole_stream(spark):
    """Records pass in slices, not a stream at once; transactions, drift and streams go on across slices and batches."""
    from tallykeep.sources.cdc import decode_records

    one = lambda k, n, **x: json.dumps({"payload": {"op": "c", "after": {"a": k} | x, "source": {"table": "t"}, "transaction": {"id": str(n)}}})
    mark = lambda status, n: json.dumps({"payload": {"status": status, "id": str(n)}})
    lines = []
    for stream, size in (("a", 1700), (None, 3), ("b", 40), ("c", 1)):
        texts = []
        for n in range(3):
            texts += [mark("BEGIN", n), *(one(k, n, **({"z": 1} if n == 2 else {})) for k in range(size)), mark(("END", "ROLLBACK", "END")[n], n)]
        lines += [(stream, i, t) for i, t in enumerate([*texts, mark("BEGIN", 9), one(0, 9)])]
    random.Random(3).shuffle(lines)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1300)
    try:
        out = assemble(decode_records(spark.createDataFrame(lines, "stream_id string, seq long, value string")))
        got = {}
        for r in out.collect():
            got.setdefault(r["stream_id"], []).append((r["reason"] or r["op"], r["new"] and r["new"]["a"]["v"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for stream, size in (("a", 1700), (None, 3), ("b", 40), ("c", 1)):
        rows = [("INSERT", str(k)) for k in range(size)]
        assert got[stream] == [*rows, ("transaction_rollback", None), ("SCHEMA_CHANGE", None), *rows, ("uncommitted_transaction_discarded", None)]
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_streaming(spark, tmp_path):
    """The same decisions through Structured Streaming, over two files."""
    from tallykeep.sources.cdc import decode_records

    lines = [{"payload": {"status": "BEGIN", "id": "1"}}, {"payload": {"op": "c", "after": {"a": 1}, "source": {"table": "t"}, "transaction": {"id": "1"}}}]
    more = [{"payload": {"status": "END", "id": "1", "event_count": 1}}, {"payload": {"op": "c", "after": {"a": 2}, "source": {"table": "t"}}}]
    src = tmp_path / "in"
    src.mkdir()
    read = lambda: spark.readStream.schema("seq long, value string").json(str(src)).select(F.lit("s").alias("stream_id"), "seq", "value")
    for k, part in enumerate((lines, more)):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"seq": 10 * k + i, "value": json.dumps(x)}) for i, x in enumerate(part)))
        q = assemble_stream(decode_records(read())).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r["new"]["a"]["v"] for r in got] == ["1", "2"]


def test_stores():
    s = MemoryStore(max_receipts=2)
    s.set("k", 1)
    assert s.apply("k", "e1", "preserve", "noop_update") == "preserve" and s.get("k") == 1
    assert s.apply("k", "e2", "repair", "insert") == "invalidate" and s.get("k") is None
    with pytest.raises(StoreApplicationError):
        s.apply("k", "e1", "invalidate", "x")
    with pytest.raises(StoreApplicationError):
        s.apply("k", "e3", "preserve", "x")

    class Client(dict):
        def set(self, k, v):
            self[k] = v
            return True

        def delete(self, k):
            return self.pop(k, None) is not None

    r = RedisStore(Client())
    r.set("k", {"a": 1})
    assert r.apply("k", "e", "invalidate", "x") == "invalidate" and r.get("k") is None and r.apply("k", "e", "invalidate", "x") == "invalidate"


def test_design():
    r = D.Relation("o", frozenset("ABCD"), ["A -> B", "B -> C", "A,D -> C"])
    assert [str(f) for f in D.minimal_cover(r.fds)] == ["A -> B", "B -> C"]
    assert D.candidate_keys(r.attributes, r.fds) == [frozenset("AD")]
    assert D.classify(r)["highest"] == "1NF"
    parts = D.synthesize(r)
    assert D.chase(r.attributes, [p.attributes for p in parts], r.fds)[0] and all(D.classify(p)["highest"] == "BCNF" for p in parts)
    e = D.Relation("e", frozenset(["s", "c", "i"]), ["s, c -> i", "i -> c"])
    assert D.classify(e)["highest"] == "3NF" and [str(f) for f in D.decompose_bcnf(e)[2]] == ["c,s -> i"]
    assert not D.chase("ABC", [frozenset("AB"), frozenset("BC")], [])[0] and D.binary_lossless("AB", "BC", [D.FD.of("B -> C")])
    assert D.redundant_groups(["A", "B", "C"], r.fds) == (["A"], ["B", "C"])
    assert D.classify(D.Relation("u", frozenset("AB"), ["A -> B"], multivalued=frozenset("B")))["highest"] == "UNF"


def test_retention(spark):
    s = FrequencySketch()
    for i in range(500):
        s.add(f"k{i % 50}")
    assert all(s.estimate(f"k{i}") >= 10 for i in range(50))
    for policy in ("fifo", "lru", "lfu", "w_lfu", "wtinylfu"):
        got = run(snowflake_stream(40, 1.2), Budget(max_rows=40, policy=policy), shapes())
        assert got["wrong"] == 0 and got["peak_rows"] <= 40
    rows = {(r["name"], r["policy"], r["max_rows"]): r for r in policy_sweep(spark).where("name in ('budget', 'shared', 'separate')").collect()}
    assert all(r["wrong"] == 0 for r in rows.values()) and rows["budget", "fifo", None]["invalidate"] == 0
    assert rows["shared", "wtinylfu", 66]["evicted"] <= rows["separate", "wtinylfu", 66]["evicted"]


def test_numbers_are_exact(spark):
    """Evidence beyond any scale is told apart, compared and grouped exactly, and refused where it can't be added up."""
    dec = lambda v: {"t": "dec", "v": v}
    change = lambda a, b, c="amount": [{"old": {**img(**FULL), c: a}, "new": {**img(**FULL), c: b}}]
    reason = lambda shape, ev: certify(events(spark, ev), shape).first()["reason"]
    by_sum = QueryShape("orders", "sum", "amount")
    assert reason(by_sum, change(dec("1.0000001"), dec("1.0000004"))) == "value_change"
    assert reason(by_sum, change(dec("1.00"), {"t": "int", "v": "1"})) == "disjoint_columns"
    assert reason(by_sum, change(dec("1"), dec("0." + "0" * 30 + "1"))) == "invalid_evidence_type"
    assert reason(by_sum, change(dec("1"), dec("1E+3"))) == "invalid_evidence_type"
    above = QueryShape("orders", "count_star", None, (), Predicate((("amount", ">", 1),)))
    assert reason(above, change({"t": "int", "v": "1"}, dec("1." + "0" * 40 + "4"))) == "predicate_entry"
    assert reason(above, change(dec("-" + "9" * 45), dec("9" * 45))) == "predicate_entry"
    for op, value, yes, no in ((">", "-1.5", "-1.49999999999", "-1.50000000001"), ("<=", "0", "-0.00", "0.0000001"), ("<", "-2", "-10", "-2.0"), ("=", "12.30", "12.3", "12.30000001"), (">=", "100", "100.0", "99.999"), ("!=", "5", "-5", "5.000")):
        from decimal import Decimal

        shape = QueryShape("orders", "count_star", None, (), Predicate((("amount", op, Decimal(value)),)))
        assert reason(shape, change(dec(no), dec(yes))) == "predicate_entry", (op, value)
        rows = spark.createDataFrame([(yes,), (no,)], "a string").selectExpr("cast(a as decimal(38,11)) as amount")
        assert cold_state(shape, rows).first()["rows"] == 1, (op, value)
    # keys of 35 digits and values of 9 places, through a whole maintenance
    key, big = "1" * 35, "2" * 35
    seed = spark.createDataFrame([(key, "0.000000004"), (key, "0.000000004"), (big, "1.000000001")], "k string, v string").selectExpr("cast(k as decimal(38,0)) as k", "cast(v as decimal(20,9)) as v")
    shape = QueryShape("orders", "sum", "v", ("k",))
    state = cold_state(shape, seed)
    assert {str(r["g0"]): str(r["sum_val"]) for r in state.collect()} == {key: "8E-9", big: "1.000000001"}
    row = lambda k, v: {"k": {"t": "int", "v": k}, "v": dec(v)}
    ev = events(spark, [{"old": row(key, "0.000000004"), "new": row(big, "0.000000005")}, {"new": row("3" * 35, "-7.5")}, {"new": row("4" * 39, "1")}, {"new": row(key, "0.0000000001")}, {"new": row("5.5", "1")}])
    certified, after = maintain(shape, state, ev)
    assert [r["reason"] for r in certified.orderBy("seq").collect()] == ["group_move", "insert", *["invalid_evidence_type"] * 3]
    assert {str(r["g0"]): float(r["sum_val"]) for r in after.collect()} == {key: 4e-9, big: 1.000000006, "3" * 35: -7.5}
    with pytest.raises(ValueError):
        cold_state(QueryShape("t", "sum", "f"), spark.createDataFrame([(1.5,)], "f double"))


def test_joins_fail_closed(spark):
    """Evidence that isn't exactly of its column's type invalidates, and repeated keys raise."""
    from decimal import Decimal

    shape = JoinShape("orders", "id", (JoinClause("customers", "id", ("orders", "cid")),), "sum", ("orders", "amount"), (("customers", "tier"),), ((("orders", "n"), ">", 3),))
    seeds = {"orders": spark.createDataFrame([(1, 1, Decimal("5.00"), 4)], "id long, cid long, amount decimal(12,2), n int"), "customers": spark.createDataFrame([(1, "a")], "id long, tier string")}
    order = lambda **k: {"op": "INSERT", "new": img(**{"id": 7, "cid": 1, "amount": "$1.00", "n": 9, **k})}
    cases = [(order(n="abc"), "invalid_evidence_type"), (order(amount="$1.005"), "invalid_evidence_type"), (order(cid=10**30), "invalid_evidence_type"), (order(cid=1.0), "invalid_evidence_type"), (order(n=2**40), "invalid_evidence_type"), (order(amount="$1.500"), "insert"), ({"relation": "customers", "op": "INSERT", "new": img(id=5, tier=6)}, "invalid_evidence_type")]
    for case, reason in cases:
        got, deltas = J.certify_join(shape, seeds, events(spark, [case]), checked=True)
        assert got.first()["reason"] == reason, case
    assert J.cold_join_state(shape, seeds).first()["sum_val"] == 5
    with pytest.raises(ValueError, match="customers.id"):
        J.certify_join(shape, {**seeds, "customers": spark.createDataFrame([(1, "a"), (1, "b")], "id long, tier string")}, events(spark, [order()]))
    _, again, rebuilt = J.maintain_join_or_rebuild(shape, seeds, J.cold_join_state(shape, seeds), events(spark, [order(n="x")]), seeds)
    assert rebuilt and again.first()["sum_val"] == 5


def test_plan_of_many_shapes_stays_small(spark):
    from tallykeep.operators.advisor import decisions

    shapes = [QueryShape("orders", "sum", "amount", (f"g{i}",), Predicate((("status", "=", "paid"), ("amount", ">", i))), name=f"s{i}") for i in range(4)]
    plan = decisions(events(spark, [{}]), shapes)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Scan") == 1 and len(plan.optimizedPlan().toString()) < 120_000


def test_streaming_maintenance(spark, tmp_path):
    """Repairs, a latch, a rebuild by hand, one by the hook, and the end of a stream, over several batches."""
    from tallykeep.sources.cdc import decode_records
    from tallykeep.streaming.maintenance import StateFolder, maintain_stream

    shape = QueryShape("t", "sum", "v", ("g",))
    put = lambda g, v, tx=None: {"payload": {"op": "c", "after": {"g": g, "v": v}, "source": {"table": "t"}, **({"transaction": {"id": tx}} if tx else {})}}
    table = lambda rows: spark.createDataFrame(rows, "g string, v long")
    begin = lambda tx: {"payload": {"status": "BEGIN", "id": tx}}
    batches = [[put("a", 1), begin("1"), put("b", 5, "1")], [{"payload": {"status": "END", "id": "1"}}, put("a", 2)], [{"ddl": "ALTER TABLE t ADD x INT"}, put("a", 4)], [put("a", 8)], [put("b", 1), begin("2"), put("b", 100, "2")], [{"end_of_stream": True}]]
    for hook in (None, lambda s, seq: table([("a", 21), ("b", 5)] if seq < 100_000 else [])):
        top = tmp_path / str(hook is None)
        (top / "in").mkdir(parents=True)
        folder = StateFolder(spark, str(top / "out"), shape)
        folder.seed(table([("a", 10)]))
        values = lambda folder=folder: {r["g0"]: int(r["sum_val"]) for r in folder.read()[0].collect()}
        read = spark.readStream.schema("seq long, value string").json(str(top / "in")).select(F.lit("s").alias("stream_id"), "seq", "value")
        seen = []
        for k, part in enumerate(batches):
            (top / "in" / f"{k}.json").write_text("\n".join(json.dumps({"seq": 10 * k + i, "value": json.dumps(x)}) for i, x in enumerate(part)))
            maintain_stream(decode_records(read), folder, str(top / "ck"), hook, availableNow=True).awaitTermination()
            seen.append((values(), folder.read()[1]))
            if hook is None and k == 3:
                folder.rebuild(table([("a", 25), ("b", 5)]))
        assert seen[0] == ({"a": 11}, False) and seen[1] == ({"a": 13, "b": 5}, False)
        reasons = [r["reason"] for r in folder.certificates().orderBy("seq").collect()]
        if hook is None:
            assert seen[2][1] and seen[3][1] and reasons.count("cache_requires_rebuild") == 2
            assert seen[4] == ({"a": 25, "b": 6}, False)
        else:
            assert seen[2] == ({"a": 21, "b": 5}, False) and seen[3] == ({"a": 29, "b": 5}, False) and seen[4] == ({"a": 29, "b": 6}, False)
        assert seen[5] == seen[4] and reasons[-1] == "uncommitted_transaction_discarded" and "schema_evolution" in reasons
