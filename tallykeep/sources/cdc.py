"""Change-data-capture formats: decoders to canonical events, and an encoder.

decode() turns one parsed record into a plain dictionary; decode_records() runs it over a DataFrame of JSON texts
by Arrow batches. JSON numbers with a point or an exponent stay floats, which later rules refuse as evidence.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

#: How the connectors mark a column whose value they didn't send.
UNAVAILABLE = ("__debezium_unavailable_value", "__toast_unchanged__")
#: JSON texts that are decoded at once, which bounds what a Python worker holds.
SLICE = 1000
ANONYMOUS_TX = "__anonymous_tx__"
RECORD_SCHEMA = V.EVENT_SCHEMA + ", record_kind string, expected_events long, column_types map<string,string>, lsn string, error string"
_DDL = re.compile(r"\b(?:ALTER|CREATE|DROP|TRUNCATE)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?(?:ONLY\s+)?([\w.\"`\[\]]+)", re.IGNORECASE)
_OPS = {"c": "INSERT", "r": "INSERT", "u": "UPDATE", "d": "DELETE", "t": "TRUNCATE", "I": "INSERT", "U": "UPDATE", "D": "DELETE", "T": "TRUNCATE"}
_WHOLE = re.compile(r"(?:^|big|small|tiny|medium)int(?:eger)?\d*$|serial")


def unavailable(value) -> bool:
    return value in UNAVAILABLE if isinstance(value, str) else isinstance(value, dict) and value.get("__debezium_unavailable") is True


def coerce(value, kind: str = ""):
    """A value by its declared type: texts of numeric columns become exact numbers, {scale, value} a decimal."""
    if isinstance(value, dict) and set(value) == {"scale", "value"}:
        raw = value["value"]
        whole = int.from_bytes(base64.b64decode(raw), "big", signed=True) if isinstance(raw, str) else int(raw)
        return Decimal(whole).scaleb(-int(value["scale"]))
    kind = kind.lower()
    if isinstance(value, str) and kind:
        try:
            if "float" in kind or "double" in kind or "real" in kind:
                return float(value)
            if "decimal" in kind or "numeric" in kind or "money" in kind:
                return Decimal(value)
            if _WHOLE.search(kind):
                return int(value)
        except (ValueError, ArithmeticError):
            return value
    return value


def tag(value) -> dict:
    if value is None:
        return {"t": "null", "v": None}
    if isinstance(value, bool):
        return {"t": "bool", "v": "true" if value else "false"}
    if isinstance(value, int):
        return {"t": "int", "v": str(value)}
    if isinstance(value, Decimal):
        return {"t": "dec", "v": format(value, "f")} if value.is_finite() else {"t": "float", "v": "nan"}
    if isinstance(value, float):
        return {"t": "float", "v": repr(value)}
    return {"t": "str", "v": value} if isinstance(value, str) else {"t": "json", "v": json.dumps(value, sort_keys=True, default=str)}


def column_types(schema: dict | None) -> dict[str, str]:
    """{column: 'type:logical'} from an envelope's schema block."""
    out = {}
    for part in (schema or {}).get("fields", []) or []:
        if part.get("field") in ("before", "after"):
            for f in part.get("fields", []) or []:
                logical = f.get("name")
                out[f["field"]] = f"{f.get('type', '')}:{logical}" if logical else str(f.get("type", ""))
    return out


def _image(row: dict | None, types: dict[str, str]) -> tuple[dict | None, list[str]]:
    if row is None:
        return None, []
    gone = [k for k, v in row.items() if unavailable(v)]
    kind = lambda k: "decimal" if "decimal" in types.get(k, "").lower() else types.get(k, "").split(":")[0]
    return {k.lower(): tag(coerce(v, kind(k))) for k, v in row.items() if not unavailable(v)}, [k.lower() for k in gone]


def _event(kind: str = "DATA", **fields) -> dict:
    return {"record_kind": kind, **fields}


def _envelope(r: dict) -> dict:
    body = r.get("payload", r)
    source = body.get("source") or {}
    types = column_types(r.get("schema") if "payload" in r else None)
    old, gone_old = _image(body.get("before"), types)
    new, gone_new = _image(body.get("after"), types)
    parts = [p for p in (source.get("schema"), source.get("table")) if p]
    tx = (body.get("transaction") or {}).get("id") or source.get("txId")
    lsn = source.get("lsn")
    op = body.get("op")
    if op == "m":
        return _event("MESSAGE", lsn=_text(lsn), tx_id=_text(tx))
    return _event(
        relation=V.relation_name(".".join(parts)) if parts else "*", op=_OPS.get(op, "UNKNOWN"), old=old, new=new, unavailable_cols=sorted({*gone_old, *gone_new}),
        tx_id=_text(tx), lsn=_text(lsn), event_id=_text(lsn) or "unknown", boundary_clock=_text(lsn), column_types={k.lower(): v for k, v in types.items()} or None,
    )


def _text(x) -> str | None:
    return None if x is None else str(x)


def _transaction(body: dict) -> dict:
    kind = {"BEGIN": "BEGIN", "END": "COMMIT", "COMMIT": "COMMIT", "ROLLBACK": "ROLLBACK", "ABORT": "ROLLBACK"}[body["status"].upper()]
    return _event(kind, tx_id=_text(body.get("id")), expected_events=body.get("event_count"), boundary_clock=_text(body.get("ts_ms")))


def _wal2json_v2(r: dict) -> dict:
    action = r["action"]
    tx, lsn = _text(r.get("xid")), _text(r.get("lsn"))
    if action in "BCR":
        return _event({"B": "BEGIN", "C": "COMMIT", "R": "ROLLBACK"}[action], tx_id=tx, lsn=lsn)
    if action == "M":
        return _event("MESSAGE", tx_id=tx, lsn=lsn)

    def side(columns):
        if columns is None:
            return None, [], {}
        out, gone, types = {}, [], {}
        for c in columns:
            name = c["name"].lower()
            types[name] = c.get("type", "")
            if "value" not in c or c.get("toast") or unavailable(c["value"]):
                gone.append(name)
            else:
                out[name] = tag(coerce(c["value"], c.get("type", "")))
        return out, gone, types

    new, gone, types = side(r.get("columns"))
    old, gone_old, old_types = side(r.get("identity"))
    relation = V.relation_name(".".join(p for p in (r.get("schema"), r.get("table")) if p)) or "*"
    return _event(relation=relation, op=_OPS.get(action, "UNKNOWN"), old=old, new=new, unavailable_cols=sorted({*gone, *gone_old}), tx_id=tx, lsn=lsn, event_id=lsn or "unknown", boundary_clock=lsn, column_types={**old_types, **types} or None)


def decode_wal2json_v1(r: dict, target_schema: str | None = None) -> list[dict]:
    """Events of a version-1 record, strictly: lengths, names and labels that contradict each other raise."""
    out = []
    for n, c in enumerate(r.get("change", [])):
        kind = str(c.get("kind", "")).upper()
        if kind not in ("INSERT", "UPDATE", "DELETE"):
            raise ValueError(f"unknown change kind {kind!r}")
        if target_schema is not None and c.get("schema") != target_schema:
            continue

        def row(names, values, types, what):
            if names is None and values is None:
                return None
            names, values = list(names or []), list(values or [])
            if len(names) != len(values) or len(set(names)) != len(names):
                raise ValueError(f"{what}: names and values don't match")
            types = types or [""] * len(names)
            return {k.lower(): tag(coerce(v, t)) for k, v, t in zip(names, values, types) if not unavailable(v)}

        new = row(c.get("columnnames"), c.get("columnvalues"), c.get("columntypes"), "columns")
        keys = c.get("oldkeys") or {}
        old = row(keys.get("keynames"), keys.get("keyvalues"), keys.get("keytypes"), "oldkeys")
        if "oldvalues" in c:
            old = row(c.get("columnnames"), c["oldvalues"], c.get("columntypes"), "oldvalues")
        if kind == "INSERT" and old or kind == "DELETE" and new:
            raise ValueError(f"{kind} with a contradictory image")
        relation = V.relation_name(".".join(p for p in (c.get("schema"), c.get("table")) if p))
        event_id = f"{r.get('nextlsn', 'wal')}:{n}"
        out.append(_event(relation=relation, op=kind, old=old, new=new, event_id=event_id, lsn=_text(r.get("nextlsn")), boundary_clock=_text(r.get("nextlsn")), old_complete=False, new_complete=False, changed_complete=False))
    return out


def decode_pgoutput(table: str, action: str, old: dict | None, new: dict | None, event_id: str = "unknown") -> dict:
    """The event of an already decoded logical replication tuple."""
    op = {"insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "truncate": "TRUNCATE"}.get(action.lower()) or _OPS.get(action[:1].upper(), "UNKNOWN")
    o, gone_old = _image(old, {})
    n, gone_new = _image(new, {})
    return _event(relation=V.relation_name(table), op=op, old=o, new=n, unavailable_cols=sorted({*gone_old, *gone_new}), event_id=event_id, boundary_clock=event_id, old_complete=False, new_complete=False, changed_complete=False)


def _ddl(r: dict) -> list[dict]:
    source = r.get("source") or {}
    named = [V.relation_name(re.sub(r"[\"`\[\]]", "", str(t.get("id", "")))) for t in r.get("tableChanges") or [] if t.get("id")]
    if not named:
        found = _DDL.search(r.get("ddl") or "")
        parts = [p for p in (source.get("schema"), source.get("table")) if p]
        named = [V.relation_name(re.sub(r"[\"`\[\]]", "", found[1]))] if found else [V.relation_name(".".join(parts))] if source.get("table") else ["*"]
    return [_event("SCHEMA_CHANGE", relation=n, op="SCHEMA_CHANGE", schema_change=True, lsn=_text(source.get("lsn")), boundary_clock=_text(source.get("lsn") or r.get("ts_ms")), tx_id=_text(source.get("txId"))) for n in named]


def decode(record: dict) -> list[dict]:
    """Canonical records of one parsed JSON record of any known format; raises ValueError for others.

    {"end_of_stream": true} is our own: it ends a stream that would else go on, and discards what is open.
    """
    body = record.get("payload") if isinstance(record.get("payload"), dict) else record
    if "ddl" in body or "tableChanges" in body:
        return _ddl(body)
    if isinstance(body.get("status"), str) and body["status"].upper() in ("BEGIN", "END", "COMMIT", "ROLLBACK", "ABORT"):
        return [_transaction(body)]
    if record.get("end_of_stream") is True:
        return [_event("FINISH")]
    if "action" in record:
        return [_wal2json_v2(record)]
    if "change" in record:
        return decode_wal2json_v1(record)
    if "op" in body or "before" in body or "after" in body:
        return [_envelope(record)]
    raise ValueError("unknown record format")


def _rows(texts, seqs, streams) -> pd.DataFrame:
    names = [part.split(" ")[0] for part in RECORD_SCHEMA.replace(V.IMAGE, "x").replace("map<string,string>", "x").split(", ")]
    out = []
    for text, seq, stream in zip(texts, seqs, streams):
        try:
            got = decode(json.loads(text))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            got = [_event("ERROR", error=str(e)[:200])]
        for i, g in enumerate(got):
            row = dict.fromkeys(names) | g | {"seq": int(seq) * 1000 + i, "stream_id": stream}
            row["event_id"] = row["event_id"] or f"evt_{seq}"
            row["schema_change"] = bool(row["schema_change"])
            out.append(row)
    return pd.DataFrame(out, columns=names).astype(object).where(lambda d: d.notna(), None)


def decode_records(lines: DataFrame) -> DataFrame:
    """Canonical records of JSON texts (stream_id, seq, value), a thousand places of seq for each text.

    What can't be decoded comes out as a record of kind ERROR with the reason, and is never lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                b = batch.iloc[lo : lo + SLICE]
                yield _rows(b["value"], b["seq"], b["stream_id"])

    return lines.select("stream_id", "seq", "value").mapInPandas(run, RECORD_SCHEMA)


def read_wal(spark: SparkSession, path: str, stream: str = "wal") -> DataFrame:
    """Records of a file: JSON lines, one array, one object, or an object with records. (stream_id, seq, value)"""
    whole = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                try:
                    got = json.loads(text)
                    got = got if isinstance(got, list) else got["records"] if isinstance(got, dict) and "records" in got else [got]
                    out = [json.dumps(x) for x in got]
                except ValueError:
                    out = [x for x in text.splitlines() if x.strip()]
                yield pd.DataFrame({"stream_id": stream, "seq": range(len(out)), "value": out})

    return whole.mapInPandas(run, "stream_id string, seq long, value string")


def _json_value(x):
    """JSON text of a tagged value: numbers bare, texts quoted."""
    return F.when(x["t"].isin("int", "bool"), x["v"]).when(x["t"] == "null", F.lit("null")).otherwise(F.to_json(F.array(x["v"])).substr(F.lit(2), F.length(F.to_json(F.array(x["v"]))) - 2))


def _json_image(img):
    pairs = F.transform(F.map_entries(img), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), _json_value(e["value"])))
    return F.when(img.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("null")


def _fields(img):
    kind = lambda t: F.when(t == "int", "int64").when(t == "dec", "decimal").when(t == "bool", "boolean").otherwise("string")
    one = lambda e: F.concat(F.lit('{"field":"'), e["key"], F.lit('","type":"'), kind(e["value"]["t"]), F.lit('"}'))
    return F.concat(F.lit("["), F.array_join(F.transform(F.map_entries(F.coalesce(img, V.empty_image())), one), ","), F.lit("]"))


def encode_debezium(events: DataFrame, schema: str = "public") -> DataFrame:
    """Debezium envelopes (stream_id, seq, value) of canonical events, with the types in the schema block."""
    op = F.when(F.upper("op") == "INSERT", "c").when(F.upper("op") == "UPDATE", "u").when(F.upper("op") == "DELETE", "d").when(F.upper("op") == "TRUNCATE", "t").otherwise("x")
    tx = F.when(F.col("tx_id").isNotNull(), F.concat(F.lit(',"transaction":{"id":"'), "tx_id", F.lit('"}'))).otherwise("")
    value = F.concat(
        F.lit('{"schema":{"fields":[{"field":"before","fields":'), _fields(F.col("old")), F.lit('},{"field":"after","fields":'), _fields(F.col("new")),
        F.lit('}]},"payload":{"op":"'), op, F.lit('","before":'), _json_image(F.col("old")), F.lit(',"after":'), _json_image(F.col("new")),
        F.lit(f',"source":{{"schema":"{schema}","table":"'), "relation", F.lit('","lsn":'), F.col("seq").cast("string"), F.lit("}"), tx, F.lit("}}"),
    )
    return events.select("stream_id", "seq", value.alias("value"))


def encode_wal2json_v2(events: DataFrame, schema: str = "public") -> DataFrame:
    kind = lambda t: F.when(t == "int", "bigint").when(t == "dec", "numeric").otherwise("text")
    one = lambda e: F.concat(F.lit('{"name":"'), e["key"], F.lit('","type":"'), kind(e["value"]["t"]), F.lit('","value":'), _json_value(e["value"]), F.lit("}"))
    side = lambda c, name: F.when(F.col(c).isNotNull(), F.concat(F.lit(f',"{name}":['), F.array_join(F.transform(F.map_entries(c), one), ","), F.lit("]"))).otherwise("")
    value = F.concat(F.lit('{"action":"'), F.upper("op").substr(1, 1), F.lit(f'","schema":"{schema}","table":"'), "relation", F.lit('","lsn":"'), F.col("seq").cast("string"), F.lit('"'), side("new", "columns"), side("old", "identity"), F.lit("}"))
    return events.select("stream_id", "seq", value.alias("value"))


def encode_wal2json_v1(events: DataFrame, schema: str = "public") -> DataFrame:
    names = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.map_keys(c), lambda k: F.concat(F.lit('"'), k, F.lit('"'))), ","), F.lit("]"))
    vals = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.map_values(c), _json_value), ","), F.lit("]"))
    kinds = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.map_values(c), lambda x: F.when(x["t"] == "dec", '"numeric"').when(x["t"] == "int", '"bigint"').otherwise('"text"')), ","), F.lit("]"))
    new = F.when(F.col("new").isNotNull(), F.concat(F.lit(',"columnnames":'), names(F.col("new")), F.lit(',"columntypes":'), kinds(F.col("new")), F.lit(',"columnvalues":'), vals(F.col("new")))).otherwise("")
    old = F.when(F.col("old").isNotNull(), F.concat(F.lit(',"oldkeys":{"keynames":'), names(F.col("old")), F.lit(',"keytypes":'), kinds(F.col("old")), F.lit(',"keyvalues":'), vals(F.col("old")), F.lit("}"))).otherwise("")
    value = F.concat(F.lit('{"nextlsn":"'), F.col("seq").cast("string"), F.lit('","change":[{"kind":"'), F.lower("op"), F.lit(f'","schema":"{schema}","table":"'), "relation", F.lit('"'), new, old, F.lit("}]}"))
    return events.select("stream_id", "seq", value.alias("value"))
