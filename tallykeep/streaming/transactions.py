"""Transactions and schema drift in a change stream, as a batch or a Structured Streaming operator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.cdc import ANONYMOUS_TX, RECORD_SCHEMA

#: Records that a Python worker turns into dictionaries at once.
SLICE = 1000
#: What comes out: released events in order, and the stream's own decisions (with decision and reason set).
OUTPUT_SCHEMA = RECORD_SCHEMA + ", decision string, reason string, boundary string"


def _names() -> list[str]:
    out, depth, part = [], 0, ""
    for ch in OUTPUT_SCHEMA + ",":
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and not depth:
            out.append(part.strip().split(" ")[0])
            part = ""
        else:
            part += ch
    return out


NAMES = _names()


@dataclass
class TransactionMachine:
    """Holds back the events of an open transaction; commits release them in order, rollbacks drop them.

    step() answers with rows for one record. Rows with a decision are the stream's own; those without are events
    to certify. Nothing comes out for BEGIN or held events. drift in a relation's columns or types comes out as
    a schema change ahead of the event.
    """

    strict: bool = False
    tx: str | None = None
    held: list[dict] = field(default_factory=list)
    known: dict[str, dict] = field(default_factory=dict)
    count: int = 0

    def clock(self, r: dict) -> str:
        event = r.get("event_id") if r.get("event_id") not in (None, "unknown") else None
        return r.get("lsn") or r.get("boundary_clock") or event or r.get("tx_id") or f"seq:{self.count}"

    def _own(self, r: dict, decision: str, reason: str) -> dict:
        return dict.fromkeys(NAMES) | {k: r.get(k) for k in ("stream_id", "seq", "event_id", "tx_id", "record_kind", "lsn")} | {"relation": "*", "op": "TX_VIOLATION" if decision == "invalidate" else None, "schema_change": False, "decision": decision, "reason": reason, "boundary": self.clock(r)}

    def _drift(self, r: dict) -> list[dict]:
        relation = r.get("relation")
        types = dict(r.get("column_types") or {})
        cols = set((r.get("new") or r.get("old") or {}).keys()) | set(r.get("unavailable_cols") or [])
        whole = bool(r.get("new"))
        seen = self.known.get(relation)
        changed = bool(seen) and ((bool(types) and bool(seen["types"]) and types != seen["types"]) or (whole and bool(seen["cols"]) and cols != seen["cols"]))
        before = seen or {"types": {}, "cols": set()}
        self.known[relation] = {"types": types or before["types"], "cols": cols if whole else before["cols"]}
        if not changed:
            return []
        return [dict.fromkeys(NAMES) | {k: r.get(k) for k in ("stream_id", "seq", "relation", "tx_id", "lsn")} | {"event_id": f"{r.get('event_id')}:drift", "op": "SCHEMA_CHANGE", "schema_change": True, "record_kind": "SCHEMA_CHANGE", "boundary": self.clock(r)}]

    def _release(self, rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            if r["record_kind"] == "DATA":
                out += self._drift(r)
            out.append(dict.fromkeys(NAMES) | r | {"boundary": self.clock(r)})
        return out

    def step(self, r: dict) -> list[dict]:
        self.count += 1
        kind, tx = r["record_kind"], r.get("tx_id")
        bad = lambda: [self._own(r, "invalidate", "transaction_boundary_violation")]
        if kind in ("MESSAGE", "ERROR"):
            return [self._own(r, "invalidate", "unknown_operation")] if kind == "ERROR" else []
        if kind == "FINISH":
            return self.finish(r)
        if kind == "BEGIN":
            nested = self.tx is not None
            self.tx, self.held = (None if nested else tx or ANONYMOUS_TX), []
            return bad() if nested else []
        if kind == "ROLLBACK":
            if self.tx is None:
                return bad() if self.strict else [self._own(r, "preserve", "transaction_rollback")]
            other = ANONYMOUS_TX not in (self.tx,) and tx is not None and tx != self.tx
            self.tx, self.held = None, []
            return bad() if other else [self._own(r, "preserve", "transaction_rollback")]
        if kind == "COMMIT":
            if self.tx is None:
                return bad()
            rows, other = self.held, self.tx != ANONYMOUS_TX and tx is not None and tx != self.tx
            self.tx, self.held = None, []
            expected = r.get("expected_events")
            if other or (expected is not None and expected == expected and int(expected) != len(rows)):
                return bad()
            return self._release(rows) if rows else [self._own(r, "preserve", "empty_transaction")]
        if self.tx is not None:
            if tx is not None and self.tx != ANONYMOUS_TX and tx != self.tx:
                self.tx, self.held = None, []
                return bad()
            self.held.append(r)
            return []
        return bad() if self.strict else self._release([r])

    def finish(self, r: dict) -> list[dict]:
        """At the end of the input: what an open transaction still holds is dropped."""
        if self.tx is None:
            return []
        self.tx, self.held = None, []
        return [self._own(r, "invalidate", "transaction_boundary_violation") if self.strict else self._own(r, "preserve", "uncommitted_transaction_discarded")]


def _plain(v):
    if isinstance(v, dict):
        return v
    if isinstance(v, list) and v and isinstance(v[0], tuple):
        return dict(v)
    if hasattr(v, "tolist"):
        return v.tolist()
    return None if v is None or (isinstance(v, float) and v != v) else v


def _records(pdf: pd.DataFrame) -> list[dict]:
    return [{k: _plain(v) for k, v in r.items()} for r in pdf.to_dict("records")]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{k: r.get(k) for k in NAMES} for r in rows], columns=NAMES).astype(object).where(lambda d: d.notna(), None)


def _frames(rows: list[dict]) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size: a transaction may release any number at once."""
    for lo in range(0, len(rows), SLICE):
        yield _frame(rows[lo : lo + SLICE])


def assemble(records: DataFrame, strict: bool = False) -> DataFrame:
    """Released events and the stream's own decisions of a finite input, one state machine for each stream_id.

    Records come sorted by stream and seq and are worked on SLICE at a time, so beside the events of an open
    transaction and the known columns nothing of a stream is held, however long it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = last = None
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                out = []
                for r in _records(batch.iloc[lo : lo + SLICE]):
                    if machine is None or r["stream_id"] != last["stream_id"]:
                        out += machine.finish(last) if machine else []
                        machine = TransactionMachine(strict)
                    out += machine.step(r)
                    last = r
                yield from _frames(out)
        if machine:
            yield from _frames(machine.finish(last))

    ordered = records.repartition("stream_id").sortWithinPartitions("stream_id", F.col("seq").asc_nulls_last())
    return ordered.mapInPandas(run, OUTPUT_SCHEMA)


def assemble_stream(records: DataFrame, strict: bool = False) -> DataFrame:
    """The same over a streaming input; open transactions and known columns are state, kept by checkpoints."""
    import json

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = TransactionMachine(strict)
        if state.exists:
            machine.tx, held, known, machine.count = state.get
            machine.held = json.loads(held)
            machine.known = {k: {"types": v["types"], "cols": set(v["cols"])} for k, v in json.loads(known).items()}
        rows = []
        for pdf in pdfs:
            rows += _records(pdf)
        out = []
        for r in sorted(rows, key=lambda r: r["seq"]):
            out += machine.step(r)
        known = json.dumps({k: {"types": v["types"], "cols": sorted(v["cols"])} for k, v in machine.known.items()})
        state.update((machine.tx, json.dumps(machine.held, default=str), known, machine.count))
        yield _frame(out)

    return records.groupBy("stream_id").applyInPandasWithState(run, OUTPUT_SCHEMA, "tx string, held string, known string, n long", "append", GroupStateTimeout.NoTimeout)
