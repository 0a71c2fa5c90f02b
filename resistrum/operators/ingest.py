"""Reports of isolates that repeat, complete or correct each other, folded into records: in one pass or as they come.

A report (message_id, seq, lab_code, patient, specimen_number, specimen_date, organism, corrected, fields, results) belongs to
a specimen (SPECIMEN). Its reports are folded in order of seq and message_id. One that the sender calls a correction
changes the oldest record of the same day, even of another organism; any other changes the record of its organism; without
such a record it makes one. fields (a map of names to texts) overwrite what was there unless they are empty; a drug in
results (a map to result, measurement, method) is added, or replaced if its result or measurement differ.

Cases: of reports with the same seq and message_id, the later arrival counts; null and empty values change nothing; reports without
specimen number are one specimen's (null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SPECIMEN = ["lab_code", "patient", "specimen_number"]
REPORT = "message_id string, seq long, specimen_date string, organism string, corrected boolean, fields map<string, string>, results map<string, struct<result: string, measurement: string, method: string>>"
FOLDED = f"{', '.join(f'{k} string' for k in SPECIMEN)}, message_id string, seq long, record int, status string, changes array<string>, newest boolean, organism string, specimen_date string, fields map<string, string>, results map<string, struct<result: string, measurement: string, method: string>>"


_ORDER = itemgetter("seq", "message_id")


def _text(value: Any) -> str:
    if type(value) is str:
        return value.strip()
    return "" if value is None or value != value else str(value).strip()


def _merged(record: dict, report: dict) -> list[str]:
    """Puts report into record; what that changes."""
    changes = []
    own, results = record["fields"], record["results"]
    for name, value in {"organism": report["organism"], "specimen_date": report["specimen_date"], **report["fields"]}.items():
        place = record if name in ("organism", "specimen_date") else own
        new = _text(value)
        if new and new != (old := place.get(name, "")):  # what a record holds is trimmed
            place[name] = new
            changes.append(f"{name}: {old} -> {new}" if old else f"{name}: {new}")
    for drug, entry in report["results"].items():
        old = results.get(drug)
        now = _text(entry["result"]), _text(entry["measurement"])
        then = (_text(old["result"]), _text(old["measurement"])) if old else None
        if now != then:
            results[drug] = dict(entry)
            changes.append(f"{drug}: {now[0] or now[1]}" if then is None else f"{drug}: {then[0] or then[1]} -> {now[0] or now[1]}")
    return changes


def _place(records: list[dict], name: str, value: str) -> int | None:
    for k, record in enumerate(records):
        if record[name] == value:
            return k
    return None


def folded(reports: Iterable[dict], last: bool = False) -> list[dict]:
    """A row for each report of one specimen: the record it made or changed, and that record's state after it; with last, only those of the records' last reports."""
    records: list[dict] = []
    rows: list[dict] = []
    newest: dict[int, int] = {}
    for r in sorted(reports, key=_ORDER):
        day, organism = _text(r["specimen_date"]), _text(r["organism"])
        at = _place(records, "specimen_date", day) if r["corrected"] and day else None
        if at is None:
            at = _place(records, "organism", organism)
        if at is None:
            at, status = len(records), "created"
            records.append({"organism": "", "specimen_date": "", "fields": {}, "results": {}})
        else:
            status = "merged"
        changes = _merged(records[at], r)
        state = {} if last else {**records[at], "fields": dict(records[at]["fields"]), "results": dict(records[at]["results"])}
        newest[at] = len(rows)
        rows.append({"message_id": r["message_id"], "seq": r["seq"], "record": at, "status": status, "changes": [] if status == "created" else changes, "newest": False, **state})
    for at, k in newest.items():
        rows[k]["newest"] = True
    return [rows[k] | records[at] for at, k in newest.items()] if last else rows


def _reports(frame: pd.DataFrame) -> Iterator[dict]:
    for r in frame.to_dict("records"):
        fields, results = (dict(r[k]) if r[k] is not None else {} for k in ("fields", "results"))
        yield r | {"seq": int(r["seq"]), "corrected": r["corrected"] is True or r["corrected"] == 1, "fields": fields, "results": {k: dict(zip(("result", "measurement", "method"), v.values() if isinstance(v, dict) else v, strict=True)) for k, v in results.items() if v is not None}}


_COLUMNS = [*SPECIMEN, "message_id", "seq", "record", "status", "changes", "newest", "organism", "specimen_date", "fields", "results"]


def _frame(key: tuple, rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([dict(zip(SPECIMEN, key, strict=True)) | r for r in rows], columns=_COLUMNS)


def held(candidates: DataFrame) -> DataFrame:
    """Those that can't be filed, with a row for each reason."""
    return candidates.select("message_id", F.explode("reasons").alias("r")).select("message_id", "r.kind", "r.location")


_RESULT = ("result", "measurement", "method")
_TYPES = {"seq": pa.int64(), "record": pa.int32(), "changes": pa.list_(pa.string()), "newest": pa.bool_(), "fields": pa.map_(pa.string(), pa.string()), "results": pa.map_(pa.string(), pa.struct([(k, pa.string()) for k in _RESULT]))}
_SCHEMA = pa.schema([(c, _TYPES.get(c, pa.string())) for c in _COLUMNS])


def _listed(column: pa.Array) -> list:
    """The column's values; by way of numpy, as to_pylist makes a scalar of each first."""
    return column.to_pylist() if column.null_count and not pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _maps(column: pa.MapArray, values: list) -> list[dict]:
    """The maps of a column, with values for all of its items; null maps are empty."""
    keys, ends = _listed(column.keys), _listed(column.offsets)
    known = _listed(column.is_valid()) if column.null_count else [True] * len(column)
    return [dict(zip(keys[a:b], values[a:b], strict=True)) if good else {} for a, b, good in zip(ends, ends[1:], known, strict=False)]


def _batch_reports(batch: pa.RecordBatch) -> Iterator[dict]:
    """The reports of a batch. Maps are read as whole columns of keys and items: row by row they would take most of the time."""
    fields, results = batch.column("fields"), batch.column("results")
    entries = [{"result": a, "measurement": b, "method": c} for a, b, c in zip(*map(_listed, results.items.flatten()), strict=True)]
    if results.items.null_count:
        good = _listed(results.items.is_valid())
        some = _maps(results, [e if g else None for e, g in zip(entries, good, strict=True)])
        tested = [{k: v for k, v in m.items() if v is not None} for m in some]
    else:
        tested = _maps(results, entries)
    plain = [c for c in batch.schema.names if c not in ("fields", "results")]
    rows = zip(*(_listed(batch.column(c)) for c in plain), _maps(fields, _listed(fields.items)), tested, strict=True)
    names = [*plain, "fields", "results"]
    return (dict(zip(names, r, strict=True)) for r in rows)


def filed(reports: DataFrame, last: bool = False) -> DataFrame:
    """All reports folded, specimen by specimen; rows with newest are the records. With last, only these are returned.

    Reports are dealt by specimen and sorted, so that a task goes through many specimens in one pass and holds the reports of one.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held_back = None, {}

        def done() -> list[tuple]:
            return [(*key, *(list(x[c].items()) if c in ("fields", "results") else x[c] for c in _COLUMNS[len(SPECIMEN) :])) for x in folded(held_back.values(), last)] if held_back else []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(_COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            rows: list[tuple] = []
            for r in _batch_reports(batch):
                own = (r["lab_code"], r["patient"], r["specimen_number"])
                if own != key:
                    rows += done()
                    key, held_back = own, {}
                held_back[r["seq"], r["message_id"]] = r
            yield packed(rows)
        yield packed(done())

    known = reports.select(*SPECIMEN, "message_id", "seq", "specimen_date", "organism", "corrected", "fields", "results")
    return known.repartition(*SPECIMEN).sortWithinPartitions(*SPECIMEN, "seq", "message_id").mapInArrow(fold, FOLDED)


class Corrections(StatefulProcessor):
    """Keeps a specimen's reports, and returns its rows anew whenever some arrive; `keep_ms` of event time after the last one they are forgotten.

    As the reports are kept by seq and message_id and folded in that order, batches may come in any order and more than once.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reports = handle.getMapState("reports", "seq long, message_id string", REPORT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            newest = max(newest, int(frame["sent_ms"].max()))
            for r in _reports(frame):
                value = tuple(r[x] for x in ("message_id", "seq", "specimen_date", "organism", "corrected", "fields"))
                self.reports.updateValue((r["seq"], r["message_id"]), (*value, {k: (v["result"], v["measurement"], v["method"]) for k, v in r["results"].items()}))
        for due in list(self.handle.listTimers()):
            newest = max(newest, due - self.keep_ms)
            self.handle.deleteTimer(due)
        self.handle.registerTimer(newest + self.keep_ms)
        yield _frame(key, folded(self._kept()))

    def _kept(self) -> Iterator[dict]:
        for _, v in self.reports.iterator():
            r = dict(zip(("message_id", "seq", "specimen_date", "organism", "corrected", "fields", "results"), v, strict=True))
            yield r | {"fields": dict(r["fields"] or {}), "results": {k: dict(zip(("result", "measurement", "method"), e, strict=True)) for k, e in (r["results"] or {}).items()}}

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.reports.clear()
        return iter(())

    def close(self) -> None:
        pass


def corrected_stream(reports: DataFrame, late: str = "1 day", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """The stream of reports (with event time sent_at) folded; the last rows of each specimen are its table. Needs the RocksDB state store."""
    marked = reports.withWatermark("sent_at", late).withColumn("sent_ms", F.unix_millis("sent_at"))
    return marked.groupBy(*SPECIMEN).transformWithStateInPandas(statefulProcessor=Corrections(keep_ms), outputStructType=FOLDED, outputMode="Update", timeMode="EventTime")
