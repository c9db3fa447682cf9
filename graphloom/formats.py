"""Results as text: table, kv, csv, jsonl and json."""

from __future__ import annotations

import csv
import datetime as dt
import decimal
import io
import json
import math

from pyspark.sql import DataFrame, Row

from graphloom.errors import GraphError

_SAFE = 2**53 - 1


def plain(value, *, js: bool = False):
    """A value as JSON has it; ``js``: whole numbers beyond 2^53 as text."""
    if isinstance(value, Row):
        return {k: plain(v, js=js) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v, js=js) for v in value]
    if isinstance(value, dt.datetime):
        return value.isoformat(timespec="milliseconds") + "Z"
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        value = int(value)
    if isinstance(value, int) and not isinstance(value, bool) and js and abs(value) > _SAFE:
        return str(value)
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def records(df: DataFrame, *, js: bool = False):
    """Rows one by one; a partition at a time comes to the driver."""
    for row in df.toLocalIterator():
        yield {k: plain(v, js=js) for k, v in zip(df.columns, row, strict=True)}


def to_ipc(df: DataFrame) -> bytes:
    """A result as an Arrow IPC stream."""
    import pyarrow as pa

    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _cell(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def render(df: DataFrame, form: str = "table", *, name: str = "", description: str | None = None, instruction: str | None = None) -> str:
    rows, columns = list(records(df)), df.columns
    meta = {k: v for k, v in (("query", name), ("description", description), ("instruction", instruction)) if v}
    if form == "json":
        return json.dumps({**meta, "rows": rows}, ensure_ascii=False)
    if form == "jsonl":
        return "\n".join(json.dumps(r, ensure_ascii=False) for r in ([{"type": "meta", **meta}] if meta else []) + rows)
    if form == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(columns)
        w.writerows([_cell(r[c]) for c in columns] for r in rows)
        return out.getvalue()
    head = "".join(f"{k}: {v}\n" for k, v in meta.items())
    if form == "kv":
        blocks = []
        for r in rows:
            title = next((str(r[c]) for c in ("type", "slug", "id", "name") if r.get(c) is not None), "row")
            blocks.append("\n".join([f"-- {title}", *[f"{c}: {_cell(r[c])}" for c in columns]]))
        return head + "\n\n".join(blocks)
    if form == "table":
        cells = [columns, *[[_cell(r[c]) for c in columns] for r in rows]]
        widths = [max(len(line[i]) for line in cells) for i in range(len(columns))]
        lines = [" | ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in cells]
        return head + "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])
    raise GraphError(f"unknown format {form}")
