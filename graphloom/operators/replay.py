"""Applying a stream of inserts, updates and deletes.

Method: per-key ordered replay. The log is repartitioned by key, sorted by (version, sequence) within the partitions,
and a state machine walks each key's run once: an insert starts a row, an update overwrites the columns its payload
names, a delete ends the row, and a sequence that was applied before is skipped.

The state of a run is mergeable (what was set since the last reset, whether there was a reset, the last position), so
the log of a hot key is cut into ranges of (version, sequence) that are replayed apart and folded afterwards. The ranges are
quantiles of the whole log: none holds more than about ``rows_a_chunk`` rows, however versions are spread. A log of one such
range has no hot key, and is neither counted by key nor folded. No task ever holds the log of one key; memory is one row's
columns.

Defined results
---------------
* op is compared without padding and case; another or a null op is no entry. Null keys, versions or sequences: no entry.
* the key is read without blanks (all white space removed); type_name stands as it is, and null is a type of its own.
* a repeated (version, sequence) of one key counts once: the one that arrived first.
* an update of a row not in the log (its beginning was pruned) or after a delete makes the row live with its columns.
* a payload ``{"before": .., "after": {..}}`` means its ``after``; null, broken and non-object payloads set nothing.
* an empty log gives no rows; columns beside the named ones are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.util import ROWS_A_CHUNK, chunk_of, cuts

OPS = ("insert", "update", "delete")
#: At most so many keys are hot, which bounds the broadcast of their names.
MOST_HOT_KEYS = 100_000
STATE = "type_name string, entity_key string, db_version bigint, seq_in_tx int, op string, live boolean, reset boolean, applied bigint, skipped bigint, columns map<string,string>"


def without_blanks(key: Column) -> Column:
    return F.regexp_replace(key, r"\s+", "")


def payload_columns(text: str | None) -> dict[str, str]:
    """The columns that a payload sets, each value as JSON text."""
    if not text:
        return {}
    try:
        value = json.loads(text)
    except ValueError:
        return {}
    if not isinstance(value, dict):
        return {}
    if "after" in value and set(value) <= {"before", "after"}:
        value = value["after"]
        if not isinstance(value, dict):
            return {}
    return {k: json.dumps(v, ensure_ascii=False, sort_keys=True) for k, v in value.items()}


class _Machine:
    """The state of one run of entries of a key."""

    __slots__ = ("applied", "columns", "id", "op", "pos", "reset", "skipped")

    def __init__(self, key: tuple):
        self.id, self.pos, self.op, self.reset, self.applied, self.skipped, self.columns = key, None, None, False, 0, 0, {}

    def apply(self, pos: tuple, op: str, payload: str | None) -> None:
        if self.pos is not None and pos <= self.pos:
            self.skipped += 1
            return
        self.pos, self.op, self.applied = pos, op, self.applied + 1
        if op != "update":
            self.reset, self.columns = True, {}
        if op != "delete":
            self.columns.update(payload_columns(payload))

    def fold(self, pos: tuple, op: str, reset: bool, applied: int, skipped: int, columns: list) -> None:
        self.pos, self.op, self.applied, self.skipped = pos, op, self.applied + applied, self.skipped + skipped
        if reset:
            self.reset, self.columns = True, {}
        self.columns.update(columns or ())

    def row(self) -> tuple:
        return (*self.id, *self.pos, self.op, self.op != "delete", self.reset, self.applied, self.skipped, list(self.columns.items()))


def _arrow(names: list[str], chunked: bool) -> pa.Schema:
    types = [pa.string(), pa.string()] + [pa.int64()] * chunked + [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())]
    return pa.schema(list(zip(names, types, strict=True)))


NAMES = ["type_name", "entity_key", "db_version", "seq_in_tx", "op", "live", "reset", "applied", "skipped", "columns"]


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema, width: int, step) -> Iterator[pa.RecordBatch]:
    """Run the machine over sorted rows; the first ``width`` columns name the run."""
    now, done = None, []
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
            if now is None or now.id != row[:width]:
                if now is not None:
                    done.append(now.row())
                now = _Machine(row[:width])
            step(now, row)
        if len(done) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
    if now is not None:
        done.append(now.row())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def _replay(batches):
    return _walk(batches, _arrow([*NAMES[:2], "chunk", *NAMES[2:]], True), 3, lambda m, r: m.apply((r[3], r[4]), r[6], r[7]))


def _fold(batches):
    return _walk(batches, _arrow(NAMES, False), 2, lambda m, r: m.fold((r[3], r[4]), r[5], r[7], r[8], r[9], r[10]))


def entries(log: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """The log's well-formed entries of committed transactions."""
    op = F.lower(F.trim("op"))
    e = log.select(
        "tx_id", "type_name", without_blanks(F.col("entity_key")).alias("entity_key"), F.col("db_version").cast("bigint").alias("db_version"),
        F.col("seq_in_tx").cast("int").alias("seq_in_tx"), "arrival_no", op.alias("op"), "payload",
    ).filter(F.col("entity_key").isNotNull() & F.col("db_version").isNotNull() & F.col("seq_in_tx").isNotNull() & F.col("op").isin(*OPS))
    if catalog is not None:
        e = e.join(catalog.select("tx_id").filter("tx_id is not null"), "tx_id", "left_semi")
    return e.drop("tx_id")


def place(version: str = "db_version", seq: str = "seq_in_tx") -> Column:
    """A number that doesn't decrease with (version, sequence)."""
    return F.col(version).cast("double") + F.col(seq).cast("double") / (1 << 32)


def replay(log: DataFrame, catalog: DataFrame | None = None, *, rows_a_chunk: int = ROWS_A_CHUNK) -> DataFrame:
    """The last state of every entity of ``log``: columns of STATE, dead entities included.

    ``catalog`` holds the committed transactions. A key with more than ``rows_a_chunk`` rows (and more than one in
    MOST_HOT_KEYS of the log's) is hot: its log is replayed in ranges.
    """
    at = cuts(log, place(), rows_a_chunk=rows_a_chunk)
    e = entries(log, catalog)
    chunk = F.lit(0).cast("bigint")
    if at:
        least = max(rows_a_chunk, log.count() // MOST_HOT_KEYS)
        keys = [F.col("type_name"), without_blanks(F.col("entity_key")).alias("entity_key")]
        hot = log.select(*keys).groupBy("type_name", "entity_key").count().filter(F.col("count") > least)
        hot = F.broadcast(hot.select(F.col("type_name").alias("_t"), F.col("entity_key").alias("_k")))
        e = e.join(hot, F.col("type_name").eqNullSafe(F.col("_t")) & (F.col("entity_key") == F.col("_k")), "left")
        chunk = F.when(F.col("_k").isNotNull(), chunk_of(place(), at)).otherwise(0).cast("bigint")
    e = e.select("type_name", "entity_key", chunk.alias("chunk"), "db_version", "seq_in_tx", "arrival_no", "op", "payload")
    parts = (
        e.repartition("type_name", "entity_key", "chunk")
        .sortWithinPartitions("type_name", "entity_key", "chunk", "db_version", "seq_in_tx", "arrival_no", "op", "payload")
        .mapInArrow(_replay, STATE.replace("db_version", "chunk bigint, db_version", 1))
    )
    if not at:
        return parts.drop("chunk")
    # One row per entity and range is folded, not the log.
    return parts.repartition("type_name", "entity_key").sortWithinPartitions("type_name", "entity_key", "chunk").mapInArrow(_fold, STATE)


def current(log: DataFrame, catalog: DataFrame | None = None, **how) -> DataFrame:
    """The living entities with their columns and the entry that made each what it is."""
    return replay(log, catalog, **how).filter("live").drop("live", "reset")
