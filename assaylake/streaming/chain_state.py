"""C1.5 over a stream: chains checked record by record in keyed state, whatever order the records arrive in.

State of a chain: its head (hash and next position), the values its records must not repeat (each forgotten after a time to
live), and records that came before their predecessor. Those wait until the gap closes; a timer releases them when it does not.

A call to the state store costs more than checking a record, so state is kept in blocks of about BLOCK records (as JSON text, the
cheapest form on the way there) that are read and written once for a chain and batch: waiting records and sequences by their number, values by linear hashing, where one
block is split for every BLOCK new values.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from ..fixed_values import GENESIS_HASH
from ..operators.chain import ChainSpec, record_hash

BLOCK = 64
#: Blocks of a state that a task holds before it writes them.
HELD_BLOCKS = 4_096
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a record's JSON text holds; a missing field is null.
_FIELDS = ("sequence", "value", "previous", "hash", "sound", "signed")
_HEAD = "hash string, next long, last_waiting long, used_values long, timed boolean"
OUT = "chain_id string, pos long, sequence long, issue_type string, expected_sequence long, message string"
_ISSUE = Row("chain_id", "pos", "sequence", "issue_type", "expected_sequence", "message")
#: Issues that only a stream knows; the batch check sees every position once and without gaps.
REPEATED_POSITION = "repeated_position"
MISSING_POSITIONS = "missing_positions"
_STREAM_MESSAGES = {REPEATED_POSITION: "This position of the chain has been checked before.",
                    MISSING_POSITIONS: "Earlier positions of the chain did not arrive in time."}


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs the state store on disk; set for the queries that the session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


@dataclass(frozen=True)
class _Names:
    """The names of a spec, as plain text for the tasks."""
    tampering: str
    reuse: str
    messages: dict


def _bucket(value: str, buckets: int) -> int:
    """Linear hashing: the low bits that number the buckets, one bit less for those that are not split yet."""
    top = 1 << buckets.bit_length() - 1
    low = int.from_bytes(hashlib.blake2b(value.encode("utf-8"), digest_size=8).digest(), "big") & (2 * top - 1)
    return low if low < buckets else low - top


class _Blocks:
    """A map state `block -> entries` as dicts, while the rows of one chain are handled.

    `fresh`: the state holds nothing yet. Entries whose value is not above `oldest` are forgotten.
    """

    def __init__(self, state: MapState, fresh: bool, oldest: int | None = None):
        self.state, self.fresh, self.oldest = state, fresh, oldest
        self.held: dict[int, dict] = {}
        self.changed: set[int] = set()

    def at(self, block: int, *, change: bool = False) -> dict:
        if block not in self.held:
            if len(self.held) >= HELD_BLOCKS:
                self.flush()
            stored = None if self.fresh else self.state.getValue((block,))
            rows = json.loads(stored[0]) if stored is not None else ()
            self.held[block] = {k: v for k, v in rows if self.oldest is None or v > self.oldest}
        if change:
            self.changed.add(block)
        return self.held[block]

    def flush(self) -> None:
        for block in self.changed:
            if self.held[block]:
                self.state.updateValue((block,), (json.dumps(list(self.held[block].items())),))
            elif not self.fresh:
                self.state.removeKey((block,))
        self.held, self.changed, self.fresh = {}, set(), False


class ChainProcessor(StatefulProcessor):
    def __init__(self, names: _Names, check_signatures: bool, ttl_ms: int | None, wait_ms: int):
        self.names, self.check_signatures, self.ttl_ms, self.wait_ms = names, check_signatures, ttl_ms, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head_state = handle.getValueState("head", _HEAD)
        self.value_state = handle.getMapState("values", "block long", "entries string", self.ttl_ms)
        self.sequence_state = handle.getMapState("sequences", "block long", "entries string", self.ttl_ms)
        self.early_state = handle.getMapState("early", "block long", "entries string")

    def close(self) -> None:
        pass

    def _open(self, now: int) -> None:
        """The state of the chain whose rows or timer come next."""
        stored = self.head_state.get()
        self.head, self.next, self.last_waiting, self.used_values, self.timed = stored or (GENESIS_HASH, 0, None, 0, False)
        oldest = None if self.ttl_ms is None else now - self.ttl_ms
        self.now = now
        self.values = _Blocks(self.value_state, not self.used_values, oldest)
        self.sequences = _Blocks(self.sequence_state, stored is None, oldest)
        self.early = _Blocks(self.early_state, self.last_waiting is None)

    def _store(self) -> None:
        """Write what has changed and set a timer where records wait."""
        for blocks in (self.values, self.sequences, self.early):
            blocks.flush()
        if self.last_waiting is not None and self.last_waiting < self.next:
            self.last_waiting = None
        if self.last_waiting is not None and not self.timed:
            self.handle.registerTimer(self.now + self.wait_ms)
            self.timed = True
        self.head_state.update((self.head, self.next, self.last_waiting, self.used_values, self.timed))

    def _issue(self, pos: int, sequence: int | None, name: str, expected: int | None = None) -> tuple:
        return pos, sequence, name, expected, {**_STREAM_MESSAGES, **self.names.messages}[name]

    def _sequence_again(self, sequence: int | None) -> bool:
        """Whether an earlier position has the sequence; otherwise this one is the first."""
        if sequence is None:
            return False
        if sequence in self.sequences.at(sequence // BLOCK):
            return True
        self.sequences.at(sequence // BLOCK, change=True)[sequence] = self.now
        return False

    def _value_again(self, value: str | None) -> bool:
        """The same for the value."""
        if value is None:
            return False
        buckets = self.used_values // BLOCK + 1
        bucket = _bucket(value, buckets)
        if value in self.values.at(bucket):
            return True
        self.values.at(bucket, change=True)[value] = self.now
        self.used_values += 1
        if self.used_values // BLOCK + 1 > buckets:
            self._split(buckets)
        return False

    def _split(self, buckets: int) -> None:
        """One more bucket, with its share of the bucket that it is split from."""
        source = buckets - (1 << buckets.bit_length() - 1)
        old = dict(self.values.at(source, change=True))
        moved = {v: used for v, used in old.items() if _bucket(v, buckets + 1) == buckets}
        if moved:
            self.values.at(buckets, change=True).update(moved)
            left = self.values.at(source, change=True)
            for value in moved:
                del left[value]

    def _checked(self, pos: int, record: str, gap: bool = False) -> list[tuple]:
        sequence, value, previous, own, sound, signed = map(json.loads(record).get, _FIELDS)
        found = []
        if not sound:
            found.append(self._issue(pos, sequence, self.names.tampering))
        if self.check_signatures and not signed:
            found.append(self._issue(pos, sequence, "invalid_signature"))
        if gap:
            found.append(self._issue(pos, sequence, MISSING_POSITIONS))
        elif previous != self.head:
            found.append(self._issue(pos, sequence, "broken_chain"))
        if sequence != pos + 1:
            found.append(self._issue(pos, sequence, "sequence_discontinuity", pos + 1))
        if self._sequence_again(sequence):
            found.append(self._issue(pos, sequence, "duplicate_sequence"))
        if self._value_again(value):
            found.append(self._issue(pos, sequence, self.names.reuse))
        self.head, self.next = own, pos + 1
        return found

    def _released(self, gap: bool = False) -> list[tuple]:
        """Waiting records from the next position on, as far as they follow one another."""
        found = []
        while self.last_waiting is not None and self.next <= self.last_waiting and self.next in self.early.at(self.next // BLOCK):
            record = self.early.at(self.next // BLOCK, change=True).pop(self.next)
            found += self._checked(self.next, record, gap)
            gap = False
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._open(timerValues.getCurrentProcessingTimeInMs())
        found = []
        for pos, record in sorted(((row["pos"], row["record"]) for row in rows), key=lambda r: r[0]):
            if pos < self.next or (pos > self.next and pos in self.early.at(pos // BLOCK)):
                found.append(self._issue(pos, json.loads(record).get("sequence"), REPEATED_POSITION))
            elif pos > self.next:
                self.early.at(pos // BLOCK, change=True)[pos] = record
                self.last_waiting = max(pos, self.last_waiting or pos)
            else:
                found += self._checked(pos, record)
                found += self._released()
        self._store()
        yield from (_ISSUE(key[0], *issue) for issue in found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._open(timerValues.getCurrentProcessingTimeInMs())
        self.timed, found = False, []
        if self.last_waiting is not None:
            first = min(block for (block,) in self.early_state.keys())
            self.next = min(self.early.at(first))
            found = self._released(gap=True)
        self._store()
        yield from (_ISSUE(key[0], *issue) for issue in found)


def stream_chain_issues(records: DataFrame, spec: ChainSpec, *, signature_valid: Column | None = None, forget_after_seconds: float | None = None,
                        wait_seconds: float = 600) -> DataFrame:
    """All integrity issues of a stream of records: the columns of `chain_issues`, equal to it once every position has arrived.

    `records` has `chain_id`, `pos` (neither null) and the spec's columns, in any order and spread over any batches. Hashes are
    made in the JVM. A value used again is reported while its first use is not older than `forget_after_seconds` (never
    forgotten by default). Records whose predecessor does not come within `wait_seconds` are released with
    `missing_positions`; what comes for a checked position afterwards is a `repeated_position`.
    """
    use_keyed_state(records.sparkSession)
    signed = F.lit(True) if signature_valid is None else F.coalesce(signature_valid, F.lit(False))
    fields = (F.col("sequence"), F.col(spec.unique), F.col(spec.previous), F.col(spec.hash), record_hash(spec).eqNullSafe(F.col(spec.hash)), signed)
    record = F.to_json(F.struct(*[field.alias(name) for name, field in zip(_FIELDS, fields)]))
    rows = records.select("chain_id", "pos", record.alias("record"))
    ttl = None if forget_after_seconds is None else int(1000 * forget_after_seconds)
    processor = ChainProcessor(_Names(spec.tampering, spec.reuse, dict(spec.messages)), signature_valid is not None, ttl, int(1000 * wait_seconds))
    return rows.groupBy("chain_id").transformWithState(processor, OUT, "append", "ProcessingTime")
