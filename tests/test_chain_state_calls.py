"""How often the stream check of a chain calls its state, and that its blocks lose nothing."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import Row

from assaylake.fixed_values import GENESIS_HASH
from assaylake.streaming import chain_state


class _State:
    def __init__(self, calls):
        self.rows, self.calls = {}, calls

    def get(self):
        self.calls["get"] += 1
        return self.rows.get(())

    def update(self, value):
        self.calls["update"] += 1
        self.rows[()] = value

    def getValue(self, key):
        self.calls["getValue"] += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls["updateValue"] += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls["removeKey"] += 1
        self.rows.pop(key, None)

    def keys(self):
        return iter(list(self.rows))


class _Handle:
    def __init__(self):
        self.calls, self.states, self.timers = Counter(), {}, []

    def getValueState(self, name, *_):
        return self.states.setdefault(name, _State(self.calls))

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls["registerTimer"] += 1
        self.timers.append(at)


class _Time:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _records(length):
    return [Row(chain_id="c", pos=p, record=json.dumps({
        "sequence": 5 if p == 700 else p + 1, "value": "again" if p in (90, 1400) else f"n{p}",
        "previous": "x" if p == 11 else f"h{p - 1}" if p else GENESIS_HASH, "hash": f"h{p}", "sound": p != 33})) for p in range(length)]


@pytest.mark.parametrize("held", [2, 4_096])
def test_a_chain_in_shuffled_batches_takes_few_calls(monkeypatch, held):
    monkeypatch.setattr(chain_state, "HELD_BLOCKS", held)
    messages = dict.fromkeys(("tampered", "reuse", "broken_chain", "sequence_discontinuity", "duplicate_sequence"), "")
    processor, handle = chain_state.ChainProcessor(chain_state._Names("tampered", "reuse", messages), False, None, 1000), _Handle()
    processor.init(handle)
    rows = _records(1500)
    random.Random(1).shuffle(rows)
    found = []
    for k in range(4):
        found += [tuple(r)[1:5] for r in processor.handleInputRows(("c",), iter(rows[k::4]), _Time(k))]
    assert sorted(found, key=str) == sorted([
        (11, 12, "broken_chain", None), (33, 34, "tampered", None), (700, 5, "sequence_discontinuity", 701),
        (700, 5, "duplicate_sequence", None), (1400, 1401, "reuse", None)], key=str)
    assert not handle.states["early"].rows and handle.states["head"].rows[()][:3] == ("h1499", 1500, None)
    kept = [v for row in handle.states["values"].rows.values() for v, _ in json.loads(row[0])]
    assert len(kept) == len(set(kept)) == 1499
    if held > 2:
        assert sum(handle.calls.values()) < len(rows) / 4
        assert max(len(json.loads(row[0])) for row in handle.states["values"].rows.values()) < 4 * chain_state.BLOCK
    again = [tuple(r)[1:4] for r in processor.handleInputRows(("c",), iter(rows[:3]), _Time(9))]
    assert [a[2] for a in again] == [chain_state.REPEATED_POSITION] * 3
