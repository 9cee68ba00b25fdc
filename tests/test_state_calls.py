"""What the state of a streamed secret costs."""

from pyspark.sql import Row

from leakscan.streaming.findings import NAMES, SecretState


class Value:
    """A value state that counts the calls to it."""

    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value


class Handle:
    def __init__(self):
        self.value = Value()

    def getValueState(self, name, schema, *rest):
        return self.value


def test_state_of_a_secret_is_read_and_written_once():
    handle, state = Handle(), SecretState()
    state.init(handle)
    row = lambda commit, seq: Row(**dict.fromkeys(NAMES) | {"commit_hash": commit, "seq": seq, "rank": 0, "live": 0, "points": 0, "length": 0, "by_seq": seq, "by_rank": 0})
    first = list(state.handleInputRows(("p", "s"), iter([row("c1", 5), row("c2", 7), row("c1", 9)]), None))
    second = list(state.handleInputRows(("p", "s"), iter([row("c3", 8)]), None))
    assert handle.value.calls == 4
    assert (first[0].occurrences, first[0].history_commits, first[0].seq) == (3, ["c1", "c2"], 5)
    assert (second[0].occurrences, second[0].history_commits, second[0].commit_hash) == (4, ["c1", "c3", "c2"], "c1")
