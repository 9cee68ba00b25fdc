"""What the states of many streamed secrets cost, and that they are kept apart."""

import json

from pyspark.sql import Row

from leakscan.streaming.findings import NAMES, PackedStates, SecretState
from tests.test_state_calls import Handle


def hit(path, secret, commit, seq, score=None):
    order = {"live": int(commit is None), "points": 0, "length": 0, "by_seq": seq if commit else -seq, "by_rank": 0}
    return dict.fromkeys(NAMES) | {"detector_type": "JWT", "file_path": path, "matched_string": secret, "commit_hash": commit, "entropy_score": score, "seq": seq, "rank": 0} | order


HITS = [hit("a\\b", "s\n", "c1", 5), hit("a/b", "s\n", None, 2), hit("a/b", "s", "c2", 3, 3.75), hit("a/b", "s", "c1", 9), hit("a/b\n", "s", "c1", 7), hit(None, "é ", "c1", 8)]


def test_pairs_of_a_bucket_share_the_calls_to_the_state():
    handle, state = Handle(), SecretState()
    state.init(handle)
    first = list(state.handleInputRows((0,), iter(Row(**h) for h in HITS), None))
    assert handle.value.calls == 2
    assert {(r.file_path, r.matched_string): (r.occurrences, r.history_commits, r.commit_hash, r.entropy_score, r.seq) for r in first} == {
        ("a/b", "s\n"): (2, ["c1"], None, None, 2), ("a/b", "s"): (2, ["c1", "c2"], "c1", 3.75, 3), ("a/b\n", "s"): (1, ["c1"], "c1", None, 7), (None, "é "): (1, ["c1"], "c1", None, 8),
    }
    second = list(state.handleInputRows((0,), iter([Row(**hit("a/b", "s", "c3", 1, 3.5))]), None))
    assert handle.value.calls == 4
    assert [(r.occurrences, r.history_commits, r.entropy_score, r.seq) for r in second] == [(3, ["c1", "c2", "c3"], 3.5, 1)]  # the others had no hits


def test_packed_states_are_the_same():
    plain, packed, out = SecretState(), PackedStates(), []
    for state in (plain, packed):
        state.init(Handle())
    for part in (HITS[:3], HITS[3:]):
        want = [r.asDict() for r in plain.handleInputRows((0,), iter(Row(**h) for h in part), None)]
        rows = (Row("bucket", "hit")(0, json.dumps({k: v for k, v in h.items() if v is not None})) for h in part)
        got = [s for r in packed.handleInputRows((0,), rows, None) for s in json.loads(r.states)]
        out.append(sorted(map(repr, got)) == sorted(map(repr, want)))
    assert out == [True, True]
