"""The suffix sort of op 6: its order, and the groups that its last step leaves."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.llm import suffixes


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(1, 3), st.integers(0, 1), st.sampled_from([1, 3, 4]), st.sampled_from([8, 9, 31, 50, 64]))
def test_groups_of_the_sort_are_common_prefixes(data, alphabet, low, times, depth):
    text = np.frombuffer(bytes(b % alphabet + low for b in data) * times, np.uint8)
    sa, new = suffixes.sorted_suffixes(text, depth)
    raw = text.tobytes()
    keys = [raw[i : i + depth] for i in sa]
    assert sorted(sa.tolist()) == list(range(len(raw))) and keys == sorted(keys)
    assert new[0] and (new[1:] == (suffixes.common_prefixes(text, sa, depth)[1:] < depth)).all()


@pytest.mark.parametrize("depth", [8, 9, 50])
def test_a_short_suffix_comes_before_zeros(depth):
    raw = b"\1" + bytes(8) + b"\2" * 9 + b"\1"
    sa = suffixes.suffix_array(np.frombuffer(raw, np.uint8), depth)
    assert [raw[i : i + depth] for i in sa] == sorted(raw[i : i + depth] for i in range(len(raw)))


@pytest.mark.parametrize("shard", [500, 1 << 20])
def test_windows_are_found_without_a_walk_of_prefixes(monkeypatch, shard):
    """The walk took 36 % of the query's time; the sort's own groups tell the same."""

    def walk(*_):
        raise AssertionError("a walk of prefixes")

    monkeypatch.setattr(suffixes, "common_prefixes", walk)
    rng = np.random.default_rng(5)
    pieces = [bytes(rng.integers(0, 2, n, np.uint8)) for n in rng.integers(50, 90, 60)]
    pieces += [p[:k] + q[k:] for p, q, k in zip(pieces, pieces[1:], rng.integers(0, 90, 59), strict=False) if len(p[:k] + q[k:]) >= 50]
    docs, least = rng.permutation(len(pieces)).astype(np.int64), {}
    for p, d in zip(pieces, docs.tolist(), strict=True):
        for i in range(len(p) - 49):
            least[p[i : i + 50]] = min(d, least.get(p[i : i + 50], d))
    got = suffixes.least_documents(pieces, docs, 50, shard)
    assert [x.tolist() for x in got] == [[least[p[i : i + 50]] for i in range(len(p) - 49)] for p in pieces]
