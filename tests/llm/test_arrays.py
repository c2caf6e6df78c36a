"""The file of arrays and the hash table of keys."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import arrays


@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=60), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30))
@settings(max_examples=60, deadline=None)
def test_places(keys, others):
    keys = np.array(sorted(keys), np.int64)
    wanted = np.array([*keys.tolist(), *others], np.int64)
    place = {k: i for i, k in enumerate(keys.tolist())}
    assert arrays.Index(keys).places(wanted).tolist() == [place.get(k, -1) for k in wanted.tolist()]


def test_keys_that_share_a_slot():
    keys = np.arange(1000, dtype=np.int64) << 40
    assert (arrays.Index(keys).places(keys) == np.arange(1000)).all() and (arrays.Index(keys).places(keys + 1) == -1).all()


def test_files(tmp_path):
    made = {"a": np.arange(7, dtype=np.int32), "none": np.zeros(0), "b": np.ones((3, 4), np.float32)}
    (tmp_path / "f").write_bytes(arrays.to_bytes(made, names=["x", "é"], n=2))
    got, notes = arrays.mapped(str(tmp_path / "f"))
    assert notes == {"names": ["x", "é"], "n": 2} and all((got[k] == made[k]).all() and got[k].shape == made[k].shape for k in made)
