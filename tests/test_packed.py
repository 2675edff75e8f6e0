"""Rows packed on their way to keyed state and in it."""

import numpy as np
import pyarrow as pa

from tagloom.streaming import packed
from tagloom.streaming import readiness as sr
from tagloom.streaming.machine import Event


def test_a_block_comes_back_as_it_was():
    numbers = np.array([5, packed.NULL, -7, 2**62, 5], np.int64)
    coded = packed.Coded(np.array([2, 0, 0, 1, 2]), ["b", None, "a", "unused"])
    forms = packed.joint([coded, packed.Coded(np.array([0, 1, 1, 0, 0]), [True, False])])
    got, names, both = packed.load(packed.dump([numbers, coded, forms]))
    assert got.tolist() == numbers.tolist()
    assert names.column() == ["a", "b", "b", None, "a"] and "unused" not in names.values
    assert both.column() == [("a", True), ("b", False), ("b", False), (None, True), ("a", True)] and len(both.values) == 3
    twice = packed.merged([[numbers, coded], [numbers, packed.Coded(np.zeros(5, np.int64), ["a"])]])
    assert twice[1].column() == [*coded.column(), *["a"] * 5] and len(twice[0]) == 10


def test_rows_are_few_and_small_on_their_way_to_the_state():
    """20,000 events of two slices are a handful of rows of some bytes an event; rows without a moment go."""
    n, rng = 20_000, np.random.default_rng(1)
    values = {"status": "", "update_frequency": "D", "freq": "D", "counts": True, "n_daily": 2, "n_monthly": 0, "day": "2024-01-01",
              "month": "202401", "target_month": "202312", "run_day": "", "cycle": "2024-01-01"}
    columns = {"slice": pa.array(np.arange(n) % 2, pa.int32()), "us": pa.array([None, *rng.integers(0, 10**12, n - 1).tolist()]),
               "event_id": pa.array(np.arange(n)), "unit": pa.array([f"TAG_{i % 3000}" for i in range(n)]),
               "key_no": pa.array(np.arange(n) % 3, pa.int32()), **{k: pa.array([v] * n) for k, v in values.items()}}
    batch = pa.RecordBatch.from_pydict({k: columns[k] for k in ["slice", *sr.NUMBERS, "unit", *sr.FORM]})
    out = list(packed.packer(sr.NUMBERS, "unit", sr.FORM)([batch.slice(0, 7000), batch.slice(7000)]))
    assert [b.num_rows for b in out] == [1] * len(out) and len(out) <= 4
    assert sum(len(b.column(1)[0].as_py()) for b in out) < 16 * n
    got = set()
    for b in out:
        us, event_id, units, forms = packed.load(b.column(1)[0].as_py())
        assert (np.diff(us) >= 0).all()
        got |= {(b.column(0)[0].as_py(), *r[:3], *Event(*r[3][1:])[1:5]) for r in zip(us.tolist(), event_id.tolist(), units.column(), forms.column())}
    given = batch.to_pylist()[1:]
    assert got == {(r["slice"], r["us"], r["event_id"], r["unit"], "D", "D", r["key_no"], True) for r in given}
