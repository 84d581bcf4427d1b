import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from palisade.operators.scan import picked, picks


def one_by_one(at, need, last):
    out = []
    for i, (t, n) in enumerate(zip(at, need, strict=True)):
        if last is None or t - last >= n:
            out.append(i)
            last = t
    return out


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(-1, 12)), max_size=40), st.booleans(), st.integers(1, 3))
def test_picks_as_one_by_one(rows, positive, least):
    at = np.array(sorted(t for t, _ in rows), np.int64)
    need = np.array([max(n, least) if positive else n for _, n in rows], np.int64)
    assert picks(at, need, None) == one_by_one(at.tolist(), need.tolist(), None)
    assert picks(at, need, -5) == one_by_one(at.tolist(), need.tolist(), -5)


def test_keys_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.sql("SELECT if(id % 3 = 0, NULL, concat('k', id % 3)) AS k, id % 2 AS j, id * id % 211 AS t, 10 + id % 5 AS need FROM range(300)")
        got = {}
        for r in picked(rows, ["k", "j"], "t", "need", ["need"]).collect():
            got.setdefault((r.k, r.j), []).append(r)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 6
    for own in got.values():
        own.sort(key=lambda r: (r.t, r.need))
        found = one_by_one([r.t for r in own], [r.need for r in own], None)
        assert sum(r.picked for r in own) == len(found)
        last = None
        for i, r in enumerate(own):
            last = r.t if i in found else last
            assert r.last == last


def test_empty(spark):
    assert picked(spark.sql("SELECT 'a' AS k, 1L AS t, 1L AS need WHERE false"), ["k"], "t", "need").count() == 0
