import pytest

from brook.operators import clean as C
from brook.operators import quality as Q


def test_required_filter_drops_missing_and_corrupt(spark):
    df = spark.createDataFrame([("1", "t", "s", None), ("2", None, "s", None), ("3", "t", None, None),
                                ("4", "t", "s", "bad,row")],
                               "id string, title string, source string, _corrupt_record string")
    out = C.required_filter(df)
    assert [r.id for r in out.collect()] == ["1"] and "_corrupt_record" not in out.columns


def test_gates():
    assert Q.reject_gate(100, 80) == 20.0  # exactly at the gate passes
    with pytest.raises(Q.GateError):
        Q.reject_gate(1000, 799)
    assert Q.reject_gate(0, 0) == 0.0
    assert Q.require_rows(3) == 3
    with pytest.raises(Q.GateError):
        Q.require_rows(0, "rows scraped")
