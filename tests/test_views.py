"""The derived views keep the facts FIXTURES.md states about the driver tables."""

from pyspark.sql import functions as F

from brook.operators import clean as C
from brook.operators import quality as Q
from brook.plans import views as V
from paths import SF01


def test_pods_unique_per_order_line(spark):
    p = V.pods(spark, SF01)
    assert p.count() == 45832 == p.select("namespace", "run", "rank").distinct().count()
    runs = V.job_runs(spark, SF01)
    same = (p.namespace == runs.namespace) & (p.run == runs.name)
    assert p.join(runs, same, "left_anti").count() == 0  # every owner exists
    assert runs.join(p, same, "left_anti").count() == 257  # orders without a line
    assert runs.select("name").distinct().count() * 2 < runs.count()  # names repeat across namespaces
    assert runs.count() == runs.select("namespace", "name").distinct().count()


def test_articles_reject_rate_above_gate(spark):
    a = Q.audit(C.clean(V.articles(spark, SF01), lineage=False)).first()
    assert a.raw_rows == 1000 and a.reject_pct == 21.5 and a.gate_passed is False


def test_event_runs_and_timestamps(spark):
    h = V.status_history(spark, SF01)
    assert h.select("namespace", "run").distinct().count() == 150
    assert dict(h.dtypes)["ts"] == "timestamp"  # watermark-ready (not timestamp_ntz)
    assert h.filter(F.col("phase").isNull()).count() == 0
