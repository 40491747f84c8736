import tempfile
import uuid

from casebook.operators import triage
from casebook.streaming import records as st


def test_stream_matches_batch(spark, small_cases):
    folder = tempfile.mkdtemp(prefix="casebook-stream-in-")
    parts = small_cases.randomSplit([0.5, 0.5], seed=3)
    for p in parts:  # two arrivals
        p.write.mode("append").parquet(folder)
    name = "flagged_" + uuid.uuid4().hex[:8]
    st.run_available(st.flagged_stream(st.record_stream(spark, folder)), name)
    got = spark.table(name)
    exp = triage.triage_flagged(small_cases)
    assert got.count() == exp.count()
    assert sorted(r[0] for r in got.select("Patient_ID").collect()) == \
        sorted(r[0] for r in exp.select("Patient_ID").collect())

    kname = "kpis_" + uuid.uuid4().hex[:8]
    st.run_available(st.running_kpis(st.record_stream(spark, folder)), kname, mode="complete")
    k = {r["Condition"]: r for r in spark.table(kname).collect()}
    b = {r["Condition"]: r["n"] for r in small_cases.groupBy("Condition").count()
         .withColumnRenamed("count", "n").dropna().collect()}
    assert {c: r["n"] for c, r in k.items()} == b
