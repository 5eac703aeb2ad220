import os
from collections import defaultdict

from gridloom.plans import impact_queries

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")

SF = f"{DATA}/sf0.001"


def test_history_takes_every_error_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'error'").selectExpr("event_id", "user_id", "to_date(ts) AS day").collect()
    names = {f"LOC-{r.n_nationkey}" for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    of = defaultdict(list)
    for e in events:
        if str(e.day) >= "2024-01-05" and f"LOC-{e.user_id % 25}" in names:
            of[f"LOC-{e.user_id % 25}"].append((-e.day.toordinal(), e.event_id))
    want = {(n, i) for n, found in of.items() for _, i in sorted(found)[:10]}
    got = impact_queries.history_of_all(spark, SF).collect()
    assert {(r.name, r.incident_id) for r in got} == want and any(i % 25 for _, i in want)
