"""Stored daily sketches merged into longer periods, against distinct counts of the transactions."""

import datetime as dt
import random

from ledgerlens.operators import kpis


def test_stored_days_merge(spark, tmp_path):
    rng = random.Random(2)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(90)), rng.randrange(5), rng.randrange(40_000), 2.0, 1.0, 1.0) for _ in range(30_000)]
    txn = spark.createDataFrame(rows, "transaction_date date, offering_id int, customer_id int, total_amount double, cost double, profit double")
    for part in (txn.where("transaction_date < '2024-02-10'"), txn.where("transaction_date >= '2024-02-10'")):
        kpis.daily_sketches(part).write.mode("append").parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    for period, of in (("week", lambda d: d - dt.timedelta(days=d.weekday())), ("month", lambda d: d.replace(day=1))):
        want = {}
        for day, _, customer, *_ in rows:
            want.setdefault(of(day), []).append(customer)
        found = {r.period_start: r for r in kpis.merged_metrics(stored, period).collect()}
        assert set(found) == set(want)
        for start, customers in want.items():
            assert found[start].transaction_count == len(customers) and found[start].revenue == 2.0 * len(customers)
            assert abs(found[start].unique_customers - len(set(customers))) <= 0.02 * len(set(customers))
    by_offering = kpis.merged_metrics(stored, "year", ("offering_id",)).collect()
    assert {r.offering_id for r in by_offering} == set(range(5))
