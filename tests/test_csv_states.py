"""Quote states of CSV lines, folded as their splits are read."""

import csv
import io
import random

import pytest

from tabwright.sources import csv_records as R

LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_quote_states_follow_the_lines_without_a_shuffle(spark, tmp_path, batch):
    rng = random.Random(5)
    rows = [(str(i), "".join(rng.choice(["a", "\n", '"', ",", 'x\n"', "\n\n"]) for _ in range(5)) + "z") for i in range(150)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("k", "v"), *rows])
    (tmp_path / "a.csv").write_text(out.getvalue(), newline="")
    kept = {c: spark.conf.get(c) for c in (LIMIT, "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set(LIMIT, batch)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        lines = R.text_lines(spark, str(tmp_path))
        steps = plan(R.begun_states(lines))
        assert "Window" not in steps and "Exchange" not in steps
        got = [r["record"] for r in R.csv_records(lines).orderBy("place").collect()]
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert [tuple(next(csv.reader(io.StringIO(g, newline="")))) for g in got] == [("k", "v"), *rows]
