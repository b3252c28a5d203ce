"""Benchmark inputs are worked out once, however many passes the medians take."""

from photoflow.operators import reports as A


def test_benchmark_inputs_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    d = spark.createDataFrame([(1, 10, 0, 5), (1, 11, 2, 70_000), (2, 12, 0, 9)], "bench_id int, doc_id long, n_errors int, pipeline_ms long")
    r = spark.createDataFrame([(1, True, 2, 4, 1 << 40), (1, False, None, None, 3), (2, True, 1, 0, 8)], "bench_id int, json_valid boolean, n_attempts int, load_ns long, duration_ms long")
    got = sorted(map(tuple, A.bench_metrics(d.mapInPandas(run, d.schema), r.mapInPandas(run, r.schema)).collect()))
    assert got == [(1, 2, 1, 70_000, 2, 1, 1, 4, 1 << 40), (2, 1, 0, 9, 1, 1, 0, 0, 8)]
    assert seen.value == 6
