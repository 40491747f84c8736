"""How often the statistics read their input."""

import pytest

from casebook.operators import anomaly, charts, cohort


@pytest.fixture(scope="module")
def counted(spark, small_cases):
    """(frame, reads): the cases, and how often they were read since the last call."""
    seen, total = spark.sparkContext.accumulator(0), small_cases.count()

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def reads():
        n, seen.value = seen.value / total, 0
        return n

    return small_cases.mapInArrow(count, small_cases.schema), reads


STATISTICS = {
    "percentile_cuts": lambda df: cohort.percentile_cuts(df),
    "kpi_overview": lambda df: cohort.kpi_overview(df),
    "kpi_by_group": lambda df: cohort.kpi_overview(df, by=["Condition"]),
    "los_benchmark": lambda df: cohort.los_benchmark(df),
    "satisfaction_overall": lambda df: cohort.satisfaction_overall(df),
    "satisfaction_report": lambda df: cohort.satisfaction_report(df),
    "target_stats": lambda df: cohort.target_stats(df),
    "combination_frequency": lambda df: cohort.combination_frequency(df),
    "histogram": lambda df: charts.histogram_data(df, "Cost"),
    "boxplot": lambda df: charts.boxplot_data(df, "condition", "los"),
}
WITH_ROWS = {
    "record_summary": lambda df: cohort.record_summary(df),
    "rare_combinations": lambda df: anomaly.rare_combinations(df),
    "boxplot_outliers": lambda df: charts.boxplot_outliers(df, "condition", "los"),
}


@pytest.mark.parametrize("name", STATISTICS)
def test_statistics_read_once(counted, name):
    df, reads = counted
    reads()
    STATISTICS[name](df).collect()
    assert reads() <= 1


@pytest.mark.parametrize("name", WITH_ROWS)
def test_rows_beside_statistics_read_twice(counted, name):
    df, reads = counted
    reads()
    WITH_ROWS[name](df).collect()
    assert reads() <= 2
