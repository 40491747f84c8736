import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from casebook.session import get_spark
    s = get_spark("local[4]", app="casebook-tests", shuffle_partitions=4,
                  extra={"spark.local.dir": tempfile.mkdtemp(prefix="casebook-test-"),
                         "spark.driver.memory": "4g"})
    yield s
    s.stop()


CASE_ROWS = [
    # id, age, gender, condition, procedure, cost, los, readm, outcome, sat
    (1, 30, "Male", "Diabetes", "Insulin Therapy", 1000.0, 3, "No", "Recovered", 5),
    (2, 45, "Female", "Diabetes", "Insulin Therapy", 2000.0, 5, "Yes", "Stable", 2),
    (3, 60, "Male", "Heart Disease", "Angioplasty", 30000.0, 9, "Yes", "Stable", 1),
    (4, 60, "Female", "Heart Disease", "Angioplasty", 30000.0, 9, "No", "Recovered", 4),
    (5, None, "Male", "Cancer", "Surgery", 50000.0, 12, "Yes", "Recovered", 3),
    (6, 72, None, "Cancer", "Chemotherapy", None, 7, "No", "Stable", 3),
    (7, 55, "Female", None, "Surgery", 8000.0, None, None, "Recovered", None),
    (8, 41, "Male", "Diabetes", None, 1500.0, 2, "No", None, 4),
    (9, 38, "Female", "Fracture", "Cast", 900.0, 1, "No", "Recovered", 5),
    (10, 66, "Male", "Heart Disease", "Bypass", 45000.0, 14, "Yes", "Stable", 2),
    (11, 50, "Female", "Fracture", "Surgery", 12000.0, 4, "No", "Recovered", 4),
    (12, 29, "Male", "Cancer", "Chemotherapy", 22000.0, 6, "Yes", "Stable", 1),
]


@pytest.fixture(scope="session")
def tiny_cases(spark):
    from casebook.schema import CASE_SCHEMA
    return spark.createDataFrame(CASE_ROWS, CASE_SCHEMA)


@pytest.fixture(scope="session")
def one_case(spark):
    from casebook.schema import CASE_SCHEMA
    return spark.createDataFrame(CASE_ROWS[:1], CASE_SCHEMA)


@pytest.fixture(scope="session")
def empty_cases(spark):
    from casebook.schema import CASE_SCHEMA
    return spark.createDataFrame([], CASE_SCHEMA)


@pytest.fixture(scope="session")
def small_cases(spark):
    from casebook.sources.tables import case_view
    return case_view(spark, SF_SMALL).cache()


def pdf(df, order=None):
    p = df.toPandas()
    if order:
        p = p.sort_values(order).reset_index(drop=True)
    return p
