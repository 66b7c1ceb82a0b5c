import math

import pytest

from rotorlens.functions import registered


def test_sql_functions(spark):
    assert "frames" in registered.register(spark)
    row = spark.sql("SELECT acs712_amps(532), ntc_celsius(515), ntc_celsius(0), bus_volts(1023, 2), order_resolution(1500, 1), order_resolution(0, 1), branch_tier(3, 0.8), branch_tier(2, 0.8), branch_tier(3, NULL)").first()
    assert row[0] == pytest.approx(1.0019550342130978) and row[1] is not None and row[2] is None and row[3] == 10 and row[4] == 0.04 and math.isinf(row[5])
    assert tuple(row)[6:] == ("Fault-capable", "INDICATIVE", "NOT MEASURED")
    assert [tuple(r) for r in spark.sql("SELECT * FROM frames(12, 6, 3)").collect()] == [(0, 0, 6), (1, 3, 9), (2, 6, 12)]
    assert spark.sql("SELECT * FROM frames(5, 6, 3)").count() == 0
