"""The library's scalars and its frame table as SQL functions of a session, in SQL themselves: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import electrical, fusion

A, B, C = electrical.NTC_REFITTED
LN = f"ln({electrical.SERIES_OHM} / ({electrical.ADC_MAX} / adc - 1))"
FUNCTIONS = {
    "acs712_amps(adc DOUBLE) RETURNS DOUBLE": f"RETURN (adc / {electrical.ADC_MAX} * {electrical.VREF}D - {electrical.VREF / 2}D) / 0.1D",
    "ntc_celsius(adc DOUBLE) RETURNS DOUBLE": f"RETURN CASE WHEN adc > 0 AND adc < {electrical.ADC_MAX} THEN 1 / ({A!r}D + {B!r}D * {LN} + {C!r}D * power({LN}, 3)) - 273.15D END",
    "bus_volts(adc DOUBLE, ratio DOUBLE) RETURNS DOUBLE": f"RETURN adc / {electrical.ADC_MAX} * {electrical.VREF}D * ratio",
    "order_resolution(rpm DOUBLE, window_s DOUBLE) RETURNS DOUBLE": "RETURN CASE WHEN rpm > 0 THEN 60 / (window_s * rpm) ELSE double('Infinity') END",
    "branch_tier(validation_groups BIGINT, macro_f1 DOUBLE) RETURNS STRING": f"RETURN CASE WHEN macro_f1 IS NULL THEN 'NOT MEASURED' WHEN validation_groups >= {fusion.MIN_GROUPS} AND macro_f1 >= {fusion.MIN_MACRO_F1}D THEN 'Fault-capable' ELSE 'INDICATIVE' END",
    "frames(samples BIGINT, width INT, hop INT) RETURNS TABLE (w BIGINT, first_n BIGINT, end_n BIGINT)": "RETURN SELECT w, w * hop, w * hop + width FROM explode(CASE WHEN samples >= width THEN sequence(0L, (samples - width) DIV hop) ELSE array() END) AS t(w)",
}


def register(spark: SparkSession) -> list[str]:
    """Names of the functions, which the session's SQL can use from now on."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
