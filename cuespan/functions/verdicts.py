"""Fleet check verdicts from measured machine values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def machine_verdict(cpu: Column, ram_gb: Column) -> Column:
    ram = F.coalesce(ram_gb, F.lit(0.0))
    cores = F.when(F.coalesce(cpu, F.lit(0)) == 0, 1).otherwise(cpu)
    return (
        F.when((ram > 0) & (ram < 2.0), "bad")
        .when((cores < 2) | ((ram > 0) & (ram < 4.0)), "warn")
        .otherwise("ok")
    )


def disk_verdict(data_gb: Column, watch_gb: Column, write_mbps: Column, error: Column) -> Column:
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "bad")
        .when(data_gb < 2.0, "bad")
        .when((data_gb < 10.0) | (watch_gb < 2.0), "warn")
        .when(write_mbps < 20.0, "warn")
        .otherwise("ok")
    )


def decode_verdict(ratio: Column) -> Column:
    r = F.coalesce(ratio, F.lit(0.0))
    return F.when(r >= 0.60, "bad").when(r >= 0.25, "warn").otherwise("ok")


def ocr_verdict(ocr_ms: Column) -> Column:
    ms = F.coalesce(ocr_ms, F.lit(0.0))
    return F.when(ms >= 2500.0, "bad").when(ms >= 800.0, "warn").otherwise("ok")


def minutes_for_half_hour(ocr_ms: Column, decode_ratio: Column, cpu: Column) -> Column:
    """Expected minutes of recognition for 30 minutes of footage, NULL without a reading time."""
    cores = F.when(F.coalesce(cpu, F.lit(0)) == 0, 4).otherwise(cpu)
    workers = F.greatest(F.lit(2), F.least(F.lit(6), F.floor(F.greatest(F.lit(1), cores) / 4)))
    reading = F.lit(1800.0) * (ocr_ms / 1000.0) / workers / 60.0
    decoding = F.lit(1800.0) * F.coalesce(decode_ratio, F.lit(0.0)) / 60.0
    return F.when(F.coalesce(ocr_ms, F.lit(0.0)) != 0, F.bround(reading + decoding, 1))
