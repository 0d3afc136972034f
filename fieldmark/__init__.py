"""Audits of sensor-archive recordings and self-report tables as Spark jobs."""
