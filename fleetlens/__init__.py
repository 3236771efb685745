"""Telemetry analytics for database fleets, written as Spark DataFrame operators."""
