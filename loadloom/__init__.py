"""Demand-forecast analytics over many series, written as Spark DataFrame jobs."""
