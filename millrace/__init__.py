"""Retail lake pipeline on Spark: arrival checks, conforming, quality gate, reports."""
