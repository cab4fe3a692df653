"""Relational and statistical operators: functions from DataFrame to DataFrame."""
