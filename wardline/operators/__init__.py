"""Operators: plain functions from DataFrame to DataFrame, lazy, with no clock inside."""
