"""Whole jobs put together from the operators: evaluators, runs, reports."""
