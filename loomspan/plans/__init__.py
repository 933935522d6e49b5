"""Chains of operators: raw table to features, evaluation, forecasts; and the registered queries."""
