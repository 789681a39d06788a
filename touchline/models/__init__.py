"""Estimators with distributed fit and transform."""
