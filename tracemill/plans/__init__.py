"""Compositions of operators: preprocessing runs, experiments, reports."""
