"""Pipelines a user calls, built from the operators."""
