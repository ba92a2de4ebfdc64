"""Whole plans: the engine, fixtures and registered queries."""
