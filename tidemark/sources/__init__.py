"""Readers for study metadata and sinks for cubes, spines and reports."""
