"""Registered queries: each binds an operator to an adapter view of the given tables."""
import importlib

MODULES = ["ranks", "sources", "spine", "joins", "recordings", "spectra", "operating", "modelling", "inference", "stress"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")
