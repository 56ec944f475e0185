"""Registered queries, one module per family."""
from importlib import import_module

FAMILIES = ["scoring", "runs", "corpus", "textops", "training", "structure", "files"]


def load() -> None:
    for name in FAMILIES:
        try:
            import_module(f"tandem.plans.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"tandem.plans.{name}":
                raise
