"""Import every query module once."""

import importlib

for _m in ("cleaning", "scoring", "lookups", "series", "statistics", "workload", "experiments", "tables", "findings", "studies"):
    importlib.import_module(f"catalog.{_m}")
