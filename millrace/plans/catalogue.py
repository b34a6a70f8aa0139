"""Imports every plan module, which fills the registry."""

import importlib
import pkgutil

import millrace.plans as plans
from millrace.plans.registry import ORACLES, QUERIES  # noqa: F401

for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if module not in ("catalogue", "registry"):
        importlib.import_module(f"millrace.plans.{module}")
