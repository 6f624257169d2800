"""All queries of the subpackage, registered by importing its modules, and the pipeline's."""

from __future__ import annotations

import importlib
import pkgutil

import touchline.llm as package
from touchline.llm.registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        importlib.import_module(f"{package.__name__}.{module}")
    import corpus_pipeline  # at the top of the repository; it imports this package's operators

    oracle = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return QUERIES | {"pipeline": corpus_pipeline.run}, ORACLES | oracle
