"""Spark-native engine for building, cleaning, scoring and profiling fine-tuning datasets."""

from importlib import import_module

__version__ = "0.1.0"

_HOMES = {
    "read_samples": "sources.readers", "read_seeds": "sources.readers", "read_documents": "sources.readers", "load_document_chunks": "sources.readers",
    "write_jsonl": "sources.writers", "write_cleaned": "sources.writers",
    "App": "plans.config", "Cleaner": "plans.config", "Quality": "plans.config",
    "Context": "plans.pipeline", "clean_rows": "plans.pipeline", "score_rows": "plans.pipeline", "inspect": "plans.pipeline", "render": "plans.pipeline", "run": "plans.pipeline", "create_strategy": "plans.pipeline",
    "MinHashDedup": "operators.dedup", "SemanticDedup": "operators.dedup", "NoDedup": "operators.dedup", "exact_dedup": "operators.dedup",
    "normalize_text": "functions.text",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    """Names are imported when they are first used."""
    if name in _HOMES:
        return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
    raise AttributeError(f"module {__name__} has no attribute {name}")
