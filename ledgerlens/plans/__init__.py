"""Pipelines and the query registry."""


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for m in ("queries_base", "queries_customer", "queries_quality", "queries_split", "queries_seller", "queries_drift", "queries_eval", "queries_causal", "queries_models", "queries_products", "queries_facts"):
        try:
            importlib.import_module(f"ledgerlens.plans.{m}")
        except ModuleNotFoundError as e:  # a module not written yet
            if e.name != f"ledgerlens.plans.{m}":
                raise
