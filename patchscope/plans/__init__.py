"""Complete queries: domain views over the given tables, and the catalogue built on them."""

from importlib import import_module

FAMILIES = ("verification", "resampling", "split", "patch", "field", "model", "result")


def all_queries():
    """(queries, oracle SQL) of every family."""
    from patchscope.plans import catalog

    for family in FAMILIES:
        import_module(f"patchscope.plans.{family}_queries")
    return catalog.QUERIES, catalog.ORACLES
