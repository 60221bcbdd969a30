"""Named queries over the test tables."""

from importlib import import_module


def load_all():
    """The registry with every query module imported."""
    for m in ("recruiting", "duplicates", "texts", "extraction", "streams"):
        import_module(f"talentgrid.plans.{m}")
    return import_module("talentgrid.plans.registry")
