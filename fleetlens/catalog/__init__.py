"""Registered queries: operators bound to the given tables, with their check SQL."""

FAMILIES = ("frames", "waits", "file_io", "requests", "sessions", "cpu_memory", "indexes", "storage", "backup", "jobs",
            "availability", "rules", "plan_documents", "streams")


def load() -> None:
    """Import every family, which registers its queries."""
    from importlib import import_module
    from importlib.util import find_spec

    for family in FAMILIES:
        if find_spec(f"fleetlens.catalog.{family}"):
            import_module(f"fleetlens.catalog.{family}")
