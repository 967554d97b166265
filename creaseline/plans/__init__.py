"""Query definitions, grouped by operator family."""

from importlib import import_module

FAMILIES = [
    "sources",
    "writes",
    "scalars",
    "filters",
    "joins",
    "aggregates",
    "windows",
    "paging",
    "search",
    "streams",
]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
