"""Named end-to-end queries."""


def load_catalog():
    """``(queries, oracles)`` with every query module imported."""
    from coinweave.plans import catalog, queries_ledger, queries_tables  # noqa: F401

    return dict(catalog.QUERIES), dict(catalog.ORACLES)
