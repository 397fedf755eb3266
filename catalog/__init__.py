"""Named queries over the test tables, each with an equivalent SQL text where one exists."""


def all_queries():
    import importlib

    from catalog import registry
    for module in ("listings", "market", "trends", "changes", "register", "texts", "requests", "streams"):
        try:
            importlib.import_module(f"catalog.{module}")
        except ModuleNotFoundError as exc:
            if exc.name != f"catalog.{module}":
                raise
    return registry.QUERIES, registry.ORACLES
