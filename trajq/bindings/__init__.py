from importlib import import_module

MODULES = ("alignment", "motion", "vectors", "statistics", "quality", "episodes", "evaluation", "storage")


def collect():
    queries, sql = {}, {}
    for m in MODULES:
        mod = import_module(f"trajq.bindings.{m}")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql
