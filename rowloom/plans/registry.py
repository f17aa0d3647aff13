"""Every registered query, with the SQL that must return the same rows where SQL can say it."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put
