"""All queries of this library and their SQL."""

from .plans import basics, learning, states  # noqa: F401


def queries() -> dict:
    return dict(basics.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(basics.SQL)
