"""The list of queries: each a function of the tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from .views import Tables, with_views

_all: dict[str, tuple[Callable[[Tables], object], str | None]] = {}


def add(name: str, run: Callable[[Tables], object], sql: str | None = None) -> None:
    if name in _all:
        raise ValueError(f"{name} is there twice")
    _all[name] = (run, sql)


def queries() -> dict:
    return {name: (lambda spark, folder, run=run: run(Tables(spark, folder))) for name, (run, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _all.items() if sql}
