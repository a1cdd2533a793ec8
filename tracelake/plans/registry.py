"""Collects the queries and reference SQL of every plan module."""

from __future__ import annotations

from importlib import import_module

_MODULES: tuple[str, ...] = ("advantage", "rewards", "tools", "chats", "cases", "documents", "graphs", "extras")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        part = getattr(import_module(f"tracelake.plans.{m}"), name)()
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("queries")


def oracle_sql() -> dict:
    return _merged("oracle_sql")
