"""Query name -> callable, query name -> SQL, gathered from the plan modules."""

from __future__ import annotations


def _modules():
    from . import scalars, stored, worlds

    return [scalars, worlds, stored]


def queries():
    out = {}
    for m in _modules():
        out.update(m.queries())
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.oracle_sql())
    return out
