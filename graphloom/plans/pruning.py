"""Graph pruning by a model of classes: a pattern reads only graphs that can hold its predicate for the types its subject may
have. Types come from patterns that state them, else from the classes that have all the predicates asked of the subject."""

from __future__ import annotations

from dataclasses import dataclass

from .access import ByType


@dataclass(frozen=True)
class Class:
    uri: str
    properties: tuple[str, ...]


def subject_types(model: list[Class], predicates: list[str], stated: list[str] = ()) -> set[str]:
    if stated:
        return {*stated}
    return {c.uri for c in model if {*predicates} <= {*c.properties}}


def graphs_for(spec_graphs: list[tuple], types: set[str], predicate: str) -> list[str]:
    """spec_graphs: (graph name, constraint) pairs that the caller may read. Rules are data, so no query is run for this."""
    out = []
    for name, constraint in spec_graphs:
        if isinstance(constraint, ByType) and constraint.types is not None and types and not types & {*constraint.types}:
            continue
        if constraint.predicates.allows(predicate):
            out.append(name)
    return out
