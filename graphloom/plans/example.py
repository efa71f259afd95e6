"""An example of a configuration: what is shared, what each user has alone, and what is dumped, walked from top to bottom."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.quads import NS
from .access import READ, READ_FOR_WRITE, WRITE, ByPrefix, ByType, Cleanup, GraphSpec, Group, all_except, none_except


def groups(user_of: Callable[[str | None], DataFrame]) -> list:
    """user_of: a table with a user's name for each user that a session stands for. Texts are read by all, labels but for their
    toxicity too; that is written to the user's own graph, and all of both to a dump, with what points at them."""
    texts, labels = NS + "documents", NS + "labels"
    shared = (
        GraphSpec(NS + "graphs/shared", ByType((texts,))),
        GraphSpec(NS + "graphs/labels", ByType((labels,), predicates=all_except(NS + "toxic"))),
        GraphSpec(NS + "graphs/first", ByPrefix(texts + "/1")),
    )
    own = (GraphSpec(NS + "graphs/users/", ByType((labels,), predicates=none_except(NS + "toxic"))),)
    dump = (GraphSpec(NS + "graphs/dump", ByType((texts, labels), inverse=all_except())),)
    return [
        Group("shared", shared, usage=frozenset({READ, READ_FOR_WRITE})),
        Group("users", own, access=user_of),
        Group("dump", dump, usage=frozenset({WRITE})),
        Cleanup("clean"),
    ]
