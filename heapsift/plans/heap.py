"""A heap in use: its tables, and what its first question works out and later ones find."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import graph
from .tables import HeapTables


@dataclass
class Heap:
    tables: HeapTables
    _net: graph.Net | None = None
    _live: DataFrame | None = None
    _reached: DataFrame | None = None
    _found: tuple[DataFrame, DataFrame | None] | None = None
    _tree: DataFrame | None = None

    @property
    def net(self) -> graph.Net:
        """The pairs of objects that an edge joins, dealt by source."""
        if self._net is None:
            self._net = graph.net(self.tables.edges)
        return self._net

    @property
    def live(self) -> DataFrame:
        """obj, level of what is reached. Cheaper than reached, which knows the order too."""
        if self._live is None:
            self._live = graph.live(self.net, self.tables.roots)
        return self._live

    @property
    def reached(self) -> DataFrame:
        if self._reached is None:
            self._reached = graph.reach(self.tables.edges, self.tables.roots)
        return self._reached

    def paths(self, targets: DataFrame) -> DataFrame:
        """The ways from roots to targets (obj), as graph.root_paths() gives; what has been reached in order is used, but not worked out for them."""
        if self._reached is not None:
            return graph.root_paths(self.tables.edges, self._reached, targets)
        return graph.paths_to(self.tables.edges, self.tables.roots, targets)

    @property
    def sizes(self) -> DataFrame:
        """The dominator tree without preorder numbers."""
        if self._found is None:
            self._found = graph.retained(self.tables, self.net, self.live)
        return self._found[0]

    @property
    def tree(self) -> DataFrame:
        if self._tree is None:
            self._tree = graph.numbered(self.sizes, self._found[1], self.net.parts)
        return self._tree
