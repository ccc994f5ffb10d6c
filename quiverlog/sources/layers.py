"""A keyed table as a base and the changes since: small changes never rewrite the base."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame

from quiverlog.sources.shared import cut

#: Changes are merged into the base when they are more than this and more than a tenth of it.
FEW_CHANGES = 100_000
#: Tables of changes that lie over each other before they are written as one.
MOST_STACKED = 4


def over(rows: DataFrame, layer: DataFrame, keys: list[str], many: bool = False) -> DataFrame:
    """``rows`` with those of ``layer`` in place of rows with equal keys; Spark broadcasts the layer's keys unless they are ``many``.

    Spark guesses the size of a written table from its compressed files: of many like keys a small part of what a broadcast takes.
    """
    own = layer.select(*keys)
    return rows.join(own.hint("merge") if many else own, keys, "left_anti").select(*layer.columns).unionByName(layer)


class Layers:
    """Rows told apart by ``keys``. ``put`` writes the changes; the base is rewritten once for many of them, so a row's cost is bounded."""

    def __init__(self, base: DataFrame, keys: list[str], tag: str):
        self.base, self.keys, self.tag = base, keys, tag
        self.changes: DataFrame | None = None
        self._many = self._stacked = 0
        self._base_rows: int | None = None

    def copy(self) -> Layers:
        return copy.copy(self)

    def rows(self) -> DataFrame:
        return self.base if self.changes is None else over(self.base, self.changes, self.keys, self._many > FEW_CHANGES)

    def put(self, fresh: DataFrame) -> None:
        """Lay ``fresh`` over what is there: a written or local table with distinct keys."""
        own = fresh.count()
        self._many += own
        changes = fresh if self.changes is None else over(self.changes, fresh, self.keys, own > FEW_CHANGES)
        self._stacked += self.changes is not None
        if self._many > FEW_CHANGES:
            if self._base_rows is None:
                self._base_rows = self.base.count()
            if 10 * self._many > self._base_rows and self._base_rows:
                self.base, self.changes = cut(over(self.base, changes, self.keys, True), self.tag), None
                self._base_rows, self._many, self._stacked = None, 0, 0
                return
        if self._stacked >= MOST_STACKED:
            changes, self._stacked = cut(changes, f"{self.tag}-changes"), 0
        self.changes = changes

    def compact(self) -> None:
        """Rewrite the base with all changes in it."""
        if self.changes is not None:
            self.base, self.changes = cut(self.rows(), self.tag), None
            self._base_rows, self._many, self._stacked = None, 0, 0
