"""Edges of a program's predicates, scanned once; and an optional snapshot for single atoms."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlog.plans.terms import EdgeAtom, Lit, variables
from quiverlog.sources.shared import local_table
from quiverlog.sources.store import GraphStore

#: Predicates that are pushed down as one filter; beyond, each atom's own filter does.
MOST_PREDICATES = 200


class EdgeCache:
    """Live edges narrowed to a plan's predicates, kept on the executors if they are at most ``most_rows`` (0: never kept)."""

    def __init__(self, most_rows: int):
        self.most_rows = most_rows
        self._state: object | None = None
        self._kept: dict[frozenset[str], DataFrame] = {}

    def edges(self, store: GraphStore, predicates: frozenset[str] | None) -> DataFrame:
        """The edges that a plan can read; ``predicates`` None: all. What was kept goes when the store has changed."""
        live = store.live()
        if not self.most_rows or predicates is None or len(predicates) > MOST_PREDICATES:
            return live
        if self._state is not store.version:
            self.clear()
            self._state = store.version
        if predicates not in self._kept:
            found = live.filter(F.col("predicate").isin(sorted(predicates))) if predicates else live.limit(0)
            if found.limit(self.most_rows + 1).count() <= self.most_rows:
                found = found.persist(StorageLevel.MEMORY_AND_DISK)
            self._kept[predicates] = found
        return self._kept[predicates]

    def clear(self) -> None:
        for frame in self._kept.values():
            frame.unpersist()
        self._kept.clear()


class HeldEdges:
    """All live edges on the driver, indexed by subject and by predicate, if they are at most ``most_rows`` (0: never)."""

    def __init__(self, most_rows: int):
        self.most_rows = most_rows
        self._state: object | None = None
        self._index: dict[tuple[int, str], list[tuple]] | None = None
        self._rows: list[tuple] = []

    def _refresh(self, store: GraphStore) -> None:
        if self._state is store.version:
            return
        self._state, self._index = store.version, None
        rows = store.live().limit(self.most_rows + 1).collect()
        if len(rows) <= self.most_rows:
            self._rows, self._index = [tuple(r) for r in rows], {}
            for row in self._rows:
                for place in range(3):
                    self._index.setdefault((place, row[place]), []).append(row)

    def answer(self, store: GraphStore, atom: EdgeAtom) -> DataFrame | None:
        """Bindings of the atom's named variables in their order, or None where no snapshot is held."""
        if not self.most_rows:
            return None
        self._refresh(store)
        if self._index is None:
            return None
        bound = [(i, t.value) for i, t in enumerate(atom.terms) if isinstance(t, Lit)]
        rows = min((self._index.get(b, []) for b in bound), key=len, default=self._rows)
        names = variables([atom])
        places = [[i for i, t in enumerate(atom.terms) if t == v] for v in names]
        good = [r for r in rows if all(r[i] == x for i, x in bound) and all(len({r[i] for i in p}) == 1 for p in places)]
        shown = [p[0] for v, p in zip(names, places) if not v.hidden]
        return local_table(store.spark, [tuple(r[i] for i in shown) for r in good], [f"c{k}" for k in range(len(shown))])
