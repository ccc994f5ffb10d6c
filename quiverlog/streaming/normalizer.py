"""Row normalizers: rows of a table become compounds, kept in step by a ledger of which row supports which edges."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlog.errors import NormalizerError
from quiverlog.functions.identity import with_compound_edges
from quiverlog.sources.layers import Layers
from quiverlog.sources.shared import cut, local_table
from quiverlog.sources.store import KEYS, GraphStore, newest_version

ROW = ["source", "normalizer", "row_key"]
_EDGES = "array<struct<subject:string,predicate:string,object:string>>"
LEDGER = f"source string, normalizer string, row_key string, edges {_EDGES}"
REGISTRATIONS = "source string, name string, kind string, role_columns map<string,string>, key_columns array<string>"


@dataclass(frozen=True)
class Registration:
    source: str
    name: str
    kind: str
    role_columns: tuple[tuple[str, str], ...]
    key_columns: tuple[str, ...]

    def rows(self, rows: DataFrame) -> DataFrame:
        """Ledger rows of a table's rows; a row with a null in a mapped column has null edges."""
        roles = {role: F.col(f"`{column}`").cast("string") for role, column in self.role_columns}
        key = F.to_json(F.struct(*(F.col(f"`{c}`") for c in self.key_columns)), {"ignoreNullFields": "false"})
        own = with_compound_edges(rows, self.kind, roles, [F.lit(self.source).alias("source"), F.lit(self.name).alias("normalizer"), key.alias("row_key")])
        return own.withColumn("edges", F.col("edges").cast(_EDGES))


def _edges(rows: DataFrame, column) -> DataFrame:
    return rows.select(F.explode(column).alias("e")).select("e.*").distinct()


class Normalizers:
    """Registrations and the ledger over one store. The ledger has one row for each source row, with the edges it supports."""

    def __init__(self, store: GraphStore):
        self.store = store
        self.registrations: dict[tuple[str, str], Registration] = {}
        self._layers = Layers(local_table(store.spark, [], [*ROW, "edges"]).select(*ROW, F.lit(None).cast(_EDGES).alias("edges")), ROW, "ledger")

    @property
    def rows(self) -> DataFrame:
        """Ledger rows that support edges."""
        return self._layers.rows().filter("edges is not null")

    @property
    def ledger(self) -> DataFrame:
        """One row for each edge that a source row supports."""
        return self.rows.select(*ROW, F.explode("edges").alias("e")).select(*ROW, "e.*")

    def create(self, source: str, rows: DataFrame, name: str, kind: str, role_columns: Mapping[str, str], key_columns: Sequence[str], backfill: bool = True) -> None:
        """Register ``role_columns`` (role to column) of a table with declared key columns, which tell its rows apart."""
        if not isinstance(role_columns, Mapping):
            raise NormalizerError("role columns must be a mapping of roles to columns")
        if not isinstance(rows, DataFrame):
            raise NormalizerError(f"{source} is not a table")
        if not key_columns:
            raise NormalizerError(f"{source} has no primary key")
        declared = self.store.declared_roles({kind}).get(kind, set())
        if not declared:
            raise NormalizerError(f"compound type {kind} has no declared roles")
        if set(role_columns) != declared:
            raise NormalizerError(f"role columns must cover the roles of {kind} exactly: {', '.join(sorted(declared))}")
        for column in [*role_columns.values(), *key_columns]:
            if column not in rows.columns:
                raise NormalizerError(f"column {column} does not exist in {source}")
        if (source, name) in self.registrations:
            raise NormalizerError(f"normalizer {name} already exists on {source}")
        registration = Registration(source, name, kind, tuple(sorted(role_columns.items())), tuple(key_columns))
        self.registrations[(source, name)] = registration
        if backfill:
            self._project(registration, rows)

    def _known(self, source: str, name: str) -> Registration:
        if (source, name) not in self.registrations:
            raise NormalizerError(f"unknown normalizer {name} on {source}")
        return self.registrations[(source, name)]

    def _project(self, r: Registration, rows: DataFrame) -> None:
        """Ledger rows and edges of rows whose keys the ledger does not hold."""
        fresh = cut(r.rows(rows).filter("edges is not null"), "projected")
        self._layers.put(fresh)
        self.store.insert(_edges(fresh, F.col("edges")))

    def _replace(self, r: Registration, change: DataFrame, inserts: bool = True, insert_all: bool = False) -> None:
        """Give rows new edges (null: none): ``change`` has distinct keys. New edges appear before old ones go.

        The ledger is read for the changed keys only, and once more for the edges that vanish: an edge goes when no row of any
        normalizer of its compound type supports it any more.
        """
        before = self._own(r).join(change.select("row_key"), "row_key", "left_semi").groupBy("row_key").agg(F.flatten(F.collect_list("edges")).alias("old"))
        moved = change.join(before, "row_key", "left")
        moved = cut((moved if insert_all else moved.filter(~F.col("edges").eqNullSafe(F.col("old")))).select(*ROW, "edges", "old"), "moved")
        none = F.array().cast(_EDGES)
        new, old = F.coalesce("edges", none), F.coalesce("old", none)
        self._layers.put(moved.select(*ROW, "edges"))
        if inserts:
            self.store.insert(_edges(moved, new if insert_all else F.array_except(new, old)))
        self._withdraw(_edges(moved, F.array_except(old, new)), [x.name for x in self.registrations.values() if x.kind == r.kind])

    def _withdraw(self, gone: DataFrame, kinds: list[str]) -> None:
        """Hide the edges that no ledger row of the normalizers ``kinds`` supports."""
        if kinds:
            held = self.rows.filter(F.col("normalizer").isin(kinds)).select(F.explode("edges").alias("e")).select("e.*")
            # the ledger streams past the edges that vanish: Spark broadcasts them while they are few
            gone = gone.join(held.join(gone, KEYS, "left_semi"), KEYS, "left_anti")
        self.store.tombstone(gone)

    def apply_changes(self, source: str, old: DataFrame | None, new: DataFrame | None) -> None:
        """Rows before and after: inserts have no old rows, deletes no new ones. Rows are told apart by their keys."""
        for r in [r for r in self.registrations.values() if r.source == source]:
            parts = []
            if old is not None:
                parts.append(r.rows(old).withColumn("edges", F.lit(None).cast(_EDGES)))
            if new is not None:
                parts.append(r.rows(new))
            if parts:
                change = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
                # max passes over null: the new edges of a row that is in both
                self._replace(r, change.groupBy(*ROW).agg(F.max("edges").alias("edges")), new is not None)

    def rebuild(self, source: str, name: str, rows: DataFrame) -> None:
        """Project all rows anew; brings back edges that were hidden by hand."""
        r = self._known(source, name)
        change = self._own(r).select(*ROW, F.lit(None).cast(_EDGES).alias("edges")).unionByName(r.rows(rows))
        self._replace(r, change.groupBy(*ROW).agg(F.max("edges").alias("edges")), insert_all=True)

    def drop(self, source: str, name: str, purge: bool = True) -> None:
        """Forget a normalizer. Without ``purge`` its edges stay, owned by none."""
        r = self._known(source, name)
        # all its rows go, so their edges are what the ledger holds: no keys are gathered to look them up
        dropped = cut(self._own(r).select(*ROW, *(["edges"] if purge else [])), "dropped")
        self._layers.put(dropped.select(*ROW, F.lit(None).cast(_EDGES).alias("edges")))
        if purge:
            self._withdraw(_edges(dropped, F.col("edges")), [x.name for x in self.registrations.values() if x.kind == r.kind and x is not r])
        del self.registrations[(source, name)]

    def _own(self, r: Registration) -> DataFrame:
        return self.rows.filter((F.col("source") == r.source) & (F.col("normalizer") == r.name))

    def change_sink(self, source: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: rows with ``before`` and ``after`` structs, null where there is none.

        A micro-batch holds at most one change of a row; a repeated batch changes nothing more, since it gives rows the same edges.
        """

        def apply(batch: DataFrame, _: int) -> None:
            batch = cut(batch.select("before", "after"), "changes")
            self.apply_changes(source, batch.filter("before is not null").select("before.*"), batch.filter("after is not null").select("after.*"))

        return apply

    def write(self, version: str) -> None:
        """Registrations and ledger into a version of a saved store (see ``GraphStore.save``)."""
        known = [(r.source, r.name, r.kind, dict(r.role_columns), list(r.key_columns)) for r in self.registrations.values()]
        self.store.spark.createDataFrame(known, REGISTRATIONS).coalesce(1).write.mode("overwrite").parquet(f"{version}/registrations")
        self.rows.repartitionByRange("source", "normalizer", "row_key").write.mode("overwrite").parquet(f"{version}/ledger")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Normalizers:
        """The newest version's store and what ``write`` put beside it: after a restart changes go on where they were."""
        found, version = cls(GraphStore.load(spark, path)), newest_version(spark, path)
        for r in spark.read.schema(REGISTRATIONS).parquet(f"{version}/registrations").collect():
            found.registrations[(r["source"], r["name"])] = Registration(r["source"], r["name"], r["kind"], tuple(sorted(r["role_columns"].items())), tuple(r["key_columns"]))
        found._layers = Layers(spark.read.schema(LEDGER).parquet(f"{version}/ledger"), ROW, "ledger")
        return found
