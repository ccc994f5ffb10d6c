"""The triple store: live edges as a DataFrame, a base with changes over it."""

from __future__ import annotations

import copy
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlog.errors import InvalidParameterError, ProgramLimitError
from quiverlog.sources.layers import Layers, over
from quiverlog.sources.shared import cut, file_system, local_table

KEYS = ["subject", "predicate", "object"]
EDGES = "subject string, predicate string, object string"
RECORDS = EDGES + ", is_deleted boolean, tx_id long"

#: Names of the schema and policy relations.
TYPE, CARDINALITY = "liquid/type", "liquid/cardinality"
SUBJECT_META, OBJECT_META = "liquid/subject_meta", "liquid/object_meta"
COMPOUND_PREDICATE, MUTABLE = "liquid/compound_predicate", "liquid/mutable"
NODE, STRING = "liquid/node", "liquid/string"
#: Policy compounds of a fresh store, and the types of their roles.
POLICY_COMPOUNDS = {
    "ReadPredicate": {"principal": STRING, "predicate": NODE},
    "ReadCompound": {"principal": STRING, "compound_type": NODE},
    "ReadTriple": {"principal": STRING, "user": STRING, "subject": NODE, "predicate": NODE, "object": NODE},
    "PredicateReadBySubject": {"predicate": NODE, "relation": NODE},
    "PredicateReadByObject": {"predicate": NODE, "relation": NODE},
    "CompoundReadByRole": {"compound_type": NODE, "role": NODE},
    "Principal": {"id": STRING, "kind": STRING},
}

#: Asserted edges that the driver holds before they are written.
MOST_HELD = 50_000
#: Roles of the types named in one program.
MOST_ROLES = 10_000


def predicate_edges(name: str, subject_cardinality: str, subject_type: str, object_cardinality: str, object_type: str) -> list[tuple[str, str, str]]:
    """The eight edges that declare a predicate."""
    from quiverlog.functions.identity import compound_identity

    out = []
    for kind, role, cardinality, of in (("Smeta", SUBJECT_META, subject_cardinality, subject_type), ("Ometa", OBJECT_META, object_cardinality, object_type)):
        cid = compound_identity(kind, {role: name})
        out += [(cid, role, name), (name, role, cid), (cid, TYPE, of), (cid, CARDINALITY, cardinality)]
    return out


def compound_role_edges(kind: str, role: str, cardinality: str, of: str) -> list[tuple[str, str, str]]:
    return [*predicate_edges(role, "1", NODE, cardinality, of), (kind, COMPOUND_PREDICATE, role)]


def bootstrap_edges() -> list[tuple[str, str, str]]:
    """What a fresh store holds: the two meta compounds and the policy compounds."""
    out = []
    for kind, role in (("Smeta", SUBJECT_META), ("Ometa", OBJECT_META)):
        out += [(kind, COMPOUND_PREDICATE, role), (kind, MUTABLE, "false")]
    for kind, roles in POLICY_COMPOUNDS.items():
        for role, of in roles.items():
            out += compound_role_edges(kind, role, "0", of)
        out.append((kind, MUTABLE, "false"))
    return list(dict.fromkeys(out))


class GraphStore:
    """Set of edges with tombstones: a base and the changes since over it. DataFrames taken before a change keep what they had.

    What programs assert stays with the driver until it is much; changes that come as DataFrames are written once, beside the base.
    """

    def __init__(self, spark: SparkSession, edges: DataFrame | None = None, bootstrap: bool = True):
        base = local_table(spark, bootstrap_edges() if bootstrap else [], KEYS)
        if edges is not None:
            # equal edges become one here; the only shuffle that building a store needs
            base = edges.select(*(F.col(k).cast("string").alias(k) for k in KEYS)).dropna().unionByName(base).distinct()
        self._begin(spark, self._as_records(base, False, 0), 0)

    @staticmethod
    def _as_records(edges: DataFrame, deleted: bool, tx: int) -> DataFrame:
        return edges.select(*KEYS, F.lit(deleted).alias("is_deleted"), F.lit(tx).cast("long").alias("tx_id"))

    def _begin(self, spark: SparkSession, records: DataFrame, tx: int) -> None:
        self.spark, self.tx = spark, tx
        #: a new object after each change: what was derived from the edges before it is out of date
        self.version = object()
        self._layers = Layers(records, KEYS, "records")
        self._held: dict[tuple[str, str, str], tuple[bool, int]] = {}
        self._records: DataFrame | None = None
        self._live: DataFrame | None = None

    @classmethod
    def of_set(cls, spark: SparkSession, edges: DataFrame) -> GraphStore:
        """A store over edges that are known to be distinct and free of nulls, as a mapping from keyed tables gives: no shuffle."""
        store = cls(spark, bootstrap=True)
        store._begin(spark, cls._as_records(edges, False, 0).unionByName(store._layers.base), 0)
        return store

    def branch(self) -> GraphStore:
        """The same store, to be changed apart; ``adopt`` takes the changes over. Neither copies or writes an edge."""
        other = copy.copy(self)
        other._layers, other._held = self._layers.copy(), dict(self._held)
        return other

    def adopt(self, other: GraphStore) -> None:
        self.__dict__.update(other.__dict__)

    def _held_table(self) -> DataFrame:
        columns = list(zip(*((*edge, *state) for edge, state in self._held.items()))) or [()] * 5
        kinds = [pa.string()] * 3 + [pa.bool_(), pa.int64()]
        return self.spark.createDataFrame(pa.table({n: pa.array(c, k) for n, c, k in zip([*KEYS, "is_deleted", "tx_id"], columns, kinds)}))

    @property
    def records(self) -> DataFrame:
        if self._records is None:
            rows = self._layers.rows()
            self._records = over(rows, self._held_table(), KEYS) if self._held else rows
        return self._records

    def live(self) -> DataFrame:
        if self._live is None:
            self._live = self.records.filter(~F.col("is_deleted")).select(*KEYS)
        return self._live

    def _changed(self) -> None:
        self.version = object()
        self._records = self._live = None

    def _put(self, fresh: DataFrame) -> None:
        if self._held:
            self._layers.put(over(self._held_table(), fresh, KEYS))
            self._held = {}
        else:
            self._layers.put(fresh)
        self._changed()

    def compact(self) -> None:
        """Rewrite the base with all changes in it."""
        if self._held:
            self._layers.put(self._held_table())
            self._held = {}
        self._layers.compact()
        self._changed()

    def insert(self, edges: Iterable[tuple[str, str, str]] | DataFrame) -> None:
        """Make edges live: new ones appear, live ones stay, tombstoned ones come back."""
        if isinstance(edges, DataFrame):
            self.tx += 1
            self._put(cut(self._as_records(edges.select(*KEYS).dropna().distinct(), False, self.tx), "inserted"))
        elif batch := list(dict.fromkeys(edges)):
            # a program's own edges are as many as its text holds
            self.tx += 1
            self._held |= dict.fromkeys(batch, (False, self.tx))
            self._changed()
            if len(self._held) > MOST_HELD:
                held, self._held = self._held_table(), {}
                self._put(held)

    def tombstone(self, edges: Iterable[tuple[str, str, str]] | DataFrame) -> None:
        """Hide edges; unknown ones are ignored."""
        self.tx += 1
        gone = edges.select(*KEYS).distinct() if isinstance(edges, DataFrame) else local_table(self.spark, list(dict.fromkeys(edges)), KEYS)
        # the live edges are the side that streams, so that few keys are broadcast to them
        self._put(cut(self._as_records(self.live().join(gone, KEYS, "left_semi"), True, self.tx), "hidden"))

    def declared_roles(self, kinds: set[str]) -> dict[str, set[str]]:
        """Roles of compound types: a handful of rows for each type named in a program; more than MOST_ROLES are an error."""
        found: dict[str, set[str]] = {}
        if kinds:
            declared = self.live().filter((F.col("predicate") == COMPOUND_PREDICATE) & F.col("subject").isin(sorted(kinds)))
            rows = declared.select("subject", "object").limit(MOST_ROLES + 1).collect()
            if len(rows) > MOST_ROLES:
                raise ProgramLimitError(f"more than {MOST_ROLES} roles are declared for {', '.join(sorted(kinds))}")
            for r in rows:
                found.setdefault(r["subject"], set()).add(r["object"])
        return found

    def save(self, path: str, normalizers=None) -> str:
        """Write a new version beside the old ones, with the registrations and ledger of ``normalizers``; the path of the version.

        Nothing is overwritten: ``state`` is written last, and only versions with a whole ``state`` count, so a crash leaves the version
        before. Records are sorted by predicate, so that scans of one predicate skip files.
        """
        number = max([0, *(n for n, _ in _versions(self.spark, path))]) + 1
        version = f"{path.rstrip('/')}/v{number:08d}"
        self.records.repartitionByRange("predicate", "subject").sortWithinPartitions("predicate", "subject").write.mode("overwrite").parquet(f"{version}/records")
        if normalizers is not None:
            normalizers.write(version)
        self.spark.createDataFrame([(self.tx,)], "tx_id long").coalesce(1).write.mode("overwrite").parquet(f"{version}/state")
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphStore:
        """The newest whole version."""
        version = newest_version(spark, path)
        store = cls.__new__(cls)
        store._begin(spark, spark.read.schema(RECORDS).parquet(f"{version}/records"), spark.read.parquet(f"{version}/state").first()["tx_id"])
        return store


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Numbers of the versions under a path, and whether each is whole."""
    system, target = file_system(spark, path)
    if not system.exists(target):
        return []
    names = [s.getPath().getName() for s in system.listStatus(target)]
    child = lambda *parts: spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))
    return [(int(n[1:]), system.exists(child(n, "state", "_SUCCESS"))) for n in names if n[0] == "v" and n[1:].isdigit()]


def newest_version(spark: SparkSession, path: str) -> str:
    whole = [n for n, good in _versions(spark, path) if good]
    if not whole:
        raise InvalidParameterError(f"{path} holds no saved store")
    return f"{path.rstrip('/')}/v{max(whole):08d}"
