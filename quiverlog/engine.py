"""Entry points: a program in, a DataFrame of strings out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlog.errors import DatatypeMismatchError, InvalidParameterError, PrivilegeError
from quiverlog.functions.identity import check_roles, with_compound_edges
from quiverlog.operators.assertions import compile_assertions
from quiverlog.operators.conjunction import View, conjunction
from quiverlog.operators.fixpoint import derive
from quiverlog.operators.policy import policy_view
from quiverlog.plans.parser import parse
from quiverlog.plans.rules import built_in_rules, called, plan_predicates
from quiverlog.plans.terms import EdgeAtom, Program, variables
from quiverlog.sources.edge_cache import EdgeCache, HeldEdges
from quiverlog.sources.store import GraphStore


class Engine:
    """Evaluates programs over a store.

    ``principal`` is the session's principal: if set, ``query`` sees only what it may read. Options, all off by default:
    ``small_graphs`` lets recursion over few edges run in memory on the driver; ``cache_rows`` keeps the edges of a program's predicates on the
    executors if there are at most so many; ``held_rows`` answers single edge atoms from a snapshot on the driver if the store
    has at most so many live edges. Results are the same with any of them.
    """

    def __init__(self, store: GraphStore, principal: str | None = None, small_graphs: bool = False, cache_rows: int = 0, held_rows: int = 0):
        self.store, self.principal, self.small_graphs = store, principal or None, small_graphs
        self._cache, self._held = EdgeCache(cache_rows), HeldEdges(held_rows)

    def query(self, program: str, columns: Sequence[str] | None = None) -> DataFrame | None:
        return self._run(program, columns, self.principal, True)

    def query_as(self, principal: str, program: str, columns: Sequence[str] | None = None) -> DataFrame | None:
        return self._run(program, columns, self._required(principal), True)

    def read_as(self, principal: str, program: str, columns: Sequence[str] | None = None) -> DataFrame | None:
        """As ``query_as``, for programs without assertions."""
        return self._run(program, columns, self._required(principal), False)

    @staticmethod
    def _required(principal: str) -> str:
        if not principal:
            raise InvalidParameterError("a principal is required")
        return principal

    def _run(self, text: str, columns: Sequence[str] | None, principal: str | None, writable: bool) -> DataFrame | None:
        program = parse(text)
        if program.assertions and not writable:
            raise PrivilegeError("this call is read-only: the program has assertions")
        if program.query is not None:
            if not program.outputs:
                raise InvalidParameterError("the query projects no variables")
            if columns is not None and len(columns) != len(program.outputs):
                raise DatatypeMismatchError(f"{len(columns)} columns are declared, the query projects {len(program.outputs)}")
        # a call changes all or nothing: it works on a branch, which the store takes over when the answer stands
        store = self.store.branch()
        if program.assertions:
            store.insert(compile_assertions(program, store))
        answer = None if program.query is None else self._answer(program, store, principal, columns)
        self.store.adopt(store)
        return answer

    def _answer(self, program: Program, store: GraphStore, principal: str | None, columns: Sequence[str] | None) -> DataFrame:
        query = program.query
        rules = program.rules + built_in_rules()
        if principal:
            view = policy_view(store.live(), principal)
        else:
            if len(query) == 1 and isinstance(query[0], EdgeAtom):
                held = self._held.answer(store, query[0])
                if held is not None:
                    return held.toDF(*(columns or program.outputs))
            view = View(self._cache.edges(store, plan_predicates(rules, query)))
        if called(query):
            view = View(view.edges, view.flagged, view.compound_grants, derive(rules, query, view, self.small_graphs))
        frame, names = conjunction(query, view)
        wanted = [names[v] for v in variables(query) if not v.hidden]
        # bindings are a set over all variables; hiding some keeps their number, as the language wants
        return frame.select(*wanted).toDF(*(columns or program.outputs))

    def register(self, name: str, program: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The answer as a temporary view, for SQL around it."""
        answer = self.query(program, columns)
        answer.createOrReplaceTempView(name)
        return answer

    def project_compound_edges(self, kind: str, rows: DataFrame, role_columns: Mapping[str, str]) -> DataFrame:
        """cid, role and value of the compound that each row makes; ``role_columns`` (role to column) must name the declared roles of ``kind``.

        A row with a null in one of them makes none. Nothing is asserted.
        """
        check_roles(kind, self.store.declared_roles({kind}).get(kind, set()), list(role_columns))
        found = with_compound_edges(rows, kind, {role: F.col(f"`{column}`").cast("string") for role, column in role_columns.items()}, [])
        return found.select(F.explode("edges").alias("e")).select(F.col("e.subject").alias("cid"), F.col("e.predicate").alias("role"), F.col("e.object").alias("value"))
