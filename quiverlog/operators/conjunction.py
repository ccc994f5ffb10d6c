"""Atoms and conjunctions as DataFrames: one column for each variable, named by its number."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlog.functions.identity import compound_prefix
from quiverlog.plans.terms import Atom, CompoundAtom, EdgeAtom, Lit, PredicateAtom, Term, Var, variables
from quiverlog.sources.shared import local_table


@dataclass
class View:
    """What a call may see. Without a policy all edges and compounds."""

    edges: DataFrame
    #: for a policy: edges with a flag ``seen``
    flagged: DataFrame | None = None
    #: for a policy: whether the compounds of a type are all granted, and the granted cids
    compound_grants: object = None
    facts: dict[tuple[str, int], DataFrame] = field(default_factory=dict)

    def visible_edges(self) -> DataFrame:
        return self.edges if self.flagged is None else self.flagged.filter("seen").select("subject", "predicate", "object")


def _bind(df: DataFrame, columns: list[tuple[str, Term]], names: dict[Var, str], extra: list[str] = ()) -> DataFrame:
    """Filter by constants and repeated variables, keep one column for each variable."""
    first: dict[Var, str] = {}
    conditions: list[Column] = []
    for column, term in columns:
        if isinstance(term, Lit):
            conditions.append(F.col(column) == term.value)
        elif term in first:
            conditions.append(F.col(column) == F.col(first[term]))
        else:
            first[term] = column
    for c in conditions:
        df = df.filter(c)
    return df.select(*(F.col(c).alias(names[v]) for v, c in first.items()), *extra)


def _compound(atom: CompoundAtom, names: dict[Var, str], view: View) -> DataFrame:
    """Role edges with one subject, together: constant roles narrow the subjects first, all other roles come from one scan and one shuffle.

    A role with several objects gives a row for each; under a policy visibility is decided by compound.
    """
    policy = view.flagged is not None
    source = view.flagged if policy else view.edges
    typed = source.filter(F.col("subject").startswith(compound_prefix(atom.kind)))
    if isinstance(atom.cid, Lit):
        typed = typed.filter(F.col("subject") == atom.cid.value)
    constant = [(i, r, t) for i, (r, t) in enumerate(atom.roles) if isinstance(t, Lit)]
    free = [(i, r, t) for i, (r, t) in enumerate(atom.roles) if isinstance(t, Var)]
    columns = [("subject", atom.cid), *((f"r{i}", t) for i, _, t in free)]
    joined = None
    for i, role, term in constant:
        part = typed.filter((F.col("predicate") == role) & (F.col("object") == term.value)).select("subject", *([F.col("seen").alias(f"s{i}")] if policy else []))
        joined = part if joined is None else joined.join(part, "subject")
    seen = ["seen"] if policy else []
    if len(free) == 1:
        i, role, _ = free[0]
        part = typed.filter(F.col("predicate") == role).select("subject", F.col("object").alias(f"r{i}"), *(F.col("seen").alias(f"s{i}") for _ in seen))
        joined = part if joined is None else joined.join(part, "subject")
    elif free:
        wanted = typed.filter(F.col("predicate").isin(sorted({r for _, r, _ in free})))
        if joined is not None:
            wanted = wanted.join(joined.select("subject"), "subject", "left_semi")
        # edges are a set, so a list of a role's objects is one too
        lists = [F.collect_list(F.when(F.col("predicate") == r, F.struct("object", *seen))).alias(f"l{i}") for i, r, _ in free]
        together = wanted.groupBy("subject").agg(*lists)
        for i, _, _ in free:
            together = together.filter(F.size(f"l{i}") > 0)
        for i, _, _ in free:
            together = together.withColumn(f"l{i}", F.explode(f"l{i}"))
        together = together.select("subject", *(F.col(f"l{i}.object").alias(f"r{i}") for i, _, _ in free), *(F.col(f"l{i}.seen").alias(f"s{i}") for i, _, _ in free for _ in seen))
        joined = together if joined is None else joined.join(together, "subject")
    if policy:
        joined = view.compound_grants(atom.kind, joined, [f"s{i}" for i in range(len(atom.roles))])
    return _bind(joined, columns, names)


def atom_frame(atom: Atom, names: dict[Var, str], view: View) -> DataFrame:
    if isinstance(atom, EdgeAtom):
        return _bind(view.visible_edges(), list(zip(("subject", "predicate", "object"), atom.terms)), names)
    if isinstance(atom, CompoundAtom):
        return _compound(atom, names, view)
    known = view.facts.get(atom.key)
    if known is None:
        known = local_table(view.edges.sparkSession, [], [f"_{i}" for i in range(len(atom.terms))])
    return _bind(known, [(f"_{i}", t) for i, t in enumerate(atom.terms)], names)


def join_order(atoms: tuple[Atom, ...], first: int | None = None) -> list[int]:
    """Constants first, then what shares variables with the atoms before: a cross product only where the program has one.

    Of edges that share as much, one that is met by its subject comes before one that is met by its object only: a subject has few
    objects of a predicate, but an object such as a nation or a status any number of subjects, and two such edges joined by it
    make all pairs of these. A cycle of edges so becomes a walk along subjects whose last edge tests both its ends.
    """
    left = list(range(len(atoms)))
    order: list[int] = []
    seen: set[Var] = set()
    while left:

        def cost(i: int):
            atom = atoms[i]
            own = set(variables([atom]))
            constants = sum(isinstance(t, Lit) for t in atom.terms)
            by_object = isinstance(atom, EdgeAtom) and bool(own & seen) and atom.terms[0] not in seen
            return (i != first if not order else bool(seen) and bool(own) and not own & seen, -len(own & seen), -constants, by_object, isinstance(atom, PredicateAtom), i)

        best = min(left, key=cost)
        order.append(best)
        seen |= set(variables([atoms[best]]))
        left.remove(best)
    return order


def conjunction(atoms: tuple[Atom, ...], view: View, override: dict[int, DataFrame] | None = None) -> tuple[DataFrame, dict[Var, str]]:
    """All bindings of ``atoms``, over hidden variables too. Each atom is a set, so their natural join is one: no DISTINCT is needed.

    ``override`` replaces the facts of single atoms, as the delta of a recursive rule does.
    """
    names = {v: f"v{i}" for i, v in enumerate(variables(atoms))}
    override = override or {}
    result: DataFrame | None = None
    for i in join_order(atoms, next(iter(override), None)):
        atom = atoms[i]
        local = View(view.edges, view.flagged, view.compound_grants, view.facts | {atom.key: override[i]}) if i in override else view
        frame = atom_frame(atom, names, local)
        if not frame.columns:  # an atom without variables is a test
            frame = frame.select(F.lit(1).alias("hit")).limit(1)
            result = frame if result is None else result.crossJoin(F.broadcast(frame)).drop("hit")
            continue
        if result is None:
            result = frame
            continue
        if result.columns == ["hit"]:
            result = frame.crossJoin(F.broadcast(result)).drop("hit")
            continue
        shared = [c for c in frame.columns if c in result.columns]
        result = result.join(frame, shared) if shared else result.crossJoin(frame)
    return result, names


def project(frame: DataFrame, names: dict[Var, str], terms: tuple[Term, ...]) -> DataFrame:
    """Head of a rule: variables and constants, columns _0, _1, ..."""
    return frame.select(*((F.lit(t.value) if isinstance(t, Lit) else F.col(names[t])).cast("string").alias(f"_{i}") for i, t in enumerate(terms)))
