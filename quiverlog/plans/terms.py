"""Programs as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lit:
    value: str


@dataclass(frozen=True)
class Var:
    name: str
    hidden: bool = False


Term = Lit | Var


@dataclass(frozen=True)
class EdgeAtom:
    terms: tuple[Term, Term, Term]


@dataclass(frozen=True)
class PredicateAtom:
    name: str
    terms: tuple[Term, ...]

    @property
    def key(self) -> tuple[str, int]:
        return self.name, len(self.terms)


@dataclass(frozen=True)
class CompoundAtom:
    kind: str
    cid: Term
    roles: tuple[tuple[str, Term], ...]

    @property
    def terms(self) -> tuple[Term, ...]:
        return (self.cid, *(t for _, t in self.roles))


Atom = EdgeAtom | PredicateAtom | CompoundAtom


@dataclass(frozen=True)
class Rule:
    head: PredicateAtom
    body: tuple[Atom, ...]


@dataclass(frozen=True)
class Program:
    assertions: tuple[tuple[Atom, ...], ...]
    rules: tuple[Rule, ...]
    query: tuple[Atom, ...] | None

    @property
    def outputs(self) -> tuple[str, ...]:
        """Named variables of the query in order of first appearance."""
        return tuple(v.name for v in variables(self.query or ()) if not v.hidden)


def variables(atoms) -> list[Var]:
    return list(dict.fromkeys(t for a in atoms for t in a.terms if isinstance(t, Var)))
