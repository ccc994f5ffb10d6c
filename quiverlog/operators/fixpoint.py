"""Rules to facts: unions, closures by squaring, semi-naive rounds, and an optional in-memory evaluator for small inputs."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlog.errors import ProgramLimitError
from quiverlog.operators.conjunction import View, atom_frame, conjunction, project
from quiverlog.plans.rules import Closure, Key, base_is_step, called, closure_shape, strata
from quiverlog.plans.terms import Atom, EdgeAtom, Lit, PredicateAtom, Rule, Var, variables
from quiverlog.sources.shared import Growing, cut, local_table

#: Fixed limit of the language.
MOST_ROUNDS = 10_000
#: With ``small_graphs``, recursion over inputs of at most this many rows runs in memory on the driver, up to so many facts; beyond either, and
#: without that option, distributed.
SMALL_INPUT = 50_000
SMALL_RESULT = 1_000_000


def union(frames: list[DataFrame]) -> DataFrame:
    """Balanced, so that hundreds of branches make a shallow plan."""
    while len(frames) > 1:
        frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])] + (frames[-1:] if len(frames) % 2 else [])
    return frames[0]


def _folded(rules: list[Rule], view: View) -> list[DataFrame]:
    """One frame for each rule; rules that read one edge and differ only in its predicate share a scan."""
    frames: list[DataFrame] = []
    alike: dict[tuple, list[Rule]] = defaultdict(list)
    for rule in rules:
        atom = rule.body[0]
        if len(rule.body) == 1 and isinstance(atom, EdgeAtom) and isinstance(atom.terms[1], Lit):
            number = {v: i for i, v in enumerate(variables([atom]))}
            shape = tuple(t if isinstance(t, Lit) else number[t] for t in (atom.terms[0], atom.terms[2], *rule.head.terms))
            alike[shape].append(rule)
        else:
            frame, names = conjunction(rule.body, view)
            frames.append(project(frame, names, rule.head.terms))
    for group in alike.values():
        first = group[0]
        if len(group) == 1:
            frame, names = conjunction(first.body, view)
        else:
            wanted = sorted({r.body[0].terms[1].value for r in group})
            local = View(view.visible_edges().filter(F.col("predicate").isin(wanted)))
            subject, _, obj = first.body[0].terms
            atom = EdgeAtom((subject, Var("__folded", True), obj))
            names = {v: f"v{i}" for i, v in enumerate(variables([atom]))}
            frame = atom_frame(atom, names, local)
        frames.append(project(frame, names, first.head.terms))
    return frames


def plain_facts(rules: list[Rule], view: View) -> DataFrame:
    return union(_folded(rules, view)).distinct()


# --- in memory ---


class TooLarge(Exception):
    pass


class SmallEvaluator:
    """Semi-naive evaluation of one recursive group over relations held as sets of tuples."""

    def __init__(self, rules: list[Rule], keys: set[Key], relations: dict[int, list[tuple]]):
        self.keys, self.relations, self.indexes = keys, relations, {}
        self.full: dict[Key, set[tuple]] = {k: set() for k in keys}
        self.by_place: dict[tuple[Key, tuple[int, ...]], dict[tuple, list[tuple]]] = {}
        self.rules = rules

    def _matches(self, atom: Atom, binding: dict[Var, str], rows: dict | None):
        """Rows of an atom under a binding, through an index on the bound places."""
        terms = atom.terms if isinstance(atom, PredicateAtom) and atom.key in self.keys else tuple(variables([atom]))
        bound = tuple(i for i, t in enumerate(terms) if isinstance(t, Lit) or t in binding)
        probe = tuple(terms[i].value if isinstance(terms[i], Lit) else binding[terms[i]] for i in bound)
        if rows is not None:
            index = rows.setdefault(bound, _index(rows["rows"], bound))
        elif isinstance(atom, PredicateAtom) and atom.key in self.keys:
            index = self.by_place.setdefault((atom.key, bound), None)
            if index is None:
                index = self.by_place[(atom.key, bound)] = _index(self.full[atom.key], bound)
        else:
            index = self.indexes.get((id(atom), bound))
            if index is None:
                index = self.indexes[(id(atom), bound)] = _index(self.relations[id(atom)], bound)
        for row in index.get(probe, ()):
            extra, good = {}, True
            for t, value in zip(terms, row):
                if isinstance(t, Var) and t not in binding and extra.setdefault(t, value) != value:
                    good = False
                    break
            if good:
                yield extra

    def _solve(self, rule: Rule, delta_at: int | None, delta: dict | None, out: set[tuple]) -> None:
        atoms = list(range(len(rule.body)))
        done = self.full[rule.head.key]

        def go(binding: dict[Var, str], left: list[int]) -> None:
            if not left:
                fact = tuple(t.value if isinstance(t, Lit) else binding[t] for t in rule.head.terms)
                if fact not in done:
                    out.add(fact)
                    if len(out) > SMALL_RESULT:
                        raise TooLarge
                return
            best = left[0] if delta_at in left and left[0] == delta_at else max(left, key=lambda i: (i == delta_at, sum(isinstance(t, Lit) or t in binding for t in rule.body[i].terms)))
            rest = [i for i in left if i != best]
            for extra in self._matches(rule.body[best], binding, delta if best == delta_at else None):
                go(binding | extra, rest)

        go({}, atoms)

    def run(self) -> dict[Key, set[tuple]]:
        delta: dict[Key, set[tuple]] = {k: set() for k in self.keys}
        for rule in self.rules:
            if not any(k in self.keys for k in called(rule.body)):
                self._solve(rule, None, None, delta[rule.head.key])
        for _ in range(MOST_ROUNDS):
            if not any(delta.values()):
                return self.full
            for key, facts in delta.items():
                self.full[key] |= facts
                for (k, bound), index in self.by_place.items():
                    if k == key and index is not None:
                        for f in facts:
                            index.setdefault(tuple(f[i] for i in bound), []).append(f)
            if sum(map(len, self.full.values())) > SMALL_RESULT:
                raise TooLarge
            rows = {k: {"rows": v} for k, v in delta.items()}
            after: dict[Key, set[tuple]] = {k: set() for k in self.keys}
            for rule in self.rules:
                for i, atom in enumerate(rule.body):
                    if isinstance(atom, PredicateAtom) and atom.key in self.keys and delta[atom.key]:
                        self._solve(rule, i, rows[atom.key], after[rule.head.key])
            delta = after
        raise ProgramLimitError(f"recursion did not end within {MOST_ROUNDS} rounds")


def _index(rows, bound: tuple[int, ...]) -> dict[tuple, list[tuple]]:
    index: dict[tuple, list[tuple]] = {}
    for row in rows:
        index.setdefault(tuple(row[i] for i in bound), []).append(row)
    return index


def _small(keys: list[Key], rules: list[Rule], view: View) -> dict[Key, DataFrame] | None:
    """The group's facts by the in-memory evaluator, or None where an input or the result is too large for it."""
    relations, left = {}, SMALL_INPUT
    known: dict[Atom, list[tuple]] = {}
    for rule in rules:
        for atom in rule.body:
            if isinstance(atom, PredicateAtom) and atom.key in keys:
                continue
            if atom not in known:
                names = {v: f"v{i}" for i, v in enumerate(variables([atom]))}
                frame = atom_frame(atom, names, view)
                frame = frame if frame.columns else frame.select(F.lit(1).alias("hit")).limit(1)
                rows = frame.limit(left + 1).collect()
                left -= len(rows)
                if left < 0:
                    return None
                known[atom] = [tuple(r) if names else () for r in rows]
            relations[id(atom)] = known[atom]
    try:
        facts = SmallEvaluator(rules, set(keys), relations).run()
    except (TooLarge, RecursionError):
        return None
    return {key: _as_facts(view.edges.sparkSession, facts[key], key[1]) for key in keys}


def _as_facts(spark: SparkSession, rows, width: int) -> DataFrame:
    return local_table(spark, rows, [f"_{i}" for i in range(width)])


def _reach(after: dict[str, list[str]], starts) -> set[str]:
    seen = set(starts)
    work = list(seen)
    while work:
        for y in after.get(work.pop(), ()):
            if y not in seen:
                seen.add(y)
                work.append(y)
    return seen


def _adjacent(pairs, turned: bool = False) -> dict[str, list[str]]:
    after: dict[str, list[str]] = {}
    for a, b in pairs:
        if turned:
            a, b = b, a
        after.setdefault(a, []).append(b)
    return after


def _small_closure(shape: Closure, view: View, bound: tuple[str, bool] | None) -> DataFrame | None:
    """A closure by breadth-first search from each start, or from the bound end alone; None where it is too large for memory."""
    base = [tuple(r) for r in plain_facts(list(shape.base), view).limit(SMALL_INPUT + 1).collect()]
    alike = not shape.step or base_is_step(shape)
    step = base if alike else [tuple(r) for r in _steps(shape, view).limit(SMALL_INPUT + 1).collect()]
    if max(len(base), len(step)) > SMALL_INPUT:
        return None
    forward = bound is None or bound[1]
    first, then = _adjacent(base, not forward), _adjacent(step, not forward)
    base_first = alike or forward == shape.right
    # from a start: its base edges, then steps; or steps, then a base edge
    starts = [bound[0]] if bound else sorted(set(first) if base_first else set(first) | set(then))
    facts: set[tuple[str, str]] = set()
    for start in starts:
        if base_first:
            ends = _reach(then, first.get(start, ()))
        else:
            ends = {y for x in _reach(then, [start]) for y in first.get(x, ())}
        facts |= {(start, y) if forward else (y, start) for y in ends}
        if len(facts) > SMALL_RESULT:
            return None
    return _as_facts(view.edges.sparkSession, facts, 2)


# --- distributed ---


def _pairs(frame: DataFrame, first: str, second: str) -> DataFrame:
    return frame.select(F.col(first).alias("_0"), F.col(second).alias("_1"))


def _compose(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(F.col("_0"), F.col("_1").alias("m")).join(right.select(F.col("_0").alias("m"), F.col("_1")), "m").select("_0", "_1")


def squared_closure(edges: DataFrame) -> DataFrame:
    """Transitive closure in a logarithm of the longest path: each round composes all known paths with the newest, and writes only new ones."""
    known = Growing(edges.distinct(), "paths")
    full = delta = known.frame()
    for _ in range(MOST_ROUNDS):
        fresh = _compose(full, delta).unionByName(_compose(delta, full)).distinct().join(full, ["_0", "_1"], "left_anti")
        delta = known.add(fresh)
        if delta is None:
            return full
        full = known.frame()
    raise ProgramLimitError(f"recursion did not end within {MOST_ROUNDS} rounds")


def _steps(shape: Closure, view: View) -> DataFrame:
    frames = []
    for atom, first, second in shape.step:
        names = {v: f"v{i}" for i, v in enumerate(variables([atom]))}
        frames.append(_pairs(atom_frame(atom, names, view), names[first], names[second]))
    return union(frames)


def closure_facts(shape: Closure, view: View) -> DataFrame:
    base = plain_facts(list(shape.base), view)
    if not shape.step or base_is_step(shape):
        return squared_closure(base)
    paths = squared_closure(_steps(shape, view))
    more = _compose(base, paths) if shape.right else _compose(paths, base)
    return base.unionByName(more).distinct()


def reachable(shape: Closure, view: View, start: str, forward: bool) -> DataFrame:
    """Facts of one bound end only: breadth first from it, not the whole closure."""
    base = plain_facts(list(shape.base), view)
    step = base if not shape.step or base_is_step(shape) else _steps(shape, view)
    if not forward:
        base, step = _pairs(base, "_1", "_0"), _pairs(step, "_1", "_0")
    from_start = forward == shape.right or not shape.step or base_is_step(shape)
    step = cut(step.distinct(), "steps")
    # otherwise the closure of the steps from the start comes first, the base last
    seen = Growing((base if from_start else step).filter(F.col("_0") == start).select("_1").distinct(), "reached")
    front = seen.frame()
    for _ in range(MOST_ROUNDS):
        front = seen.add(front.withColumnRenamed("_1", "_0").join(step, "_0").select("_1").distinct().join(seen.frame(), "_1", "left_anti"))
        if front is None:
            break
    else:
        raise ProgramLimitError(f"recursion did not end within {MOST_ROUNDS} rounds")
    seen = seen.frame()
    if not from_start:
        ends = seen.select(F.col("_1").alias("_0")).unionByName(local_table(view.edges.sparkSession, [(start,)], ["_0"])).distinct()
        seen = ends.join(base, "_0").select("_1").distinct()
    out = seen.select(F.lit(start).alias("_0"), "_1")
    return out if forward else _pairs(out, "_1", "_0")


def semi_naive(keys: list[Key], rules: list[Rule], view: View) -> dict[Key, DataFrame]:
    """Least fixpoint of a recursive group: each round joins the newest facts of one atom with all facts of the others, and writes new facts only."""
    spark = view.edges.sparkSession
    seeds = {k: [r for r in rules if r.head.key == k and not any(c in keys for c in called(r.body))] for k in keys}
    known = {k: Growing(plain_facts(seeds[k], view) if seeds[k] else _as_facts(spark, [], k[1]), "facts") for k in keys}
    delta: dict[Key, DataFrame | None] = {k: known[k].frame() for k in keys}
    for _ in range(MOST_ROUNDS):
        full = {k: known[k].frame() for k in keys}
        now = View(view.edges, view.flagged, view.compound_grants, view.facts | full)
        fresh: dict[Key, list[DataFrame]] = {k: [] for k in keys}
        for rule in rules:
            for i, atom in enumerate(rule.body):
                if isinstance(atom, PredicateAtom) and atom.key in keys and delta[atom.key] is not None:
                    frame, names = conjunction(rule.body, now, {i: delta[atom.key]})
                    fresh[rule.head.key].append(project(frame, names, rule.head.terms))
        delta = {k: known[k].add(union(fresh[k]).distinct().join(full[k], full[k].columns, "left_anti")) if fresh[k] else None for k in keys}
        if not any(d is not None for d in delta.values()):
            return full
    raise ProgramLimitError(f"recursion did not end within {MOST_ROUNDS} rounds")


def derive(rules: tuple[Rule, ...], query: tuple[Atom, ...], view: View, small: bool = False) -> dict[Key, DataFrame]:
    """Facts of every predicate that the query needs."""
    facts: dict[Key, DataFrame] = {}
    groups = strata(rules, query)
    for keys, own, recursive in groups:
        now = View(view.edges, view.flagged, view.compound_grants, facts)
        if not recursive:
            facts[keys[0]] = plain_facts(own, now)
            continue
        shape = closure_shape(keys, own)
        if shape:
            bound = _bound_end(shape, groups, query)
            held = _small_closure(shape, now, bound) if small else None
            if held is None:
                held = reachable(shape, now, *bound) if bound else closure_facts(shape, now)
            facts[shape.key] = held
            continue
        found = _small(keys, own, now) if small else None
        facts |= semi_naive(keys, own, now) if found is None else found
    return facts


def _bound_end(shape: Closure, groups, query: tuple[Atom, ...]) -> tuple[str, bool] | None:
    """The constant and its side where the closure is used once, in the query, with one end bound."""
    uses = [a for a in query if isinstance(a, PredicateAtom) and a.key == shape.key]
    inside = any(shape.key in called(r.body) for keys, own, _ in groups if keys != [shape.key] for r in own)
    if len(uses) != 1 or inside:
        return None
    a, b = uses[0].terms
    if isinstance(a, Lit):
        return a.value, True
    return (b.value, False) if isinstance(b, Lit) else None
