"""Random positive programs over a small graph against a naive fixpoint."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quiverlog import Engine, GraphStore
from quiverlog.plans.parser import parse
from quiverlog.plans.terms import EdgeAtom, Lit, Var, variables

NODES = ["a", "b", "c", "d"]
edges = st.sets(st.tuples(st.sampled_from(NODES), st.sampled_from(["p", "q"]), st.sampled_from(NODES)), min_size=1, max_size=7)
variable = st.sampled_from(["x", "y", "z"])
atom = st.one_of(
    st.builds(lambda s, p, o: f'Edge({s},"{p}",{o})', variable, st.sampled_from(["p", "q"]), st.one_of(variable, st.just('"a"'))),
    st.builds(lambda n, s, o: f"{n}({s},{o})", st.sampled_from(["R", "S"]), variable, variable),
)


@st.composite
def rule(draw):
    body = draw(st.lists(atom, min_size=1, max_size=3))
    names = sorted({v.name for v in variables(parse(", ".join(body) + "?").query)})
    head = draw(st.sampled_from(["R", "S"]))
    return f"{head}({draw(st.sampled_from(names))},{draw(st.sampled_from(names))}) :- {', '.join(body)}."


def naive(program, graph):
    facts = {("R", 2): set(), ("S", 2): set()}

    def solve(atoms):
        names = variables(atoms)
        for values in itertools.product(NODES, repeat=len(names)):
            at = dict(zip(names, values))
            rows = [tuple(t.value if isinstance(t, Lit) else at[t] for t in a.terms) for a in atoms]
            if all(r in (graph if isinstance(a, EdgeAtom) else facts[a.key]) for a, r in zip(atoms, rows)):
                yield at

    changed = True
    while changed:
        changed = False
        for r in program.rules:
            for at in list(solve(r.body)):
                fact = tuple(at[t] if isinstance(t, Var) else t.value for t in r.head.terms)
                if fact not in facts[r.head.key]:
                    facts[r.head.key].add(fact)
                    changed = True
    return sorted(tuple(at[v] for v in variables(program.query)) for at in solve(program.query))


@pytest.mark.parametrize(("small", "examples"), [(True, 12), (False, 3)])
def test_least_fixpoint(spark, small, examples):
    @settings(max_examples=examples, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(edges, st.lists(rule(), min_size=2, max_size=4), st.sampled_from(["R(x,y)?", "R(x,y), S(y,z)?", 'S("a",y)?', 'R(x,y), Edge(y,"p",z)?']))
    def check(graph, rules, query):
        text = " ".join(dict.fromkeys(['R(x,y) :- Edge(x,"p",y).', *rules])) + " " + query
        engine = Engine(GraphStore(spark, spark.createDataFrame(sorted(graph), "subject string, predicate string, object string"), bootstrap=False), small_graphs=small)
        assert sorted(tuple(r) for r in engine.query(text).collect()) == naive(parse(text), graph)

    check()
