import pytest

from quiverlog import Engine, GraphStore
from quiverlog.errors import ProgramLimitError
from quiverlog.operators import policy

#: A library: shelves, books and loans. Every way of granting is used once.
LIBRARY = """
DefCompound("Loan", "reader", "0", "liquid/string"). DefCompound("Loan", "book", "0", "liquid/string"). DefCompound("Loan", "desk", "0", "liquid/string").
Edge("book/1", "title", "Maps"). Edge("book/2", "title", "Tides"). Edge("book/3", "title", "Owls").
Edge("book/1", "shelf", "shelf/a"). Edge("book/2", "shelf", "shelf/a"). Edge("book/3", "shelf", "shelf/b").
Edge("book/3", "donated_by", "reader/7"). Edge("shelf/b", "kept_by", "reader/8").
Loan@(reader="reader/7", book="book/1", desk="north"). Loan@(reader="reader/9", book="book/2", desk="south").
ReadPredicate@(principal="clerk", predicate="title"). Edge("cataloguer", "liquid/can_read_predicate", "shelf").
ReadCompound@(principal="auditor", compound_type="Loan"). Edge("inspector", "liquid/can_read_compound", "Loan").
ReadTriple@(principal="guest", user="nobody at all", subject="book/2", predicate="title", object="Tides").
ReadTriple@(principal="nobody at all", user="visitor", subject="book/2", predicate="shelf", object="shelf/a").
PredicateReadBySubject@(predicate="title", relation="donated_by"). PredicateReadByObject@(predicate="shelf", relation="kept_by").
CompoundReadByRole@(compound_type="Loan", role="reader").
Edge("trainee", "liquid/acts_for", "desk team"). Edge("desk team", "liquid/acts_for", "clerk"). Edge("clerk", "liquid/acts_for", "trainee").
"""
TITLES = [("book/1", "Maps"), ("book/2", "Tides"), ("book/3", "Owls")]
SHELVES = [("book/1", "shelf/a"), ("book/2", "shelf/a"), ("book/3", "shelf/b")]
LOANS = [("reader/7", "book/1"), ("reader/9", "book/2")]


@pytest.fixture(scope="module")
def engine(spark):
    engine = Engine(GraphStore(spark))
    engine.query(LIBRARY)
    return engine


def rows(df):
    return sorted(tuple(r) for r in df.collect())


#: principal: titles, shelves, loans that it sees
SEEN = {
    "clerk": (TITLES, [], []),
    "trainee": (TITLES, [], []),
    "cataloguer": ([], SHELVES, []),
    "auditor": ([], [], LOANS),
    "inspector": ([], [], LOANS),
    "guest": (TITLES[1:2], [], []),
    "visitor": ([], SHELVES[1:2], []),
    "reader/7": (TITLES[2:], [], LOANS[:1]),
    "reader/8": ([], SHELVES[2:], []),
    "reader/9": ([], [], LOANS[1:]),
    "a stranger": ([], [], []),
}


@pytest.mark.parametrize(("principal", "joined"), [*((p, False) for p in SEEN), ("clerk", True), ("reader/7", True)])
def test_what_a_principal_sees(engine, monkeypatch, principal, joined):
    """The same whether grants are filters and broadcasts or joins."""
    if joined:
        monkeypatch.setattr(policy, "MOST_NAMES", 0)
        monkeypatch.setattr(policy, "MOST_BROADCAST", 0)
    titles, shelves, loans = SEEN[principal]
    assert rows(engine.read_as(principal, 'Edge(b, "title", t)?')) == titles
    assert rows(engine.read_as(principal, 'Edge(b, "shelf", s)?')) == shelves
    assert rows(engine.read_as(principal, "Loan@(reader=r, book=b)?")) == loans
    assert rows(engine.read_as(principal, 'Edge(l, "desk", d)?')) == []


def test_rules_see_no_more_than_queries(engine):
    rules = 'Called(b, t) :- Edge(b, "title", t). Lent(b) :- Loan@(book=b). On(t, s) :- Called(b, t), Edge(b, "shelf", s). '
    assert rows(engine.read_as("reader/7", rules + "Called(b, t)?")) == TITLES[2:]
    assert rows(engine.read_as("auditor", rules + "Lent(b)?")) == [("book/1",), ("book/2",)]
    assert rows(engine.read_as("clerk", rules + "On(t, s)?")) == []


def test_another_principal_for_one_call(engine):
    session = Engine(engine.store, principal="cataloguer")
    assert rows(session.query('Edge(b, "shelf", s)?')) == SHELVES
    assert rows(session.query_as("visitor", 'Edge(b, "shelf", s)?')) == SHELVES[1:2]
    assert rows(session.query('Edge(b, "shelf", s)?')) == SHELVES


def test_grants_asserted_in_the_same_call_count(spark):
    engine = Engine(GraphStore(spark), principal="p")
    assert rows(engine.query('Edge("x", "size", "9"). ReadPredicate@(principal="p", predicate="size"). Edge(a, "size", b)?')) == [("x", "9")]


def test_legacy_role_grant(spark):
    engine = Engine(GraphStore(spark))
    engine.query('DefCompound("Note", "by", "0", "liquid/string"). DefCompound("Note", "text", "0", "liquid/string"). Note@(by="me", text="one"). Note@(by="you", text="two"). Edge("Note", "liquid/readable_compound_if_role_has", "by").')
    assert rows(engine.read_as("me", "Note@(text=t)?")) == [("one",)]
    assert rows(engine.read_as("me", 'Note@(by="you", text=t)?')) == []


def test_scope_by_joins(engine, monkeypatch):
    monkeypatch.setattr(policy, "SMALL_ACTS", 1)
    assert rows(engine.read_as("trainee", 'Edge(b, "title", t)?')) == TITLES


def test_only_named_roles_decide(spark):
    engine = Engine(GraphStore(spark))
    engine.query('DefCompound("Box","in","0","liquid/string"). DefCompound("Box","out","0","liquid/string"). Box@(in="1", out="2"). ReadPredicate@(principal="p", predicate="in").')
    assert rows(engine.read_as("p", "Box@(in=x)?")) == [("1",)]
    assert rows(engine.read_as("p", "Box@(in=x, out=y)?")) == []


def test_scope_beyond_the_rounds_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(policy, "SMALL_ACTS", 1)
    monkeypatch.setattr(policy, "MOST_ROUNDS", 2)
    edges = spark.createDataFrame([(f"p{i}", policy.ACTS_FOR, f"p{i + 1}") for i in range(5)], "subject string, predicate string, object string")
    with pytest.raises(ProgramLimitError):
        policy.effective_scope(edges, "p0")
