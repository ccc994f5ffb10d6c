import pytest

from quiverlog import Engine, GraphStore
from quiverlog.errors import DataError, DatatypeMismatchError, InvalidParameterError, PrivilegeError, ProgramLimitError, ProgramSyntaxError
from quiverlog.operators import fixpoint
from quiverlog.operators.conjunction import join_order
from quiverlog.plans.parser import parse


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def engine(spark):
    return Engine(GraphStore(spark))


@pytest.fixture(params=[True, False], ids=["in memory", "distributed"])
def either(request, spark):
    return Engine(GraphStore(spark), small_graphs=request.param)


def test_rules_over_rules(engine):
    """Who could teach whom what, one introduction away."""
    found = engine.query(
        """
        Edge("ida","met","olu"). Edge("ida","met","pia"). Edge("olu","met","raj"). Edge("pia","met","raj"). Edge("pia","met","sol").
        Edge("raj","plays","oud"). Edge("raj","plays","flute"). Edge("sol","plays","drum"). Edge("raj","lives_in","Lyon").
        Second(x, y, z) :- Edge(x,"met",y), Edge(y,"met",z).
        Local(p, i, c) :- Edge(p,"plays",i), Edge(p,"lives_in",c).
        Lesson(x, y, i, c) :- Second(x, y, z), Local(z, i, c).
        Lesson("ida", y, i, c)?"""
    )
    assert rows(found) == sorted((y, i, "Lyon") for y in ("olu", "pia") for i in ("oud", "flute"))


STOPS = ["harbour", "market", "museum", "station", "zoo"]


def test_closure_shapes(either):
    """A tram line: every spelling of "later on the line", open and with either end given."""
    either.query(" ".join(f'Edge("{a}", "then", "{b}").' for a, b in zip(STOPS, STOPS[1:])))
    later = sorted((a, b) for i, a in enumerate(STOPS) for b in STOPS[i + 1 :])
    base = 'Later(u, v) :- Edge(u, "then", v). '
    for step in ("Later(u, w) :- Later(u, v), Later(v, w).", "Later(u, w) :- Later(v, w), Later(u, v).", 'Later(u, w) :- Later(u, v), Edge(v, "then", w).', 'Later(u, w) :- Edge(u, "then", v), Later(v, w).'):
        assert rows(either.query(f"{base}{step} Later(u, v)?")) == later
        assert rows(either.query(f'{base}{step} Later("market", v)?')) == [(x,) for x in STOPS[2:]]
        assert rows(either.query(f'{base}{step} Later(u, "station")?')) == [(x,) for x in STOPS[:3]]
        assert rows(either.query(f'{base}{step} Later("museum", "zoo"), Edge("harbour", "then", s)?')) == [("market",)]


def test_closure_of_another_step(either):
    either.query('Edge("c","in","n"). Edge("n","of","r"). Edge("r","of","w").')
    for step in ('L(x,z) :- L(x,y), Edge(y,"of",z).',):
        assert rows(either.query('L(x,y) :- Edge(x,"in",y). ' + step + " L(x,y)?")) == [("c", "n"), ("c", "r"), ("c", "w")]
        assert rows(either.query('L(x,y) :- Edge(x,"in",y). ' + step + ' L("c",y)?')) == [("n",), ("r",), ("w",)]
        assert rows(either.query('L(x,y) :- Edge(x,"in",y). ' + step + ' L(x,"w")?')) == [("c",)]
    left = 'L(x,y) :- Edge(x,"of",y). L(x,z) :- Edge(x,"in",y), L(y,z). '
    assert rows(either.query(left + 'L("c",y)?')) == [("r",)]
    assert rows(either.query(left + 'L(x,"w")?')) == [("r",)]


def test_cycles(either):
    """Four seasons lead to each other for ever, and a tail leads in."""
    either.query('Edge("spring","to","summer"). Edge("summer","to","autumn"). Edge("autumn","to","winter"). Edge("winter","to","spring"). Edge("start","to","winter").')
    assert len(rows(either.query('To(x,y) :- Edge(x,"to",y). To(x,z) :- To(x,y), To(y,z). To(x,y)?'))) == 5 * 4


def test_mutual_recursion(either):
    """A path of five notes: who is an even and who an odd number of steps away."""
    either.query(" ".join(f'Edge("{a}", "up", "{b}").' for a, b in zip("cdefg", "defga")))
    rules = 'Odd(x,y) :- Edge(x,"up",y). Even(x,z) :- Odd(x,y), Edge(y,"up",z). Odd(x,z) :- Even(x,y), Edge(y,"up",z). '
    assert rows(either.query(rules + 'Odd("c",y)?')) == [("a",), ("d",), ("f",)]
    assert rows(either.query(rules + 'Even("c",y)?')) == [("e",), ("g",)]


def test_seed_from_a_derived_predicate(either):
    """The least fixpoint, also where recursion starts from another rule's facts."""
    either.query('Edge("a","p","b"). Edge("b","p","c").')
    assert rows(either.query('S(x,y) :- Edge(x,"p",y). R(x,y) :- S(x,y). R(x,z) :- R(x,y), S(y,z). R(x,y)?')) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_a_cycle_is_not_joined_by_a_shared_object_first():
    """Customers and suppliers of a nation make no pairs before it is known who buys from whom."""
    query = parse('Edge(c, "in_nation", n), Edge(s, "in_nation", n), Edge(c, "buys_from", s)?').query
    assert join_order(query) == [0, 2, 1]
    assert join_order(parse('Edge(c, "in_nation", n), Edge(s, "in_nation", n), Edge(c, "pays", "x")?').query) == [2, 0, 1]
    assert join_order(parse('Edge(a, "p", b), Edge(d, "p", b), Edge(b, "q", d)?').query) == [0, 2, 1]


def test_round_limit(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "MOST_ROUNDS", 2)
    engine = Engine(GraphStore(spark))
    engine.query(" ".join(f'Edge("n{i}","p","n{i + 1}").' for i in range(9)))
    with pytest.raises(ProgramLimitError):
        engine.query('A(x,y) :- Edge(x,"p",y). B(x,z) :- A(x,y), Edge(y,"p",z). A(x,z) :- B(x,y), Edge(y,"p",z). A(x,y)?')


def test_bag_after_projection(engine):
    engine.query('Edge("x","p","1"). Edge("x","p","2"). Edge("y","p","1").')
    assert rows(engine.query('Edge(s,"p",_)?')) == [("x",), ("x",), ("y",)]
    assert rows(engine.query('S(s) :- Edge(s,"p",_). S(s)?')) == [("x",), ("y",)]


def test_fresh_head_constant_and_case(engine):
    engine.query('Edge("s","p","o").')
    assert rows(engine.query('F("__fresh__") :- Edge("s","p","o"). F(v)?')) == [("__fresh__",)]
    assert engine.query('Edge(a,"p",A)?').columns == ["a", "A"]


def test_compounds(engine):
    engine.query('DefCompound("Seat","row","0","liquid/string"). DefCompound("Seat","side","0","liquid/string"). Seat@(row="4", side="left").')
    assert rows(engine.query("Seat@(cid=c, row=r)?")) == [("Seat@(row='4', side='left')", "4")]
    # the type is the text before the sign, no longer and no shorter name
    engine.query('Edge("Seating@(row=9)", "row", "no"). Edge("Seat@(by hand)", "row", "7").')
    assert rows(engine.query("Seat@(row=r)?")) == [("4",), ("7",)]
    assert rows(engine.query('Seat@(cid="Seat@(by hand)", row=r)?')) == [("7",)]
    engine.query('Edge("Seat@(by hand)", "row", "8"). Edge("Seat@(by hand)", "side", "left"). Edge("Seat@(by hand)", "side", "right").')
    assert len(rows(engine.query('Seat@(cid="Seat@(by hand)", row=r, side=s)?'))) == 4
    assert rows(engine.query('Seat@(row=r, side="right")?')) == [("7",), ("8",)]
    assert rows(engine.query('Seat@(row="8", side="right", cid=c)?')) == [("Seat@(by hand)",)]
    for bad in ('Seat@(row="1").', 'Seat@(row="1", side="left", deck="up").', 'Berth@(row="1").'):
        with pytest.raises(InvalidParameterError):
            engine.query(bad)


def test_clauses_bind_cids_left_to_right(engine):
    engine.query('DefCompound("T","k","0","liquid/string"). T@(cid=x, k="v"), Edge(x,"kind",\n"drama").')
    assert rows(engine.query('Edge("T@(k=\'v\')","kind",o)?')) == [("drama",)]
    engine.query('T@(cid="T@(k=\'w\')", k="w").')
    for text, error in (('T@(cid="no", k="v").', DataError), ('T@(cid=x, k="1"), T@(cid=x, k="2").', DataError), ('Edge(x,"kind","a").', ProgramSyntaxError), ('Foo("a").', ProgramSyntaxError)):
        with pytest.raises(error):
            engine.query(text)


def test_identity_with_quotes_and_backslashes(engine):
    engine.query(r'''DefCompound("T","k","0","liquid/string"). T@(k="a\\b'c").''')
    assert rows(engine.query("T@(cid=c, k=k)?")) == [("T@(k=E'a\\\\b''c')", "a\\b'c")]


def test_schema_relations(engine):
    engine.query('DefPred("name","1","liquid/node","0","liquid/string").')
    assert ("name", "1", "liquid/node", "0", "liquid/string") in rows(engine.query("DefPred(p,a,b,c,d)?"))
    assert rows(engine.query('DefPred("mine","a","b","c","d") :- Edge("Smeta","liquid/mutable","false"). DefPred("mine",a,b,c,d)?')) == [("a", "b", "c", "d")]
    assert rows(engine.query('Ometa@(cid=c, liquid/object_meta="name")?')) == [("Ometa@(liquid/object_meta='name')",)]


def test_tombstones(engine):
    engine.query('Edge("A","p","B").')
    before = engine.query('Edge("A","p",o)?')
    engine.store.tombstone([("A", "p", "B"), ("un", "known", "edge")])
    assert rows(engine.query('Edge("A","p",o)?')) == []
    assert rows(before) == [("B",)]
    engine.query('Edge("A","p","B").')
    assert rows(engine.query('Edge("A","p",o)?')) == [("B",)]
    assert engine.store.records.filter("subject = 'un'").count() == 0


def test_entry_points(engine):
    assert engine.query('Edge("a","p","b").') is None
    assert engine.query('Edge(x,"p",y)?', columns=["left", "right"]).columns == ["left", "right"]
    for call, error in (
        (lambda: engine.query('Edge("a","p","b")?'), InvalidParameterError),
        (lambda: engine.query('Edge("no","p","no"). Edge(x,"p",y)?', columns=["one"]), DatatypeMismatchError),
        (lambda: engine.read_as("me", 'Edge("no","p","no"). Edge(x,"p",y)?'), PrivilegeError),
        (lambda: engine.read_as("", 'Edge(x,"p",y)?'), InvalidParameterError),
    ):
        with pytest.raises(error):
            call()
    assert rows(engine.query('Edge("no",p,o)?')) == []


def test_many_rules_and_layers(engine):
    wide = " ".join(f'Any(x) :- Edge("M","m{i}",x).' for i in range(300))
    engine.query(" ".join(f'Edge("M","m{i}","v{i}").' for i in range(300)))
    assert len(rows(engine.query(wide + " Any(x)?"))) == 300
    for i in range(15):
        engine.query(f'Edge("layer","n","{i}").')
    assert len(rows(engine.query('Edge("layer","n",x)?'))) == 15


def test_save_and_load(engine, tmp_path, spark):
    engine.query('Edge("a","p/q","b"). Edge("a","p/q","c").')
    engine.store.tombstone([("a", "p/q", "c")])
    engine.store.save(str(tmp_path))
    again = GraphStore.load(spark, str(tmp_path))
    assert rows(Engine(again).query('Edge("a","p/q",o)?')) == [("b",)]
    again.insert([("a", "p/q", "c")])
    again.save(str(tmp_path))
    assert rows(Engine(GraphStore.load(spark, str(tmp_path))).query('Edge("a","p/q",o)?')) == [("b",), ("c",)]


@pytest.mark.parametrize("query", ['R("n0", y)?', 'R(x, "n5")?'])
def test_bound_closure_beyond_the_rounds_is_an_error(spark, monkeypatch, query):
    monkeypatch.setattr(fixpoint, "MOST_ROUNDS", 2)
    engine = Engine(GraphStore(spark), small_graphs=False)
    engine.query(" ".join(f'Edge("n{i}", "next", "n{i + 1}").' for i in range(5)))
    with pytest.raises(ProgramLimitError):
        engine.query('R(x, y) :- Edge(x, "next", y). R(x, z) :- R(x, y), R(y, z). ' + query)


def test_a_failing_call_leaves_nothing(spark, monkeypatch):
    """Assertions of a call whose query fails are not made, and the store's next changes are as ever."""
    monkeypatch.setattr(fixpoint, "MOST_ROUNDS", 2)
    engine = Engine(GraphStore(spark, bootstrap=False))
    path = " ".join(f'Edge("{i}", "next", "{i + 1}").' for i in range(9))
    with pytest.raises(ProgramLimitError):
        engine.query(path + ' R(x, y) :- Edge(x, "next", y). R(x, z) :- R(x, y), Edge(y, "next", z). R(x, y)?')
    assert engine.store.records.count() == 0 and engine.store.tx == 0
    assert rows(engine.query('Edge("a", "next", "b"). Edge(x, "next", y)?')) == [("a", "b")]


def test_kept_edges_give_the_same_answers(spark):
    store = GraphStore(spark, bootstrap=False)
    plain, near = Engine(store), Engine(store, cache_rows=100, held_rows=100)
    store.insert([("a", "p", "a"), ("a", "p", "b"), ("b", "q", "c"), ("c", "p", "c")])
    texts = ('Edge(x, "p", y)?', 'Edge(x, "p", x)?', 'Edge("a", p, o)?', 'Edge(x, _, _)?', 'Edge(x, y, z)?', 'Edge("z", p, o)?', 'Edge(x, "p", y), Edge(y, "q", z)?', 'R(x, y) :- Edge(x, p, y). R(x, y)?')

    def failing(engine):  # its branch is read, cached and thrown away
        with pytest.raises(DatatypeMismatchError):
            engine.query('Edge("never", "p", "never"). Edge(x, "p", y)?', ["one"])

    for change in (lambda: None, lambda: store.tombstone([("a", "p", "b")]), lambda: plain.query('Edge("b", "p", "b").'), lambda: failing(near), lambda: near.query('Edge("z", "q", "b").')):
        change()
        for text in texts:
            assert rows(near.query(text)) == rows(plain.query(text)), text


def test_changes_over_a_written_base(spark):
    """Layers of changes, merged or not, against a plain set."""
    store, truth = GraphStore(spark, spark.createDataFrame([(f"s{i}", "p", "o") for i in range(30)], "subject string, predicate string, object string"), bootstrap=False), {(f"s{i}", "p", "o") for i in range(30)}
    for k in range(12):
        edges = {(f"s{(7 * k + j) % 40}", "p", "o") for j in range(5)}
        if k % 3 == 1:
            store.tombstone(edges)
            truth -= edges
        else:
            store.insert(edges if k % 2 else spark.createDataFrame(list(edges), "subject string, predicate string, object string"))
            truth |= edges
        assert {tuple(r) for r in store.live().collect()} == truth
    store.compact()
    assert {tuple(r) for r in store.live().collect()} == truth


def test_projected_compounds(engine, spark):
    engine.query('DefCompound("Seat","row","0","liquid/string"). DefCompound("Seat","side","0","liquid/string").')
    table = spark.createDataFrame([(4, "left"), (5, None)], "r int, s string")
    assert rows(engine.project_compound_edges("Seat", table, {"row": "r", "side": "s"})) == [("Seat@(row='4', side='left')", "row", "4"), ("Seat@(row='4', side='left')", "side", "left")]
    with pytest.raises(InvalidParameterError):
        engine.project_compound_edges("Seat", table, {"row": "r"})
