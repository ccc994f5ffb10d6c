"""What a principal may read: policies are taken from all live edges, made into grants once, and decide edges and compounds in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlog.errors import ProgramLimitError
from quiverlog.functions.identity import compound_prefix
from quiverlog.operators.conjunction import View
from quiverlog.operators.fixpoint import MOST_ROUNDS, union
from quiverlog.sources.shared import Growing, cut, local_table

#: Policy relations kept as plain edges.
ACTS_FOR = "liquid/acts_for"
CAN_READ_PREDICATE, CAN_READ_COMPOUND = "liquid/can_read_predicate", "liquid/can_read_compound"
READABLE_BY_SUBJECT, READABLE_BY_OBJECT = "liquid/readable_if_subject_has", "liquid/readable_if_object_has"
READABLE_COMPOUND_BY_ROLE = "liquid/readable_compound_if_role_has"

_LEGACY = (ACTS_FOR, CAN_READ_PREDICATE, CAN_READ_COMPOUND, READABLE_BY_SUBJECT, READABLE_BY_OBJECT, READABLE_COMPOUND_BY_ROLE)
_COMPOUNDS = ("ReadPredicate", "ReadCompound", "ReadTriple", "PredicateReadBySubject", "PredicateReadByObject", "CompoundReadByRole")

#: acts_for edges that are walked in memory; more of them are walked by joins.
SMALL_ACTS = 20_000
#: Grants (some 200 bytes each) that are broadcast, and names that become a filter of the scan; more of them are joined by shuffles.
MOST_BROADCAST, MOST_NAMES = 50_000, 500


def _where(edges: DataFrame, predicate: str) -> DataFrame:
    return edges.filter(F.col("predicate") == predicate)


def effective_scope(edges: DataFrame, principal: str) -> DataFrame:
    """The principal and everyone it acts for, directly or not: one column ``q``."""
    spark = edges.sparkSession
    acts = _where(edges, ACTS_FOR).select("subject", "object")
    rows = acts.limit(SMALL_ACTS + 1).collect()
    if len(rows) <= SMALL_ACTS:
        after: dict[str, list[str]] = {}
        for r in rows:
            after.setdefault(r["subject"], []).append(r["object"])
        seen, work = {principal}, [principal]
        while work:
            for q in after.get(work.pop(), ()):
                if q not in seen:
                    seen.add(q)
                    work.append(q)
        return local_table(spark, [(q,) for q in sorted(seen)], ["q"])
    known = Growing(local_table(spark, [(principal,)], ["q"]), "scope")
    front = known.frame()
    for _ in range(MOST_ROUNDS):
        front = known.add(acts.join(front, acts["subject"] == front["q"]).select(F.col("object").alias("q")).distinct().join(known.frame(), "q", "left_anti"))
        if front is None:
            return known.frame()
    raise ProgramLimitError(f"acts_for did not end within {MOST_ROUNDS} rounds")


def _roles(edges: DataFrame, kind: str, *roles: str) -> DataFrame:
    """Policy compounds with their roles as columns."""
    typed = edges.filter(F.col("subject").startswith(compound_prefix(kind)))
    out = None
    for role in roles:
        part = _where(typed, role).select("subject", F.col("object").alias(role))
        out = part if out is None else out.join(part, "subject")
    return out


def _policies(edges: DataFrame) -> DataFrame:
    """The policy edges, in one scan: as many as policies were asserted."""
    wanted = F.col("predicate").isin(*_LEGACY)
    for kind in _COMPOUNDS:
        wanted = wanted | F.col("subject").startswith(compound_prefix(kind))
    return cut(edges.filter(wanted), "policies")


def _grants(edges: DataFrame, principal: str) -> DataFrame:
    """grant, a, b, c: predicate (a), triple (a, b, c), type (a), and node a with predicate or type b by subject, object or role."""
    policy = _policies(edges)
    scope = effective_scope(policy, principal)
    mine = lambda df, column: df.join(scope, df[column] == scope["q"], "left_semi")
    made = lambda df, grant, *columns: df.select(F.lit(grant).alias("grant"), *(F.col(c).alias(n) if c else F.lit(None).cast("string").alias(n) for c, n in zip((*columns, None, None)[:3], "abc")))

    triples = mine(policy.filter(F.col("subject").startswith(compound_prefix("ReadTriple")) & F.col("predicate").isin("principal", "user")), "object").select(F.col("subject").alias("cid")).distinct()
    typed = policy.filter(F.col("subject").startswith(compound_prefix("ReadTriple")))
    for role in ("subject", "predicate", "object"):
        triples = triples.join(_where(typed, role).select(F.col("subject").alias("cid"), F.col("object").alias(f"t_{role}")), "cid")
    parts = [
        made(mine(_roles(policy, "ReadPredicate", "principal", "predicate"), "principal"), "predicate", "predicate"),
        made(mine(_where(policy, CAN_READ_PREDICATE), "subject"), "predicate", "object"),
        made(triples, "triple", "t_subject", "t_predicate", "t_object"),
        made(mine(_roles(policy, "ReadCompound", "principal", "compound_type"), "principal"), "type", "compound_type"),
        made(mine(_where(policy, CAN_READ_COMPOUND), "subject"), "type", "object"),
    ]
    conditional = cut(union([
        *(made(_roles(policy, kind, what, by), grant, what, by) for grant, kind, what, by in (("subject", "PredicateReadBySubject", "predicate", "relation"), ("object", "PredicateReadByObject", "predicate", "relation"), ("role", "CompoundReadByRole", "compound_type", "role"))),
        *(made(_where(policy, legacy), grant, "subject", "object") for grant, legacy in (("subject", READABLE_BY_SUBJECT), ("object", READABLE_BY_OBJECT), ("role", READABLE_COMPOUND_BY_ROLE))),
    ]).distinct(), "conditional")
    relations = [r["b"] for r in conditional.select("b").distinct().limit(MOST_NAMES + 1).collect()]
    if relations:
        # nodes with such a relation to the scope; few relations become a filter of the scan
        held = edges.filter(F.col("predicate").isin(relations)) if len(relations) <= MOST_NAMES else edges
        held = mine(held, "object").select(F.col("subject").alias("node"), F.col("predicate").alias("b"))
        parts.append(held.join(conditional.select("grant", F.col("a").alias("what"), "b"), "b").select("grant", F.col("node").alias("a"), F.col("what").alias("b"), F.lit(None).cast("string").alias("c")))
    return cut(union(parts).distinct(), "grants")


def policy_view(edges: DataFrame, principal: str) -> View:
    """Edges with a flag ``seen``, and a rule for compounds.

    An edge is seen by a grant of its predicate, of the very triple, or because its subject or object has a relation to the scope. A
    compound is seen by a grant of its type, because one of its roles names the scope, or if every role edge that is asked for is seen.
    Grants are made and counted once: few are broadcast, so that the edges are flagged as they are scanned, many are joined.
    """
    grants = _grants(edges, principal)
    counts = {r["grant"]: r["n"] for r in grants.groupBy("grant").agg(F.count(F.lit(1)).alias("n")).collect()}

    def of(grant: str, *columns: str) -> DataFrame:
        found = grants.filter(F.col("grant") == grant).select(*(F.col(a).alias(c) for a, c in zip("abc", columns)))
        return F.broadcast(found) if counts[grant] <= MOST_BROADCAST else found

    flagged, flags = edges, []
    if 0 < counts.get("predicate", 0) <= MOST_NAMES:
        flags.append(F.col("predicate").isin([r["predicate"] for r in of("predicate", "predicate").collect()]))
        counts.pop("predicate")
    for grant, keys in (("predicate", ["predicate"]), ("triple", ["subject", "predicate", "object"]), ("subject", ["subject", "predicate"]), ("object", ["object", "predicate"])):
        if counts.get(grant):
            flagged = flagged.join(of(grant, *keys).withColumn(f"by_{grant}", F.lit(True)), keys, "left")
            flags.append(F.coalesce(F.col(f"by_{grant}"), F.lit(False)))
    seen = F.lit(False)
    for flag in flags:
        seen = seen | flag
    flagged = flagged.select("subject", "predicate", "object", seen.alias("seen"))
    whole_types = counts.get("type", 0)

    def compounds(kind: str, joined: DataFrame, named: list[str]) -> DataFrame:
        good = F.lit(True)
        for f in named:
            good = good & F.col(f)
        if counts.get("role"):
            held = of("role", "subject", "what").filter((F.col("what") == kind) & F.col("subject").startswith(compound_prefix(kind))).select("subject", F.lit(True).alias("by_role")).distinct()
            joined, good = joined.join(held, "subject", "left"), good | F.coalesce(F.col("by_role"), F.lit(False))
        if whole_types:
            whole = grants.filter((F.col("grant") == "type") & (F.col("a") == kind)).select(F.lit(True).alias("all_seen")).limit(1)
            joined, good = joined.join(F.broadcast(whole), F.lit(True), "left"), good | F.coalesce(F.col("all_seen"), F.lit(False))
        return joined.filter(good)

    return View(edges, flagged, compounds)
