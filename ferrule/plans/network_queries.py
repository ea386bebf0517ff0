"""Queries over graphs made from clauses, concepts and their relations, resolution of references, rules with variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import census, clauses, concepts, graph, resolve
from ferrule.operators.rules import Literal, Rule, consequences
from ferrule.plans.registry import query
from ferrule.sources.tables import spread, table

c = F.col


# Graphs from clauses


def order_clauses(spark, d):
    """Each order a document and each of its lines a sentence: parts and events are declared in every line, suppliers in the first only. A select for each literal, so that a query makes only those it asks for."""
    part, supplier, event = (F.concat(F.lit(k), c(v).cast("string")) for k, v in (("p", "l_partkey"), ("s", "l_suppkey"), ("e", "l_linenumber")))
    items, no, few = table(spark, d, "lineitem"), F.lit(False), c("l_quantity") < 10
    place = (c("l_orderkey").alias("document"), c("l_linenumber").alias("sentence"), c("l_linenumber").alias("line"))
    lit = lambda name, body, *args, rows=items: rows.select(*place, F.lit(name).alias("predicate"), F.array(*args).alias("args"), body.alias("in_body"))
    said = [
        lit("entity", few, part, F.lit("part")), lit("event", no, event, F.lit("ship")), lit("argument", no, event, F.lit("1"), supplier), lit("argument", no, event, F.lit("2"), part),
        lit("grade", no, part, c("l_linestatus")), lit("qualifier", no, event, c("l_returnflag")), lit("entity", no, supplier, F.lit("supplier"), rows=items.where("l_linenumber = 1")),
    ]
    return reduce(DataFrame.unionByName, said)


_L = "l as (select l_orderkey as document, l_linenumber as sentence, 'p' || l_partkey as p, 's' || l_suppkey as s, 'e' || l_linenumber as e, l_quantity < 10 as few, l_linestatus as grade, l_returnflag as flag from lineitem)"


@query(f"""with {_L}, n as (select 'entity' as kind, document, p as name, 'part' as label, sentence from l union all select 'event', document, e, 'ship', sentence from l union all select 'entity', document, s, 'supplier', sentence from l where sentence = 1)
           select kind || ':' || document || ':' || name as id, kind, any_value(label) as label, document, min(sentence) as sentence, name from n group by kind, document, name""")
def kb_declared_nodes(spark, d):
    return clauses.declared(order_clauses(spark, d))


@query(f"""with {_L}, p1 as (select document, p, min(sentence) as first from l group by 1, 2), s1 as (select distinct document, s from l where sentence = 1)
           select 'argument' as kind, 'event:' || l.document || ':' || e as source, 'entity:' || l.document || ':' || l.p as target, 'argument 2' as label, l.document, sentence, sentence as line, case when sentence = first then 'sentence' else 'document' end as found
           from l join p1 on l.document = p1.document and l.p = p1.p
           union all select 'argument', 'event:' || l.document || ':' || e, case when s1.s is null then 'minted:' else 'entity:' end || l.document || ':' || l.s, 'argument 1', l.document, sentence, sentence,
           case when s1.s is null then 'minted' when sentence = 1 then 'sentence' else 'document' end from l left join s1 on l.document = s1.document and l.s = s1.s""")
def kb_argument_edges(spark, d):
    rows = order_clauses(spark, d)
    return clauses.argument_edges(rows, clauses.declarations(rows))


@query(f"""with {_L} select 'grade' as kind, 'entity:' || document || ':' || p as source, 'word:' || grade as target, grade as label, document, sentence, sentence as line, 'declared' as found from l
           union all select 'qualifier', 'event:' || document || ':' || e, 'word:' || flag, flag, document, sentence, sentence, 'declared' from l""")
def kb_annotation_edges(spark, d):
    rows = order_clauses(spark, d)
    return clauses.annotation_edges(rows, clauses.declarations(rows))


def rule_lines(spark, d):
    """Each line of an order a clause; lines of returned goods are another sentence."""
    sentence = F.when(c("l_returnflag") == "R", 2).otherwise(1)
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("document"), sentence.alias("sentence"), c("l_linenumber").alias("line"), "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")


def _rule_literals():
    """(ordinal, predicate, in_body, world, args) of a rule line: its head states an event, its body has two events in worlds of their own, an argument and a grade."""
    name = lambda tag, value: F.concat(F.lit(tag), value.cast("string"))
    head, first, second, part = name("h", c("line") % 2), name("q", c("l_partkey") % 4), name("q", c("l_suppkey") % 4), name("p", c("l_partkey") % 9)
    actual, world = F.lit("actual"), c("l_linestatus")
    return [
        (0, "event", False, actual, (head, F.lit("do"))), (1, "event", True, world, (first, F.lit("hold"))), (2, "event", True, actual, (second, F.lit("hold"))),
        (3, "argument", True, world, (first, F.lit("1"), part)), (4, "grade", True, actual, (second, c("l_returnflag"))),
    ]


def rule_clauses(spark, d):
    """The literals of rule lines, each once a line; they lie by sentence."""
    said = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(p).alias("predicate"), F.lit(body).alias("in_body"), world.alias("world"), F.array(*args).alias("args")) for k, p, body, world, args in _rule_literals()])
    # A sentence's lines meet before they are taken apart; a clause that an earlier row of its line states is left out.
    w = Window.partitionBy("document", "sentence", "line").orderBy("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag").rowsBetween(Window.unboundedPreceding, -1)
    met = spread(rule_lines(spark, d), "document", "sentence").withColumn("said", said).withColumn("before", F.collect_list("said").over(w))
    new = F.when(F.size("before") == 0, c("said")).otherwise(F.array_except("said", F.flatten("before")))
    return met.select("document", "sentence", "line", F.explode(new).alias("s")).select("document", "sentence", "line", "s.*")


def rule_statements(lines, distinct: bool):
    """The literals of rule lines, once a line or as often as rows state them. A select for each literal, so that a query makes only those it asks for."""
    parts = []
    for ordinal, predicate, body, world, args in _rule_literals():
        names = [f"arg{k}" for k in range(len(args))]
        rows = lines.select("document", "sentence", "line", world.alias("world"), *[x.alias(n) for n, x in zip(names, args)])
        rows = rows.distinct() if distinct else rows
        parts.append(rows.select("document", "sentence", "line", F.lit(ordinal).alias("ordinal"), F.lit(predicate).alias("predicate"), F.lit(body).alias("in_body"), "world", F.array(*names).alias("args")))
    return reduce(DataFrame.unionByName, parts)


_R = """l as (select distinct l_orderkey as document, case when l_returnflag = 'R' then 2 else 1 end as sentence, l_linenumber as line, 'h' || l_linenumber % 2 as h, 'q' || l_partkey % 4 as q1, 'q' || l_suppkey % 4 as q2, 'p' || l_partkey % 9 as p, l_linestatus as world, l_returnflag as flag from lineitem),
  b as (select document, sentence, line, 1 as ordinal, world, q1 as q from l union select document, sentence, line, 2, 'actual', q2 from l), h as (select distinct document, sentence, line, h from l),
  k as (select document, sentence, 'event:' || document || ':' || q as source, 'event:' || document || ':' || h as target, line, ordinal, world from b join h using (document, sentence, line)),
  r as (select *, row_number() over (partition by document, sentence, source, target order by line, ordinal, world) as nth from k)"""


@query(f"""with {_R} select 'implies' as kind, source, target, 'condition supports' as label, document, sentence, line, world from r where nth = 1""")
def kb_condition_edges(spark, d):
    return clauses.condition_edges(rule_clauses(spark, d))


@query(f"""with {_R} select a.document, a.sentence, a.source, a.target, b.line as kept_line, b.world as kept_world, a.line, a.world from r a join r b on (a.document, a.sentence, a.source, a.target) = (b.document, b.sentence, b.source, b.target) and a.nth > 1 and b.nth = 1""")
def kb_condition_merges(spark, d):
    return clauses.condition_merges(rule_clauses(spark, d))


@query(f"""with {_R} select kind, source, target, label, document, sentence, world, min(line) as line, count(*) as times from (
    select distinct document, sentence, line, 'argument' as kind, 'event:' || document || ':' || q1 as source, 'minted:' || document || ':' || p as target, 'argument 1' as label, world from l
    union all select distinct document, sentence, line, 'grade', 'event:' || document || ':' || q2, 'word:' || flag, flag, 'actual' from l) group by all""")
def kb_body_edges(spark, d):
    lines = rule_lines(spark, d)
    return clauses.body_edges(rule_statements(spread(lines, "document", "sentence"), True), clauses.declarations(rule_statements(lines, False)))


@query(f"""with {_R} select distinct 'implies' as kind, 'context:' || document || ':actual' as source, 'event:' || document || ':' || h as target, 'condition implies event' as label, document, sentence, line from l""")
def kb_context_edges(spark, d):
    return clauses.context_edges(rule_clauses(spark, d))


@query("""select o_orderkey as document, s::int as sentence, 'scope:' || o_orderkey || ':' || s as id from orders, range(1, 6) t(s) where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = s)""")
def kb_orphan_scopes(spark, d):
    scopes = table(spark, d, "orders").select(c("o_orderkey").alias("document"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("sentence"))
    scopes = scopes.withColumn("id", F.concat(F.lit("scope:"), c("document").cast("string"), F.lit(":"), c("sentence").cast("string")))
    return clauses.orphan_scopes(scopes, order_clauses(spark, d)).select("document", "sentence", "id")


@query("""select 'region:' || r_regionkey as id from region where r_regionkey <> 0 union all select 'nation:' || n_nationkey from nation where n_regionkey <> 0
          union all select 'supplier:' || s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey <> 0 union all select 'customer:' || c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 0""")
def kb_unreached(spark, d):
    nodes = graph.star_nodes(spark, d).where("kind in ('region', 'nation', 'supplier', 'customer')")
    return clauses.unreached(nodes, graph.star_edges(spark, d).where("kind in ('located', 'within')"), spark.range(1).select(F.lit("region:0").alias("id")))


# Concepts


_KIND = {"contains": ("argument", "argument 2"), "supplies": ("argument", "argument 1"), "located": ("property", "located"), "within": ("operator", "within")}
_E = """e as (select 'argument' as kind, 'argument 2' as label, 'order:' || l_orderkey as source, 'part:' || l_partkey as target, l_returnflag as scope from lineitem union all select 'argument', 'argument 1', 'supplier:' || l_suppkey, 'part:' || l_partkey, l_returnflag from lineitem
  union all select 'property', 'located', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, null from supplier union all select 'property', 'located', 'customer:' || c_custkey, 'nation:' || c_nationkey, null from customer
  union all select 'operator', 'within', 'nation:' || n_nationkey, 'region:' || n_regionkey, null from nation)"""


def _edges(spark, d):
    pick = lambda k: F.create_map(*[F.lit(x) for name, pair in _KIND.items() for x in (name, pair[k])])[c("kind")]
    scope = F.when(c("scope").isNotNull(), F.array("scope"))
    return graph.star_edges(spark, d).select(pick(0).alias("kind"), pick(1).alias("label"), "source", "target", scope.alias("scope"), F.lit(None).cast("array<string>").alias("far"))


@query(f"""with {_E}, w as (select source, target, case label when 'argument 2' then 400 when 'argument 1' then 100 when 'located' then 200 else 100 end as w from e)
           select node, max(w)::int as role from (select source as node, w from w union all select target, w + 25 from w) group by 1""")
def kb_best_role(spark, d):
    return census.best_roles(_edges(spark, d))


@query(f"""with {_E} select kind, label, source, target from e where kind <> 'operator' and split_part(source, ':', 1) in ('supplier', 'part', 'nation') and split_part(target, ':', 1) in ('supplier', 'part', 'nation')""")
def kb_concept_relations(spark, d):
    nodes = graph.star_nodes(spark, d)
    return census.concept_relations(_edges(spark, d), nodes, ("supplier", "part", "nation")).select("kind", "label", "source", "target")


@query(f"""with {_E} select md5(kind || chr(31) || source || chr(31) || target || chr(31) || label || chr(31) || coalesce(scope, '') || chr(31)) as key, count(*) as n from e group by kind, source, target, label, scope""")
def kb_edge_keys(spark, d):
    return census.edge_key(_edges(spark, d)).groupBy(F.md5("key").alias("key")).agg(F.count("*").alias("n"))


@query("""select 'implies' as kind, l_orderkey, l_linenumber, l_returnflag = 'R' or l_linestatus = 'O' as negated from lineitem""")
def kb_negated_support(spark, d):
    minus = lambda name, value: F.when(c(name) == value, F.array(F.lit("-"))).otherwise(F.array(F.lit("may")))
    negated = census.negated_support(F.lit("implies"), F.lit("condition supports"), minus("l_returnflag", "R"), minus("l_linestatus", "O"))
    return table(spark, d, "lineitem").select(F.lit("implies").alias("kind"), "l_orderkey", "l_linenumber", negated.alias("negated"))


@query("""select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2""")
def kb_scope_census(spark, d):
    return census.histogram(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("""select 'l_returnflag/l_linestatus' as census, l_returnflag as key, l_linestatus as sub, count(distinct l_orderkey) as sites, min(l_orderkey) as first from lineitem group by 2, 3
          union all select 'l_suppkey/l_returnflag', l_suppkey::varchar, l_returnflag, count(distinct l_orderkey), min(l_orderkey) from lineitem group by 2, 3""")
def kb_corpus_census(spark, d):
    return census.nested(table(spark, d, "lineitem"), [("l_returnflag", "l_linestatus"), ("l_suppkey", "l_returnflag")], "l_orderkey")


@query("""select l_partkey, l_suppkey, l_returnflag, l_linestatus, string_agg(l_orderkey, ',' order by l_orderkey) as keys, count(*) as n from lineitem group by 1, 2, 3, 4""")
def kb_full_identity(spark, d):
    out = census.identical(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"], "l_orderkey")
    return out.withColumn("keys", F.array_join(F.transform("keys", lambda x: x.cast("string")), ","))


@query("""with a as (select conv_id, role, count(*)::int as k from conversations group by 1, 2) select role || '/' || k as shape, count(*) as n from a group by 1""")
def kb_premise_shapes(spark, d):
    calls = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.collect_list("turn").alias("args"))
    return census.shapes(calls, "role", "args")


@query("""with r as (select 'supplier' as kind, s_suppkey as id, s_nationkey as nation, s_acctbal as weight from supplier union all select 'customer', c_custkey, c_nationkey, c_acctbal from customer)
          select kind, id, nation, row_number() over (partition by nation order by case kind when 'customer' then 1 else 2 end, weight desc, id)::int as place from r""")
def kb_priority_order(spark, d):
    some = lambda name, k, p: table(spark, d, name).select(F.lit(name).alias("kind"), c(f"{p}_{k}").alias("id"), c(f"{p}_nationkey").alias("nation"), c(f"{p}_acctbal").alias("weight"))
    rows = some("supplier", "suppkey", "s").unionByName(some("customer", "custkey", "c"))
    return resolve.by_rank(rows, ("customer", "supplier"), "kind", "weight", "id", ["nation"]).select("kind", "id", "nation", "place")


_CONCEPT_KINDS = ("supplier", "part", "nation")


@query(f"""with {_E}, n as (select 'part:' || p_partkey as id, 'part' as kind, p_name as label from part where p_partkey in (select l_partkey from lineitem) union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier)
           select id, kind, label, case when lower(label) like 'ring%' then 2 when lower(label) like '% ring%' then 3 else 4 end as score from n where lower(label) || ' ' || lower(id) || ' ' || kind like '%ring%' order by score, label, kind, id limit 10""")
def kb_concept_search(spark, d):
    nodes = graph.star_nodes(spark, d)
    return concepts.search_concepts(nodes, census.concept_relations(_edges(spark, d), nodes, _CONCEPT_KINDS), "ring", 10, _CONCEPT_KINDS)


@query("""with recursive e as (select 'supplier:' || l_suppkey as a, 'part:' || l_partkey as b from lineitem union select 'part:' || l_partkey, 'supplier:' || l_suppkey from lineitem union select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier
            union select 'nation:' || s_nationkey, 'supplier:' || s_suppkey from supplier),
          b(node, depth) as (select 'supplier:1', 0 union select e.b, depth + 1 from b join e on a = node where depth < 4) select min(depth)::int as length from b where node = 'part:9'""")
def kb_concept_path_len(spark, d):
    path = concepts.shortest_concept_path(_edges(spark, d), graph.star_nodes(spark, d), "supplier:1", "part:9", 4, _CONCEPT_KINDS)
    return path.agg(F.max("step").alias("length"))


@query(f"""with {_E}, r as (select * from e where kind <> 'operator' and split_part(source, ':', 1) in ('supplier', 'part') and split_part(target, ':', 1) in ('part', 'nation'))
           select (select count(distinct n) from (select source as n from r union select target from r)) as nodes, (select count(*) from (select distinct kind, label, source, target, coalesce(scope, '') from r)) as relations""")
def kb_concept_counts(spark, d):
    nodes = graph.star_nodes(spark, d)
    return concepts.concept_counts(nodes, census.concept_relations(_edges(spark, d), nodes, _CONCEPT_KINDS), _CONCEPT_KINDS)


@query(f"""with {_E}, r as (select * from e where kind <> 'operator' and split_part(source, ':', 1) in ('supplier', 'part') and split_part(target, ':', 1) in ('part', 'nation'))
           select node, count(*) as relations, sum(o)::bigint as out, sum(1 - o)::bigint as into from (select source as node, 1 as o from r union all select target, 0 from r) group by 1""")
def kb_concept_incidence(spark, d):
    return concepts.incidence(census.concept_relations(_edges(spark, d), graph.star_nodes(spark, d), _CONCEPT_KINDS))


_SCOPED = """v as (select event_id, user_id % 50 as a, (user_id + event_id) % 50 as b, event_type, case event_type when 'click' then 'may' when 'view' then '- should' else '' end as scope,
  case when event_id % 3 = 0 then 'can' when event_id % 3 = 1 then null else '- should' end as far from events)"""


def _scoped(spark, d):
    chains = spark.createDataFrame([("c", ["may"]), ("v", ["-", "should"]), ("f", ["can"])], "id string, chain array<string>")
    near = F.when(c("event_type") == "click", "c").when(c("event_type") == "view", "v")
    far = F.when(c("event_id") % 3 == 0, "f").when(c("event_id") % 3 == 2, "v")
    edges = table(spark, d, "events").select(c("event_id").alias("id"), (c("user_id") % 50).alias("source"), ((c("user_id") + c("event_id")) % 50).alias("target"), c("event_type").alias("label"), near.alias("scope_id"), far.alias("far_id"))
    return concepts.with_scopes(edges, chains)


@query(f"""with {_SCOPED} select event_id as id, scope, coalesce(far, '') as far, case when a = 7 then scope else coalesce(far, '') end as near_end, case when a = 7 then coalesce(far, '') else scope end as far_end from v where a = 7 or b = 7""")
def kb_scope_reading(spark, d):
    text = lambda x: F.array_join(x, " ")
    rows = _scoped(spark, d).where("source = 7 or target = 7")
    seen = concepts.scope_reading(c("scope"), c("far"), c("source") != 7)
    return rows.select("id", text(c("scope")).alias("scope"), F.coalesce(text(c("far")), F.lit("")).alias("far"), text(seen["near"]).alias("near_end"), text(seen["far"]).alias("far_end"))


@query(f"""with {_SCOPED} select event_id as id, case when event_id % 10 = 0 then 'highlight' else 'context' end as state, scope like '-%' or coalesce(far like '-%', false) as dashed,
           event_type || case when scope <> '' then ' · ' || scope else '' end || case when far is not null and far <> scope then ' → ' || far else '' end as label from v""")
def kb_edge_views(spark, d):
    edges = _scoped(spark, d)
    return concepts.edge_views(edges, edges.where("id % 10 = 0").select("id"))


@query("""with l as (select distinct 'supplier:' || l_suppkey as s, 'part:' || l_partkey as t, l_orderkey as d, l_linenumber as n from lineitem)
          select 'concept:' || s as key, s as subject, s as member from l union select 'concept:' || s, s, t from l union select 'concept:' || t, t, t from l union select 'concept:' || t, t, s from l
          union select 'rule:' || d || ':' || n, null, s from l union select 'rule:' || d || ':' || n, null, t from l""")
def kb_focus_sets(spark, d):
    # A line is its two keys; its ends are named where distinct lines lie, and occurrences are joined there.
    items = table(spark, d, "lineitem").select(F.struct("l_suppkey", "l_partkey").alias("line"), c("l_orderkey").alias("document"), c("l_linenumber").alias("sentence"))
    lines = items.select("line").distinct().select("line", graph.node_id("supplier", c("line.l_suppkey")).alias("source"), graph.node_id("part", c("line.l_partkey")).alias("target"))
    return concepts.focus_sets(lines, items)


# References


@query("""with u as (select o_custkey as key, min(o_orderkey) as v from orders where o_orderpriority = '1-URGENT' group by 1), f as (select o_custkey as key, min(o_orderkey) as v from orders where o_orderstatus = 'F' group by 1)
          select c_custkey, coalesce(u.v, f.v) as value, case when u.v is not null then 'urgent' when f.v is not null then 'filled' end as source from customer left join u on u.key = c_custkey left join f on f.key = c_custkey""")
def kb_priority_lookup(spark, d):
    orders = table(spark, d, "orders")
    least = lambda where: orders.where(where).groupBy(c("o_custkey").alias("key")).agg(F.min("o_orderkey").alias("value"))
    return resolve.by_priority(table(spark, d, "customer").select("c_custkey"), "c_custkey", (least("o_orderpriority = '1-URGENT'"), "urgent"), (least("o_orderstatus = 'F'"), "filled"))


@query("""with k as (select l_partkey, min(l_orderkey) as l_orderkey from lineitem where l_quantity > 49 group by 1 having count(*) = 1) select p_partkey, l_orderkey from part join k on l_partkey = p_partkey""")
def kb_unique_match(spark, d):
    bulky = table(spark, d, "lineitem").where("l_quantity > 49").select(c("l_partkey").alias("p_partkey"), "l_orderkey")
    return resolve.unique_match(table(spark, d, "part").select("p_partkey"), bulky, ["p_partkey"])


@query("""with w as (select l_orderkey, count(distinct l_returnflag) as n, min(l_returnflag) as v from lineitem where l_linenumber <= 2 group by 1)
          select o_orderkey, case when n = 1 then v end as flag, case when n is null then 'missing' when n > 1 then 'several' else 'unique' end as status from orders left join w on l_orderkey = o_orderkey""")
def kb_scope_witness(spark, d):
    seen = table(spark, d, "lineitem").where("l_linenumber <= 2").select(c("l_orderkey").alias("o_orderkey"), c("l_returnflag").alias("flag"))
    return resolve.witnessed(table(spark, d, "orders").select("o_orderkey"), seen, ["o_orderkey"], "flag").select("o_orderkey", "flag", "status")


@query("""select doc_id, 'unlabelled' as side from (select doc_id from documents except select doc_id from labels) union all select doc_id, 'undocumented' from (select doc_id from labels except select doc_id from documents)""")
def kb_orphans_both_ways(spark, d):
    return resolve.both_orphans(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"], ("unlabelled", "undocumented"))


@query("""with s as (select conv_id, turn // 2 as grp, role from conversations), k as (select conv_id, count(distinct role) as k from s group by 1)
          select conv_id, grp::bigint as grp, count(distinct role) = any_value(k) as on_both from s join k using (conv_id) group by 1, 2""")
def kb_groups_on_both_sides(spark, d):
    spans = table(spark, d, "conversations").select("conv_id", F.floor(c("turn") / 2).alias("grp"), "role")
    return resolve.groups_on_both_sides(spans, ["conv_id"], "grp", "role")


@query("""select conv_id, string_agg(role, ',' order by turn) || ',' || string_agg(turn::varchar, ',' order by turn) as proof from conversations group by 1""")
def kb_proof_concatenation(spark, d):
    from ferrule.operators.collect import ordered_list

    rows = table(spark, d, "conversations").groupBy("conv_id").agg(ordered_list(c("role"), c("turn"), c("role")).alias("a"), ordered_list(c("turn").cast("string"), c("turn")).alias("b"))
    return rows.select("conv_id", F.array_join(F.concat("a", "b"), ",").alias("proof"))


# Rules with variables


@query("""with recursive inside(a, b, round) as (
            select a, b, 1 from (select 'supplier:' || s_suppkey as a, 'nation:' || s_nationkey as b from supplier union select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation union select 'region:' || r_regionkey, 'world' from region)
            union select i.a, e.b, i.round + 1 from inside i join (select 'nation:' || n_nationkey as a, 'region:' || n_regionkey as b from nation union select 'region:' || r_regionkey, 'world' from region) e on i.b = e.a)
          select a, b, min(round)::int as round from inside group by 1, 2""")
def kb_rules_recursive(spark, d):
    edge = lambda name, a, b: table(spark, d, name).select(graph.node_id(a[0], c(a[1])).alias("a0"), b.alias("a1"))
    located = (
        edge("supplier", ("supplier", "s_suppkey"), graph.node_id("nation", c("s_nationkey"))).unionByName(edge("nation", ("nation", "n_nationkey"), graph.node_id("region", c("n_regionkey"))))
        .unionByName(edge("region", ("region", "r_regionkey"), F.lit("world")))
    )
    rules = [Rule(Literal("inside", ("X", "Y")), (Literal("located", ("X", "Y")),)), Rule(Literal("inside", ("X", "Z")), (Literal("inside", ("X", "Y")), Literal("located", ("Y", "Z"))))]
    return consequences({"located": located}, rules)["inside"].select(c("a0").alias("a"), c("a1").alias("b"), "round")


@query("""select distinct c_custkey as customer, l_suppkey as supplier from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey
          where o_orderstatus = 'F' and not exists (select 1 from lineitem x where x.l_orderkey = o_orderkey and x.l_returnflag = 'R')""")
def kb_rules_negated(spark, d):
    some = lambda name, *cols: table(spark, d, name).select(*[c(k).alias(f"a{i}") for i, k in enumerate(cols)])
    facts = {
        "customer": some("customer", "c_custkey", "c_nationkey"), "order": some("orders", "o_orderkey", "o_custkey", "o_orderstatus"), "line": some("lineitem", "l_orderkey", "l_suppkey"),
        "supplier": some("supplier", "s_suppkey", "s_nationkey"), "returned": table(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("a0")),
    }
    body = (Literal("customer", ("C", "N")), Literal("order", ("O", "C", "f")), Literal("line", ("O", "S")), Literal("supplier", ("S", "N")))
    facts["order"] = facts["order"].withColumn("a2", F.lower("a2"))  # upper-case letters are variables
    rule = Rule(Literal("near", ("C", "S")), body, unless=(Literal("returned", ("O",)),))
    return consequences(facts, [rule])["near"].select(c("a0").alias("customer"), c("a1").alias("supplier"))
