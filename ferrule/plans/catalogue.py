"""Named queries over the driver's tables, each with the SQL that states its result.

Facts come from the star schema: suppliers, customers and orders are entities, line items tie orders and suppliers to parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import arithmetic as ar
from ferrule.functions import quantities as qu
from ferrule.functions import strings as st
from ferrule.functions import terms as te
from ferrule.operators import answers, checks, collect, graph, logic, prove, text, windows
from ferrule.plans import answer_queries, builtin_queries, derivation_queries, forest_queries, frame_queries, network_queries, source_queries, term_queries  # noqa: F401  their queries are kept too
from ferrule.plans.registry import ORACLES, QUERIES, joined, query
from ferrule.sources.tables import spread, table
from ferrule.streaming import events as ev

__all__ = ["ORACLES", "QUERIES"]

c = F.col


# Conjunction, negation, quantifiers


@query("""select distinct r_name, n_name, c_mktsegment, s_suppkey from region join nation on r_regionkey = n_regionkey
          join supplier on s_nationkey = n_nationkey join customer on c_nationkey = n_nationkey""")
def kb_conjunctive_join(spark, d):
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    nation = table(spark, d, "nation").select(c("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name")
    supplier = table(spark, d, "supplier").select(c("s_nationkey").alias("n_nationkey"), "s_suppkey")
    # Only the segments of a nation matter, so customers are reduced before the join.
    segment = table(spark, d, "customer").select(c("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct()
    return logic.conjunction(supplier, nation, region, segment).select("r_name", "n_name", "c_mktsegment", "s_suppkey").distinct()


@query("""select l_orderkey, l_linenumber, l_partkey, l_quantity, p_size from lineitem join part on l_partkey = p_partkey
          where l_quantity >= p_size and p_size >= 40""")
def kb_theta_bound(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    part = table(spark, d, "part").where("p_size >= 40").select(c("p_partkey").alias("l_partkey"), "p_size")
    return items.join(part, "l_partkey").where(qu.satisfies(F.lit("eq"), c("l_quantity"), F.lit("geq"), c("p_size"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "p_size")


@query("""select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')""")
def kb_naf_anti(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey"))
    return logic.without(table(spark, d, "customer").select("c_custkey", "c_name"), urgent)


@query("""select o_orderkey, o_custkey from orders o where o_orderstatus = 'F'
          and not exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')
          and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')""")
def kb_scope_guard(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    excluded = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return logic.without(logic.without(orders, excluded), returned)


@query("""select s_suppkey, s_name from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R' and l_quantity > 49)""")
def kb_exists_semi(spark, d):
    bulky = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(c("l_suppkey").alias("s_suppkey"))
    return logic.exists(table(spark, d, "supplier").select("s_suppkey", "s_name"), bulky)


@query("""select l_orderkey from lineitem group by l_orderkey having count(distinct l_returnflag) = (select count(distinct l_returnflag) from lineitem)""")
def kb_relational_division(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    return logic.divide(items, "l_orderkey", "l_returnflag", items.select("l_returnflag"))


@query("""select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and not l_quantity > 10)""")
def kb_forall(spark, d):
    items = table(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_quantity")
    return logic.for_all(table(spark, d, "orders").select("o_orderkey"), items, c("l_quantity") > 10)


@query("""with f as (select o_custkey, min(o_orderkey) as k from orders where o_orderstatus = 'F' and o_totalprice > 450000 group by 1)
          select c_custkey, k as o_orderkey from customer left join f on o_custkey = c_custkey""")
def kb_ignore_left(spark, d):
    big = table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 450000").select(c("o_custkey").alias("c_custkey"), "o_orderkey")
    return logic.ignore(table(spark, d, "customer").select("c_custkey"), big, [c("o_orderkey")])


@query("""with o as (select o_custkey, o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT' and o_totalprice > 300000)
          select c_custkey, min(o_orderkey) as answer, 'then' as branch from customer join o on o_custkey = c_custkey group by 1
          union all select c_custkey, -1, 'else' from customer where c_custkey not in (select o_custkey from o)""")
def kb_if_then_else(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select(c("o_custkey").alias("c_custkey"), "o_orderkey")
    then, other = [c("c_custkey"), c("o_orderkey").alias("answer")], [c("c_custkey"), F.lit(-1).cast("long").alias("answer")]
    return logic.if_then_else(table(spark, d, "customer").select("c_custkey"), urgent, [c("o_orderkey")], then, other)


@query("""with o as (select o_custkey, o_orderkey from orders where o_orderstatus = 'P' and o_totalprice > 400000)
          select c_custkey, o_orderkey as answer, 'then' as branch from customer join o on o_custkey = c_custkey
          union all select c_custkey, -1, 'else' from customer where c_custkey not in (select o_custkey from o)""")
def kb_soft_cut(spark, d):
    big = table(spark, d, "orders").where("o_orderstatus = 'P' and o_totalprice > 400000").select(c("o_custkey").alias("c_custkey"), "o_orderkey")
    then, other = [c("c_custkey"), c("o_orderkey").alias("answer")], [c("c_custkey"), F.lit(-1).cast("long").alias("answer")]
    return logic.soft_cut(table(spark, d, "customer").select("c_custkey"), big, then, other)


@query("""select c_nationkey as nation, c_name as name, 0 as branch from customer where c_acctbal < 0
          union all select s_nationkey, s_name, 1 from supplier where s_acctbal < 0""")
def kb_disjunction(spark, d):
    left = table(spark, d, "customer").where("c_acctbal < 0").select(c("c_nationkey").alias("nation"), c("c_name").alias("name"))
    right = table(spark, d, "supplier").where("s_acctbal < 0").select(c("s_nationkey").alias("nation"), c("s_name").alias("name"))
    return logic.disjunction(left, right)


# Collecting


@query("""select c_custkey, coalesce(string_agg(o_orderkey, ',' order by o_orderkey), '') as found
          from customer left join orders on o_custkey = c_custkey and o_orderpriority = '2-HIGH' group by 1""")
def kb_findall_list(spark, d):
    orders = table(spark, d, "orders").where("o_orderpriority = '2-HIGH'").select(c("o_custkey").alias("c_custkey"), "o_orderkey")
    return collect.find_all(table(spark, d, "customer").select("c_custkey"), orders, "o_orderkey", ["o_orderkey"]).select("c_custkey", joined(c("found")).alias("found"))


@query("""select l_orderkey, l_returnflag, string_agg(l_partkey, ',' order by l_linenumber, l_partkey) as bag from lineitem group by 1, 2""")
def kb_bagof_groups(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")
    return collect.bag_of(items, ["l_orderkey", "l_returnflag"], "l_partkey", ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_returnflag", joined(c("bag")).alias("bag"))


@query("""select l_suppkey, string_agg(distinct p_brand, ',' order by p_brand) as brands from lineitem join part on l_partkey = p_partkey where p_size = 7 group by 1""")
def kb_setof_groups(spark, d):
    part = table(spark, d, "part").where("p_size = 7").select(c("p_partkey").alias("l_partkey"), "p_brand")
    goal = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(part, "l_partkey")
    return collect.set_of(goal, ["l_suppkey"], "p_brand").select("l_suppkey", joined(c("set")).alias("brands"))


@query("""select c_custkey, count(o_orderkey) as n, count(o_orderkey) = 0 as absent from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1""")
def kb_count_absent(spark, d):
    goal = table(spark, d, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return collect.count_with_zero(table(spark, d, "customer").select("c_custkey"), goal).withColumn("absent", c("n") == 0)


@query("""select l_orderkey, min(l_quantity) as least, max(l_quantity) as most, count(*) as n from lineitem group by 1""")
def kb_minmax_list(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.count("*").alias("n"))


@query("""select l_orderkey, l_returnflag, l_linestatus, min(l_linenumber) as first_line, count(*) as n, count(distinct l_partkey) as n_distinct,
          string_agg(l_partkey, ',' order by l_linenumber, l_partkey) as parts from lineitem group by 1, 2, 3""")
def kb_group_by_consequence(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")
    out = collect.grouped_in_order(items, ["l_orderkey", "l_returnflag", "l_linestatus"], ["l_linenumber", "l_partkey"], "l_partkey")
    return out.select("l_orderkey", "l_returnflag", "l_linestatus", c("first.l_linenumber").alias("first_line"), "n", "n_distinct", joined(c("values")).alias("parts"))


@query("""with l as (select distinct doc_id, unnest(string_split(text, chr(10))) as line from documents)
          select md5(line) as statement, doc_id, min(doc_id) over (partition by line) as first_doc from l where line <> ''""")
def kb_synthesize_points(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("text")).where("text <> ''")
    return collect.merged_statements(lines, "text", "doc_id", "doc_id").select(F.md5("text").alias("statement"), "doc_id", c("first").alias("first_doc"))


@query("""select l_suppkey, l_partkey, n, l_orderkey, l_linenumber from (
          select *, count(*) over (partition by l_suppkey, l_partkey) as n,
          row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber) as k from lineitem) where k = 1""")
def kb_representative_edge(spark, d):
    items = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return collect.representatives(items, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"])


_NODES = """nodes as (select 'region:' || r_regionkey as id, 'region' as kind, r_name as label from region
  union all select 'nation:' || n_nationkey, 'nation', n_name from nation union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier
  union all select 'customer:' || c_custkey, 'customer', c_name from customer union all select 'part:' || p_partkey, 'part', p_name from part
  union all select 'order:' || o_orderkey, 'order', 'order ' || o_orderkey from orders)"""
_EDGES = """edges as (select 'contains' as kind, 'order:' || l_orderkey as source, 'part:' || l_partkey as target, l_orderkey as document, l_linenumber as sentence, l_returnflag as scope from lineitem
  union all select 'supplies', 'supplier:' || l_suppkey, 'part:' || l_partkey, l_orderkey, l_linenumber, l_returnflag from lineitem
  union all select 'located', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, null, null, null from supplier
  union all select 'located', 'customer:' || c_custkey, 'nation:' || c_nationkey, null, null, null from customer
  union all select 'within', 'nation:' || n_nationkey, 'region:' || n_regionkey, null, null, null from nation)"""
_ENDS = """ends as (select source as node, target as peer from edges union all select target, source from edges)"""


@query(f"with {_NODES}, {_EDGES} select 'node ' || kind as what, count(*) as n from nodes group by 1 union all select 'edge ' || kind, count(*) from edges group by 1")
def kb_kind_census(spark, d):
    count = lambda df, what: df.groupBy(F.concat(F.lit(f"{what} "), "kind").alias("what")).agg(F.count("*").alias("n"))
    return count(graph.star_nodes(spark, d), "node").unionByName(count(graph.star_edges(spark, d), "edge"))


@query(f"""with {_EDGES}, s as (select kind, row_number() over (order by kind, source, target, coalesce(document, -1), coalesce(sentence, -1)) as k from edges)
           select kind, count(*) as total, count(*) filter (k <= 480) as shown, count(*) filter (k > 480) as removed from s group by 1""")
def kb_truncation_disclosure(spark, d):
    edges = graph.star_edges(spark, d).withColumn("doc", F.coalesce("document", F.lit(-1).cast("long"))).withColumn("sen", F.coalesce("sentence", F.lit(-1)))
    return collect.disclosed(edges, [c("kind"), c("source"), c("target"), c("doc"), c("sen")], 480, "kind")


# Along an order


@query("""with m as (select event_id, user_id, event_type, ts, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as new
          from events window w as (partition by user_id order by ts, event_id))
          select event_id, user_id, case when new = 1 then event_type else '' end as shown, sum(new) over (partition by user_id order by ts, event_id)::bigint as run from m""")
def kb_grade_runs(spark, d):
    return windows.shown_once_per_run(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "shown", "run")


@query("""select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before,
          row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1 or before <> event_type""")
def kb_adjacent_dedupe(spark, d):
    return windows.without_adjacent_repeats(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""select conv_id, turn, role, last_value(case when role = 'user' then md5(text) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as asked from conversations""")
def kb_running_marker(spark, d):
    rows = table(spark, d, "conversations")
    return windows.carried_forward(rows, ["conv_id"], ["turn"], F.when(c("role") == "user", F.md5("text")), "asked").select("conv_id", "turn", "role", "asked")


@query("""select event_id, user_id from (select event_id, user_id, epoch_us(ts) + (value * 1000000)::bigint * 60 as finish,
          lead(epoch_us(ts)) over (partition by user_id order by epoch_us(ts), epoch_us(ts) + (value * 1000000)::bigint * 60, event_id) as next from events) where next < finish""")
def kb_span_overlap(spark, d):
    at = F.unix_micros(c("ts").cast("timestamp"))
    spans = table(spark, d, "events").select("event_id", "user_id", at.alias("start"), (at + F.round(c("value") * 1000000).cast("long") * 60).alias("finish"))
    return windows.overlaps_next(spans, ["user_id"], "start", "finish", "event_id").select("event_id", "user_id")


@query("""with f as (select l_orderkey, l_returnflag, l_linestatus, min((l_linenumber, l_partkey)) as first from lineitem group by 1, 2, 3)
          select l_orderkey, l_returnflag, l_linestatus, row_number() over (partition by l_orderkey order by first, l_returnflag, l_linestatus)::bigint as number from f""")
def kb_variant_numbering(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")
    out = windows.variants(spread(items, "l_orderkey"), ["l_orderkey"], ["l_returnflag", "l_linestatus"], ["l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"])
    return out.select("l_orderkey", "l_returnflag", "l_linestatus", c("number").cast("long").alias("number"))


@query("""with m as (select user_id, ts, event_id, case when ts - lag(ts) over w > interval 6 hour or lag(ts) over w is null then 1 else 0 end as cut from events window w as (partition by user_id order by ts, event_id)),
          s as (select *, sum(cut) over (partition by user_id order by ts, event_id)::bigint as session from m)
          select user_id, session, epoch_us(min(ts)) as started, epoch_us(max(ts)) as ended, count(*) as n from s group by 1, 2""")
def kb_session_window(spark, d):
    out = windows.sessions(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 6 * 3600, "event_id")
    micros = lambda k: F.unix_micros(c(k).cast("timestamp")).alias(k)
    return out.select("user_id", "session", micros("started"), micros("ended"), "n")


@query("""select p.event_id as point, i.event_id as span from events p join events i on p.user_id = i.user_id and p.event_type = 'click' and i.event_type = 'view'
          and p.ts >= i.ts and p.ts < i.ts + interval 2 hour""")
def kb_interval_join(spark, d):
    rows = table(spark, d, "events")
    points = rows.where("event_type = 'click'").select("user_id", c("event_id").alias("point"), "ts")
    spans = rows.where("event_type = 'view'").select("user_id", c("event_id").alias("span"), c("ts").alias("start"), (c("ts") + F.expr("interval 2 hours")).alias("finish"))
    return windows.within_interval(points, spans, "user_id", "ts", "start", "finish", 7200).select("point", "span")


@query("""with p as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, least(l_partkey % 5, l_suppkey % 5) as a, greatest(l_partkey % 5, l_suppkey % 5) as b from lineitem)
          select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (partition by l_orderkey, a, b order by l_linenumber, l_partkey, l_suppkey) - 1 - (count(*) over (partition by l_orderkey, a, b) - 1) / 2.0 as off from p""")
def kb_parallel_offsets(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    end = lambda k: F.concat_ws("/", F.lpad(c("l_orderkey").cast("string"), 12, "0"), (c(k) % 5).cast("string"))
    out = windows.parallel_offsets(rows.withColumn("a", end("l_partkey")).withColumn("b", end("l_suppkey")), "a", "b", ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", c("offset").cast("double").alias("off"))


# Sorting and limits


@query("""select l_orderkey, string_agg(l_partkey, ',' order by l_partkey) as sorted from lineitem group by 1""")
def kb_sort_msort(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(joined(F.array_sort(F.collect_list("l_partkey"))).alias("sorted"))


@query("""select l_orderkey, string_agg(distinct l_suppkey, ',' order by l_suppkey desc) as sorted from lineitem group by 1""")
def kb_sort_dedupe(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(joined(F.sort_array(F.collect_set("l_suppkey"), asc=False)).alias("sorted"))


@query("""select l_orderkey, string_agg(l_returnflag || '-' || l_partkey, ',' order by l_returnflag, l_linenumber, l_partkey) as pairs from lineitem group by 1""")
def kb_keysort(spark, d):
    pair = F.concat_ws("-", "l_returnflag", "l_partkey")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(joined(collect.ordered_list(pair, c("l_returnflag"), c("l_linenumber"), c("l_partkey"))).alias("pairs"))


@query("""select o_orderkey, o_totalprice, k as n, (select count(*) from orders where o_orderstatus = 'F') > 32 as more from (
          select *, row_number() over (order by o_totalprice desc, o_orderkey)::int as k from orders where o_orderstatus = 'F') where k <= 32""")
def kb_answer_cap(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return logic.capped(orders, [F.desc("o_totalprice"), c("o_orderkey")], 32)


@query(f"""with {_NODES}, s as (select id, kind, label, case when lower(label) = 'ring' then 0 when lower(id) = 'ring' then 1 when lower(label) like 'ring%' then 2 when lower(label) like '% ring%' then 3
           when lower(label) like '%ring%' then 4 when lower(id) like '%ring%' then 5 else 6 end as score from nodes where kind = 'part' and lower(label) || ' ' || lower(id) || ' ' || kind like '%ring%')
           select id, kind, label, score from s order by score, label, kind, id limit 24""")
def kb_ranked_search(spark, d):
    return graph.search(graph.star_nodes(spark, d).where("kind = 'part'"), "ring")


@query("""select doc_id, source from documents where contains(lower(text), 'license') or contains(lower(source), 'license')""")
def kb_text_filter(spark, d):
    return table(spark, d, "documents").where(st.contains_ignoring_case(c("text"), F.lit("license")) | st.contains_ignoring_case(c("source"), F.lit("license"))).select("doc_id", "source")


@query("""select chr(k::int) as typed, (select p_name from part where starts_with(lower(p_name), chr(k::int)) order by p_partkey limit 1) as label from range(97, 123) t(k)
          where exists (select 1 from part where starts_with(lower(p_name), chr(k::int)))""")
def kb_typeahead(spark, d):
    part = table(spark, d, "part").select(F.lower(F.left("p_name", F.lit(1))).alias("typed"), "p_partkey", "p_name").where("typed between 'a' and 'z'")
    return part.groupBy("typed").agg(F.min_by("p_name", "p_partkey").alias("label"))


# Sets


@query("""with a as (select distinct c_nationkey as nation, c_mktsegment as segment from customer where c_acctbal < 0), b as (select distinct c_nationkey as nation, c_mktsegment as segment from customer where c_acctbal > 9000)
          select *, 'left' as only_in from (select * from a except select * from b) union all select *, 'right' from (select * from b except select * from a)""")
def kb_set_difference(spark, d):
    rows = table(spark, d, "customer").select(c("c_nationkey").alias("nation"), c("c_mktsegment").alias("segment"), "c_acctbal")
    return checks.named_differences(rows.where("c_acctbal < 0").drop("c_acctbal"), rows.where("c_acctbal > 9000").drop("c_acctbal"))


@query("""with a as (select o_orderkey, o_orderpriority as v from orders), b as (select o_orderkey, case when o_orderkey % 97 = 0 then 'changed' else o_orderpriority end as v from orders where o_orderkey % 101 <> 0)
          select o_orderkey, a.v as left_value, b.v as right_value from a full join b using (o_orderkey) where a.v is distinct from b.v""")
def kb_ordered_differential(spark, d):
    left = table(spark, d, "orders").select("o_orderkey", c("o_orderpriority").alias("v"))
    right = left.where("o_orderkey % 101 <> 0").withColumn("v", F.when(c("o_orderkey") % 97 == 0, "changed").otherwise(c("v")))
    return checks.keyed_differential(left, right, ["o_orderkey"], "v")


# Graph


@query("""with n as (select 'supplier:' || s_suppkey as id, s_nationkey as k from supplier union all select 'customer:' || c_custkey, c_nationkey from customer
            union all select 'nation:' || n_nationkey, n_nationkey from nation),
          r as (select id, n_regionkey as r from n join nation on n_nationkey = k union all select distinct 'region:' || n_regionkey, n_regionkey from nation)
          select id as node, min(id) over (partition by r) as component from r""")
def kb_components(spark, d):
    return graph.components(graph.star_edges(spark, d).where("kind in ('within', 'located')"))


@query(f"with {_EDGES}, {_ENDS} select node, count(*) as degree from ends group by 1")
def kb_degree(spark, d):
    return graph.degrees(graph.star_edges(spark, d))


@query(f"""with {_EDGES} select kind, case when source = 'part:7' then 'out' else 'in' end as direction, case when source = 'part:7' then target else source end as peer, document, sentence
           from edges where source = 'part:7' or target = 'part:7'""")
def kb_incident(spark, d):
    return graph.incident(graph.star_edges(spark, d), "part:7").select("kind", "direction", "peer", "document", "sentence")


def _reach(depth: int):
    sql = f"""with recursive {_EDGES}, ends as (select distinct source as node, target as peer from edges union select target, source from edges),
      b(node, depth) as (select 'supplier:1', 0 union select peer, depth + 1 from b join ends using (node) where depth < {depth}) select node, min(depth)::int as depth from b group by 1"""

    def run(spark, d):
        return graph.within_steps(graph.star_edges(spark, d), "supplier:1", depth)

    run.__name__ = f"kb_neighborhood_d{depth}"
    query(sql)(run)


for _depth in (1, 2, 3):
    _reach(_depth)


@query(f"""with recursive {_EDGES}, ends as (select distinct source as node, target as peer from edges union select target, source from edges),
  b(node, depth) as (select 'region:0', 0 union select peer, depth + 1 from b join ends using (node) where depth < 5)
  select 'part:3' as goal, min(depth)::int as length from b where node = 'part:3'""")
def kb_shortest_path_len(spark, d):
    path = graph.shortest_path(graph.star_edges(spark, d), "region:0", "part:3")
    return path.agg(F.max("step").alias("length")).select(F.lit("part:3").alias("goal"), "length")


@query(f"""with {_EDGES}, c as (select o_orderkey as d, o_orderpriority as p from orders)
           select distinct kind, source, target, document, sentence, scope from edges join c on d = document where p = '1-URGENT' and sentence <= 2 or p = '2-HIGH'""")
def kb_evidence_subgraph(spark, d):
    order = table(spark, d, "orders").select(c("o_orderkey").alias("document"), "o_orderpriority")
    line = order.where("o_orderpriority = '1-URGENT'").select("document", F.explode(F.array(F.lit(1), F.lit(2))).alias("sentence"))
    cited = line.unionByName(order.where("o_orderpriority = '2-HIGH'").select("document", F.lit(None).cast("int").alias("sentence")))
    # Only edges of line items have a document: lines are looked up, which are narrow, and their edges are made where they lie then.
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("document"), c("l_linenumber").cast("int").alias("sentence"), c("l_partkey").alias("part"), c("l_suppkey").alias("supplier"), c("l_returnflag").alias("scope"))
    return graph.line_edges(graph.evidence(lines, cited)).distinct()


_MAP = f"""with {_NODES}, {_EDGES}, {_ENDS}, hit as (select id as node from nodes where lower(label) || ' ' || id || ' ' || kind like '%ring%' order by case when lower(label) = 'ring' then 0 when lower(label) like 'ring%' then 2
    when ' ' || lower(label) like '% ring%' then 3 when lower(label) like '%ring%' then 4 else 5 end, label, kind, id limit 1),
  h1 as (select peer, count(*) as weight from ends where node = (select node from hit) group by 1 order by weight desc, peer limit 24),
  br as (select peer, weight, row_number() over (order by weight desc, peer)::int as branch from h1),
  h2 as (select branch, ends.peer, count(*) as weight from ends join br on ends.node = br.peer where ends.peer not in (select node from hit union select peer from br) group by 1, 2),
  own as (select peer, min(branch) as branch, arg_min(weight, branch) as weight from h2 group by 1),
  rk as (select *, row_number() over (partition by branch order by weight desc, peer) as k from own)
  select 0::int as round, 0::int as branch, node, 0::bigint as weight from hit union all select 1, branch, peer, weight from br union all select (k + 1)::int, branch, peer, weight from rk where k <= 4"""


@query(_MAP)
def kb_answer_map(spark, d):
    return graph.answer_map(graph.star_nodes(spark, d), graph.star_edges(spark, d), "ring")


@query("""select 'supplier:' || s_suppkey as id, 3 as depth, 'should,' || case when n_nationkey % 2 = 0 then '-' else 'may' end || ',' || case when n_regionkey % 2 = 0 then 'can' else 'must' end as chain
          from supplier join nation on s_nationkey = n_nationkey
          union all select 'nation:' || n_nationkey, 2, case when n_nationkey % 2 = 0 then '-' else 'may' end || ',' || case when n_regionkey % 2 = 0 then 'can' else 'must' end from nation
          union all select 'region:' || r_regionkey, 1, case when r_regionkey % 2 = 0 then 'can' else 'must' end from region""")
def kb_scope_chain(spark, d):
    pick = lambda k, a, b: F.when(c(k) % 2 == 0, a).otherwise(b).alias("operator")
    scopes = (
        table(spark, d, "supplier").select(graph.node_id("supplier", c("s_suppkey")).alias("id"), graph.node_id("nation", c("s_nationkey")).alias("parent"), F.lit("should").alias("operator"))
        .unionByName(table(spark, d, "nation").select(graph.node_id("nation", c("n_nationkey")).alias("id"), graph.node_id("region", c("n_regionkey")).alias("parent"), pick("n_nationkey", "-", "may")))
        .unionByName(table(spark, d, "region").select(graph.node_id("region", c("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), pick("r_regionkey", "can", "must")))
    )
    return graph.scope_chains(scopes).select("id", joined(c("chain")).alias("chain"), "depth")


@query("""select l_orderkey, l_linenumber, l_partkey, 'contains · ' || l_returnflag || case when l_linestatus <> l_returnflag then ' → ' || l_linestatus else '' end as label from lineitem""")
def kb_edge_label(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", graph.edge_label(F.lit("contains"), c("l_returnflag"), c("l_linestatus")).alias("label"))


@query(f"""with {_NODES}, {_EDGES}, bad as (select 'missing end' as rule, e.kind as kind, count(*) as n from (select kind, unnest([source, target]) as x from edges) e left join nodes on id = x and not (id like 'part:%9') where id is null group by 2)
  select rule, kind, n from bad""")
def kb_graph_integrity(spark, d):
    edges = graph.star_edges(spark, d)
    ends = edges.select("kind", F.explode(F.array("source", "target")).alias("id"))
    nodes = graph.star_nodes(spark, d).where("id not like 'part:%9'").select("id")  # without them there is something to find
    return checks.orphans(ends, nodes, ["id"]).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("missing end").alias("rule"), "kind", "n")


# Text


@query(r"""with w as (select p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '') as tw from part),
  s as (select p_partkey, tw, len(list_filter(['hot', 'ring', 'steel'], lambda x: list_contains(tw, x))) as k from w)
  select p_partkey, (case when array_to_string(tw, ' ') like '%hot ring%' then 1000 else 0 end + 320 * k + round(120.0 * k / greatest(len(tw), 1)))::int as score from s where k > 0""")
def kb_lexical_score(spark, d):
    words = st.ascii_words(F.concat_ws(" ", "p_name", "p_type"))
    asked = F.array(F.lit("hot"), F.lit("ring"), F.lit("steel"))
    rows = table(spark, d, "part").select("p_partkey", words.alias("tw"))
    score = text.lexical_score(asked, c("tw"), st.phrase_in(c("tw"), F.array(F.lit("hot"), F.lit("ring"))))
    return rows.where(F.arrays_overlap(asked, c("tw"))).select("p_partkey", score.cast("int").alias("score"))


_FOLD = r"regexp_replace(lower({}), '[\s.:;]+', '', 'g')"


@query(f"select doc_id, item_id, instr(h, n)::int - 1 as at from (select doc_id, {_FOLD.format('text')} as h from documents), (select item_id, {_FOLD.format('text')} as n from benchmark) where instr(h, n) > 0")
def kb_passage_whole(spark, d):
    pages, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", c("text").alias("passage"))
    return text.located(pages, items, "text", "passage", "doc_id", "item_id")


@query("""select item_id, other, (select max(k) from range(20, least(length(a), length(b))) t(k) where right(a, k::int) = left(b, k::int))::int as size from (
          select x.item_id, y.item_id as other, x.text || left(y.text, 20 + (y.item_id % 17)::int) as a, y.text as b from benchmark x join benchmark y on y.item_id = x.item_id + 1)""")
def kb_passage_prefix(spark, d):
    items = table(spark, d, "benchmark")
    nxt = items.select((c("item_id") - 1).alias("item_id"), c("item_id").alias("other"), c("text").alias("b"))
    pairs = items.select("item_id", c("text").alias("t")).join(nxt, "item_id").withColumn("a", F.concat("t", F.substr(c("b"), F.lit(1), (20 + c("other") % 17).cast("int"))))
    return pairs.select("item_id", "other", text.longest_continuation(c("a"), c("b")).alias("size"))


@query("""select doc_id, 0 as ord, null::int as grp, substr(text, 1, 3) as piece from documents where length(text) > 20 union all select doc_id, 1, 1, substr(text, 4, 5) from documents where length(text) > 20
          union all select doc_id, 2, null, substr(text, 9, 2) from documents where length(text) > 20 union all select doc_id, 3, 2, substr(text, 11, 10) from documents where length(text) > 20
          union all select doc_id, 4, null, substr(text, 21) from documents where length(text) > 20""")
def kb_alignment_segments(spark, d):
    span = lambda a, b, g: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(g).alias("grp"))
    rows = table(spark, d, "documents").where(F.length("text") > 20).select("doc_id", "text", F.array(span(3, 8, 1), span(10, 20, 2)).alias("spans"))
    return text.segments(rows, "doc_id", "text", "spans")


@query(r"""select doc_id, len(w)::bigint as n, len(list_distinct(w))::bigint as n_distinct, md5(array_to_string(w, ' ')) as words from (
          select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents)""")
def kb_tokenize(spark, d):
    rows = table(spark, d, "documents").select("doc_id", st.ascii_words(c("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("words"))


@query("""with g as (select o_custkey, list(o_orderkey::varchar order by o_orderkey) as x from orders where o_orderpriority = '5-LOW' and o_totalprice > 350000 group by 1)
          select o_custkey, case len(x) when 1 then x[1] when 2 then x[1] || ' and ' || x[2] else array_to_string(x[:-2], ', ') || ', and ' || x[-1] end as said from g""")
def kb_coordinate(spark, d):
    rows = table(spark, d, "orders").where("o_orderpriority = '5-LOW' and o_totalprice > 350000").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
    return rows.select("o_custkey", st.coordinated(F.transform("x", lambda v: v.cast("string"))).alias("said"))


# Builtins


@query("""select distinct l_orderkey as a, l_partkey - 800 as b, (l_orderkey % 17)::bigint as x, l_orderkey + l_partkey - 800 as s, l_orderkey * (l_partkey - 800) as p, (((l_orderkey - 7000) % 13) + 13) % 13 as m,
          (l_orderkey - 7000) % 13 as r, trunc((l_orderkey - 7000) / 13.0)::bigint as t, floor((l_orderkey - 7000) / 13.0)::bigint as f, gcd(l_orderkey, l_partkey)::bigint as g, power(3, l_orderkey % 17)::bigint as pw,
          (length(ltrim(bin(l_partkey + 1), '0')) - 1)::int as tb, abs(l_partkey - 800) as ab, sign(l_partkey - 800)::bigint as sg, round(sqrt(l_partkey), 6) as sq, round(ln(l_partkey + 1), 6) as lg from lineitem""")
def kb_bounded_arith(spark, d):
    a, b, k = c("l_orderkey"), c("l_partkey") - 800, c("l_orderkey") - 7000
    x = (a % 17).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().select(
        a.alias("a"), b.alias("b"), x.alias("x"), ar.bounded(a + b).alias("s"), ar.bounded(a * b).alias("p"), ar.modulo(k, F.lit(13)).alias("m"), ar.remainder(k, F.lit(13)).alias("r"),
        ar.truncated(k, F.lit(13)).alias("t"), ar.floored(k, F.lit(13)).alias("f"), ar.greatest_divisor(a, c("l_partkey")).alias("g"), ar.integer_power(F.lit(3).cast("long"), x).alias("pw"),
        ar.top_bit(c("l_partkey") + 1).alias("tb"), F.abs(b).alias("ab"), F.signum(b).cast("long").alias("sg"), F.round(F.sqrt("l_partkey"), 6).alias("sq"), F.round(F.ln(c("l_partkey") + 1), 6).alias("lg"),
    )


@query("""with t as (select 'integer' as kind, p_size::double as num, p_size::varchar as text from part union select 'float', p_retailprice, p_retailprice::varchar from part
          union select 'atom', 0, p_type from part union select 'string', 0, p_name from part)
          select kind, text, row_number() over (order by case kind when 'integer' then 1 when 'float' then 1 when 'atom' then 3 else 4 end, num, case kind when 'float' then 0 when 'integer' then 2 else 0 end, case when kind in ('atom', 'string') then text else '' end)::int as place from t
          where kind <> 'float' or text not in (select text from t where kind = 'integer')""")
def kb_term_order(spark, d):
    part = table(spark, d, "part")
    none = F.lit(0.0)
    terms = (
        part.select(F.lit("integer").alias("kind"), c("p_size").cast("double").alias("num"), c("p_size").cast("string").alias("text"))
        .union(part.select(F.lit("float"), "p_retailprice", c("p_retailprice").cast("string")))
        .union(part.select(F.lit("atom"), none, "p_type")).union(part.select(F.lit("string"), none, "p_name")).distinct()
    )
    key = te.order_key(c("kind"), c("num"), F.when(c("kind").isin("atom", "string"), c("text")))
    return windows.numbered(terms, key, "place").select("kind", "text", c("place").cast("int").alias("place"))


@query(r"""select p_partkey, lower(p_name) as low, upper(p_type) as up, length(p_name)::int as n, p_name || '/' || p_brand as cat, contains(lower(p_name), 'ing') as icase, ascii(p_name)::int as code, instr(p_name, 'i')::int - 1 as first_i,
          array_to_string(list_transform(string_split(p_name, ' '), lambda x: trim(x, 'rt')), '|') as pieces, substr(p_name, 2, 3) as sub,
          case when regexp_matches(p_brand, '^[a-z][a-zA-Z0-9_]*$') then p_brand else '''' || p_brand || '''' end as quoted from part""")
def kb_string_builtins(spark, d):
    name = c("p_name")
    at = st.occurrences(name, F.lit("i"))
    return table(spark, d, "part").select(
        "p_partkey", F.lower("p_name").alias("low"), F.upper("p_type").alias("up"), F.length("p_name").alias("n"), F.concat(name, F.lit("/"), c("p_brand")).alias("cat"),
        st.contains_ignoring_case(name, F.lit("ING")).alias("icase"), F.get(st.code_points(name), F.lit(0)).alias("code"), F.coalesce(F.get(at, F.lit(0)), F.lit(-1)).alias("first_i"),
        F.array_join(st.split_and_strip(name, " ", "rt"), "|").alias("pieces"), F.substring("p_name", 2, 3).alias("sub"), te.quoted(c("p_brand")).alias("quoted"),
    )


@query("""select vec_id, len(embedding)::int as n, list_contains(x, 3) as has3, array_to_string(list_sort(x), ',') as sorted, array_to_string(list_sort(list_distinct(x)), ',') as uniq, list_max(x) as most, list_min(x) as least,
          array_to_string(x || [label], ',') as app, x[2] as second from (select *, list_transform(embedding, lambda v: floor(v * 20)::int) as x from embeddings)""")
def kb_array_builtins(spark, d):
    # Single precision, as the SQL multiplies.
    rows = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: F.floor(v * F.lit(20).cast("float")).cast("int")))
    has3 = F.coalesce(F.array_contains("x", 3), F.when(c("x").isNotNull(), F.lit(False)))
    return rows.select(
        "vec_id", F.size("embedding").alias("n"), has3.alias("has3"), joined(F.array_sort("x")).alias("sorted"), joined(F.array_sort(F.array_distinct("x"))).alias("uniq"), F.array_max("x").alias("most"),
        F.array_min("x").alias("least"), joined(F.concat("x", F.array("label"))).alias("app"), F.get("x", F.lit(1)).alias("second"),
    )


@query("""select distinct l_quantity::int as quantity, l_linenumber, case l_returnflag when 'R' then 'at least ' when 'A' then 'at most ' else '' end || l_quantity::int || case when l_quantity = 1 then ' unit' else ' units' end as reading,
          case l_returnflag when 'R' then l_quantity::int >= 20 when 'A' then false else l_quantity::int >= 20 end as enough,
          case l_returnflag when 'A' then l_quantity::int * 60 <= 1800 else false end as brief from lineitem""")
def kb_quantity_reading(spark, d):
    n = c("l_quantity").cast("int")
    cmp = F.when(c("l_returnflag") == "R", "geq").when(c("l_returnflag") == "A", "leq").otherwise("eq")
    return table(spark, d, "lineitem").select(
        n.alias("quantity"), "l_linenumber", qu.reading(cmp, n, F.lit("unit")).alias("reading"), qu.satisfies(cmp, n, F.lit("geq"), F.lit(20)).alias("enough"),
        qu.satisfies_in_units(cmp, n, F.lit("minute"), F.lit("leq"), F.lit(1800), F.lit("second")).alias("brief"),
    ).distinct()


@query("""select p_partkey, (p_size * 6 // gcd(p_size * 6, 35))::bigint as pn, (35 // gcd(p_size * 6, 35))::bigint as pd, (p_size * 5 // gcd(p_size * 5, 42))::bigint as qn, (42 // gcd(p_size * 5, 42))::bigint as qd from part""")
def kb_quantity_product(spark, d):
    n = lambda v: F.lit(v).cast("long")
    size = c("p_size").cast("long")
    rows = table(spark, d, "part").select("p_partkey", qu.product(size, n(5), n(6), n(7)).alias("p"), qu.quotient(size, n(7), n(6), n(5)).alias("q"))
    return rows.select("p_partkey", c("p.n").alias("pn"), c("p.d").alias("pd"), c("q.n").alias("qn"), c("q.d").alias("qd"))


# Derivation


@query("""select o_orderkey, o_orderpriority, o_orderkey % 5 <> 0 or date '1998-01-01' < o_orderdate::date as derived from orders where o_orderstatus = 'F'""")
def kb_supersession(spark, d):
    statements = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    records = table(spark, d, "orders").where("o_orderkey % 5 = 0 and o_orderstatus = 'F'").select("o_orderkey", c("o_orderdate").alias("date"))
    return prove.superseded(statements, records, "o_orderkey", "1998-01-01")


def _rules(spark, d):
    """Facts of places, and rules that pass membership up from suppliers through nations to regions; a region is served unless it is barred."""
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    call = lambda name, k: te.call(name, c(k).cast("string"))
    facts = supplier.select(call("active", "s_suppkey").alias("goal")).unionByName(table(spark, d, "region").where("r_regionkey = 2").select(call("barred", "r_regionkey").alias("goal")))
    no, yes = F.lit(False).alias("negated"), F.lit(True).alias("negated")
    reg = nation.select(c("n_regionkey").alias("r"), "n_nationkey", F.concat(F.lit("r:"), c("n_nationkey").cast("string")).alias("rule"))
    rules = (
        supplier.select(F.concat(F.lit("n:"), c("s_suppkey").cast("string")).alias("rule"), call("supplied", "s_nationkey").alias("head"), call("active", "s_suppkey").alias("goal"), no)
        .unionByName(reg.select("rule", call("served", "r").alias("head"), call("supplied", "n_nationkey").alias("goal"), no))
        .unionByName(reg.select("rule", call("served", "r").alias("head"), call("barred", "r").alias("goal"), yes))
        .unionByName(table(spark, d, "region").select(F.concat(F.lit("w:"), c("r_regionkey").cast("string")).alias("rule"), F.lit("world").alias("head"), call("served", "r_regionkey").alias("goal"), no))
    )
    return facts, rules


@query("""select 'active(' || s_suppkey || ')' as goal, 0 as round, 'fact' as via from supplier union all select 'barred(2)', 0, 'fact' from region where r_regionkey = 2
  union all select 'supplied(' || s_nationkey || ')', 1, min('n:' || s_suppkey) from supplier group by s_nationkey
  union all select 'served(' || n_regionkey || ')', 2, min('r:' || n_nationkey) from nation where n_nationkey in (select s_nationkey from supplier) and n_regionkey <> 2 group by n_regionkey
  union all select 'world', 3, min('w:' || n_regionkey) from nation where n_nationkey in (select s_nationkey from supplier) and n_regionkey <> 2""")
def kb_prove_depth(spark, d):
    facts, rules = _rules(spark, d)
    return prove.derive(facts, rules, 4)


@query("""select 'supplied(' || n_nationkey || ')' as goal, case when n_nationkey in (select s_nationkey from supplier) then 'proved' else 'failed' end as status, case when n_nationkey in (select s_nationkey from supplier) then 'failed' else 'proved' end as negated from nation
  union all select 'served(' || r_regionkey || ')', case when s then 'limit' else 'failed' end, case when s then 'limit' else 'proved' end from (
  select r_regionkey, r_regionkey <> 2 and exists (select 1 from nation join supplier on n_nationkey = s_nationkey where n_regionkey = r_regionkey) as s from region)""")
def kb_prove_naf_status(spark, d):
    facts, rules = _rules(spark, d)
    goals = table(spark, d, "nation").select(te.call("supplied", c("n_nationkey").cast("string")).alias("goal")).unionByName(table(spark, d, "region").select(te.call("served", c("r_regionkey").cast("string")).alias("goal")))
    found = prove.status(goals, facts, rules, 1)
    return found.join(prove.negation_status(found).withColumnRenamed("status", "negated"), "goal")


@query("""with v as (select n_regionkey as r, min('r:' || n_nationkey) as via from nation where n_nationkey in (select s_nationkey from supplier) and n_regionkey <> 2 group by 1),
  n as (select r, n_nationkey as k from v join nation on 'r:' || n_nationkey = via), s as (select r, min('n:' || s_suppkey) as via from n join supplier on s_nationkey = k group by 1)
  select 'served(' || r || ')' as root, 'fact' as kind, 'active(' || substr(via, 3) || ')' as goal, 2 as first_depth from s union all select 'served(' || r || ')', 'negation', 'barred(' || r || ')', 1 from v""")
def kb_proof_leaves(spark, d):
    facts, rules = _rules(spark, d)
    known = prove.derive(facts, rules, 4)
    roots = known.where("goal like 'served%'").select("goal")
    return prove.distinct_leaves(prove.proof_steps(known, rules, roots, 4))


# Answers


@query("""with k as (select l_orderkey as o, min(l_linenumber) as place, 'qualifier' as kind, l_returnflag as value from lineitem group by 1, 4 union all select l_orderkey, min(l_linenumber), 'grade', l_linestatus from lineitem where l_quantity > 40 group by 1, 4)
  select o_orderkey, (select string_agg(value, ', ' order by place, value) from k where o = o_orderkey and kind = 'qualifier') as qualifier, (select string_agg(value, ', ' order by place, value) from k where o = o_orderkey and kind = 'grade') as grade,
  not exists (select 1 from k where o = o_orderkey) as missing from orders""")
def kb_marks_view(spark, d):
    items = table(spark, d, "lineitem")
    mark = lambda df, kind, value: df.select(c("l_orderkey").alias("o_orderkey"), c("l_linenumber").alias("place"), F.lit(kind).alias("kind"), c(value).alias("value"))
    given = mark(items, "qualifier", "l_returnflag").unionByName(mark(items.where("l_quantity > 40"), "grade", "l_linestatus"))
    return answers.marks(table(spark, d, "orders").select("o_orderkey"), given, "o_orderkey").select("o_orderkey", "qualifier", "grade", "missing")


@query("""select p_partkey, case when p_size > 40 then 'If the part is large, ' || 'the ' || p_name || ' should not be used.' when p_size < 5 then 'When any applies: the part is small; the part is cheap, the ' || p_name || ' should be checked.'
  else 'The ' || p_name || ' should be stored and labelled.' end as said from part""")
def kb_render_advice(spark, d):
    none = F.array().cast("array<string>")
    conditions = F.when(c("p_size") > 40, F.array(F.lit("the part is large"))).when(c("p_size") < 5, F.array(F.lit("the part is small"), F.lit("the part is cheap"))).otherwise(none)
    mods = F.array().cast("array<struct<preposition:string,value:string>>")
    act = lambda polarity, verb, obj: answers.action_text(F.lit(polarity), F.lit(verb), F.lit(obj), mods, none)
    actions = F.when(c("p_size") > 40, F.array(act("negative", "be used", None))).when(c("p_size") < 5, F.array(act("positive", "be checked", None))).otherwise(F.array(F.lit("be stored"), F.lit("labelled")))
    return table(spark, d, "part").select("p_partkey", answers.rule_text(conditions, F.concat(F.lit("the "), "p_name"), F.lit("should"), actions).alias("said"))


@query("""select o_custkey, 'solutions([' || string_agg('sol([' || o_orderpriority || ',' || o_orderstatus || '])', ',' order by o_orderpriority, o_orderstatus) || '])' as answer
  from (select distinct o_custkey, o_orderpriority, o_orderstatus from orders) group by 1""")
def kb_serialize_answer(spark, d):
    return answers.serialised(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus"), ["o_custkey"], ["o_orderpriority", "o_orderstatus"], ["o_orderpriority", "o_orderstatus"])


@query("""with r as (select conv_id, turn, text, sum(length(text) + 1) over (partition by conv_id order by turn) as run from conversations)
  select conv_id, turn, sum((run > 8000)::int) over (partition by conv_id)::bigint as hidden from r qualify run <= 8000""")
def kb_result_text_cap(spark, d):
    return answers.text_budget(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text", 8000).select("conv_id", "turn", c("hidden").cast("long").alias("hidden"))


# Turns and events


@query("""with q as (select conv_id, turn, 'q' || row_number() over (partition by conv_id order by turn) as call from conversations where role = 'user')
  select conv_id, turn as segment, case when turn % 3 = 0 then 'model' when exists (select 1 from q where q.conv_id = a.conv_id and q.call = 'q' || (a.turn // 2 + case when a.turn % 5 = 0 then 9 else 0 end)) then 'kb' else 'unverified' end as label
  from conversations a where role = 'assistant'""")
def kb_citation_audit(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    ran = ev.call_ids(rows.where("role = 'user'"), "conv_id", ["turn"])
    cited = F.array(F.concat(F.lit("q"), (F.floor(c("turn") / 2) + F.when(c("turn") % 5 == 0, 9).otherwise(0)).cast("string")))
    segments = rows.where("role = 'assistant'").select("conv_id", c("turn").alias("segment"), F.when(c("turn") % 3 == 0, "model").otherwise("kb").alias("source"), cited.alias("cited"))
    return ev.audited(segments, ran, ["conv_id"]).select("conv_id", "segment", "label")


@query("""select conv_id, turn, 'q' || row_number() over (partition by conv_id order by turn) as call from conversations where role = 'user'""")
def kb_call_ids(spark, d):
    return ev.call_ids(table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn"), "conv_id", ["turn"])


@query("""select event_id, event_type, json_extract(props, '$.k')::int as k from events""")
def kb_event_decode(spark, d):
    return ev.decoded_props(table(spark, d, "events")).select("event_id", "event_type", "k")


@query("""select date_trunc('hour', ts)::varchar as started, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def kb_event_windows(spark, d):
    out = ev.windowed_counts(table(spark, d, "events"))
    return out.select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with b as (select vec_id as id, embedding[1]::double * 100 as x, embedding[2]::double * 100 as y, 0.6::double as w, 0.3::double as h from embeddings)
  select a.id as a, b.id as b, round(least(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) + 0.2, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) + 0.2), 6) as gap from b a join b b on a.id < b.id
  and greatest(a.x, b.x) - 0.1 < least(a.x + a.w, b.x + b.w) + 0.1 and greatest(a.y, b.y) - 0.1 < least(a.y + a.h, b.y + b.h) + 0.1""")
def kb_box_overlap(spark, d):
    boxes = table(spark, d, "embeddings").select(c("vec_id").alias("id"), (F.get("embedding", F.lit(0)).cast("double") * 100).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 100).alias("y"), F.lit(0.6).alias("w"), F.lit(0.3).alias("h"))
    return checks.separation(boxes, 0.1).select("a", "b", F.round("gap", 6).alias("gap"))


@query("""select doc_id, case when quality = 1 and toxic = 0 then 'approved' when quality = 0 then 'rejected' when toxic = 1 then 'contested' else 'unreviewed' end as label from documents left join labels using (doc_id)""")
def kb_review_labels(spark, d):
    label = F.when((c("quality") == 1) & (c("toxic") == 0), "approved").when(c("quality") == 0, "rejected").when(c("toxic") == 1, "contested").otherwise("unreviewed")
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", label.alias("label"))
