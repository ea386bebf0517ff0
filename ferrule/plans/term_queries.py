"""Queries over terms as tables of nodes: parts, calls, typed records, conditions merged up to renaming, one-way matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import terms as te
from ferrule.operators import patterns
from ferrule.operators import termtree as tt
from ferrule.plans.registry import query
from ferrule.sources.tables import spread, table

c = F.col


def _order_terms(spark, d):
    text = F.concat(F.lit("order("), c("o_orderkey").cast("string"), F.lit(", '"), c("o_orderpriority"), F.lit("', [status("), F.lower("o_orderstatus"), F.lit("), c("), c("o_custkey").cast("string"), F.lit(")])"))
    return table(spark, d, "orders").select(c("o_orderkey").alias("term"), text.alias("text"))


@query("""with o as (select o_orderkey as term, o_orderkey::varchar as k, '''' || o_orderpriority || '''' as p, 'status(' || lower(o_orderstatus) || ')' as s, 'c(' || o_custkey || ')' as c, lower(o_orderstatus) as st, o_custkey::varchar as ck from orders),
  w as (select *, '[' || s || ', ' || c || ']' as l from o), x as (select *, 'order(' || k || ', ' || p || ', ' || l || ')' as whole from w)
  select term, 0 as level, 1 as place, 'compound' as kind, 'order' as functor, whole as text, null as above from x
  union all select term, 1, 1, 'number', null, k, whole from x union all select term, 1, 2, 'atom', null, p, whole from x union all select term, 1, 3, 'list', null, l, whole from x
  union all select term, 2, 1, 'compound', 'status', s, l from x union all select term, 2, 2, 'compound', 'c', c, l from x
  union all select term, 3, 1, 'atom', null, st, s from x union all select term, 3, 1, 'number', null, ck, c from x""")
def kb_term_nodes(spark, d):
    found = tt.nodes(_order_terms(spark, d))
    above = found.select("term", c("node").alias("parent"), c("text").alias("above"))
    return found.join(above, ["term", "parent"], "left").select("term", "level", "place", "kind", "functor", "text", "above")


@query("""select o_orderkey as term, 'order(' || o_orderkey || ',''' || o_orderpriority || ''',[status(' || lower(o_orderstatus) || '),c(' || o_custkey || ')])' as text from orders""")
def kb_term_round_trip(spark, d):
    return tt.rendered(tt.nodes(_order_terms(spark, d)))


@query("""select l_orderkey as term, case when l_returnflag = 'R' then 'g_back' else 'g_part' end as functor, l_partkey::varchar as subject, l_returnflag = 'R' as negated, count(*) as n from lineitem group by all
  union all select l_orderkey, 'g_by', l_suppkey::varchar, false, count(*) from lineitem where l_returnflag <> 'R' group by all""")
def kb_body_calls(spark, d):
    """Bodies of clauses, an order's each, with a call for each line; the calls are read back from the text."""
    part, supplier = c("l_partkey").cast("string"), c("l_suppkey").cast("string")
    back = F.concat(F.lit("\\+ g_back("), part, F.lit(", 'came, (back''')"))
    said = F.when(c("l_returnflag") == "R", back).otherwise(F.concat(F.lit("g_part("), part, F.lit(", [g_by("), supplier, F.lit(")])")))
    bodies = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("term")).agg(F.concat(F.lit("head(X) :- "), F.array_join(F.sort_array(F.collect_list(said)), ", "), F.lit(".")).alias("text"))
    found = tt.calls(tt.nodes(tt.read_clauses(bodies), text="body"), "g_[a-z]+")
    return found.groupBy("term", "functor", F.get("arguments", F.lit(0)).alias("subject"), "negated").agg(F.count("*").alias("n"))


@query("""with b as (select distinct o_custkey as document, o_orderkey as sentence, o_orderstatus as s, o_orderpriority as p from orders),
  k as (select s, p, min((document, sentence)) as f, count(*) as sources from b group by 1, 2)
  select b.document, b.sentence, f[1] as first_document, f[2] as first_sentence, sources from b join k using (s, p)""")
def kb_exclusion_groups(spark, d):
    """Each order's exclusion has variables of its own names; those that say the same are one condition with its sources."""
    x, y = F.concat(F.lit("X"), c("o_orderkey").cast("string")), F.concat(F.lit("Y"), c("o_custkey").cast("string"))
    body = F.concat(te.call("entity", F.lit("actual"), x, te.quoted(c("o_orderpriority")), F.lit("_")), F.lit(", \\+ "), te.call("status", y, x, F.lower("o_orderstatus"), y))
    return tt.merged_conditions(table(spark, d, "orders").select(c("o_custkey").alias("document"), c("o_orderkey").alias("sentence"), body.alias("body")))


@query("""with s as (select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem), k as (select l_orderkey as term, count(*) as n from s group by 1)
  select l_orderkey as term, l_linenumber::bigint as number, l_partkey::varchar as part, l_quantity::bigint as amount, count(*) as times from s where l_quantity < 40 group by all""")
def kb_term_records(spark, d):
    """Lists of typed records, an order's each; records whose amount is no whole number are refused, those of 40 or more here."""
    amount = F.when(c("l_quantity") < 40, c("l_quantity").cast("long").cast("string")).otherwise(F.lit("many"))
    one = te.call("line", c("l_linenumber").cast("string"), F.concat(F.lit('"'), c("l_partkey").cast("string"), F.lit('"')), amount)
    texts = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("term")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(one)), ","), F.lit("]")).alias("text"))
    good, _ = tt.records(tt.nodes(texts), "line", {"number": "integer", "part": "text", "amount": "integer"})
    return good.groupBy("term", "number", "part", "amount").agg(F.count("*").alias("times"))


@query("""select b as pattern, p_partkey as term from (select distinct p_brand as b from part) join part on p_brand = b
  union all select 'twice', p_partkey from part where p_size = p_partkey % 50 union all select 'size ' || p_size, p_partkey from part""")
def kb_term_match(spark, d):
    """Patterns with variables made from the parts' brands and sizes, and one whose variable stands twice, matched to a term for each part."""
    parts = table(spark, d, "part")
    brand = F.concat(F.lit("'"), c("p_brand"), F.lit("'"))
    terms = spread(parts.select("p_partkey", "p_size", "p_brand", "p_type")).select(c("p_partkey").alias("term"), te.call("part", c("p_size").cast("string"), te.call("t", brand, F.concat(F.lit("'"), c("p_type"), F.lit("'"))), (c("p_partkey") % 50).cast("string")).alias("text"))
    patterns = (
        parts.select(c("p_brand").alias("term"), te.call("part", F.lit("_"), te.call("t", brand, F.lit("T")), F.lit("N")).alias("text")).distinct()
        .unionByName(parts.select(F.concat(F.lit("size "), c("p_size").cast("string")).alias("term"), te.call("part", c("p_size").cast("string"), F.lit("X"), F.lit("Y")).alias("text")).distinct())
        .unionByName(spark.range(1).select(F.lit("twice").alias("term"), F.lit("part(N,_,N)").alias("text")))
    )
    return tt.matched(tt.nodes(patterns), tt.nodes(terms))


@query("""with x as (select distinct l_orderkey as term, l_partkey as p, l_returnflag as f, l_shipdate as s from lineitem)
  select term, 'rest' as part, 'g_part(' || p || ')' as text from x where f = 'N' union all select term, 'rest', '\\+ g_part(' || p || ')' from x where f = 'A'
  union all select distinct term, 'scope', 'k' || p from x where f = 'R' union all select distinct term, 'supersession', strftime(s, '%Y%m%d') from x where f = 'R'""")
def kb_guard_split(spark, d):
    """Bodies of an order's clause with a guard for each line that came back; guards are set aside from the text."""
    part, day = c("l_partkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")
    guards = F.concat(F.lit("\\+ exclusion(k"), part, F.lit("), evaluation_date(V), satisfies(exactly, V, less, "), day, F.lit(")"))
    said = F.when(c("l_returnflag") == "R", guards).when(c("l_returnflag") == "A", F.concat(F.lit("\\+ g_part("), part, F.lit(")"))).otherwise(F.concat(F.lit("g_part("), part, F.lit(")")))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate").distinct()
    bodies = lines.groupBy(c("l_orderkey").alias("term")).agg(F.array_join(F.sort_array(F.collect_list(said)), ", ").alias("text"))
    found = patterns.guard_split(tt.nodes(bodies), "exclusion", "evaluation_date", "satisfies").select("term", "part", "text")
    rest, guarded = found.where("part = 'rest'"), found.where("part <> 'rest'").distinct()
    # Parts shipped on several days are one line each in the rest.
    return rest.unionByName(guarded)
