"""Queries over frames of sentences: variants by body, what events aim at, where frames start."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import frames as fr
from ferrule.plans.registry import query
from ferrule.sources.tables import table

c = F.col


@query("""with f as (select o_custkey as k, o_orderpriority as p, min(o_orderkey) as first from orders group by 1, 2), n as (select *, row_number() over (partition by k order by first) as variant from f)
  select 'customers' as document, o_custkey as sentence, variant::int as variant, o_orderkey as line, 'event(actual,V0,' || lower(o_orderstatus) || ')' as head, 'entity(actual,V0,''' || o_orderpriority || ''')' as body from orders join n on k = o_custkey and p = o_orderpriority""")
def kb_frames(spark, d):
    """Each order a clause of its customer's sentence, with a variable of its own name; those of one priority share a body."""
    x = F.concat(F.lit("X"), c("o_orderkey").cast("string"))
    head = F.concat(F.lit("event(actual,"), x, F.lit(","), F.lower("o_orderstatus"), F.lit(")"))
    body = F.concat(F.lit("entity(actual,"), x, F.lit(",'"), c("o_orderpriority"), F.lit("')"))
    return fr.framed(table(spark, d, "orders").select(F.lit("customers").alias("document"), c("o_custkey").alias("sentence"), c("o_orderkey").alias("line"), head.alias("head"), body.alias("body")))


def _view(spark, d):
    """An order's first line says what came back (an object), what was kept (a size, for a supplier) or what was sent (with a supplier); urgent customers take the part."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("l")).select("l_orderkey", "l.*")
    rows = line.join(table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    part, supplier = F.concat(F.lit("p"), c("l_partkey").cast("string")), F.concat(F.lit("s"), c("l_suppkey").cast("string"))
    said = (
        F.when(c("l_returnflag") == "R", F.concat(F.lit("entity(actual,P,"), part, F.lit("), event(actual,E,return), arg(actual,E,2,P)")))
        .when(c("l_returnflag") == "A", F.concat(F.lit("property(actual,P,size), event(actual,E,keep), arg(actual,E,2,P), pp(actual,E,for,S), entity(actual,S,"), supplier, F.lit(")")))
        .otherwise(F.concat(F.lit("event(actual,E,send), pp(actual,E,with,S), entity(actual,S,"), supplier, F.lit(")")))
    )
    takes = F.concat(F.lit(", event(actual,T,take), arg(actual,T,1,C), entity(actual,C,customer), arg(actual,T,2,Q), entity(actual,Q,"), part, F.lit(")"))
    body = F.concat(said, F.when(c("o_orderpriority") == "1-URGENT", takes).when(c("o_orderpriority") == "2-HIGH", F.concat(F.lit(", \\+ (event(actual,T,take), arg(actual,T,2,Q), entity(actual,Q,"), part, F.lit("))"))).otherwise(F.lit("")))
    clauses = rows.select(F.lit("orders").alias("document"), c("l_orderkey").alias("sentence"), c("l_linenumber").alias("line"), F.lit("event(actual,H,do)").alias("head"), body.alias("body"))
    return fr.viewed(fr.literals(fr.framed(clauses)))


_FIRST = """with l as (select l_orderkey as k, min((l_linenumber, l_partkey, l_suppkey, l_returnflag)) as m from lineitem group by 1), v as (select k, m[2] as p, m[3] as s, m[4] as f, o_orderpriority as priority from l join orders on o_orderkey = k)"""


@query(_FIRST + """ select k as sentence, case f when 'R' then 'return' when 'A' then 'keep' else 'send' end as verb, case f when 'R' then 'T1' when 'A' then 'T2' else 'T3' end as rule, case f when 'R' then 'p' || p else 's' || s end as noun,
  case when f = 'A' then 'size' end as property, case f when 'A' then 'for' when 'R' then null else 'with' end as prep from v union all select k, 'take', 'T1', 'p' || p, null, null from v where priority in ('1-URGENT', '2-HIGH')""")
def kb_frame_targets(spark, d):
    view = _view(spark, d)
    found = fr.targets(view, spark.range(1).select(F.lit("send").alias("verb"), F.lit("with").alias("prep")))
    verbs = view.events.select(*fr.FRAME, c("ref").alias("event"), "verb")
    return found.join(verbs, [*fr.FRAME, "event"]).select("sentence", "verb", "rule", "noun", "property", "prep")


@query(_FIRST + """, x as (select k, 1 as part, 'p' || p as concept from v where priority = '1-URGENT' union all select k, 2, 'p' || p from v where f = 'R')
  select k as sentence, row_number() over (partition by k order by part)::int as place, concept from (select k, concept, min(part) as part from x group by 1, 2)""")
def kb_frame_starts(spark, d):
    return fr.starts(_view(spark, d), ["customer"], ["return"]).select("sentence", "place", "concept")
