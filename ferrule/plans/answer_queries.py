"""Queries over readings of annotations, grades, preferences and run contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import quantities as qu
from ferrule.functions import readings as rd
from ferrule.plans.registry import query
from ferrule.sources.tables import table

c = F.col


@query("""select l_orderkey, l_linenumber, case l_returnflag when 'R' then 'occurs before' when 'A' then 'occurs after' end as near, case l_returnflag when 'R' then 'occurs after' when 'A' then 'occurs before' end as far,
          case l_returnflag when 'R' then 'before offset' when 'A' then 'after offset' else 'distance' end as offset_near, case l_returnflag when 'R' then 'before offset for' when 'A' then 'after offset for' else 'distance for' end as offset_far,
          'at least ' || l_linenumber || case when l_linenumber = 1 then ' day ' else ' days ' end || case l_returnflag when 'R' then 'before' when 'A' then 'after' else 'apart from' end as anchor_near,
          'at least ' || l_linenumber || case when l_linenumber = 1 then ' day ' else ' days ' end || case l_returnflag when 'R' then 'after' when 'A' then 'before' else 'apart from' end as anchor_far from lineitem""")
def kb_time_readings(spark, d):
    role = F.when(c("l_returnflag") == "R", "before").when(c("l_returnflag") == "A", "after").otherwise("within")
    order, offset = rd.both_ends(role, rd.ORDER), rd.both_ends(role, rd.OFFSET)
    anchor = rd.anchored(role, qu.reading(F.lit("geq"), c("l_linenumber"), F.lit("day")))
    ends = lambda s, a, b: (s["near"].alias(a), s["far"].alias(b))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *ends(order, "near", "far"), *ends(offset, "offset_near", "offset_far"), *ends(anchor, "anchor_near", "anchor_far"))


@query("""with g as (select distinct l_orderkey, l_linestatus as s, l_returnflag as r from lineitem),
          a as (select l_orderkey, s || '_' || r as label, case s when 'O' then 1 else 2 end as k from g)
          select l_orderkey, string_agg(replace(label, '_', ' '), ', ' order by k, label) as grade from a group by 1""")
def kb_grade_reading(spark, d):
    label = F.concat(F.lower("l_linestatus"), F.lit("_"), c("l_returnflag"))
    grades = F.array_sort(F.collect_set(F.struct(c("l_linestatus").alias("dimension"), label.alias("label"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(grades.alias("g")).select("l_orderkey", rd.grade_reading(c("g"), ("O", "F")).alias("grade"))


@query("""with q as (select conv_id, role, min(turn) as t from conversations group by 1, 2) select conv_id, string_agg(replace(role || '_turn', '_', ' '), ', ' order by t) as words from q group by 1""")
def kb_qualifier_reading(spark, d):
    from ferrule.operators.collect import ordered_list

    rows = table(spark, d, "conversations").groupBy("conv_id").agg(ordered_list(F.concat("role", F.lit("_turn")), c("turn")).alias("w"))
    return rows.select("conv_id", rd.qualifier_reading(c("w")).alias("words"))


@query("""select p_partkey, case when p_size % 3 = 0 then replace(p_brand, '_', ' ') else replace(p_brand, '_', ' ') || ' over ' || p_type end as said from part""")
def kb_preference_reading(spark, d):
    return table(spark, d, "part").select("p_partkey", rd.preference_reading(c("p_brand"), F.when(c("p_size") % 3 != 0, c("p_type"))).alias("said"))


@query("""select o_orderkey, case when o_orderstatus = 'P' then 'none' else 'date(' || strftime(o_orderdate::date, '%Y%m%d') || ')' end as term from orders""")
def kb_run_context(spark, d):
    day = F.when(c("o_orderstatus") != "P", F.date_format(c("o_orderdate").cast("date"), "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", rd.context_term(rd.real_day(day)).alias("term"))
