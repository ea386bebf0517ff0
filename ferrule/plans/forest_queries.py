"""Queries over parents, embeddings and closures of many small graphs, and over conditions of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import forest
from ferrule.plans.registry import query
from ferrule.sources.tables import staged, table

c = F.col


@query("""with recursive t as (select distinct conv_id, turn from conversations where turn is not null), e as (select t.conv_id, t.turn, b.turn as up from t left join t b on b.conv_id = t.conv_id and b.turn = t.turn // 2 and t.turn > 0),
  u as (select conv_id, turn, turn as top, 0 as depth from e where up is null union all select e.conv_id, e.turn, u.top, u.depth + 1 from e join u on e.conv_id = u.conv_id and e.up = u.turn)
  select conv_id, turn, top as root, depth::bigint as depth from u""")
def kb_roots(spark, d):
    """Each turn hangs below the turn of half its number, where its conversation has that."""
    turns = table(spark, d, "conversations").where("turn is not null").select("conv_id", "turn").distinct()
    halves = turns.where("turn > 0").withColumn("up", F.floor(c("turn") / 2).cast(turns.schema["turn"].dataType))
    above = halves.join(turns.withColumnRenamed("turn", "up"), ["conv_id", "up"])
    return forest.roots(turns.join(above, ["conv_id", "turn"], "left"), ["conv_id"], "turn", "up")


def _events(spark, d):
    """Each line of an order is an event with its supplier for a subject; its part's size class and the next supplier are what it names. Lines of returned goods stand in a context inside the others'."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_partkey", "l_returnflag")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    size = lambda k: (c(k) % 5).cast("string")
    return rows.select(
        c("l_orderkey").alias("document"), F.concat(F.lit("e"), c("l_linenumber").cast("string")).alias("event"), c("l_linenumber").alias("ordinal"), F.when(c("l_returnflag") == "R", "inner").otherwise("actual").alias("context"),
        F.concat(F.lit("s"), size("l_suppkey")).alias("subject"), F.array(F.concat(F.lit("p"), size("l_partkey")), F.concat(F.lit("s"), ((c("l_suppkey") + 1) % 5).cast("string"))).alias("objects"), F.array(F.concat(F.lit("p"), ((c("l_partkey") + 1) % 5).cast("string"))).alias("others"),
    )


_EVENTS = """with recursive x as (select l_orderkey as document, l_linenumber as k, min((l_suppkey, l_partkey, l_returnflag)) as m from lineitem group by 1, 2),
  v as (select document, k, case when m[3] = 'R' then 'inner' else 'actual' end as context, 's' || m[1] % 5 as subject, ['p' || m[2] % 5, 's' || (m[1] + 1) % 5] as objects, ['p' || (m[2] + 1) % 5] as others from x),
  r as (select e.document, e.k, min(p.k) as parent from v e join v p on e.document = p.document and e.k <> p.k and e.subject <> p.subject
        and ((e.context = p.context and list_contains(p.objects, e.subject)) or (e.context = 'inner' and p.context = 'actual' and list_has_any(p.objects, list_concat([e.subject], e.objects, e.others)))) group by 1, 2),
  walk(document, k, top, n) as (select document, k, parent, 1 from r union all select w.document, w.k, r.parent, n + 1 from walk w join r on w.document = r.document and w.top = r.k where n <= 8),
  round as (select distinct document from walk where n > 8)"""


@query(_EVENTS + """ select v.document, 'e' || v.k as event, case when round.document is null then 'e' || r.parent end as parent, round.document is not null as circular from v left join r on v.document = r.document and v.k = r.k left join round on v.document = round.document""")
def kb_embedding_parents(spark, d):
    events = staged(_events(spark, d), "events")
    contexts = events.select("document", F.lit("inner").alias("context"), F.lit("actual").alias("outer")).distinct()
    return forest.embedded(events, contexts, ["document"])


@query(_EVENTS + """, p as (select v.document, v.k, r.parent from v left join r on v.document = r.document and v.k = r.k where v.document not in (select document from round)),
  tree as (select document, k, k as owner from p where parent is null union all select p.document, p.k, tree.owner from p join tree on p.document = tree.document and p.parent = tree.k),
  about as (select distinct t.document, t.owner, o.ref from tree t join (select document, k, unnest(objects) as ref from v) o on t.document = o.document and t.k = o.k)
  select document, 'e' || owner as event, k::bigint as ordinal from tree union all select distinct a.document, 'e' || a.owner, 100 + substr(a.ref, 2)::bigint + case when a.ref[1] = 's' then 10 else 0 end from about a""")
def kb_owned_heads(spark, d):
    """An order's heads: one for each line, about its event and naming its objects, and one for each object that any line names, about that."""
    events = staged(_events(spark, d), "events")
    contexts = events.select("document", F.lit("inner").alias("context"), F.lit("actual").alias("outer")).distinct()
    placed = forest.embedded(events, contexts, ["document"]).where("not circular").select("document", "event", "parent")
    ref = c("ref")
    own = events.select("document", c("ordinal").cast("long").alias("ordinal"), F.lit("event").alias("name"), c("event").alias("low"), c("objects").alias("refs"))
    named = events.select("document", F.explode("objects").alias("ref")).distinct()
    number = F.lit(100) + F.substring(ref, 2, 9).cast("long") + F.when(ref.startswith("s"), 10).otherwise(0)
    named = named.select("document", number.alias("ordinal"), F.lit("entity").alias("name"), ref.alias("low"), F.array().cast("array<string>").alias("refs"))
    return forest.owned(own.unionByName(named), placed, ["document"])
