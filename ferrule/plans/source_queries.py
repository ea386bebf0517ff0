"""Queries that write rows of the tables in a source's format into the shared folder and read them back, and others over operators of small reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import arithmetic as ar
from ferrule.functions import readings as rd
from ferrule.functions import strings as st
from ferrule.functions import terms as te
from ferrule.operators import codebook, logic, prove
from ferrule.operators import text as located
from ferrule.plans.registry import query
from ferrule.sources import committed
from ferrule.sources import provenance as pv
from ferrule.sources import text as sources
from ferrule.sources.tables import shared_dir, table

c = F.col


def _written(df: DataFrame, label: str) -> str:
    """Writes a column of texts, a row's each with newlines of its own if it likes, and returns the folder."""
    path = f"{shared_dir(df.sparkSession)}/sources/{label}-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def _fields(*columns):
    return F.concat_ws("\t", *[x.cast("string") for x in columns])


@query("""select o_orderkey::int as sentence, 'fact' as kind, 'status' as predicate, o_orderkey || ', ' || lower(o_orderstatus) as arguments, null as body from orders
  union all select o_orderkey, 'rule', 'urgent', 'X', 'order(X, ' || o_custkey || '), \\+ done(X)' from orders where o_orderpriority = '1-URGENT'""")
def kb_clause_sites(spark, d):
    """Each order a marked block of clauses in text files that are read by ranges."""
    key = c("o_orderkey").cast("string")
    fact = F.concat(F.lit("status("), key, F.lit(", "), F.lower("o_orderstatus"), F.lit(")."))
    rule = F.when(c("o_orderpriority") == "1-URGENT", F.concat(F.lit("urgent(X) :- order(X, "), c("o_custkey").cast("string"), F.lit("), \\+ done(X).")))
    blocks = table(spark, d, "orders").select(F.concat_ws("\n", F.concat(F.lit("% S"), key, F.lit(": an order")), F.lit(""), fact, rule).alias("value"))
    return sources.clause_sites(spark, _written(blocks, "clauses")).select("sentence", "kind", "predicate", "arguments", "body")


@query("""select o_orderkey as doc, count(*) as n, min(l_linenumber)::bigint as low, max(l_linenumber)::bigint as high from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def kb_controlled_sentences(spark, d):
    """Lines of text, a sentence each, numbered in their file; what an order's lines say is found again whatever file it is in."""
    said = F.concat(F.lit("order "), c("l_orderkey").cast("string"), F.lit(" has line "), c("l_linenumber").cast("string"), F.lit("."))
    found = sources.sentences(spark, _written(table(spark, d, "lineitem").select(said.alias("value")), "sentences"))
    part = lambda n: F.regexp_extract("text", r"^order (\d+) has line (\d+)\.$", n).cast("long")
    numbers = found.groupBy("path").agg(F.count("*").alias("n"), F.max("sentence").alias("last"), F.count_distinct("sentence").alias("k")).where("n <> last or n <> k")
    rows = found.join(numbers.select("path"), "path", "left_anti")  # files whose lines are not numbered 1, 2, ... would be missing below
    return rows.select(part(1).alias("doc"), part(2).alias("line")).groupBy("doc").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"))


@query("""select 'r' || p_partkey as region, p_brand as file, p_size::int as page, ['parts', p_type] as section, case when p_size < 10 then 'pending' when p_size < 30 then 'ace' else 'restates' end as state, case when p_size >= 10 then p_name end as detail from part""")
def kb_coverage_tsv(spark, d):
    status = F.when(c("p_size") < 10, "pending").when(c("p_size") < 30, F.concat(F.lit("ace("), "p_name", F.lit(")"))).otherwise(F.concat(F.lit("restates("), "p_name", F.lit(")")))
    rows = table(spark, d, "part").select(_fields(F.concat(F.lit("r"), c("p_partkey").cast("string")), c("p_brand"), F.concat(F.lit("p"), c("p_size").cast("string")), F.concat(F.lit("parts > "), "p_type"), status).alias("value"))
    head = spark.range(1).select(F.lit("# region\tfile\tpage\tsection\tstatus").alias("value"))
    return sources.coverage(spark, _written(head.unionByName(rows), "coverage"))


@query("""select 'd' || s_suppkey as document, 'n' || s_nationkey as region, s_name as kept, 'balance ' || s_acctbal::bigint as dropped from supplier""")
def kb_projection_notes(spark, d):
    supplier = table(spark, d, "supplier")
    balance = F.concat(F.lit("balance "), F.rint("s_acctbal").cast("long").cast("string"))
    rows = supplier.select(_fields(F.concat(F.lit("d"), c("s_suppkey").cast("string")), F.concat(F.lit("n"), c("s_nationkey").cast("string")), c("s_name"), balance).alias("value"))
    return pv.projection_notes(spark, _written(rows, "notes"))


@query("""select 'qualifier' as kind, p_brand as word from part group by 2 union all select 'scope', p_type from part group by 2""")
def kb_vocabulary(spark, d):
    part = table(spark, d, "part")
    rows = part.select(_fields(F.lit("qualifier"), c("p_brand"), F.lit("")).alias("value")).unionByName(part.select(_fields(F.lit("scope"), c("p_name"), c("p_type")).alias("value"))).unionByName(spark.range(1).select(F.lit("qualifier\t").alias("value")))
    words = pv.vocabulary(spark, _written(rows, "vocabulary"))
    return pv.qualifiers(words).select(F.lit("qualifier").alias("kind"), "word").distinct().unionByName(pv.scope_keys(words).select(F.lit("scope").alias("kind"), c("key").alias("word")))


@query("""select doc_id, lang, source, n_chars::bigint as n_chars, md5(text) as digest from documents""")
def kb_committed_json(spark, d):
    """Documents written as JSON with a manifest that comes last, and read back by it."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", c("n_chars").cast("long").alias("n_chars"), "text")
    path = f"{shared_dir(spark)}/sources/committed-{uuid.uuid4().hex}"
    committed.write_committed(docs, path)
    back = committed.read_committed(spark, path, "doc_id long, lang string, source string, n_chars long, text string")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@query("""with l as (select l_orderkey as k, count(*) as n, min(l_linenumber)::int as first, max(l_linenumber)::int as last from lineitem group by 1)
  select o_orderkey as document, coalesce(n, 0) as clauses, first, last, o_orderpriority as kept, case when o_orderstatus = 'F' then 'stale' end as label from orders left join l on k = o_orderkey""")
def kb_assembled_documents(spark, d):
    orders = table(spark, d, "orders")
    clauses = table(spark, d, "lineitem").select(c("l_orderkey").alias("document"), c("l_linenumber").cast("int").alias("line"), "l_returnflag").join(orders.select(c("o_orderkey").alias("document")), "document", "left_semi")
    notes = orders.select(c("o_orderkey").alias("document"), c("o_orderpriority").alias("kept"), c("o_orderstatus").alias("dropped"))
    labels = orders.where("o_orderstatus = 'F'").select(c("o_orderkey").alias("document"), F.lit("stale").alias("label"))
    whole = pv.assembled(orders.select(c("o_orderkey").alias("document")), clauses, notes, labels)
    lines = F.transform("clauses", lambda x: x["line"])
    return whole.select("document", F.coalesce(F.size("clauses"), F.lit(0)).cast("long").alias("clauses"), F.get(lines, F.lit(0)).alias("first"), F.element_at(lines, -1).alias("last"), "projection.kept", "label")


@query("""select a.p_partkey, case when a.p_size < 25 then '<' when a.p_size > 25 then '>' else '=' end as to_number, '<' as to_atom, case when a.p_type < 'PROMO' then '<' when a.p_type > 'PROMO' then '>' else '=' end as atoms, '<' as exact from part a""")
def kb_compare_terms(spark, d):
    """compare/3 of a part's size with a number and an atom, of its type with an atom, and of two integers that one double stands for."""
    key = lambda kind, num, text: te.order_key(F.lit(kind), num, text)
    none, size = F.lit(None).cast("long"), key("integer", c("p_size").cast("long"), F.lit(None).cast("string"))
    big = c("p_partkey") * 0 + 9007199254740992
    return table(spark, d, "part").select(
        "p_partkey", te.compared(size, key("integer", F.lit(25).cast("long"), F.lit(None).cast("string"))).alias("to_number"), te.compared(size, key("atom", none, c("p_type"))).alias("to_atom"),
        te.compared(key("atom", none, c("p_type")), key("atom", none, F.lit("PROMO"))).alias("atoms"), te.compared(key("integer", big, none.cast("string")), key("integer", big + 1, none.cast("string"))).alias("exact"),
    )


@query("""select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as n from customer join orders on o_custkey = c_custkey) where n = 1""")
def kb_once(spark, d):
    """once/1: each customer's first order by price."""
    goal = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), "c_custkey")
    return logic.first(goal, ["c_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("""with s as (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 5000 group by 1)
  select 'rich(' || n_nationkey || ')' as goal, case when n_regionkey = 1 then 'assumption' else 'fact' end as via, 0 as round from nation where n_regionkey = 1 or n_nationkey in (select k from s)
  union all select 'sound(' || n_regionkey || ')', min('n:' || n_nationkey), 1 from nation where n_regionkey = 1 or n_nationkey in (select k from s) group by n_regionkey""")
def kb_derive_assumed(spark, d):
    """Goals that are assumed are not looked for in facts, and rules go on from them."""
    nation = table(spark, d, "nation")
    goal = lambda name, k: te.call(name, c(k).cast("string"))
    facts = table(spark, d, "supplier").where("s_acctbal > 5000").select(goal("rich", "s_nationkey").alias("goal"))
    rules = nation.select(F.concat(F.lit("n:"), c("n_nationkey").cast("string")).alias("rule"), goal("sound", "n_regionkey").alias("head"), goal("rich", "n_nationkey").alias("goal"), F.lit(False).alias("negated"))
    return prove.derive(facts, rules, None, nation.where("n_regionkey = 1").select(goal("rich", "n_nationkey").alias("goal"))).select("goal", "via", "round")


@query("""select p_partkey, regexp_replace(lower(p_name || '. ' || p_type || ': ' || p_brand), '[\\s.:;]+', '', 'g') as folded,
  case when instr(p_name, 'a') > 0 and instr(substr(p_name, instr(p_name, 'a') + 1), 'e') > 0 then true else false end as in_order from part""")
def kb_fold_and_order(spark, d):
    """A part's texts folded for locating, and whether a and then e stand in its name."""
    text = F.concat("p_name", F.lit(". "), "p_type", F.lit(": "), "p_brand")
    return table(spark, d, "part").select("p_partkey", st.folded(text).alias("folded"), located.in_order(c("p_name"), F.array(F.lit("a"), F.lit("e"))).alias("in_order"))


@query("""select p_partkey, (p_size % 20)::bigint as n, power(3, p_size % 20)::bigint as power, p_size % 40 <= 39 as fits from part""")
def kb_growth_guard(spark, d):
    """Powers that stay within the bound, told before they are taken."""
    n = (c("p_size") % 20).cast("long")
    return table(spark, d, "part").select("p_partkey", n.alias("n"), ar.integer_power(F.lit(3).cast("long"), n).alias("power"), ar.power_fits(F.lit(3).cast("long"), (c("p_size") % 40).cast("long")).alias("fits"))


@query("""select p_name as document, case when max(p_size) % 3 = 0 then 'recommendation' when max(p_size) % 3 = 1 then 'implementation' else 'supporting' end as kind from part where p_partkey in (select max(p_partkey) from part group by p_name) group by p_name""")
def kb_document_kinds(spark, d):
    """Documents named by coverage rows, of the kind their last row says."""
    section = F.when(c("p_size") % 3 == 0, F.array(F.lit("part"), F.concat(F.lit("Recommendation "), c("p_size").cast("string")))).when(c("p_size") % 3 == 1, F.array(F.lit("Implementation considerations"))).otherwise(F.array(F.lit("Recommendation")))
    rows = table(spark, d, "part").select(F.lpad(c("p_partkey").cast("string"), 12, "0").alias("region"), section.alias("section"), F.lit("ace").alias("state"), c("p_name").alias("detail"))
    return codebook.document_kinds(rows)


@query("""select o_custkey as id, count(*) as n, case when c_nationkey < 12 then c_mktsegment end as class from orders join customer on c_custkey = o_custkey group by all""")
def kb_classified_concepts(spark, d):
    """Customers with orders, classed by a codebook that has an entry for each."""
    concepts = table(spark, d, "orders").groupBy(c("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    customers = table(spark, d, "customer").select(c("c_custkey").alias("id"), F.when(c("c_nationkey") < 12, c("c_mktsegment")).alias("class"))
    book = customers.join(concepts, "id", "left_semi")
    # Segments are a fixed handful.
    classes = [r["class"] for r in customers.where("class is not null").select("class").distinct().collect()]
    return codebook.classified(concepts.join(customers.select("id"), "id", "left_semi"), book, classes)


@query("""select p_partkey, replace(replace(p_name || ' of ' || p_brand, '_', ' '), '-', ' ') as words, p_brand || ' — sentence ' || p_size || ', ref ' || p_partkey as place from part""")
def kb_plain_readings(spark, d):
    place = rd.named_place(c("p_brand"), c("p_size"), F.concat(F.lit("ref("), c("p_partkey").cast("string"), F.lit(")")), c("p_name"))
    return table(spark, d, "part").select("p_partkey", rd.plain_words(F.concat("p_name", F.lit(" of "), "p_brand"), "buyer").alias("words"), place.alias("place"))
