"""Queries over type tests, term access, renaming, rounding and the other builtins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import arithmetic as ar
from ferrule.functions import readings as rd
from ferrule.functions import terms as te
from ferrule.plans.registry import joined, query
from ferrule.sources.tables import spread, table

c = F.col


@query("""with t as (select p_partkey, 'integer' as kind, p_size::varchar as text from part union all select p_partkey, 'float', p_retailprice::varchar from part union all select p_partkey, 'atom', p_brand from part
            union all select p_partkey, 'string', p_name from part union all select p_partkey, 'list', case when p_size % 4 = 0 then '[]' else '[' || p_size || ']' end from part
            union all select p_partkey, 'compound', 'size(' || p_size || ')' from part union all select p_partkey, 'variable', 'X' || p_size from part)
          select p_partkey, kind, kind <> 'variable' as bound, kind = 'atom' as atom, kind = 'integer' as int_, kind = 'float' as float_, kind in ('integer', 'float') as number_, kind = 'string' as string_, kind = 'list' as list_,
            kind = 'compound' or kind = 'list' and text <> '[]' as compound_, kind in ('integer', 'float', 'atom', 'string') as atomic_, kind in ('atom', 'compound') as callable_, kind <> 'variable' as ground_,
            case when kind in ('integer', 'float', 'atom', 'string') then 'string' end as as_text from t""")
def kb_type_tests(spark, d):
    part = table(spark, d, "part")
    size = c("p_size").cast("string")
    kinds = {
        "integer": size, "float": c("p_retailprice").cast("string"), "atom": c("p_brand"), "string": c("p_name"), "list": F.when(c("p_size") % 4 == 0, "[]").otherwise(F.concat(F.lit("["), size, F.lit("]"))),
        "compound": te.call("size", size), "variable": F.concat(F.lit("X"), size),
    }
    each = part.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in kinds.items()])).alias("t")).select("p_partkey", "t.*")
    kind, text = c("kind"), c("text")
    written = F.when(kind.isin("atom", "string"), F.lit("a")).otherwise(text)  # names and strings hold no variables, whatever their letters
    return each.select(
        "p_partkey", "kind", te.is_bound(kind).alias("bound"), te.is_atom(kind).alias("atom"), te.is_integer(kind).alias("int_"), te.is_float(kind).alias("float_"), te.is_number(kind).alias("number_"), te.is_string(kind).alias("string_"),
        te.is_list(kind, text).alias("list_"), te.is_compound(kind, text).alias("compound_"), te.is_atomic(kind).alias("atomic_"), te.is_callable(kind).alias("callable_"), te.is_ground(written).alias("ground_"), te.to_string(kind).alias("as_text"),
    )


@query("""select c_custkey, unnest(range(c_nationkey - 3, c_custkey % 7 + 1)) as n from customer""")
def kb_between(spark, d):
    low, high = (c("c_nationkey") - 3).cast("long"), (c("c_custkey") % 7).cast("long")
    return table(spark, d, "customer").select("c_custkey", F.explode(ar.between(low, high)).alias("n"))


@query("""select p_partkey, (p_partkey + 1)::bigint as next, case when p_size > 0 then p_size - 1 end::bigint as previous, (p_size - p_partkey)::bigint as x, (7 - p_size)::bigint as y, (p_partkey + 7)::bigint as z from part""")
def kb_succ_plus(spark, d):
    key, size, seven, none = c("p_partkey").cast("long"), c("p_size").cast("long"), F.lit(7).cast("long"), F.lit(None).cast("long")
    return table(spark, d, "part").select(
        "p_partkey", ar.successor(x=key).alias("next"), ar.successor(y=size).alias("previous"), ar.added(none, key, size)["x"].alias("x"), ar.added(size, none, seven)["y"].alias("y"), ar.added(key, seven, none)["z"].alias("z")
    )


@query("""with v as (select l_orderkey, l_linenumber, (l_extendedprice - 30000) / 4 as v, l_orderkey::bigint as a, l_linenumber::bigint as b from lineitem)
          select l_orderkey, l_linenumber, round(v)::bigint as nearest, trunc(v)::bigint as cut, ceil(v)::bigint as up, floor(v)::bigint as down, a::double as as_float, round(exp(b / 10.0), 9) as ex, least(a, b * 100) as lo, greatest(a, b * 100) as hi, -a as neg,
            floor(a / 8.0)::bigint as half, case when a % b = 0 then a // b end as whole, case when a % b <> 0 then round(a / b::double, 9) end as fraction from v""")
def kb_rounding(spark, d):
    v, a, b = (c("l_extendedprice") - 30000) / 4, c("l_orderkey").cast("long"), c("l_linenumber").cast("long")
    out = ar.divided(a, b)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", ar.to_integer(v).alias("nearest"), ar.toward_zero(v).alias("cut"), ar.raised(v).alias("up"), ar.lowered(v).alias("down"), ar.to_float(a).alias("as_float"), F.round(ar.exponential(b / 10), 9).alias("ex"),
        F.least(a, b * 100).alias("lo"), F.greatest(a, b * 100).alias("hi"), ar.negated(a).alias("neg"), ar.shifted_right(a, 3).alias("half"), out["whole"].alias("whole"), F.round(out["fraction"], 9).alias("fraction"),
    )


@query("""select n_nationkey, round(pi() * n_nationkey, 9) as around, round(exp(1) * n_nationkey, 9) as grown, 1.0::double + 2.220446049250313e-16 > 1.0 as above, n_nationkey < 'inf'::double as finite, (n_nationkey << 3)::bigint as shifted from nation""")
def kb_constants(spark, d):
    k = c("n_nationkey")
    return table(spark, d, "nation").select(
        k, F.round(ar.constant("pi") * k, 9).alias("around"), F.round(ar.constant("e") * k, 9).alias("grown"), (F.lit(1.0) + ar.constant("epsilon") > 1.0).alias("above"), ((k < ar.constant("inf")) & F.isnan(ar.constant("nan"))).alias("finite"),
        ar.shifted_left(k.cast("long"), 3).alias("shifted"),
    )


@query("""select l_orderkey, l_linenumber, 'line,' || l_partkey || ',' || l_suppkey || ',' || l_returnflag as parts, 'line(' || l_partkey || ',' || l_suppkey || ',' || l_returnflag || ')' as term, l_suppkey::varchar as second, null::varchar as fifth,
          '''[|]''(' || l_partkey || ',''[|]''(' || l_suppkey || ',''[|]''(' || l_returnflag || ',[])))' as chain from lineitem""")
def kb_term_access(spark, d):
    arguments = F.array(*[c(k).cast("string") for k in ("l_partkey", "l_suppkey", "l_returnflag")])
    whole = te.univ(F.lit("line"), arguments)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", joined(whole).alias("parts"), te.from_univ(whole).alias("term"), te.argument(arguments, F.lit(2)).alias("second"), te.argument(arguments, F.lit(5)).alias("fifth"), te.chain(arguments).alias("chain")
    )


@query("""select l_orderkey, l_linenumber, generate_subscripts(x, 1)::bigint as n, unnest(x) as value from (select l_orderkey, l_linenumber, [l_partkey::varchar, l_suppkey::varchar, l_returnflag] as x from lineitem)""")
def kb_arguments(spark, d):
    arguments = F.array(*[c(k).cast("string") for k in ("l_partkey", "l_suppkey", "l_returnflag")])
    each = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(arguments).alias("k", "value"))
    return each.select("l_orderkey", "l_linenumber", (c("k") + 1).cast("long").alias("n"), "value")


@query("""select p_partkey, 'S' || p_size || ',B' || p_partkey as vars, 'need(_G' || p_partkey || '_0,"Not A"),has(_G' || p_partkey || '_1,_G' || p_partkey || '_0,''Q'',_)' as copy,
          'gets(V1,V0) :- need(V0,"Not A"),has(V1,V0,''Q'',_)' as canonical, 'need(k0,"Not A"),has(k1,k0,''Q'',k_any15)' as fixed, false as ground from part""")
def kb_term_variables(spark, d):
    s, b = F.concat(F.lit("S"), c("p_size").cast("string")), F.concat(F.lit("B"), c("p_partkey").cast("string"))
    body = F.concat(F.lit("need("), s, F.lit(',"Not A"),has('), b, F.lit(","), s, F.lit(",'Q',_)"))
    head = F.concat(F.lit("gets("), b, F.lit(","), s, F.lit(")"))
    return spread(table(spark, d, "part").select("p_partkey", "p_size")).select(
        "p_partkey", joined(te.variables(body)).alias("vars"), te.copied(body, c("p_partkey").cast("string")).alias("copy"), te.canonical_clause(head, body).alias("canonical"), te.grounded(body, "k").alias("fixed"), te.is_ground(body).alias("ground")
    )


@query("""select l_orderkey, l_linenumber, 'p(s0,' || case when l_suppkey = l_partkey then 's0' else 's1' end || ',x)' as normal, l_partkey = l_suppkey as same from lineitem""")
def kb_term_equality(spark, d):
    a, b = F.concat(F.lit("sk"), c("l_partkey").cast("string")), F.concat(F.lit("sk"), c("l_suppkey").cast("string"))
    text = F.concat(F.lit("p("), a, F.lit(","), b, F.lit(",x)"))
    return spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber", te.normalised_constants(text, "sk[0-9]+").alias("normal"), te.same_term(te.call("f", a), te.call("f", b)).alias("same"))


@query(r"""select doc_id, not regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{202a}-\x{202e}\x{2066}-\x{2069}]') as safe from documents""")
def kb_safe_text(spark, d):
    return table(spark, d, "documents").select("doc_id", rd.is_safe(c("text")).alias("safe"))


@query("""select l_orderkey, coalesce(string_agg(distinct (l_linenumber - 3), ',' order by l_linenumber - 3) filter (l_linenumber > 3), '') as numbers from lineitem group by 1""")
def kb_positive_integers(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(joined(rd.positive_integers(F.collect_list(c("l_linenumber") - 3))).alias("numbers"))
