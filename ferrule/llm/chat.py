"""Chat formatting with DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values of this format).
START, END, BREAK, SEP = "<|im_start|>", "<|im_end|>\n", "<|turn|>", "\n"

#: Inside texts a backslash is doubled, then one is put after the first character of anything that could begin a
#: control string of this template or of the common instruction templates.
_RISKY = r"<(?=\||/?s>|</?SYS)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"({_RISKY})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """Roles end at a newline, so in them it is written as a backslash and n, which escape() never makes."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: (conv, formatted string, loss_spans array<struct<start, length>>).

    Turns are collected as structs and sorted by (turn, role, text); adjacent turns of one role
    become one block: START role, newline, the escaped texts with BREAK between them, END. loss_spans are
    the code-point ranges (start from 1) of the texts whose role is in trained; breaks lie outside them.
    read_chat() gives the turns back exactly.

    A null text or role counts as empty; a null turn sorts first; rows that are repeated stay repeated;
    a null conversation id is one conversation. Other columns are ignored. A formatted
    conversation is one string, so its turns meet in one row, and nothing larger than that row does.
    """
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    grouped = turns.select(F.col(f"`{conv}`").alias(conv), one.alias("t")).groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Each turn knows what stands before and after its text; the formatted string is their concatenation.
    n = F.size("turns")

    def piece(t: Column, i: Column) -> Column:
        joined = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        last = (i == n - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        head = F.when(joined, F.lit(BREAK)).otherwise(F.concat(F.lit(START), escape_role(t["role"]), F.lit(SEP)))
        return F.struct(
            head.alias("head"), escape(t["text"]).alias("body"), F.when(last, F.lit(END)).otherwise(F.lit("")).alias("tail"), t["role"].isin(*trained).alias("on")
        )

    pieces = grouped.select(conv, F.transform("turns", piece).alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    lens = F.transform("pieces", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), F.length(p["tail"]).alias("t"), p["on"].alias("on")))
    return pieces.select(conv, formatted.alias("formatted"), lens.alias("lens")).select(conv, "formatted", _spans(F.col("lens")).alias("loss_spans"))


def _spans(lens: Column) -> Column:
    """Ranges of the texts that are on. Running sums go block by block, about the square root of the turns each, so that a long conversation does not copy its list at every turn."""
    kind = "array<struct<start:bigint,length:bigint>>"
    size = F.greatest(F.ceil(F.sqrt(F.size(lens))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lens) - 1, F.lit(0)), size), lambda at: F.slice(lens, at + 1, size))
    whole = lambda x: (x["h"] + x["b"] + x["t"]).cast("long")
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + whole(x)))
    begin = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(sums, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]

    def step(acc: Column, x: Column) -> Column:
        here = F.struct((acc["at"] + x["h"]).alias("start"), x["b"].cast("long").alias("length"))
        return F.struct((acc["at"] + whole(x)).alias("at"), F.when(x["on"], F.concat(acc["spans"], F.array(here))).otherwise(acc["spans"]).alias("spans"))

    def spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(kind).alias("spans")), step)["spans"]

    return F.flatten(F.zip_with(blocks, starts, spans))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>, texts unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def block(b: Column) -> Column:
        body = F.substring_index(b, START, -1)
        at = F.instr(body, SEP)
        name = unescape_role(F.substr(body, F.lit(1), at - 1))
        texts = F.split(F.substr(body, at + 1), r"<\|turn\|>", -1)
        return F.transform(texts, lambda x: F.struct(name.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, block))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order, nothing between them."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "select -7L as conv_id, t as turn, if(t = 0, 'user', 'assistant') as role, '</s>[INST] ok [/INST]' as text from (select explode(array(0L, 1L)) as t)"
    )
    out = format_chat(turns.unionByName(probe)).withColumn("back", read_chat(F.col("formatted"))).withColumn("loss", loss_texts(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  -- a backslash is doubled, and one goes into every place where a control string could begin
  select *, length(text) + list_sum(list_transform(['\', '<|', '<s>', '</s>', '<<SYS', '<</SYS', '[INST]', '[/INST]'], lambda x: (length(text) - length(replace(text, x, ''))) // length(x))) as esc,
    lag(role) over w as before, lead(role) over w as after
  from t window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(esc + case when before is not distinct from role then 8 else 13 + length(role) end
      + case when after is not distinct from role then 0 else 11 end)::bigint as formatted_chars
from e group by conv_id
"""
