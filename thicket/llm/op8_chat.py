"""Chat formatting in DataFrame expressions alone.

A conversation's turns are collected as structs, sorted by turn, and folded: adjacent turns of one role share a block. A block is
`[INST] role`, newline, its texts with `<+>` between them, ` [/INST]`; a conversation stands between `<s>` and `</s>`. Inside roles and texts
`&`, `<`, `[` and, in roles, a newline are written as `&amp;`, `&lt;`, `&lb;`, `&nl;`, so no text can hold a control string, and parse() gets every
turn back. The loss mask is the list of spans (start, length in code points) of assistant texts in the formatted string.

Null texts and roles are empty. Turns that tie, or are null, sort by turn (nulls first), role, text; repeated rows stay. Rows of a null conv_id
are one conversation. Empty tables give empty tables. Other columns are not read, so their names can't clash. One conversation is one string, so it is one row's work by definition; turns are
shuffled once, by conv_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NAME = "op8_relational_chat"
TURNS = "array<struct<role: string, text: string>>"
#: Pieces of output whose places are summed up together.
PART = 256
#: The turns of conversation -1, whose texts hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def escape(x: str, role: bool = False) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')"
    return f"replace({out}, '\\n', '&nl;')" if role else out


def unescape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&nl;', '\\n'), '&lb;', '['), '&lt;', '<'), '&amp;', '&')"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: sorted."""
    rows = conversations.selectExpr("conv_id", "struct(turn, coalesce(cast(role as string), '') as role, coalesce(cast(text as string), '') as text) as x")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x")).selectExpr("conv_id", f"cast(transform(x, y -> struct(y.role, y.text)) as {TURNS}) as turns")


def merged(df: DataFrame) -> DataFrame:
    """Adjacent turns of one role as a block: each first turn of a block takes the turns up to the next block's first."""
    first = df.withColumn("a", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role <> turns[i - 1].role)"))
    both = first.withColumn("b", F.expr("concat(slice(a, 2, size(a)), array(size(turns)))"))
    return both.selectExpr("conv_id", "transform(a, (s, i) -> struct(turns[s].role as role, transform(slice(turns, s + 1, b[i] - s), t -> t.text) as texts)) as blocks")


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans."""
    df = merged(turns(conversations))
    shown = df.withColumn("shown", F.expr(f"""transform(blocks, b -> struct(b.role as role, concat('[INST] ', {escape("b.role", True)}, '\\n') as head, transform(b.texts, t -> {escape("t")}) as texts))"""))
    # a piece is a literal stretch of output, with whether the loss counts it
    pieces = """flatten(transform(shown, b -> concat(array(struct(b.head as s, false as loss)),
        flatten(transform(b.texts, (t, i) -> array(struct(if(i = 0, '', '<+>') as s, false as loss), struct(t as s, b.role = 'assistant' as loss)))),
        array(struct(' [/INST]' as s, false as loss)))))"""
    out = shown.selectExpr("conv_id", f"concat(array(struct('<s>' as s, false as loss)), {pieces}, array(struct('</s>' as s, false as loss))) as p")
    out = out.selectExpr("conv_id", "array_join(transform(p, x -> x.s), '') as formatted", "transform(p, x -> struct(char_length(x.s) as n, x.loss as loss)) as p")
    # running sums inside parts of PART pieces, then over the parts: an array that grows by a copy each time stays short
    out = out.withColumn("p", F.expr(f"transform(sequence(0, (size(p) - 1) div {PART}), k -> slice(p, k * {PART} + 1, {PART}))"))
    inner = """aggregate(b, struct(0 as n, cast(array() as array<struct<start: int, length: int>>) as spans),
        (acc, x) -> struct(acc.n + x.n as n, if(x.loss, concat(acc.spans, array(struct(acc.n as start, x.n as length))), acc.spans) as spans))"""
    out = out.withColumn("p", F.expr(f"transform(p, b -> {inner})"))
    out = out.withColumn("at", F.expr("aggregate(p, struct(1 as n, cast(array() as array<int>) as at), (acc, b) -> struct(acc.n + b.n as n, concat(acc.at, array(acc.n)) as at), acc -> acc.at)"))
    spans = "flatten(transform(p, (b, k) -> transform(b.spans, s -> struct(at[k] + s.start as start, s.length as length))))"
    return out.selectExpr("conv_id", "formatted", f"{spans} as loss_spans")


def parse(formatted: str) -> str:
    """SQL for the turns of a formatted string."""
    body = f"split(substring({formatted}, 4, char_length({formatted}) - 7), '\\\\[INST\\\\] ', -1)"
    block = f"transform(filter({body}, (b, i) -> i > 0), b -> substring(b, 1, char_length(b) - 8))"
    texts = "split(substring(b, instr(b, '\\n') + 1), '<[+]>', -1)"
    role = unescape("substring(b, 1, instr(b, '\\n') - 1)")
    return f"flatten(transform({block}, b -> transform({texts}, t -> struct({role} as role, {unescape('t')} as text))))"


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and masks say, read back from them alone."""
    back = formatted.withColumn("back", F.expr(parse("formatted")))
    loss = f"array_join(transform(loss_spans, s -> {unescape('substring(formatted, s.start, s.length)')}), '')"
    back = back.withColumn("loss", F.expr(loss))
    return back.selectExpr("conv_id", "cast(size(back) as bigint) as n_turns", "sha2(array_join(transform(back, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256) as turns_sha256",
                           "cast(char_length(loss) as bigint) as loss_chars", "sha2(loss, 256) as loss_sha256", "cast(char_length(formatted) as bigint) as formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    probe = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{PROBE}' as text")
    return digest(format_chat(rows.unionByName(probe)))


def oracle() -> str:
    code = lambda x: f"length({x}) + 4 * (length({x}) - length(replace({x}, '&', ''))) + 3 * (length({x}) - length(replace({x}, '<', ''))) + 3 * (length({x}) - length(replace({x}, '[', '')))"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (7 + sum({code("text")} + CASE WHEN before = role THEN 3 ELSE 16 + {code("role")} END))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""
