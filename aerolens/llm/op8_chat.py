r"""Chat formatting by schema fingerprints.

Records come in different layouts: message lists (role/content, from/value),
prompt and completion, instruction with an optional input and an output.  A
row's fingerprint is the hash of the nested field paths that it fills in,
sorted; a table of declarative mappings, keyed by fingerprint, turns the
record into canonical turns (role, text).  Mappings name the paths they need
and those they allow to be absent; every combination has its fingerprint, so
a lookup by hash decides.  Rows of unknown layout get no mapping and no turns.

The template writes each turn as ``<|turn|>role\ntext<|end|>\n``.  Inside
texts and roles a backslash is doubled, and one is put after the first
character of each control string (those of this template and of common ones),
which breaks it and can be undone; a line feed in a role is escaped as well.
Loss spans (start, length in code points of the formatted string) cover the
escaped texts of assistant turns.  ``parse`` reads the turns back from the
formatted string alone, ``loss_texts`` from string and spans.

Only built-in functions run here.  A conversation is one string, so its turns
meet in one task, as any digest over it needs; rows are grouped by conv_id
after a projection to the four columns used.

Defined cases: null texts and roles count as empty; turns are ordered by turn,
then role and text (nulls first), and repeated rows stay; a null conv_id is a
conversation of its own; extra columns are ignored; an empty table gives
conversation -1 alone in the query.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from aerolens.llm.common import table

START, END = "<|turn|>", "<|end|>\n"
TRAINED_ROLE = "assistant"
# Control strings of this template and of public chat formats.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>",
           "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<start_of_turn>", "<end_of_turn>")
BREAKS = "(" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL) + ")"


# --- layouts ---------------------------------------------------------------

@dataclass(frozen=True)
class Mapping:
    """Field paths of a layout and the SQL expression of its turns array<struct<role, text>>."""
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: str


def _pair(user: str, assistant: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {user}), named_struct('role', 'assistant', 'text', {assistant}))"


ROLE_NAMES = "case lower({0}) when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' else {0} end"
MAPPINGS = (
    Mapping("messages", ("messages",), ("messages[].role", "messages[].content"),
            "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Mapping("sharegpt", ("conversations",), ("conversations[].from", "conversations[].value"),
            f"transform(conversations, m -> named_struct('role', {ROLE_NAMES.format('m.from')}, 'text', m.value))"),
    Mapping("prompt", ("prompt", "completion"), (), _pair("prompt", "completion")),
    Mapping("question", ("question", "answer"), (), _pair("question", "answer")),
    Mapping("instruction", ("instruction", "output"), (), _pair("instruction", "output")),
    Mapping("instruction_input", ("instruction", "input", "output"), (), _pair("concat(instruction, '\\n\\n', input)", "output")),
)


def field_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, list[tuple[str, bool]]]]:
    """(path, steps) of every field; a step is a name and whether it is an array to look into."""
    out = []

    def walk(kind: T.DataType, path: str, steps: list[tuple[str, bool]]) -> None:
        if steps:
            out.append((path, steps))
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, [*steps, (f.name, False)])
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                walk(f.dataType, f"{path}[].{f.name}", [*steps[:-1], (steps[-1][0], True), (f.name, False)])

    walk(schema, prefix, [])
    return out


def _filled(steps: list[tuple[str, bool]], at: Column | None = None) -> Column:
    """Whether the field is there: not null, for fields of array elements in any element."""
    (name, is_array), rest = steps[0], steps[1:]
    c = F.col(f"`{name}`") if at is None else at.getField(name)
    if not rest:
        return c.isNotNull()
    if is_array:
        return F.coalesce(F.exists(c, lambda e: _filled(rest, e)), F.lit(False))
    return _filled(rest, c)


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.array_sort(paths)), 256)


def with_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with columns ``fingerprint``, ``mapping`` and ``turns`` (null for unknown layouts).

    Top-level columns that no mapping names don't count for the fingerprint.
    """
    roots = {p.split("[")[0].split(".")[0] for m in mappings for p in (*m.required, *m.optional)}
    known = {p for m in mappings for p in (*m.required, *m.optional)}
    found = [(p, s) for p, s in field_paths(records.schema) if s[0][0] in roots]
    names = {p for p, _ in found}
    present = F.array_compact(F.array(*[F.when(_filled(s), F.lit(p)) for p, s in found if p in known])) if found else F.array().cast("array<string>")
    d = records.withColumn("fingerprint", fingerprint(present))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        if not names >= {*m.required, *m.optional}:
            continue                           # the table has no such columns
        prints = [fingerprint(F.array(*[F.lit(x) for x in (*m.required, *extra)]))
                  for k in range(len(m.optional) + 1) for extra in itertools.combinations(m.optional, k)]
        hit = F.col("fingerprint").isin(*prints)
        name = F.when(hit, F.lit(m.name)).otherwise(name)
        turns = F.when(hit, F.expr(m.turns)).otherwise(turns)
    empty = lambda t, f: F.coalesce(t.getField(f), F.lit(""))
    return d.withColumn("mapping", name).withColumn(
        "turns", F.transform(turns, lambda t: F.struct(empty(t, "role").alias("role"), empty(t, "text").alias("text"))))


# --- template --------------------------------------------------------------

def escape(text: Column) -> Column:
    # a backslash is doubled; after the first character of a control string one is put in
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, BREAKS, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> Column:
    """Struct (formatted, loss_spans) of an array of (role, text)."""
    def piece(t: Column) -> Column:
        role = F.replace(escape(t.role), F.lit("\n"), F.lit("\\\n"))
        return F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(t.text).alias("body"), (t.role == TRAINED_ROLE).alias("loss"))

    pieces = F.transform(turns, piece)
    sizes = F.transform(pieces, lambda p: F.struct(F.length(p.head).alias("head"), F.length(p.body).alias("body"), p.loss.alias("loss")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        span = F.struct((s.at + p.head).alias("start"), p.body.cast("bigint").alias("length"))
        return F.struct((s.at + p.head + p.body + len(END)).alias("at"),
                        F.when(p.loss, F.concat(s.spans, F.array(span))).otherwise(s.spans).alias("spans"))

    text = F.array_join(F.transform(pieces, lambda p: F.concat(p.head, p.body, F.lit(END))), "")
    return F.struct(text.alias("formatted"), F.aggregate(sizes, start, step, lambda s: s.spans).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    parts = F.filter(F.split(formatted, re.escape(END)), lambda p: p != "")
    head = "(?s)^" + re.escape(START) + r"([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"),
                                                 unescape(F.regexp_extract(p, head, 2)).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int"))))


def conversations_as_records(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) of rows by turn."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content")).alias("m"))
    g = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return g.select("conv_id", F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("messages"))


def formatted(records: DataFrame) -> DataFrame:
    """``records`` with fingerprint, mapping, turns, formatted and loss_spans."""
    d = with_turns(records).withColumn("_f", format_turns(F.col("turns")))
    return d.select(*[c for c in d.columns if c != "_f"], "_f.formatted", "_f.loss_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.sql("select -1L as conv_id, t as turn, r as role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    d = formatted(conversations_as_records(rows)).select("conv_id", "formatted", "loss_spans")
    d = d.withColumns({"back": parse(F.col("formatted")), "loss": loss_texts(F.col("formatted"), F.col("loss_spans"))})
    whole = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    trained = F.array_join("loss", "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("conv_id", F.size("back").cast("bigint").alias("n_turns"), digest(whole).alias("turns_sha256"),
                    F.length(trained).cast("bigint").alias("loss_chars"), digest(trained).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars"))


def _sql_escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


ORACLE_SQL = f"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, role as raw, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, length({_sql_escaped("text")}) + length(replace({_sql_escaped("role")}, chr(10), '\\' || chr(10))) + {len(START) + 1 + len(END)} as chars from r
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, raw nulls first, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, raw nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from e group by conv_id
"""
