"""Chat formatting by schema fingerprints.

A record's nested field paths that any layout knows are hashed; the digest selects a
declarative mapping that turns the record into canonical turns (turn, role, text).
Turns are then written by one template, and control strings inside texts are escaped
reversibly.

A layout fits a record that has all paths it asks for, whatever else it has; of
several the one that asks for most is taken, ties in the order declared here.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

HEAD, END = "### ", "\n</turn>\n"
#: Code points that start a control string, and what stands for them inside texts; the escape itself comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"))
#: Names of roles that layouts other than the canonical one use.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layouts of JSON records.  turns: (role, path) of fields; array: a list of messages.
LAYOUTS = {
    "messages": {"array": "messages"},
    "conversations": {"array": "conversations"},
    "prompt_response": {"turns": (("user", "prompt"), ("assistant", "response"))},
    "prompt_completion": {"turns": (("user", "prompt"), ("assistant", "completion"))},
    "question_answer": {"turns": (("user", "question"), ("assistant", "answer"))},
    "instruction": {"turns": (("user", "instruction"), ("assistant", "output"))},
    "instruction_input": {"turns": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    "system_prompt": {"turns": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
}
#: Layouts of one message of a list: role and text field.  The role field alone makes one fit.
MESSAGES = {"role_content": ("role", "content"), "from_value": ("from", "value")}
#: Layouts of tables with a row for each turn: conversation, turn, role and text column, and whether roles have names of its own.
ROW_LAYOUTS = {
    "turn_rows": ("conv_id", "turn", "role", "text", False),
    "message_rows": ("conversation_id", "index", "from", "value", True),
}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _print(paths: Column, known) -> Column:
    """Fingerprint of those of a record's paths that are among ``known``."""
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, known)))), "\n"), 256)


def _named(role: Column) -> Column:
    """The canonical name of a role; null is empty."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[role], role, F.lit(""))


def row_turns(df: DataFrame) -> DataFrame:
    """A table with a row for each turn -> (conv_id, turn, role, text).

    A table may hold rows of several layouts, each with its own columns filled: a row's
    paths are its columns that aren't null, and their fingerprint selects the layout that
    most of them belong to (none: the first one).  Only layouts whose columns the table
    has all are asked; with none of them it is an error.  Other columns are ignored.
    """
    has = {c.lower() for c in df.columns}
    fit = [cols for cols in ROW_LAYOUTS.values() if {c.lower() for c in cols[:4]} <= has]
    if not fit:
        raise ValueError(f"no layout has all its columns among {sorted(df.columns)}")
    known = sorted({c for cols in fit for c in cols[:4]})
    # every set of columns that a row may have filled, and the place of the layout that it selects
    filled = [set(x) for n in range(len(known) + 1) for x in combinations(known, n)]
    selects = {fingerprint(x): max(range(len(fit)), key=lambda i: (len(x & set(fit[i][:4])), -i)) for x in filled}
    paths = F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in known)))
    (layout,) = fresh(df, "layout")
    chosen = F.create_map(*(F.lit(x) for kv in selects.items() for x in kv))[_print(paths, known)]
    d = df.withColumn(layout, chosen)

    def pick(i: int, name: str) -> Column:
        as_of = lambda cols: _named(F.col(f"`{cols[i]}`")) if i == 2 and cols[4] else F.col(f"`{cols[i]}`")
        return F.coalesce(*(F.when(F.col(layout) == k, as_of(cols)) for k, cols in enumerate(fit))).alias(name)

    return d.select(*(pick(i, name) for i, name in enumerate(("conv_id", "turn", "role", "text"))))


def json_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """JSON records of mixed layouts -> (conv_id, turn, role, text).

    A record of no known layout (null and broken JSON too) gives one row with null
    turn, role and text, and so does an empty list; a message of no known layout is a
    turn with null role and text: nothing goes unseen.  Null or missing texts are empty.
    """
    keys = lambda j: F.coalesce(F.json_object_keys(j), F.array().cast("array<string>"))
    d = df.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("j")).withColumn("paths", keys(F.col("j")))
    field = lambda j, p: F.coalesce(F.get_json_object(j, f"$.{p}"), F.lit(""))
    asks = lambda layout: [layout["array"]] if "array" in layout else [p for _, p in layout["turns"]]

    def mapped(m):
        out = F.lit(None).cast("struct<role:string,text:string>")
        for role, text in reversed(MESSAGES.values()):
            made = F.struct(_named(F.get_json_object(m, f"$.{role}")).alias("role"), field(m, text).alias("text"))
            out = F.when(_print(keys(m), [role]) == fingerprint([role]), made).otherwise(out)
        return out

    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in sorted(reversed(LAYOUTS.values()), key=lambda x: len(asks(x))):  # the one asked last decides first
        if "array" in layout:
            made = F.transform(F.from_json(F.get_json_object("j", f"$.{layout['array']}"), "array<string>"), mapped)
        else:
            made = F.array(*(F.struct(F.lit(r).alias("role"), field("j", p).alias("text")) for r, p in layout["turns"]))
        turns = F.when(_print(F.col("paths"), asks(layout)) == fingerprint(asks(layout)), made).otherwise(turns)
    return d.select("conv_id", F.posexplode_outer(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    """Undoes escape(): cut at doubled escapes, so that what is left of each starts a control string."""

    def plain(x):
        for a, b in ESCAPES[1:]:
            x = F.replace(x, F.lit(b), F.lit(a))
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit("</turn>")), F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: DataFrame, loss_role: str = "assistant", segment: int = 128) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_turns array<boolean>, one row a conversation.

    loss_turns[i] says if the text of the i-th turn is under the loss mask.  Turns of
    a conversation are in order of turn (null first), role and text; null roles and
    texts are empty; repeated rows are turns of their own; null conv_ids are one
    conversation.  Runs of ``segment`` turns are written first, then joined, so that
    a long conversation meets in one task only as its finished parts.  A formatted
    conversation is one value and must fit in a row (2 GB), and so is a very long text;
    an empty table gives no rows, other columns are ignored.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("segment", F.expr(f"turn div {segment}"))
    parts = t.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    line = lambda r: F.concat(F.lit(HEAD), _escape_role(r["role"]), F.lit(":\n"), escape(r["text"]), F.lit(END))
    parts = parts.select("conv_id", "segment", F.array_join(F.transform("rows", line), "").alias("s"), F.transform("rows", lambda r: r["role"] == loss_role).alias("m"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "s", "m"))).alias("p"))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda p: p["s"]), "").alias("formatted"), F.flatten(F.transform("p", lambda p: p["m"])).alias("loss_turns"))


def read_turns(formatted: Column) -> Column:
    """Parse a formatted conversation: array<struct<role, text>>."""
    pieces = F.split(formatted, r"\n</turn>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p):
        at = F.instr(p, ":\n")
        return F.struct(_unescape_role(F.substring(p, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"), unescape(F.substring(p, at + 2, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = format_turns(row_turns(table(spark, sf_dir, "conversations")).unionByName(extra))
    back = made.select("conv_id", "formatted", "loss_turns", read_turns(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.zip_with("turns", "loss_turns", lambda t, m: F.when(m, t["text"]).otherwise("")), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS t2,
             replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), chr(10), '\n') AS r2 FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(r2) + 2 + length(t2) + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
