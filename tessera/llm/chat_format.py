"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record may have any of several layouts (messages, shared conversations, prompt and completion,
instruction and output). The layouts' nested field paths form a vocabulary; a record's fingerprint is the
MD5 of the sorted paths that it holds (not null), and selects a declarative mapping of paths to turns.
Fields outside the vocabulary, clashing names included, do not change a fingerprint. A record with an
unknown fingerprint has no turns and layout null.

The template writes a turn as  <s>role[INST]text[/INST]</s>  and escapes these control strings inside roles
and texts: a backslash is doubled, and a control string gets a backslash after its first character, which no
longer spells it; removing one backslash before every character undoes both. The loss mask has a run per
turn (characters before the text, of the text, after it, and whether the text bears loss); the assistant's
texts bear loss.

Null roles and texts are empty. Turns with equal numbers are ordered by role and text; a null turn comes
first, a null conversation id is one conversation. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")

#: Layout: its field paths, and its turns as (role or path of the role, path of the text). A list path
#: ("messages[].role") gives a turn per element; the roles of the layout conversations are renamed by ROLES.
LAYOUTS = {
    "messages": (("messages[].role", "messages[].content"),),
    "conversations": (("conversations[].from", "conversations[].value"),),
    "prompt": (("user", "prompt"), ("assistant", "completion")),
    "system_prompt": (("system", "system"), ("user", "prompt"), ("assistant", "completion")),
    "instruction": (("user", "instruction"), ("assistant", "output")),
    "instruction_input": (("user", "instruction"), ("user", "input"), ("assistant", "output")),
    "question": (("user", "prompt"),),
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths_of(layout: str) -> list[str]:
    return sorted({p for turn in LAYOUTS[layout] for p in (turn if "[]." in turn[0] else turn[1:])})


VOCABULARY = sorted({p for layout in LAYOUTS for p in paths_of(layout)})


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def _has(df: DataFrame, path: str) -> bool:
    """Whether the table's schema has the path, with the type that the vocabulary asks for."""
    kinds = dict(df.dtypes)
    if "[]." not in path:
        return kinds.get(path) == "string"
    column, field = path.split("[].")
    return column in kinds and kinds[column].startswith("array<struct<") and f"{field}:string" in kinds[column]


def fingerprint(df: DataFrame) -> Column:
    """Each record's fingerprint: which paths of the vocabulary it holds."""
    held = [F.when(F.col(p.split("[].")[0]).isNotNull(), F.lit(p)) for p in VOCABULARY if _has(df, p)]
    return F.md5(F.array_join(F.array_compact(F.array(*held)), "\n")) if held else F.md5(F.lit(""))


def _turns(df: DataFrame, layout: str) -> Column | None:
    if not all(_has(df, p) for p in paths_of(layout)):
        return None
    renamed = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def element(role: str, text: str):
        def turn(x: Column) -> Column:
            said = F.coalesce(x[role], F.lit(""))
            return F.struct((F.coalesce(renamed[said], said) if layout == "conversations" else said).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

        return turn

    out = []
    for role, text in LAYOUTS[layout]:
        if "[]." in role:
            column, field = role.split("[].")
            out.append(F.transform(column, element(field, text.split("[].")[1])))
        else:
            out.append(F.array(F.struct(F.lit(role).alias("role"), F.col(text).alias("text"))))
    return F.concat(*out)


def canonical(df: DataFrame) -> DataFrame:
    """df with layout and turns (array of role, text)."""
    tagged = df.withColumn("__print", fingerprint(df))
    layout, turns = F.lit(None), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name in LAYOUTS:
        mapped = _turns(df, name)
        if mapped is not None:
            same = F.col("__print") == fingerprint_of(paths_of(name))
            layout, turns = F.when(same, F.lit(name)).otherwise(layout), F.when(same, mapped).otherwise(turns)
    return tagged.withColumns({"layout": layout.cast("string"), "turns": F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>"))}).drop("__print")


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        x = F.replace(x, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return x


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def render(df: DataFrame) -> DataFrame:
    """df with formatted (the text) and loss_runs, from turns."""
    escaped = df.withColumn("__turns", F.transform("turns", lambda t: F.struct(escape(t.role).alias("role"), escape(t.text).alias("text"), (t.role == "assistant").alias("loss"))))
    piece = lambda t: F.concat(F.lit("<s>"), t.role, F.lit("[INST]"), t.text, F.lit("[/INST]</s>"))
    run = lambda t: F.struct((F.length(t.role) + 9).alias("before"), F.length(t.text).alias("of"), F.lit(11).alias("after"), t.loss.alias("loss"))
    return escaped.withColumns({"formatted": F.array_join(F.transform("__turns", piece), ""), "loss_runs": F.transform("__turns", run)}).drop("__turns")


def parse(df: DataFrame) -> DataFrame:
    """df with read_turns and loss_text, read back from formatted and loss_runs alone."""
    pieces = F.expr("slice(split(formatted, '</s>'), 1, size(split(formatted, '</s>')) - 1)")
    split = df.withColumn("__pieces", pieces)
    # a piece is <s>role[INST]text[/INST]; the first [INST] ends the role
    turns = F.expr("transform(__pieces, p -> named_struct('role', substring(p, 4, locate('[INST]', p) - 4), 'text', substring(p, locate('[INST]', p) + 6, length(p) - locate('[INST]', p) - 12)))")
    loss = F.expr("array_join(transform(filter(arrays_zip(__pieces, loss_runs), x -> x.loss_runs.loss), x -> substring(x.__pieces, x.loss_runs.before + 1, x.loss_runs.of)), '')")
    read = split.withColumns({"__read": turns, "loss_text": unescape(loss)})
    return read.withColumn("read_turns", F.transform("__read", lambda t: F.struct(unescape(t.role).alias("role"), unescape(t.text).alias("text")))).drop("__pieces", "__read")


def format_chat(records: DataFrame) -> DataFrame:
    """records in any known layout -> layout, turns, formatted, loss_runs."""
    return render(canonical(records))


def gathered(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as records of the messages layout: conv_id, messages."""
    each = rows.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")).alias("m"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m")).select("conv_id", F.transform("m", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all conversations, and conversation -1 in the prompt layout."""
    ok = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(ok).alias("prompt"), F.lit(ok).alias("completion"))
    records = gathered(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(extra, allowMissingColumns=True)
    read = parse(format_chat(records))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout")


_ESC = "replace(replace(replace(replace(replace({}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
OP1_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'messages' AS layout FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'prompt' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'prompt')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars, min(layout) AS layout
FROM rows_ GROUP BY conv_id"""
