"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A record's nested field paths (names only, from its variant schema) are hashed; the hash
picks a layout's mapping, a declarative description of where roles and contents stand, and
the mapping's expression makes canonical turns. Turns become one string by a template whose
marks cannot occur inside a text: the characters that marks are made of are escaped,
reversibly. A loss mask of code-point spans marks the assistants' texts.

Everything is a built-in expression, with one shuffle where rows of turns are gathered into
conversations (a conversation's string is one value, so its turns meet in one row). Roles
stay as they stand, but for layouts whose records name the speaker with ``from``: their names
are brought to the canonical ones. Results by case: null texts and roles are empty; a row
with a null id is a conversation of its own, of one turn; turns with equal numbers stand by
role and text, null numbers first; a record whose layout is unknown
gives no turns and a null layout; repeated records are formatted each; an empty table gives
an empty result; other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.rules import let

TURN = "struct<role:string,text:string>"
#: Characters that template marks are made of, with their escapes; the escape sign is first.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))
OPEN, ROLE_END, CLOSE = "<|", "|>\n", "<|end|>\n"
#: Speakers' names in ``from`` records, with the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: a list of records, or single fields by role."""

    name: str
    shape: str
    turns: str = ""  # path of the list
    role: str = ""  # fields of its records
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, fields whose texts are joined


#: Shapes are variant schemas without types, keys in order of name (fixed values).
LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", "messages", "role", "content"),
    Layout("from_value", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "conversations", "from", "value"),
    Layout("prompt_response", "OBJECT<prompt, response>", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system_prompt_response", "OBJECT<prompt, response, system>", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", "OBJECT<completion, prompt>", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", "OBJECT<instruction, output>", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", "OBJECT<input, instruction, output>", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", "OBJECT<answer, question>", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def shape_of(record: Column) -> Column:
    """A variant's nested field paths, without the types of its values."""
    typed = F.schema_of_variant(record)
    return F.regexp_replace(typed, r": (?!ARRAY|OBJECT)[A-Z_ ]+(\([0-9, ]+\))?", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape_of(record))


def _turns(layout: Layout, record: Column) -> Column:
    empty = F.lit("")
    if layout.turns:
        listed = F.variant_get(record, f"$.{layout.turns}", f"array<struct<{layout.role}:string,{layout.text}:string>>")
        known = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
        plain = lambda t: F.coalesce(t[layout.role], empty)
        role = (lambda t: F.coalesce(F.try_element_at(known, plain(t)), plain(t))) if layout.role == "from" else plain
        return F.transform(listed, lambda t: F.struct(role(t).alias("role"), F.coalesce(t[layout.text], empty).alias("text")))
    own = lambda f: F.coalesce(F.variant_get(record, f"$.{f}", "string"), empty)
    texts = lambda fs: F.array_join(F.filter(F.array(*map(own, fs)), lambda x: x != ""), "\n\n") if len(fs) > 1 else own(fs[0])
    return F.array(*(F.struct(F.lit(r).alias("role"), texts(fs).alias("text")) for r, fs in layout.fields))


def canonical_turns(df: DataFrame, *, id_col: str, record_col: str) -> DataFrame:
    """``conv_id``, ``layout`` and ``turns`` of a table of variant records."""
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"), fingerprint(F.col(record_col)).alias("print"))
    layout, turns = F.lit(None).cast("string"), F.array().cast(f"array<{TURN}>")
    for x in LAYOUTS:
        hit = F.col("print") == F.xxhash64(F.lit(x.shape))
        layout = F.when(hit, F.lit(x.name)).otherwise(layout)
        turns = F.when(hit, _turns(x, F.col("record"))).otherwise(turns)
    return rows.select("conv_id", layout.alias("layout"), F.coalesce(turns, F.array().cast(f"array<{TURN}>")).alias("turns"))


def escape(text: Column) -> Column:
    for sign, to in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(to))
    return text


def unescape(text: Column) -> Column:
    for sign, to in reversed(ESCAPES):
        text = F.replace(text, F.lit(to), F.lit(sign))
    return text


#: Values that are summed together, so that running sums cost little in long conversations.
RUN = 256


def running_starts(lengths: Column) -> Column:
    """The sum of what stands before each length, by runs of RUN."""
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    before = lambda values, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(add(F.slice(values, 1, F.greatest(i, F.lit(1)))))
    n = F.ceil(F.size(lengths) / RUN).cast("int")
    runs = F.when(n == 0, F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: F.slice(lengths, b * RUN + 1, RUN)))

    def over(r: Column) -> Column:
        sums = F.transform(r, add)
        return let(sums, lambda s: let(F.transform(s, lambda x, i: before(s, i)), lambda starts: F.flatten(F.transform(r, lambda x, b: F.transform(x, lambda y, i: F.get(starts, b) + before(x, i))))))

    return let(runs, over)


def format_turns(df: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss`` (start and length of the escaped texts to learn)."""
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END))
    cut = df.select("conv_id", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("learn"))).alias("cut"))
    lengths = F.transform("cut", lambda c: (F.char_length(c["head"]) + F.char_length(c["body"]) + len(CLOSE)).cast("long"))
    spans = let(
        running_starts(lengths),
        lambda starts: F.filter(
            F.transform("cut", lambda c, i: F.struct((F.get(starts, i) + F.char_length(c["head"])).alias("start"), F.char_length(c["body"]).cast("long").alias("length"), c["learn"].alias("learn"))),
            lambda s: s["learn"],
        ),
    )
    text = F.array_join(F.transform("cut", lambda c: F.concat(c["head"], c["body"], F.lit(CLOSE))), "")
    return cut.select("conv_id", text.alias("formatted"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string."""
    parts = F.split(formatted, r"<\|end\|>\n")
    segments = F.slice(parts, F.lit(1), F.size(parts) - 1)
    mark = lambda s: F.locate(ROLE_END, s)
    role = lambda s: unescape(F.substring(s, F.lit(len(OPEN) + 1), mark(s) - (len(OPEN) + 1)))
    text = lambda s: unescape(F.substring(s, mark(s) + len(ROLE_END), F.char_length(s)))
    return F.transform(segments, lambda s: F.struct(role(s).alias("role"), text(s).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def gather(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of turns as ``conv_id`` and a variant ``record``, in the layout that fits the roles."""
    empty = F.lit("")
    rows = df.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("content")).alias("t"),
    )
    # Rows without an id never meet: each has a number of its own.
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    convs = rows.withColumn("alone", alone).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("t")).drop("alone")
    roles, text = F.transform("t", lambda t: t["role"]), lambda k: F.get("t", k)["content"]
    messages = F.to_variant_object(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")))
    pair = F.to_variant_object(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    led = F.to_variant_object(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")))
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    record = F.when(is_("user", "assistant"), pair).when(is_("system", "user", "assistant"), led).otherwise(messages)
    return convs.select("conv_id", record.alias("record"))
