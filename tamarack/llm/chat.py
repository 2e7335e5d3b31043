"""Chat formatting: schema fingerprints select declarative mappings into canonical turns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A turn is OPEN or REPLY, the role, TEXT, the text, END. REPLY opens a turn whose text is under the loss mask.
OPEN, REPLY, TEXT, END = "<|turn|>", "<|reply|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    r"""``<``, ``[`` and ``\`` get a ``\`` behind them, which breaks every control string that starts with one of the first two."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema, arrays as ``[]``."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


@dataclass(frozen=True)
class Mapping:
    """A layout's field paths, and its turns as an array of (role, text) given a function from path to column."""

    paths: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column]


def _messages(array: str, role: str, text: str) -> Mapping:
    return Mapping((f"{array}[].{role}", f"{array}[].{text}"), lambda c: F.transform(c(array), lambda m: _turn(m[role], m[text])))


#: Layouts known by name; a further one is one more entry.
LAYOUTS = {
    "messages": _messages("messages", "role", "content"),
    "conversations": _messages("conversations", "from", "value"),
    "prompt_response": Mapping(("prompt", "response"), lambda c: F.array(_turn("user", c("prompt")), _turn("assistant", c("response")))),
    "prompt_completion": Mapping(("prompt", "completion"), lambda c: F.array(_turn("user", c("prompt")), _turn("assistant", c("completion")))),
    "instruction": Mapping(("instruction", "output"), lambda c: F.array(_turn("user", c("instruction")), _turn("assistant", c("output")))),
    "instruction_input": Mapping(
        ("instruction", "input", "output"),
        lambda c: F.array(_turn("user", F.when(F.coalesce(c("input"), F.lit("")) == "", c("instruction")).otherwise(F.concat_ws("\n", c("instruction"), c("input")))), _turn("assistant", c("output"))),
    ),
}


@dataclass(frozen=True)
class TurnRows:
    """A layout with one row a turn: the columns that name the conversation, its order, the role and the text."""

    conversation: str
    order: str
    role: str
    text: str

    @property
    def paths(self) -> tuple[str, ...]:
        return (self.conversation, self.order, self.role, self.text)


LAYOUTS |= {
    "turn_rows": TurnRows("conv_id", "turn", "role", "text"),
    "message_rows": TurnRows("conversation_id", "message_index", "sender", "message"),
    "thread_rows": TurnRows("thread_id", "position", "author", "body"),
}
#: What a record's fingerprint is made of: the paths that some layout uses; all others don't count.
KNOWN = sorted({p for m in LAYOUTS.values() for p in m.paths})
BY_FINGERPRINT = {fingerprint(list(m.paths)): name for name, m in LAYOUTS.items()}
_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _ROLES.items() for x in kv]), role), role)


def render(turns: Column, loss_role: str = "assistant") -> Column:
    """The formatted text of an array of (role, text)."""
    one = lambda t: F.concat(F.when(t["role"] == loss_role, REPLY).otherwise(OPEN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def read_turns(formatted: Column) -> Column:
    """Back from the formatted text: array of (role, text, loss)."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.regexp_replace(F.substring_index(x, TEXT, 1), r"^<\|(turn|reply)\|>", "")).alias("role"),
            unescape(F.substring_index(x, TEXT, -1)).alias("text"),
            x.startswith(REPLY).alias("loss"),
        ),
    )


def _canonical(turns: Column) -> Column:
    """Empty where null, roles by their canonical names."""
    turns = F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>"))
    return F.transform(turns, lambda t: F.struct(_role(t["role"]).alias("role"), t["text"].alias("text")))


def format_table(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A table of one layout, whichever: the fingerprint of its nested field paths selects the mapping, which names the columns.

    Paths that no layout uses don't count. Raises ValueError for a layout that
    no mapping knows.

    - Nested records, one conversation a row: ``df`` with ``turns`` and
      ``formatted`` (columns of these names are replaced). Null arrays are
      conversations without turns.
    - Rows by turn: ``<conversation>, formatted``, one row a conversation. Turns
      go by their order, ties by role and text, a null order first; a null
      conversation is one; repeated rows are repeated turns; roles stay as
      they are. A conversation is one row of the result and so has to fit in
      memory.

    Null roles and texts are empty; an empty table gives an empty result.
    """
    found = fingerprint([p for f in df.schema.fields for p in field_paths(f.dataType, f.name) if p in KNOWN])
    if found not in BY_FINGERPRINT:
        raise ValueError(f"no mapping for the layout with fingerprint {found}")
    layout = LAYOUTS[BY_FINGERPRINT[found]]
    if isinstance(layout, Mapping):
        out = df.withColumn("turns", _canonical(layout.turns(lambda p: F.col(f"`{p}`"))))
        return out.withColumn("formatted", render(F.col("turns"), loss_role))
    turn = F.struct(F.col(layout.order).alias("at"), F.coalesce(layout.role, F.lit("")).alias("role"), F.coalesce(layout.text, F.lit("")).alias("text"))
    grouped = df.groupBy(layout.conversation).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(layout.conversation, render(F.col("turns"), loss_role).alias("formatted"))


def _under(array: str) -> Callable[[Column], Column]:
    return lambda key: F.concat(F.lit(f"{array}[]."), key)


def format_json(df: DataFrame, json_col: str) -> DataFrame:
    """Heterogeneous records as JSON text: ``df`` with ``layout``, ``turns`` and ``formatted`` (columns of these names are replaced).

    Each row's nested field paths are hashed where the row is, and the hash
    selects the row's mapping. Paths that no layout uses don't count, be they
    further keys of the record or of a message; an empty array stands for one
    of its layout. Rows that are null, no JSON object or of an unknown layout
    stay, with null in the three columns.
    """
    nested = {name: m for name, m in LAYOUTS.items() if isinstance(m, Mapping)}
    arrays = {p.split("[].")[0]: [q for q in m.paths] for m in nested.values() for p in m.paths if "[]." in p}
    flat = sorted({p for m in nested.values() for p in m.paths if "[]." not in p})
    kinds = [f"`{a}`:array<map<string,string>>" for a in arrays] + [f"`{p}`:string" for p in flat]
    rec = F.from_json(F.col(json_col), f"struct<{','.join(kinds)}>")
    keys = F.coalesce(F.json_object_keys(json_col), F.array().cast("array<string>"))
    paths = [F.array_intersect(keys, F.array(*map(F.lit, flat)))]
    for name, leaves in arrays.items():
        inside = F.array_distinct(F.flatten(F.transform(rec[name], F.map_keys)))
        inside = F.transform(inside, _under(name))
        every = F.array(*map(F.lit, leaves))
        own = F.when(F.size(rec[name]) == 0, every).otherwise(F.array_intersect(inside, F.array(*[F.lit(p) for p in KNOWN if p.startswith(f"{name}[].")])))
        paths.append(F.coalesce(own, F.array().cast("array<string>")))
    print_ = F.sha2(F.array_join(F.array_sort(F.concat(*paths)), "\n"), 256)
    layout = F.element_at(F.create_map(*[F.lit(x) for f, n in BY_FINGERPRINT.items() if n in nested for x in (f, n)]), print_)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, mapping in nested.items():
        turns = F.when(F.col("layout") == name, mapping.turns(lambda p: rec[p])).otherwise(turns)
    out = df.withColumn("layout", layout).withColumn("turns", F.when(F.col("layout").isNotNull(), _canonical(turns)))
    return out.withColumn("formatted", render(F.col("turns")))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say, read back: number of turns, digests of turns and of the text under the loss mask."""
    lines = F.array_join(F.transform(F.col("back"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(F.col("back"), lambda t: t["loss"]), lambda t: t["text"]), "")
    return (
        formatted.withColumn("back", read_turns(F.col("formatted")))
        .withColumn("loss", loss)
        .select(
            "conv_id",
            F.size("back").cast("long").alias("n_turns"),
            F.sha2(lines, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
