"""Chat formatting: a state machine over roles, and text segments with loss flags from a declarative template.

Built from DataFrame functions only.  A conversation becomes one row: its
formatted text, the segments that text is made of (each under the loss or not),
and whether its roles come in an order that the template's state machine
accepts.  Control strings inside texts are escaped, so the formatted text can
be read back (``parse``) to exactly the turns that went in.

One shuffle brings the turns of a conversation together, since its text is one
value; apart from that everything is per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, whose text is learned, and which role may follow which.

    A turn is ``opening`` + role + ``role_end`` + text + ``closing``.  ``follows``
    maps a state (a role, or "" before the first turn) to the roles allowed
    next; ``final`` are the states a conversation may end in.
    """

    opening: str = "<|im_start|>"
    role_end: str = "\n"
    closing: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        # escaping a text takes the one pair of characters apart that all marks begin with
        if not (self.opening.startswith("<|") and self.closing.startswith("<|") and self.role_end):
            raise ValueError("opening and closing must begin with '<|', and something must end a role")


CHATML = Template()


def escape(text: Column) -> Column:
    r"""One backslash more between ``<`` and ``|``: no control string is left, and none is lost."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _written_role(role: Column) -> Column:
    # a role that could be taken for syntax is written in hexadecimal
    return F.when(role.rlike(r"[\\|\n]"), F.concat(F.lit(r"\x"), F.hex(F.encode(role, "UTF-8")))).otherwise(role)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per ``conv_id``: ``formatted``, ``segments`` (array of text and loss), ``n_turns``, ``valid``.

    ``turns`` needs ``conv_id``, ``turn``, ``role`` and ``text``; other columns
    are ignored.  Turns are in order of ``turn``, nulls first, ties by role,
    then text; repeated rows are turns of their own.  A null role or text is
    empty.  Rows without a conv_id are one conversation.  Conversations with
    an order that the state machine doesn't accept are formatted as they are
    and have ``valid`` false.  An empty table gives no rows.
    """
    t = template
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    moves = F.create_map(*[F.lit(x) for state, roles in t.follows.items() for role in roles for x in (f"{state}\n{role}", role)])
    # the state after each turn; null, once an order is refused, leads nowhere
    state = F.aggregate("turns", F.lit(""), lambda s, x: F.try_element_at(moves, F.concat(s, F.lit("\n"), x.role)))

    def written(x: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(t.opening), _written_role(x.role), F.lit(t.role_end)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x.text).alias("text"), x.role.isin(*t.learned).alias("loss")),
            F.struct(F.lit(t.closing).alias("text"), F.lit(False).alias("loss")),
        )

    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.coalesce(state.isin(*t.final), F.lit(False)).alias("valid"),
        F.flatten(F.transform("turns", written)).alias("segments"),
    ).withColumn("formatted", F.concat_ws("", "segments.text"))


def parse(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (array of role and text) of a formatted text, unescaped."""
    t = template
    parts = F.split(formatted, rf"\Q{t.closing}\E")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    heads = F.transform(parts, lambda p: F.struct(F.substring_index(p, t.role_end, 1).alias("head"), p.alias("turn")))

    def read(p: Column) -> Column:
        skipped = len(t.opening)
        role = p.head.substr(F.lit(skipped + 1), F.length(p.head))
        plain = F.when(role.startswith(r"\x"), F.decode(F.unhex(role.substr(F.lit(3), F.length(role))), "UTF-8")).otherwise(role)
        text = p.turn.substr(F.length(p.head) + len(t.role_end) + 1, F.length(p.turn))
        return F.struct(plain.alias("role"), unescape(text).alias("text"))

    return F.transform(heads, read)


def learned_text(segments: Column) -> Column:
    """All text under the loss, unescaped, in order."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)))
