"""Chat formatting that can be read back: rendered turns, a parser of their grammar, escapes where needed.

DataFrame functions only. The grammar of a formatted conversation is

    conversation := turn*
    turn         := "<|im_start|>" role LF body "<|im_end|>" LF

A body holds no control string, that is no ``<|``. Reading a body takes one backslash out of
every ``<``, backslashes, ``|``, so a body that needs one gets one: ``<|`` is written
``<\\|`` and ``<\\|`` is written ``<\\\\|``. Roles are one line without ``|``: ``%``, ``|``
and line feeds are written as ``%25``, ``%7C`` and ``%0A``.

Every turn makes the round trip: it is rendered as it is, parsed, and compared with its
source. Where that differs, its content is escaped and the trip is made again. What still
differs then stops the query, as does a conversation whose turns do not come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.places import quoted

# The strings that mark turns.
START = "<|im_start|>"
END = "<|im_end|>\n"

_CONTROL = "<|"
_TURN = "struct<role:string,text:string>"
#: The roles whose texts a model is trained on.
TRAINED = ("assistant",)


def format_conversations(
    rows: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: tuple[str, ...] = TRAINED,
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are the places (``first`` code point from 0, ``n_chars``) of the bodies
    of trained roles in ``formatted``, in order; they hold escaped text and no marks. Turns
    go by number, equal numbers by role and text, null numbers first; repeated rows are
    turns of their own. Null texts and roles are empty ones. Rows without conversation are
    one conversation without id. An empty table has none. A conversation is a row of the
    result, so it must fit into one (2 GB).
    """
    turns = rows.select(
        quoted(conversation).alias("conv_id"),
        quoted(turn).alias("turn"),
        F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"),
    )
    trip = turns.withColumn("plain", _render(F.col("role"), F.col("text")))
    trip = trip.withColumn("escaped", ~_comes_back(F.col("plain"), F.col("role"), F.col("text")))
    trip = trip.withColumn(
        "rendered", F.when(F.col("escaped"), _render(_escape_role(F.col("role")), _escape(F.col("text")))).otherwise(F.col("plain"))
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n_chars = F.char_length("rendered")
    body = n_chars - F.lit(len(END)) - F.char_length(F.substring_index("rendered", "\n", 1)) - 1
    trip = trip.select(
        "conv_id",
        F.row_number().over(in_order).alias("at"),
        "role",
        "text",
        "rendered",
        (F.sum(n_chars.cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - len(END) - body).alias("first"),
        body.cast("long").alias("n_chars"),
    )
    whole = trip.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "rendered", "first", "n_chars"))).alias("turns"))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    spans = F.transform(
        F.filter("turns", lambda x: x["role"].isin(*trained)),
        lambda x: F.struct(x["first"].alias("first"), x["n_chars"].alias("n_chars")),
    )
    made = whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda x: x["rendered"]), "").alias("formatted"), spans.alias("loss_spans"), source.alias("source")
    )
    same = parse_conversation(F.col("formatted")).eqNullSafe(F.col("source"))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not come back as its turns")))
    return made.select("conv_id", checked.alias("formatted"), "loss_spans")


def parse_conversation(formatted: Column) -> Column:
    """The turns (``role``, ``text``) of a formatted conversation; null where the grammar does not hold."""
    parts = F.split(formatted, _literal(END), -1)
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _parse_turn)
    valid = (F.element_at(parts, -1) == "") & ~F.exists(turns, lambda x: x.isNull())
    return F.when(valid, turns)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask of a formatted conversation, unescaped, in order."""
    return F.transform(spans, lambda x: _unescape(F.substring(formatted, (x["first"] + 1).cast("int"), x["n_chars"].cast("int"))))


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END))


def _comes_back(rendered: Column, role: Column, text: Column) -> Column:
    """Whether parsing gives exactly the one turn that was rendered."""
    found = parse_conversation(rendered)
    return F.coalesce(found == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))


def _parse_turn(part: Column) -> Column:
    """A turn without its end mark; null where it is none."""
    inner = F.substr(part, F.lit(len(START) + 1))
    # Taken by length: what follows the first line feed, however many there are.
    role = F.substring_index(inner, "\n", 1)
    body = F.substr(inner, F.char_length(role) + 2)
    good = part.startswith(START) & inner.contains("\n") & ~body.contains(_CONTROL) & ~role.contains("|")
    return F.when(good, F.struct(_unescape_role(role).alias("role"), _unescape(body).alias("text"))).otherwise(F.lit(None).cast(_TURN))


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    for plain, written in _IN_ROLES:
        role = F.replace(role, F.lit(plain), F.lit(written))
    return role


def _unescape_role(role: Column) -> Column:
    for plain, written in reversed(_IN_ROLES):
        role = F.replace(role, F.lit(written), F.lit(plain))
    return role


#: The per cent sign comes first when escaping and so last when reading.
_IN_ROLES = (("%", "%25"), ("|", "%7C"), ("\n", "%0A"))


def _literal(text: str) -> str:
    return "".join(f"\\{x}" if x in "<|>" else x for x in text)
