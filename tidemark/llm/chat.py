"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (fixed strings):

    conversation := "<s>" turn* "</s>"
    turn         := "[INST]" text "[/INST]"            role user
                  | "[OUT]" text "[/OUT]"              role assistant, under the loss mask
                  | "[ROLE=" role "]" text "[/ROLE]"   any other role

Rendered text is read by a parser that cuts at closing marks. Where the recovered turns differ from the source
(a text holds a control string), the conversation's texts and roles are escaped: one backslash goes behind the
first character of every control string and of every control string that already has backslashes there.
Reading takes one backslash away again, so escaping is reversible for any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
#: Closing mark of each kind of turn; "]" inside a role would end its mark, so roles escape it as well.
_CLOSE = r"\[/INST\]|\[/OUT\]|\[/ROLE\]"
_CONTROL_TAILS = r"/?s>|/?INST\]|/?OUT\]|/ROLE\]|ROLE="
_RAW = rf"([<\[])(\\*)(?={_CONTROL_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)(?={_CONTROL_TAILS})"
CHUNK_TURNS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def escape_role(role: Column) -> Column:
    """As ``escape``; "%" and "]" become "%25" and "%5D", so that a role never ends its mark."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column) -> Column:
    return (F.when(role == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
            .when(role == "assistant", F.concat(F.lit("[OUT]"), text, F.lit("[/OUT]")))
            .otherwise(F.concat(F.lit("[ROLE="), role, F.lit("]"), text, F.lit("[/ROLE]"))))


def parse_turns(body: Column) -> Column:
    """The turns between BEGIN and END as array<struct<role, text>>, unescaped."""
    pieces = F.regexp_extract_all(body, F.lit(rf"(?s)\[(?:INST|OUT|ROLE=[^\]]*)\].*?(?:{_CLOSE})"), F.lit(0))

    def read(piece: Column) -> Column:
        role = (F.when(F.startswith(piece, F.lit("[INST]")), F.lit("user"))
                .when(F.startswith(piece, F.lit("[OUT]")), F.lit("assistant"))
                .otherwise(unescape_role(F.regexp_extract(piece, r"(?s)^\[ROLE=([^\]]*)\]", 1))))
        text = F.regexp_extract(piece, rf"(?s)^\[(?:INST|OUT|ROLE=[^\]]*)\](.*)(?:{_CLOSE})$", 1)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, read)


def _render(turns: Column, escaped: bool) -> Column:
    def one(turn: Column) -> Column:
        if escaped:
            return render_turn(escape_role(turn["role"]), escape(turn["text"]))
        return render_turn(turn["role"], turn["text"])

    return F.array_join(F.transform(turns, one), "")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, formatted.

    Turns are ordered by (turn, role, text), null turns first, so ties and repeated rows have one order and all
    stay. Null text and null role count as empty; a null identifier is a conversation of its own; an empty
    table gives no rows. Other columns are ignored. Turns are rendered, read back and escaped in chunks of
    ``CHUNK_TURNS`` turn numbers, so the work on a very long conversation spreads; only its finished
    chunks meet in its one output row.
    """
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS))
    chunks = rows.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    chunks = chunks.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))

    # as it is; escaped where that does not read back; an error if even this does not
    chunks = chunks.withColumn("part", _render(F.col("turns"), escaped=False))
    chunks = chunks.withColumn("same", _reads_back(F.col("part"), F.col("turns")))
    chunks = chunks.withColumn("part", F.when(F.col("same"), F.col("part")).otherwise(_render(F.col("turns"), escaped=True)))
    chunks = chunks.withColumn("same", F.col("same") | _reads_back(F.col("part"), F.col("turns")))
    checked = F.when(F.col("same"), F.col("part")).otherwise(F.raise_error(F.lit("a formatted conversation does not read back")))
    whole = chunks.select("conv", "chunk", checked.alias("part")).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return whole.select(F.col("conv").alias(conv_col), F.concat(F.lit(BEGIN), body, F.lit(END)).alias("formatted"))


def _reads_back(part: Column, turns: Column) -> Column:
    """Whether the parser finds these turns, and nothing that the tokenizer would take for a mark inside them."""
    marks = F.regexp_count(part, F.lit(r"</?s>|\[/?INST\]|\[/?OUT\]|\[/ROLE\]|\[ROLE="))
    return (marks == 2 * F.size(turns)) & (parse_turns(part) == turns)


def read_conversations(formatted: DataFrame, text_col: str = "formatted") -> DataFrame:
    """``formatted`` with the turns read back: array<struct<role, text>>."""
    body = F.substr(F.col(text_col), F.lit(len(BEGIN) + 1), F.length(text_col) - F.lit(len(BEGIN) + len(END)))
    return formatted.withColumn("turns", parse_turns(body))


def digests(read: DataFrame, conv_col: str = "conv_id", text_col: str = "formatted") -> DataFrame:
    """Lengths and digests of what ``read_conversations`` found."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    own = F.filter("turns", lambda t: t["role"] == "assistant")
    read = read.withColumn("loss", F.array_join(F.transform(own, lambda t: t["text"]), ""))
    return read.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length(text_col).cast("long").alias("formatted_chars"))
