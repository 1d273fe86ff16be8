"""Chat formatting: roles through a finite-state machine, turns through a declarative template.

The template names the text before and after a turn, and the machine. A conversation becomes
segments, (text, loss) in order, whose texts joined are the formatted conversation: the mark
before a turn, its text, the mark after it. ``mask`` gives where in it, in bytes of UTF-8, the
text under the loss mask stands, so that a reader needs just the formatted text and the mask.
Every control string of the template begins with ``<``; where a turn's own text holds one,
that ``<`` is written as ``~1`` and each ``~`` as ``~0``, so that no text can end a turn
or begin one, and the text can be read back exactly.

The machine reads the roles in turn order: an optional system turn, then user and assistant
in turn, beginning with user. Each move leads to a state and says whether the turn is under the
loss mask. ``valid`` says whether the conversation passes and ``state`` where the machine
stands after it; conversations that do not pass are formatted all the same, and what an
assistant says out of turn is under the mask as well.

Cases: null text or role is the empty string; rows with a null conv_id are one conversation;
turns with the same number, null first, stand by role and text, and equal rows stay; an unknown
role leads to "error" and has no loss; an empty table gives an empty one; other columns drop. A
conversation is one row, and so must fit a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import let


@dataclass(frozen=True)
class Template:
    """Marks of a turn; ``control`` are the strings that may not stand in a text."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|end|>\n"
    control: tuple[str, ...] = ("<|turn|>", "<|says|>", "<|end|>", "</s>", "<s>")
    #: state -> {role: (next state, whether the turn is under the loss mask)}; what is not listed
    #: leads to "error" without loss.
    machine: dict[str, dict[str, tuple[str, bool]]] = field(default_factory=lambda: {
        "start": {"system": ("system", False), "user": ("user", False), "assistant": ("error", True)},
        "system": {"user": ("user", False), "assistant": ("error", True)},
        "user": {"assistant": ("assistant", True)},
        "assistant": {"user": ("user", False), "assistant": ("error", True)},
        "error": {"assistant": ("error", True)},
    })
    accepts: tuple[str, ...] = ("user", "assistant")


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for c in template.control:
        out = F.replace(out, F.lit(c), F.lit("~1" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def run_machine(roles: Column, template: Template = CHAT) -> Column:
    """Over an array of roles: ``at``, where the machine stands after them, and ``loss``, an
    array of whether each turn is under the mask."""

    def step(so_far: Column, role: Column) -> Column:
        to, loss = F.lit("error"), F.lit(False)
        for a, moves in template.machine.items():
            for r, (b, flag) in moves.items():
                here = (so_far["at"] == a) & (role == r)
                to, loss = F.when(here, F.lit(b)).otherwise(to), F.when(here, F.lit(flag)).otherwise(loss)
        return F.struct(to.alias("at"), F.array_append(so_far["loss"], loss).alias("loss"))

    return F.aggregate(roles, F.struct(F.lit("start").alias("at"), F.array().cast("array<boolean>").alias("loss")), step)


def masked(segments: Column) -> Column:
    """start and length, in bytes of the joined texts, of each segment under the mask."""

    def step(so_far: Column, s: Column) -> Column:
        size = F.octet_length(s["text"]).cast("long")
        more = F.array_append(so_far["spans"], F.struct(so_far["at"].alias("start"), size.alias("length")))
        return F.struct((so_far["at"] + size).alias("at"), F.when(s["loss"], more).otherwise(so_far["spans"]).alias("spans"))

    nothing = F.array().cast("array<struct<start:bigint,length:bigint>>")
    return F.aggregate(segments, F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("spans")), step)["spans"]


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, text) in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def format_chats(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, state, valid, segments (array of text, loss), formatted and mask."""
    def parts(t: Column, loss: Column) -> Column:
        head = F.concat(F.lit(template.turn), escape(t["role"], template), F.lit(template.says))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    c = conversations(rows).withColumn("run", run_machine(F.transform("turns", lambda t: t["role"]), template))
    c = c.select("conv_id", F.col("run.at").alias("state"), F.flatten(F.zip_with("turns", "run.loss", parts)).alias("segments"))
    return c.select("conv_id", "state", F.col("state").isin(*template.accepts).alias("valid"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), masked(F.col("segments")).alias("mask"))


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """From formatted and mask alone: conv_id, turns (role, text) as they were before formatting,
    and loss_text, all that is under the loss mask; state, valid and formatted stay."""
    pieces = F.filter(F.split("formatted", r"\Q" + template.turn + r"\E", -1), lambda _, i: i > 0)

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(1), F.length(p) - len(template.end))
        cut = F.instr(body, template.says)
        return F.struct(unescape(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + len(template.says))).alias("text"))

    under = let(F.col("formatted").cast("binary"), lambda raw: F.transform("mask", lambda m: unescape(F.substring(raw, m["start"].cast("int") + 1, m["length"].cast("int")).cast("string"))))
    loss = F.array_join(under, "")
    return formatted.select("conv_id", "state", "valid", "formatted", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"))


def digests(back: DataFrame) -> DataFrame:
    """What was read back, as counts and digests."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        "state", "valid",
    )


_ESC = "replace(replace(replace(replace(replace(replace({}, '~', '~0'), '<|turn|>', '~1|turn|>'), '<|says|>', '~1|says|>'), '<|end|>', '~1|end|>'), '</s>', '~1/s>'), '<s>', '~1s>')"
ORACLE_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), m AS (
  SELECT conv_id, CASE WHEN bool_and(CASE before WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' WHEN 'system' THEN role = 'user' ELSE place = 1 AND role IN ('system', 'user') END)
    THEN max(role) FILTER (WHERE place = n) ELSE 'error' END AS state FROM o GROUP BY conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(8 + 8 + 8 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT g.conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, state, state IN ('user', 'assistant') AS valid
FROM g JOIN m ON g.conv_id IS NOT DISTINCT FROM m.conv_id
"""
