"""Chat formatting by a finite-state machine over roles.

A template declares the machine (for each state, the role that leads on and the state after it, and
the states in which a conversation may end) and what is written for a turn: a head, the text and a
tail, with a loss flag each. The turns of a conversation run through the machine in order; those it
accepts give three segments for each turn, the others one row that says why.

A conversation may be of any length. Its turns are split into chunks of 2^CHUNK turn numbers, each
chunk becomes the function from the state before it to the state after, and the functions are
applied in order; so only roles are gathered, of a chunk at a time, and a text moves once. Whether
rows of one number differ is told by a 64-bit hash of their texts.

Cases: turns are ordered by their number; rows repeated in full count once, while two different rows
of one number, or a null number, reject the conversation, as does a null or unknown role. A null
text counts as empty; empty and very long texts are written whole. Rows without a conversation
can't be ordered and are left out. An empty table gives an empty result. Only the four named columns
are read, so others have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named


#: Turn numbers of a chunk, as a power of two.
CHUNK = 10


@dataclass(frozen=True)
class Template:
    """moves: {state: {role: next state}}; head, tail: with {role} wherever the role's name goes."""

    moves: dict[str, dict[str, str]]
    start: str
    ends: tuple[str, ...]
    head: str
    tail: str
    learned: tuple[str, ...]  # roles whose text bears loss
    learn_tail: bool = True  # whether the tail of such a turn does


CHATML = Template(
    moves={"open": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    start="open",
    ends=("answered",),
    head="<|im_start|>{role}\n",
    tail="<|im_end|>\n",
    learned=("assistant",),
)


def _moves(template: Template) -> Column:
    """The state that follows, by state and role."""
    pairs = [(f"{state}\x00{role}", to) for state, by in template.moves.items() for role, to in by.items()]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def _states(template: Template) -> list[str]:
    return sorted({template.start, *template.ends, *template.moves, *(to for by in template.moves.values() for to in by.values())})


def format_chats(df: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segment, turn, role, text, loss, error): segments count from 0 in each conversation."""
    rows = df.where(named(conv_col).isNotNull()).select(
        named(conv_col).alias("conv_id"), named(turn_col).cast("long").alias("turn"), F.struct(named(role_col).alias("role"), F.coalesce(named(text_col), F.lit("")).alias("text")).alias("r")
    )
    turns = rows.groupBy("conv_id", "turn").agg(F.min("r").alias("r"))  # repeated rows combine before they move
    mark = F.struct(F.col("r.role").alias("role"), F.xxhash64("r.text").alias("text"))
    marks = rows.select("conv_id", "turn", mark.alias("m")).groupBy("conv_id", "turn").agg(F.min("m").alias("m"), F.max("m").alias("z"))
    fault = F.when(F.col("turn").isNull(), 2).when(~F.col("m").eqNullSafe(F.col("z")), 1).otherwise(0)
    short = marks.select("conv_id", F.shiftright("turn", CHUNK).alias("chunk"), F.struct("turn", F.col("m.role").alias("role")).alias("t"), fault.alias("fault"))
    moves, states = _moves(template), _states(template)
    leads = [F.aggregate("turns", F.lit(s), lambda state, t: moves[F.concat(state, F.lit("\x00"), t["role"])]) for s in states]  # null once a turn finds no move
    chunks = short.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("turns"), F.max("fault").alias("fault"))
    chunks = chunks.select("conv_id", "chunk", "turns", "fault", F.array(*leads).alias("leads"))

    places = F.create_map(*[x for i, s in enumerate(states) for x in (F.lit(s), F.lit(i))])
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "leads")))
    state = F.aggregate("chunks", F.lit(template.start), lambda state, c: F.get(c["leads"], places[state]))
    judged = chunks.groupBy("conv_id").agg(ordered.alias("chunks"), F.max("fault").alias("fault")).select("conv_id", "fault", state.alias("state"))
    error = F.when(F.col("fault") == 2, "turn missing").when(F.col("fault") == 1, "turn repeated").when(F.col("state").isNull(), "turn order").when(~F.col("state").isin(*template.ends), "unfinished")
    judged = judged.select("conv_id", error.alias("error"))

    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counted = chunks.select("conv_id", "turns", F.coalesce(F.sum(F.size("turns")).over(earlier), F.lit(0)).alias("before"))
    good = counted.join(judged.where("error IS NULL").select("conv_id"), "conv_id").select("conv_id", "before", F.posexplode("turns").alias("i", "t"))
    order = good.select("conv_id", F.col("t.turn").alias("turn"), (F.col("before") + F.col("i")).alias("i"))

    filled = lambda text: F.replace(F.lit(text), F.lit("{role}"), F.col("r.role")) if "{role}" in text else F.lit(text)
    learned = F.col("r.role").isin(*template.learned)
    part = lambda k, text, loss: F.struct((F.col("i") * 3 + k).cast("int").alias("segment"), text.alias("text"), loss.alias("loss"))
    three = F.array(part(0, filled(template.head), F.lit(False)), part(1, F.col("r.text"), learned), part(2, filled(template.tail), learned & F.lit(template.learn_tail)))
    written = turns.join(order, ["conv_id", "turn"]).select("conv_id", "turn", F.col("r.role").alias("role"), F.explode(three).alias("p"))
    accepted = written.select("conv_id", "p.segment", "turn", "role", "p.text", "p.loss", F.lit(None).cast("string").alias("error"))
    rejected = judged.where("error IS NOT NULL").select("conv_id", *[F.lit(None).cast(accepted.schema[c].dataType).alias(c) for c in ("segment", "turn", "role", "text", "loss")], "error")
    return accepted.unionByName(rejected)


ORACLE = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
judged AS (
  SELECT conv_id,
    CASE WHEN bool_or(turn IS NULL) THEN 'turn missing'
         WHEN count(DISTINCT turn) < count(*) THEN 'turn repeated'
         WHEN NOT bool_and(CASE role
             WHEN 'system' THEN i = 1
             WHEN 'user' THEN i = 1 OR before IN ('system', 'assistant')
             WHEN 'assistant' THEN coalesce(before = 'user', FALSE)
             ELSE FALSE END) THEN 'turn order'
         WHEN max(CASE WHEN after IS NULL THEN role END) <> 'assistant' THEN 'unfinished' END AS error
  FROM numbered GROUP BY conv_id)
SELECT conv_id, CAST((i - 1) * 3 + k AS INTEGER) AS segment, turn, role,
  CASE k WHEN 0 THEN '<|im_start|>' || role || chr(10) WHEN 1 THEN text ELSE '<|im_end|>' || chr(10) END AS text,
  k > 0 AND role = 'assistant' AS loss, error
FROM numbered JOIN judged USING (conv_id), (VALUES (0), (1), (2)) AS parts(k) WHERE error IS NULL
UNION ALL
SELECT conv_id, NULL, NULL, NULL, NULL, NULL, error FROM judged WHERE error IS NOT NULL"""
