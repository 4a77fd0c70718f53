"""Chat formatting: a finite-state machine over roles checks the order of turns, and a template gives text segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import cut, unused

#: Rows of a conversation beyond which no task holds it whole: it is cut into stretches of as many turns.
HOT = 100_000


@dataclass(frozen=True)
class Template:
    """start/end: text before and after a turn ({role} stands for its role). loss: roles whose content and end are learnt."""

    start: str = "<|{role}|>\n"
    end: str = "<|end|>\n"
    opening: str = "<|begin|>"
    closing: str = "<|stop|>"
    loss: tuple[str, ...] = ("assistant",)


@dataclass(frozen=True)
class Machine:
    """Transitions (state, role) -> state; a conversation is valid if it ends in an accepting state. A missing transition rejects."""

    start: str = "begin"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict = field(
        default_factory=lambda: {
            ("begin", "system"): "system", ("begin", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant",
            ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant",
        }
    )


def _run(turns: Column, machine: Machine) -> Column:
    """The state after all turns; 'reject' once a transition is missing."""
    table = F.create_map(*[F.lit(x) for (s, r), t in machine.moves.items() for x in (f"{s}>{r}", t)])
    step = lambda state, turn: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), turn["role"])), F.lit("reject"))
    return F.aggregate(turns, F.lit(machine.start), step)


def _rows(turns: DataFrame) -> DataFrame:
    """(conv_id, t) with t the turn's number, role in lower case without outer blanks, and text."""
    return turns.select("conv_id", F.struct("turn", F.trim(F.lower("role")).alias("role"), "text").alias("t"))


def _gathered(turns: DataFrame, machine: Machine) -> DataFrame:
    """conversations() of those that a task may hold. Repeats stand side by side once sorted, so they go in one pass."""
    c = _rows(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("every"))  # one shuffle
    c = c.select("conv_id", F.filter("every", lambda t, i: (i == 0) | ~t.eqNullSafe(F.get("every", i - 1))).alias("turns"))
    missing = F.exists("turns", lambda t: t["turn"].isNull() | t["role"].isNull() | t["text"].isNull())
    again = F.size(F.array_distinct(F.transform("turns", lambda t: t["turn"]))) < F.size("turns")
    order = ~_run(F.col("turns"), machine).isin(*machine.accept)
    reason = F.when(missing, "null turn").when(again, "repeated turn").when(order, "order")
    return c.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def conversations(turns: DataFrame, machine: Machine | None = None) -> DataFrame:
    """(conv_id, turns, valid, reason) of each conversation, its turns an array of (turn, role, text) in order.

    A turn's order is its number; rows repeated in all four columns count once. reason is null if valid, else the first of:
    'null turn' (a turn without number, role or text), 'repeated turn' (two rows of one number that differ), 'order' (the
    machine rejects). Rows of null conv_id form one conversation. Roles are compared in lower case without outer blanks.
    A row holds its whole conversation here; `segments` has no such need.
    """
    return _gathered(turns, machine or Machine())


def _stretched(turns: DataFrame, machine: Machine, size: int) -> DataFrame:
    """(conv_id, k, n, t) of each turn of the valid ones among conversations of any length: k counts from 0, n is their number.

    Distinct turns are sorted over all tasks and numbered, and cut into stretches of `size` by their number. A stretch is known
    by its ends and by the state in which it leaves the machine for each state in which it may be entered; these are few, and
    what they make together says whether the conversation is valid.
    """
    spark = turns.sparkSession
    states = sorted({machine.start, "reject", *machine.moves.values(), *[s for s, _ in machine.moves]})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("conv_id").asc_nulls_first(), *[F.col(f"t.{c}").asc_nulls_first() for c in ("turn", "role", "text")]]
    ranged = cut(_rows(turns).distinct().repartitionByRange(parts, *key).sortWithinPartitions(*key)).withColumn("at", F.monotonically_increasing_id())
    pid, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    ends, place = {}, 0
    for p, rows in ranged.groupBy(pid.alias("p")).count().orderBy("p").collect():  # one row a partition
        ends[p], place = place, place + rows
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in ends.items() for x in kv]), pid) if ends else F.lit(0)
    placed = ranged.select("conv_id", "t", (offset + within).alias("g"))
    starts = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("g").alias("start"), F.count("*").alias("n"), F.bool_or(F.col("t.turn").isNull() | F.col("t.role").isNull() | F.col("t.text").isNull()).alias("missing"))
    numbered = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "t", (F.col("g") - F.col("start")).alias("k"), "n", "missing")
    narrow = numbered.select("conv_id", F.expr(f"k div {size}").alias("stretch"), F.struct("k", "t.turn", "t.role").alias("s"))
    held = narrow.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list("s")).alias("s"))
    table = F.create_map(*[F.lit(x) for (s, r), t in machine.moves.items() for x in (f"{s}>{r}", t)])
    step = lambda state, turn: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), turn["role"])), F.lit("reject"))
    leaves = F.map_from_arrays(F.array(*[F.lit(s) for s in states]), F.array(*[F.aggregate("s", F.lit(s), step) for s in states]))
    again = F.size(F.array_distinct(F.transform("s", lambda x: x["turn"]))) < F.size("s")
    known = held.select("conv_id", F.struct("stretch", F.element_at("s", 1)["turn"].alias("first"), F.element_at("s", -1)["turn"].alias("last"), again.alias("again"), leaves.alias("leaves")).alias("x"))
    whole = known.groupBy("conv_id").agg(F.array_sort(F.collect_list("x"), lambda a, b: (a["stretch"] - b["stretch"]).cast("int")).alias("xs"))
    met = F.exists(F.sequence(F.lit(1), F.size("xs")), lambda i: (i > 1) & (F.get("xs", i - 1)["first"] == F.get("xs", i - 2)["last"]))
    final = F.aggregate("xs", F.lit(machine.start), lambda state, x: F.element_at(x["leaves"], state))
    valid = whole.where(~F.exists("xs", lambda x: x["again"]) & ~met & final.isin(*machine.accept)).select(F.col("conv_id").alias("valid_id"))
    return numbered.where("not missing").join(valid, F.col("conv_id").eqNullSafe(F.col("valid_id")), "left_semi").select("conv_id", "k", "n", "t")


def segments(turns: DataFrame, machine: Machine | None = None, template: Template | None = None, hot: int = HOT) -> DataFrame:
    """(conv_id, seg, role, text, loss): the pieces of every valid conversation, in order of seg, which joined give its text.

    Each turn gives its header (no loss), its content and its end (loss for the template's roles, if any); before the first
    turn stands the opening, after the last the closing (loss if its turn has). Empty contents stay as empty segments.
    Conversations that `conversations` calls invalid give none; an empty table gives an empty result; further columns don't
    matter. Conversations of more than `hot` rows are spread over tasks; their rows are the same.
    """
    machine, template = machine or Machine(), template or Template()
    learnt = lambda role: role.isin(*template.loss) if template.loss else F.lit(False)
    piece = lambda role, text, loss: F.struct(role.cast("string").alias("role"), text.alias("text"), loss.alias("loss"))
    nothing, no = F.lit(None), F.lit(False)
    head, tail = template.start.split("{role}", 1) if "{role}" in template.start else (template.start, None)
    header = lambda role: F.concat(F.lit(head), role, F.lit(tail)) if tail is not None else F.lit(head)
    pieces_of = lambda t: F.array(piece(t["role"], header(t["role"]), no), piece(t["role"], t["text"], learnt(t["role"])), piece(t["role"], F.lit(template.end), learnt(t["role"])))
    opening, closing = F.array(piece(nothing, F.lit(template.opening), no)), lambda role: F.array(piece(nothing, F.lit(template.closing), learnt(role)))
    only = turns.select("conv_id", "turn", "role", "text")
    large = only.groupBy("conv_id").count().where(F.col("count") > hot).select(F.col("conv_id").alias(unused(only, "hot_id")))
    some = not (large := cut(large)).isEmpty()
    on = F.col("conv_id").eqNullSafe(F.col(large.columns[0]))
    small = only.join(large, on, "left_anti") if some else only
    pieces = F.concat(opening, F.flatten(F.transform("turns", pieces_of)), closing(F.element_at("turns", -1)["role"]))
    out = _gathered(small, machine).where("valid").select("conv_id", F.posexplode(pieces).alias("seg", "p")).select("conv_id", F.col("seg").cast("bigint").alias("seg"), "p.role", "p.text", "p.loss")
    if not some:
        return out
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())])))
    each = F.concat(F.when(F.col("k") == 0, opening).otherwise(none), pieces_of(F.col("t")), F.when(F.col("k") == F.col("n") - 1, closing(F.col("t.role"))).otherwise(none))
    first = F.when(F.col("k") == 0, 0).otherwise(3 * F.col("k") + 1)
    long = _stretched(only.join(large, on, "left_semi"), machine, max(hot, 1)).select("conv_id", first.alias("first"), F.posexplode(each).alias("i", "p"))
    return out.unionByName(long.select("conv_id", (F.col("first") + F.col("i")).cast("bigint").alias("seg"), "p.role", "p.text", "p.loss"))


SQL = r"""
with t as (select distinct conv_id, turn, trim(lower(role), ' ') as role, text from conversations),
o as (
  select *, lag(role) over w as before, row_number() over w as k, count(*) over c as n
  from t window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first), c as (partition by conv_id)
),
v as (
  select conv_id from o group by conv_id
  having bool_and(turn is not null and role is not null and text is not null) and count(distinct turn) = count(*)
    and bool_and(case when k = 1 then role in ('system', 'user')
                      else (before || '>' || role) in ('system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant') end)
    and max(case when k = n then role end) = 'assistant'
),
x as (select o.* from o join v on o.conv_id is not distinct from v.conv_id)
select conv_id, 0 as seg, cast(null as varchar) as role, '<|begin|>' as text, false as loss from x where k = 1
union all select conv_id, 3 * k - 2, role, '<|' || role || '|>' || chr(10), false from x
union all select conv_id, 3 * k - 1, role, text, role = 'assistant' from x
union all select conv_id, 3 * k, role, '<|end|>' || chr(10), role = 'assistant' from x
union all select conv_id, 3 * k + 1, null, '<|stop|>', role = 'assistant' from x where k = n
"""
