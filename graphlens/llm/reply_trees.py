"""Chat formatting of reply trees, with built-in functions only.

Messages name the message they answer. Iterative self-joins find each message's 2^k-th ancestor, its depth and the scores on
its way from the root; the leaves, which stand for the root-to-leaf paths, are ranked by mean score; and the same ancestor
tables, from the farthest to the nearest, give the messages of each chosen path exactly once. So a tree of depth d takes
about 2 log2(d) joins by (tree, message), whatever its size, and no list of ancestors is held before the path is formatted.

Each turn stands between marks of its role. Inside texts a backslash goes before each backslash and behind the first
character of each mark, so no text holds a mark, and taking backslashes out again gives the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, table

BEGIN, END = "<s>", "</s>"
#: Opening and closing marks by role; any other role is written between marks of its own before the text.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "[/ANS]")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
LEARNED = "assistant"

_CONTROL = [BEGIN, END, *(m for pair in MARKS.values() for m in pair), *OTHER]


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


#: A backslash, or the place behind the first character of a mark.
_ESCAPED = "|".join([r"\\", *(f"(?<={_quoted(m[0])})(?={_quoted(m[1:])})" for m in _CONTROL)])
_TURNS = "(?s)" + "|".join(f"{_quoted(a)}.*?{_quoted(b)}" for a, b in [*MARKS.values(), (OTHER[0], OTHER[2])])


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def ancestors(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(reached, jumps) for messages(t, m, parent, score): reached(t, m, depth, total) has each message with a root, total the
    scores from the root to it; jumps[k](t, m, up) has its 2^k-th ancestor, where there is one."""
    ids = messages.select("t", F.col("m").alias("parent"), F.lit(True).alias("known"))
    start = messages.join(ids, ["t", "parent"], "left")
    state = materialize(start.select("t", "m", F.when(F.col("known"), F.col("parent")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"), F.col("score").alias("total")))
    done, jumps, most = [state.where("up IS NULL").drop("up")], [], None
    active = state.where("up IS NOT NULL")
    while active.limit(1).count():
        most = state.count() if most is None else most
        if 1 << len(jumps) > most:  # what is left answers itself
            break
        jumps.append(active.select("t", "m", "up"))
        above = active
        for part in done:
            above = above.unionByName(part.withColumn("up", F.lit(None).cast("long")))
        above = above.select("t", F.col("m").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("sum"))
        moved = active.join(above, ["t", "up"]).select("t", "m", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("sum")).alias("total"))
        moved = materialize(moved)
        done.append(moved.where("up IS NULL").drop("up"))
        active = moved.where("up IS NOT NULL")
    reached = done[0]
    for part in done[1:]:
        reached = reached.unionByName(part)
    return reached, jumps


def paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """tree_id, leaf, branch, place, role, text: the messages of the `best` root-to-leaf paths of each tree (None: of all).

    messages: tree_id, message_id, parent_id, role, text, score. A path's rank, branch, goes by the mean score of its
    messages (null: 0), ties by the smaller leaf; with best=None branch is null. place counts from 0 at the root. A message
    whose parent is null or not in its tree is a root. Of rows with one tree and message id one with the smallest (parent,
    role, text, score) counts; a null message id is taken as -1. Messages that answer each other in a ring have no root and
    are on no path. Rows with a null tree_id are one tree. An empty table gives an empty result.
    """
    kept = messages.select(
        F.coalesce(F.concat(F.lit("i"), F.col("tree_id").cast("string")), F.lit("null")).alias("t"), "tree_id", F.coalesce(F.col("message_id").cast("long"), F.lit(-1)).alias("m"),
        F.col("parent_id").cast("long").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    one = kept.groupBy("t", "m").agg(F.min(F.struct("parent", "role", "text", "score", "tree_id")).alias("x"))
    rows = materialize(one.select("t", "m", "x.*"))
    reached, jumps = ancestors(rows.select("t", "m", "parent", "score"))
    answered = rows.select("t", F.col("parent").alias("m"))
    leaves = reached.join(answered, ["t", "m"], "left_anti").select("t", F.col("m").alias("leaf"), "depth", (F.col("total") / (F.col("depth") + 1)).alias("mean"))
    if best is None:
        chosen = leaves.withColumn("branch", F.lit(None).cast("int"))
    else:
        rank = F.row_number().over(Window.partitionBy("t").orderBy(F.col("mean").desc(), "leaf"))
        chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= best)
    on = materialize(chosen.select("t", "leaf", "branch", F.col("leaf").alias("m"), F.col("depth").alias("place")))
    for k in reversed(range(len(jumps))):
        more = on.join(jumps[k], ["t", "m"]).select("t", "leaf", "branch", F.col("up").alias("m"), (F.col("place") - (1 << k)).alias("place"))
        on = materialize(on.unionByName(more))
    return on.join(rows, ["t", "m"]).select("tree_id", "leaf", "branch", "place", "role", "text")


def format_turns(turns: DataFrame, keys: list[str], order: str = "place") -> DataFrame:
    """keys, formatted, loss: one text for each group of turns(role, text), and its mask: the byte spans (start from 0, bytes)
    of the assistant's texts. Turns go by `order`, which is unique in a group. A group's text is one row, so it has to fit one."""
    text, role = escape(F.col("text")), F.col("role")
    opened, closed = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (a, b) in MARKS.items():
        opened, closed = F.when(role == name, F.lit(a)).otherwise(opened), F.when(role == name, F.lit(b)).otherwise(closed)
    parts = turns.select(*keys, order, role, opened.alias("opened"), text.alias("inner"), closed.alias("closed"))
    parts = parts.withColumn("part", F.concat("opened", "inner", "closed"))
    before = F.sum(F.octet_length("part")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + len(BEGIN) + F.octet_length("opened")
    span = F.when(role == LEARNED, F.struct(start.alias("start"), F.octet_length("inner").cast("long").alias("bytes")))
    grouped = parts.select(*keys, order, "part", span.alias("span")).groupBy(*keys)
    both = grouped.agg(F.sort_array(F.collect_list(F.struct(order, "part"))).alias("parts"), F.sort_array(F.collect_list("span")).alias("loss"))
    return both.select(*keys, F.concat(F.lit(BEGIN), F.array_join("parts.part", ""), F.lit(END)).alias("formatted"), "loss")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""

    def one(x: Column) -> Column:
        role = unescape(F.regexp_extract(x, f"(?s)^{_quoted(OTHER[0])}(.*?){_quoted(OTHER[1])}", 1))
        text = F.regexp_extract(x, f"(?s){_quoted(OTHER[1])}(.*){_quoted(OTHER[2])}$", 1)
        for name, (a, b) in MARKS.items():
            own = x.startswith(a)
            role, text = F.when(own, F.lit(name)).otherwise(role), F.when(own, F.substring(x, F.lit(len(a) + 1), F.length(x) - len(a) - len(b))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURNS), F.lit(0)), one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return let(formatted.cast("binary"), lambda raw: F.array_join(F.transform(loss, lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), ""))


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Conversations(conv_id, turn, role, text) as trees: each row, by turn, answers the one before it; ties go by role and text.

    So each conversation has one path, with all its rows. Null turns come first.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    numbered = rows.select(F.col("conv_id").alias("tree_id"), number.alias("message_id"), "role", "text")
    return numbered.withColumns({"parent_id": F.when(F.col("message_id") > 1, F.col("message_id") - 1), "score": F.lit(0.0)})


def op13_chat_format(spark, sf_dir):
    added = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").unionByName(added)
    chosen = paths(conversations_as_trees(rows))
    out = format_turns(chosen, ["tree_id", "leaf"])
    back = out.withColumns({"turns": read_turns(F.col("formatted")), "learned": read_loss(F.col("formatted"), F.col("loss"))})
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha(text).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), sha(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _marked(col: str) -> str:
    """SQL: how many backslashes escaping adds."""
    return " + ".join(f"(length({col}) - length(replace({col}, '{m}', ''))) // {len(m)}" for m in ["\\", *_CONTROL])


_WIDTHS = " ".join(f"WHEN role = '{k}' THEN {len(a) + len(b)}" for k, (a, b) in MARKS.items())

QUERIES = {"op13_chat_format": op13_chat_format}
ORACLES = {
    "op13_chat_format": f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, length(text) + {_marked('text')} + CASE {_WIDTHS} ELSE {sum(map(len, OTHER))} + length(role) + {_marked('role')} END AS chars FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), '') AS learned, sum(chars) AS chars FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars + {len(BEGIN + END)} AS BIGINT) AS formatted_chars FROM g
""",
}
