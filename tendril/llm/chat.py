"""Prefix trees of conversations: shared turns once, depth first, with positions and ancestor intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.operators.skew import ranked
from tendril.session import materialize

#: The template: a turn is OPEN, role, line feed, text, CLOSE.
OPEN, CLOSE = "<|turn|>", "<|over|>\n"
#: Ranks that one window task adds up; the totals of the bins are one row each.
BIN = 65_536


def escape(text: Column) -> Column:
    """No template marker survives: they begin with ``<|``, which becomes ``&lt;|``."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, leaf, path, nodes): the turns of a conversation in order, each named by a digest of all up to it.

    Null roles and texts are empty; turns with the same number go by role and text, null numbers first.
    A null conv_id is a conversation of its own. A conversation is one training example and its hash runs
    over all its turns in order, so it is the unit that one task holds.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def step(done: Column, turn: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape_role(turn["role"]), F.lit("\n"))
        body = escape(turn["text"])
        parent = F.coalesce(F.get(done, F.size(done) - 1)["node"], F.lit(""))
        formatted = F.concat(head, body, F.lit(CLOSE))
        learnt = turn["role"] == "assistant"
        return F.concat(
            done,
            F.array(
                F.struct(
                    F.substring(F.sha2(F.concat(parent, formatted), 256), 1, 32).alias("node"),
                    parent.alias("parent"),
                    formatted.alias("formatted"),
                    F.when(learnt, F.length(head)).otherwise(0).alias("loss_from"),
                    F.when(learnt, F.length(body)).otherwise(0).alias("loss_chars"),
                )
            ),
        )

    empty = F.expr("cast(array() as array<struct<node:string,parent:string,formatted:string,loss_from:int,loss_chars:int>>)")
    nodes = F.aggregate("turns", empty, step)
    return grouped.select("conv_id", nodes.alias("nodes")).select(
        "conv_id",
        F.element_at("nodes", -1)["node"].alias("leaf"),
        F.array_join(F.transform("nodes", lambda x: x["node"]), "").alias("path"),
        "nodes",
    )


def pack(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packed, routes) of what ``conversations_of`` returns.

    packed: one row per node of the prefix trees: tree, node, parent, formatted, start and length in the
    depth-first stream of its tree (a token is a code point), position of its first token within its
    conversation, loss_from and loss_chars (the text under the loss mask), ancestors (intervals of the
    stream that it may attend to; inside itself attention is causal).
    routes: one row per node on the way to a leaf: leaf, depth, tree, start.

    Conversations sorted by their digests stand in depth-first order of leaves; a node belongs to the
    first that passes it. Equal conversations meet once, and a shared turn is summed up before it is
    shuffled, so neither a frequent conversation nor a frequent first turn gathers in one task.
    """
    whole = conversations.groupBy("leaf").agg(F.first("path").alias("path"), F.first("nodes").alias("nodes"))
    whole = materialize(whole, "conversations")
    order = ranked(whole.select("leaf", "path"), [F.col("path")]).select("leaf", "rank")
    passes = whole.join(order, "leaf").select("leaf", "rank", F.col("nodes")[0]["node"].alias("tree"), F.posexplode("nodes").alias("depth", "n"))
    passes = materialize(passes.select("leaf", "rank", "tree", "depth", F.col("n.node").alias("node"), F.length("n.formatted").alias("length")), "passes")
    owned = materialize(passes.groupBy("node").agg(F.min("rank").alias("rank"), F.first("depth").alias("depth"), F.first("tree").alias("tree"), F.first("length").alias("length")), "nodes")

    bins = owned.groupBy("rank").agg(F.first("tree").alias("tree"), F.sum("length").alias("emitted")).withColumn("bin", F.floor(F.col("rank") / BIN))
    totals = bins.groupBy("bin").agg(F.sum("emitted").alias("total"))
    before = totals.select("bin", (F.sum("total").over(Window.orderBy("bin")) - F.col("total")).alias("before"))
    inside = F.sum("emitted").over(Window.partitionBy("bin").orderBy("rank")) - F.col("emitted")
    offsets = bins.withColumn("inside", inside).join(before, "bin").select("rank", "tree", (F.col("before") + F.col("inside")).alias("offset"))
    first = offsets.groupBy("tree").agg(F.min("offset").alias("origin"))
    offsets = offsets.join(first, "tree").select("rank", (F.col("offset") - F.col("origin")).alias("offset"))
    along = F.sum("length").over(Window.partitionBy("rank").orderBy("depth")) - F.col("length")
    starts = materialize(owned.withColumn("along", along).join(offsets, "rank").select("node", F.col("rank").alias("owner"), (F.col("offset") + F.col("along")).alias("start")), "starts")

    routed = passes.join(starts, "node")
    path = Window.partitionBy("leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    interval = F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end"))
    seen = routed.select("*", F.coalesce(F.sum("length").over(path), F.lit(0)).alias("position"), F.collect_list(interval).over(path).alias("ancestors"))
    own = seen.filter("rank = owner").select("leaf", "depth", "tree", "node", "start", "length", "position", "ancestors")
    texts = whole.select("leaf", F.posexplode("nodes").alias("depth", "n"))
    packed = own.join(texts, ["leaf", "depth"]).select("tree", "node", "n.parent", "start", "length", "position", "ancestors", "n.formatted", "n.loss_from", "n.loss_chars")
    return materialize(packed, "packed"), routed.select("leaf", "depth", "tree", "start")


def read_back(packed: DataFrame, routes: DataFrame) -> DataFrame:
    """(leaf, formatted, learnt): what a conversation sees in the stream, and its texts under the loss mask."""
    learnt = F.when(F.col("loss_chars") > 0, F.expr("substring(formatted, loss_from + 1, loss_chars)")).otherwise("")
    seen = routes.join(packed.select("tree", "start", "formatted", learnt.alias("learnt")), ["tree", "start"])
    parts = seen.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "formatted", "learnt"))).alias("parts"))
    return parts.select(
        "leaf",
        F.array_join(F.transform("parts", lambda x: x["formatted"]), "").alias("formatted"),
        F.array_join(F.transform("parts", lambda x: unescape(x["learnt"])), "").alias("learnt"),
    )


def digest(turns: DataFrame) -> DataFrame:
    """Hashes of turns and loss text of every conversation, parsed from the packed stream."""
    conversations = materialize(conversations_of(turns), "chats")
    packed, routes = pack(conversations)
    back = read_back(packed, routes)
    marked = F.split("formatted", r"<\|over\|>\n", -1)
    bodies = F.transform(F.slice(marked, 1, F.size(marked) - 1), lambda x: F.substring(x, len(OPEN) + 1, 1 << 30))

    def plain(turn: Column) -> Column:
        at = F.instr(turn, "\n")
        return F.concat(unescape_role(turn.substr(F.lit(1), at - 1)), F.lit("\n"), unescape(turn.substr(at + 1, F.length(turn))), F.lit("\n"))

    found = back.select("leaf", bodies.alias("bodies"), "formatted", "learnt").select(
        "leaf",
        F.size("bodies").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("bodies", plain), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return conversations.select("conv_id", "leaf").join(found, "leaf").drop("leaf")


#: One conversation more, whose texts look like another template's markers.
EXTRA = "</s>[INST] ok [/INST]"


def with_extra(turns: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)


def oracle() -> str:
    esc = lambda x: f"replace(replace({x}, '&', '&amp;'), '<|', '&lt;|')"
    order = "order by turn nulls first, role, text"
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from
  (select conv_id, turn, role, text from conversations union all values (-7, 0, 'user', '{EXTRA}'), (-7, 1, 'assistant', '{EXTRA}')))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(OPEN) + 1 + len(CLOSE)} + length(replace({esc('role')}, chr(10), '&nl;')) + length({esc('text')}))::bigint as formatted_chars
from t group by conv_id"""
