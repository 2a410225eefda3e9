"""Chat formatting of reply trees, with DataFrame functions only.

A node has a tree, an id, a parent, a role, a text and a score. Iterative self-joins double each node's
ancestor pointer and add up scores and depths on the way, so a chain of n turns takes log2(n) rounds. A
leaf's branch scores the mean over its path; the best branches of each tree are chosen, and their nodes
are gathered by climbing the stored pointers (2^k steps in round k). Each chosen path becomes one
conversation.

Template: <|im_start|>role, line feed, text, <|im_end|>, line feed, for each turn. Control strings
inside texts (this template's and those of other common ones) get one backslash after their first character;
one that already has backslashes there gets one more, so unescape() is exact. In roles, backslash
and line feed are written \\b and \\n. The loss mask holds the spans of assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialize

START, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character of a control string.
TAILS = r"\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({TAILS})", "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _same(a: str, b: str, left: str, right: str) -> Column:
    return F.expr(f"{a}.tree <=> {b}.tree and {a}.{left} = {b}.{right}")


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, path, depth, role, text): the nodes of the best `branches` root-to-leaf paths of each tree.

    nodes: tree, node, parent, role, text, score. path is the leaf's id, depth counts from 0 at the root.
    A parent that is not in the table makes a root; nodes that never reach a root (cycles) are dropped;
    a null score counts as 0; ties go to the smaller leaf id. Node ids are unique within a tree.
    """
    parents = nodes.select(F.col("tree").alias("p_tree"), F.col("node").alias("p_node")).distinct()
    start = (nodes.join(parents, F.expr("tree <=> p_tree and parent = p_node"), "left")
             .select("tree", "node", F.col("p_node").alias("anc"), F.when(F.col("p_node").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")))
    # only pointers that are still open are joined on; a node that has reached its root rests
    steps, now = [], materialize(start, "up")
    for _ in range(64):
        open_ = now.where("anc is not null")
        if open_.isEmpty():
            break
        steps.append(now)
        nxt = open_.alias("a").join(now.alias("b"), _same("a", "b", "anc", "node")).select(
            "a.tree", "a.node", F.col("b.anc").alias("anc"), (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.total") + F.col("b.total")).alias("total"))
        now = materialize(now.where("anc is null").unionByName(nxt), "up")
        if (now.where("anc is not null").agg(F.max("depth")).first()[0] or 0) > 2 * now.count():  # only cycles are left
            break
    have_child = nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = now.where("anc is null").alias("a").join(have_child.alias("b"), _same("a", "b", "node", "node"), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), "node"))
    path = leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select("tree", F.col("node").alias("path"), "node")
    path = materialize(path, "path")
    for step in steps:
        up = path.alias("a").join(step.where("anc is not null").alias("b"), _same("a", "b", "node", "node")).select("a.tree", "a.path", F.col("b.anc").alias("node"))
        grown = materialize(path.unionAll(up), "path")
        discard(path)
        path = grown
    deep = path.alias("a").join(now.alias("b"), _same("a", "b", "node", "node")).select("a.tree", "a.path", "a.node", "b.depth")
    return deep.alias("a").join(nodes.alias("b"), _same("a", "b", "node", "node")).select("a.tree", "a.path", "a.depth", "b.role", "b.text")


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, path, formatted, loss): one row per path; loss is array<struct<start, end>> in code points
    of formatted, end exclusive, one span per assistant text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), _role_out(role), F.lit("\n"))
    turn = paths.select("tree", "path", "depth", head.alias("head"), escape(text).alias("body"), (role == "assistant").alias("mine"))
    turn = turn.withColumn("size", F.length("head") + F.length("body") + len(END) + 1)
    before = F.coalesce(F.sum("size").over(W.partitionBy("tree", "path").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turn = turn.withColumn("start", before + F.length("head"))
    row = F.struct("depth", F.concat("head", "body", F.lit(END + "\n")).alias("s"), "mine", "start", (F.col("start") + F.length("body")).alias("end"))
    got = turn.groupBy("tree", "path").agg(F.array_sort(F.collect_list(row)).alias("t"))
    return got.select("tree", "path", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"),
                      F.transform(F.filter("t", lambda x: x["mine"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")

    def one(x):
        body = F.substring(x, F.lit(len(START) + 1), F.length(x))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_role_in(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)


def loss_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chains(turns: DataFrame) -> DataFrame:
    """Reply trees of linear conversations (conv_id, turn, role, text): each turn answers the one before;
    rows that repeat a turn follow one another by role and text."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.select(F.col("conv_id").alias("tree"), at.cast("long").alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    nodes = materialize(chains(turns.unionAll(more)), "nodes")
    made = format_paths(best_paths(nodes))
    read = made.select(F.col("tree").alias("conv_id"), "formatted", "loss", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("under"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"),
                       F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) loss_sha256,
  cast(sum(24 + length(regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g'))) as bigint) formatted_chars
from t group by conv_id
"""
