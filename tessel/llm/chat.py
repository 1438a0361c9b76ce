"""Chat formatting of reply trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.frames import Packed, release, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn(role: Column, text: Column) -> Column:
    """One message in ChatML. Markers inside a text are broken with a backslash, so that no text can pose as another turn."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", r"<\\|$1|>")
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("user")), F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def format_trees(messages: DataFrame, per_root: int = 1) -> DataFrame:
    """The best root-to-leaf paths of reply trees, each as one conversation.

    ``messages`` has ``tree``, ``id``, ``parent``, ``role``, ``text`` and ``score``; other columns are ignored. A
    message whose parent is null, or absent from its tree, is a root. Self-joins double the reach of every message's
    pointer until all have met their roots, which takes the logarithm of the greatest depth; on the way they add up
    scores. A branch scores the sum of its messages' scores; the ``per_root`` best of each root are chosen, ties going to
    the smaller leaf. The doubled pointers, taken back from the longest, then list each chosen branch's messages.

    Gives ``tree``, ``root``, ``leaf``, ``rank``, ``n_turns``, ``score`` and ``conversation``. A null score counts as 0, a
    null text as empty, a null role as user. Rows with a null tree or identifier are left out. Of rows that share tree
    and identifier one stays: the least by (parent, role, text, score). Messages that hang from a cycle have no root and
    are left out. An empty table gives an empty table.
    """
    named = ("tree", "id", "parent", "role", "text", "score")
    rows = Packed(messages, *named).frame.select(*named).where("tree IS NOT NULL AND id IS NOT NULL")
    rest = F.struct("parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = written(rows.groupBy("tree", "id").agg(F.min(rest).alias("m")).select("tree", "id", "m.*"))
    ids = nodes.select("tree", F.col("id").alias("parent"))
    rooted = nodes.join(ids, ["tree", "parent"], "left_semi").select("tree", "id", "parent")
    reach = nodes.select("tree", "id", "score").join(rooted, ["tree", "id"], "left")
    # Each message's pointer ``up``; ``top`` is the last message before it, and ``score`` and ``n`` are of those up to ``top``.
    reach = written(reach.select("tree", "id", F.col("parent").alias("up"), F.col("id").alias("top"), "score", F.lit(1).alias("n")))
    jumps, most = [], nodes.count()
    while 1 << len(jumps) <= most and not reach.where("up IS NOT NULL").isEmpty():
        jumps.append(reach.where("up IS NOT NULL").select("tree", "id", "up"))
        next_ = reach.select("tree", F.col("id").alias("up"), F.struct("up", "top", "score", "n").alias("b"))
        both = reach.join(next_, ["tree", "up"], "left")
        before, reach = reach, written(both.select("tree", "id", F.col("b.up").alias("up"), F.coalesce("b.top", "top").alias("top"), (F.col("score") + F.coalesce("b.score", F.lit(0.0))).alias("score"), (F.col("n") + F.coalesce("b.n", F.lit(0))).alias("n")))
    parents = nodes.select("tree", F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    leaves = reach.where("up IS NULL").join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree", "top").orderBy(F.col("score").desc(), "id")
    chosen = written(leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_root))
    path = chosen.select("tree", F.col("id").alias("leaf"), "id", F.col("n").alias("at"))
    for k in reversed(range(len(jumps))):
        above = path.join(jumps[k], ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), (F.col("at") - F.lit(1 << k)).alias("at"))
        path = written(path.unionByName(above))
    said = path.join(nodes.select("tree", "id", turn(F.col("role"), F.col("text")).alias("turn")), ["tree", "id"])
    said = said.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "turn"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: x["turn"]), "")
    branches = chosen.select("tree", F.col("top").alias("root"), F.col("id").alias("leaf"), "rank", F.col("n").alias("n_turns"), "score")
    return branches.join(said, ["tree", "leaf"]).select("tree", "root", "leaf", "rank", "n_turns", "score", text.alias("conversation"))


def messages_of(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: those that begin with equal turns share these turns' messages, and branch where they differ.

    A turn replies to the turn before it; its message is known by its place and a 112-bit digest of all roles and texts up to
    it, and its tree by the first of these. A message scores its words. Running sums of the turns' digests make the ids, so that
    a conversation is streamed, never held.

    Rows without a conversation are left out. A null turn comes before all others. Rows that share conversation, turn, role
    and text are one. Those that differ in role or text are alternative replies: each is a branch, and what follows replies to
    the least of them by (role, text), null first. Null roles and texts differ from empty ones. An empty table gives an empty
    table; other columns are ignored.
    """
    rows = Packed(conversations, "conv_id", "turn", "role", "text").frame.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").distinct()
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("place", F.dense_rank().over(turns)).withColumn("number", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    own = [F.coalesce(F.concat(F.lit("+"), c), F.lit("-")) for c in ("role", "text")]
    rows = rows.withColumn("digest", F.md5(F.concat_ws("|", F.col("place").cast("string"), *own).cast("binary")))
    earlier = Window.partitionBy("conv_id").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    for k in (0, 1):
        part = F.conv(F.substring("digest", 1 + 14 * k, 14), 16, 10).cast("decimal(17,0)")
        rows = rows.withColumn(f"own{k}", part).withColumn(f"before{k}", F.coalesce(F.sum(F.when(F.col("number") == 1, part)).over(earlier), F.lit(0).cast("decimal(27,0)")))
    first = F.first(F.when((F.col("place") == 1) & (F.col("number") == 1), F.concat_ws(":", F.lit("1"), F.col("own0").cast("string"), F.col("own1").cast("string"))), True)
    rows = rows.withColumn("first", first.over(turns))
    id_ = F.concat_ws(":", F.col("place").cast("string"), *[(F.col(f"before{k}") + F.col(f"own{k}")).cast("decimal(28,0)").cast("string") for k in (0, 1)])
    parent = F.when(F.col("place") > 1, F.concat_ws(":", (F.col("place") - 1).cast("string"), *[F.col(f"before{k}").cast("decimal(28,0)").cast("string") for k in (0, 1)]))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("double")
    return rows.select(F.when(F.col("place") == 1, id_).otherwise(F.col("first")).alias("tree"), id_.alias("id"), parent.alias("parent"), "role", "text", words.alias("score"))


ORACLE = r"""
WITH RECURSIVE a AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS number
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
b AS (
  SELECT *, ('0x' || substr(d, 1, 14))::HUGEINT AS own0, ('0x' || substr(d, 15, 14))::HUGEINT AS own1
  FROM (SELECT *, md5(concat_ws('|', place, coalesce('+' || role, '-'), coalesce('+' || text, '-'))) AS d FROM a)),
c AS (
  SELECT *, coalesce(sum(own0) FILTER (number = 1) OVER w, 0)::HUGEINT AS before0, coalesce(sum(own1) FILTER (number = 1) OVER w, 0)::HUGEINT AS before1,
    max('1:' || own0 || ':' || own1) FILTER (place = 1 AND number = 1) OVER (PARTITION BY conv_id) AS first
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (
  SELECT DISTINCT CASE WHEN place = 1 THEN '1:' || own0 || ':' || own1 ELSE first END AS tree,
    place || ':' || (before0 + own0) || ':' || (before1 + own1) AS id, CASE WHEN place > 1 THEN (place - 1) || ':' || before0 || ':' || before1 END AS parent,
    coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')), 0)::DOUBLE AS score,
    '<|im_start|>' || coalesce(role, 'user') || chr(10) || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') || '<|im_end|>' || chr(10) AS said
  FROM c),
p AS (
  SELECT tree, id AS root, id AS leaf, 1 AS n_turns, score, said FROM m WHERE parent IS NULL
  UNION ALL
  SELECT p.tree, p.root, m.id, p.n_turns + 1, p.score + m.score, p.said || m.said
  FROM p JOIN m ON p.tree = m.tree AND p.leaf = m.parent),
r AS (
  SELECT *, row_number() OVER (PARTITION BY tree, root ORDER BY score DESC, leaf) AS rank FROM p
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tree = p.tree AND m.parent = p.leaf))
SELECT tree, root, leaf, rank::INT AS rank, n_turns::INT AS n_turns, score, said AS conversation FROM r WHERE rank <= 1
"""
