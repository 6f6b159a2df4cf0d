"""Chat formatting by quotation linking.

Lines are parsed to a quote depth (their leading ">" marks) and a body; a passage is a run of lines of one depth without
blank ones. Quoted passages, normalised (lower case, white space collapsed) and hashed, are joined to messages that hold
the passage unquoted: the nearest earlier one of the same conversation, else the first of all earlier conversations. A
message replies to the original of its shallowest quotes (of several, the one with the most passages, then the latest);
without a linked quote it replies to the message before it. Conversations whose messages quote earlier conversations
join their thread. Messages come out in reply order, which never puts a reply before what it replies to, and without their
quotes.

Only built-in DataFrame functions are used. Originals are looked up in two ways that never pair a group with itself: the
last one before in (passage, conversation), and one aggregated row a passage. What is counted or looked up in order is cut
into ranges of that order, however its keys are spread; each range is one task's, and ranges are combined by one row each. So
a hot conversation, passage, turn or thread is spread over tasks; only messages that share conversation, turn, role and the
first 64 characters of longer texts lie in one range.

Nulls: a null text counts as empty; null conversations are one, before all others; null turns come first in their
conversation. Rows that share conversation and turn are ordered by role and text; repeated rows are messages of their own.
A message is "earlier" by (conv_id, turn). Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Leading characters of a text that ranges of messages are cut by.
_LEAD = 64
_CUT, _END = "\x01", "\x02"
_LOW = -(1 << 63)


def _lines(text: Column) -> Column:
    """Lines as struct(depth, body)."""
    plain = F.translate(F.coalesce(text, F.lit("")), _CUT + _END + "\r", "")

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("depth"), F.regexp_replace(line, r"^(?:[ \t]*>)+[ \t]?", "").alias("body"))

    return F.transform(F.split(plain, "\n"), parse)


def _passages(lines: Column) -> Column:
    """Runs of lines of one depth without blank ones, as struct(depth, body)."""
    depth = F.transform(lines, lambda x: x["depth"])
    before = F.concat(F.array(F.lit(-1)), depth)
    joined = F.array_join(F.transform(F.arrays_zip(lines.alias("x"), F.slice(before, 1, F.size(lines)).alias("d")), lambda z: F.concat(F.when((z["x"]["depth"] != z["d"]) | (F.trim(z["x"]["body"]) == ""), F.concat(F.lit(_CUT), z["x"]["depth"].cast("string"), F.lit(_END))).otherwise(F.lit("\n")), z["x"]["body"])), "")
    parts = F.transform(F.split(joined, _CUT), lambda s: F.struct(F.substring_index(s, _END, 1).try_cast("int").alias("depth"), F.substring_index(s, _END, -1).alias("body")))
    return F.filter(parts, lambda p: F.trim(F.translate(p["body"], "\n\t", "  ")) != "")


def _hash(body: Column) -> Column:
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))))


def _clean(text: Column, lines: Column) -> Column:
    """The text without quoted lines and the lines that announce them; as it is, if nothing is quoted."""
    next_ = F.concat(F.slice(F.transform(lines, lambda x: x["depth"]), 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit(0)))
    kept = F.filter(F.arrays_zip(lines.alias("x"), next_.alias("n")), lambda z: (z["x"]["depth"] == 0) & ~((z["n"] > 0) & z["x"]["body"].rlike(r"(?i)^\s*(on\b.*)?\bwrote:\s*$")))
    body = F.array_join(F.transform(kept, lambda z: z["x"]["body"]), "\n")
    return F.when(F.exists(lines, lambda x: x["depth"] > 0), F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(F.coalesce(text, F.lit("")))


def _ranges(df: DataFrame) -> int:
    return min(common.shuffle_partitions(df.sparkSession), max(1, -(-common.stored_bytes(df) // common.PART_BYTES)))


def _running(df: DataFrame, group: list[str], by: str, total: Column) -> DataFrame:
    """df with `ahead`: total (of one column of df) over the rows of smaller `by` in the group, which is unique in it."""
    written = common.materialize(df).df
    part = common.materialize(written.repartitionByRange(_ranges(written), *group, by).withColumn("part", F.spark_partition_id())).df
    earlier = Window.unboundedPreceding, -1
    inside = part.withColumn("within", total.over(Window.partitionBy(*group, "part").orderBy(by).rowsBetween(*earlier)))
    parts = part.groupBy(*group, "part").agg(total.alias("all"))
    fold = F.max if dict(parts.dtypes)["all"].startswith("struct") else F.sum
    parts = parts.select(*group, "part", fold("all").over(Window.partitionBy(*group).orderBy("part").rowsBetween(*earlier)).alias("over"))
    both = F.coalesce("within", "over") if fold is F.max else F.coalesce(F.col("within") + F.col("over"), "within", "over")
    return inside.join(parts, [*group, "part"]).withColumn("ahead", both).drop("part", "within", "over")


def link_quotations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), thread_id, position (from 0, in the thread), parent_conv, parent_turn,
    link (quote, turn or root), depth (deepest quote), n_quoted, n_linked (passages): one row for each input row."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("conv", F.coalesce("conv_id", F.lit(_LOW))).withColumn("at", F.coalesce("turn", F.lit(_LOW)))
    # ranges of messages in their order, numbered within; written down, so that they don't change when a task runs again
    whole = F.length(F.coalesce("text", F.lit(""))) <= _LEAD
    cuts = ["conv", "at", "role", F.substring("text", 1, _LEAD), F.when(whole, F.monotonically_increasing_id())]
    dealt = own.repartitionByRange(_ranges(own), *cuts).sortWithinPartitions("conv", "at", "role", "text")
    dealt = dealt.withColumn("block", F.spark_partition_id().cast("long")).withColumn("in_block", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    lined = dealt.withColumn("lines", _lines(F.col("text"))).withColumn("passages", _passages(F.col("lines")))
    messages = lined.select("conv_id", "turn", "role", "conv", "at", "block", "in_block", _clean(F.col("text"), F.col("lines")).alias("text"), F.transform("passages", lambda p: F.struct(p["depth"].alias("depth"), _hash(p["body"]).alias("hash"))).alias("passages"))
    messages = common.materialize(messages).df
    key = ["conv", "block", "in_block"]

    found = messages.select(*key, "at", F.explode("passages").alias("p")).select(*key, "at", "p.depth", "p.hash")
    quotes = found.where("depth > 0")
    wanted = quotes.select("hash").distinct()
    originals = found.where("depth = 0").join(wanted, "hash", "left_semi")
    me = F.struct("conv", "at", "block", "in_block")
    # nearest earlier original of the same conversation, looked up once a (passage, conversation, turn)
    steps = originals.unionByName(quotes).groupBy("hash", "conv", "at").agg(F.max(F.when(F.col("depth") == 0, me)).alias("own"))
    before = _running(common.few(steps, messages), ["hash", "conv"], "at", F.max("own")).select("hash", "conv", "at", F.col("ahead").alias("before"))
    near = quotes.join(before, ["hash", "conv", "at"])
    # else the first of all
    first = originals.groupBy("hash").agg(F.min(me).alias("first"))
    linked = near.join(first, "hash", "left").withColumn("to", F.coalesce("before", F.when(F.struct("first.conv", "first.at") < F.struct("conv", "at"), F.col("first"))))
    votes = linked.where("to IS NOT NULL").groupBy(*key, "depth", "to").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy(*key).agg(F.max_by("to", F.struct((-F.col("depth")).alias("shallow"), "n", "to")).alias("to"))
    seen = linked.groupBy(*key).agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_quoted"), F.count("to").alias("n_linked"))
    replies = common.materialize(common.few(seen.join(chosen, key, "left"), messages)).df

    # blocks of a conversation: how many messages come before each, and the last one of the block before it
    blocks = messages.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.min("in_block").alias("start"), F.max(F.struct("in_block", "conv_id", "turn")).alias("last"))
    order = Window.partitionBy("conv").orderBy("block")
    blocks = blocks.select("conv", "block", "start", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.lag("last").over(order).alias("last_before"))
    # threads: a conversation hangs under the one its first quote of another conversation comes from
    hung = replies.where("to.conv <> conv").groupBy("conv").agg(F.min_by("to.conv", F.struct("block", "in_block")).alias("up"))
    roots = common.materialize(common.few(hung, replies)).df
    while not roots.join(roots.select(F.col("conv").alias("up")), "up", "left_semi").isEmpty():
        higher = roots.select(F.col("conv").alias("up"), F.col("up").alias("top"))
        roots = common.materialize(common.few(roots.join(higher, "up", "left").select("conv", F.coalesce("top", "up").alias("up")), roots)).df
    sizes = messages.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).join(roots, "conv", "left").select("conv", "n", F.coalesce("up", "conv").alias("thread"))
    sizes = _running(common.few(sizes, messages), ["thread"], "conv", F.sum("n")).select("conv", "thread", F.coalesce("ahead", F.lit(0)).alias("offset"))
    # neighbours within a block; what is known of conversations comes by their blocks, for messages stay dealt by blocks
    blocks = blocks.join(sizes, "conv")
    inside = Window.partitionBy("conv", "block").orderBy("in_block")
    before = F.coalesce(F.lag(F.struct("in_block", "conv_id", "turn")).over(inside), F.col("last_before"))
    placed = messages.join(blocks, ["conv", "block"]).withColumn("before", before).join(replies.withColumnRenamed("depth", "deepest"), key, "left")
    real = lambda x: F.when(x != _LOW, x)
    link = F.when(F.col("to").isNotNull(), "quote").when(F.col("before").isNotNull(), "turn").otherwise("root")
    zero = F.lit(0).cast("long")
    return placed.select("conv_id", "turn", "role", "text", real(F.col("thread")).alias("thread_id"), (F.col("offset") + F.col("ahead") + F.col("in_block") - F.col("start")).cast("long").alias("position"), F.when(F.col("to").isNotNull(), real(F.col("to.conv"))).otherwise(F.col("before.conv_id")).alias("parent_conv"), F.when(F.col("to").isNotNull(), real(F.col("to.at"))).otherwise(F.col("before.turn")).alias("parent_turn"), link.alias("link"), F.coalesce(F.col("deepest").cast("long"), zero).alias("depth"), F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"))


def op8_quotation_linking(spark, sf_dir: str) -> DataFrame:
    return link_quotations(common.table(spark, sf_dir, "conversations"))


def quoted_conversations(spark, sf_dir: str) -> DataFrame:
    """The operator over conversations whose messages quote the two messages before them, nested, ahead of their own text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")

    def quote(back: int) -> Column:
        marks = "> " * back
        return F.concat(F.lit(marks), F.replace(F.coalesce(F.lag("text", back).over(order), F.lit("")), F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))

    talk = common.table(spark, sf_dir, "conversations")
    return link_quotations(talk.select("conv_id", "turn", "role", F.concat(quote(2), quote(1), F.coalesce("text", F.lit(""))).alias("text")))


#: DuckDB: each quoted passage is looked up in all messages.
ORACLE_SQL = r"""
WITH RECURSIVE m AS (
  SELECT *, row_number() OVER (ORDER BY conv, tick, role NULLS FIRST, text NULLS FIRST) AS id
  FROM (SELECT conv_id, turn, role, text, coalesce(conv_id, -9223372036854775808) AS conv, coalesce(turn, -9223372036854775808) AS tick FROM conversations)
), raw AS (
  SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT id, string_split(translate(coalesce(text, ''), chr(1) || chr(2) || chr(13), ''), chr(10)) AS ls FROM m)
), l AS (
  SELECT id, pos, len(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS depth, regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS body FROM raw
), b AS (
  SELECT *, trim(body) = '' AS blank, lag(depth) OVER w AS pd, lead(depth) OVER w AS nd FROM l WINDOW w AS (PARTITION BY id ORDER BY pos)
), g AS (
  SELECT *, sum(CASE WHEN blank OR pd IS NULL OR pd <> depth THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS run FROM b
), p AS (
  SELECT id, run, min(depth) AS depth, trim(regexp_replace(lower(string_agg(body, chr(10) ORDER BY pos)), '\s+', ' ', 'g')) AS norm FROM g GROUP BY id, run HAVING trim(translate(string_agg(body, ''), chr(10) || chr(9), '  ')) <> ''
), q AS (
  SELECT p.id, p.depth, p.norm, m.conv, m.tick FROM p JOIN m USING (id) WHERE depth > 0
), o AS (
  SELECT p.id, p.norm, m.conv, m.tick FROM p JOIN m USING (id) WHERE depth = 0 AND p.norm IN (SELECT norm FROM q)
), t AS (
  SELECT id, depth, coalesce((SELECT max(o.id) FROM o WHERE o.norm = q.norm AND o.conv = q.conv AND o.tick < q.tick), (SELECT min(o.id) FROM o WHERE o.norm = q.norm AND (o.conv < q.conv OR (o.conv = q.conv AND o.tick < q.tick)))) AS target FROM q
), v AS (
  SELECT id, depth, target, count(*) AS n FROM t WHERE target IS NOT NULL GROUP BY ALL
), c AS (
  SELECT id, target FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, n DESC, target DESC) AS k FROM v) WHERE k = 1
), s AS (
  SELECT id, max(depth) AS depth, count(*) AS n_quoted, count(target) AS n_linked FROM t GROUP BY id
), hung AS (
  SELECT conv, up FROM (SELECT m.conv, x.conv AS up, row_number() OVER (PARTITION BY m.conv ORDER BY m.id) AS k FROM c JOIN m ON m.id = c.id JOIN m x ON x.id = c.target WHERE x.conv <> m.conv) WHERE k = 1
), r AS (
  SELECT DISTINCT conv, conv AS top FROM m UNION SELECT r.conv, hung.up FROM r JOIN hung ON r.top = hung.conv
), th AS (
  SELECT conv, min(top) AS thread FROM r GROUP BY conv
), k AS (
  SELECT id, bool_or(depth > 0) AS quoting, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE depth = 0 AND NOT (coalesce(nd, 0) > 0 AND regexp_matches(body, '(?i)^\s*(on\b.*)?\bwrote:\s*$'))), ''), '^\s+|\s+$', '', 'g') AS cleaned FROM b GROUP BY id
), f AS (
  SELECT m.*, th.thread, k.quoting, k.cleaned, c.target, s.depth, s.n_quoted, s.n_linked, lag(m.id) OVER (PARTITION BY m.conv ORDER BY m.id) AS before, row_number() OVER (PARTITION BY th.thread ORDER BY m.id) - 1 AS position
  FROM m JOIN th USING (conv) JOIN k USING (id) LEFT JOIN c USING (id) LEFT JOIN s USING (id)
)
SELECT f.conv_id, f.turn, f.role, CASE WHEN f.quoting THEN f.cleaned ELSE coalesce(f.text, '') END AS text, nullif(f.thread, -9223372036854775808) AS thread_id, f.position, x.conv_id AS parent_conv, x.turn AS parent_turn,
       CASE WHEN f.target IS NOT NULL THEN 'quote' WHEN f.before IS NOT NULL THEN 'turn' ELSE 'root' END AS link, CAST(coalesce(f.depth, 0) AS BIGINT) AS depth, coalesce(f.n_quoted, 0) AS n_quoted, coalesce(f.n_linked, 0) AS n_linked
FROM f LEFT JOIN m x ON x.id = coalesce(f.target, f.before)
"""

#: The same over conversations that quote.
QUOTED_SQL = ORACLE_SQL.replace("FROM conversations", "FROM quoting").replace(
    "WITH RECURSIVE",
    """WITH RECURSIVE quoting AS (
  SELECT conv_id, turn, role, '> > ' || replace(coalesce(lag(text, 2) OVER o, ''), chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(coalesce(lag(text) OVER o, ''), chr(10), chr(10) || '> ') || chr(10) || coalesce(text, '') AS text
  FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
),""",
)
