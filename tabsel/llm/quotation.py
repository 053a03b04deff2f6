"""Chat formatting by quotation linking.

Nested quote levels are parsed from each message's lines. A passage is a run of lines of one level. Normalised quoted
passages, their paragraphs and their lines are hashed and joined to those that earlier messages of the conversation
wrote themselves, so a quote is found whole, in part, or wrapped anew. A message replies to the one that most lines of
its outermost linked level come from. Conversations come out in reply order, each message without its quotes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = r"^(?:[ \t]*>)+"
#: Who wrote the quote below: such a line has at most 200 characters between its first word and its verb.
ATTRIBUTION = r"^[ \t]*(?:On|Am|Le|El) [^\n]{1,200} (?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
#: Rows of whole conversations that are put in order together.
TOGETHER = 50_000


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def _messages(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, raw, ck, pos, parsed): the place of each message in its conversation, and its lines."""
    base = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    base = base.withColumn("ck", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")))
    rows = base.withColumn("pos", F.row_number().over(Window.partitionBy("ck").orderBy("turn", "role", "raw")))
    level = lambda x: F.length(F.translate(F.regexp_extract(x, MARKS, 0), " \t", ""))
    parsed = F.transform(F.split("raw", "\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS + r"[ \t]?", "").alias("line"), x.rlike(ATTRIBUTION).alias("named")))
    following = lambda i: F.coalesce(F.try_element_at("parsed", i + 2)["level"], F.lit(0))
    rows = rows.withColumn("parsed", parsed)
    gone = lambda p, i: p["named"] & (p["level"] == 0) & (following(i) > 0)
    return rows.withColumn("parsed", F.transform("parsed", lambda p, i: F.struct(p["level"].alias("level"), p["line"].alias("line"), gone(p, i).alias("gone"))))


def _pieces(rows: DataFrame) -> DataFrame:
    """(ck, pos, level, i, hs): for each line with words the hashes of itself, its paragraph and its passage.

    Of what a message wrote itself (level 0) all lines are one passage; at other levels a passage ends where the level
    changes. A paragraph ends at a line without words as well.
    """
    lines = rows.select("ck", "pos", F.posexplode("parsed").alias("i", "p")).where("not p.gone")
    lines = lines.select("ck", "pos", "i", F.col("p.level").alias("level"), normalised(F.col("p.line")).alias("line"))
    # lines in a row have the same difference of their place and their number among the lines of their level
    of_level = Window.partitionBy("ck", "pos", "level").orderBy("i")
    lines = lines.withColumn("passage", F.when(F.col("level") > 0, F.col("i") - F.row_number().over(of_level)).otherwise(0)).where("line <> ''")
    lines = lines.withColumn("paragraph", F.col("i") - F.row_number().over(of_level))
    whole = lambda *by: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " "))
    key = ["ck", "pos", "level", "passage"]
    paragraphs = lines.groupBy(*key, "paragraph").agg(whole().alias("h2"), F.array_sort(F.collect_list(F.struct("i", F.md5("line").alias("h1")))).alias("own"))
    passages = lines.groupBy(*key).agg(whole().alias("h3"))
    both = paragraphs.join(passages, key)
    return both.select("ck", "pos", "level", F.inline("own"), "h2", "h3").select("ck", "pos", "level", "i", F.array_distinct(F.array("h1", "h2", "h3")).alias("hs"))


def _found(pieces: DataFrame) -> DataFrame:
    """(ck, pos, level, source, c): how many lines of each level come from which earlier message."""
    wrote = pieces.where("level = 0").select("ck", F.col("pos").alias("source"), F.explode("hs").alias("h")).distinct()
    quoted = pieces.where("level > 0").select("ck", "pos", "level", "i", F.explode("hs").alias("h"))
    hits = quoted.join(wrote, ["ck", "h"]).where("source < pos")
    return hits.groupBy("ck", "pos", "level", "source", "i").agg(F.lit(1).alias("one")).groupBy("ck", "pos", "level", "source").agg(F.count("*").alias("c"))


def _ordered(numbers: DataFrame, turn_type: T.DataType) -> DataFrame:
    """(ck, pos, position, depth, reply_to) of (ck, pos, parent, turn), parents having smaller places than their replies.

    Two passes over the numbers of a conversation: sizes of subtrees backwards, places forwards. A task holds some
    bytes for each message of a conversation, never its texts.
    """
    spread = numbers.select("ck", "pos", "parent", "turn").repartition("ck").sortWithinPartitions("ck", "pos")

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        pos, parent = table.column("pos").to_numpy(), table.column("parent").fill_null(0).to_numpy()
        n = len(pos)
        base = np.arange(n) - pos + 1
        above = np.where(parent > 0, base + parent - 1, -1).tolist()
        size, depth, place, free = [1] * n, [0] * n, [0] * n, [0] * n
        for v in range(n - 1, -1, -1):
            if above[v] >= 0:
                size[above[v]] += size[v]
        root, first = 1, (pos == 1).tolist()
        for v in range(n):
            u = above[v]
            if first[v]:
                root = 1
            if u < 0:
                place[v] = root
                root += size[v]
            else:
                place[v], depth[v] = free[u], depth[u] + 1
                free[u] += size[v]
            free[v] = place[v] + 1
        at = pa.array(above, pa.int64(), mask=np.array(above) < 0)
        turn = table.column("turn").combine_chunks()
        turn = turn.chunk(0) if isinstance(turn, pa.ChunkedArray) else turn
        return pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (table.column("ck").combine_chunks(), table.column("pos").combine_chunks())), pa.array(place, pa.int64()), pa.array(depth, pa.int64()), turn.take(at)], names=["ck", "pos", "position", "depth", "reply_to"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in it:
            starts = np.flatnonzero(batch.column("pos").to_numpy() == 1)
            if len(starts) and rows + starts[-1] >= TOGETHER:  # the last conversation may go on
                if rows + starts[-1]:
                    yield solve([*held, batch.slice(0, starts[-1])])
                held, rows = [], 0
                batch = batch.slice(starts[-1])
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if rows:
            yield solve(held)

    schema = T.StructType([T.StructField("ck", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("position", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("reply_to", turn_type)])
    return spread.mapInArrow(run, schema)


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, position, reply_to, depth, quote_level, linked_lines, text), one for each message.

    position is the place in reply order from 1 (a reply follows its message, siblings by turn); reply_to the turn of
    the message replied to, null for one that quotes nothing known; depth its distance to the first of its thread;
    quote_level the deepest level; linked_lines the lines, of the outermost level with any link, found in the message
    replied to (ties: the latest message). A line before a quote that names its author goes, too. Only earlier messages
    are linked. A null text is an empty message, null turns come first, rows with equal turns are taken by role and
    text, repeated rows are messages of their own; messages with a null conv_id are one conversation. A long message is
    taken whole; an empty table gives no rows. Other columns are not read.

    The work follows the messages and the pairs of messages of a conversation that share a quoted line.
    """
    rows = _messages(messages, conv_col, turn_col, role_col, text_col)
    own = F.transform(F.filter("parsed", lambda p: (p["level"] == 0) & ~p["gone"]), lambda p: p["line"])
    text = F.trim(F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""))
    hits = _found(_pieces(rows.select("ck", "pos", "parsed")))
    best = hits.groupBy("ck", "pos").agg(F.max(F.struct((-F.col("level")).alias("level"), "c", "source")).alias("best")).select("ck", "pos", F.col("best.c").alias("linked_lines"), F.col("best.source").alias("parent"))
    quote_level = F.array_max(F.transform("parsed", lambda p: p["level"]))
    found = rows.select("ck", "conv_id", "turn", "role", "pos", quote_level.alias("quote_level"), text.alias("text")).join(best, ["ck", "pos"], "left")
    order = _ordered(found, found.schema["turn"].dataType)
    out = found.join(order, ["ck", "pos"])
    return out.select("conv_id", "turn", "role", "position", "reply_to", "depth", F.col("quote_level").cast("long").alias("quote_level"), F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"), "text")


def links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, quote_level, source_turn, linked_lines): for each message and level of its quotes the message they come from.

    A level whose lines no earlier message wrote has no row. Ties, nulls, repeated rows and long messages as in link().
    """
    rows = _messages(messages, conv_col, turn_col, role_col, text_col)
    best = _found(_pieces(rows.select("ck", "pos", "parsed"))).groupBy("ck", "pos", "level").agg(F.max(F.struct("c", "source")).alias("best"))
    named = rows.select("ck", "pos", "conv_id", "turn")
    source = named.select("ck", F.col("pos").alias("source"), F.col("turn").alias("source_turn"))
    out = best.select("ck", "pos", "level", F.col("best.c").alias("c"), F.col("best.source").alias("source")).join(named, ["ck", "pos"]).join(source, ["ck", "source"])
    return out.select("conv_id", "turn", F.col("level").cast("long").alias("quote_level"), "source_turn", F.col("c").cast("long").alias("linked_lines"))


#: link() on the table, whose messages quote one level at most; QUOTED_SQL has all levels and passages.
ORACLE_SQL = r"""
with recursive m as (
  select conv_id, turn, role, coalesce(text, '') as raw, row_number() over (partition by conv_id order by turn nulls first, role nulls first, coalesce(text, '')) as pos
  from conversations),
l as (
  select conv_id, pos, unnest(string_split(raw, chr(10))) as x, unnest(range(len(string_split(raw, chr(10))))) as i from m),
p as (
  select conv_id, pos, i, length(replace(replace(regexp_extract(x, '^(?:[ \t]*>)+'), ' ', ''), chr(9), '')) as level,
    regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') as line,
    regexp_matches(x, '^[ \t]*(?:On|Am|Le|El) [^\n]{1,200} (?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$') as named from l),
q as (select *, coalesce(lead(level) over (partition by conv_id, pos order by i), 0) as following,
    lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) as norm from p),
own as (select * from q where level = 0 and not (named and following > 0)),
body as (select conv_id, pos, regexp_replace(string_agg(line, chr(10) order by i), '^\s+|\s+$', '', 'g') as text from own group by all),
lev as (select conv_id, pos, max(level) as quote_level from q group by all),
hits as (
  select a.conv_id, a.pos, b.pos as source, count(*) as c
  from (select * from q where level = 1 and norm <> '') a
  join (select distinct conv_id, pos, md5(norm) as h from own where norm <> '') b on a.conv_id = b.conv_id and md5(a.norm) = b.h and b.pos < a.pos
  group by all),
best as (select conv_id, pos, max(row(c, source)) as b from hits group by all),
t as (
  select m.conv_id, m.turn, m.role, m.pos, coalesce(body.text, '') as text, lev.quote_level, best.b[1] as c, best.b[2] as parent
  from m left join body on m.conv_id is not distinct from body.conv_id and m.pos = body.pos
  left join lev on m.conv_id is not distinct from lev.conv_id and m.pos = lev.pos left join best on m.conv_id = best.conv_id and m.pos = best.pos),
w as (
  select conv_id, pos, [pos] as path from t where parent is null
  union all select t.conv_id, t.pos, list_append(w.path, t.pos) from t join w on t.conv_id = w.conv_id and t.parent = w.pos)
select t.conv_id, t.turn, t.role, row_number() over (partition by t.conv_id order by w.path) as position, o.turn as reply_to,
  cast(len(w.path) - 1 as bigint) as depth, cast(t.quote_level as bigint) as quote_level, cast(coalesce(t.c, 0) as bigint) as linked_lines, t.text
from t join w on t.conv_id is not distinct from w.conv_id and t.pos = w.pos left join m o on o.conv_id = t.conv_id and o.pos = t.parent
"""


def quoted(conversations: DataFrame) -> DataFrame:
    """The conversations with quotes: each later message quotes the one before it, every third nests the one before that,
    every fifth quotes only at the second level, every seventh has the quote on one line."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n, one, two = F.row_number().over(w) - 1, F.lag("text", 1).over(w), F.lag("text", 2).over(w)
    mark = lambda m, x: F.concat(F.lit(m), F.replace(x, F.lit("\n"), F.concat(F.lit("\n"), F.lit(m))))
    flat = F.concat(F.lit("> "), F.replace(one, F.lit("\n"), F.lit(" ")), F.lit("\n"))
    first = F.when(F.col("n") % 7 == 6, F.col("flat")).when(F.col("n") % 5 == 4, F.lit("")).otherwise(F.concat(F.col("q1"), F.lit("\n")))
    second = F.when((F.col("n") % 3 == 2) | (F.col("n") % 5 == 4), F.concat(F.col("q2"), F.lit("\n"))).otherwise("")
    rows = conversations.select("conv_id", "turn", "role", "text", n.alias("n"), mark("> ", one).alias("q1"), mark(">> ", two).alias("q2"), flat.alias("flat"))
    quotes = F.concat(F.coalesce(first, F.lit("")), F.coalesce(second, F.lit("")))
    return rows.select("conv_id", "turn", "role", F.concat(quotes, "text").alias("text"))


#: link() and links() as SQL over a table m of messages.
_MESSAGES = r"""
m as (
  select conv_id, turn, role, coalesce(text, '') as raw, row_number() over (partition by conv_id order by turn nulls first, role nulls first, coalesce(text, '')) as pos
  from input),
l as (
  select conv_id, pos, unnest(string_split(raw, chr(10))) as x, unnest(range(len(string_split(raw, chr(10))))) as i from m),
p as (
  select conv_id, pos, i, length(replace(replace(regexp_extract(x, '^(?:[ \t]*>)+'), ' ', ''), chr(9), '')) as level,
    regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') as line,
    regexp_matches(x, '^[ \t]*(?:On|Am|Le|El) [^\n]{1,200} (?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$') as named from l),
q as (
  select * from (
    select *, coalesce(lead(level) over (partition by conv_id, pos order by i), 0) as following, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) as norm from p)
  where not (level = 0 and named and following > 0)),
runs as (
  select *, case when level > 0 then i - row_number() over (partition by conv_id, pos, level order by i) else 0 end as passage from q),
pieces as (
  select *, i - row_number() over (partition by conv_id, pos, level order by i) as paragraph from runs where norm <> ''),
hashed as (
  select conv_id, pos, level, i, unnest([md5(norm),
    md5(string_agg(norm, ' ' order by i) over (partition by conv_id, pos, level, passage, paragraph)),
    md5(string_agg(norm, ' ' order by i) over (partition by conv_id, pos, level, passage))]) as h from pieces),
hits as (
  select a.conv_id, a.pos, a.level, b.pos as source, count(distinct a.i) as c
  from (select * from hashed where level > 0) a join (select distinct conv_id, pos, h from hashed where level = 0) b on a.conv_id = b.conv_id and a.h = b.h and b.pos < a.pos
  group by all)"""

_QUOTED = r"""
lagged as (
  select conv_id, turn, role, text, row_number() over w - 1 as n, lag(text, 1) over w as one, lag(text, 2) over w as two
  from conversations window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
input as (
  select conv_id, turn, role, coalesce(case when n % 7 = 6 then '> ' || replace(one, chr(10), ' ') || chr(10) when n % 5 = 4 then '' else '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10) end, '')
    || coalesce(case when n % 3 = 2 or n % 5 = 4 then '>> ' || replace(two, chr(10), chr(10) || '>> ') || chr(10) else '' end, '') || text as text from lagged)"""

_LINKED = r"""
body as (select conv_id, pos, regexp_replace(string_agg(line, chr(10) order by i), '^\s+|\s+$', '', 'g') as text from q where level = 0 group by all),
lev as (select conv_id, pos, max(level) as quote_level from p group by all),
best as (select conv_id, pos, max(row(-level, c, source)) as b from hits group by all),
t as (
  select m.conv_id, m.turn, m.role, m.pos, coalesce(body.text, '') as text, lev.quote_level, best.b[2] as c, best.b[3] as parent
  from m left join body on m.conv_id is not distinct from body.conv_id and m.pos = body.pos
  left join lev on m.conv_id is not distinct from lev.conv_id and m.pos = lev.pos left join best on m.conv_id = best.conv_id and m.pos = best.pos),
w as (
  select conv_id, pos, [pos] as path from t where parent is null
  union all select t.conv_id, t.pos, list_append(w.path, t.pos) from t join w on t.conv_id = w.conv_id and t.parent = w.pos)
select t.conv_id, t.turn, t.role, row_number() over (partition by t.conv_id order by w.path) as position, o.turn as reply_to,
  cast(len(w.path) - 1 as bigint) as depth, cast(t.quote_level as bigint) as quote_level, cast(coalesce(t.c, 0) as bigint) as linked_lines, t.text
from t join w on t.conv_id is not distinct from w.conv_id and t.pos = w.pos left join m o on o.conv_id = t.conv_id and o.pos = t.parent
"""

_ALL_LINKS = r"""
best as (select conv_id, pos, level, max(row(c, source)) as b from hits group by all)
select m.conv_id, m.turn, cast(best.level as bigint) as quote_level, o.turn as source_turn, cast(best.b[1] as bigint) as linked_lines
from best join m using (conv_id, pos) join m o on o.conv_id = best.conv_id and o.pos = best.b[2]
"""

QUOTED_SQL = f"with recursive {_QUOTED}, {_MESSAGES}, {_LINKED}".replace("o.turn as reply_to", "cast(coalesce(o.turn, -1) as bigint) as reply_to")
LINKS_SQL = f"with {_QUOTED}, {_MESSAGES}, {_ALL_LINKS}"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def quoted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link() on conversations that quote, as those of the table don't; reply_to is -1 for none."""
    return link(quoted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumn("reply_to", F.coalesce(F.col("reply_to").cast("long"), F.lit(-1)))


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(quoted(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
