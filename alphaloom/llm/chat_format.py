"""Chat formatting in prefix trees: conversations that share their first turns share the tokens of these turns.

A node is a turn after given earlier turns; its key is the chained digest of role (with its length) and text from the root on, so equal
prefixes have equal keys. Paths (lists of keys, one for each distinct conversation) in sorted order are the leaves of a depth-first walk: each adds the
turns that it doesn't share with the one before it, so every node is laid out once. Sorted paths are dealt in ranges, whatever
tree they belong to; a range's walk starts where the one before ended, which follows from a summary of each range. A node's
position ids continue those of its parent, and its attention is the list of its ancestors' token intervals and its own, neighbours merged.
A walk keeps the path that it is on and nothing else, so a tree of any size and shape is dealt to many tasks.

Template: <|im_start|>role NEWLINE text <|im_end|> NEWLINE, the marks being token ids beyond the vocabulary. In roles and texts, a
backslash is put after the < of every <, backslashes, | run, which is undone by taking one away; in roles, before that, backslashes
are doubled and a newline becomes a backslash and an n. The loss mask covers the escaped text of assistant turns.

Defined results: null texts and roles are empty; turns are ordered by turn (nulls first), then role and text; a conversation that repeats
another's turns ends at the same node; a null conv_id is a conversation; very long texts and conversations are whole; an empty table gives no
nodes; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, saved, table
from .packing import Encoder, default_encoder

START, STOP = "<|im_start|>", "<|im_end|>"
#: Ids of the two marks: the first that the vocabulary leaves free.
START_ID, STOP_ID = 50257, 50258
LEARNED = "assistant"
#: Paths in a range, about. A summary of each range, two paths, goes to the driver.
RANGE = 20_000
#: Tokens of repeated turns that a task remembers.
CACHE = 1 << 20
_AFTER = r"<(\\*)\|"
_BEFORE = r"<\\(\\*)\|"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, _AFTER, r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, _BEFORE, r"<$1|")


def escaped_role(c: Column) -> Column:
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], re.sub(_BEFORE, r"<\1|", role))


def turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, t (its turns in order) and keys (their nodes)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    one = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    step = F.expr("transform(t, x -> sha2(concat(length(x.role), ':', x.role, x.text), 256))")
    link = lambda a, x: F.concat(a, F.array(F.substring(F.sha2(F.concat(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")), x), 256), 1, 32)))
    return one.select("conv_id", "t", F.aggregate(step, F.array().cast("array<string>"), link).alias("keys"))


def _tokens(encoder: Encoder):
    """A mapInArrow function over (row, keys, escaped turns, conv_id): per turn token ids, their number and the loss span within them."""

    def run(batches):
        known, held = {}, 0
        for batch in batches:
            out = [[], [], [], []]
            for keys, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = []
                for key, turn in zip(keys, said):
                    if key not in known:
                        head, body, tail = [START_ID, *encoder.encode(turn["role"] + "\n")], encoder.encode(turn["text"]), [STOP_ID, *encoder.encode("\n")]
                        span = (len(head), len(head) + len(body)) if turn["role"] == LEARNED else (0, 0)
                        if held > CACHE:
                            known, held = {}, 0
                        known[key] = head + body + tail, *span
                        held += len(known[key][0])
                    found.append(known[key])
                for column, value in zip(out, ([len(f[0]) for f in found], *([f[k] for f in found] for k in range(3)))):
                    column.append(value)
            types = (pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(3), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types))], names=["row", "conv_id", "keys", "n", "ids", "loss_start", "loss_end"])

    return run


def _common(a: list, b: list) -> int:
    """Length of the common beginning."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


class Walk:
    """A depth-first walk along sorted paths: the path it is on, the offsets of its nodes, and the next free place in its tree."""

    def __init__(self, keys: list[str], offsets: list[int], end: int):
        self.keys, self.offsets, self.end = keys, offsets, end

    def step(self, keys: list[str], n: list[int]) -> int:
        """Goes on to the next path; returns how many of its turns are laid out already."""
        shared = _common(self.keys, keys)
        if not shared:
            self.end = 0
        self.keys, self.offsets = keys, self.offsets[:shared]
        for size in n[shared:]:
            self.offsets.append(self.end)
            self.end += size
        return shared


def _summaries(batches):
    """Of (range, row, keys, n) sorted by range and keys: the first and the last path of each range, as walked from an empty start."""
    now = first = walk = None

    def told():
        return pa.record_batch([pa.array([now], pa.int32()), *(pa.array([x]) for x in (first[0], first[1], walk.keys, walk.offsets, walk.end))], names=["range", "first", "n", "last", "offsets", "end"])

    for batch in batches:
        for number, keys, n in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if number != now:
                if now is not None:
                    yield told()
                now, first, walk = number, (keys, n), Walk([], [], 0)
            walk.step(keys, n)
    if now is not None:
        yield told()


def _starts(summaries: list) -> dict[int, tuple]:
    """Where the walk of each range starts: the last path of the range before, its offsets, and the next free place."""
    out, keys, offsets, end = {}, [], [], 0
    for s in sorted(summaries, key=lambda s: s["range"]):
        out[s["range"]] = keys, offsets, end
        shared, through = _common(keys, s["first"]), _common(s["first"], s["last"])
        # What the range has laid out in its first tree moves: the walk from an empty start has laid out shared turns anew.
        moved = end - sum(s["n"][:shared]) if shared and through else 0
        offsets = [offsets[k] if k < min(shared, through) else o + moved for k, o in enumerate(s["offsets"])]
        keys, end = s["last"], s["end"] + moved
    return out


def _layout(starts: dict[int, tuple]):
    """A mapInArrow function over (range, row, keys, n) sorted by range and keys: how many turns a path shares with earlier ones, the place of its own, and what these attend to before it."""

    def run(batches):
        now = walk = None
        for batch in batches:
            out = [[], [], [], []]
            for number, row, keys, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if number != now:
                    now, walk = number, Walk(*starts[number])
                shared = walk.step(keys, n)
                prior: list[dict] = []
                for offset, size in zip(walk.offsets[:shared], n):
                    if prior and prior[-1]["end"] == offset:
                        prior[-1]["end"] = offset + size
                    else:
                        prior.append({"start": offset, "end": offset + size})
                for column, value in zip(out, (row, shared, walk.offsets[shared] if shared < len(keys) else walk.end, prior)):
                    column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=["row", "shared", "start", "prior"])

    return run


def forest(chats: DataFrame, encoder: Encoder | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of `turns` rows.

    nodes: tree, key, parent, depth, offset (place of its tokens in its tree's depth-first sequence), position (id of its
    first token), ids, loss_start, loss_end (within its ids) and attention (intervals [start, end) in the sequence).
    paths: leaf (key of a last turn), and the keys of all turns up to it.
    """
    tokens = saved(tokenised(chats, encoder), "chat-tokens")
    return _forest(tokens)


def tokenised(chats: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Of `turns` rows: row (a number), conv_id, keys, and of each turn its token ids, their number and the loss span."""
    said = F.transform("t", lambda x: F.struct(escaped_role(x["role"]).alias("role"), escaped(x["text"]).alias("text")))
    rows = chats.select(F.monotonically_increasing_id().alias("row"), "keys", said.alias("t"), "conv_id")
    kind = dict(chats.dtypes)["conv_id"]
    return rows.mapInArrow(_tokens(encoder or default_encoder()), f"row long, conv_id {kind}, keys array<string>, n array<long>, ids array<array<int>>, loss_start array<int>, loss_end array<int>")


def _forest(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`forest` of a written table of `tokenised` rows; the nodes are not written."""
    # Equal conversations are one path. Only keys and sizes are sorted.
    paths = tokens.groupBy(F.element_at("keys", -1).alias("leaf")).agg(F.min(F.struct("row", "keys", "n")).alias("p")).select("p.row", "p.keys", "p.n")
    paths = saved(paths, "chat-paths")
    ranges = paths.repartitionByRange(max(1, -(-paths.count() // RANGE)), "keys").select(F.spark_partition_id().alias("range"), "row", "keys", "n")
    ranges = saved(ranges, "chat-ranges")
    ordered = ranges.repartition("range").sortWithinPartitions("range", "keys")
    starts = _starts(ordered.mapInArrow(_summaries, "range int, first array<string>, n array<long>, last array<string>, offsets array<long>, end long").collect())
    laid = ordered.mapInArrow(_layout(starts), "row long, shared int, start long, prior array<struct<start:bigint,end:bigint>>")

    both = tokens.join(laid, "row").withColumn("ahead", F.aggregate("n", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    fresh = F.arrays_zip("keys", "ids", "loss_start", "loss_end")
    own = both.select("keys", "shared", "start", "prior", "ahead", F.posexplode(F.slice(fresh, F.col("shared") + 1, F.size("keys"))).alias("p", "x")).withColumn("k", F.col("p") + F.col("shared"))
    before, past = F.get("ahead", F.col("k")) - F.get("ahead", F.col("shared")), F.get("ahead", F.col("k") + 1) - F.get("ahead", F.col("shared"))
    # A path's own turns follow one another: one interval, which may continue the last of the shared ones.
    run = F.struct("start", (F.col("start") + past).alias("end"))
    last = F.try_element_at("prior", F.lit(-1))
    longer = F.concat(F.slice("prior", 1, F.greatest(F.size("prior") - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), run["end"].alias("end"))))
    attention = F.when(last["end"] == F.col("start"), longer).otherwise(F.concat("prior", F.array(run)))
    nodes = own.select(
        F.col("keys")[0].alias("tree"), F.col("x.keys").alias("key"), F.when(F.col("k") > 0, F.get("keys", F.col("k") - 1)).alias("parent"), (F.col("k") + 1).alias("depth"), (F.col("start") + before).alias("offset"),
        F.get("ahead", F.col("k")).alias("position"), F.col("x.ids").alias("ids"), F.col("x.loss_start").alias("loss_start"), F.col("x.loss_end").alias("loss_end"), attention.alias("attention"),
    )
    return nodes, paths.select(F.element_at("keys", -1).alias("leaf"), "keys")


def read_paths(nodes: DataFrame, paths: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Per path: key (of its last turn), turns (role, text by depth, unescaped, from tokens), formatted_chars and loss_text.

    What a last turn attends to must be as long as the turns of its path, else the layout is damaged and the read fails.
    """
    encoder = encoder or default_encoder()

    def run(batches):
        marks = {START_ID: START, STOP_ID: STOP}
        for batch in batches:
            columns = [[], [], [], [], []]
            for ids, begin, end in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                stop = len(ids) - 1 - ids[::-1].index(STOP_ID)
                inner = encoder.decode(ids[1:stop])
                role, _, text = inner.partition("\n")
                whole = len(marks[ids[0]]) + len(inner) + len(marks[ids[stop]]) + len(encoder.decode(ids[stop + 1 :]))
                # The text under the mask, as a place in the turn's text.
                at, size = (len(encoder.decode(ids[1:begin])) - len(role) - 1, len(encoder.decode(ids[begin:end]))) if end > begin else (0, 0)
                if at < 0 or at + size > len(text):
                    raise ValueError("the loss mask covers more than a text")
                for column, value in zip(columns, (unescaped_role(role), text, whole, at, size)):
                    column.append(value)
            types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types)), batch.column(4), batch.column(5)], names=["key", "role", "text", "chars", "at", "learned", "size", "seen"])

    seen = F.aggregate("attention", F.lit(0).cast("long"), lambda a, i: a + i["end"] - i["start"])
    said = nodes.select("key", "ids", "loss_start", "loss_end", F.size("ids").cast("long").alias("size"), seen.alias("seen")).mapInArrow(run, "key string, role string, text string, chars long, at int, learned int, size long, seen long")
    steps = join_unique(paths.select("leaf", F.posexplode("keys").alias("k", "key")), saved(said, "chat-read"), "key")
    turn = F.struct("k", "role", unescaped(F.col("text")).alias("text"), "chars", unescaped(F.substr("text", F.col("at") + 1, F.col("learned"))).alias("loss"), "size", "seen")
    whole = steps.groupBy("leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    total = lambda f: F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t[f])
    sound = F.assert_true(total("size") == F.element_at("turns", -1)["seen"], "the layout disagrees with the attention")
    return whole.where(sound.isNull()).select(F.col("leaf").alias("key"), "turns", total("chars").alias("formatted_chars"), F.array_join(F.transform("turns", lambda t: t["loss"]), "").alias("loss_text"))


def read_back(nodes: DataFrame, paths: DataFrame, leaves: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """`read_paths` of the conversations that end in `leaves` (conv_id, key): conv_id, turns, formatted_chars and loss_text."""
    return join_unique(leaves, saved(read_paths(nodes, paths, encoder), "chat-whole"), "key").select("conv_id", "turns", "formatted_chars", "loss_text")


def format_chats(conversations: DataFrame, encoder: Encoder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, paths, leaves): the packed forest, the nodes of each path, and the node at which each conversation ends."""
    nodes, paths, leaves = laid_out(conversations, encoder)
    return saved(nodes, "chat-forest"), paths, leaves


def laid_out(conversations: DataFrame, encoder: Encoder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `format_chats`, but the forest is not written: for a single reader."""
    tokens = saved(tokenised(turns(conversations), encoder), "chat-tokens")
    return (*_forest(tokens), tokens.select("conv_id", F.element_at("keys", -1).alias("key")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = f"{STOP}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes, paths, leaves = laid_out(rows.unionByName(own))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_paths(nodes, paths).select(
        "key", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
    # Digests alone follow each conversation to its last turn.
    return join_unique(leaves, saved(read, "chat-whole"), "key").drop("key")


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
), sized AS (
  SELECT *, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS chars FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
