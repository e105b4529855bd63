"""N-gram Jaccard self-join by prefix trees.

Each document is its set of distinct word shingles. Documents with equal sets form a class; classes are joined.

Routing. A trie join needs sets that may link in the same task. Sets are dealt by an exact pigeonhole argument: linked
sets x, y of sizes in one size range differ in at most D elements, so if the hash space is cut into D + 1 + SPARE parts, at
least 1 + SPARE parts hold the same elements in both. The digest of each part is a routing key (a set near the lower end
of its range also takes the keys of the range below, where a smaller partner is). Keys are counted over all sets; those of one set alone
go, and each set leaves out as many of its keys as there are spare parts, the most frequent ones first, so that a popular passage makes no
candidates. All sets leave out by one order of the keys, so of the keys that linked sets share the last is left to both: this is exact.
Below STRICT percent, parts hold so few elements that more of them have to be spare (WIDE). Classes that share a key that is left are
candidates; candidates that hang together form a group.

Trie join. In a group, elements are ordered by falling frequency and the ordered sets stored in a trie (as sorted
sequences with their common prefixes). It is walked depth-first once; each node carries the overlaps of all probe sets with the
path so far, computed once for all sets below it. A subtree is left as soon as no probe set can still reach
the needed overlap with what remains of the longest set below it. Groups too large for a task are cut into blocks by size,
and each pair of blocks whose sizes can link is a task; tasks return link counts and a spanning forest, not pairs.

Defined results: null and empty texts have empty sets, link with nothing and are their own component; with fewer words
than a shingle the whole sequence is the one element; very long texts are sets like any other; repeated rows each appear, and rows of one
doc_id with unlike texts each by their own text; rows without a doc_id link and connect others like any row, but never name a component (one that has no other rows has a null component_id);
an empty table gives no rows; extra columns are ignored. Elements are 64-bit hashes of shingles and sets are told apart by 64-bit digests of them:
two that agree count as one (among 10^9 sets one such pair is expected with a chance of 3 %).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import by_slices, join_unique, saved, slices, split, table
from .components import components

#: Parts beyond the needed number, so that keys of empty parts are seldom needed.
SPARE = 2
#: The same below STRICT percent.
WIDE, STRICT = 70, 90
#: Upper ends of the size ranges grow by this factor.
RANGE = 1.37
#: Sets and elements in a block of a large group.
BLOCK_SETS, BLOCK_ELEMENTS = 768, 600_000
#: Sizes in a block of a large group differ by this factor at most.
SIZES = 1.05

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _ODD[k]
    h = (h ^ (h >> _U(29))) * _ODD[(k + 2) % 5]
    return h ^ (h >> _U(32))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(element, row) of the distinct shingles of each text, sorted by row and element."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    row = np.repeat(np.arange(len(texts)), counts)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=_U, count=len(coded.dictionary))
    code = coded.indices.to_numpy(zero_copy_only=False)[full]
    row = row[full]
    h = known[code] if len(known) else np.zeros(0, _U)
    counts = np.bincount(row, minlength=len(texts))
    # Words at the end of a text have no successors in it; a short text counts as a whole.
    start = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(len(h)) - start[row]
    left = counts[row] - place
    whole = counts[row] < n
    take = (left >= n) | (whole & (place == 0))
    out = np.zeros(len(h), _U)
    for k in range(n):
        shifted = np.zeros(len(h), _U)
        shifted[: max(0, len(h) - k)] = h[k:]
        out += np.where(left > k, mixed(shifted, k % 5) * (_ODD[(k + 1) % 5] + _U(2 * k)), _U(0))
    out = mixed(out + np.where(whole, counts[row], 0).astype(_U), 4)[take]
    row = row[take]
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    if len(out):
        fresh = np.concatenate([[True], (out[1:] != out[:-1]) | (row[1:] != row[:-1])])
        out, row = out[fresh], row[fresh]
    return out, row


class Bound:
    """Links at 100 * |x & y| >= percent * |x | y|: needed overlap, size ranges and parts."""

    def __init__(self, percent: int):
        self.percent = percent
        self.spare = SPARE if percent >= STRICT else WIDE

    def overlap(self, both):
        """Least overlap of a linked pair whose sizes sum up to `both`."""
        return -(-self.percent * both // (100 + self.percent))

    def smallest(self, size):
        return -(-self.percent * size // 100)

    def ranges(self, largest: int) -> np.ndarray:
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, int(low[-1] * RANGE)))
        return np.array(low, dtype=np.int64)

    def parts(self, low: np.ndarray) -> np.ndarray:
        """Parts of each range: one more than the most elements in which linked sets differ, plus the spare ones; 0 if they can't differ."""
        top = low[1:] - 1
        both = top + top * 100 // self.percent
        differ = both * (100 - self.percent) // (100 + self.percent)
        return np.where(differ > 0, differ + 1 + self.spare, 0)


def routing_keys(element: np.ndarray, row: np.ndarray, rows: int, bound: Bound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, tag) of all sets; tag is 256 * (ranges below the set's own) + the number of keys in that range that the set leaves out."""
    size = np.bincount(row, minlength=rows)
    low = bound.ranges(int(size.max(initial=1)))
    parts = bound.parts(low)
    own = np.searchsorted(low, size, side="right") - 1
    least = np.searchsorted(low, np.maximum(1, bound.smallest(size)), side="right") - 1
    place, value = mixed(element, 1) >> _U(32), mixed(element, 3)
    keys, owners, tags = [], [], []
    for back in range(int((own - least).max(initial=0)) + 1):
        level = own - back
        m = np.where((size > 0) & (level >= least), parts[np.maximum(level, 0)], 0)
        begin = np.concatenate([[0], np.cumsum(m)])
        used = m[row] > 0
        at = begin[row[used]] + ((place[used] * m[row[used]].astype(_U)) >> _U(32)).astype(np.int64)
        total, held = np.zeros(begin[-1], _U), np.zeros(begin[-1], bool)
        np.add.at(total, at, value[used])
        held[at] = True
        owner = np.repeat(np.arange(rows), m)
        empty = np.bincount(owner[~held], minlength=rows)
        part = np.arange(begin[-1]) - begin[owner]
        key = mixed(mixed(total, 0) + part.astype(_U) * _ODD[1] + level[owner].astype(_U) * _ODD[2], 4)
        # Parts that are empty in both sets may be among the equal ones; they have no keys while others must be left.
        emit = held | (empty[owner] > bound.spare)
        keys.append(key[emit])
        owners.append(owner[emit])
        tags.append(256 * back + np.maximum(0, bound.spare - empty)[owner[emit]])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(tags)


def digest(element: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The set_id of each set."""
    total = np.zeros(rows, _U)
    np.add.at(total, row, mixed(element, 0))
    return mixed(total + np.bincount(row, minlength=rows).astype(_U), 1).view(np.int64)


def tagged(docs: DataFrame, n: int, once: bool = False) -> DataFrame:
    """docs with the set_id of each row's text; with once a task gives each (doc_id, set_id) one row."""
    text, doc, columns = docs.columns.index("text"), docs.columns.index("doc_id"), docs.columns

    def run(batches):
        seen: set = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            element, row = shingle_sets(batch.column(text), n)
            ids = digest(element, row, batch.num_rows)
            out = pa.record_batch([*batch.columns, pa.array(ids)], names=[*columns, "set_id"])
            if not once:
                return out
            fresh = []
            for pair in zip(batch.column(doc).to_pylist(), ids.tolist()):
                fresh.append(pair not in seen)
                seen.add(pair)
            return out.filter(pa.array(fresh, pa.bool_()))

        yield from by_slices(work, text)(batches)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("set_id", LongType())]))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """Per document row: doc_id, n (size of its set) and set_id."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        element, row = shingle_sets(batch.column(1), n)
        size = np.bincount(row, minlength=batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(size.astype(np.int64)), pa.array(digest(element, row, batch.num_rows))], names=["doc_id", "n", "set_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(by_slices(work), "doc_id long, n long, set_id long")


def keys_of(docs: DataFrame, n: int, bound: Bound) -> DataFrame:
    """(key, node, tag) of the routing keys of all sets; a task gives those of a set once, however often it meets it."""

    def run(batches):
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.num_rows
            element, row = shingle_sets(batch.column(0), n)
            ids = digest(element, row, rows)
            fresh = np.zeros(rows, bool)
            for k, x in enumerate(ids.tolist()):
                fresh[k] = x not in seen
                seen.add(x)
            use = fresh[row]
            key, owner, tag = routing_keys(element[use], row[use], rows, bound)
            return pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids[owner]), pa.array(tag, pa.int32())], names=["key", "node", "tag"])

        yield from by_slices(work, 0)(batches)

    return docs.select("text").mapInArrow(run, "key long, node long, tag int")


def _several(batches):
    """Of (key, node, tag) sorted by key and node: the rows of keys that more than one node has, each node once."""
    held = None  # the last row, if nothing tells yet whether its key has another node
    last = None  # (key, node) of the last row
    for batch in batches:
        key, node, tag = (batch.column(k).to_numpy() for k in (0, 1, 2))
        if not len(key):
            continue
        same = np.concatenate([[last is not None and last[0] == key[0]], key[1:] == key[:-1]])
        again = same & (node == np.concatenate([[last[1] if last else 0], node[:-1]]))
        if again.any():
            at = ~again
            last = key[-1], node[-1]
            key, node, tag, same = key[at], node[at], tag[at], same[at]
            if not len(key):
                continue
        else:
            last = key[-1], node[-1]
        follows = np.append(same[1:], False)
        take = same | follows
        # Whether the last row is followed by one of its key is known with the next batch only.
        rest = None if same[-1] else (key[-1], node[-1], tag[-1])
        columns = [key[take], node[take], tag[take]]
        if same[0] and held is not None:
            columns = [np.concatenate([[h], c]) for h, c in zip(held, columns)]
        held = rest
        if len(columns[0]):
            yield pa.record_batch([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], names=["key", "node", "tag"])


def _stars(batches):
    """Of (key, set) sorted by both: for sets that share a key, edges to the first of them."""
    last_key = last_first = None
    for batch in batches:
        key, node = (batch.column(k).to_numpy() for k in (0, 1))
        if not len(key):
            continue
        start = np.concatenate([[True], key[1:] != key[:-1]])
        first = node[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
        if key[0] == last_key:
            first[: np.argmin(key == key[0]) if (key != key[0]).any() else len(key)] = last_first
        last_key, last_first = key[-1], first[-1]
        far = np.flatnonzero(first != node)
        if len(far):
            pairs = np.unique(np.c_[node[far], first[far]], axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def candidate_edges(docs: DataFrame, n: int, bound: Bound) -> DataFrame:
    """Edges (a, b) that connect sets which share a key that neither leaves out. Keys are made from the texts once more, straight into the shuffle, instead of being stored."""
    shared = keys_of(docs, n, bound).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_several, "key long, node long, tag int")
    shared = saved(shared, "ngram-shared")
    often = shared.withColumn("sets", F.count("*").over(Window.partitionBy("key")))
    place = F.row_number().over(Window.partitionBy("node", F.shiftright("tag", 8)).orderBy(F.desc("sets"), "key"))
    left = often.withColumn("place", place).where(F.col("place") > F.col("tag") % 256).select("key", "node")
    return left.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "a long, b long")


def trie_join(left: list[np.ndarray], right: list[np.ndarray], bound: Bound):
    """Yields (i, array of j) for the links between sets of `left` (in a trie) and `right` (the probes)."""
    tokens, code, often = np.unique(np.concatenate(left), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -often))] = np.arange(len(tokens))
    ends = np.cumsum([len(x) for x in left])
    paths = [np.sort(rank[code[e - len(x) : e]]) for x, e in zip(left, ends)]
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
    # Probes by element: postings[begin[r]:begin[r + 1]] hold element r.
    flat, who = np.concatenate(right), np.repeat(np.arange(len(right)), [len(x) for x in right])
    at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
    found = tokens[at] == flat
    element, who = rank[at[found]], who[found]
    by = np.argsort(element, kind="stable")
    postings, begin = who[by], np.concatenate([[0], np.cumsum(np.bincount(element, minlength=len(tokens)))])
    size = np.array([len(x) for x in right])

    def gained(path: np.ndarray) -> np.ndarray:
        """Overlaps of all probes with a run of elements."""
        b, e = begin[path], begin[path + 1]
        n = e - b
        index = np.repeat(b - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(postings[index], minlength=len(size))

    common = [0] * len(order)
    for k in range(1, len(order)):
        a, b = paths[order[k - 1]], paths[order[k]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        common[k] = int(differ[0]) if len(differ) else m
    # smaller[j]: the next set that shares a shorter prefix with the one before it, where the subtree of common[j] ends.
    smaller, open_ = [len(order)] * len(order), []
    for j in range(1, len(order)):
        while open_ and common[open_[-1]] > common[j]:
            smaller[open_.pop()] = j
        open_.append(j)
    length = np.array([len(paths[i]) for i in order])
    stack = [(0, np.zeros(len(size), np.int64))]  # (depth, overlaps of the path down to it)
    k = 0
    while k < len(order):
        path = paths[order[k]]
        while stack[-1][0] > common[k]:
            stack.pop()
        # Nodes of this path where later sets branch off: (depth, end of the subtree), deepest first.
        nodes, j = [], k + 1
        while j < len(order) and common[j] > stack[-1][0]:
            nodes.append((common[j], smaller[j]))
            j = smaller[j]
        left_at = 0
        for depth, end in reversed(nodes):
            up, overlap = stack[-1]
            overlap = overlap + gained(path[up:depth])
            rest = np.minimum(length[k:end].max() - depth, size - overlap)
            if not (overlap + rest >= bound.overlap(length[k:end].min() + size)).any():
                left_at = end
                break
            stack.append((depth, overlap))
        if left_at:
            k = left_at
            continue
        up, overlap = stack[-1]
        need = bound.overlap(len(path) + size)
        if (overlap + np.minimum(len(path) - up, size - overlap) >= need).any():
            if up < len(path):
                overlap = overlap + gained(path[up:])
            hits = np.flatnonzero(overlap >= need)
            if len(hits):
                yield order[k], hits
        k += 1


def _task_links(n: int, bound: Bound):
    """A mapInArrow function over rows sorted by task: links within and between its blocks, as counts and a forest."""

    def one(rows: dict) -> pa.RecordBatch:
        sets, side = rows["set"], np.array(rows["side"])
        copies, ids = np.array(rows["copies"]), np.array(rows["set_id"])
        links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = not len(b)
        b = a if own else b
        if len(a) and len(b):
            for i, hits in trie_join([sets[x] for x in a], [sets[x] for x in b], bound):
                i, hits = a[i], b[hits]
                hits = hits[hits != i]
                if len(hits):
                    links[i] += copies[hits].sum()
                    if not own:
                        links[hits] += copies[i]
                    joined = np.unique(root[np.append(hits, i)])
                    if len(joined) > 1:
                        root[np.isin(root, joined)] = joined[0]
        return pa.record_batch([pa.array(ids), pa.array(links), pa.array(ids[root])], names=["set_id", "links", "root"])

    def run(batches):
        held: dict[str, list] = {"set": [], "side": [], "copies": [], "set_id": []}
        task = None
        for batch in batches:
            names = batch.schema.names
            for low, high in slices(batch.column(names.index("text"))):
                part = batch.slice(low, high - low)
                element, row = shingle_sets(part.column(names.index("text")), n)
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
                values = {c: part.column(names.index(c)).to_pylist() for c in ("task", "side", "copies", "set_id")}
                for k in range(part.num_rows):
                    if values["task"][k] != task:
                        if len(held["set"]) > 1:
                            yield one(held)
                        task, held = values["task"][k], {"set": [], "side": [], "copies": [], "set_id": []}
                    held["set"].append(element[ends[k - 1] if k else 0 : ends[k]])
                    for c in ("side", "copies", "set_id"):
                        held[c].append(values[c][k])
        if len(held["set"]) > 1:
            yield one(held)

    return run


def join(docs: DataFrame, n: int = 3, percent: int = 90, sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links (rows linked with it) per document row.

    With sets also set_id and root, which tells components apart where doc_ids repeat.
    """
    with_sets = sets
    bound = Bound(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(sketches(docs, n), "ngram-sketches")
    sets = saved(rows.where("n > 0").groupBy("set_id").agg(F.max("n").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "ngram-sets")
    group = components(candidate_edges(docs, n, bound))

    # A group that is too large for a task is cut by size, and a size that still is by a hash: sums decide, nothing is sorted.
    members = sets.join(group, sets["set_id"] == group["node"]).select("set_id", "rep", "n", "copies", F.col("root").alias("group"))
    load, size = F.sum(F.greatest(F.lit(1 / BLOCK_SETS), F.col("n") / BLOCK_ELEMENTS)), F.floor(F.log(SIZES, F.col("n")) + 1e-9)
    loads = members.groupBy("group", size.alias("size")).agg(load.alias("load"))
    large = saved(loads.groupBy("group").agg(F.sum("load").alias("whole")).where("whole > 1").join(loads, "group").select("group", "size", F.ceil("load").alias("parts")), "ngram-large")
    cut = F.xxhash64("size", F.pmod(F.xxhash64("set_id"), F.col("parts")))
    members = members.withColumn("size", size).join(large, ["group", "size"], "left").withColumn("block", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(cut))
    members = saved(members.select("set_id", "rep", "n", "copies", "group", "block"), "ngram-members")
    ends = members.groupBy("group", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = ends.select("group", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    tasks = ends.join(other, "group").where(f"block <= block2 AND 100 * high >= {percent} * low2 AND 100 * high2 >= {percent} * low").select("group", "block", "block2")
    name = F.xxhash64("group", "block", "block2").alias("task")
    dealt = tasks.select("group", "block", F.lit(0).alias("side"), name).union(tasks.where("block < block2").select("group", F.col("block2").alias("block"), F.lit(1).alias("side"), name))
    dealt = dealt.groupBy("group", "block").agg(F.collect_list(F.struct("task", "side")).alias("tasks"))
    places = members.join(dealt, ["group", "block"]).select(F.col("rep").alias("doc_id"), "set_id", "copies", "tasks")
    # The sets travel as texts: once to their list of tasks, then to each of these.
    maybe, _ = split(docs, members.select(F.col("rep").alias("doc_id")), "doc_id")
    if repeated(docs):
        own = tagged(maybe, n, once=True).alias("d")
        texts = own.join(places.alias("p").hint("merge"), F.expr("d.doc_id <=> p.doc_id AND d.set_id = p.set_id")).select("d.set_id", "copies", "tasks", "text").dropDuplicates(["set_id"])
    else:
        texts = maybe.join(places.hint("merge"), "doc_id")
    work = texts.select("set_id", "copies", "text", F.explode("tasks").alias("t")).select("t.task", "t.side", "set_id", "copies", "text")
    found = saved(work.repartition("task").sortWithinPartitions("task", "side", "set_id").mapInArrow(_task_links(n, bound), "set_id long, links long, root long"), "ngram-links")

    forest = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    named = sets.join(forest, sets["set_id"] == forest["node"], "left").select("set_id", "rep", "copies", F.coalesce("root", "set_id").alias("root"))
    name = named.groupBy("root").agg(F.min("rep").alias("component"))
    known = named.where("copies > 1 OR root <> set_id").union(named.join(forest.select("root").distinct(), "root", "left_semi").select(named.columns)).distinct()
    known = known.join(name, "root").join(links, "set_id", "left").select("set_id", "root", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = join_unique(rows.where("n > 0").select("doc_id", "n", "set_id"), saved(known, "ngram-known"), "set_id", "left")
    none = F.lit(None).cast("long")
    out = out.select("doc_id", "n", "component", "n_links", "set_id", "root").union(rows.where("n = 0").select("doc_id", "n", none, none, "set_id", none))
    more = ["set_id", F.coalesce("root", "set_id").alias("root")] if with_sets else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *more)


def repeated(docs: DataFrame) -> bool:
    """Whether some row has no doc_id, or one that stands in more than one row."""
    return bool(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') AS l FROM documents
), words AS (
  SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS k FROM split) WHERE word <> ''
), shingles AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, i, n, concat_ws(' ', word, lead(word) OVER d, lead(word, 2) OVER d) AS shingle FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE i + 2 <= n OR (n < 3 AND i = 1)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 90 * (s.n + t.n - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id)) AS component_id, (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id)
"""
