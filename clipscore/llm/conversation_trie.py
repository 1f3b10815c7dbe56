"""Prefix trie of conversations: containers of suffixes under trie heads, burst where they are too large, then sorted and swept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.llm.common import attach, in_arrow, stored
from clipscore.operators import ordered

FAMILY = 20
HEAD_CHOICES = 4
BLOCK_TURNS = 1 << 14  # of a conversation in one row
CONTAINER_TURNS = 1 << 16  # in one container
_CHUNK_IDS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"
NODE = "id binary, depth bigint, conv_id {kind}, parent_conv_id {kind}, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _own_turns(conversations: DataFrame, largest: int, hot_rows: int) -> DataFrame:
    """conv_id, pos (from 1), turn_id (a digest of role and text), words of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn_id = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", turn_id.alias("turn_id"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")
    )
    return _settled(ordered.ranked(_settled(turns, largest, hot_rows), ["conv_id"], ["turn", "turn_id"], "pos", hot_rows=hot_rows, largest=largest), largest, hot_rows)


def _settled(df: DataFrame, largest: int, hot_rows: int) -> DataFrame:
    """Written where a conversation is so long that ``running`` reads its input several times."""
    return stored(df) if largest > hot_rows else df


def _head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(HEAD_CHOICES)).cast("bigint")


def _sequences(turns: DataFrame, block: int, largest: int, hot_rows: int) -> DataFrame:
    """Rows (conv_id, depth, id, head, words, total) of the rebuilt conversations; one of depth 0 for a turnless one.

    ``id`` names the whole prefix: it digests four running sums of 32-bit pieces of a hash of (depth, turn), so
    that a conversation of any length is cut into ranges where it must be; ``head`` is the id one turn before.
    A turn of a family's first conversation is sent to those that take it, and the first own turn says that
    a conversation exists.
    """
    c, pos = F.col("conv_id"), F.col("pos")
    step = F.when(c < 0, -1).otherwise(1)
    family = F.transform(F.sequence(F.lit(0), F.when(c == 0, 2 * FAMILY - 2).otherwise(FAMILY - 1)), lambda i: F.when(i < FAMILY, c + step * i).otherwise(FAMILY - 1 - i))
    taken = F.filter(family, lambda m: _head_turns(m) >= pos)
    given = F.when((c % FAMILY == 0) & (pos < HEAD_CHOICES), F.transform(taken, lambda m: F.struct(m.cast("bigint").alias("c"), F.lit(0).alias("kind"))))
    own = F.when(pos > _head_turns(c), F.array(F.struct(c.cast("bigint").alias("c"), F.lit(1).alias("kind"))))
    exists = F.when(pos == 1, F.array(F.struct(c.cast("bigint").alias("c"), F.lit(2).alias("kind"))))
    none = F.array().cast("array<struct<c:bigint,kind:int>>")
    dealt = turns.select(F.explode(F.concat(*[F.coalesce(x, none) for x in (given, own, exists)])).alias("to"), "pos", "turn_id", "words")
    rows = dealt.select(F.col("to.c").alias("conv_id"), F.col("to.kind").alias("kind"), "pos", "turn_id", "words")

    real = F.when(F.col("kind") < 2, 1).otherwise(0).cast("bigint")
    mark = F.when(F.col("kind") == 2, 1).otherwise(0).cast("bigint")
    bound = largest + HEAD_CHOICES
    counted = ordered.running(_settled(rows, largest, hot_rows), ["conv_id"], ["kind", "pos"], {"real": real, "mark": mark}, hot_rows=hot_rows, largest=bound)
    alive = counted.where("mark_total > 0 AND (kind < 2 OR real_total = 0)").withColumn("depth", F.when(F.col("kind") < 2, F.col("real_before") + 1).otherwise(0))
    hashed = [F.xxhash64("depth", "turn_id", F.lit(seed)) for seed in ("first", "second")]
    pieces = {f"s{2 * i + k}": F.when(F.col("depth") > 0, piece).otherwise(0).cast("bigint") for i, h in enumerate(hashed) for k, piece in enumerate((F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))))}
    named = _settled(alive.withColumns(pieces), largest, hot_rows)
    summed = ordered.running(named, ["conv_id"], ["depth"], {s: F.col(s) for s in pieces}, hot_rows=hot_rows, largest=bound)

    def prefix(depth: Column, parts: list[Column]) -> Column:
        return F.when(depth > 0, F.unhex(F.md5(F.concat_ws(",", depth, *parts)))).otherwise(F.unhex(F.lit("")))

    return summed.select(
        "conv_id", "depth", F.col("real_total").alias("total"), "words",
        prefix(F.col("depth"), [F.col(f"{s}_before") + F.col(s) for s in pieces]).alias("id"),
        F.when((F.col("depth") == 0) | (F.pmod(F.col("depth") - 1, F.lit(block)) == 0), prefix(F.col("depth") - 1, [F.col(f"{s}_before") for s in pieces])).alias("head"),
    )


def _blocks(sequences: DataFrame, block: int) -> DataFrame:
    """conv_id, level, head, ids, words, ends: the turns of a conversation in rows of ``block``."""
    level = F.when(F.col("depth") == 0, 0).otherwise(F.floor((F.col("depth") - 1) / block)).cast("bigint")
    turn = F.when(F.col("depth") > 0, F.struct("depth", "id", "words"))
    made = sequences.groupBy("conv_id", level.alias("level")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.max("head").alias("head"), (F.max("depth") == F.max("total")).alias("ends")
    )
    return made.select("conv_id", "level", "head", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"), "ends")


def _last(ids: str = "ids", head: str = "head") -> Column:
    return F.when(F.size(ids) > 0, F.element_at(ids, -1)).otherwise(F.col(head))


def _end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the node's ascending conv_ids, joined by commas.

    Ranges of (node, conv_id) first join ids to chunks, then the chunks of a node pass in order through one hash: no
    list is held, and a node where very many end costs one task a stream of text, which the digest demands.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, start = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or nodes[i] != nodes[start] or i - start >= _CHUNK_IDS:
                    out.append((nodes[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["node", "first", "part"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for n, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256(part.encode())
                else:
                    digest.update(b"," + part.encode())
            yield _pairs(done)
        yield _pairs([] if node is None else [(node, digest.hexdigest())])

    def _pairs(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])

    spread = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    parts = in_arrow(spread.select("node", "conv_id"), joined, "node binary, first bigint, part string")
    streamed = parts.repartition("node").sortWithinPartitions("node", "first").select("node", "part")
    return in_arrow(streamed, hashed, "node binary, ends_sha256 string")


def _burst(suffixes: DataFrame, limit: int) -> DataFrame:
    """``suffixes`` with d, the turns that went into the trie, and box, the node whose container they are in.

    A container of over ``limit`` turns and more than one suffix bursts by next turn; turns that all its suffixes
    share go at once.  Only counts are looked at, and a suffix never moves to another task but where
    its container is one of very many small ones (see ``attach``).
    """
    boxed = stored(suffixes.withColumns({"d": F.lit(0), "box": F.col("head")}))
    while True:
        sizes = boxed.groupBy("box").agg(F.sum((F.size("ids") - F.col("d")).cast("bigint")).alias("turns"), F.count("*").alias("rows"))
        large = stored(sizes.where((F.col("turns") > limit) & (F.col("rows") > 1)).select("box", "rows"))
        if large.isEmpty():
            return boxed
        marked = attach(boxed, large.withColumn("large", F.lit(True)), "box", "rows")
        ends = marked.where("large").groupBy("box").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
        shared = stored(ends.select("box", F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int").alias("shared")).join(large, "box"))
        moved = attach(boxed, shared, "box", "rows")
        deeper = F.when(F.col("shared").isNull(), F.col("d")).otherwise(F.least(F.size("ids"), F.col("shared") + 1))
        boxed = stored(moved.withColumn("d", deeper).withColumn("box", F.when(F.col("d") > 0, F.get("ids", F.col("d") - 1)).otherwise(F.col("head"))).drop("shared"))


def _sweep(boxed: DataFrame, base: int, kind: str) -> DataFrame:
    """Node rows of every container, and a row (top true) of what its trie head gets: path, children, leaves, saved.

    The suffixes of a container arrive sorted, so its nodes are open on a stack and close when a
    suffix leaves them; a container's nodes, at most its turns, are held until it ends, because
    the least conversation of a parent is known only then.
    """
    columns = ["box", "d", "up", "ids", "words", "n", "least", "stops", "ends_sha256", "below_children", "below_leaves", "below_saved", "head"]
    dealt = boxed.repartition("box").sortWithinPartitions("box", "ids").select(*columns)
    names = ["id", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary())]

    class Box:
        def __init__(self, row: tuple) -> None:
            self.d, self.up, self.path, self.least = row[1], row[2], [row[12], *row[3][: row[1]]], row[6]
            # open nodes: [id, words, n, least, children, leaves, saved, ends, closed children]
            self.open: list[list] = [[b"", 0, 0, None, 0, 0, 0, None, []]]
            self.done: list[tuple] = []
            self.ids: list[bytes] = []

        def close(self, keep: int) -> None:
            while len(self.open) > keep + 1:
                node = self.open.pop()
                above = self.open[-1]
                leaves, saved = (node[5] if node[4] else 1), node[6] + (node[2] - 1) * node[1]
                above[2] += node[2]
                above[3] = node[3] if above[3] is None else min(above[3], node[3])
                above[4] += 1
                above[5] += leaves
                above[6] += saved
                above[8].append(len(self.done))
                for child in node[8]:
                    self.done[child][3] = node[3]
                self.done.append([node[0], base + self.d + len(self.open), node[3], None, node[2], node[4], leaves, saved, node[7], None])

        def add(self, row: tuple) -> None:
            ids, words = row[3][self.d :], row[4][self.d :]
            same = 0
            while same < len(ids) and same < len(self.ids) and ids[same] == self.ids[same]:
                same += 1
            self.close(same)
            for i in range(same, len(ids)):
                self.open.append([ids[i], words[i], 0, None, 0, 0, 0, None, []])
            end = self.open[-1]
            end[2] += row[5]
            end[3] = row[6] if end[3] is None else min(end[3], row[6])
            end[4] += row[9]
            end[5] += row[10]
            end[6] += row[11]
            end[7] = row[8]
            self.ids = ids

        def finish(self) -> list[list]:
            self.close(0)
            root = self.open[0]
            for child in root[8]:
                self.done[child][3] = self.up if self.d == 0 else root[3]
            return [*self.done, [None, None, None, None, None, root[4], root[5], root[6], None, self.path]]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, box, ready = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if box is None or row[0] != current:
                    if box is not None:
                        ready += box.finish()
                    current, box = row[0], Box(row)
                box.add(row)
                if len(ready) >= CONTAINER_TURNS:
                    yield batch_of(ready)
                    ready = []
        yield batch_of(ready + (box.finish() if box is not None else []))

    return in_arrow(dealt, run, NODE.format(kind=kind) + ", path array<binary>")


def _level(suffixes: DataFrame, base: int, limit: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of one level of blocks, and (head, children, leaves, saved): what its blocks add to the nodes they hang from."""
    boxed = _burst(suffixes, limit)
    swept = stored(_sweep(boxed, base, kind))
    turns = boxed.where("d > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("d"))).alias("j"))
    stops = F.when(F.size("ids") == F.col("j"), F.col("stops")).otherwise(0)
    path = F.slice("ids", 1, F.col("j"))
    burst = stored(
        turns.groupBy(F.concat(F.array("head"), path).alias("path"), "up", F.element_at("words", F.col("j")).alias("words"))
        .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum(stops).alias("stops"))
        .withColumns({"id": F.element_at("path", -1), "leaves": F.when(F.col("n") == F.col("stops"), 1).otherwise(0).cast("bigint"), "saved": (F.col("n") - 1) * F.col("words")})
    )
    here = F.size("path") - 1
    from_boxes = swept.where("path IS NOT NULL").select(F.posexplode("path").alias("at", "id"), here.alias("far"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    from_burst = burst.select(F.posexplode("path").alias("at", "id"), (here - 1).alias("far"), F.lit(1).cast("bigint").alias("children"), "leaves", "saved")
    told = from_boxes.unionByName(from_burst).groupBy("id", (F.col("at") == 0).alias("top")).agg(
        F.sum(F.when(F.col("at") == F.col("far"), F.col("children")).otherwise(0)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    told = stored(told)
    ended = boxed.where("d > 0 AND d = size(ids)").select(F.col("box").alias("id"), "ends_sha256")
    whole = burst.drop("leaves", "saved").join(told.where("NOT top").drop("top"), "id").join(ended, "id", "left")
    parents = burst.select("id", F.col("least").alias("parent_least")).join(told.select("id", "children"), "id")
    parented = attach(whole.withColumn("parent", F.get("path", F.size("path") - 2)), stored(parents).withColumnRenamed("id", "parent").withColumnRenamed("children", "many"), "parent", "many")
    top = F.size("path") == 2
    grown = parented.select(
        "id", (F.lit(base) + F.size("path") - 1).cast("bigint").alias("depth"), F.col("least").alias("conv_id"),
        F.when(top, F.col("up")).otherwise(F.col("parent_least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
    nodes = swept.where("path IS NULL").drop("path").unionByName(grown)
    return nodes, told.where("top").select(F.col("id").alias("head"), "children", "leaves", "saved")


def trie(conversations: DataFrame, limit: int = CONTAINER_TURNS, block: int = BLOCK_TURNS, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, equal ones by a digest of role and text; rows without a conv_id
    take no part; repeated rows are turns of their own; null role and text are empty.  A conversation
    that takes all its turns from an absent or short first of its family may be turnless and ends at the
    root.  An empty table gives an empty one; other columns are not looked at.

    Equal conversations are one suffix with a count.  A conversation longer than ``block`` turns goes on in
    further rows, each the head of a trie of its own; the levels are swept from the deepest up.
    """
    known = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    largest = ordered.largest_key(known, ["conv_id"])
    blocks = stored(_blocks(_sequences(_own_turns(known, largest, hot_rows), block, largest, hot_rows), block))
    facts = blocks.where("level = 0").agg(F.min("conv_id"), F.count("*")).first()
    least, convs = facts[0], facts[1]
    levels = (blocks.agg(F.max("level")).first()[0] or 0) + 1
    digests = _end_digests(blocks.where("ends").select(_last().alias("node"), "conv_id"))
    distinct = blocks.groupBy("level", "head", "ids", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.count_if("ends").alias("stops"))
    suffixes = stored(distinct.withColumn("node", _last()).join(digests, "node", "left"))
    nodes, below = None, None
    for level in reversed(range(levels)):
        part = suffixes.where(F.col("level") == level)
        if below is None:
            part = part.withColumns({f"below_{c}": F.lit(0).cast("bigint") for c in ("children", "leaves", "saved")})
        else:
            kept = [F.coalesce(c, F.lit(0)).cast("bigint").alias(f"below_{c}") for c in ("children", "leaves", "saved")]
            part = part.join(below.withColumnRenamed("head", "node"), "node", "left").select(*part.columns, *kept)
        if level:
            above = suffixes.where((F.col("level") == level - 1) & (F.size("ids") == block)).select(F.col("node").alias("head"), F.col("least").alias("up"), "n")
            part = attach(part.withColumnRenamed("n", "many"), above.withColumnRenamed("n", "rows"), "head", "rows").withColumnRenamed("many", "n")
        else:
            part = part.withColumn("up", F.lit(least).cast("bigint"))
        found, below = _level(part, level * block, limit, "bigint")
        nodes = found if nodes is None else nodes.unionByName(found)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not convs:
        return nodes.select(*columns)
    at_root = suffixes.where("level = 0 AND size(ids) = 0").select("head", "ends_sha256")
    root = below.join(at_root, "head", "left").select(
        F.col("head").alias("id"), F.lit(0).cast("bigint").alias("depth"), F.lit(least).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(convs).cast("bigint").alias("n_convs"), F.col("children").alias("n_children"), F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.unionByName(root).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).select(*columns)


def trie_sql() -> str:
    """DuckDB SQL for :func:`trie`; CRC-32 bit by bit."""
    crc = (
        "list_reduce(range(0, 8 * len(s)::BIGINT), lambda a, i: xor(xor(a, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1])::BIGINT ELSE 0 END) >> 1,"
        " 3988292384 * (xor(a, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1])::BIGINT ELSE 0 END) & 1)), 4294967295::BIGINT)"
    )
    return f"""
WITH t AS (SELECT conv_id::BIGINT AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST,
  sha256(concat(octet_length(encode(role)), ':', role, text))) AS pos, {{'role': role, 'text': text}} AS t FROM t),
h AS MATERIALIZED (SELECT c, xor({crc}, 4294967295) % {HEAD_CHOICES} AS h FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM n)),
r AS (SELECT h.c, 0 AS k, n.pos, n.t FROM h JOIN n ON n.c = h.c - h.c % {FAMILY} AND n.pos <= h.h
  UNION ALL SELECT h.c, 1, n.pos, n.t FROM h JOIN n ON n.c = h.c AND n.pos > h.h),
s AS MATERIALIZED (SELECT h.c, list(r.t ORDER BY k, pos) FILTER (r.t IS NOT NULL) AS p FROM h LEFT JOIN r ON h.c = r.c GROUP BY h.c),
m AS MATERIALIZED (SELECT c, coalesce(len(p), 0) AS total, unnest(range(0, coalesce(len(p), 0) + 1)) AS d, p FROM s),
v AS MATERIALIZED (SELECT c, total, d, CASE WHEN d = 0 THEN '' ELSE sha256(p[1:d]::VARCHAR) END AS id,
  CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE sha256(p[1:d - 1]::VARCHAR) END AS parent,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '{WORD}')) END AS words FROM m),
node AS MATERIALIZED (SELECT id, any_value(d) AS depth, any_value(parent) AS parent, any_value(words) AS words, count(*) AS n_convs, min(c) AS conv_id,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = total), '')) AS ends_sha256 FROM v GROUP BY id),
kids AS (SELECT parent AS id, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
full_ AS MATERIALIZED (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (id)),
up AS (SELECT DISTINCT b.id AS top, a.id AS id FROM v a JOIN v b ON a.c = b.c AND b.d <= a.d),
sub AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM up JOIN full_ USING (id) GROUP BY top)
SELECT f.conv_id, f.depth::BIGINT AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, sub.n_leaves, sub.saved_tokens, f.ends_sha256
FROM full_ f JOIN sub ON sub.top = f.id LEFT JOIN full_ g ON g.id = f.parent"""
