"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a source, by doc_id, are joined three by
three up to the source's subroot, and subroots in the same way up to the root.
Nodes are labelled by level and place, so a node's label is above those of its
children. Nodes are taken in the order of their labels: a priority queue
delivers the digests of the children to the parent's label, and a reversed
sweep delivers to every child the proof suffix of its parent, with its own
siblings before it.

The queue is external: a tree is cut into blocks of 3 ** LEVELS consecutive
nodes. Messages within a block stay in the task's queue; what a block's top
sends goes through the shared folder, dealt by the label of the block that it
is for. So a source of any size is many blocks, and a round does LEVELS levels.

A suffix is a list of levels, ``left,right`` each, split by ``;``: the digests of
the siblings before and after the node. The proof is its digests, in order.

Defined results: null columns are hashed as ``-``; a null source is a source of
its own, before all others; a null doc_id comes first in its source; rows that
repeat a doc_id are leaves of their own, ordered by their digests; a lone leaf
is its source's subroot, a lone subroot the root, with an empty proof; an empty
table gives no rows. Texts are hashed whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftline.llm.common import discard, materialise, prepare, table

#: Children of a node, levels of a block, and rows of a range of the leaves.
FAN, LEVELS, RANGE = 3, 6, 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the count of bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    columns = {c: F.col(c) for c in FIELDS} | ({} if text is None else {"text": text})
    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)).cast("binary"), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int, most: int = LEVELS) -> int:
    """Levels that a tree with n nodes goes up at once."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // FAN), k + 1
    return k


def upward(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of a block's nodes by level, taken from a queue by label; the last level is the block's top."""
    queue: list[tuple[int, int, str]] = []
    for place, d in enumerate(digests):
        heappush(queue, (0, place, d))
    found: list[list[str]] = [[] for _ in range(levels + 1)]
    held: list[str] = []
    while queue:
        level, place, d = heappop(queue)
        found[level].append(d)
        if level == levels:
            continue
        held.append(d)
        if len(held) == FAN or not queue or queue[0][0] > level:  # the last child that this parent has
            heappush(queue, (level + 1, place // FAN, _sha("".join(held))))
            held = []
    return found


def downward(found: list[list[str]], suffix: str) -> list[str]:
    """The suffix of every lowest node, from that of the block's top: the sweep in reverse order of labels."""
    queue: list[tuple[int, int, str]] = [(-(len(found) - 1), 0, suffix)]
    out = [""] * len(found[0])
    while queue:
        level, place, own = heappop(queue)
        if level == 0:
            out[-place] = own
            continue
        below = found[-level - 1]
        first = -place * FAN
        run = below[first : first + FAN]
        for k in range(len(run)):
            step = "".join(run[:k]) + "," + "".join(run[k + 1 :])
            heappush(queue, (level + 1, -(first + k), step + (";" + own if own else "")))
    return out


def proof_digest(suffix: str) -> str:
    return _sha(suffix.replace(",", "").replace(";", ""))


def fold(digest: str, suffix: str) -> str:
    """The root that a digest and its proof give."""
    for step in suffix.split(";") if suffix else ():
        left, right = step.split(",")
        digest = _sha(left + digest + right)
    return digest


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows, with ``place`` from 0 within each tree by the order, and ``n``, the tree's rows.

    Ranges of about RANGE rows are numbered each, after one row for each range and tree has been summed; ties are
    broken by a row number, so neither a tree nor equal rows make a range large.
    """
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()))
    parts = max(1, -(-rows.count() // RANGE))
    ranged = materialise(rows.repartitionByRange(parts, tree, *order, "tie").withColumn("range", F.spark_partition_id()))
    discard(rows)
    counts = ranged.groupBy("range", F.col(tree).alias("t")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("t").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("range").alias("r"), "t", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"), F.sum("c").over(Window.partitionBy("t")).alias("n"))
    within = F.row_number().over(Window.partitionBy("range", tree).orderBy(*order, "tie")) - 1
    met = ranged.withColumn("within", within).join(counts, (F.col("range") == F.col("r")) & F.col(tree).eqNullSafe(F.col("t")))
    return met.withColumn("place", F.col("first") + F.col("within")).drop("range", "r", "t", "first", "within", "tie")


def _blocks(nodes: DataFrame, tree: str, columns: list[str]) -> DataFrame:
    """Nodes (tree, place, n, columns) -> rows of at most 3 ** LEVELS nodes: tree, block, n, items by place."""
    size = FAN**LEVELS
    packed = nodes.groupBy(tree, F.floor(F.col("place") / size).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias("items"))
    return packed.select(tree, "block", "n", *(F.col(f"items.{c}").alias(c) for c in columns))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests = batch.column("n").to_pylist(), batch.column("digest").to_pylist()
        tops = [upward(d, height(n))[-1][0] for n, d in zip(sizes, digests, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("block"), pa.array([-(-n // FAN**LEVELS) for n in sizes], pa.int64()), pa.array(tops, pa.string())], ["tree", "place", "n", "digest"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees, places, suffixes = [], [], []
        for tree, block, n, digests, suffix in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "digest", "suffix")), strict=True):
            own = downward(upward(digests, height(n)), suffix or "")
            trees.extend([tree] * len(own))
            places.extend(range(block * FAN**LEVELS, block * FAN**LEVELS + len(own)))
            suffixes.extend(own)
        yield pa.RecordBatch.from_arrays([pa.array(trees, batch.column(0).type), pa.array(places, pa.int64()), pa.array(suffixes, pa.string())], ["tree", "place", "suffix"])


def sweep_up(nodes: DataFrame, columns: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tree, place, n, digest) -> the blocks of each round, and the roots (tree, digest). A round for every LEVELS levels of the largest tree."""
    rounds, roots = [materialise(_blocks(nodes, "tree", columns))], []
    kind = nodes.schema["tree"].dataType.simpleString()
    while True:
        tops = materialise(rounds[-1].select("tree", "block", "n", "digest").mapInArrow(_tops, f"tree {kind}, place bigint, n bigint, digest string"))
        roots.append(tops.where("n = 1").select("tree", "digest"))
        more = tops.where("n > 1")
        if more.isEmpty():
            break
        rounds.append(materialise(_blocks(more, "tree", ["digest"])))
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return rounds, found


def _with_suffix(blocks: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Blocks with the suffix of their top."""
    s = suffixes.select(F.col("tree").alias("t"), F.col("place").alias("p"), "suffix")
    return blocks.join(s, (F.col("tree") == F.col("t")) & (F.col("block") == F.col("p")), "left").drop("t", "p")


def sweep_down(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest round's blocks with the suffix of their tops; roots (tree, suffix) begin it."""
    kind = roots.schema["tree"].dataType.simpleString()
    suffixes = roots.select("tree", F.lit(0).cast("long").alias("place"), "suffix")
    for k in range(len(rounds) - 1, 0, -1):
        # trees that ended in a lower round go past the higher ones
        sent = _with_suffix(rounds[k], suffixes).select("tree", "block", "n", "digest", "suffix").mapInArrow(_suffixes, f"tree {kind}, place bigint, suffix string")
        own = rounds[k].select("tree").distinct()
        suffixes = materialise(sent.unionByName(suffixes.join(own, "tree", "left_anti")))
    return _with_suffix(rounds[0], suffixes)


_PROVED = "doc_id {0}, tree bigint, leaf string, proof_sha256 string, folded_root string, n_siblings bigint"


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, trees, leaves, proofs, folded, siblings = [], [], [], [], [], []
        for doc_ids, tree, n, digests, others, suffix in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tree", "n", "digest", "tampered", "suffix")), strict=True):
            own = downward(upward(digests, height(n)), suffix or "")
            ids.extend(doc_ids)
            trees.extend([tree] * len(own))
            leaves.extend(digests)
            for s, t in zip(own, others, strict=True):
                proofs.append(proof_digest(s))
                folded.append(fold(t, s))
                siblings.append(len(s.replace(",", "").replace(";", "")) // 64)
        columns = ((ids, batch.column("doc_id").type.value_type), (trees, pa.int64()), (leaves, pa.string()), (proofs, pa.string()), (folded, pa.string()), (siblings, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["doc_id", "tree", "leaf", "proof_sha256", "folded_root", "n_siblings"])


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings of every row.

    ``tampered`` is what a row's text has become since (the text itself, if not said): folded_root is made of that
    text's leaf and the proof of the original.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text") if tampered is None else tampered
    leaves = docs.select("doc_id", "source", leaf().alias("digest"), F.when(text.eqNullSafe(F.col("text")), F.lit(None)).otherwise(leaf(text)).alias("tampered"))
    placed = materialise(numbered(leaves.withColumn("tampered", F.coalesce("tampered", "digest")), "source", ["doc_id", "digest"]))
    sources = materialise(numbered(placed.where("place = 0").select("source", F.lit(0).alias("all")), "all", ["source"]).select("source", F.col("place").alias("tree")))
    nodes = placed.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("tree", "place", "n", "doc_id", "digest", "tampered")
    rounds, subroots = sweep_up(nodes, ["doc_id", "digest", "tampered"])
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(subroots.count()).alias("n"))
    top_rounds, roots = sweep_up(tops, ["digest"])
    found = roots.first()
    root = found["digest"] if found else None  # one digest
    top_blocks = sweep_down(top_rounds, roots.select("tree", F.lit("").alias("suffix")))
    top_suffixes = top_blocks.select("tree", "block", "n", "digest", "suffix").mapInArrow(_suffixes, "tree bigint, place bigint, suffix string")
    starts = materialise(top_suffixes.select(F.col("place").alias("tree"), "suffix"))
    proved = sweep_down(rounds, starts).select("doc_id", "tree", "n", "digest", "tampered", "suffix").mapInArrow(_prove, _PROVED.format(kind))
    return proved.join(subroots.withColumnRenamed("digest", "subroot"), "tree").select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", F.col("folded_root").eqNullSafe(F.lit(root)).alias("verified"), "n_siblings"
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else f"{c}::VARCHAR") for c in FIELDS) + ")"


#: The tree node by node in recursive queries: levels of a source, then of the subroots; each leaf meets the runs of its ancestors, and folds step by step.
ORACLES = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE crc_bits AS (
    SELECT b AS b0, b::BIGINT AS c, 0 AS k FROM range(256) AS r(b)
    UNION ALL SELECT b0, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
), crc_table AS (
    SELECT list(c ORDER BY b0) AS t FROM crc_bits WHERE k = 8
), crcs AS (
    SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 4294967295::BIGINT AS c, 0 AS k FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT doc_id, s, xor(c >> 8, t[(xor(c, ascii(s[k + 1])::BIGINT) & 255) + 1]), k + 1 FROM crcs, crc_table WHERE k < length(s)
), even AS (
    SELECT doc_id FROM crcs WHERE k = length(s) AND xor(c, 4294967295::BIGINT) % 2 = 0
), leaves AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, {_sql_leaf("text")} AS leaf,
           CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS tampered
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
    SELECT tree, 0 AS level, place, n, leaf AS digest FROM placed
    UNION ALL SELECT tree, level + 1, place // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, level, place // {FAN}, n
), subroots AS (
    SELECT tree, level AS tops, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS n FROM nodes WHERE n = 1
), top_nodes AS (
    SELECT 0 AS level, spot AS place, n, subroot AS digest FROM subroots
    UNION ALL SELECT level + 1, place // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY place)) FROM top_nodes WHERE n > 1 GROUP BY level, place // {FAN}, n
), runs AS (
    SELECT tree, level, place // {FAN} AS run, list(digest ORDER BY place) AS d FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
    SELECT level, place // {FAN} AS run, list(digest ORDER BY place) AS d FROM top_nodes WHERE n > 1 GROUP BY ALL
), steps AS (
    SELECT p.doc_id, p.leaf, p.place, p.tree, r.level, r.d, (p.place // ({FAN} ** r.level)::BIGINT) % {FAN} AS k
    FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.place // ({FAN} ** (r.level + 1))::BIGINT
    UNION ALL
    SELECT p.doc_id, p.leaf, p.place, p.tree, s.tops + r.level, r.d, (s.spot // ({FAN} ** r.level)::BIGINT) % {FAN}
    FROM placed p JOIN subroots s USING (tree) JOIN top_runs r ON r.run = s.spot // ({FAN} ** (r.level + 1))::BIGINT
), sides AS (
    SELECT tree, place, level, array_to_string(d[:k], '') AS l, array_to_string(d[k + 2:], '') AS r FROM steps
), proofs AS (
    SELECT tree, place, string_agg(l || r, '' ORDER BY level) AS proof, count(*) AS depth FROM sides GROUP BY tree, place
), folds AS (
    SELECT tree, place, 0 AS level, tampered AS digest FROM placed
    UNION ALL SELECT f.tree, f.place, f.level + 1, sha256(s.l || f.digest || s.r) FROM folds f JOIN sides s ON s.tree = f.tree AND s.place = f.place AND s.level = f.level
)
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(coalesce(o.proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified,
       length(coalesce(o.proof, '')) // 64 AS n_siblings
FROM placed p JOIN subroots s USING (tree) JOIN (SELECT digest FROM top_nodes WHERE n = 1) t ON true LEFT JOIN proofs o ON o.tree = p.tree AND o.place = p.place
JOIN folds f ON f.tree = p.tree AND f.place = p.place AND f.level = coalesce(o.depth, 0)"""
}
