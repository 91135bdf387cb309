"""Merkle manifest of a dataset: a root digest, and for every record the proof that leads to it.

Records of a source are the leaves of its tree in id order, every three consecutive nodes make
one of the next level, and the subroots in source order are the leaves of the tree above them.

Digests travel by time-forward processing.  Nodes are labelled so that children come before
their parent; a node sends its digest to its parent's label, a priority queue hands messages out
in label order, and so each node finds its children's digests when its turn comes.  The sweep back
visits the labels in reverse and sends every node what is left of its proofs above it.

The queue has two parts.  Within a block of ``BLOCK`` neighbouring nodes it lives in the task,
where labels in post order keep it at a few messages for each level.  Messages that leave a block go
through a written table, shuffled and sorted by label.  Each round shrinks the trees by the
factor ``BLOCK``, so a hot source is many blocks and a trillion records take five rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabsight.llm.common import materialize, parts
from tabsight.operators.ordered import ORDINAL, group_spans, number_rows

FAN = 3
LEVELS = 6  # that one round climbs
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Path = tuple  # ((left siblings, right siblings), path of the parent), or () at the root


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def climb(leaves: Sequence[str], levels: int) -> list[list[str]]:
    """Digests of all nodes of a block, a list for each level from the leaves up.

    A label is (last leaf below the node, level).  Nodes without neighbours are hashed alone.
    """
    rows: list[list[str]] = [list(leaves), *([] for _ in range(levels))]
    last = len(leaves) - 1
    queue: list[tuple[int, int, int, str]] = []

    def send(level: int, at: int, value: str) -> None:
        if level < levels:
            parent = at // FAN
            heappush(queue, (min((parent + 1) * FAN ** (level + 1) - 1, last), level + 1, at, value))

    for i, leaf in enumerate(leaves):
        send(0, i, leaf)
        while queue and queue[0][0] == i:
            label, children = queue[0][:2], []
            while queue and queue[0][:2] == label:
                children.append(heappop(queue)[3])
            level = label[1]
            rows[level].append(digest("".join(children)))
            send(level, len(rows[level]) - 1, rows[level][-1])
    return rows


def deliver(rows: Sequence[Sequence[str]], above: Path) -> list[Path]:
    """The path of every leaf of a block, given the path of the block's top node."""
    top, last = len(rows) - 1, len(rows[0]) - 1
    paths: list[Path] = [()] * len(rows[0])
    queue: list[tuple[int, int, int, Path]] = [(-last, -top, 0, above)]
    while queue:
        _, level, at, path = heappop(queue)
        if level == 0:
            paths[at] = path
            continue
        below = rows[-level - 1]
        first = at * FAN
        children = below[first : first + FAN]
        for i in range(len(children)):
            left, right = "".join(children[:i]), "".join(children[i + 1 :])
            end = min((first + i + 1) * FAN ** (-level - 1) - 1, last)
            heappush(queue, (-end, level + 1, first + i, ((left, right), path)))
    return paths


def steps(path: Path) -> Iterator[tuple[str, str]]:
    """(left, right) siblings from a node up to the root."""
    while path:
        yield path[0]
        path = path[1]


def path_of(lefts: Sequence[str], rights: Sequence[str]) -> Path:
    path: Path = ()
    for pair in zip(reversed(list(lefts)), reversed(list(rights))):
        path = (pair, path)
    return path


def fold(value: str, path: Path) -> str:
    """The root that a node with this digest and these siblings would have."""
    for left, right in steps(path):
        value = digest(left + value + right)
    return value


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, list]]:
    """The rows of each block of a sorted partition as lists by column; one block is held at a time."""
    held: dict[str, list] = {}
    for pdf in batches:
        if not len(pdf):
            continue
        columns = {c: pdf[c].tolist() for c in pdf.columns}
        tree, block = pdf["tree"].to_numpy(), pdf["block"].to_numpy()
        edges = [0, *((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])).nonzero()[0] + 1, len(pdf)]
        for start, end in zip(edges, edges[1:]):
            if held and (held["tree"][0], held["block"][0]) == (columns["tree"][start], columns["block"][start]):
                for c in columns:
                    held[c] += columns[c][start:end]
            else:
                if held:
                    yield held
                held = {c: v[start:end] for c, v in columns.items()}
    if held:
        yield held


def _dealt(nodes: DataFrame) -> DataFrame:
    """Rows with (tree, block, idx) dealt by block and sorted by label; messages have idx -1."""
    return nodes.repartition(parts(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "idx")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {BLOCK}"))


_NODES = "tree long, n long, idx long, digest string"


def up(nodes: DataFrame) -> DataFrame:
    """One round up: (tree, n, idx, digest) of the nodes ``LEVELS`` higher, or of the roots of smaller trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for b in _blocks(batches):
            n = b["n"][0]
            top = climb(b["digest"], min(LEVELS, height(n)))[-1]
            out.append((b["tree"][0], -(-n // BLOCK), b["block"][0], top[0]))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["tree", "n", "idx", "digest"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["tree", "n", "idx", "digest"])

    return _dealt(_in_blocks(nodes.select("tree", "n", "idx", "digest"))).mapInPandas(run, _NODES)


_PATHS = "tree long, idx long, lefts array<string>, rights array<string>, subroot string"
_MESSAGE = "tree long, block long, lefts array<string>, rights array<string>, subroot string"


def _swept(nodes: DataFrame, messages: DataFrame, of_leaf: Callable[[dict, int, Path, str], tuple], schema: str) -> DataFrame:
    """One round down: ``of_leaf`` makes a row of each node, its path and its tree's subroot.

    A block's message is one more row of it, so paths are not joined to the nodes.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for b in _blocks(batches):
            head = {c: v.pop(0) for c, v in b.items()}
            rows = climb(b["digest"], min(LEVELS, height(b["n"][0])))
            for i, path in enumerate(deliver(rows, path_of(head["lefts"], head["rights"]))):
                out.append(of_leaf(b, i, path, head["subroot"]))
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    mail = messages.withColumn("idx", F.lit(-1).cast("long"))
    for f in nodes.schema.fields:
        if f.name not in mail.columns:
            mail = mail.withColumn(f.name, F.lit(0 if f.dataType.typeName() == "long" else False if f.dataType.typeName() == "boolean" else None).cast(f.dataType))
    return _dealt(_in_blocks(nodes).unionByName(mail, allowMissingColumns=True)).mapInPandas(run, schema)


def _paths(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    def row(b: dict, i: int, path: Path, subroot: str) -> tuple:
        pairs = list(steps(path))
        return b["tree"][i], b["idx"][i], [p[0] for p in pairs], [p[1] for p in pairs], subroot

    return _swept(nodes.select("tree", "n", "idx", "digest"), messages, row, _PATHS)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round, written: the given ones, then those a round higher, until all trees end."""
    tables = [nodes]
    while True:
        current = tables[-1] if len(tables) == 1 else tables[-1].filter("n > 1")
        tables.append(materialize(up(current), "merkle_up"))
        if not tables[-1].filter("n > 1").limit(1).count():
            return tables


def _down(tables: Sequence[DataFrame], ends: DataFrame) -> DataFrame:
    """Messages to the blocks of the first table, given those to the trees' top blocks (tree, lefts, rights, subroot)."""
    messages = None
    for i in range(len(tables) - 1, 0, -1):
        done = tables[i].filter("n = 1").select("tree").join(ends, "tree").withColumn("block", F.lit(0).cast("long"))
        messages = done if messages is None else messages.unionByName(done.select(*messages.columns))
        messages = materialize(messages.select("tree", "block", "lefts", "rights", "subroot"), "merkle_mail")
        if i > 1:
            messages = _paths(tables[i - 1].filter("n > 1"), messages).withColumnRenamed("idx", "block")
    return messages


@dataclass(frozen=True)
class Manifest:
    """A written manifest.

    ``leaves``: tree, n, idx, digest and the columns the leaves came with.  ``subroots``: one row per source
    (tree, source, n, subroot).  ``mail``: what reaches the blocks of leaves in the sweep back.
    """

    root: str | None
    leaves: DataFrame
    subroots: DataFrame
    mail: DataFrame | None

    def proofs(self) -> DataFrame:
        """(tree, idx, lefts, rights, subroot) of each leaf: its siblings at each level up to the root."""
        return _paths(self.leaves, self.mail)


def build(leaves: DataFrame, order: Sequence[str], source: str = "source") -> Manifest:
    """The manifest of ``leaves`` (a written table with ``digest``), ordered by ``order`` within each source, nulls first."""
    rows = number_rows(leaves, [source, *order])
    spans = group_spans(rows, [source]).select(
        F.col(source).alias("_source"), F.col("_start").alias("tree"), F.col("_n").alias("n"))
    placed = rows.frame.join(spans, F.col(source).eqNullSafe(F.col("_source"))).withColumn("idx", F.col(ORDINAL) - F.col("tree"))
    placed = placed.drop("_source", ORDINAL)
    if not rows.total:
        return Manifest(None, placed, spans.select("tree", F.col("_source").alias(source), "n", F.lit(None).cast("string").alias("subroot")), None)
    tables = _rounds(placed)
    tops = None
    for t in tables[1:]:
        ended = t.filter("n = 1").select("tree", "digest")
        tops = ended if tops is None else tops.unionByName(ended)
    # trees are named by their first ordinal, so their order is that of the sources
    numbered = number_rows(tops, ["tree"])
    roots = numbered.frame.select(
        F.lit(0).cast("long").alias("tree"), F.lit(numbered.total).cast("long").alias("n"), F.col(ORDINAL).alias("idx"), "digest", F.col("tree").alias("of"))
    above = _rounds(roots.drop("of"))
    root = above[-1].first()["digest"]
    start = leaves.sparkSession.createDataFrame([(0, [], [], root)], "tree long, lefts array<string>, rights array<string>, subroot string")
    paths = _paths(roots.drop("of"), _down(above, start))
    ends = roots.select(F.col("of").alias("tree"), "idx", F.col("digest").alias("subroot")).join(paths.select("idx", "lefts", "rights"), "idx")
    ends = materialize(ends.select("tree", "lefts", "rights", "subroot"), "merkle_mail")
    subroots = spans.join(ends.select("tree", "subroot"), "tree").select("tree", F.col("_source").alias(source), "n", "subroot")
    return Manifest(root, placed, subroots, _down(tables, ends))


def _field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


_VERIFIED = "doc_id long, no_id boolean, leaf string, subroot string, proof_sha256 string, folded_root string"


def manifest_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    ``folded_root`` starts from the leaf of a tampered text, without its line feeds, where 2 divides the
    crc32 of the id.  A null id comes first in its source and is not tampered with; documents of one
    source and id go by their digest; equal rows have a leaf each.  Texts are hashed where they are read and
    never shuffled.  Other columns are ignored, an empty table gives no rows.
    """
    text, number = F.col("text"), F.col("doc_id").cast("long").cast("string")
    values = [number, F.col("source"), F.col("lang"), F.col("n_chars").cast("long").cast("string"), text]
    touched = (F.crc32(number.cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    forged = F.when(touched, _leaf([*values[:-1], F.replace(text, F.lit("\n"), F.lit(""))]))
    leaves = docs.select(
        "source", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"),
        _leaf(values).alias("digest"), forged.alias("forged"))
    leaves = leaves.withColumn("has_id", ~F.col("no_id"))
    made = build(materialize(leaves, "merkle_leaves"), ["has_id", "id", "digest"])

    def row(b: dict, i: int, path: Path, subroot: str) -> tuple:
        proof = digest("".join(left + right for left, right in steps(path)))
        return b["id"][i], b["no_id"][i], b["digest"][i], subroot, proof, fold(b["forged"][i] or b["digest"][i], path)

    if made.root is None:
        swept = docs.sparkSession.createDataFrame([], _VERIFIED)
    else:
        swept = _swept(made.leaves.select("tree", "n", "idx", "digest", "id", "no_id", "forged"), made.mail, row, _VERIFIED)
    root = F.lit(made.root).cast("string")
    return swept.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"))


# crc32 bit by bit; tree levels and folds by recursion
MANIFEST_SQL = r"""
WITH RECURSIVE shown AS (
  SELECT doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') AS f1, coalesce(strlen(source) || ':' || source, '-') AS f2,
         coalesce(strlen(lang) || ':' || lang, '-') AS f3, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS f4,
         coalesce(strlen(text) || ':' || text, '-') AS f5, replace(text, chr(10), '') AS cut,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                                      lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(f1 || f2 || f3 || f4 || f5) AS leaf,
         CASE WHEN crc % 2 = 0 THEN sha256(f1 || f2 || f3 || f4 || coalesce(strlen(cut) || ':' || cut, '-'))
              ELSE sha256(f1 || f2 || f3 || f4 || f5) END AS altered
  FROM shown),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves),
low(tree, level, idx, digest, m) AS (
  SELECT tree, 0, idx, leaf, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (m + 2) // 3
  FROM low WHERE m > 1 GROUP BY tree, level, idx // 3, m),
subroots AS (SELECT tree, digest, count(*) OVER () AS n FROM low WHERE m = 1),
high(level, idx, digest, m) AS (
  SELECT 0, tree, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (m + 2) // 3
  FROM high WHERE m > 1 GROUP BY level, idx // 3, m),
sides AS (
  SELECT p.tree, p.idx, s.level, s.idx AS place, s.digest, s.idx < p.idx // (3 ** s.level)::BIGINT AS is_left
  FROM placed p JOIN low s ON s.tree = p.tree AND s.m > 1 AND s.idx // 3 = p.idx // (3 ** (s.level + 1))::BIGINT
    AND s.idx <> p.idx // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT p.tree, p.idx, 1000 + s.level, s.idx, s.digest, s.idx < p.tree // (3 ** s.level)::BIGINT
  FROM placed p JOIN high s ON s.m > 1 AND s.idx // 3 = p.tree // (3 ** (s.level + 1))::BIGINT
    AND s.idx <> p.tree // (3 ** s.level)::BIGINT),
proofs AS (SELECT tree, idx, sha256(string_agg(digest, '' ORDER BY level, place)) AS proof FROM sides GROUP BY tree, idx),
path AS (
  SELECT p.tree, p.idx, l.level, row_number() OVER (PARTITION BY p.tree, p.idx ORDER BY l.level) AS step
  FROM placed p JOIN (
    SELECT DISTINCT tree, level FROM low WHERE m > 1 UNION ALL SELECT DISTINCT t.tree, 1000 + h.level FROM subroots t, high h WHERE h.m > 1) l ON l.tree = p.tree),
steps AS (
  SELECT path.tree, path.idx, path.step,
         coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE s.is_left), '') AS lefts,
         coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE NOT s.is_left), '') AS rights
  FROM path LEFT JOIN sides s ON s.tree = path.tree AND s.idx = path.idx AND s.level = path.level
  GROUP BY path.tree, path.idx, path.step),
folds(tree, idx, step, value) AS (
  SELECT tree, idx, 0::BIGINT, altered FROM placed
  UNION ALL
  SELECT f.tree, f.idx, f.step + 1, sha256(s.lefts || f.value || s.rights)
  FROM folds f JOIN steps s ON s.tree = f.tree AND s.idx = f.idx AND s.step = f.step + 1),
folded AS (SELECT tree, idx, max_by(value, step) AS value FROM folds GROUP BY tree, idx),
top AS (SELECT digest FROM high WHERE m = 1)
SELECT p.doc_id, p.leaf, r.digest AS subroot, top.digest AS root, coalesce(proofs.proof, sha256('')) AS proof_sha256,
       folded.value AS folded_root, folded.value = top.digest AS verified
FROM placed p JOIN subroots r USING (tree) CROSS JOIN top JOIN folded USING (tree, idx) LEFT JOIN proofs USING (tree, idx)"""
