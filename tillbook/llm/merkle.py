"""Merkle manifest of a dataset: a persistent hash tree in which each altered leaf makes a version that copies only its path.

A node is the SHA-256 of its two children's digests as hex text; the last node of an odd level is hashed alone. A tree is built in steps of
``LEVELS`` levels: an aligned block of 2^LEVELS nodes makes one node of the next step, whatever the number of leaves, so no task holds more
than a block, and a tree of 2^30 leaves takes three steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import stored
from tillbook.operators.sequence import number_rows

#: Levels of one block.
LEVELS = 10
#: Columns of a leaf, in the order they are hashed in.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after another: ``-`` for a null, else the number of its UTF-8 bytes, a colon and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _node(*children: str) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels_of(nodes: Sequence[str], levels: int | None) -> list[list[str]]:
    """The levels above ``nodes``, themselves first: so many, or without a number until one node is left."""
    built = [list(nodes)]
    while len(built[-1]) > 1 if levels is None else len(built) <= levels:
        below = built[-1]
        built.append([_node(*below[at : at + 2]) for at in range(0, len(below), 2)])
    return built


def siblings(built: list[list[str]], place: int) -> list[str]:
    """What stands beside the path from ``place`` up, level by level; empty where the path's node stands alone."""
    found = []
    for level in built[:-1]:
        beside = place ^ 1
        found.append(level[beside] if beside < len(level) else "")
        place >>= 1
    return found


def copied_path(built: list[list[str]], place: int, digest: str) -> list[str]:
    """The nodes that a version with another ``digest`` at ``place`` copies, from the leaf up; it shares all others with the tree."""
    path = [digest]
    for beside in siblings(built, place):
        children = (beside, path[-1]) if place & 1 else (path[-1], beside)
        path.append(_node(*children))
        place >>= 1
    return path


def _block_step(nodes: DataFrame, levels: int) -> DataFrame:
    """For nodes (tree, pos, digest, single, altered): ``beside`` (their siblings within the block), ``top`` (the block's node) and
    ``version`` (the block's node in the version of an altered node; null without one).

    ``single`` says that the tree has but this block, which then ends with its root; of another block all levels are built.
    """

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pos", "digest", "altered"))))
        alone = table.column("single")[0].as_py()
        built = levels_of([digest for _, digest, _ in rows], None if alone else levels)
        versions = [copied_path(built, at, altered)[-1] if altered else None for at, (_, _, altered) in enumerate(rows)]
        return pa.table(
            {
                "tree": table.column("tree"),
                "pos": pa.array([pos for pos, _, _ in rows], pa.int64()),
                "single": table.column("single"),
                "beside": pa.array([siblings(built, at) for at in range(len(rows))], pa.list_(pa.string())),
                "top": pa.array([built[-1][0]] * len(rows), pa.string()),
                "version": pa.array(versions, pa.string()),
            }
        )

    block = F.shiftright("pos", levels)
    schema = "tree long, pos long, single boolean, beside array<string>, top string, version string"
    return stored(nodes.groupBy("tree", block.alias("_block")).applyInArrow(build, schema), "merkle-blocks")


def folded(digest: str, path: str, place: str) -> Column:
    """``digest`` with the siblings in the array column ``path`` folded in, from ``place`` in its tree up."""
    start = F.struct(F.col(digest).alias("digest"), F.col(place).cast("long").alias("place"))

    def step(state: Column, sibling: Column) -> Column:
        left = state["place"].bitwiseAND(F.lit(1).cast("long")) == 0
        children = F.when(left, F.concat(state["digest"], sibling)).otherwise(F.concat(sibling, state["digest"]))
        return F.struct(F.sha2(children, 256).alias("digest"), F.shiftright(state["place"], 1).alias("place"))

    return F.aggregate(path, start, step, lambda state: state["digest"])


def grow(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The trees over leaves (tree, pos, digest, altered): first the same places with ``path`` (the siblings up to the root, empty where
    there is none), ``root`` and ``version``, the root of the version in which that leaf alone is ``altered`` (null where that is null;
    an ``altered`` that equals ``digest`` is folded up like any other); then each tree with its ``root``.

    Places count from 0 in each tree without gaps. A block holds the versions of its own leaves. Above that, versions go on as
    rows: each is joined with the siblings of its block's node and copies the nodes on its path, so a block's versions are spread by place
    and never gathered.
    """
    many = F.shiftright("last", levels) > 0

    def sized(nodes: DataFrame) -> DataFrame:
        last = stored(nodes.groupBy("tree").agg(F.max("pos").alias("last")), "merkle-sizes")
        return nodes.join(last, "tree").withColumn("single", ~many).drop("last")

    none = F.lit(None).cast("string").alias("altered")
    steps = [_block_step(sized(leaves), levels)]
    while not steps[-1].where("not single").isEmpty():
        # Trees of several blocks go on with one node for each.
        first_of_block = F.col("pos").bitwiseAND((1 << levels) - 1) == 0
        up = steps[-1].where(~F.col("single") & first_of_block)
        steps.append(_block_step(sized(up.select("tree", F.shiftright("pos", levels).alias("pos"), F.col("top").alias("digest"), none)), levels))

    roots = steps[0].where("single and pos = 0").select("tree", F.col("top").alias("root"))
    for step in steps[1:]:
        roots = roots.union(step.where("single and pos = 0").select("tree", "top"))

    # Down from the last step, each node learns what lies above its block: the rest of its path and the root.
    above = steps[-1].select("tree", "pos", F.col("beside").alias("path"), F.col("top").alias("root"))
    for step in reversed(steps[:-1]):
        upper = stored(above.select("tree", F.col("pos").alias("_block"), F.col("path").alias("rest"), "root"), "merkle-upper")
        own = step.withColumn("_block", F.shiftright("pos", levels)).join(upper, ["tree", "_block"], "left")
        rest = F.coalesce("rest", F.array().cast("array<string>"))
        above = own.select("tree", "pos", F.concat("beside", rest).alias("path"), F.coalesce("root", "top").alias("root"), "version")

    # Up from the first step, each version copies what is above its block.
    if len(steps) > 1:
        changed = steps[0].where("version is not null").select("tree", F.col("pos").alias("leaf"), F.shiftright("pos", levels).alias("pos"), "version")
        for step in steps[1:]:
            going = changed.join(step.select("tree", "pos", "beside"), ["tree", "pos"], "left")
            going = going.withColumn("beside", F.coalesce("beside", F.array().cast("array<string>")))
            changed = going.select("tree", "leaf", F.shiftright("pos", levels).alias("pos"), folded("version", "beside", "pos").alias("version"))
        changed = changed.select("tree", F.col("leaf").alias("pos"), "version")
        above = above.drop("version").join(changed, ["tree", "pos"], "left")
    else:
        above = steps[0].select("tree", "pos", F.col("beside").alias("path"), F.col("top").alias("root"), "version")
    return above, roots


def tampered(doc_id: Column, n_chars: Column, every: int = TAMPER) -> Column:
    """``n_chars`` plus 1 where ``every`` divides the crc32 of the doc_id in decimal digits; nulls stay, and so do rows without a doc_id."""
    hit = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % every == 0
    return F.when(F.coalesce(hit, F.lit(False)), n_chars + F.lit(1).cast("long")).otherwise(n_chars)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot (of its language), root, proof_sha256 (of all siblings up to the root), folded_root
    (recomputed from the document's leaf, altered where it is tampered with, and its siblings) and verified (whether it equals the root).

    Leaves stand by doc_id within their language (nulls last, then by leaf; rows that repeat in full are leaves of their own), languages by
    their UTF-8 bytes, null first. An empty text is hashed as such. A long text is hashed by Spark within its scan; nothing else
    of it is kept. An empty table gives no rows. Other columns than ``FIELDS`` are not used.
    """
    own = [F.col(f) for f in FIELDS]
    changed = [tampered(F.col("doc_id"), F.col("n_chars")) if f == "n_chars" else F.col(f) for f in FIELDS]
    hashed = stored(
        docs.select("doc_id", "lang", leaf_digest(*own).alias("digest"), leaf_digest(*changed).alias("altered")), "merkle-leaves"
    )
    langs = stored(hashed.groupBy("lang").count(), "merkle-langs")
    ranked = number_rows(langs.withColumn("none", F.col("lang").isNotNull()), ["none", "lang"], "tree").select("lang", "tree", "count")
    ranked = stored(ranked, "merkle-trees")
    placed = number_rows(
        hashed.join(ranked.select("lang", "tree"), hashed["lang"].eqNullSafe(ranked["lang"])).select("tree", "doc_id", "digest", "altered"),
        ["tree", "doc_id", "digest"],
        "seq",
    )
    starts = stored(placed.groupBy("tree").agg(F.min("seq").alias("start")), "merkle-starts")
    placed = placed.join(starts, "tree").withColumn("pos", F.col("seq") - F.col("start")).drop("seq", "start")
    # A document that isn't altered is folded as well: its own leaf goes up by its siblings.
    leaves = stored(placed.select("tree", "pos", "doc_id", "digest", "altered"), "merkle-placed")
    paths, roots = grow(leaves.drop("doc_id"), levels)
    # The languages' subroots are the leaves of one more tree.
    subroots = roots
    over = stored(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("altered")), "merkle-subroots")
    upper, _ = grow(over, levels)
    top = stored(upper.select(F.col("pos").alias("tree"), F.col("path").alias("upper"), F.col("root").alias("all")), "merkle-root")
    again = folded("version", "upper", "tree")
    proven = paths.join(top, "tree").select(
        "tree",
        "pos",
        F.col("root").alias("subroot"),
        F.col("all").alias("root"),
        F.sha2(F.concat(F.array_join("path", ""), F.array_join("upper", "")), 256).alias("proof_sha256"),
        again.alias("folded_root"),
        (again == F.col("all")).alias("verified"),
    )
    digest = F.col("digest").alias("leaf")
    return leaves.select("tree", "pos", "doc_id", digest).join(proven, ["tree", "pos"]).drop("tree", "pos")
