"""Operator 11: a Merkle manifest of a dataset, by labels that are nested intervals.

Each row is a leaf, the digest of its fields. The leaves of a part (a language) stand in an order of their
own, and a node's label is the interval [lo, hi) of leaf ranks that it covers: the leaf of rank r has [r, r + 1),
a node has the union of its children's. So ancestors are found without pointers: a node's ancestor on a level
is the one whose interval contains its own, and a node's siblings are what is left of the parent's interval
without its own. Subroots of the parts, in the parts' order, are the leaves of one more tree of the same kind.

Levels are worked out HEIGHT at a time. The nodes whose labels lie in one interval of the level HEIGHT above
are a block: at most ARITY ** HEIGHT of them, whatever the data, so all rows are dealt once and then
blocks only, a thousandth of them. On the way down a block joins the path of the ancestor that contains it,
bucketed by that one's level and first rank, and only then do leaves get their whole paths.

A row's proof is its path: for each level, the digests of its siblings on the left and on the right. Folding a
leaf with it gives the root again, unless the leaf is another one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved
from .ranks import ranked

ARITY, HEIGHT = 2, 10
#: Fields of a document's leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(fields: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the fields: ``-`` for null, else the length in UTF-8 bytes, ``:`` and the value.

    Lengths keep fields apart, and null from empty.
    """
    parts = []
    for c in fields:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path give."""
    return F.aggregate(path, leaf, lambda x, p: F.sha2(F.concat(p["left"], x, p["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of a path's siblings, level by level from the leaf up, left to right."""
    return _joined(F.transform(path, lambda p: F.concat(p["left"], p["right"])))


def _whole(a: Column, b) -> Column:
    return ((a - a % b) / b).cast("long")


def _blocks(nodes: DataFrame, arity: int, height: int, tier: int) -> DataFrame:
    """(part, lo, hi, size, members, levels): nodes of level ``height * tier`` by the ancestor that contains them.

    ``levels[k]`` are the digests of the block's nodes k levels up, the last one is of a single node. A part
    ends where one node is left of it.
    """
    one, span = arity ** (height * tier), arity ** (height * (tier + 1))
    powers = F.array(*(F.lit(arity**k).cast("long") for k in range(63) if arity**k < 1 << 62))
    block = _whole(F.col("lo"), span)
    members = F.array_sort(F.collect_list(F.struct("lo", "digest", "held")))
    dealt = nodes.groupBy("part", block.alias("block")).agg(F.max("size").alias("size"), members.alias("m"))
    tall = F.size(F.filter(powers, lambda p: p < F.col("size"))) - height * tier
    steps = F.slice(F.array(*(F.lit(k) for k in range(height))), F.lit(1), F.least(F.greatest(tall, F.lit(0)), F.lit(height)))
    up = lambda d: F.transform(F.sequence(F.lit(0), ((F.size(d) - 1 - (F.size(d) - 1) % arity) / arity).cast("int")), lambda i: _joined(F.slice(d, i * arity + 1, F.lit(arity))))
    levels = F.aggregate(steps, F.array(F.transform("m", lambda x: x["digest"])), lambda made, _: F.concat(made, F.array(up(F.element_at(made, -1)))))
    kept = F.transform("m", lambda x: F.struct(x["lo"].alias("lo"), x["held"].alias("held")))
    lo = F.col("block") * span
    return dealt.select("part", lo.alias("lo"), F.least(lo + span, "size").alias("hi"), "size", F.lit(one).cast("long").alias("one"), kept.alias("members"), levels.alias("levels"))


def _path(lo: Column, arity: int, height: int) -> Column:
    """Within a block, the siblings of each ancestor-or-self of the member that begins at ``lo``: what its parent covers without it."""
    powers = F.array(*(F.lit(arity**k).cast("long") for k in range(height + 2) if arity**k < 1 << 62))

    def level(k: Column) -> Column:
        wide = F.col("one") * F.element_at(powers, k + 1)
        base, end = F.col("lo"), F.col("size")
        own_lo = base + _whole(lo - base, wide) * wide
        own_hi = F.least(own_lo + wide, end)
        parent_lo = base + _whole(lo - base, wide * arity) * (wide * arity)
        parent_hi = F.least(parent_lo + wide * arity, end)
        of = F.element_at("levels", k + 1)
        covered = lambda a, b: F.array_join(F.slice(of, (_whole(a - base, wide) + 1).cast("int"), _whole(F.greatest(b - a, F.lit(0)) + wide - 1, wide).cast("int")), "")
        return F.struct(covered(parent_lo, own_lo).alias("left"), covered(own_hi, parent_hi).alias("right"))

    steps = F.slice(F.array(*(F.lit(k) for k in range(height))), F.lit(1), F.size("levels") - 1)
    return F.transform(steps, level)


def _tree(leaves: DataFrame, above: Callable[[DataFrame], DataFrame], arity: int, height: int) -> DataFrame:
    """(part, held, leaf, path, top): each leaf with its path to the roots of ``above``.

    ``leaves`` are (part, rank, size, digest, held); ``above`` takes (part, digest) of each part's root and gives
    (part, path, top), the path from there on and what else is known there.
    """
    most = leaves.agg(F.max("size")).first()[0] or 1
    tiers = 1
    while arity ** (height * tiers) < most:
        tiers += 1
    nodes = leaves.select("part", F.col("rank").alias("lo"), "size", "digest", "held")
    blocks = []
    for tier in range(tiers):
        blocks.append(saved(_blocks(nodes, arity, height, tier), "blocks"))
        nodes = blocks[-1].select("part", "lo", "size", F.element_at(F.element_at("levels", -1), 1).alias("digest"), F.lit(None).cast(leaves.schema["held"].dataType).alias("held"))
    upper = above(nodes.select("part", "digest")).select("part", F.lit(0).cast("long").alias("lo"), F.lit(1 << 62).alias("hi"), "path", "top")
    for tier in reversed(range(tiers)):
        span = arity ** (height * (tier + 1)) if tier < tiers - 1 else 1 << 62
        own, anc = (x.withColumn("bucket", _whole(F.col("lo"), span)).alias(name) for x, name in ((blocks[tier], "b"), (upper, "a")))
        inside = (F.col("b.part") == F.col("a.part")) & (F.col("b.bucket") == F.col("a.bucket")) & (F.col("a.lo") <= F.col("b.lo")) & (F.col("b.hi") <= F.col("a.hi"))
        attached = own.join(anc, inside).select("b.*", F.col("a.path").alias("beyond"), "a.top")
        wide = F.least(F.col("one"), F.col("size"))
        each = F.transform(F.arrays_zip("members", F.element_at("levels", 1).alias("leaf")), lambda x: F.struct(
            x["members"]["lo"].alias("lo"), F.least(x["members"]["lo"] + wide, F.col("size")).alias("hi"), x["members"]["held"].alias("held"), x["leaf"].alias("leaf"),
            F.concat(_path(x["members"]["lo"], arity, height), F.col("beyond")).alias("path")))
        upper = attached.select("part", "top", F.explode(each).alias("x")).select("part", "x.*", "top")
    return upper.drop("lo", "hi")


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", part: str = "lang", presented: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """Per row: its id, ``part``, ``leaf``, ``subroot``, ``root``, ``path`` and ``presented`` (a leaf's digest).

    Leaves of a part ascend by id (null first), rows of one id by their digests; parts ascend by their UTF-8
    bytes, null first. ``presented`` has other values for some fields, as a copy of the dataset would show them:
    its digest is that of the row with those, and folds to the root only if nothing differs (``verified``).
    Equal rows are leaves of their own. Null and empty texts, very long ones and null ids are leaves as any
    other; an empty table has no rows. Other columns are not read, whatever their names.
    """
    values = {f: rows[f] for f in fields}
    leaf = digest([values[f] for f in fields])
    shown = digest([(presented or {}).get(f, values[f]) for f in fields])
    differs = F.lit(False)
    for f, other in (presented or {}).items():
        differs = differs | ~values[f].cast("string").eqNullSafe(other.cast("string"))
    named = F.coalesce(F.concat(F.lit("="), rows[part].cast("string")), F.lit("-"))  # "-" is before "=": null comes first
    each = saved(rows.select(named.alias("part"), rows[id_col].alias("id"), leaf.alias("digest"), F.when(differs, shown).alias("shown"), F.monotonically_increasing_id().alias("row")), "leaves")
    placed = ranked(each, "part", F.col("id").asc_nulls_first(), F.col("digest"), F.col("row"))
    forget(each)
    leaves = placed.select("part", "rank", "size", "digest", F.struct("id", "shown").alias("held"))

    def parts_tree(subroots: DataFrame) -> DataFrame:
        every = subroots.select(F.lit("all").alias("part"), F.col("part").alias("name"), "digest")
        top = ranked(saved(every, "subroots"), "part", F.col("name")).select("part", "rank", "size", "digest", F.struct("name").alias("held"))
        end = lambda roots: roots.select("part", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))
        found = _tree(top, end, arity, height)
        return found.select(F.col("held.name").alias("part"), "path", F.struct(F.col("leaf").alias("subroot"), F.col("top").alias("root")).alias("top"))

    found = _tree(leaves, parts_tree, arity, height)
    return found.select(
        F.col("held.id").alias(id_col), F.when(F.col("part") != "-", F.substring("part", 2, 2147483647)).alias("part"), "leaf", "top.subroot", "top.root", "path", F.coalesce("held.shown", "leaf").alias("presented")
    )


def verified(found: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with ``folded_root``, which the presented leaf gives, and whether that is the root."""
    return found.withColumn("folded_root", folded(F.col("presented"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
