"""Content digests and Merkle trees as Column expressions.

Leaves are SHA-256 of the UTF-8 member, nodes SHA-256 of the two raw digests,
and an odd node moves up unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_raw(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def canonical_members(members: Column) -> Column:
    """Distinct members in lexicographic order."""
    return F.array_sort(F.array_distinct(members))


def _up(nodes: Column) -> Column:
    """The next level of a tree."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    left = lambda k: F.element_at(nodes, (2 * k + 1).cast("int"))
    right = lambda k: F.element_at(nodes, (2 * k + 2).cast("int"))
    return F.transform(pairs, lambda k: F.when(2 * k + 1 < F.size(nodes), sha256_raw(F.concat(left(k), right(k)))).otherwise(left(k)))


def _heights(members: Column) -> Column:
    """1 to the tree's height; a tree of one node gets one step that changes nothing."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(members).cast("double"))).cast("int")))


def leaves(members: Column) -> Column:
    return F.transform(canonical_members(members), lambda m: sha256_raw(m.cast("binary")))


def fold(nodes: Column) -> Column:
    """The node above up to 1,024 nodes of one level, ten levels up; a level that is left over changes nothing."""
    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(10)), nodes, lambda level, _: F.when(F.size(level) > 1, _up(level)).otherwise(level)), 1)


def merkle_root(members: Column) -> Column:
    """Hex root over the distinct, sorted members; null for none."""
    root = F.aggregate(_heights(canonical_members(members)), leaves(members), lambda nodes, _: _up(nodes))
    return F.when(F.size(members) > 0, F.lower(F.hex(F.element_at(root, 1))))


def inclusion_proof(members: Column, member: Column) -> Column:
    """``[{sibling, position}]`` from the member's leaf up; levels where its node moves up unchanged give no step.  Null if it isn't a member."""
    ordered = canonical_members(members)
    levels = F.aggregate(_heights(ordered), F.array(leaves(members)), lambda done, _: F.concat(done, F.array(_up(F.element_at(done, -1)))))
    index = F.array_position(ordered, member) - 1

    def step(k: Column) -> Column:
        at = F.floor(index / F.pow(F.lit(2.0), k)).cast("int")
        other = at.bitwiseXOR(1)
        nodes = F.element_at(levels, (k + 1).cast("int"))
        position = F.when(other < at, "left").otherwise("right")
        return F.when(other < F.size(nodes), F.struct(F.lower(F.hex(F.element_at(nodes, (other + 1).cast("int")))).alias("sibling"), position.alias("position")))

    steps = F.transform(F.sequence(F.lit(0), F.size(levels) - 2), step)
    return F.when(index >= 0, F.filter(steps, lambda s: s.isNotNull()))


def inclusion_proofs(members: Column) -> Column:
    """``[{member, proof}]`` of all distinct members; the tree is hashed once."""
    ordered = canonical_members(members)
    levels = F.aggregate(_heights(ordered), F.array(leaves(members)), lambda done, _: F.concat(done, F.array(_up(F.element_at(done, -1)))))

    def proof(tree: Column, index: Column) -> Column:
        def step(nodes: Column, k: Column) -> Column:
            at = F.call_function("shiftright", index, k)
            other = at.bitwiseXOR(1)
            position = F.when(other < at, "left").otherwise("right")
            return F.when((other < F.size(nodes)) & (k < F.size(tree) - 1), F.struct(F.lower(F.hex(F.element_at(nodes, other + 1))).alias("sibling"), position.alias("position")))

        return F.array_compact(F.transform(tree, step))

    return F.element_at(F.transform(F.array(levels), lambda tree: F.transform(ordered, lambda m, i: F.struct(m.alias("member"), proof(tree, i).alias("proof")))), 1)


def verify_inclusion(member: Column, proof: Column, root: Column) -> Column:
    """Whether the proof leads from the member to the root; an unknown position fails."""

    def step(node: Column, s: Column) -> Column:
        sibling = F.unhex(s["sibling"])
        return F.when(s["position"] == "left", sha256_raw(F.concat(sibling, node))).when(s["position"] == "right", sha256_raw(F.concat(node, sibling)))

    return F.coalesce(F.lower(F.hex(F.aggregate(proof, sha256_raw(member.cast("binary")), step))) == F.lower(root), F.lit(False))


def cover_digest(tokens: Column) -> Column:
    """Identity of a cover: SHA-256 of its distinct sorted tokens, one after the other."""
    return F.sha2(F.array_join(canonical_members(tokens), ""), 256)


def region_digest(tokens: Column) -> Column:
    """Identity of a region: SHA-256 of its distinct sorted tokens, each behind a bar."""
    return F.sha2(F.array_join(F.transform(canonical_members(tokens), lambda t: F.concat(F.lit("|"), t)), ""), 256)


def short_id(identity: Column) -> Column:
    return F.substring(identity, 1, 16)
