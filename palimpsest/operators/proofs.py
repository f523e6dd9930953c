"""Merkle commitments over ordered chunks: leaves, root, inclusion proofs, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..storage import checkpointed


def leaf(chunk: Column) -> Column:
    return F.sha2(chunk.cast("binary"), 256)


def parent(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def chunks(rows: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """(key, index from 0, chunk): a text cut into parts of `size` code points; an empty or null text is one empty chunk."""
    body = F.coalesce(F.col(text), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(body) / size).cast("int") - 1))
    return rows.select(key, F.posexplode(F.transform(starts, lambda i: F.substring(body, i * size + 1, F.lit(size)))).alias("index", "chunk")).select(key, F.col("index").cast("long").alias("index"), "chunk")


def levels(leaves: DataFrame, key: str, most: int = 62) -> DataFrame:
    """(key, index from 0, hash) leaves -> (key, level, index, hash, pad) of the whole tree.

    Leaves count as padded by the last one to a power of two: what would cover padding only isn't
    stored, but every row carries its level's hash of that, pad. Each level is one aggregation
    over pairs, written before the next, so a tree of any number of leaves is built without
    gathering them. Trees of more levels than `most` are an error.
    """
    # leaves are hashes of what may take long to work out, so they are written once
    leaves = checkpointed(leaves.select(key, F.col("index").cast("long"), "hash"))
    sized = leaves.groupBy(key).agg(F.max("index").alias("last"), F.max_by("hash", "index").alias("pad"))
    deep = checkpointed(sized.withColumn("depth", F.when(F.col("last") > 0, F.length(F.bin("last"))).otherwise(0)))
    top = deep.agg(F.max("depth")).first()[0] or 0
    if top > most:
        raise ValueError(f"a tree of {top} levels; {most} at most")
    level = checkpointed(leaves.join(deep.select(key, "depth", "pad"), key))
    out = level.withColumn("level", F.lit(0))
    for n in range(1, top + 1):
        pairs = level.filter(F.col("depth") >= n).groupBy(key, F.shiftright("index", 1).alias("index"), "depth", "pad").agg(F.min_by("hash", "index").alias("l"), F.max_by("hash", "index").alias("r"), F.count(F.lit(1)).alias("c"))
        both = parent(F.col("l"), F.when(F.col("c") == 2, F.col("r")).otherwise(F.col("pad")))
        level = checkpointed(pairs.select(key, "index", both.alias("hash"), "depth", parent(F.col("pad"), F.col("pad")).alias("pad")))
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out.select(key, "level", "index", "hash", "pad", "depth")


def roots(tree: DataFrame, key: str) -> DataFrame:
    return tree.filter("level = depth").select(key, F.col("hash").alias("root"), "depth")


def proofs(tree: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, index) targets -> (key, index, path): siblings from the leaf up, each with the side it stands on; a tree of one leaf has an empty path."""
    deep = tree.filter("level = 0").select(key, "depth").distinct()
    steps = targets.select(key, F.col("index").alias("target")).join(deep, key).select(key, "target", F.explode_outer(F.when(F.col("depth") > 0, F.sequence(F.lit(0), F.col("depth") - 1))).alias("level"))
    at = F.expr("shiftright(target, level)")
    steps = steps.withColumn("index", F.when(at % 2 == 0, at + 1).otherwise(at - 1)).withColumn("side", F.when(at % 2 == 0, "right").otherwise("left"))
    pads = tree.groupBy(key, "level").agg(F.first("pad").alias("pad"))
    joined = steps.join(tree.select(key, "level", "index", "hash"), [key, "level", "index"], "left").join(pads, [key, "level"], "left")
    step = F.when(F.col("level").isNotNull(), F.struct("level", "side", F.coalesce("hash", "pad").alias("hash")))
    return joined.groupBy(key, "target").agg(F.sort_array(F.collect_list(step)).alias("path")).withColumnRenamed("target", "index")


def recomputed(leaf_hash: Column, path: Column) -> Column:
    return F.aggregate(path, leaf_hash, lambda h, s: F.when(s["side"] == "right", parent(h, s["hash"])).otherwise(parent(s["hash"], h)))


def redacted_tiles(boxes: DataFrame, tile: str = "tile") -> DataFrame:
    """(page_id, tiles): the tiles that any box of a page touches, each once, in order."""
    return boxes.groupBy("page_id").agg(F.array_sort(F.collect_set(tile)).alias("tiles"))


def found_proof(json: Column) -> Column:
    """The root that a proof anywhere in JSON names, or null: the first object with a root of 64 hex digits."""
    return F.nullif(F.regexp_extract(json, r'"(?:merkleRoot|root)"\s*:\s*"([0-9a-f]{64})"', 1), F.lit(""))


# Signatures ---------------------------------------------------------------------------------------


def _pad(key: Column, with_byte: int) -> Column:
    """A key of 64 bytes at most, filled up with zeros, each byte xor with_byte."""
    digits = F.rpad(F.hex(key), 128, "0")
    each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseXOR(F.lit(with_byte))), 2, "0"))
    return F.unhex(F.array_join(each, ""))


def hmac(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 of a message under a key, both binary, in hex. Keys of more than 64 bytes count as their hashes."""
    key, message = key.cast("binary"), message.cast("binary")
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    return let(short, lambda k: F.sha2(F.concat(_pad(k, 0x5C), F.unhex(F.sha2(F.concat(_pad(k, 0x36), message), 256))), 256))


def signed(roots_: DataFrame, key: Column) -> DataFrame:
    """Adds signature: the root, which is hex, signed under a key."""
    return roots_.withColumn("signature", hmac(key, F.unhex("root")))


def genuine(root: Column, signature: Column, key: Column) -> Column:
    """Whether a signature is the root's own; false for a null or a root that isn't hex."""
    return F.coalesce(hmac(key, F.unhex(root)) == F.lower(signature), F.lit(False))
