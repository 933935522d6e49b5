"""Merkle fixity audit of WARC records over replicas.

Records are hashed; the hashes of one offset range of a file make a leaf node, 16
neighbouring nodes make the node above, up to one root for each file, and files go
on in the same way up to one root. Replicas compare roots; only below mismatching
nodes are children read, so an audit of equal replicas ends at the root and a
corrupt record is found in one step per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

RANGE_BITS = 16  # a leaf node holds the records that begin in 64 KiB
FANOUT_BITS = 4
FILE_RECORDS = 4096  # consecutive page ids in one WARC file
FOLD = 16  # different rows of one record that are put together at once, on average


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = FILE_RECORDS) -> DataFrame:
    """(file, record, payload): pages as WARC response records. Null urls and bodies are empty; a null id is file -1, record null."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    file = F.coalesce(F.floor(F.col(id_col) / per_file), F.lit(-1)).cast("long")
    return pages.select(file.alias("file"), F.col(id_col).alias("record"), F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("payload"))


def digests(rows: DataFrame) -> DataFrame:
    """(file, record, length, digest). Rows that repeat a record, as all without an id do, count as one record.

    Its digest doesn't depend on their order: equal rows are counted before they
    meet, and the different ones are folded by the leading digits of their digests,
    about 16 into one, so that no task gathers a record of very many rows."""
    each = rows.select("file", "record", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("digest"))
    each = cut(each.groupBy("file", "record", "digest").agg(F.sum("length").alias("length"), F.count("*").alias("times")))
    most = each.groupBy("file", "record").count().agg(F.max("count")).first()[0] or 0
    depth = 0
    while most > FOLD << (4 * depth):
        depth += 1
    one = F.when(F.col("times") == 1, F.col("digest")).otherwise(F.sha2(F.concat_ws(":", "digest", F.col("times").cast("string")).cast("binary"), 256))
    nodes = each.select("file", "record", "length", F.substring("digest", 1, depth).alias("part"), one.alias("digest"))
    together = F.when(F.count("*") == 1, F.min("digest")).otherwise(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), "").cast("binary"), 256))
    for digits in range(depth, -1, -1):
        nodes = nodes.groupBy("file", "record", F.substring("part", 1, digits).alias("part")).agg(F.sum("length").alias("length"), together.alias("digest"))
    return nodes.select("file", "record", "length", "digest")


def manifest(found: DataFrame) -> DataFrame:
    """found with offset: records follow one another in a file by record id. A file's size bounds the window."""
    w = Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn("offset", F.sum("length").over(w) - F.col("length"))


def _combined(*what: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*what))), lambda x: F.concat_ws(":", *[x[f"_{i}"].cast("string") for i in range(len(what))])), "|").cast("binary"), 256)


def leaves(found: DataFrame) -> DataFrame:
    """(file, node, digest): one node for each offset range of a file that has records."""
    return found.groupBy("file", F.shiftright("offset", RANGE_BITS).alias("node")).agg(_combined(F.col("offset").alias("_0"), F.col("length").alias("_1"), F.col("digest").alias("_2")).alias("digest"))


def _parent(level: int, range_levels: int) -> list[Column]:
    """The key of the node above a node of this level."""
    if level < range_levels:
        return [F.col("file"), F.shiftright("node", FANOUT_BITS).alias("node")]
    return [F.shiftright("file", FANOUT_BITS).alias("file"), F.lit(0).cast("long").alias("node")]


def tree(found: DataFrame, range_levels: int, file_levels: int) -> list[DataFrame]:
    """Node tables (file, node, digest) from the leaf nodes up to the root."""
    levels = [cut(leaves(found))]
    for level in range(range_levels + file_levels):
        above = levels[-1].select("*", F.struct(*_parent(level, range_levels)).alias("up"))
        levels.append(cut(above.groupBy("up.file", "up.node").agg(_combined(F.col("file").alias("_0"), F.col("node").alias("_1"), F.col("digest").alias("_2")).alias("digest"))))
    return levels


def _depth(spread: int, bits: int) -> int:
    return -(-max(1, spread).bit_length() // bits)


def audit(reference: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, record, offset, length, kind) of each record that differs, from record tables (file, record, payload).

    kind is changed, missing (from the replica) or extra (a record that the
    manifest doesn't name; its offset is null). Equal replicas, empty ones too,
    give no rows; their trees are not descended. Columns beside the three are not read."""
    ours = cut(manifest(digests(reference)))
    names = ours.select("file", "record", "offset")
    same = names["file"].eqNullSafe(F.col("r.file")) & names["record"].eqNullSafe(F.col("r.record"))
    theirs = cut(digests(replica).alias("r").join(names, same, "left").select("r.*", "offset"))
    extra = theirs.where("offset is null").select("file", "record", F.lit(None).cast("long").alias("offset"), "length", F.lit("extra").alias("kind"))
    placed = theirs.where("offset is not null")
    most = ours.agg(F.max("offset").alias("o"), F.max(F.abs(F.col("file"))).alias("f")).first()
    range_levels, file_levels = _depth((most["o"] or 0) >> RANGE_BITS, FANOUT_BITS), _depth(most["f"] or 0, FANOUT_BITS) + 1
    mine, other = tree(ours, range_levels, file_levels), tree(placed, range_levels, file_levels)

    def differing(level: int, above: DataFrame | None) -> DataFrame:
        a, b = mine[level], other[level]
        if above is not None:
            a, b = (x.withColumn("up", F.struct(*_parent(level, range_levels))).join(above.select(F.struct("file", "node").alias("up")), "up", "left_semi").drop("up") for x in (a, b))
        both = a.alias("a").join(b.alias("b"), ["file", "node"], "full_outer")
        return both.where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select("file", "node")

    bad = cut(differing(len(mine) - 1, None))
    for level in range(len(mine) - 2, -1, -1):
        if bad.isEmpty():
            break
        bad = cut(differing(level, bad))
    if bad.isEmpty():
        return extra
    inside = lambda x: x.withColumn("node", F.shiftright("offset", RANGE_BITS)).join(bad, ["file", "node"], "left_semi")
    a, b = inside(ours).alias("a"), inside(placed).select("file", "offset", "digest", "length").alias("b")
    both = a.join(b, ["file", "offset"], "left").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    kind = F.when(F.col("b.digest").isNull(), "missing").otherwise("changed")
    return both.select("file", "record", "offset", F.col("a.length").alias("length"), kind.alias("kind")).unionByName(extra)


def damaged(rows: DataFrame) -> DataFrame:
    """A replica with faults that follow from the record id's md5, for drills: 00 loses the record, 01 changes its last byte, 02 cuts its last 9 bytes."""
    tag = F.substring(F.md5(F.col("record").cast("string").cast("binary")), 1, 2)
    payload = F.when(tag == "01", F.concat(F.expr("substring(payload, 1, octet_length(payload) - 1)"), F.lit("!").cast("binary"))).when(tag == "02", F.expr("substring(payload, 1, octet_length(payload) - 9)")).otherwise(F.col("payload"))
    return rows.where((tag != "00") | tag.isNull()).withColumn("payload", payload)
