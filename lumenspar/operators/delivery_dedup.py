"""Exactly one copy of messages that were delivered at least once.

Identifiers are encoded exactly as (shard, bucket, bit): a record offset within its topic, a producer's sequence number
within (topic, producer, epoch). Both are dense counters already, so the shard is the dictionary's entry and the counter is
the code; an identifier that isn't a non-negative number gets a shard of its own. Seen codes are kept in containers of
32768 bits, one row per (shard, bucket): the sorted list of its bits while they are few, a bitmap beyond that.

A batch goes through four steps. Of each code the first arrival is selected (a delivery with a whole payload before others,
then the smallest delivery_id). Codes are tested against the seen-bitmaps. Exact links come next: a pair of identifiers of
one delivery whose first arrivals differ links those two arrivals; only such links, which are few, are contracted. A first
arrival that is the smallest of its links and touches no seen code is kept. Last, the new codes are united with the
buckets they fall into, and a rename makes bitmaps and ledger current at once.

A whole table (`duplicates`) is worked as two batches, whole payloads first: so no later batch brings a better copy of a
message, and only deliveries with one identifier (a broken payload names no producer) follow, which link nothing. Batches in
order of arrival give other rows where a later one brings the first whole copy of a message, a smaller delivery_id or a
link between messages kept before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspar.session import cut, drop_since, mark, scratch
from lumenspar.sources.versions import VersionedGroups

BITS = 32768
SPARSE = 2048  # a list of more bits takes more room than a bitmap


def _code(prefix: list[Column], number: Column) -> Column:
    """(shard, bucket, bit) of an identifier: dense if it is a number, else a shard of its own."""
    n = F.when(number.rlike(r"^(0|[1-9][0-9]{0,17})$"), number.cast("bigint"))
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)  # noqa: E731  # lengths keep joined parts apart
    shard = F.concat_ws("/", *(part(c.cast("string")) for c in prefix))
    return F.struct(F.when(n.isNotNull(), shard).otherwise(F.concat_ws("/", shard, part(number))).alias("shard"), F.coalesce(F.expr("0L") + (n - F.pmod(n, F.lit(BITS))) / BITS, F.lit(0)).cast("bigint").alias("bucket"), F.coalesce(F.pmod(n, F.lit(BITS)), F.lit(0)).cast("int").alias("bit"))


def identifiers(deliveries: DataFrame, delivery_id: str = "delivery_id", topic: str = "topic", offset: str = "rec_offset", payload: str = "payload") -> DataFrame:
    """(delivery_id, whole, a, b): a = the code of (topic, offset), b = that of (topic, producer, epoch, pseq).

    whole: the payload is a whole JSON object. b is null unless it is and names all three. Nulls give no identifier.
    """
    j = F.get_json_object
    trimmed = F.regexp_replace(F.col(payload), r"^\s+|\s+$", "")
    variant = F.try_parse_json(trimmed)
    whole = F.coalesce(trimmed.startswith("{") & trimmed.endswith("}") & variant.isNotNull(), F.lit(False))
    text = lambda f: F.try_variant_get(variant, f"$.{f}", "string")
    a = F.when(F.col(topic).isNotNull() & F.col(offset).isNotNull(), _code([F.lit("offset"), F.col(topic)], F.col(offset).cast("string")))
    d = deliveries.select(F.col(delivery_id).alias("delivery_id"), F.col(topic).alias("topic"), a.alias("a"), whole.alias("whole"), F.when(whole, text("producer")).alias("producer"), F.when(whole, text("epoch")).alias("epoch"), F.when(whole, text("pseq")).alias("pseq"))
    b = F.when(F.col("topic").isNotNull() & F.col("producer").isNotNull() & F.col("epoch").isNotNull() & F.col("pseq").isNotNull(), _code([F.lit("producer"), F.col("topic"), F.col("producer"), F.col("epoch")], F.col("pseq")))
    return d.select("delivery_id", "whole", "a", b.alias("b"))


def _components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node linked to node, of links (u, v) between numbers.

    Alternating large-star and small-star contractions, each two pre-aggregated shuffles of the links, until nothing
    changes; the links shrink to stars in O(log^2) rounds.
    """
    e = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before and now[0]:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


CODE = ["shard", "bucket", "bit"]


def _known() -> Column:
    """True if `bit` is in the container (bits, bitmap) of its bucket."""
    byte = F.expr("cast(conv(hex(substring(bitmap, cast(bit / 8 as int) + 1, 1)), 16, 10) as int)")
    return F.coalesce(F.array_contains("bits", F.col("bit")), F.lit(False)) | (F.coalesce(byte, F.lit(0)).bitwiseAND(F.expr("shiftleft(1, bit % 8)")) > 0)


def first_arrivals(ids: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(shard, bucket, bit, first, known): of each code the arrival to prefer, and whether the code was seen before."""
    one = ids.select("delivery_id", "whole", F.explode(F.array_compact(F.array("a", "b"))).alias("i")).select("delivery_id", "whole", "i.*")
    first = one.groupBy(*CODE).agg(F.coalesce(F.min(F.when(F.col("whole"), F.col("delivery_id"))), F.min("delivery_id")).alias("first"))
    if seen is None:
        return first.withColumn("known", F.lit(False))
    return first.join(seen, ["shard", "bucket"], "left").select(*CODE, "first", _known().alias("known"))


def select_new(ids: DataFrame, first: DataFrame) -> DataFrame:
    """(kept): the delivery to keep of each message none of whose codes was seen, of `ids` and their first_arrivals.

    Deliveries without any identifier are messages of their own.
    """
    code = lambda side: F.struct(*(F.col(c) for c in CODE)).alias(side)
    pairs = ids.where("a is not null and b is not null").select("a", "b").distinct()
    links = pairs.join(first.select(code("a"), F.col("first").alias("u")), "a").join(first.select(code("b"), F.col("first").alias("v")), "b").where("u <> v").select("u", "v").distinct()
    roots = _components(links)
    messages = first.join(roots.withColumnRenamed("node", "first"), "first", "left").groupBy(F.coalesce("root", "first").alias("kept")).agg(F.max("known").alias("known"))
    return messages.where("not known").select("kept").unionByName(ids.where("a is null and b is null").select(F.col("delivery_id").alias("kept")).distinct())


def unite(first: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(shard, bucket, bits, bitmap): the codes of a batch united with the containers of `seen`."""
    new = first.groupBy("shard", "bucket").agg(F.collect_set("bit").alias("bits")).withColumn("bitmap", F.lit(None).cast("binary"))  # at most 32768 numbers
    if seen is not None:
        new = new.unionByName(seen).groupBy("shard", "bucket").agg(F.array_distinct(F.flatten(F.collect_list("bits"))).alias("bits"), F.first("bitmap", ignorenulls=True).alias("bitmap"))
    few = F.col("bitmap").isNull() & (F.size("bits") <= SPARSE)
    listed = new.where(few).select("shard", "bucket", F.array_sort("bits").alias("bits"), "bitmap")
    dense = new.where(~few)
    maps = dense.select("shard", "bucket", F.explode("bits").alias("bit")).groupBy("shard", "bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    maps = maps.unionByName(dense.where("bitmap is not null").select("shard", "bucket", "bitmap")).groupBy("shard", "bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    return listed.unionByName(maps.select("shard", "bucket", F.lit(None).cast("array<int>").alias("bits"), "bitmap"))


STATE = "shard string, bucket bigint, bits array<int>, bitmap binary"


class SeenBitmaps(VersionedGroups):
    """Seen-bitmaps below a folder, a row per (shard, bucket), replaced group by group under a ledger of batches."""

    def process(self, deliveries: DataFrame, batch: str, out: str, **columns: str) -> bool:
        """Writes (delivery_id) of the deliveries to keep of a batch to `out` and unites its codes; False, with nothing
        read or written, if the batch was done before."""
        if batch in self.manifest()["done"]:
            return False
        at = mark()
        ids = cut(identifiers(deliveries, **columns), "ids")
        self.process_ids(ids, batch, out)
        drop_since(at)
        return True

    def process_ids(self, ids: DataFrame, batch: str, out: str) -> bool:
        """process() of deliveries whose identifiers are encoded already."""
        now = self.manifest()
        if batch in now["done"]:
            return False
        codes = cut(first_arrivals(ids), "codes")
        touched = self.touched(codes, "shard", "bucket")
        seen = self.read(now, touched, STATE)
        if seen is not None:
            codes = cut(codes.drop("known").join(seen, ["shard", "bucket"], "left").select(*CODE, "first", _known().alias("known")), "codes")
        select_new(ids, codes).select(F.col("kept").alias("delivery_id")).write.mode("overwrite").parquet(out)
        self.replace(now, touched, cut(unite(codes, seen), "united"), ("shard", "bucket"), batch)
        return True


def duplicates(deliveries: DataFrame, **columns: str) -> DataFrame:
    """(delivery_id) of every delivery that isn't the one kept: of each message the smallest with a whole payload, or the
    smallest of all if none is whole.

    Null payloads, offsets and topics give no identifier from them; rows without a delivery_id are ignored; repeated
    delivery ids are one delivery if they agree. An empty table gives an empty result.
    """
    spark = deliveries.sparkSession
    ids = cut(identifiers(deliveries, **columns).where("delivery_id is not null"), "ids")  # payloads are parsed once
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))  # both batches touch all of them: as many as there are tasks
    bitmaps, kept = SeenBitmaps(spark, scratch(spark, "seen"), groups), []
    for name, part in (("whole", ids.where("whole")), ("broken", ids.where("not whole"))):
        kept.append(scratch(spark, "kept"))
        bitmaps.process_ids(part, name, kept[-1])
    return ids.select("delivery_id").distinct().join(spark.read.schema("delivery_id bigint").parquet(*kept), "delivery_id", "left_anti")
