"""Sources mixed to target weights by systematic sampling.

Every document has an expected number of copies: its source's target tokens over its source's tokens. Within a source the
expected copies are summed up along an order, one random offset is added, and a document is emitted once for each integer
its stretch of the sum crosses. So a source's documents and tokens come out within one document of what was asked.

The prefix sum is two-level: documents fall into blocks by hash (blocks of about `block_rows`, so a hot source has many),
are summed inside a block ordered by length (which spreads long and short documents evenly over the sample), and blocks
are offset by the sums of the blocks before them. Only one row per block crosses between blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.session import cut

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source"), folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_multi_50k") -> DataFrame:
    """(keep..., n_tokens): tokens of each whole text under a public byte-level BPE; null and empty texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (Path(folder) / f"{vocabulary}.tiktoken").open("rb"))}
        enc = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("x")).mapInArrow(run, f"{schema}, n_tokens bigint")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, want_tokens, copies) of each target source.

    copies is the expected number of copies of each of its documents. Shares of sources without tokens are spread over
    the others in proportion. total_tokens defaults to the largest total at which no source needs more than its
    max_repeats; a larger total caps the sources that run out, and the rest then fall short of the total, not of their
    shares of it. Targets with a null source, share or repeats are ignored; a repeated source counts once.
    """
    t = targets.where("source is not null and target_share > 0 and max_repeats is not null").dropDuplicates(["source"])
    s = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    j = F.broadcast(t).join(s, "source", "left").fillna(0, ["docs", "tokens"])  # targets are configuration: one row per source
    live = F.when(F.col("tokens") > 0, F.col("target_share"))
    every = Window.partitionBy(F.lit(0))  # as many rows as there are target sources
    j = j.withColumn("share", live / F.sum(live).over(every))
    most = F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(every)
    j = j.withColumn("total", F.lit(total_tokens).cast("double") if total_tokens is not None else most)
    return j.select("source", "target_share", "max_repeats", "docs", "tokens", (F.col("share") * F.col("total")).alias("want_tokens"), F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("share") * F.col("total") / F.col("tokens"))).otherwise(0.0).alias("copies"))


def mix(sizes: DataFrame, plan: DataFrame, doc_id: str = "doc_id", block_rows: int = 50_000, seed: int = 11) -> DataFrame:
    """(doc_id, source, n_tokens, copies): documents with the number of times each is used, at least once.

    sizes has doc_id, source and n_tokens; documents of no planned source, with a null source or without tokens aren't
    used. The result depends on seed and the documents alone, not on how they are partitioned.
    """
    p = F.broadcast(plan.where("copies > 0").select("source", F.col("copies").alias("each"), F.greatest(F.lit(1), F.ceil(F.col("docs") / block_rows)).alias("blocks")))
    h = F.xxhash64(F.col(doc_id), F.lit(seed))
    d = sizes.where("n_tokens > 0").join(p, "source").withColumn("block", F.pmod(h, F.col("blocks"))).withColumn("h", h)
    sums = d.groupBy("source", "block").agg((F.count("*") * F.first("each")).alias("sum"))
    w = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    u = (F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    before = sums.select("source", "block", (F.coalesce(F.sum("sum").over(w), F.lit(0.0)) + u).alias("base"))
    rank = F.row_number().over(Window.partitionBy("source", "block").orderBy("n_tokens", "h", doc_id))
    x = d.join(before, ["source", "block"]).withColumn("r", rank)
    eps = 1e-9
    copies = F.floor(F.col("base") + F.col("each") * F.col("r") + eps) - F.floor(F.col("base") + F.col("each") * (F.col("r") - 1) + eps)
    return x.select(doc_id, "source", "n_tokens", copies.cast("bigint").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per target source: target and reached share of the mix's tokens, documents used, most repeats of one."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("docs_used"), F.max("copies").alias("most_repeats"))
    j = plan.join(got, "source", "left").fillna(0, ["mix_tokens", "docs_used", "most_repeats"])
    return j.select("source", "target_share", "max_repeats", "tokens", "mix_tokens", "docs_used", "most_repeats", (F.col("mix_tokens") / F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))).alias("share"))


def emit(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each used document's row, once per copy, with `copy` from 1."""
    return docs.join(mixed.select(doc_id, "copies"), doc_id).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


def measured(docs: DataFrame, **options) -> DataFrame:
    """token_counts written once, since totals, block sums and the sample all read it."""
    return cut(token_counts(docs, **options))
