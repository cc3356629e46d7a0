"""The vantage-point tree: exact links, fewer comparisons than all pairs, and real work in the shards of a corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import simhash


def shard(n, seed, clusters):
    """Fingerprints that agree in 13 bits, a third of them in one cluster."""
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 1 << 63, n, dtype=np.uint64) & ~np.uint64((1 << 13) - 1)
    if clusters:
        for i in range(n // 3):
            for bit in rng.integers(13, 64, 3):
                fp[i] = fp[max(i - 1, 0)] ^ np.uint64(1 << int(bit)) if bit % 3 else fp[i]
    return np.unique(fp)


def parts(size, edges):
    forest = simhash._Forest(size)
    forest.join(iter(edges))
    return [forest.root(i) for i in range(size)]


@pytest.mark.parametrize("clusters", [False, True])
@pytest.mark.parametrize("n, share", [(60, 0.85), (1000, 0.5), (4000, 0.55)])
def test_links_are_those_of_all_pairs_with_fewer_comparisons(n, share, clusters):
    fp = shard(n, n, clusters)
    forest = simhash._Forest(len(fp))
    simhash.link_within(fp, np.arange(len(fp)), 4, forest)
    near = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    got, want = parts(len(fp), forest.edges), parts(len(fp), near.tolist())
    assert len({*zip(got, want, strict=True)}) == len(set(got)) == len(set(want))
    assert forest.compared < share * len(fp) * (len(fp) - 1) / 2


def test_shards_of_a_corpus_reach_the_tree(spark):
    """At sf0.1 shards are small; those of many documents are over the leaf size and are split by a vantage point."""
    assert simhash.LEAF <= 16
    prints = spark.range(120_000).select(F.xxhash64("id").alias("fp"))
    shift, bits = simhash._shards(4)[0]
    sizes = prints.groupBy(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)).alias("v")).count()
    assert sizes.where(F.col("count") > simhash.LEAF).count() > 0.3 * sizes.count()
