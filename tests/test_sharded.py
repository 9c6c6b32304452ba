"""shard_assignment against a sequential fill, over many blocks."""

import random

from brindle.operators import mutation



def test_blocks_go_on_filling_the_open_shard(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, 0, 3, 20, 50, 99, 100, 101, 250, rng.randint(0, 60)]) for _ in range(400)]
    want, shard, at = [], 0, 0
    for i, n in enumerate(sizes):
        if at and at + n > 100:
            shard, at = shard + 1, 0
        want.append((i, shard, at))
        at += n
    rows = spark.createDataFrame(list(enumerate(sizes)), "row long, n_bytes int")
    for block in (1, 7, 64):
        assert sorted(map(tuple, mutation.sharded(rows, 100, block=block).collect())) == want, block
