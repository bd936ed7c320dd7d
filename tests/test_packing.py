import random

import pytest

from tidewell.operators import ingest as I


@pytest.mark.parametrize("most", [1, 5])
def test_batches_go_on_over_partitions_as_one_fold(spark, most):
    rng, data = random.Random(4), []
    for source, n in (("a", 3), ("b", 2900), ("c", 1), ("d", 700), (None, 40)):
        data = data + [(source, i, len(data) + i, rng.choice([1, 1, 5, 90, 300, 900, 2500])) for i in range(n)]
    df = spark.createDataFrame([(s, p, m, "x" * 4 * t) for s, p, m, t in data], "source_id string, pos long, msg_id long, text string").repartition(5)
    want, batch, used, n = {}, 0, 0, 0
    for s, p, m, t in data:
        if p == 0:
            batch, used, n = 0, 0, 0
        elif used + t > 2000 or n >= most:
            batch, used, n = batch + 1, 0, 0
        used, n = used + t, n + 1
        want[m] = (s, batch, t)
    for parts in ("4", "300"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {r.msg_id: (r.source_id, r.batch_no, r.tokens) for r in I.packed_batches(df, most=most).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([("a", None, 1, "x"), ("a", 1, 2, None)], "source_id string, pos long, msg_id long, text string")
    assert I.packed_batches(df).collect() == []
