"""What is stored in the shared folder, and how it goes."""

import uuid

from pyspark.sql import functions as F

from cuetide import session


def test_stored_tables_go(spark):
    kept = session.stored(spark.range(3).toDF("x"), "kept")
    with session.temporary_tables(spark):
        gone = session.stored(spark.range(5).toDF("x"), "gone")
        assert gone.count() == 5 and session.path_exists(spark, gone._cuetide_path)
    assert not session.path_exists(spark, gone._cuetide_path) and kept.count() == 3
    session.let_go(kept)
    assert not session.path_exists(spark, kept._cuetide_path)
    session.let_go(spark.range(1))  # what was not stored is left alone


def test_upserts_keep_the_last_row_of_a_key(spark):
    from cuetide.streaming import upserts

    target = session.keep_folder(spark, f"{session.shared_dir(spark)}/cuetide/upserts-{uuid.uuid4().hex}")
    write = upserts.upsert_batch(target, ["k"], ["seq"], buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, seq long, v string")
    assert upserts.read(spark, target, rows().schema).count() == 0
    write(rows((1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")), 0)
    write(rows((2, 5, "y"), (1, 2, "late"), (9, 1, "z"), (None, 1, "n")), 1)
    for epoch in (2, 3):  # a batch that runs again changes nothing
        write(rows((3, 1, "w")), epoch)
    write(rows().where(F.lit(False)), 4)
    got = sorted((r.k or 0, r.seq, r.v) for r in upserts.read(spark, target).collect())
    assert got == [(0, 1, "n"), (1, 3, "c"), (2, 5, "y"), (3, 1, "w"), (9, 1, "z")]


def test_upserts_grow_and_can_be_read_meanwhile(spark):
    from cuetide.streaming import upserts

    target = session.keep_folder(spark, f"{session.shared_dir(spark)}/cuetide/growing-{uuid.uuid4().hex}")
    write = upserts.upsert_batch(target, ["k"], ["seq"], buckets=1, bucket_rows=100)
    want: dict[int, int] = {}
    before = None
    for epoch in range(4):
        fresh = {k: epoch for k in range(epoch * 80, epoch * 80 + 150)}
        write(spark.createDataFrame(list(fresh.items()), "k long, seq long"), epoch)
        if before is not None:  # made before this batch, read after it
            assert {r.k: r.seq for r in before.collect()} == want
        want |= fresh
        before = upserts.read(spark, target)
        assert {r.k: r.seq for r in before.collect()} == want
    versions = upserts._versions(spark, target)
    assert len(versions) == 2 and upserts._list(spark, target, versions[-1])[0].buckets == 4
    # Few keys touch few buckets; the others stay where they are.
    paths = {r.path for r in upserts._list(spark, target, versions[-1])}
    write(spark.createDataFrame([(5, 99)], "k long, seq long"), 9)
    assert len(paths - {r.path for r in upserts._list(spark, target, upserts._versions(spark, target)[-1])}) == 1
