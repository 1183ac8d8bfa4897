"""Long and hostile texts: nothing may recurse with the text, nor take time that grows faster than it."""

import random
import time

import pytest

from cuetide.llm import pii

ROW = "doc_id long, text string"


def _one(spark, text):
    frame = spark.createDataFrame([(1, text)], ROW)
    return pii.report(frame).first(), pii.redact(frame).first().text


def test_address_of_many_labels(spark):
    row, text = _one(spark, "to a@" + "b." * 100_000 + "c now")
    assert row.n_email == 1 and text == "to [EMAIL] now"


@pytest.mark.parametrize("unit", ["1.", "Mr Max Miller ", "+1 (", "a@b.c ", "1234 ", "(555) 123-4567 "])
def test_repeated_units(spark, unit):
    from test_formats_and_filters import base_spans

    text = unit * (40_000 // len(unit))
    row, _ = _one(spark, text)
    want = base_spans(text)
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [want.count(k + ":") for k in ("email", "ip", "card", "phone")]


def test_tokens_take_time_in_proportion(spark):
    rnd = random.Random(1)
    text = " ".join(f"a1b2c3d{rnd.randrange(10_000):04}" for _ in range(85_000))
    _one(spark, text[:1000])
    began = time.monotonic()
    _one(spark, text)
    assert len(text) > 1_000_000 and time.monotonic() - began < 120


def test_added_spans_keep_clear_of_each_other(spark):
    rows = [(1, 'phone: (555) 123-4567abcd0ef9 key = "abcd1234efgh5678"'), (2, "Dr Anna Smith 555-123-4567 a1b2c3d4@x.org Mr J")] * 2
    for row in pii.report(spark.createDataFrame(rows, ROW)).collect():
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",") if s and not s.startswith(("email", "ip", "card", "phone:")))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_many_spans_are_cut_at_their_places(spark):
    parts = [f"word{i} u{i}@x.org {'é😀' * (i % 3)} +1 (555) 123-{i:04}, " for i in range(300)]
    _, text = _one(spark, "".join(parts))
    assert text == "".join(f"word{i} [EMAIL] {'é😀' * (i % 3)} [PHONE], " for i in range(300))


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([("a@b.c", 1, "x", "y", None), (None, 2, "x", "y", 3.0)], "text string, pii int, base string, more string, _pii double")
    assert [tuple(r) for r in pii.redact(rows).collect()] == [("[EMAIL]", 1, "x", "y", None), (None, 2, "x", "y", 3.0)]
    assert pii.redact(rows.limit(0)).count() == 0
