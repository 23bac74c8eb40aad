import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.functions import display, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("around", [" ", " ", "\u001c", "　", " \t\r\n", "\u0085 "])
def test_strip_is_unicode_aware(spark, around):
    assert one(spark, text.strip(F.lit(f"{around}a b{around}"))) == "a b"
    assert one(spark, text.is_blank(F.lit(around)))


def test_strip_set_is_what_python_strips():
    assert sorted(text.WHITESPACE) == [chr(n) for n in range(0x110000) if chr(n).isspace()]


def test_preview_always_ends_in_dots(spark):
    assert one(spark, display.source_preview(F.lit("short"))) == "short..."
    assert one(spark, display.source_preview(F.lit("x" * 400))) == "x" * 300 + "..."
    assert one(spark, display.query_preview(F.lit("q" * 51))) == "q" * 50 + "..."


@pytest.mark.parametrize(
    "stamp, shown",
    [("2024-01-01T00:00:05", "2024-01-01T00:00:05+00:00"), ("2024-01-01T00:00:05.25", "2024-01-01T00:00:05.250000+00:00")],
)
def test_iso_timestamp(spark, stamp, shown):
    value = F.lit(datetime.datetime.fromisoformat(stamp + "+00:00"))
    assert one(spark, text.iso_timestamp(value)) == shown
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert one(spark, text.iso_timestamp(value)) == shown
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_elapsed_is_truncated(spark):
    a, b = F.timestamp_micros(F.lit(1_000_000)), F.timestamp_micros(F.lit(2_749_999))
    assert one(spark, text.elapsed_ms(a, b)) == 1749


def test_display_labels(spark):
    assert one(spark, display.answer_caption(F.lit(1749), F.lit(312), F.lit("m"))) == "Latency: 1749ms | Tokens: 312 | Model: m"
    assert one(spark, display.chunk_label(F.lit(31))) == "31 chunks"
    assert one(spark, display.source_heading(F.lit(4), F.lit(0.91))) == "**Page 4** (similarity: 0.9100)"
    assert one(spark, display.latency_label(F.lit(12))) == "12ms"
    colours = [one(spark, display.status_colour(F.lit(s))) for s in ("completed", "failed", "processing")]
    assert colours == ["green", "orange", "orange"]


def expected_windows(body: str, size: int, overlap: int) -> list[str]:
    step = size - overlap
    count = 1 + max(0, (len(body) - max(overlap, 1)) // step)
    return [body[n * step : n * step + size] for n in range(count)]


@settings(max_examples=15, deadline=None)
@given(
    bodies=st.lists(st.text(alphabet="ab \né🙂 ", max_size=90), min_size=1, max_size=25),
    shape=st.sampled_from([(8, 2), (8, 0), (8, 7), (9, 5), (40, 10), (1, 0)]),
)
def test_windows_follow_the_closed_form(spark, bodies, shape):
    size, overlap = shape
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = rows.select("n", text.windows(F.col("body"), size, overlap).alias("w")).collect()
    for row in got:
        assert row["w"] == expected_windows(bodies[row["n"]], size, overlap)


@pytest.mark.parametrize("size, overlap", [(50, 50), (50, 60), (0, 0), (5, -1)])
def test_windows_reject_shapes_without_progress(size, overlap):
    with pytest.raises(ValueError):
        text.windows(F.lit("x"), size, overlap)


def test_long_text_is_cut_in_linear_time(spark):
    """Five million characters; a scan from the start for each window would not end here."""
    body = F.repeat(F.lit("abcdefghij"), 500_000)
    count = one(spark, F.size(text.windows(body, 2048, 200)))
    assert count == 1 + (5_000_000 - 200) // 1848


def test_cosine(spark):
    def vector(*xs):
        return F.array(*[F.lit(float(x)).cast("float") for x in xs])

    assert one(spark, vectors.cosine_similarity(vector(1, 0), vector(2, 0))) == 1.0
    assert one(spark, vectors.cosine_similarity(vector(1, 0), vector(0, 3))) == 0.0
    assert one(spark, vectors.cosine_similarity(vector(1, 0), vector(-1, 0))) == -1.0
    assert one(spark, vectors.cosine_distance(vector(1, 1), vector(1, 1))) == pytest.approx(0.0)
    assert one(spark, vectors.cosine_similarity(vector(0, 0), vector(1, 0))) is None
