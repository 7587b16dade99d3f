import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorset.config import MatchConfig, deep_clean, exact_and_near
from mirrorset.functions import bits, frames, media, paths, vectors
from mirrorset.operators import blocking as B
from mirrorset.operators import features as X
from mirrorset.operators import matching
from mirrorset.streaming import events


def one(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("p,lo,hi,d,want", [
    (1, 0, 0, 3600, 36), (1, 0, 0, 60, 0.6), (1, 5, 10, 60, 5), (1, 5, 10, 700, 7), (1, 5, 10, 3600, 10),
    (0, 0, 0, 60, 0), (0, 0, 15, 60, 15), (0, 8, 0, 60, 8), (0, 5, 15, 60, 15)])
def test_duration_tolerance(spark, p, lo, hi, d, want):
    cfg = MatchConfig(duration_percent=p, duration_min_s=lo, duration_max_s=hi)
    assert cfg.tolerance(d) == pytest.approx(want)
    assert one(spark, B.tolerance(F.lit(float(d)), cfg)) == pytest.approx(want)


@pytest.mark.parametrize("p,lo,hi", [(20, 0, 0), (1, 5, 10), (1, 5, 0), (10, 0, 30), (0, 3, 15), (5, 9, 4)])
def test_duration_bins_lose_no_pair(spark, p, lo, hi):
    cfg = MatchConfig(duration_percent=p, duration_min_s=lo, duration_max_s=hi)
    d = spark.range(0, 1500).select((F.col("id") * 2.5).alias("d")).withColumn("b", B.duration_bin("d", cfg))
    vals = [(r.d, r.b) for r in d.collect()]
    for i, (x, bx) in enumerate(vals):
        for y, by in vals[i:]:
            if y - x > cfg.tolerance(x):
                break
            if y - x <= min(cfg.tolerance(x), cfg.tolerance(y)):
                assert abs(bx - by) <= 1


def test_bit_limits():
    assert MatchConfig(percent=96).max_bits == 2 and MatchConfig(percent=95).max_bits == 3
    assert MatchConfig(percent=75).max_bits == 16
    assert MatchConfig(quorum_ratio=0.6).required_positions(5) == 3
    assert exact_and_near().percent == 98 and deep_clean().partial_audio


def quorum(spark, a, b, percent, ratio):
    cfg = MatchConfig(percent=percent, quorum_ratio=ratio, use_phash=True)
    df = spark.createDataFrame([(a, b)], "a_phashes array<bigint>, b_phashes array<bigint>")
    return matching.phash_verdict(df, cfg, len(a)).first()["phash_diff"]


def test_phash_quorum(spark):
    assert quorum(spark, [0, 0], [0, -1], 90, 1.0) is None
    assert quorum(spark, [-1, 7, 7, 7], [0, 7, 7, 7], 90, 0.6) == pytest.approx(0.25)
    off = (1 << 20) - 1
    assert quorum(spark, [0, 0, 0, 0, 0], [0, 0, off, off, off], 75, 0.6) is None
    assert quorum(spark, [0, 0, 0, 0, 0], [0, 0, off, off, off], 75, 0.4) is not None
    assert quorum(spark, [0, 0], [0, (1 << 16) - 1], 75, 1.0) == pytest.approx(0.125)


def test_combined_verdict(spark):
    schema = ("a_gray array<smallint>, b_gray array<smallint>, a_phashes array<bigint>, "
              "b_phashes array<bigint>, a_is_image boolean")
    cfg = MatchConfig(percent=96, combine_gray_and_phash=True)
    df = spark.createDataFrame([([7] * 64, [7] * 64, [0], [-1], False), ([0] * 64, [255] * 64, [7], [7], False),
                                ([0] * 64, [255] * 64, [0], [-1], False)], schema)
    got = [(r.difference, r.flags) for r in matching.classic_verdict(df, cfg, 1, 64).collect()]
    assert got[0] == (0.0, 8) and got[1] == (0.0, 16) and got[2][0] is None


def test_masked_difference_without_pixels_is_null(spark):
    cfg = MatchConfig(percent=96, ignore_black=True)
    df = spark.createDataFrame([([0] * 64, [0] * 64), ([100] * 64, [101] * 64)],
                               "a_gray array<smallint>, b_gray array<smallint>")
    got = [r.gray_diff for r in matching.gray_verdict(df, cfg, 1, 64).collect()]
    assert got[0] is None and got[1] == pytest.approx(1 / 256)
    assert one(spark, frames.gray_diff_masked("a", "b", True, False), a=[0, 0], b=[0, 0]) is None


def test_quantize_and_cosine(spark):
    df = spark.createDataFrame([([2.0, -2.0, 0.0, 1.0, -1.0],)], "v array<float>")
    assert df.select(vectors.quantize_unit("v").alias("q")).first()["q"] == [127, -127, 0, 127, -127]
    df = spark.createDataFrame([([127, 0], [0, 127]), ([127, 127], [127, 127])], "a array<tinyint>, b array<tinyint>")
    assert [r[0] for r in df.select(vectors.int8_cosine("a", "b")).collect()] == [0.0, 1.0]


def test_phash_batch_matches_direct_transform(spark):
    rng = np.random.default_rng(3)
    gray = rng.integers(0, 256, size=(12, 1024))
    df = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(gray)], "id int, gray array<smallint>")
    got = {r.id: r.h for r in df.select("id", frames.phash_batch()("gray").alias("h")).collect()}
    n = np.arange(32)
    wave = np.array([np.cos((2 * n + 1) * k * np.pi / 64) for k in range(1, 9)])
    for i, g in enumerate(gray):
        coef = (wave @ g.reshape(32, 32) @ wave.T).ravel()
        mid = np.sort(coef)[31:33].mean()
        want = sum(1 << j for j in range(64) if coef[j] > mid)
        assert bin((got[i] % 2 ** 64) ^ want).count("1") <= 2


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame([(list(range(64)),)], "g array<smallint>")
    once = df.select(frames.flip_rows("g", 8).alias("g"))
    assert once.first()["g"][:8] == [7, 6, 5, 4, 3, 2, 1, 0]
    assert once.select(frames.flip_rows("g", 8).alias("g")).first()["g"] == list(range(64))


def test_rgb_darkness(spark):
    assert one(spark, frames.is_bright_rgb("g"), g=[0, 0, 200] * 5) is True
    assert one(spark, frames.is_bright_rgb("g"), g=[0, 0, 0] * 5) is False


def test_paths(spark):
    def p(expr, path):
        return one(spark, expr(F.col("p")), p=path)

    assert p(lambda c: paths.wildcard_match(c, "*.MP4"), "/a/b.mp4")
    assert not p(lambda c: paths.wildcard_match(c, "b"), "/a/b")
    assert p(lambda c: paths.in_scope(c, ["/a/"]), "/a/b") and not p(lambda c: paths.in_scope(c, ["/a"]), "/ab")
    assert not p(lambda c: paths.in_scope(c, ["/a"]), "/a/.hidden")
    assert p(lambda c: paths.protected(c, ["/keep"]), "/keep/sub/b")
    assert not p(lambda c: paths.protected(c, ["/keep"]), "/keep-other/c")
    assert not p(lambda c: paths.protected(c, ["/keep"]), "/keep/../a.mp4")
    assert p(lambda c: paths.relocate(c, "/a", "/z"), "/ab/c") == "/ab/c"
    assert p(lambda c: paths.folder_depth(c), "/a/b/c") == 3


def test_texts(spark):
    assert [one(spark, media.score_text(F.lit(x))) for x in (99.949, 99.95, 100.0)] == ["99.9", "100.0", "100.0"]
    assert [one(spark, media.bytes_text(F.lit(x))) for x in (0, 1, 1280, 5 << 20)] == ["0 B", "1.0 B", "1.3 KB", "5.0 MB"]
    assert one(spark, media.duration_delta_text(F.lit(-3725.0))) == "-1h02m05s"
    assert one(spark, media.percent_text(F.lit(99.6), F.lit(100.0))) == "="


def test_message_template(spark):
    assert one(spark, events.message_template(F.lit("took 12 ms for 'a 1' and \"b\""))) == "took # ms for '*' and \"*\""
    assert one(spark, events.message_template(F.lit("bad 'open 12"))) == "bad '"


def test_audio_words(spark):
    assert len(X.chroma_pairs()) == 32
    v = [0.0] * 12
    v[0] = 1.0
    df = spark.createDataFrame([(v,)], "c array<double>")
    want = sum(1 << i for i, (a, b) in enumerate(X.chroma_pairs()) if a == 0)
    assert df.select(X.chroma_word("c").alias("w")).first()["w"] == want
    assert one(spark, X.chroma_normalize("c"), c=[0.0] * 12) == [0.0] * 12
    assert one(spark, bits.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 64


def test_chunked_windows_cross_borders(spark):
    df = spark.range(0, 50).select(F.lit(1).alias("file_id"), F.col("id").alias("frame"), F.array(
        *[F.col("id").cast("double")] * 12).alias("chroma"))
    import mirrorset.operators.features as mod

    whole = {r.frame: r.chroma for r in X.chroma_smooth(df).collect()}
    old, mod.in_chunks.__defaults__ = mod.in_chunks.__defaults__, (7,)
    try:
        cut = {r.frame: r.chroma for r in X.chroma_smooth(df).collect()}
    finally:
        mod.in_chunks.__defaults__ = old
    assert whole == cut and sorted(whole) == list(range(4, 50))


def test_exif_timestamp(spark):
    df = spark.createDataFrame([("2024:05:06 07:08:09",), (" 2024:05:06 07:08:09 ",), ("0000:00:00",), (None,)], "t string")
    got = [str(r.x) for r in df.select(media.exif_timestamp("t").alias("x")).collect()]
    assert got == ["2024-05-06 07:08:09"] * 2 + ["None"] * 2


def test_where_expression_reads_words_inside_strings(spark):
    from mirrorset.operators.selection import where_expression

    df = spark.createDataFrame([(1, "select from"), (1, "b")], "group_id bigint, path string")
    assert [r.path for r in where_expression(df, "path = 'select from'").collect()] == ["select from"]
    with pytest.raises(ValueError):
        where_expression(df, "path IN (SELECT 'b')")


def test_audio_fingerprint_carries_few_counts(spark):
    """Majority of each second's words by brute force; the 32 counts travel in eleven numbers, not in one each."""
    rng = np.random.default_rng(5)
    rows = [(f, i, int(w)) for f in range(3) for i, w in enumerate(rng.integers(0, 1 << 32, 40 + f))]
    df = spark.createDataFrame(rows, "file_id bigint, frame int, word bigint")
    made = X.audio_fingerprint(df)
    assert made._jdf.queryExecution().executedPlan().toString().count("partial_") <= 12
    got = {(r["file_id"], r["sec"]): r["block"] for r in made.collect()}
    seconds = {}
    for f, i, w in rows:
        seconds.setdefault((f, int(i * X.FRAME_HOP / X.SAMPLE_RATE)), []).append(w)
    assert got == {k: sum(1 << b for b in range(32) if sum(w >> b & 1 for w in ws) >= len(ws) // 2 + 1) for k, ws in seconds.items()}
