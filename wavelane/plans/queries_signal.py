"""Queries on samples, spectra and mel bands."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import bands, spectral
from .grid import every_position
from .registry import SIGNAL, TRACKS, events_signal, load, query, r6, schedule_sql

W = "WITH "
PI = "3.141592653589793::DOUBLE"

RAW = "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem"


def raw(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), *[F.col(f"l_{c}").cast("double").alias(a) for c, a in (("quantity", "q"), ("extendedprice", "p"), ("discount", "d"), ("tax", "t"))])


@query(W + f"x AS ({RAW}) " + """SELECT k, n, round((CAST(q * 600 AS INTEGER) / 32768.0::DOUBLE)::FLOAT::DOUBLE, 6) + 0.0 AS i16, round((CAST(p * 40 AS INTEGER) / 8388608.0::DOUBLE)::FLOAT::DOUBLE, 6) + 0.0 AS i24,
round((CAST(p * 10000 AS INTEGER) / 2147483648.0::DOUBLE)::FLOAT::DOUBLE, 6) + 0.0 AS i32 FROM x""")
def pcm_decode(spark, sf_dir):
    """Integers of each depth as single precision."""
    x = raw(spark, sf_dir)
    take = lambda c, by: F.round(F.col(c) * by).cast("int")
    return x.select("k", "n", *[r6(S.pcm_to_float(take(c, by), depth).cast("double")).alias(depth) for c, by, depth in (("q", 600, "i16"), ("p", 40, "i24"), ("p", 10000, "i32"))])


@query(W + f"x AS ({RAW})" + """, f AS (SELECT k, n, [q, p / 997.0::DOUBLE, d, t, n::DOUBLE * 1.5::DOUBLE][1:(n - 1) % 5 + 1] AS ch FROM x)
SELECT k, n, round(CASE len(ch) WHEN 1 THEN ch[1] WHEN 2 THEN ch[1] WHEN 3 THEN (ch[1] + ch[3]) / 2 WHEN 4 THEN (ch[1] + ch[3]) / 2 ELSE (ch[1] + ch[3] + ch[5]) / 3 END, 5) + 0.0 AS l,
round(CASE len(ch) WHEN 1 THEN ch[1] WHEN 2 THEN ch[2] WHEN 3 THEN ch[2] ELSE (ch[2] + ch[4]) / 2 END, 5) + 0.0 AS r, round(list_sum(ch) / len(ch), 4) + 0.0 AS mono FROM f""")
def channel_folds(spark, sf_dir):
    """Frames of one to five channels to stereo and to mono."""
    ch = F.slice(F.array("q", F.col("p") / 997, "d", "t", F.col("n") * F.lit(1.5)), F.lit(1), (F.col("n") - 1) % 5 + 1)
    f = raw(spark, sf_dir).withColumn("ch", ch).withColumn("s", S.fold_stereo(F.col("ch")))
    return f.select("k", "n", (F.round("s.l", 5) + F.lit(0.0)).alias("l"), (F.round("s.r", 5) + F.lit(0.0)).alias("r"), (F.round(S.fold_mono(F.col("ch")), 4) + F.lit(0.0)).alias("mono"))


@query(W + TRACKS + """, sized AS (SELECT track, total, CAST(round(total * 44100.0::DOUBLE / 48000.0::DOUBLE) AS BIGINT) AS target FROM tracks),
outp AS (SELECT track, total, i, i * (total - 1)::DOUBLE / greatest(target - 1, 1)::DOUBLE AS p FROM (SELECT *, unnest(range(0, target)) AS i FROM sized)),
f AS (SELECT *, CAST(floor(p) AS BIGINT) AS a, p - floor(p) AS frac FROM outp)
SELECT f.track, i, round(x.l + frac * (y.l - x.l), 6) + 0.0 AS l, round(x.r + frac * (y.r - x.r), 6) + 0.0 AS r FROM f
JOIN sig x ON x.track = f.track AND x.pos = least(a, f.total - 1) JOIN sig y ON y.track = f.track AND y.pos = least(a + 1, f.total - 1)""")
def linear_resample(spark, sf_dir):
    """From 48 kHz to 44.1 kHz by two equi-joins on source frames."""
    sig = events_signal(spark, sf_dir)
    t = sig.select("track", "total").distinct().withColumn("target", S.target_length(F.col("total"), F.lit(48000.0)))
    out = every_position(t, F.col("target"), "i")
    p = S.source_position(F.col("i"), F.col("total"), F.col("target"))
    out = out.withColumns({"a": F.least(F.floor(p).cast("long"), F.col("total") - 1), "b": F.least(F.floor(p).cast("long") + 1, F.col("total") - 1), "frac": p - F.floor(p)})
    x, y = (sig.select("track", F.col("pos").alias(c), F.col("l").alias(f"l_{c}"), F.col("r").alias(f"r_{c}")) for c in "ab")
    both = out.join(x, ["track", "a"]).join(y, ["track", "b"])
    return both.select("track", "i", *[r6(F.col(f"{c}_a") + F.col("frac") * (F.col(f"{c}_b") - F.col(f"{c}_a"))).alias(c) for c in "lr"])


@query(f"""SELECT k, round(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * k / 2048), 6) + 0.0 AS hann, CAST(CASE WHEN k - 1024 < 0 THEN 1024 - k WHEN k - 1024 >= 700 THEN 2 * 699 - (k - 1024) ELSE k - 1024 END AS BIGINT) AS mirrored
FROM (SELECT unnest(range(0, 2048)) AS k)""")
def hann_and_mirror(spark, sf_dir):
    """The window, and indices mirrored at the ends of 700 samples."""
    k = F.col("id")
    return spark.range(2048).select(k.alias("k"), r6(S.hann(k, 2048)).alias("hann"), S.reflect(k - 1024, F.lit(700)).cast("long").alias("mirrored"))


@query("""SELECT n, n // 441 + 1 AS frames, (n // 441) * 441 + 2048 AS ola, CAST(1024 AS BIGINT) AS crop_from, n + 1024 AS crop_to FROM (SELECT l_orderkey AS n FROM lineitem UNION SELECT unnest([0, 1, 441, 352800])::BIGINT)""")
def frame_counts(spark, sf_dir):
    """Frames, overlap-add length and crop of signals of many lengths."""
    fixed = spark.createDataFrame([(x,) for x in (0, 1, 441, 352800)], "n long")
    n = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("n")).union(fixed).distinct()
    frames = S.frame_count(F.col("n"))
    return n.select("n", frames.alias("frames"), S.overlap_length(frames).alias("ola"), F.lit(1024).cast("long").alias("crop_from"), (F.col("n") + 1024).alias("crop_to"))


@query("""SELECT hz, round(CASE WHEN hz >= 1000 THEN 15.0::DOUBLE + ln(hz / 1000.0::DOUBLE) / (ln(6.4::DOUBLE) / 27) ELSE hz / (200.0::DOUBLE / 3) END, 6) + 0.0 AS mel, round(hz::DOUBLE, 6) + 0.0 AS back FROM (SELECT unnest(range(0, 22051, 50))::DOUBLE AS hz)""")
def mel_scale(spark, sf_dir):
    """Hz to mel and back."""
    hz = spark.range(0, 22051, 50).select(F.col("id").cast("double").alias("hz"))
    return hz.select("hz", r6(S.hz_to_mel(F.col("hz"))).alias("mel"), r6(S.mel_to_hz(S.hz_to_mel(F.col("hz")))).alias("back"))


BRIDGE = """top AS (SELECT 15.0::DOUBLE + ln(22050.0::DOUBLE / 1000) / (ln(6.4::DOUBLE) / 27) AS m),
edge AS (SELECT e, CASE WHEN e = 61 THEN m ELSE m / 61 * e END AS mel FROM (SELECT unnest(range(0, 62)) AS e), top),
hz AS (SELECT e, CASE WHEN mel >= 15 THEN 1000.0::DOUBLE * exp((ln(6.4::DOUBLE) / 27) * (mel - 15)) ELSE 200.0::DOUBLE / 3 * mel END AS f FROM edge),
tri AS (SELECT e AS band, f AS lo, lead(f) OVER w AS mid, lead(f, 2) OVER w AS hi FROM hz WINDOW w AS (ORDER BY e)),
bins AS (SELECT b AS bin, CASE WHEN b = 1024 THEN 22050.0::DOUBLE ELSE 22050.0::DOUBLE / 1024 * b END AS f FROM (SELECT unnest(range(0, 1025)) AS b)),
bridge AS (SELECT CAST(band AS INTEGER) AS band, CAST(bin AS INTEGER) AS bin FROM tri, bins WHERE hi IS NOT NULL AND least((f - lo) / (mid - lo), (hi - f) / (hi - mid)) > 0 UNION SELECT 0, 0 UNION SELECT 59, 1024)"""


@query(W + BRIDGE + " SELECT band, bin FROM bridge")
def band_layout(spark, sf_dir):
    """Bins of the 60 mel bands."""
    return bands.band_bins(spark)


@query(W + BRIDGE + ", s AS (SELECT band, count(*) AS n FROM bridge GROUP BY band) SELECT band, n AS n_bins, n * 4 AS dim_in, CAST((sum(n) OVER (ORDER BY band) - n) * 4 AS BIGINT) AS feature_start FROM s")
def band_ranges(spark, sf_dir):
    """Each band's width and place in the gathered features."""
    return bands.band_sizes(bands.band_bins(spark))


@query(W + BRIDGE + " SELECT bin, count(*) AS n_bands FROM bridge GROUP BY bin")
def bin_cover(spark, sf_dir):
    """in how many bands a bin lies."""
    return bands.bands_per_bin(bands.band_bins(spark))


@query(W + BRIDGE + " SELECT band, bin, ch, ri, CAST(4 * bin + 2 * ch + ri AS BIGINT) AS feature, CAST(2 * bin + ch AS BIGINT) AS slot FROM bridge, (SELECT unnest([0, 1]) AS ch), (SELECT unnest([0, 1]) AS ri)")
def feature_index(spark, sf_dir):
    """Feature and slot of each bin, channel and part, by band."""
    b = bands.band_bins(spark).select("band", "bin", F.explode(F.array(F.lit(0), F.lit(1))).alias("ch")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("ri"))
    return b.select("band", "bin", "ch", "ri", (4 * F.col("bin") + 2 * F.col("ch") + F.col("ri")).cast("long").alias("feature"), (2 * F.col("bin") + F.col("ch")).cast("long").alias("slot"))


N_FFT, HOP = 16, 4
DFT = SIGNAL + f""", fr AS (SELECT track, total, unnest(range(0, total // {HOP} + 1)) AS frame FROM (SELECT DISTINCT track, total FROM sig)),
pl AS (SELECT track, total, frame, k, frame * {HOP} + k - {N_FFT // 2} AS p FROM fr, (SELECT unnest(range(0, {N_FFT})) AS k)),
mi AS (SELECT *, CASE WHEN p < 0 THEN -p WHEN p >= total THEN 2 * (total - 1) - p ELSE p END AS pos FROM pl),
fx AS (SELECT mi.track, mi.total, frame, k, l AS v, l * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * k / {N_FFT})) AS x FROM mi JOIN sig ON sig.track = mi.track AND sig.pos = mi.pos),
dft AS (SELECT track, total, frame, b AS bin, sum(x * cos(2 * {PI} * b * k / {N_FFT})) AS re, -sum(x * sin(2 * {PI} * b * k / {N_FFT})) AS im FROM fx, (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS b) GROUP BY ALL)"""


def left(spark, sf_dir):
    return events_signal(spark, sf_dir).select("track", "pos", "total", F.col("l").alias("v"))


@query(W + DFT + " SELECT track, CAST(frame AS INTEGER) AS frame, CAST(k AS INTEGER) AS k, round(v, 6) + 0.0 AS v FROM fx")
def framed_signal(spark, sf_dir):
    """Overlapping frames of each track, mirrored at the ends."""
    return spectral.framed(left(spark, sf_dir), ["track"], N_FFT, HOP).select("track", "frame", "k", r6(F.col("v")).alias("v"))


@query(W + DFT + " SELECT track, CAST(frame AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM dft")
def short_dft(spark, sf_dir):
    """K1 for short windows: windowed spectra by the definition."""
    return spectral.small_dft(left(spark, sf_dir), ["track"], N_FFT, HOP).select("track", "frame", "bin", r6(F.col("re")).alias("re"), r6(F.col("im")).alias("im"))


@query(W + SIGNAL + f" SELECT track, pos, round(l, 6) + 0.0 AS v FROM sig WHERE pos < total // {HOP} * {HOP} + {N_FFT // 2}")
def short_dft_round_trip(spark, sf_dir):
    """The spectra back to the signal by overlap-add over the squared window."""
    back = spectral.small_idft(spectral.small_dft(left(spark, sf_dir), ["track"], N_FFT, HOP), ["track"], N_FFT, HOP)
    return back.select("track", "pos", r6(F.col("v")).alias("v"))


BRIDGE9 = "bridge AS (SELECT CAST(b AS INTEGER) AS bin, CAST(unnest(CASE WHEN b % 3 = 2 THEN [b // 3, b // 3 + 1] ELSE [b // 3] END) AS INTEGER) AS band FROM (SELECT unnest(range(0, 9)) AS b))"


def small_bridge(spark):
    b = F.col("id")
    own = F.when(b % 3 == 2, F.array(F.floor(b / 3), F.floor(b / 3) + 1)).otherwise(F.array(F.floor(b / 3)))
    return spark.range(9).select(b.cast("int").alias("bin"), F.explode(own.cast("array<int>")).alias("band"))


@query(W + DFT + ", " + BRIDGE9 + """, ga AS (SELECT track, frame, band, d.bin, re * (band + 1) / (frame % 3 + 2) AS v FROM dft d JOIN bridge b ON d.bin = b.bin), n AS (SELECT bin, count(*) AS n FROM bridge GROUP BY bin)
SELECT track, CAST(frame AS INTEGER) AS frame, CAST(ga.bin AS INTEGER) AS bin, round(sum(v) / any_value(n), 6) + 0.0 AS v FROM ga JOIN n ON ga.bin = n.bin GROUP BY ALL""")
def gather_and_scatter(spark, sf_dir):
    """Bins to overlapping bands, a gain each, and back by average.

    A track has one total; grouped with it, rows stay where small_dft put them.
    """
    spec = spectral.small_dft(left(spark, sf_dir), ["track"], N_FFT, HOP)
    bridge = small_bridge(spark)
    made = bands.gather(spec, bridge).withColumn("v", F.col("re") * (F.col("band") + 1) / (F.col("frame") % 3 + 2))
    n = bands.bands_per_bin(bridge)
    back = made.groupBy("track", "total", "frame", "bin").agg(F.sum("v").alias("v")).join(F.broadcast(n), "bin")
    return back.select("track", "frame", "bin", r6(F.col("v") / F.col("n_bands")).alias("v"))


@query(W + DFT + """ SELECT track, CAST(frame AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin, round(re * cos(bin) - im * sin(frame), 6) + 0.0 AS re, round(re * sin(frame) + im * cos(bin), 6) + 0.0 AS im FROM dft""")
def masked_spectrum(spark, sf_dir):
    """Complex mask times spectrum."""
    spec = spectral.small_dft(left(spark, sf_dir), ["track"], N_FFT, HOP)
    m = S.complex_product(F.col("re"), F.col("im"), F.cos(F.col("bin").cast("double")), F.sin(F.col("frame").cast("double")))
    return spec.select("track", "frame", "bin", m.alias("m")).select("track", "frame", "bin", r6(F.col("m.re")).alias("re"), r6(F.col("m.im")).alias("im"))


# By Parseval's theorem: half of 2048 times the energy, and of the squares of the two bins that are their own mirror.
@query(W + schedule_sql(4410, 1000) + f""", fr AS (SELECT track, win_id, start, take, unnest(range(0, take // 441 + 1)) AS frame FROM sched),
pl AS (SELECT track, win_id, start, take, frame, k, frame * 441 + k - 1024 AS p FROM fr, (SELECT unnest(range(0, 2048)) AS k)),
mi AS (SELECT track, win_id, frame, k, start + greatest(least(CASE WHEN abs(p) >= take THEN 2 * (take - 1) - abs(p) ELSE abs(p) END, take - 1), 0) AS pos FROM pl),
fx AS (SELECT mi.track, win_id, frame, k, l * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * k / 2048)) AS x FROM mi JOIN sig ON sig.track = mi.track AND sig.pos = mi.pos)
SELECT track, CAST(win_id AS INTEGER) AS win_id, CAST(frame AS INTEGER) AS frame, round((2048 * sum(x * x) + sum(x) * sum(x) + sum(CASE WHEN k % 2 = 0 THEN x ELSE -x END) * sum(CASE WHEN k % 2 = 0 THEN x ELSE -x END)) / 2, 4) + 0.0 AS energy
FROM fx GROUP BY ALL""")
def fft_energy(spark, sf_dir):
    """K1 at full size: spectra of 2048 points of each window by FFT, as energy a frame."""
    from ..operators.overlap import windows
    from .grid import Grid

    wins = windows(events_signal(spark, sf_dir), Grid(4410, 1000), ["track"])
    spec = spectral.track_spectra(wins, ["track"])
    power = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda s, x: s + x)
    return spec.select("track", "win_id", "frame", (F.round(power, 4) + F.lit(0.0)).alias("energy"))


@query(f"""WITH f AS (SELECT unnest(range(0, 44100)) AS i)
SELECT CAST(i AS BIGINT) AS pos, round(0.4::DOUBLE * sin(2 * {PI} * 196 * i / 44100) + 0.2::DOUBLE * sin(2 * {PI} * 980 * i / 44100), 6) + 0.0 AS l, CAST((i * 1103515245::BIGINT + 12345) % 2147483648 AS BIGINT) AS noise FROM f""")
def synthetic_track(spark, sf_dir):
    """A second of two tones and a hash noise, made by position."""
    i = F.col("id")
    tone = lambda a, hz: a * F.sin(2 * math.pi * hz * i / 44100)
    return spark.range(44100).select(i.alias("pos"), r6(tone(0.4, 196) + tone(0.2, 980)).alias("l"), ((i * 1103515245 + 12345) % 2147483648).alias("noise"))
