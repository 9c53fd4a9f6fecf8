"""Queries on admission, parsing, checkpoints, weights, comparisons and timed runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import admission, metrics, weights
from ..sources import sidecar
from .grid import neighbours
from .queries_signal import BRIDGE
from .registry import load, query, r6

W = "WITH "

ORDERS = "o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(round(o_totalprice) AS BIGINT) AS p FROM orders)"


def orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.round("o_totalprice").cast("long").alias("p"))


@query(W + ORDERS + """, q AS (SELECT k, p, (19400.0::DOUBLE - 5100) / (352800.0::DOUBLE * 352800 - 176400.0::DOUBLE * 176400) AS q FROM o)
SELECT k, p AS win, CASE WHEN p = 0 THEN 0 ELSE CAST(round(greatest(5100 - q * 176400.0::DOUBLE * 176400 + q * p::DOUBLE * p, 0)) AS BIGINT) END AS need_mb,
CASE WHEN p IN (176400, 352800) THEN 'measured' WHEN p < 176400 THEN 'extrapolated below' WHEN p > 352800 THEN 'extrapolated above' ELSE 'interpolated' END AS trust FROM q""")
def forward_price(spark, sf_dir):
    """The price of a window of as many samples as an order costs, and its trust."""
    p = F.col("p")
    return orders(spark, sf_dir).select("k", p.alias("win"), S.forward_price_mb(p).alias("need_mb"), S.price_trust(p).alias("trust"))


@query(W + ORDERS + " SELECT k, 60 * 8 * CAST(p % 2000 + 1 AS BIGINT) * (p % 2000 + 1) * 4 AS score_bytes, (60 * 8 * CAST(p % 2000 + 1 AS BIGINT) * (p % 2000 + 1) * 4 + 1048575) // 1048576 AS score_mb FROM o")
def forward_bound(spark, sf_dir):
    """Bytes of the attention scores, 60 bands x 8 heads x frames squared x 4, in MiB rounded up."""
    n = F.col("p") % 2000 + 1
    size = F.lit(60 * 8 * 4).cast("long") * n * n
    return orders(spark, sf_dir).select("k", size.alias("score_bytes"), F.floor((size + 1048575) / 1048576).alias("score_mb"))


SNAP = ORDERS + """, s AS (SELECT k, CASE WHEN p % 3 = 0 THEN p % 9000 END AS commit_avail_mb, CASE WHEN p % 5 < 2 THEN p % 7000 END AS avail_phys_mb,
CASE WHEN p % 7 < 4 THEN 16384 END AS total_phys_mb, CASE WHEN p % 4 = 0 THEN p % 3000 END AS proc_commit_mb, CASE WHEN p % 2 = 0 THEN p % 20000 END AS proc_rss_mb,
p % 8000 AS need, CASE WHEN p % 11 = 0 THEN p % 6000 END AS budget FROM o)"""


def snapshots(spark, sf_dir):
    p = F.col("p")
    return orders(spark, sf_dir).select(
        "k", F.when(p % 3 == 0, p % 9000).alias("commit_avail_mb"), F.when(p % 5 < 2, p % 7000).alias("avail_phys_mb"), F.when(p % 7 < 4, 16384).alias("total_phys_mb"),
        F.when(p % 4 == 0, p % 3000).alias("proc_commit_mb"), F.when(p % 2 == 0, p % 20000).alias("proc_rss_mb"), (p % 8000).alias("need"), F.when(p % 11 == 0, p % 6000).alias("budget"),
    )


@query(W + SNAP + """, c AS (SELECT *, coalesce(commit_avail_mb, avail_phys_mb, CASE WHEN total_phys_mb IS NOT NULL THEN greatest(total_phys_mb - coalesce(proc_commit_mb, proc_rss_mb, 0), 0) END) AS ceiling FROM s)
SELECT k, CAST(ceiling AS BIGINT) AS ceiling, coalesce(need > coalesce(budget, ceiling), false) AS refused, commit_avail_mb >= need AS fits FROM c""")
def admission_gate(spark, sf_dir):
    """Ceiling, refusal and the three-valued fit of many snapshots."""
    c = snapshots(spark, sf_dir).withColumn("ceiling", admission.ceiling().cast("long"))
    return c.select("k", "ceiling", admission.refuses(F.col("need"), F.col("budget"), F.col("ceiling")).alias("refused"), admission.fits(F.col("need")).alias("fits"))


MARK = " OR ".join(f"contains(lower(t), '{m}')" for m in admission.MARKERS)
TEXTS = "'BFCArena failed', 'std::bad_alloc', 'Out of memory', 'cancelled: out of memory', 'no such file', 'memory gate: refused', 'ok', 'cannot allocate 5 bytes'"


@query(f"SELECT doc_id, t, ({MARK}) AND NOT contains(lower(t), 'cancel') AS allocation_failure FROM (SELECT doc_id, [{TEXTS}][doc_id % 8 + 1] AS t FROM documents)")
def allocation_failures(spark, sf_dir):
    """Which error texts tell of a failed allocation."""
    texts = F.array(*[F.lit(x.strip(" '")) for x in TEXTS.split(", ")])
    d = load(spark, sf_dir, "documents").select("doc_id", F.get(texts, (F.col("doc_id") % 8).cast("int")).alias("t"))
    return d.select("doc_id", "t", admission.is_allocation_failure(F.col("t")).alias("allocation_failure"))


@query(f"SELECT doc_id, ({MARK.replace('(t)', '(text)')}) AND NOT contains(lower(text), 'cancel') AS allocation_failure FROM documents")
def allocation_failures_in_documents(spark, sf_dir):
    """D6 over whole texts."""
    return load(spark, sf_dir, "documents").select("doc_id", admission.is_allocation_failure(F.col("text")).alias("allocation_failure"))


@query(W + ORDERS + " SELECT k, p, CAST(length(format('{:b}', p)) + 6 AS BIGINT) // 7 AS bytes FROM o")
def varint_lengths(spark, sf_dir):
    """Bytes of a varint."""
    return orders(spark, sf_dir).select("k", "p", S.varint_length(F.col("p")).cast("long").alias("bytes"))


CLI = "'4s', '3.5s', '176400', ' 8S ', 's', '.', '1e9s', '-3s', '0', '0s', '1.2.3s', '.5s', 'abc', '12 s'"


@query(f"""WITH t AS (SELECT event_id, [{CLI}][event_id % 14 + 1] AS t FROM events), u AS (SELECT *, trim(t) AS u FROM t)
SELECT event_id, t, CASE WHEN n > 0 THEN n END AS samples FROM (SELECT event_id, t, CASE WHEN regexp_full_match(u, '[0-9]*\\.?[0-9]*[sS]') AND regexp_matches(u, '[0-9]') THEN CAST(round(CAST(regexp_replace(u, '[sS]$', '') AS DOUBLE) * 44100) AS BIGINT)
WHEN regexp_full_match(u, '[0-9]+') THEN CAST(u AS BIGINT) END AS n FROM u)""")
def window_arguments(spark, sf_dir):
    """Samples of a window given as samples or seconds."""
    texts = F.array(*[F.lit(x[1:-1]) for x in CLI.split(", ")])
    e = load(spark, sf_dir, "events").select("event_id", F.get(texts, (F.col("event_id") % 14).cast("int")).alias("t"))
    return e.select("event_id", "t", S.window_samples(F.col("t")).alias("samples"))


@query(W + ORDERS + " SELECT k, CAST(CASE WHEN c % 50 = 0 THEN 100 ELSE least(p, c * 900) * 100 // (c * 900) END AS INTEGER) AS percent, round(CASE WHEN c % 10 > 0 THEN p / (c % 10)::DOUBLE ELSE 0 END, 6) + 0.0 AS rtf FROM o")
def progress_and_rate(spark, sf_dir):
    """Percent finished, and the real-time factor."""
    c, p = F.col("c"), F.col("p")
    total = F.when(c % 50 == 0, 0).otherwise(c * 900)
    return orders(spark, sf_dir).select("k", S.progress_percent(p, total).alias("percent"), r6(S.real_time_factor(p, (c % 10).cast("double"))).alias("rtf"))


# Exported names and keys of all tensors, by the structure of either naming.
NAMES = """parts AS (SELECT * FROM (VALUES ('0.norm.gamma', 'attn.norm.weight'), ('0.to_qkv.weight', 'attn.to_qkv.weight'), ('0.to_gates.weight', 'attn.to_gates.weight'), ('0.to_gates.bias', 'attn.to_gates.bias'), ('0.to_out.0.weight', 'attn.to_out.layers.0.weight'),
('1.net.0.gamma', 'ff.net.layers.0.weight'), ('1.net.1.weight', 'ff.net.layers.1.weight'), ('1.net.1.bias', 'ff.net.layers.1.bias'), ('1.net.4.weight', 'ff.net.layers.4.weight'), ('1.net.4.bias', 'ff.net.layers.4.bias')) t(part, own)),
names AS (SELECT 'model.band_split.to_features.' || b || '.' || s.part AS name, 'band_split.to_features_' || b || '.' || s.own AS key FROM b, (VALUES ('0.gamma', 'norm.weight'), ('1.weight', 'linear.weight'), ('1.bias', 'linear.bias')) s(part, own)
UNION ALL SELECT 'model.mask_estimators.0.to_freqs.' || b || '.0.' || j || '.' || p, 'mask_estimators_0.to_freqs_' || b || '.layers.' || j || '.' || p FROM b, j, p
UNION ALL SELECT 'model.layers.' || i || '.' || x.n || '.layers.0.' || part, 'layers_' || i || '.' || x.axis || '.layers_0.' || own FROM i, parts, (VALUES (0, 'time_transformer'), (1, 'freq_transformer')) x(n, axis)
UNION ALL SELECT 'model.layers.' || i || '.' || x.n || '.norm.gamma', 'layers_' || i || '.' || x.axis || '.norm.weight' FROM i, (VALUES (0, 'time_transformer'), (1, 'freq_transformer')) x(n, axis)
UNION ALL SELECT 'other.weight', NULL)"""


def exported_names(spark):
    """The names under which the 672 tensors are exported, and one that is none of them."""
    parts = ["0.norm.gamma", "0.to_qkv.weight", "0.to_gates.weight", "0.to_gates.bias", "0.to_out.0.weight", "1.net.0.gamma", "1.net.1.weight", "1.net.1.bias", "1.net.4.weight", "1.net.4.bias"]
    names = ["other.weight"]
    for b in range(60):
        names += [f"model.band_split.to_features.{b}.{p}" for p in ("0.gamma", "1.weight", "1.bias")]
        names += [f"model.mask_estimators.0.to_freqs.{b}.0.{j}.{p}" for j in (0, 2, 4) for p in ("weight", "bias")]
    for i in range(weights.DEPTH):
        names += [f"model.layers.{i}.{x}.{p}" for x in (0, 1) for p in (*(f"layers.0.{q}" for q in parts), "norm.gamma")]
    return spark.createDataFrame([(n,) for n in names], "name string")


KEYS = """b AS (SELECT unnest(range(0, 60)) AS b), i AS (SELECT unnest(range(0, 6)) AS i), a AS (SELECT unnest(['time_transformer', 'freq_transformer']) AS a), j AS (SELECT unnest([0, 2, 4]) AS j), p AS (SELECT unnest(['weight', 'bias']) AS p),
keys AS (SELECT 'band_split.to_features_' || b || '.' || unnest(['norm.weight', 'linear.weight', 'linear.bias']) AS key FROM b
UNION ALL SELECT 'mask_estimators_0.to_freqs_' || b || '.layers.' || j || '.' || p FROM b, j, p
UNION ALL SELECT 'layers_' || i || '.' || a || '.' || unnest(['norm.weight', 'layers_0.attn.norm.weight', 'layers_0.attn.to_qkv.weight', 'layers_0.attn.to_gates.weight', 'layers_0.attn.to_gates.bias', 'layers_0.attn.to_out.layers.0.weight',
'layers_0.ff.net.layers.0.weight', 'layers_0.ff.net.layers.1.weight', 'layers_0.ff.net.layers.1.bias', 'layers_0.ff.net.layers.4.weight', 'layers_0.ff.net.layers.4.bias']) FROM i, a)"""


@query(W + KEYS + ", " + NAMES + " SELECT name, key FROM names")
def canonical_keys(spark, sf_dir):
    """Keys of exported parameter names."""
    return exported_names(spark).select("name", weights.canonical_key(F.col("name")).alias("key"))


@query(W + KEYS + " SELECT key, CAST(CASE WHEN ends_with(key, 'bias') OR contains(key, 'norm.') OR ends_with(key, 'net.layers.0.weight') THEN 1 ELSE 2 END AS INTEGER) AS rank FROM keys")
def weight_keys(spark, sf_dir):
    """The 672 tensors, by name and rank."""
    return weights.expected(spark).select("key", F.size("shape").alias("rank"))


@query(W + KEYS + ", " + BRIDGE + """, found AS (SELECT key FROM keys WHERE key NOT IN ('layers_0.time_transformer.norm.weight', 'layers_5.freq_transformer.norm.weight') UNION ALL SELECT unnest(['optimizer.step', 'layers_0.time_transformer.layers_0.attn.norm.weight'])),
faults AS (SELECT 'unknown' AS fault FROM (SELECT DISTINCT key FROM found WHERE key NOT IN (SELECT key FROM keys)) UNION ALL SELECT 'missing' FROM keys WHERE key NOT IN (SELECT key FROM found)
UNION ALL SELECT 'repeated' FROM (SELECT key FROM found GROUP BY key HAVING count(*) > 1) UNION ALL SELECT 'shape 384x' || 4 * count(*) || ' for ' || 4 * count(*) || 'x384' FROM bridge WHERE band = 0)
SELECT fault, count(*) AS n FROM faults GROUP BY fault""")
def weight_faults(spark, sf_dir):
    """A file with two tensors short, one too many, one turned and one given twice."""
    want = weights.expected(spark)
    key = F.col("key")
    turned = "band_split.to_features_0.linear.weight"
    found = want.filter(~key.isin("layers_0.time_transformer.norm.weight", "layers_5.freq_transformer.norm.weight"))
    found = found.withColumn("shape", F.when(key == turned, F.reverse("shape")).otherwise(F.col("shape")))
    extra = spark.createDataFrame([("optimizer.step", [1]), ("layers_0.time_transformer.layers_0.attn.norm.weight", [384])], "key string, shape array<int>")
    return weights.check(found.union(extra), want).groupBy("fault").agg(F.count("*").alias("n"))


JOBS = """j AS (SELECT k, 1 AS format, p AS total_frames, p // 625 + 1 AS n_chunks, 1000 AS "window", 375 AS overlap, p * 4 AS input_bytes, p * 1000003 AS input_mtime_ns, 77 AS model_bytes, 88 AS model_mtime_ns FROM o)"""


def jobs(spark, sf_dir):
    p = F.col("p")
    n = {"format": F.lit(1), "total_frames": p, "n_chunks": F.floor(p / 625) + 1, "window": F.lit(1000), "overlap": F.lit(375), "input_bytes": p * 4, "input_mtime_ns": p * 1000003, "model_bytes": F.lit(77), "model_mtime_ns": F.lit(88)}
    return orders(spark, sf_dir).select("k", *[c.cast("long").alias(f) for f, c in n.items()])


@query(W + ORDERS + ", " + JOBS + """ SELECT k, '# stem checkpoint' || chr(10) || 'format=1' || chr(10) || 'total_frames=' || total_frames || chr(10) || 'n_chunks=' || n_chunks || chr(10) || 'window=1000' || chr(10) || 'overlap=375' || chr(10) ||
'input_bytes=' || input_bytes || chr(10) || 'input_mtime_ns=' || input_mtime_ns || chr(10) || 'model_bytes=77' || chr(10) || 'model_mtime_ns=88' || chr(10) AS sidecar FROM j""")
def sidecar_encode(spark, sf_dir):
    """Sidecar texts."""
    return sidecar.encode(jobs(spark, sf_dir), "k")


@query(W + ORDERS + ", " + JOBS + """ SELECT k, total_frames, n_chunks, input_mtime_ns, CASE WHEN k % 4 = 1 THEN 'repeated field' WHEN k % 4 = 2 THEN '1 fields are missing' WHEN k % 4 = 3 THEN 'not key=value' END AS fault FROM j""")
def sidecar_decode(spark, sf_dir):
    """Sidecars read back, some of them damaged."""
    t = sidecar.encode(jobs(spark, sf_dir), "k")
    text = F.when(F.col("k") % 4 == 1, F.concat("sidecar", F.lit("format=1\n"))).when(F.col("k") % 4 == 2, F.regexp_replace("sidecar", "overlap=375\n", "")).when(F.col("k") % 4 == 3, F.concat("sidecar", F.lit("what is this\n"))).otherwise(F.concat("sidecar", F.lit("later=1\n")))
    d = t.select("k", sidecar.decode(text).alias("d"))
    return d.select("k", "d.total_frames", "d.n_chunks", "d.input_mtime_ns", "d.fault")


@query(W + ORDERS + ", " + JOBS + """ SELECT k, CASE k % 4 WHEN 0 THEN 'identical' WHEN 1 THEN 'frames ' || total_frames || ' vs ' || total_frames + 1 || ', model changed' WHEN 2 THEN 'grid 1000/375 vs 1000/250' ELSE 'input ' || input_bytes || 'B@' || input_mtime_ns || 'ns vs ' || input_bytes || 'B@' || input_mtime_ns + 1 || 'ns' END AS difference FROM j""")
def job_difference(spark, sf_dir):
    """How two runs differ."""
    j = jobs(spark, sf_dir)
    k = F.col("k") % 4
    b = {"total_frames": F.when(k == 1, 1).otherwise(0), "model_bytes": F.when(k == 1, 1).otherwise(0), "overlap": F.when(k == 2, -125).otherwise(0), "input_mtime_ns": F.when(k == 3, 1).otherwise(0)}
    a = j.select("k", F.struct(*sidecar.FIELDS).alias("a"), F.struct(*[(F.col(f) + b.get(f, F.lit(0))).alias(f) for f in sidecar.FIELDS]).alias("b"))
    return a.select("k", sidecar.difference("a", "b").alias("difference"))


STEMFILES = ORDERS + """, f AS (SELECT k, s, p // 40 - (k % 3) * s AS declared, CASE WHEN k % 17 = 0 AND s = 1 THEN 12 ELSE 44 + (p // 40) * 4 - (k % 5) * s END AS bytes, p // 41 AS total FROM o, (SELECT unnest([0, 1]) AS s))"""


@query(W + STEMFILES + """, h AS (SELECT k, count(*) FILTER (bytes >= 44) AS n, least(min(least(declared, (bytes - 44) // 4)), max(total)) AS v FROM f GROUP BY k) SELECT k, CAST(CASE WHEN n = 2 AND v > 0 THEN v END AS BIGINT) AS frames FROM h""")
def resume_frames(spark, sf_dir):
    """Frames that both stems of a torn pair hold."""
    s = F.col("s")
    f = orders(spark, sf_dir).select("k", "p", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    base = F.floor(F.col("p") / 40)
    f = f.select("k", (base - F.col("k") % 3 * s).alias("declared"), F.when((F.col("k") % 17 == 0) & (s == 1), 12).otherwise(44 + base * 4 - F.col("k") % 5 * s).alias("bytes"), F.floor(F.col("p") / 41).alias("total"))
    return sidecar.resume_frames(f, ["k"]).select("k", F.col("frames").cast("long").alias("frames"))


@query("SELECT c_custkey AS k, 'out/' || c_name || '/vocals.wav.part' AS part, 'out/' || c_name || '/vocals.wav.part.job' AS job FROM customer")
def staging_names(spark, sf_dir):
    """Names of staged stems and their sidecars."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), sidecar.staging_names(F.concat(F.lit("out/"), "c_name", F.lit("/vocals.wav"))).alias("s"))
    return c.select("k", "s.part", "s.job")


PAIR = "p AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice / 1009.0::DOUBLE AS a, l_extendedprice / 1009.0::DOUBLE + CASE WHEN l_linenumber % 2 = 0 THEN l_tax / 7.0::DOUBLE ELSE 0 END AS b, l_returnflag AS f FROM lineitem)"


def pair(spark, sf_dir):
    a = F.col("l_extendedprice").cast("double") / 1009
    x = load(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), a.alias("a"), (a + F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax").cast("double") / 7).otherwise(0.0)).alias("b"), F.col("l_returnflag").alias("f"))


@query(W + PAIR + " SELECT f, count(*) AS n, count(*) FILTER (a <> b) AS differing, round(max(abs(a - b)), 6) + 0.0 AS max_abs, round(max(abs(a - b) / abs(a)) FILTER (abs(a) > 1e-4), 6) + 0.0 AS max_rel, round(corr(a, b), 6) + 0.0 AS corr, round(10 * log10(sum(a * a) / sum((a - b) * (a - b))), 4) + 0.0 AS snr_db FROM p GROUP BY f")
def signal_difference(spark, sf_dir):
    """How far one signal is from another."""
    d = metrics.difference(pair(spark, sf_dir), ["f"])
    return d.select("f", "n", "differing", *[r6(F.col(c)).alias(c) for c in ("max_abs", "max_rel", "corr")], (F.round("snr_db", 4) + F.lit(0.0)).alias("snr_db"))


@query(W + PAIR + ", q AS (SELECT f, CAST(trunc(a * 100) AS INTEGER) AS x, CAST(trunc(b * 100) AS INTEGER) AS y FROM p) SELECT f, count(*) FILTER (x <> y) AS differing, CAST(max(abs(x - y)) AS INTEGER) AS worst FROM q GROUP BY f")
def stem_difference(spark, sf_dir):
    """quantised values that differ, and the worst step."""
    q = pair(spark, sf_dir).select("f", (F.col("a") * 100).cast("int").alias("x"), (F.col("b") * 100).cast("int").alias("y"))
    return q.groupBy("f").agg(F.count_if(F.col("x") != F.col("y")).alias("differing"), F.max(F.abs(F.col("x") - F.col("y"))).alias("worst"))


@query(W + PAIR + " SELECT f, round(20 * log10(sqrt(avg(a * a))), 4) + 0.0 AS dbfs, round(10 * log10((sum(a * b) * sum(a * b) / sum(a * a)) / (sum(b * b) - sum(a * b) * sum(a * b) / sum(a * a))), 3) + 0.0 AS si_sdr FROM p GROUP BY f")
def stem_energies(spark, sf_dir):
    """level and scale-invariant distortion."""
    d = pair(spark, sf_dir).groupBy("f").agg(metrics.dbfs(F.col("a")).alias("dbfs"), metrics.si_sdr(F.col("a"), F.col("b")).alias("si_sdr"))
    return d.select("f", (F.round("dbfs", 4) + F.lit(0.0)).alias("dbfs"), (F.round("si_sdr", 3) + F.lit(0.0)).alias("si_sdr"))


BYTES = """a AS (SELECT event_type AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, event_id % 256 AS v FROM events),
b AS (SELECT t, pos, CASE WHEN pos % 331 = 330 THEN v + 1 ELSE v END AS v FROM a WHERE pos % 997 <> 996)"""


@query(W + BYTES + " SELECT coalesce(a.t, b.t) AS t, min(coalesce(a.pos, b.pos)) FILTER (a.v IS DISTINCT FROM b.v) AS first_diff, count(*) FILTER (a.v IS DISTINCT FROM b.v) AS n_diff FROM a FULL JOIN b ON a.t = b.t AND a.pos = b.pos GROUP BY 1")
def first_difference(spark, sf_dir):
    """Where two files differ first, and how often."""
    from .grid import positions

    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("t"), "event_id")
    a = positions(e, ["t"], ["event_id"], F.floor(F.col("event_id") / 4096)).select("t", "pos", (F.col("event_id") % 256).alias("v"))
    b = a.filter(F.col("pos") % 997 != 996).withColumn("v", F.when(F.col("pos") % 331 == 330, F.col("v") + 1).otherwise(F.col("v")))
    return metrics.first_difference(a, b, ["t"])


RUNS = """r AS (SELECT c_custkey AS k, label, pos, c_acctbal / 97.0::DOUBLE + 200 + CASE WHEN label = 'B' THEN (c_custkey % 7) - 3 ELSE 0 END + CASE WHEN (label = 'A') = (pos = 'BA') THEN c_custkey % 5 ELSE 0 END + (c_custkey % 3) * CASE WHEN label = 'A' AND pos = 'AB' THEN 1 ELSE 0 END AS w
FROM customer, (SELECT unnest(['A', 'B']) AS label), (SELECT unnest(['AB', 'BA']) AS pos) WHERE NOT (c_custkey % 23 = 0 AND label = 'B' AND pos = 'BA'))"""


def runs(spark, sf_dir):
    k = F.col("k")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("x"))
    c = c.select("*", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("label")).select("*", F.explode(F.array(F.lit("AB"), F.lit("BA"))).alias("order"))
    a, ba = F.col("label") == "A", F.col("order") == "BA"
    wall = F.col("x") / 97 + 200 + F.when(~a, k % 7 - 3).otherwise(0) + F.when(a == ba, k % 5).otherwise(0) + k % 3 * F.when(a & ~ba, 1).otherwise(0)
    return c.filter(~((k % 23 == 0) & ~a & ba)).select("k", "label", "order", wall.alias("wall_s"))


@query(W + RUNS + """, p AS (SELECT k, max(w) FILTER (label = 'A' AND pos = 'AB') AS aab, max(w) FILTER (label = 'A' AND pos = 'BA') AS aba, max(w) FILTER (label = 'B' AND pos = 'AB') AS bab, max(w) FILTER (label = 'B' AND pos = 'BA') AS bba FROM r GROUP BY k)
SELECT k, round((bab - aab + bba - aba) / 2, 6) + 0.0 AS dd, round((aba - aab + bab - bba) / 2, 6) + 0.0 AS position, round(greatest(abs(aba - aab), CASE WHEN bba IS NULL THEN NULL ELSE abs(bba - bab) END), 6) + 0.0 AS scatter FROM p""")
def paired_estimate(spark, sf_dir):
    """Difference of two configurations with the position effect cancelled."""
    e = metrics.paired_estimate(runs(spark, sf_dir), ["k"])
    return e.select("k", *[r6(F.col(c)).alias(c) for c in ("dd", "position", "scatter")])


@query(W + RUNS + " SELECT label || CAST(chr(9) AS VARCHAR) || pos || chr(9) || format('{:.3f}', w) AS line FROM r WHERE true")
def bench_rows(spark, sf_dir):
    """Timed runs as tab-separated text."""
    return runs(spark, sf_dir).select(F.concat_ws("\t", "label", "order", F.format_string("%.3f", "wall_s")).alias("line"))


@query(W + ORDERS + " SELECT k, format('{:,}', p) || ' frames' AS summary FROM o")
def digit_groups(spark, sf_dir):
    """Counts with grouped digits."""
    return orders(spark, sf_dir).select("k", F.concat(F.format_number("p", 0), F.lit(" frames")).alias("summary"))


@query(W + ORDERS + " SELECT k, CAST(9 - bit_count((p % 512)::BIGINT) AS INTEGER) AS missing, CASE WHEN p >= 2048 THEN p - 2048 END AS capacity FROM o")
def missing_fields(spark, sf_dir):
    """Absent bits of a nine-bit mask, and a table's capacity."""
    p = F.col("p")
    return orders(spark, sf_dir).select("k", (9 - F.bit_count(p % 512)).cast("int").alias("missing"), F.when(p >= 2048, p - 2048).alias("capacity"))


@query(W + ORDERS + """ SELECT k, p AS target, CASE WHEN p <= 0 OR p % 441 <> 0 THEN 'off the hop' WHEN p > 352800 THEN 'longer' WHEN length(format('{:b}', p)) NOT BETWEEN 15 AND 21 THEN 'other width' ELSE 'ok' END AS verdict FROM (SELECT k, (p // 441) * 441 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS p FROM o)""")
def patch_verdicts(spark, sf_dir):
    """Which windows could be patched into a graph of 352800."""
    p = F.col("target")
    t = orders(spark, sf_dir).select("k", (F.floor(F.col("p") / 441) * 441 + F.when(F.col("k") % 3 == 0, 1).otherwise(0)).alias("target"))
    said = F.when((p <= 0) | (p % 441 != 0), "off the hop").when(p > 352800, "longer").when(S.varint_length(p) != S.varint_length(F.lit(352800)), "other width").otherwise("ok")
    return t.select("k", "target", said.alias("verdict"))


@query(W + "e AS (SELECT event_type AS t, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events) SELECT t, round(max(value), 6) + 0.0 AS peak, round(max(abs(value - b)), 6) + 0.0 AS step FROM e GROUP BY t")
def peak_levels(spark, sf_dir):
    """the peak over a bracket, and the largest step."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("t"), "value", "ts", "event_id")
    e = neighbours(e, ["t"], ["ts", "event_id"], F.date_trunc("day", "ts"), "value")
    return e.groupBy("t").agg(r6(F.max("value")).alias("peak"), r6(F.max(F.abs(F.col("value") - F.col("before")))).alias("step"))
