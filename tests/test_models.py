import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.errors import MemoryRefusal, ModelError, OutputError
from wavelane.operators import admission, modelgraph as G, network as N, spectral, weights
from wavelane.sources import safetensors
from wavelane.sources.sidecar import Job

W = 352_800


def ld(field, payload):
    return G.varint(field << 3 | 2) + G.varint(len(payload)) + payload


def vi(field, v):
    return G.varint(field << 3) + G.varint(v)


def tensor(name, values):
    raw = b"".join(int(v).to_bytes(8, "little", signed=True) for v in values)
    return ld(1, G.varint(len(values))) + vi(2, 7) + (ld(8, name.encode()) if name else b"") + ld(9, raw)


def floats(name, n):
    return ld(1, G.varint(n)) + vi(2, 1) + ld(8, name.encode()) + ld(9, b"")


def constant(name, values):
    return ld(3, name.encode()) + ld(4, b"Constant") + ld(5, ld(1, b"value") + ld(5, tensor("", values)) + vi(20, 4))


def value(name, dims):
    shape = b"".join(ld(1, vi(1, d)) for d in dims)
    return ld(1, name.encode()) + ld(2, ld(1, vi(1, 1) + ld(2, shape)))


def model(window=W, extra=()):
    nodes = [constant("/a", [2, 1, window]), constant("/b", [window]), constant("/c", [window]), constant("/d", [window]), constant("/e", [2048])]
    inits = [tensor("bands", [0, 12, 64]), floats("istft.window_sum_inv", window + 2048), floats("cos", 1024), *extra]
    g = b"".join(ld(1, n) for n in nodes) + b"".join(ld(5, i) for i in inits) + ld(2, b"g") + ld(11, value("mix", [1, 2, window])) + ld(12, value("sources", [1, 2, 2, window])) + ld(13, value("x", [window]))
    return vi(1, 9) + ld(7, g)


def test_inspect_and_patch():
    r = G.inspect(model())
    assert (r.window, r.capacity, r.nodes, r.initializers, r.value_infos, r.name) == (W, W, 5, 3, 1, "g")
    assert [s.kind for s in r.sites].count("constant") == 4 and [s.kind for s in r.sites].count("dimension") == 2
    out, after = G.patch_window(model(), 176_400)
    assert after.window == 176_400 and len(out) == len(model()) and all(s.value == 176_400 for s in after.sites)
    same, _ = G.patch_window(model(), W)
    assert same == model()


@pytest.mark.parametrize("target", [0, 1000, 441, W + 441])
def test_refused_patches(target):
    with pytest.raises(ModelError):
        G.patch_window(model(), target)


def test_refused_graphs():
    with pytest.raises(ModelError, match="as data"):
        G.inspect(model(extra=[tensor("weights", [W])]))
    with pytest.raises(ModelError):
        G.inspect(vi(1, 9))
    with pytest.raises(ModelError):
        G.scan(b"\x0a\xff")


def test_varints():
    assert [len(G.varint(v)) for v in (127, 128, 441, 176_400, 352_800)] == [1, 2, 2, 3, 3]
    assert G.varint(176_400) == bytes([0x90, 0xE2, 0x0A])
    assert all(G.read_varint(G.varint(v), 0, 10)[0] == v for v in (0, 1, 127, 128, 1 << 40, (1 << 63) - 1))


def test_onnx_session_in_a_worker(spark):
    """A graph made of bytes: sources = stack of half the mix, twice."""
    from wavelane.operators.onnx_separator import OnnxSeparator
    from wavelane.operators.overlap import stems
    from wavelane.plans.grid import Grid

    win = 441

    def node(op, ins, outs, attrs=b""):
        return b"".join(ld(1, i.encode()) for i in ins) + b"".join(ld(2, o.encode()) for o in outs) + ld(4, op.encode()) + attrs

    def ints(name, dims, values):
        return ld(1, b"".join(G.varint(d) for d in dims)) + vi(2, 7) + ld(8, name.encode()) + ld(9, b"".join(v.to_bytes(8, "little") for v in values))

    half = vi(2, 1) + ld(8, b"half") + ld(9, np.float32(0.5).tobytes())
    window = ld(2, b"win") + constant("/w", [win])
    shape = ints("axes", [1], [1])
    nodes = [window, node("Mul", ["mix", "half"], ["y"]), node("Unsqueeze", ["y", "axes"], ["z"]), node("Concat", ["z", "z"], ["sources"], ld(5, ld(1, b"axis") + vi(3, 1) + vi(20, 2)))]
    g = b"".join(ld(1, n) for n in nodes) + ld(2, b"g") + ld(5, half) + ld(5, shape) + ld(11, value("mix", [1, 2, win])) + ld(12, value("sources", [1, 2, 2, win]))
    raw = vi(1, 8) + ld(7, g) + ld(8, ld(1, b"") + vi(2, 13))
    frames = spark.range(1000).select(F.lit("a").alias("track"), F.col("id").alias("pos"), F.lit(1000).cast("long").alias("total"), (F.col("id") / 1000).alias("l"), (-F.col("id") / 1000).alias("r"))
    got = stems(frames, Grid(win, 100), lambda: OnnxSeparator(raw, threads=1), ["track"]).orderBy("pos").toPandas()
    assert len(got) == 1000
    assert np.allclose(got.voc_l, np.arange(1000) / 2000, atol=1e-6) and np.allclose(got.bg_r, -np.arange(1000) / 2000, atol=1e-6)
    with pytest.raises(ModelError):
        OnnxSeparator(raw[:-3])
    with pytest.raises((OutputError, Exception)):
        OnnxSeparator(raw, threads=1).separate(np.zeros((2, 5)))


SMALL = N.Shape(bands=6, n_fft=64, hop=16, dim=8, heads=2, head_dim=4, depth=2, mult=2)


def test_full_size_names_and_bands(spark):
    full = N.Shape()
    assert [len(b) for b in full.band_bins][0] == 7 and len(full.band_bins[-1]) == 130 and sum(map(len, full.band_bins)) == 1979
    assert full.cover.min() == 1 and full.cover.max() == 2
    assert len(full.tensors) == 672
    want = {r.key: tuple(r.shape) for r in weights.expected(spark).collect()}
    assert want == full.tensors


def test_forward_keeps_shape_and_masks_linearly():
    net = N.Network(SMALL, SMALL.random())
    mix = np.random.default_rng(1).normal(0, 0.2, (2, 400))
    out = net.forward(mix)
    assert out.shape == mix.shape and np.isfinite(out).all()
    ones = N.Network(SMALL, SMALL.random())
    ones.masks = lambda spec: np.ones((SMALL.bins, 2, spec.shape[2]), complex)
    assert np.abs(ones.forward(mix) - mix).max() < 1e-9


def test_network_stems_against_a_loop(spark):
    """The query's stems are those of a plain loop over windows on the driver."""
    from wavelane.operators import overlap
    from wavelane.plans.queries_models import SMALL, network_stems
    from wavelane.plans.registry import GRID, events_signal

    sf = "/root/testdata/sf0.001"
    engine = N.NetworkSeparator(N.Network(SMALL, SMALL.random()), GRID.win)
    got = network_stems(spark, sf).toPandas()
    for name, own in events_signal(spark, sf).toPandas().groupby("track"):
        own = own.sort_values("pos")
        total, x = len(own), own[["l", "r"]].to_numpy().T
        starts = [0] if total <= GRID.win else [*range(0, total - GRID.win + 1, GRID.hop)]
        starts += [total - GRID.win] * (total > GRID.win and (total - GRID.win) % GRID.hop != 0)
        sums, weights = np.zeros((4, total)), np.zeros(total)
        for k, s in enumerate(starts):
            n = min(GRID.win, total - s)
            mix = np.zeros((2, GRID.win), np.float32)
            mix[:, :n] = x[:, s : s + n]
            w = np.array([1.0 if not ((k and i < GRID.overlap) or (k + 1 < len(starts) and i >= GRID.hop)) else (i if k and i < GRID.overlap else GRID.win - 1 - i) / (GRID.overlap - 1) for i in range(GRID.win)])
            out = np.concatenate(engine.separate(mix))
            sums[:, s : s + n] += (out * w)[:, :n]
            weights[s : s + n] += w[:n]
        mine = got[got.track == name].sort_values("pos")
        want = np.where(weights > 1e-8, sums / np.maximum(weights, 1e-8), 0)
        assert len(mine) == total and np.abs(mine[list(overlap.PARTS)].to_numpy().T - want).max() < 2e-6


def test_transposed_tensors(spark):
    from wavelane.operators import weights as W

    rows = [("a", [3, 2], [float(x) for x in range(6)]), ("b", [4], [1.0, 2.0, 3.0, 4.0]), ("c", [1, 3], [5.0, 6.0, 7.0])]
    got = {r.key: (r.shape, r.data) for r in W.transposed(spark.createDataFrame(rows, "key string, shape array<int>, data array<double>")).collect()}
    assert got == {"a": ([2, 3], [0.0, 2.0, 4.0, 1.0, 3.0, 5.0]), "b": rows[1][1:], "c": ([3, 1], rows[2][2])}


def test_attention_against_loops():
    s, w = SMALL, SMALL.random(3)
    net, p = N.Network(s, w), "layers_0.time_transformer.layers_0."
    x = np.random.default_rng(2).normal(size=(1, 5, s.dim))
    h = np.array([[N.l2_norm(x[0, t], w[p + "attn.norm.weight"]) for t in range(5)]])[0]
    qkv = h @ w[p + "attn.to_qkv.weight"]
    inner = s.heads * s.head_dim
    out = np.zeros((5, inner))
    for hd in range(s.heads):
        cut = slice(hd * s.head_dim, (hd + 1) * s.head_dim)
        q, k, v = qkv[:, :inner][:, cut], qkv[:, inner : 2 * inner][:, cut], qkv[:, 2 * inner :][:, cut]

        def turn(a, t):
            r = a.copy()
            for i in range(0, s.head_dim, 2):
                th = t / 10000 ** (i / s.head_dim)
                r[i], r[i + 1] = a[i] * math.cos(th) - a[i + 1] * math.sin(th), a[i] * math.sin(th) + a[i + 1] * math.cos(th)
            return r

        for t in range(5):
            sc = np.array([turn(q[t], t) @ turn(k[u], u) / math.sqrt(s.head_dim) for u in range(5)])
            e = np.exp(sc - sc.max())
            gate = 1 / (1 + math.exp(-(h[t] @ w[p + "attn.to_gates.weight"][:, hd] + w[p + "attn.to_gates.bias"][hd])))
            out[t, cut] = e / e.sum() @ v * gate
    assert np.allclose(net._attention(x, p)[0], out @ w[p + "attn.to_out.layers.0.weight"])


def test_weight_files(spark, tmp_path):
    own = SMALL.random()
    path = str(tmp_path / "w.safetensors")
    safetensors.save(path, {k: v.T if v.ndim == 2 else v for k, v in own.items()})
    got = N.load_weights(SMALL, safetensors.load(path))
    assert all(np.allclose(got[k], v, atol=1e-6) for k, v in own.items())
    with pytest.raises(ModelError, match="missing"):
        N.load_weights(SMALL, {})
    with pytest.raises(ModelError, match="unknown"):
        N.load_weights(SMALL, {**own, "x": np.zeros(1)})
    t = weights.transposed(safetensors.table(spark, path)).filter("key = 'band_split.to_features_0.linear.weight'").first()
    want = own["band_split.to_features_0.linear.weight"]
    assert tuple(t.shape) == want.shape and np.allclose(np.array(t.data).reshape(t.shape), want, atol=1e-6)


def test_fixed_vectors():
    assert np.allclose(N.l2_norm(np.array([3.0, 4.0]), np.ones(2)), np.array([0.6, 0.8]) * math.sqrt(2))
    assert np.allclose(N.l2_norm(np.zeros(3), np.ones(3)), 0)
    assert np.allclose(N.l2_norm(np.full(4, 1e-20), np.ones(4)), 2e-8)
    assert np.allclose(N.gelu(np.array([1.0, -1.0, 2.0])), [0.8413447460685429, -0.1586552539314571, 1.9544997361036416])
    x = np.sin(np.arange(35_280) * 0.01) * 0.5
    assert np.abs(spectral.istft(spectral.stft(x), len(x)) - x).max() < 1e-9
    assert spectral.stft(x).shape == (1025, 81)


def test_gate(monkeypatch):
    none = dict.fromkeys(admission.FIELDS)
    admission.admit(4000, 4000)
    admission.admit(10**9, None, none)
    with pytest.raises(MemoryRefusal) as e:
        admission.admit(4001, None, none | {"commit_avail_mb": 4000})
    assert admission.MARKERS[-1] in str(e.value)
    with pytest.raises(MemoryRefusal):
        admission.admit(100, 50)
    with pytest.raises(MemoryRefusal):
        admission.admit(13385, None, none | {"total_phys_mb": 16384, "proc_rss_mb": 3000})
    with admission.peak_mb(0.005) as p:
        block = np.ones(5_000_000)
    assert p.mb > 0 and block.sum() > 0 and admission.summary(none).count("?") == 8


def test_snapshot_frame(spark):
    r = admission.snapshot_frame(spark).first()
    assert r.total_phys_mb > 0 and r.proc_rss_mb > 0


def test_job_round_trip_and_faults(tmp_path):
    f = tmp_path / "in"
    f.write_bytes(b"12345")
    j = Job.of(100, 3, 50, 10, str(f), str(tmp_path / "none"))
    assert Job.decode(j.encode() + "later=5\n") == j and j.input_bytes == 5 and (j.model_bytes, j.model_mtime_ns) == (0, 0)
    for bad in (j.encode() + "format=1\n", j.encode().replace("overlap=10\n", ""), j.encode() + "huh\n", j.encode().replace("window=50", "window=x")):
        with pytest.raises(ValueError):
            Job.decode(bad)


def mac_said():
    return "Mach Virtual Memory Statistics: (page size of 16384 bytes)\nPages free:                               64000.\nPages active:                            300000.\nPages inactive:                          128000.\nPages speculative:                         1000.\n"


def test_counters_of_other_systems():
    got = admission.mac_counters(mac_said(), "17179869184\n", "  524288\n")
    assert got["avail_phys_mb"] == (64000 + 128000 + 1000) * 16384 >> 20 and got["total_phys_mb"] == 16384 and got["proc_rss_mb"] == 512 and got["commit_avail_mb"] is None
    assert set(admission.mac_counters("", "", "")) == set(admission.FIELDS) and not any(admission.mac_counters("", "", "").values())


def test_npy_files(tmp_path):
    from wavelane.errors import InputError
    from wavelane.sources import npy

    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    np.save(f"{tmp_path}/a.npy", x)
    assert (npy.load(f"{tmp_path}/a.npy") == x).all()
    np.save(f"{tmp_path}/b.npy", x.astype(float))
    np.save(f"{tmp_path}/c.npy", np.asfortranarray(x))
    (tmp_path / "d.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-1])
    (tmp_path / "e.npy").write_bytes(b"no array")
    for name in "bcde":
        with pytest.raises(ModelError):
            npy.load(f"{tmp_path}/{name}.npy")
    with pytest.raises(InputError):
        npy.load(f"{tmp_path}/none.npy")


def exported(spark, change=lambda rows: rows):
    """A graph as an exporter writes it: named norms and biases, unnamed weights of products, buffers."""
    from wavelane.operators import weights as W

    def ld(number, payload):
        return G.varint(number << 3 | 2) + G.varint(len(payload)) + payload

    def init(name, x):
        return ld(5, b"".join(G.varint(1 << 3) + G.varint(d) for d in x.shape) + G.varint(2 << 3) + G.varint(1) + ld(8, name.encode()) + ld(9, x.astype("<f4").tobytes()))

    rng, body, names = np.random.default_rng(1), b"", []
    for i in range(2):
        for t in (0, 1):
            base = f"layers.{i}.{t}"
            names += [(f"model.{base}.layers.0.0.norm.gamma", None), (f"model.{base}.norm.gamma", None), (f"model.{base}.layers.0.1.net.1.bias", None)]
            names += [(f"/model/{base}/layers.0.0/to_qkv/MatMul", "w"), (f"/model/{base}/layers.0.0/to_out/to_out.0/MatMul", "w"), (f"/model/{base}/layers.0.1/net/net.4/MatMul", "w")]
    names += [("/model/band_split/to_features.3/to_features.3.1/MatMul", "w"), ("/model/mask_estimators.0/to_freqs.7/to_freqs.7.0/to_freqs.7.0.2/MatMul", "w"), ("stft.window", None)]
    want = {}
    for k, (name, weight) in enumerate(change(names)):
        x = rng.normal(size=(3, 4) if weight else (5,)).astype(np.float32)
        if weight:
            body += init(f"onnx::MatMul_{k}", x) + ld(1, ld(1, b"x") + ld(1, f"onnx::MatMul_{k}".encode()) + ld(3, name.encode()) + ld(4, b"MatMul"))
        else:
            body += init(name, x)
        want[name] = x
    return G.varint(1 << 3) + G.varint(9) + ld(7, body), want


def test_weights_of_an_exported_graph(spark):
    from wavelane.operators import modelweights as M

    buf, held = exported(spark)
    got = M.extract(spark, buf, whole=False)
    assert len(got) == len(held) - 1
    assert (got["layers_1.freq_transformer.layers_0.attn.to_out.layers.0.weight"] == held["/model/layers.1.1/layers.0.0/to_out/to_out.0/MatMul"].T).all()
    assert (got["layers_0.time_transformer.layers_0.ff.net.layers.4.weight"] == held["/model/layers.0.0/layers.0.1/net/net.4/MatMul"].T).all()
    assert (got["band_split.to_features_3.linear.weight"] == held["/model/band_split/to_features.3/to_features.3.1/MatMul"].T).all()
    assert (got["mask_estimators_0.to_freqs_7.layers.2.weight"] == held["/model/mask_estimators.0/to_freqs.7/to_freqs.7.0/to_freqs.7.0.2/MatMul"].T).all()
    assert (got["layers_1.time_transformer.norm.weight"] == held["model.layers.1.0.norm.gamma"]).all()
    with pytest.raises(ModelError, match="missing"):
        M.extract(spark, buf)
    for change in (lambda n: [*n, n[0]], lambda n: [*n, ("elsewhere.weight", None)], lambda n: [*n, ("/other/x/MatMul", "w")]):
        with pytest.raises(ModelError):
            M.extract(spark, exported(spark, change)[0], whole=False)


def test_windows_by_value():
    from wavelane.operators import modelweights as M
    from wavelane.plans.queries_models import sample_graph

    raw = sample_graph(176_400)
    small = M.resize(raw, 441)  # of another width, which the patch in place refuses
    assert G.inspect(small).window == 441 and len(small) < len(raw) and M.resize(raw, 176_400) == raw
    assert M.resize(raw, 88_200) == G.patch_window(raw, 88_200)[0]
    for shapes in ("strip", "patch", "keep"):
        assert M.round_trip(raw, 441, shapes)
    for target, shapes in ((440, "strip"), (176_841, "strip"), (0, "keep"), (441, "other")):
        with pytest.raises(ModelError):
            M.resize(raw, target, shapes)
    assert G.inspect(M.resize(raw, 440, force=True)).window == 440
