"""A separator that runs a serialised graph with onnxruntime, one session a worker."""

from __future__ import annotations

import numpy as np

from ..errors import ModelError, OutputError, SessionError
from . import modelgraph


class OnnxSeparator:
    """sources[0] of the graph's output are vocals, sources[1] the background.

    window: a shorter window to patch into the graph; None keeps its own.
    """

    name, sample_rate = "onnx", 44_100

    def __init__(self, model: bytes, window: int | None = None, threads: int = 4):
        try:
            import onnxruntime as ort
        except ImportError as e:
            raise ModelError("onnxruntime isn't installed") from e
        self.report = modelgraph.inspect(model)
        self.patched = window is not None and window != self.report.window
        if self.patched:
            model, self.report = modelgraph.patch_window(model, window)
        self.window_samples = self.report.window
        options = ort.SessionOptions()
        options.intra_op_num_threads, options.inter_op_num_threads = threads, 1
        options.enable_cpu_mem_arena = False
        try:
            self.session = ort.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        except Exception as e:
            raise ModelError(f"the graph doesn't load: {e}") from e
        self.input = self.session.get_inputs()[0]
        if self.input.shape[-1] != self.window_samples:
            raise ModelError(f"the session declares {self.input.shape[-1]}, not {self.window_samples}")

    def separate(self, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        try:
            out = self.session.run(None, {self.input.name: mix[None].astype(np.float32)})[0]
        except Exception as e:
            raise SessionError(str(e)) from e
        if out.ndim != 4 or out.shape[0] != 1 or out.shape[1] < 2 or out.shape[2] < 2 or out.shape[3] != self.window_samples:
            raise OutputError(f"the graph gave {out.shape}, not [1, 2 or more, 2 or more, {self.window_samples}]")
        if not np.isfinite(out).all():
            raise OutputError("the graph gave values that aren't finite")
        return out[0, 0, :2], out[0, 1, :2]
