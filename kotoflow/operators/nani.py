"""Classifier of 何's reading (ナン or ナニ) from the token after it; pluggable.

The default is a rule.  An ONNX pair is used where its files are given: an
encoder from string[1, 6] (pos, pos_group1, pos_group2, pron, ctype, cform) to
int64 codes, and a classifier whose first output is 1 for ナン.
"""

from __future__ import annotations

from functools import lru_cache

from kotoflow.operators.njd import Token


def rule(nxt: Token | None) -> bool:
    if nxt is None:
        return False
    return nxt.pron.startswith(("デ", "ダ", "ト", "ノ", "ナ")) and nxt.pos in ("助詞", "助動詞", "記号") or nxt.pos_group2 == "助数詞"


class OnnxModel:
    """Loaded once per worker; answers are kept by the six inputs.  No next token, or an inference error, is ナニ."""

    def __init__(self, encoder: str, classifier: str):
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        self.encoder, self.classifier = (ort.InferenceSession(p, options, providers=["CPUExecutionProvider"]) for p in (encoder, classifier))
        self._answer = lru_cache(maxsize=1000)(self._run)

    def _run(self, row: tuple[str, ...]) -> bool:
        import numpy as np

        try:
            codes = self.encoder.run(None, {self.encoder.get_inputs()[0].name: np.array([row], dtype=object)})[0]
            return int(np.ravel(self.classifier.run(None, {self.classifier.get_inputs()[0].name: codes})[0])[0]) == 1
        except Exception:  # noqa: BLE001  the default reading holds where the model fails
            return False

    def __call__(self, nxt: Token | None) -> bool:
        if nxt is None:
            return False
        return self._answer((nxt.pos, nxt.pos_group1, nxt.pos_group2, nxt.pron, nxt.ctype, nxt.cform))


def model(files: tuple[str, str] | None):
    return OnnxModel(*files) if files else rule
