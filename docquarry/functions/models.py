"""Encoders and rerankers that load once in each worker process, when first asked, and warm up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_loaded: dict = {}


class LazyModel:
    """What ``load`` makes, one for each process and ``key``; only the recipe travels to executors.

    ``warm_up`` runs once after loading, on the model.
    """

    def __init__(self, key: tuple, load: Callable, warm_up: Callable | None = None):
        self.key, self.load, self.warm_up = key, load, warm_up

    def get(self):
        if self.key not in _loaded:
            _loaded[self.key] = model = self.load()
            if self.warm_up:
                self.warm_up(model)
        return _loaded[self.key]


class SentenceEncoder:
    """Dense unit vectors of texts by a sentence-transformers model: texts -> matrix."""

    def __init__(self, name: str, device: str = "cpu", max_length: int = 1024, batch: int = 4, load: Callable | None = None):
        self.name, self.device, self.max_length, self.batch = name, device, max_length, batch
        self.model = LazyModel(("encoder", name, device, max_length), load or self._load, lambda m: m.encode(["warm-up"], batch_size=1))

    def _load(self):
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(self.name, device=self.device)
        model.max_seq_length = self.max_length
        return model

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.get().encode(texts, batch_size=self.batch), np.float32)


class CrossEncoderScorer:
    """Relevance logits of (question, text) pairs by a cross-encoder: questions, texts -> scores."""

    def __init__(self, name: str, device: str = "cpu", max_length: int = 512, batch: int = 4, load: Callable | None = None):
        self.name, self.device, self.max_length, self.batch = name, device, max_length, batch
        self.model = LazyModel(("scorer", name, device, max_length), load or self._load, lambda m: m.predict([("warm-up", "warm-up")], batch_size=1))

    def _load(self):
        from sentence_transformers import CrossEncoder

        return CrossEncoder(self.name, max_length=self.max_length, device=self.device)

    def __call__(self, questions: list[str], texts: list[str]) -> list[float]:
        return [float(x) for x in self.model.get().predict(list(zip(questions, texts)), batch_size=self.batch)]
