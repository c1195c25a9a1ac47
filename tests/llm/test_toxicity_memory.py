from __future__ import annotations

import tracemalloc

import numpy as np

from caseloom.llm import toxicity


def test_fit_holds_few_bytes_a_word(monkeypatch):
    """The driver fits the model: of the words it holds two numbers of four bytes, and hashes of a fifth."""
    seen = []
    monkeypatch.setattr(toxicity, "_train", lambda *a: seen.append(tracemalloc.get_traced_memory()[0]))
    rng = np.random.default_rng(1)
    for words in (10, 4000):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, 900, words)) for _ in range(200)]
        tracemalloc.start()
        toxicity.fit(texts, [i % 2 for i in range(200)])
        tracemalloc.stop()
    assert seen[1] - seen[0] < 200 * 3990 * 40  # 53 bytes a word before, 29 now
