import numpy as np
import pyarrow as pa

from neardup.functions import fingerprint as FP


def test_simhash_takes_arrow_batches_and_one_text_at_a_time(monkeypatch):
    """The worker never turns a whole batch into Python texts, and forgets digests beyond a bound."""
    held = []

    def one(text, digests):
        held.append(len(digests))
        return real(text, digests)
    real = FP._simhash_one
    monkeypatch.setattr(FP, "_simhash_one", one)
    monkeypatch.setattr(FP, "_KNOWN_DIGESTS", 50)
    texts = [" ".join(f"w{i}-{j}" for j in range(20)) for i in range(40)] + [None, "", " \n"]
    got = FP.simhash_words.func(pa.array(texts))
    assert isinstance(got, pa.ListArray)
    assert got.to_pylist() == [real(t, {}) for t in texts]
    assert got.to_pylist()[-3:] == [None, None, None] and max(held) <= 50 + 2 * 20


def test_simhash_of_an_empty_batch():
    assert FP.simhash_words.func(pa.array([], pa.string())).to_pylist() == []
    assert np.array(FP.simhash_words.func(pa.array(["a"])).to_pylist()).shape == (1, 4)
