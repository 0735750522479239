"""Words and symbols of a chunk: the same as by splitting each text, looked up once."""

import random

import numpy as np
import pytest

from cellspan.llm import mixing


def test_words_are_those_of_a_split():
    rng = random.Random(1)
    docs = [[], [b""], [b"", b" \n", b"A b\x0bc\x1cD\x85 \xc2\xa0e", b"\n\nx"]]
    docs += [[bytes(rng.choice(b"aB \n\t\x0b\x1c\xc3\x85\x00") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))] for _ in range(200)]
    for own in docs:
        tokens, want = mixing.Tokens(own), [t.lower().split() + [mixing.END] for t in own]
        assert [tokens.words[i] for i in tokens.each] == [w for s in want for w in s]
        assert tokens.lens.tolist() == [len(s) for s in want]
        assert tokens.kinds.tolist() == [mixing._KIND[w[-1]] for w in tokens.words]


def test_symbols_are_looked_up_once(monkeypatch):
    docs = [b"the cat sat on the mat .", b"a dog, the cat and odd words", b""]
    code = mixing.Code([b"the", b"cat", b"a"], [3, 2, 1], 11, 3)
    coder = mixing.Coder(code, 20)
    logits = {k: [np.zeros(n, np.float32) for n in coder.slots(k)] for k in mixing.FEWER}
    model = mixing.Model(coder, logits, {k: np.full((mixing.GATES[k], mixing.INPUTS), 0.3) for k in mixing.FEWER}, {k: np.full((mixing.GATES[k], mixing.STEPS), 0.5) for k in mixing.FEWER})
    calls, symbols = [], code.symbols
    monkeypatch.setattr(code, "symbols", lambda words: calls.append(words) or symbols(words))
    tokens, score = mixing.log_probabilities(model, docs)
    bits = sum(len(s.bit) * np.ones(1) for s in coder.streams(tokens, tokens.doc, mixing._blocks(tokens)).values())
    assert tokens.symbols(code).tolist() == [max(0, [b"", mixing.END, b"the", b"cat", b"a"].index(w) if w in (mixing.END, b"the", b"cat", b"a") else 0) for w in tokens.words]
    assert len(calls) == 1
    assert score.sum() == pytest.approx(-float(bits[0]) * np.log10(2), rel=1e-6)  # a model that knows nothing: half for each bit
