"""What words without a code add to their documents: all words of a batch at once, over any cuts of Arrow's batches."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from cellspan.llm import mixing


class Held:
    def repartition(self, *a):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_words_of_a_batch_are_added_at_once(monkeypatch, size):
    rng = np.random.default_rng(5)
    n, v, rows, known, base = 1000, 50, [], collections.Counter(), collections.Counter()
    for batch in (3, 9, 1 << 33):
        docs = 6
        ids = np.arange(docs) + batch % 1000 * 10
        facts = np.array([ids, [0, 0, 1, 0, 0, 0]], "<i8").tobytes() + np.ones((5, docs)).astype("<f8").tobytes()
        rows.append((batch, None, 0, facts))
        for c in sorted(rng.integers(0, 4, 200 if batch != 9 else 0).tolist()):
            at = rng.integers(0, docs - 1, rng.integers(1, 4))  # the last document has no such word
            rows.append((batch, at.astype("<u4").tobytes(), c, None))
            for d in at.tolist():
                known[ids[d]] += c > 0
                base[ids[d]] += math.log10((c + 1) / (n + v + 1))
    run = mixing._completed(Held(), n, v)
    parts = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + size]), (pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["batch", "docs", "c", "facts"]) for a in range(0, len(rows), size)]
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: calls.append(1) or count(*a, **b))
    got = [r for b in run(iter(parts)) for r in b.to_pylist()]
    assert len(got) == 18 and 0 < len(calls) <= 2 * (len(parts) + 3)
    assert sum(r["doc_id"] is None for r in got) == 3
    for r in got:
        if r["doc_id"] is not None:
            assert r["n_known"] == 1 + known[r["doc_id"]] and r["base_score"] == pytest.approx(1 + base[r["doc_id"]], abs=1e-9)
