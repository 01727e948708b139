import tracemalloc
from unittest import mock

import numpy as np
import pyarrow as pa

from tidemark.llm import decontaminate, kneser_ney, textblock, toxicity
from tidemark.llm.common import in_steps


def _batch(n, seed=3):
    rng = np.random.default_rng(seed)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (5000, 6))])
    return pa.record_batch({"text": [" ".join(rng.choice(words, 350)) for _ in range(n)]})


def _peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_step_takes_little_beside_its_batch():
    batch, net = _batch(1000), toxicity.BiGru()
    assert _peak_mb(lambda: [decontaminate.words_of(s.column(0)) for s in in_steps(iter([batch]))]) < 50
    assert _peak_mb(lambda: [toxicity.score_texts(net, s.column(0)) for s in in_steps(iter([batch]))]) < 70


def _counted(batch):
    """What a task that counts n-grams makes of a batch."""

    class Frame:
        def mapInArrow(self, run, _):
            self.run = run
            return self

        def select(self, *_):
            return self

        groupBy = agg = select

    frame = Frame()
    with mock.patch.object(kneser_ney, "F"):
        kneser_ney.count_grams(frame)
    return frame.run(iter([batch]))


def test_counted_n_grams_pass_on_in_pieces():
    """Of a task's n-grams only a piece at a time becomes a batch of strings; the strings are those of the code points."""

    text = "".join(map(chr, np.random.default_rng(5).integers(0x4E00, 0x9FFF, 250_000)))
    batch = pa.record_batch({"text": [text, "añ漢\U0001f600b"], "lang": ["zh", None]})
    found = list(_counted(batch))
    assert max(b.num_rows for b in found) <= kneser_ney.ROWS
    padded = kneser_ney.START * 4 + text
    grams = [g for b in found for g, x in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True) if x == "zh"]
    assert set(grams) == {padded[k : k + 5] for k in range(len(text))} and len(grams) == len(set(grams))
    assert "añ漢\U0001f600b" in [g for b in found for g in b.column(1).to_pylist()]


def test_a_long_text_leaves_no_powers_behind():
    text = "word " * 600_000
    hashes = decontaminate.words_of(pa.array([text]))[-1]
    assert len(set(hashes.tolist())) == 1 and hashes[0] == decontaminate.words_of(pa.array(["word"]))[-1][0]
    assert len(textblock._powers(10)[0]) <= textblock.KEPT_POWERS


def test_windows_score_alike_in_any_company():
    batch, net = _batch(40), toxicity.BiGru()
    texts = batch.column(0)
    alone = np.concatenate([toxicity.score_texts(net, texts.slice(k, 1)) for k in range(len(texts))])
    assert np.allclose(toxicity.score_texts(net, texts), alone, atol=1e-6)
