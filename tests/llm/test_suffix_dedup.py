import hashlib
import random

import pytest

from strata.llm import suffix_dedup as S

from .helpers import doc, frame


def texts_with_repeats(rng):
    def noise(n):
        return "".join(rng.choice("abcdefgh é😀") for _ in range(n))
    shared = [noise(n) for n in (199, 200, 201, 260, 700)]
    out = []
    for _ in range(40):
        out.append("".join(noise(rng.randrange(0, 300)) + rng.choice(shared)[rng.randrange(0, 30):] for _ in range(rng.randrange(1, 4))))
    t = noise(900)
    out += [t, t, t[:450], t[3:], noise(500), "a" * 1500, "ab" * 199, "a" * 199, "a" * 200, "", None, noise(199)]
    u = noise(250)
    return out + [u + noise(9) + u]


@pytest.mark.parametrize("segment", [1 << 18, 300])
def test_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    texts = texts_with_repeats(random.Random(6))
    raws = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in S.remove_repeats(frame(spark, [doc(i, t) for i, t in enumerate(texts)]), with_bytes=True).collect()}
    for i, (raw, spans) in enumerate(zip(raws, S.brute_force(raws))):
        ends = [0] + [b for _, b in spans]
        kept = b"".join(raw[a:b] for a, b in zip(ends, [a for a, _ in spans] + [len(raw)]))
        assert [(s.start, s.end) for s in got[i].spans] == spans, i
        assert (got[i].n_bytes, bytes(got[i].kept), got[i].kept_sha256) == (len(raw), kept, hashlib.sha256(kept).hexdigest())


def test_every_window_has_one_anchor_by_its_content():
    rng = random.Random(2)
    shared = bytes(rng.randrange(97, 101) for _ in range(400))
    raws = [bytes(rng.randrange(97, 101) for _ in range(n)) + shared for n in (0, 1, 333)]
    picks = []
    for raw in raws:
        _, first, last, pick = S.anchors([raw])
        window = {s: p for a, b, p in zip(first, last, pick) for s in range(a, b + 1)}
        assert sorted(window) == list(range(len(raw) - S.WIDTH + 1))
        base = len(raw) - 400
        picks.append([window[base + s] - base for s in range(201)])
    assert picks[0] == picks[1] == picks[2]


def test_edges(spark, edge_docs, edge_rows, no_docs):
    rows = S.repeats_report(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    got = {r.doc_id: r for r in rows}
    for i in (8, 9, 11):
        assert got[i].n_removed == got[i].n_bytes > 200 and got[i].n_spans == 1
        assert got[i].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[0].n_bytes, got[0].n_spans) == (0, 0)
    assert S.repeats_report(no_docs).collect() == []


def test_texts_are_searched_together():
    """Runs and windows of many texts come in one batch per SEGMENT bytes, with the spans of each text."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    from strata.llm import suffix_dedup as sd
    rng = np.random.default_rng(3)
    shared = rng.bytes(700)
    raws = [rng.bytes(300) + shared[:250 + 40 * i] + rng.bytes(90 * i) for i in range(9)] + [b"", b"short", shared, rng.bytes(400)]
    anchored = [sd.anchors([r])[1:3] for r in raws]
    count = {}
    for r in raws:
        for s in range(len(r) - sd.WIDTH + 1):
            count[r[s:s + sd.WIDTH]] = count.get(r[s:s + sd.WIDTH], 0) + 1
    alone = [[s for s in range(len(r) - sd.WIDTH + 1) if count[r[s:s + sd.WIDTH]] == 1] for r in raws]
    runs = [[a for a, b in zip(*(x.tolist() for x in own)) if set(range(a, b + 1)) <= set(w)] for own, w in zip(anchored, alone)]
    text, start, end = sd.repeated_spans(raws, [r or None for r in runs], alone)
    assert [[(a, b) for t, a, b in zip(text, start, end) if t == i] for i in range(len(raws))] == sd.brute_force(raws)
    pack = zstandard.ZstdCompressor()
    z = pa.array([pack.compress(r) for r in raws], pa.binary())
    reps = [[{"lo": int(a), "m": 1} for a in own[0]] for own in anchored]
    made = list(sd._window_rows([pa.RecordBatch.from_arrays([pa.array(range(len(raws))), z, pa.array(reps)], names=["rid", "z", "reps"])]))
    assert len(made) == 1 and made[0].num_rows == sum(max(0, len(r) - sd.WIDTH + 1) for r in raws)
    assert len(list(sd._finish([pa.RecordBatch.from_arrays([pa.array(range(len(raws))), z, pa.array(runs), pa.array(alone)],
                                                           names=["key", "z", "runs", "windows"])], False))) == 1
