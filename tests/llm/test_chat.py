from strata.llm.chat import rotate_perspectives

SCHEMA = "conv_id long, turn long, role string, text string, part long, mask string"


def conv(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)


def test_every_speaker_gets_a_perspective(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé"), (1, 2, "bob", "yo"), (1, 3, "cy", ""), (1, 4, "ann", "bye")]
    got = {r.perspective: r for r in rotate_perspectives(conv(spark, rows)).collect()}
    assert set(got) == {"ann", "bob", "cy"}
    assert got["bob"].text == ("<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhé<|end|>\n<|assistant|>\nyo<|end|>\n"
                               "<|user name=cy|>\n<|end|>\n<|user name=ann|>\nbye<|end|>\n")
    for who, r in got.items():
        learnt = [r.text[int(a):int(b)] for a, b in (s.split(":") for s in r.mask.split(","))]
        assert learnt == [t + "<|end|>\n" for _, _, role, t in rows if role == who]


def test_parts_and_edges(spark):
    rows = [(1, i, f"p{i % 2}", "x" * i) for i in range(200)]
    rows += [(2, 0, None, "who"), (2, 0, None, "who"), (2, None, "u", None), (None, 1, "u", "lost"), (3, 0, "system", "only")]
    out = rotate_perspectives(conv(spark, rows), part_turns=64).collect()
    parts = sorted((r.perspective, r.part, r.n_messages) for r in out if r.conv_id == 1)
    assert parts == [(p, k, n) for p in ("p0", "p1") for k, n in enumerate((64, 64, 64, 8))]
    two = {r.perspective: r for r in out if r.conv_id == 2}
    assert two["u"].text == "<|assistant|>\n<|end|>\n<|user name=unknown|>\nwho<|end|>\n"
    assert two["unknown"].n_messages == 2
    assert [r.text for r in out if r.conv_id is None] == ["<|assistant|>\nlost<|end|>\n"]
    assert not [r for r in out if r.conv_id == 3]
    assert rotate_perspectives(conv(spark, [])).collect() == []


def test_no_part_is_longer_whatever_the_turns(spark):
    rows = [(1, 0, f"p{i % 2}", f"same turn {i:03}") for i in range(150)]                # repeated turns
    rows += [(1, 10 + i % 30, "p0", f"late {i:03}") for i in range(60)] + [(1, 64, "p1", "next"), (1, 300, "p0", "end")]
    rows += [(2, None, "u", f"no turn {i:03}") for i in range(100)] + [(2, -i, "u", "minus") for i in range(1, 100)]
    rows += [(None, i % 5, "u", f"lost {i:03}") for i in range(130)] + [(None, 0, "u", "lost 000")] * 70
    rows += [(4, 0, "u", "same")] * 200 + [(4, 64, "u", "b"), (5, 0, "u", "a"), (5, 130, "u", "b")]
    out = rotate_perspectives(conv(spark, rows)).collect()
    assert max(r.n_messages for r in out) == 64
    parts = lambda c, p: [(r.part, r.n_messages) for r in sorted(out, key=lambda r: r.part) if (r.conv_id, r.perspective) == (c, p)]
    assert parts(1, "p0") == parts(1, "p1") == [(0, 64), (1, 64), (2, 64), (3, 18), (4, 1), (7, 1)]
    assert parts(2, "u") == [(0, 64), (1, 64), (2, 64), (3, 7)]
    assert parts(None, "u") == [(0, 64), (1, 64), (2, 2)]
    assert parts(4, "u") == [(0, 1), (1, 1)] and parts(5, "u") == [(0, 1), (2, 1)]
    for c in (1, 2, None, 4):
        first = lambda m: (m[1] is not None, m[1] or 0, m[2], m[3])
        own = sorted({r for r in rows if r[0] == c}, key=first)
        for who in {r[2] for r in own}:
            text = "".join(r.text for r in sorted(out, key=lambda r: r.part) if (r.conv_id, r.perspective) == (c, who))
            heads = {who: "<|assistant|>\n"}
            assert text == "".join(heads.get(m[2], f"<|user name={m[2]}|>\n") + m[3] + "<|end|>\n" for m in own)
