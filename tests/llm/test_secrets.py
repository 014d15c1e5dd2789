import hashlib
import math
import random
import re

import numpy as np
import pytest

from strata.llm import secrets as S
from strata.llm.secrets import redact_secrets, scan_secrets

from .helpers import doc, frame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(spans)]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_base_spans_by_definition(spark):
    rng = random.Random(3)
    bits = ["password=", "PassWd : '", 'secret":"', "token=token:", "api_key = ", "apikey=", "AKIA", "AKIAAKIA", "é😀", " ", "\n",
            "0123456789abcdef", "deadbeef" * 4, "ABCDEFGHIJKLM", "hunter2hunter2", "x.y=/+-_", "f" * 31, "'", "ſecret=abcdefghi"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = rows(scan_secrets(frame(spark, [doc(i, t) for i, t in enumerate(texts)])))
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("random")] == want
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(
            sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))


def normal_tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def p_value(run, alphabet):
    """The battery by definition."""
    n = len(run)
    groups, classes = S.symbol_groups(alphabet), S.symbol_classes(alphabet)
    assert sorted("".join(groups)) == sorted("".join(classes)) == sorted(alphabet)
    chi = sum((sum(c in g for c in run) - n * len(g) / len(alphabet)) ** 2 / (n * len(g) / len(alphabet)) for g in groups)
    df = len(groups) - 1
    sides = [normal_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))]
    kind = [next(i for i, g in enumerate(classes) if c in g) for c in run]
    f = [len(g) / len(alphabet) for g in classes]
    two, three = sum(x ** 2 for x in f), sum(x ** 3 for x in f)
    same = sum(a == b for a, b in zip(kind, kind[1:]))
    sides.append(2 * normal_tail(abs(same - (n - 1) * two) / math.sqrt((n - 1) * two * (1 - two) + 2 * (n - 2) * (three - two ** 2))))
    x = np.array([alphabet.index(c) for c in run], float)
    x -= x.mean()
    sides.append(2 * normal_tail(abs(((x[1:] * x[:-1]).sum() / (x * x).sum() + 1 / n) * math.sqrt(n))) if (x * x).sum() > 1e-6 else 0.0)
    h = sum(-math.log(max(min(s, 1.0), 1e-12)) for s in sides)
    return math.exp(-h) * (1 + h + h * h / 2)


ENCODINGS = [(0, S.HEX_ALPHABET, str), (0, S.HEX_ALPHABET, str.upper), (1, S.B32_ALPHABET, str), (1, S.B32_ALPHABET, str.upper),
             (2, S.B36_ALPHABET, str), (2, S.B36_ALPHABET, str.upper), (3, S.B64_ALPHABET, str)]


def candidates(spark, runs):
    found = S.find_spans(frame(spark, [doc(i, f"x {r} y") for i, r in enumerate(runs)]))
    return {r.doc_id: r._cand for r in found.collect()}


def test_p_values_by_definition(spark):
    rng = random.Random(4)
    runs, want = [], []
    for i in range(140):
        enc, alphabet, case = ENCODINGS[i % 7]
        run = "".join(rng.choice(alphabet) for _ in range(rng.randrange(24, 31 if enc == 0 else 120)))
        if i % 3 == 0:
            run = run[:6] + "e" * (len(run) - 6) if enc != 3 else run[:6] + "Ee" * ((len(run) - 6) // 2)
        runs.append(case(run))
        want.append((enc, p_value(run, alphabet)))
    got = candidates(spark, runs)
    seen = 0
    for i, (enc, p) in enumerate(want):
        for c in got[i] or []:
            band = sum(len(runs[i]) >= b for b in S.BANDS[1:])
            if c.stratum == enc * len(S.BANDS) + band:  # a run may also fit a narrower alphabet
                assert c.p == pytest.approx(p, rel=0.02, abs=2e-6), runs[i]
                assert c.bin == min(int(-math.log10(c.p) / S.BIN_WIDTH), S.BINS)
                seen += 1
    assert seen > 110


def cut_by_definition(bins, q):
    """The threshold of one stratum, from the bins of its runs."""
    m, even = len(bins), sum(b < S.EVEN_BINS for b in bins) / (1 - 10 ** (-S.EVEN_BINS * S.BIN_WIDTH))
    limit = next((b for b in sorted(set(bins)) if 10 ** (-b * S.BIN_WIDTH) * m <= q * sum(x >= b for x in bins)), S.BINS + 1)
    here = [b for b in sorted(set(bins)) if b < limit]
    cut = 0
    for b, after in zip(here, [*here[1:], limit]):
        upto = sum(x <= b for x in bins)
        if b < S.EVEN_BINS or upto - even * (1 - 10 ** (-(b + 1) * S.BIN_WIDTH)) <= q * upto + 2 * math.sqrt(upto):
            cut = max(cut, min(after, limit))
    return cut


def test_thresholds_by_definition(spark):
    rng = random.Random(12)
    strata = {s: [min(int(-math.log10(rng.random() ** rng.choice(power)) / S.BIN_WIDTH), S.BINS) for _ in range(size)]
              for s, (size, power) in enumerate([(1, [1]), (40, [1]), (400, [1, 9]), (300, [2]), (50, [30]), (900, [1, 1, 3])])}
    rows = [([(0, 1, s, b, 0.5)],) for s, bins in strata.items() for b in bins]
    found = spark.createDataFrame(rows, "_cand array<struct<start:bigint,end:bigint,stratum:int,bin:int,p:double>>")
    got = {r.stratum: r.first_bin for r in S.thresholds(found, 0.01).collect()}
    assert got == {s: cut_by_definition(bins, 0.01) for s, bins in strata.items()}


def test_random_strings_of_every_alphabet_are_found(spark):
    rng = random.Random(9)
    runs = [case("".join(rng.choice(alphabet) for _ in range(size))) for size in (24, 31, 40) for _, alphabet, case in ENCODINGS
            for _ in range(40) if alphabet != S.HEX_ALPHABET or size < 32]
    words = [f"{a}{b}{i:04d}{c}{d}{i % 97:05d}Item" for i, (a, b, c, d) in enumerate(
        (rng.choice(["Order", "Invoice", "Customer"]), rng.choice(["Line", "Entry"]), rng.choice(["Shipment", "Return"]),
         rng.choice(["Batch", "Parcel"])) for _ in range(400))]
    words += [f"/usr/local/share/Project{i}/Module{i % 7}/index" for i in range(200)]
    words += ["plainlowercaseletterswithoutdigits", "12345678901234567890123", "Aa1" * 20, "state-of-the-art-and-more"]
    got = rows(scan_secrets(frame(spark, [doc(i, f"x {t} y") for i, t in enumerate(runs + words)])))
    hit = [bool(got[i].spans) for i in range(len(runs + words))]
    found, false = sum(hit[:len(runs)]), sum(hit[len(runs):])
    assert found >= 0.9 * len(runs), found / len(runs)
    assert false <= 0.02 * (found + false), false


def test_edges_and_redaction(spark, edge_docs, edge_rows, no_docs):
    out = scan_secrets(edge_docs).collect()
    assert len(out) == len(edge_rows)
    assert all(r.spans == "" for r in out)
    assert scan_secrets(no_docs).collect() == [] == redact_secrets(no_docs).collect()
    same = redact_secrets(edge_docs)
    assert same.schema.names == edge_docs.schema.names
    assert sorted(map(repr, same.collect())) == sorted(map(repr, edge_docs.collect()))
    text = 'a é token="' + "0123456789abcdef" * 2 + '" b AKIA' + "Z" * 16
    got = redact_secrets(frame(spark, [doc(1, text), doc(2, "AKIA" + "Q" * 12)])).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in got} == {1: ('a é [SECRET]" b [SECRET]', 24), 2: ("[SECRET]", 8)}


def test_many_matches_in_a_long_text(spark):
    text = " ".join(f"{i:032x}" for i in range(3000))
    got = scan_secrets(frame(spark, [doc(1, text)])).first()
    assert got.n_hex == 3000
    assert got.base_sha256 == hashlib.sha256(",".join(base(text)).encode()).hexdigest()
