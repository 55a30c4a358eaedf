"""Suffix arrays, common prefixes and removal against brute force."""

import random

import numpy as np
import pytest

from tidewake.llm import repeats, suffix_array as sa


def strings():
    rng = random.Random(8)
    yield from (b"", b"a", b"aa", b"banana", b"mississippi", b"\xff\x00" * 20, b"abcabcabc" * 9, b"a" * 100)
    for _ in range(200):
        yield bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randint(1, 80)))
    yield bytes(rng.randrange(256) for _ in range(6000))
    yield bytes(rng.choice(b"abc") for _ in range(3000)) * 3
    yield b" ".join(rng.choice([b"the", b"of", b"tion", b"er"]) for _ in range(5000))


def test_suffix_arrays():
    for text in strings():
        values = np.frombuffer(text, np.uint8)
        order = sa.suffix_array(values)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        got = sa.common_prefixes(values.astype(np.uint16), order)
        for a, b in zip(want, want[1:]):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert got[b] == k


def slow(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), kept))
    return out


def corpus(length):
    rng = random.Random(11)

    def words(n):
        return " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    base, line = words(120), words(8)
    texts = [None, "", "short", "x" * (length - 1), "y" * length, "z" * (3 * length), base, base, words(150) + base[100:500] + words(20)]
    for _ in range(30):                                   # near copies with an edit each
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice("XYZ") + base[at + 1:])
    for _ in range(20):                                   # a common passage in different places
        texts.append(words(rng.randint(5, 60)) + line + words(rng.randint(5, 60)))
    texts += [(line + "\n") * 40, (line + "\n") * 25 + "tail", words(3000)]
    return texts


@pytest.mark.parametrize("length,pieces", [(200, 2048), (40, 3)])
def test_operator(spark, monkeypatch, length, pieces):
    monkeypatch.setattr(repeats, "ANCHOR_PIECES", pieces)
    texts = corpus(length)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "N" * 50, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_BYTES string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.drop_repeats(df, length=length).collect()}
    want = slow([(t or "").encode() for _, t, _ in rows], length)
    assert len(got) == len(rows)
    for (key, _, _), w in zip(rows, want):
        assert got[key] == w, key
    assert repeats.drop_repeats(df.limit(0), length=length).count() == 0


def test_blocks_and_hot_anchors(monkeypatch):
    """Cutting texts into small blocks and salting do not lose a window."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
    texts = [(t or "").encode() for t in corpus(200)]
    number, start, windows, anchor, content, sides = repeats.pieces_of(texts)
    covered = {(int(i), int(s) + k) for i, s, n in zip(number, start, windows) for k in range(n)}
    assert covered == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 199)} and len(covered) == windows.sum()
    by_window = {}
    for i, s, n, a in zip(number.tolist(), start.tolist(), windows.tolist(), anchor.tolist()):
        for k in range(s, s + n):
            assert by_window.setdefault(texts[i][k:k + 200], a) == a
    shared = {}                                           # pieces with an equal window share a side
    for k, (i, s, n) in enumerate(zip(number.tolist(), start.tolist(), windows.tolist())):
        for w in range(s, s + n):
            shared.setdefault(texts[i][w:w + 200], set()).add(k)
    both = [(int(x) >> 32 & 0xFFFFFFFF, int(x) & 0xFFFFFFFF) for x in sides]
    for ks in shared.values():
        for k in ks:
            assert all((both[k][0] and both[k][0] == both[j][0]) or (both[k][1] and both[k][1] == both[j][1]) for j in ks)
    runs = repeats.repeated_windows(texts)
    want = slow(texts, 200)
    for t, found, (_, gone, _, _) in zip(texts, runs, want):
        mask = bytearray(len(t))
        for a, b in found:
            mask[a:b + 199] = b"\x01" * (b + 199 - a)
        assert sum(mask) == gone
