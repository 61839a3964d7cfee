"""Parts that run without Spark: closed forms and brute force."""

import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import digest, htmltext, linededup, media, packing, piecetokens, simhash, substrings
from tessera.llm.suffixarray import suffix_array

TEXTS = st.text(st.sampled_from("ab \n▁é漢😀.'<|"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60) | st.lists(st.integers(0, 2), max_size=40).map(bytes))
def test_suffix_array_is_sorted(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_integers():
    s = [300, 5, 300, 5, 256]
    assert suffix_array(s) == sorted(range(5), key=lambda i: s[i:])


def words_file():
    return packing.tokenizer_file()


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_word_ids_are_those_of_the_library(texts):
    w = packing.words_of(words_file())
    ids, sizes = w.encode(pa.array(texts, pa.string()))
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == w.t.encode(t, add_special_tokens=False).ids
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS | st.just("a" * 200), max_size=5))
def test_piece_ids_are_those_of_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piecetokens.tokenizer_file())
    tokens = piecetokens.tokens_of(piecetokens.tokenizer_file())
    ids, sizes = tokens.encode(pa.array(texts, pa.string()))
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == sp.encode(t)
        at += n
    assert tokens.decode(ids, sizes) == [t.replace("▁", " ") for t in texts]


def test_ids_of_long_words_are_those_of_the_library(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piecetokens.tokenizer_file())
    r = random.Random(6)
    texts = ["".join(r.choices("etaoinshrdluéßжи的一是不了人我在有他這x=/é🙂", k=n)) for n in (40_000, 3_000, 50)] + ["ab" * 20_000, "x" * 3_000]
    for most in (piecetokens.WORD_CHARS, 20):
        monkeypatch.setattr(piecetokens, "WORD_CHARS", most)
        tokens = piecetokens.PieceTokens(piecetokens.tokenizer_file())
        assert sum(1 for _ in tokens.parts(texts[0])) > 1
        ids, sizes = tokens.encode(pa.array(texts + texts[:1]))
        assert np.split(ids, np.cumsum(sizes)[:-1])[1].tolist() == sp.encode(texts[1])
        assert ids.tolist() == [i for t in texts + texts[:1] for i in sp.encode(t)]


def test_best_fit_by_brute_force():
    r = random.Random(4)
    fit, free = packing.BestFit(100, 10_000), {}
    for _ in range(3000):
        size = r.randint(1, 100)
        best = min((f for f in free.values() if f >= size), default=100)
        at, offset = fit.add(size)
        assert offset == 100 - best
        free[at] = free.get(at, 100) - size
        assert free[at] >= 0


def test_the_fullest_bin_closes_first():
    fit = packing.BestFit(10, 2)
    assert [fit.add(n)[0] for n in (6, 7, 8)] == [0, 1, 2]  # the third bin is the fullest: it closes
    assert fit.add(2) == (1, 7) and fit.n_open == 2


def test_fingerprint_by_bits():
    text = "The cat\tSAT on the  mat now"
    ws = [w for w in text.replace("\t", " ").split(" ") if w]
    ws = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in ws]
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(len(ws) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == want
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"one two") & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two", 42)


def test_canonical_forms():
    assert digest.canonical("  Ｆｏｏ BAR\n") == "foo bar"
    assert digest.canonical("Straße") == digest.canonical("STRASSE")
    assert digest.canonical("é") == digest.canonical("É")
    assert digest.edited("abcdef", "xy") == "abcxy" and digest.edited("a", "xy") == "a" and digest.edited("abc", "wxyz") == "abw"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("pqrstu"), max_size=14), st.lists(st.sampled_from("pqrstu"), max_size=14))
def test_alignment_keeps_both_orders(a, b):
    seen, at = {}, {}
    for i, x in enumerate(a):
        at[x, seen.get(x, 0)] = i
        seen[x] = seen.get(x, 0) + 1
    pairs, mine = [], {}
    for j, x in enumerate(b):
        k = mine.get(x, 0)
        if (x, k) in at:
            pairs.append((j, at[x, k], a.count(x) == 1 and b.count(x) == 1))
        mine[x] = k + 1
    if not pairs:
        return
    out = linededup.aligned(pairs)
    to = {j: i for j, i, _ in pairs}
    assert len(set(out)) == len(out) and [to[j] for j in sorted(out)] == sorted(to[j] for j in out)
    if a == b:
        assert sorted(out) == list(range(len(b)))


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_media_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and len(payload) > 0
    assert media.from_png(media.to_png(payload)).tobytes() == payload


def test_damaged_media_are_told():
    png = bytearray(media.to_png(media.padded(b"abc" * 400)))
    png[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(png))


def test_cells_cover_each_window_once():
    r = random.Random(1)
    for text in (bytes(r.choices(b"ab ", k=700)), b"to " * 400, bytes(r.choices(range(32, 120), k=900)), b"x" * 49, b"x" * 50):
        got = sorted((a, z) for _, _, s, e in substrings.cells(text) for a, z in zip(s.tolist(), e.tolist(), strict=True))
        assert [i for a, z in got for i in range(a, z + 1)] == list(range(max(0, len(text) - 49)))


def test_blocks_of_broken_markup():
    page = "<html><head><title>t</title></head><body><p>a &amp; b<br>c<p><b>d<div>e</b></div><script>x='</p>'</script><ul><li>f<li>g</ul>h &copy;<!-- no --><p hidden>i"
    assert [b.text for b in htmltext.leaf_blocks(page)] == ["a & b c", "d", "e", "f", "g", "h ©", "i"]
    assert htmltext.leaf_blocks("") == [] and htmltext.leaf_blocks("a < b <") != []


def test_field_decodes_the_likeliest_states():
    from itertools import product

    r = random.Random(2)
    model = htmltext.Field({"a": 1.2, "b": -0.7, "c": 0.1}, np.array([[0.5, -0.4], [-0.3, 0.6]]), np.array([0.1, -0.2]), np.array([0.3, 0.0]))
    for _ in range(30):
        fs = [[r.choice("abc") for _ in range(2)] for _ in range(6)]

        def score(y):
            s = model.first[y[0]] + model.last[y[-1]] + sum(model.weights[k] for f, x in zip(fs, y, strict=True) if x for k in f)
            return s + sum(model.pairs[a][b] for a, b in zip(y, y[1:], strict=False))

        best = max(product((0, 1), repeat=6), key=score)
        assert score(tuple(map(int, model.decode(fs)))) == pytest.approx(score(best))


def test_field_on_pages_it_has_not_seen():
    model = htmltext.trained(300, 120)
    right = total = 0
    for page, labels in htmltext.labelled_pages(60, seed=99):
        got = model.decode(htmltext.described(htmltext.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_nfkc_is_stable_for_canonical_forms():
    for t in ("ﬁﬂ ① Ⅷ", "Å Å", "ς Σ"):
        c = digest.canonical(t)
        assert unicodedata.normalize("NFKC", c) == c and digest.canonical(c) == c


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><meta charset=x><style>a{}</style><body><p>one</p>", ["one"]),
        ("<head><title>T</title></head><header>q</header><p>one</p>", ["q", "one"]),
        ("<p>a <svg width='1'/> b</p><p>c <svg/> d</p>", ["a b", "c d"]),
        ("<p>a <svg><text>no</text></svg> b</p>", ["a b"]),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>", ["let x=2 be"]),
    ],
)
def test_silent_elements_end(page, want):
    assert [b.text for b in htmltext.leaf_blocks(page)] == want
