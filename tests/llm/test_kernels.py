"""The operators' kernels against brute force, without Spark."""

import itertools
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from attestra.llm import embed_dedup, html_text, minhash, packing, pii, quality, shingles, topk, url_filter, warc
from attestra.llm.common import byte_slices, local_components
from attestra.llm.sentencepiece_unigram import BYTE, CONTROL, MARKER, NORMAL, UNKNOWN, Model
from attestra.llm.tokens import ChunkIds



# --- common
def test_byte_slices_hold_every_text_once():
    texts = pa.array(["a" * 10, None, "", "b" * 30, "c", "d" * 5, "e"])
    for given in (texts, texts.slice(2), texts.slice(0, 0)):
        for most in (1, 6, 1000):
            parts = list(byte_slices(given, most))
            assert pa.concat_arrays(parts).equals(given)
            assert all(len(p) <= 1 or sum(len(t or "") for t in p.to_pylist()) <= most for p in parts)


def test_local_components():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 12)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 10))]
        root = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        a, b = (np.array([p[k] for p in pairs], int) for k in (0, 1))
        assert local_components(n, a, b).tolist() == root


# --- 1
def _vocabulary(bytes_too=True):
    words = ["a", "b", "c", MARKER, MARKER + "a", "ab", "bc", "abc", MARKER + "abc", "é", MARKER * 2]
    scores = [-3.1, -3.3, -3.9, -2.2, -2.75, -4.05, -4.4, -5.3, -4.15, -6.0, -3.05]
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL)] + ([(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)] if bytes_too else [])
    return Model(pieces + [(w, s, NORMAL) for w, s in zip(words, scores, strict=True)])


def _best_score(m, text):
    known = {p[0]: s for p, s in zip(m.pieces, m.scores, strict=True) if p[2] == NORMAL}
    best = [0.0] + [-1e18] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            s = known.get(text[start:end], m.unknown_score if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def _message(*fields):
    """A protocol buffer message of numbers, floats and bytes by field."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_model_files_encode_as_the_public_library_does(tmp_path):
    import sentencepiece

    rng = random.Random(11)
    words = ["the", "house", "houses", "use", "s", "of", "\u2581the", "\u2581house", "\u2581of", "\u2581", "\u2581\u2581", "é", "ho", "us", "es", *"abcdefghijklmnopqrstuvwxyz"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((w, -rng.uniform(1, 9), 1) for w in dict.fromkeys(words))]
    made = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, kind)))) for p, s, kind in pieces)
    made += _message((2, _message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2)))) + _message((3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "unigram.model"
    path.write_bytes(made)
    theirs, own = sentencepiece.SentencePieceProcessor(model_proto=made), Model.read(str(path))
    assert own.scores[own.pieces.index(next(p for p in own.pieces if p[0] == "the"))] < 0
    texts = ["the houses of the house", "", "  two  spaces ", "ééxé 1\n漢", *("".join(rng.choices("the ousxyfé 漢", k=30)) for _ in range(300))]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == theirs.encode(text), text
        assert own.decode(ids) == text


def test_sentencepiece_finds_the_best_path_and_round_trips():
    m, rng = _vocabulary(), random.Random(3)
    texts = ["".join(rng.choices("abcé z\n☃", k=rng.randint(0, 14))) for _ in range(300)] + ["", " ", "   ", "x" * 500, "abc" * 200]
    known = {k for k, p in enumerate(m.pieces) if p[2] == NORMAL}
    for text, ids in zip(texts, m.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert m.decode(ids) == text
        if text:
            spelled = MARKER + text.replace(" ", MARKER)
            unknown = sum(c not in m.single for c in spelled if c in "z\n☃x")
            score = sum(m.scores[k] for k in ids if k in known) + unknown * m.unknown_score
            assert score == pytest.approx(_best_score(m, spelled))
            assert m._search_one(spelled.encode()) == np.frombuffer(m._search([spelled.encode()])[0], "<i4").tolist()
    assert m.encode([None]) == [None]
    assert m.decode([2 + 0xFF]) == "�"
    plain = _vocabulary(False)
    assert plain.unknown in np.frombuffer(plain.encode(["z"])[0], "<i4").tolist()


# --- 2
def test_chunked_framing_and_damaged_records():
    for n in (0, 1, 8191, 8192, 8193, 30_000):
        payload = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(payload)) == payload
    for broken in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", warc.chunked(b"abc")[:-4]):
        with pytest.raises(ValueError):
            warc.unchunked(broken)
    records = list(warc._records("7", "http://x", b"q" * 50_000, False, 1000))
    raw = b"".join(r + b"\r\n" for r in records)
    parsed = list(warc.parse(raw))
    assert len(parsed) == len(records) > 50 and not any(p[2] for p in parsed)
    assert b"".join(p[1] for p in parsed).startswith(b"HTTP/1.1 200 OK")
    assert list(warc.parse(raw[:-1]))[-1][2] == "record framing"
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"x"), "sha1:WRONG")[1] == "digest"


# --- 3
def test_threshold_algorithm():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, m, d, k = (int(rng.integers(*r)) for r in ((0, 60), (1, 8), (1, 6), (1, 9)))
        lists, queries = rng.integers(-3, 4, (n, d)).astype(float), rng.integers(-3, 4, (m, d)).astype(float)
        own = np.where(rng.random(m) < 0.5, rng.integers(0, max(n, 1), m), -1) if n else np.full(m, -1)
        best, scores, _ = topk.threshold_top_k(lists, queries, own, k)
        for q in range(m):
            expect = sorted((-int(lists[i] @ queries[q]), i) for i in range(n) if i != own[q])[:k]
            assert [(-int(scores[q, j]), int(best[q, j])) for j in range(k) if best[q, j] >= 0] == expect
    spread = np.zeros((4000, 2))
    spread[:, 0] = np.arange(4000)
    assert topk.threshold_top_k(spread, np.array([[1.0, 0.0]]), np.array([-1]), 5)[2] < 400  # stops early


# --- 4
def _least_bins(items, capacity):
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for at in {b: i for i, b in enumerate(bins) if b >= items[k]}.values():
            bins[at] -= items[k]
            go(k + 1, bins)
            bins[at] += items[k]
        go(k + 1, [*bins, capacity - items[k]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_plan_places_every_item_and_reduction_is_safe():
    rng = np.random.default_rng(0)
    for _ in range(120):
        capacity = int(rng.integers(5, 30))
        items = rng.integers(1, capacity + 1, int(rng.integers(0, 10))).tolist()
        counts = {x: items.count(x) for x in set(items)}
        made = packing.plan(counts, capacity)
        bins = [[] for _ in range(made.bins)]
        used = dict.fromkeys(counts, 0)
        for length, lo, n, first, offset in made.entries:
            assert used[length] == lo
            used[length] += n
            for b in range(first, first + n):
                bins[b].append((offset, length))
        assert used == counts
        for b in bins:
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert 0 < at <= capacity
        assert made.bins - _least_bins(items, capacity) in (0, 1)
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_chunk_ids_are_those_of_the_tokenizer():
    known = ChunkIds(public_tokenizers.path("word_bpe_49k.json"), most=64)
    texts = ["Hello  world, it's ÉTÉ!! 12", "", None, "a\x1cb c", "ΣΑΣ <|endoftext|>x ½ Ⅳ é", "x" * 500, "日本語🙂", "don't I'LL"] + [f"word{k} And{k}!!" for k in range(200)]
    for text, ids in zip(texts, known.packed(texts), strict=True):
        expect = known.encoder.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expect
        assert zlib.crc32(ids) == zlib.crc32(np.array(expect, "<u4").tobytes())


# --- 5
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text):
    out = []
    for kind, pattern in _PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "x_y", "1.2.3.4", "999.1.1.1", "4785 3805 9239 1139", "4785380592391139", "+1 (389) 555-5010", "+", "-", " ", "12", "é", "d@e-f.g@h.i", "00", "%"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == _plain_spans(text), text


def test_added_spans_context_and_redaction():
    assert pii.spans("IBAN GB82 WEST 1234 5698 7654 32 ok")[-1][0] == "iban"
    assert not [s for s in pii.spans("GB83 WEST 1234 5698 7654 32") if s[0] == "iban"]
    assert not pii.spans("123-45-6789") and pii.spans("ssn 123-45-6789")[0][0] == "ssn"
    assert pii.spans("call +1 (389) 555-5010")[0][3] > pii.spans("x +1 (389) 555-5010")[0][3]
    assert pii.redacted("to a@b.cd now") == "to <EMAIL> now" and pii.redacted("clean") == "clean"
    assert pii.spans(None) == pii.spans("") == [] and pii.redacted(None) is None
    for long in ("a" * 200_000, "1" * 200_000 + ".", "+1" + "(" * 200_000, "a@" * 50_000, "1.2." * 50_000):
        pii.spans(long)


def test_ibans_before_words_and_numbers():
    iban = "DE89 3704 0044 0532 0130 00"
    for after in ("", " BIC COBADEFFXXX", " 2024", " AND", " GB82 WEST 1234 5698 7654 32"):
        for before in ("", "AB12 "):
            text = before + iban + after
            found = [text[s[1] : s[2]] for s in pii.spans(text) if s[0] == "iban"]
            assert found == [iban, *([after[1:]] if after.startswith(" GB") else [])], text



# --- 6
@pytest.mark.parametrize("page,text", [
    (None, None), ("", ""), ("plain", "plain"), ("<p>one<p>two <b>x</b>", "one\n\ntwo x"), ("a<br>b", "a\nb"), ("<ul><li>a<li>b<ol><li>c</ol></ul>d", "- a\n- b\n  1. c\n\nd"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name    N\nlonger  1"), ("<table><tr><td colspan=2>w<td>z<tr><td>a<td>b<td>c</table>", "w     z\na  b  c"),
    ("<title>t</title><script>var s='</p>'</script><p hidden>no</p><p style='display:none'>no</p>yes &amp;", "yes &"), ("<pre> a\n  b</pre>", " a\n  b"),
    ("<!-- c -->x<!-- open", "x"), ("a < b", "a < b"), ("<p>a</div>b", "ab"), ("<table><tr><td>a<table><tr><td>x</table><td>b</table>", "a x  b"), ("<li>loose", "- loose"),
])
def test_page_text(page, text):
    assert html_text.page_text(page) == text


def test_page_text_is_linear():
    for page in ("<div>" * 50_000 + "x", "<!--" * 50_000, "<script>" * 20_000, "<p><table>" * 10_000, "</b>" * 30_000 + "<b>" * 30_000, "<p><button>" + "<div>" * 30_000, "<style>" + "/*" * 100_000, "<style>" + "@a{" * 50_000, "<style>" + ".a{display:none}" * 20_000 + "</style>" + "<b class=a>" * 20_000):
        html_text.page_text(page)


def test_large_tables_are_aligned():
    # hardly any padding, then none but what the text can bear, then far more
    dense = "<table>" + "".join(f"<tr><td>{'x' * (99 + k % 2)}<td>{'y' * 100}" for k in range(6000)) + "</table>"
    assert set(map(len, html_text.page_text(dense).split("\n"))) == {202}
    wide = lambda n: "<table><tr><td>" + "x" * n + "<td>y" + "<tr><td>a<td>b" * 20_000 + "</table>"
    assert html_text.page_text(wide(40)).split("\n")[-1] == "a" + " " * 41 + "b"
    assert html_text.page_text(wide(20_000)).endswith("\na\tb")


@pytest.mark.parametrize("page,text", [
    ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> holds", "so x=2 holds"),
    ("a<svg><title>t</title><defs><text>no</text></defs><style>s</style><g>no<text>one</text><text>two <tspan>three</tspan></text></g></svg>b", "a one two three b"),
    ("Size <select><option>S<option selected>M<option>L</select>.", "Size M ."), ("<select><optgroup label=g><option disabled>pick<option>S<option>M</select>", "S"),
    ("<select multiple><option>S<option>M</select>", "S\nM"), ("<pre>a <svg>no<text>b</text></svg></pre>", "a  b"), ("<select></select>x", "x"),
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f</table>", "a  b  c\n   d  e\nf"),
    ("<table><tbody><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>", "a  b    c\nd       e\nf  g"),
])
def test_page_text_of_formulas_drawings_choices_and_row_spans(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<p style='visibility:hidden'>a <b style='visibility:visible'>b</b> c</p>d", "b\n\nd"), ("<ol><li>a<li style='visibility:hidden'>b<li>c</ol>", "1. a\n3. c"),
    ("<table><tr><td style='visibility:hidden'>aa<td>b<tr><td>c<td>d</table>", "   b\nc  d"), ("<img alt=x>y<pre style='visibility:hidden'>a\n<b style='visibility:visible'>b</b></pre>", "y\n\nb"),
    ("<svg><g style='visibility:hidden'><text>a</text></g><text>b</text></svg>", "b"),
    ("<style>.x{display:none} p.y{visibility:hidden}</style><b>b</b><i class='a x'>no</i><p class=y>no</p><u class=y>u</u>", "b\n\nu"),
    ("<style>@media print{b{display:none}} @media screen{#q{display:none}}</style><b>b</b><i id=q>no</i>", "b"),
    ("<style>.x{display:none}</style><i class=x style='display:inline'>a</i><i hidden>no</i><i hidden style='display:block'>b</i>", "ab"),
    ("<style>.x{display:none!important}</style><i class=x style='display:inline'>no</i>z", "z"), ("<style>.a{display:none}.a{display:block}</style><a class=a>k</a>", "k"),
    ("<style>#i{display:inline}i{display:none}.c{display:none}</style><i id=i class=c>a</i><i>no</i>", "a"), ("<style>/* } */ a{display:none", ""), ("<style>a>b{display:none}</style><a><b>x</b></a>", "x"),
])
def test_page_text_by_style(page, text):
    assert html_text.page_text(page) == text


_HIDES = {"": "", "none": " style='display:none'", "off": " hidden", "hidden": " style='visibility:hidden'", "visible": " style='visibility:visible'", "sheet": " class=gone", "dim": " class='b dim'"}


def _some_tree(rng, kinds, deep):
    """A tree of (name, how it hides, children) and words."""
    kids = []
    for _ in range(rng.integers(1, 4)):
        name = rng.choice([*kinds, "word"]) if deep else "word"
        inside = {"div": ("div", "p", "ul", "span"), "p": ("span",), "span": ("span",), "ul": ()}.get(name, ())
        if name == "word":
            kids.append("w" + str(rng.integers(1000)))
        elif name == "ul":
            kids.append(_some_list(rng, deep))
        else:
            kids.append((name, rng.choice(list(_HIDES)) if rng.random() < 0.4 else "", _some_tree(rng, inside, deep - 1)))
    return kids


def _some_list(rng, deep):
    pick = lambda: rng.choice(list(_HIDES)) if rng.random() < 0.2 else ""
    return ("ul", pick(), [("li", pick(), ["i" + str(rng.integers(1000)), *([_some_list(rng, deep - 1)] if deep > 1 and rng.random() < 0.4 else [])]) for _ in range(rng.integers(1, 4))])


def _markup(x):
    return f" {x} " if isinstance(x, str) else f"<{x[0]}{_HIDES[x[1]]}>{''.join(map(_markup, x[2]))}</{x[0]}>"


def _naive_lines(nodes, shown, depth, out):
    """Adds words, "line" and "gap" marks to out, as (kind, text)."""
    for x in nodes:
        if isinstance(x, str):
            out += [("word", x)] if shown else []
            continue
        name, how, kids = x
        if how in ("none", "off", "sheet"):
            continue
        own = how not in ("hidden", "dim") and (how == "visible" or shown)
        edge = {"div": "line", "li": "line", "p": "gap", "ul": "line" if depth else "gap"}.get(name)
        out += [(edge, "")] if edge else []
        if name == "li":
            out.append(("mark", "  " * (depth - 1) + "- "))
        _naive_lines(kids, own, depth + (name == "ul"), out)
        out += [("unmark", "")] if name == "li" else []
        out += [(edge, "")] if edge else []


def _naive_text(nodes):
    marks, text, now, gap, mark = [], "", "", False, ""
    _naive_lines(nodes, True, 0, marks)
    for kind, s in [*marks, ("line", "")]:
        if kind == "word":
            now = f"{now} {s}" if now else mark + s
        elif kind in ("mark", "unmark"):
            mark = s
        else:
            if now:
                text += ("\n\n" if gap else "\n") * bool(text) + now
                now, gap, mark = "", False, ""
            gap = gap or kind == "gap"
    return text


def test_page_text_against_a_naive_renderer():
    rng = np.random.default_rng(5)
    seen = 0
    for _ in range(600):
        nodes = _some_tree(rng, ("div", "p", "ul", "span"), 4)
        want = _naive_text(nodes)
        seen += "- " in want and "\n\n" in want
        page = "<head><style>.gone{display:none}.dim{visibility:hidden}</style></head><body>" + "".join(map(_markup, nodes))
        assert html_text.page_text(page) == want, page
    assert seen > 50


# --- 7
def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.train(x[:4000], y[:4000], np.zeros((1, 1)))
    p = m.probabilities(x[4000:])
    assert ((p > 0.5) == y[4000:]).mean() > 0.9 and 0.25 <= m.temperature <= 8
    assert quality.train(x[:5], np.ones(5), np.zeros((1, 1))).probabilities(x).min() > 0.5
    assert quality.train(x[:0], y[:0], np.zeros((1, 1))).probabilities(x)[0] == pytest.approx(0.5)


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8000, 6))
    truth = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(8000) < truth).astype(float)
    m = quality.train(x[:4000], y[:4000], np.zeros((1, 1)))
    p = m.probabilities(x[4000:])
    # expected calibration error over ten bins of held-out rows, and against the network without its temperature
    error = lambda p: sum(abs(p[k].mean() - y[4000:][k].mean()) * k.mean() for e in range(10) if (k := (p * 10).astype(int).clip(0, 9) == e).any())
    plain = quality.Model(m.units, m.center, m.spread, m.layers, 1.0).probabilities(x[4000:])
    assert error(p) < 0.06 and error(p) <= error(plain) + 0.01 and m.temperature != 1.0


def test_words_and_shapes(monkeypatch):
    words, shapes = quality.words_of("The THE the 12 a!! é")
    assert words[0] == words[1] == words[2] and len(set(shapes[:3].tolist())) == 3 and shapes[5] == -1
    assert all(len(x) == 0 for x in quality.words_of(None)) and len(quality.words_of("a" * (2**21 + 3))[0]) == 1
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "C", "é", "12", "!?", " ", "\n"]) for _ in range(3000)) + "x" * 200 + " end"
    whole = quality.words_of(text)
    monkeypatch.setattr(quality, "_PART", 64)
    assert all((a == b).all() for a, b in zip(whole, quality.words_of(text), strict=True))
    monkeypatch.setattr(quality, "_POWER", quality._POWER[:100])
    long = quality.words_of(text)
    assert (long[0][:-2] == whole[0][:-2]).all() and len(long[0]) == len(whole[0])


def test_context_sums_against_loops(monkeypatch):
    monkeypatch.setattr(quality, "_PIECE", 7)
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["a", "B", "cc", "!", "9", "Dd"], k=rng.randrange(12))) for _ in range(30)]
    index, apart = quality.index_vectors(), quality.WINDOW
    assert (np.abs(index[:-1]).sum(1) == quality.NONZERO).all() and not index[-1].any()
    got, expect = np.zeros((2, quality.BUCKETS, quality.DIMS), np.int64)
    words, shapes = [], []
    for text in texts:
        h, s = quality.words_of(text)
        w = quality.buckets_of(h)
        words += [*w, *[quality.BUCKETS] * apart]
        shapes += [*s, *[-1] * apart]
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j:
                    expect[w[i]] += index[w[j]]
                    if s[i] >= 0:
                        expect[s[i]] += index[w[j]]
    quality.add_contexts(got, np.array(words), np.array(shapes), index)
    assert (got == expect).all() and expect.any()


# --- 8
def test_bounds_hold_and_no_pair_is_lost():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * rng.uniform(0, 0.4, (40, 1))])
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    q, s, e = embed_dedup.quantised(unit)
    near = (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T
    assert (np.abs(unit @ unit.T - near) <= (1 + e[:, None]) * e + e[:, None] * (1 + e) + e[:, None] * e + 1e-12).all()
    found = {(int(a), int(b)) for i, j in embed_dedup.linked_pairs(x, x, 0.98) for a, b in zip(i, j, strict=True)}
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True)} | {(k, k) for k in range(80)}


# --- 9
def test_segmentation_is_the_cheapest():
    rng = random.Random(4)
    words = url_filter.Words({"cheap": 2.0, "pills": 2.5, "ch": 1.0, "eap": 1.2, "p": 3.0, "ills": 2.0}, 6.0)
    assert words.split("cheappills") == ["cheap", "pills"]
    for _ in range(100):
        name = "".join(rng.choices("cheapils", k=rng.randint(1, 8)))
        cost = lambda parts: sum(words.costs.get(p, 6.0 * (1 + len(p))) for p in parts)
        cuts = itertools.product((0, 1), repeat=len(name) - 1)
        every = ["".join(c + "|" * k for c, k in zip(name, (*cut, 0), strict=True)).split("|") for cut in cuts]
        assert cost(words.split(name)) == pytest.approx(min(map(cost, every)))


# --- 10
def _sets(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_shingles_count_as_sets():
    texts = ["", None, " \n", "one", "a b c d", "A b C d e f a B c d e f", "x y z w v " * 50, "é É ẞ ß q r", "a b c d e\x0bf\x0cg\xa0h"]
    sets = shingles.shingle_sets(pa.array(texts))
    assert np.diff(sets.ends, prepend=0).tolist() == [len(_sets(t)) for t in texts]
    same = list(shingles.shingle_sets(pa.array(["a b c d", "a b c d e", "A  b\nc d", "ab c d"])))
    assert (same[0] == same[2]).all() and len({x[0] for x in same}) == 3
    assert (shingles.min_hashes(sets, 4)[0] == -1).all()


def test_cells_tie_what_is_linked():
    rng = random.Random(6)
    for trial in range(20):
        base = [[rng.randrange(10**6) for _ in range(60)] for _ in range(3)]
        docs = [sorted({x if rng.random() > 0.06 else rng.randrange(10**9) for x in rng.choice(base)}) for _ in range(25)]
        sets = [np.array(d, np.int64) for d in docs]
        sides, sigs = np.array([rng.randrange(1 + trial % 3) for _ in docs]), np.zeros((25, 4), np.int32)
        a, b = minhash.cell_links(np.arange(25), sides, np.arange(25), sigs, sets, 85, 2)
        link = [(i, j) for i, j in itertools.combinations(range(25), 2) if 100 * len({*docs[i]} & {*docs[j]}) >= 85 * len({*docs[i]} | {*docs[j]}) and (sides[i] != sides[j] or sides[i] == 0)]
        i, j = (np.array([p[k] for p in link], int) for k in (0, 1))
        assert (local_components(25, a.astype(int), b.astype(int)) == local_components(25, i, j)).all()
        assert len(a) < 25
        # what is tied by its labels already isn't tied again
        again = minhash.cell_links(np.arange(25), sides, local_components(25, i, j), sigs, sets, 85, 2)
        assert len(again[0]) == 0


def test_lists_are_merged_up_to_ties(monkeypatch):
    rng = np.random.default_rng(6)
    for trial in range(40):
        monkeypatch.setattr(minhash, "SHORT_LIST", 2 + trial % 9)
        lengths = rng.integers(1, 20, 12)
        keys = np.repeat(rng.choice(10**9, 12, replace=False), lengths)
        n = len(keys)
        two, blocks = np.repeat(rng.random(12) < 0.5, lengths), rng.integers(0, 2, n)
        sigs, sizes = rng.integers(0, 3, (n, 8)).astype(np.int32), rng.integers(80, 120, n)
        a, b = minhash.merged(keys, two, blocks, sigs, sizes, 85, 5)
        pairs = [(i, j) for i, j in itertools.combinations(range(n), 2) if keys[i] == keys[j] and not (two[i] and blocks[i] == blocks[j]) and (sigs[i] == sigs[j]).sum() >= 5 and 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j])]
        assert {*zip(a.tolist(), b.tolist(), strict=True)} <= {*pairs} and pairs
        i, j = np.array(pairs).T
        assert (local_components(n, a, b) == local_components(n, i, j)).all()
