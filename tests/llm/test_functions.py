"""The Python cores of the training-data operators against plain versions."""

import gzip
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfloom.llm import bpe, decontam, html_extract, langid, quality, secrets, simhash, warc
from shelfloom.llm.ftrl import Ftrl, probabilities

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH) as f:
        return bpe.Counter(json.load(f))


def test_bpe_counts_every_kind_of_character(tokenizer, counter):
    texts = ["", "a<|endoftext|> b<|endoftext|>", "it's I'LL we'll  \n\n x", "x" * 3000, "\x1c\x1d a\x85\xa0 b", "ſs Kk", "日本語 テスト 🙂🙂"]
    texts += ["".join(chr(q) for q in range(a, a + 64) if not 0xD800 <= q < 0xE000) + " x" for a in range(0, 0x3100, 64)]
    texts += [f"a{chr(q)}{chr(q)}b {chr(q)} c" for q in [*range(0x100), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x180E]]
    for text in texts:
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)
    assert counter.count(None) == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_counts_as_the_library(text):
    from tokenizers import Tokenizer

    global _lib
    try:
        _lib
    except NameError:
        with open(PATH) as f:
            _lib = (Tokenizer.from_file(PATH), bpe.Counter(json.load(f)))
    assert _lib[1].count(text) == len(_lib[0].encode(text, add_special_tokens=False).ids)


def test_bpe_refuses_other_files(counter):
    with open(public_tokenizers.path("word_bpe_49k.json")) as f, pytest.raises(ValueError):
        bpe.Counter(json.load(f))


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB é\x1f\t\x0b ", max_size=40)))
def test_simhash_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_stars_connect_dense_blocks():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.int64)
    near = np.concatenate([base[k] ^ (np.int64(1) << np.arange(40, dtype=np.int64)) for k in range(3)])
    u, v = simhash._star(near, near, 3)
    assert len(u) <= 2 * 2 * len(near)
    seen = {int(x): int(x) for x in near}

    def find(x):
        while seen[x] != x:
            x = seen[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        seen[find(a)] = find(b)
    assert len({find(int(x)) for x in near}) == 3


def test_warc_round_trip_and_index(tmp_path):
    rng = random.Random(3)
    blocks = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 50, 70_000]))) for _ in range(12)] + [b"WARC/1.1\r\n\r\n\r\n"]
    plain = b"".join(warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": f"<{k}>"}, b) for k, b in enumerate(blocks))
    source, target = tmp_path / "a.warc.gz", tmp_path / "b.warc.gz"
    for data in (gzip.compress(plain), gzip.compress(plain[:500]) + gzip.compress(plain[500:])):
        source.write_bytes(data)
        assert warc.normalise_file(source, target) == len(blocks)
        index = [line.split("\t") for line in open(f"{target}.idx").read().splitlines()]
        for (offset, length, name, kind), block in zip(index, blocks, strict=True):
            headers, found = warc.read_at(target, int(offset), int(length))
            assert found == block and headers["WARC-Record-ID"] == name and kind == "response"
        assert gzip.decompress(target.read_bytes()) == plain


def test_warc_truncation_is_an_error():
    data = gzip.compress(warc.record_bytes({"WARC-Type": "response"}, b"x" * 999))
    with pytest.raises(ValueError):
        list(warc.normalise([data[:-20]]))
    with pytest.raises(ValueError):
        list(warc.normalise([gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")]))
    assert list(warc.normalise([])) == []


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- <p>gone</p> --><div class="cookie-notice">We use cookies, all of them.</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First  paragraph, with text.<br><p>Second\n one; it is longer, it has signs.</p><ul><li>one<li>two</ul>
<form><p>Sign up now, please, today.</p></form><section id="comments"><p>A reader wrote, at length, that this is good.</p></section></article>
<aside>Related, and more.</aside><footer>&copy; me</footer></body></html>"""


def test_html_main_text():
    want = "Title & more\nFirst paragraph, with text.\nSecond one; it is longer, it has signs.\none\ntwo"
    assert html_extract.extract(PAGE) == want
    assert html_extract.extract(PAGE[: PAGE.index("<ul><li>one") ]) == "\n".join(want.split("\n")[:3])


def test_html_without_article():
    page = "<body><div class=menu><a href=x>a</a></div><div id=main>" + "<p>Some text here, with a comma. And more of it.</p>" * 5 + "</div><div class=footer>bye</div>"
    assert html_extract.extract(page) == "\n".join(["Some text here, with a comma. And more of it."] * 5)


def test_html_keeps_all_chosen_text():
    part = lambda name, n: "".join(f"<p>{name} {k}, a sentence with signs. And another one, longer.</p>" for k in range(n))
    lines = lambda name, n: [f"{name} {k}, a sentence with signs. And another one, longer." for k in range(n)]
    teaser = f"<body><article>{part('teaser', 1)}</article><article><h1>Title</h1>{part('real', 9)}</article></body>"
    assert html_extract.extract(teaser).split("\n") == [*lines("teaser", 1), "Title", *lines("real", 9)]
    split = f"<body><div>{part('first', 13)}</div><div>{part('second', 7)}</div></body>"
    assert html_extract.extract(split).split("\n") == [*lines("first", 13), *lines("second", 7)]
    quote = f"<body><div><blockquote>{part('quoted', 13)}</blockquote>{part('own', 7)}</div></body>"
    assert html_extract.extract(quote).split("\n") == [*lines("quoted", 13), *lines("own", 7)]


def test_html_containers_by_name():
    page = """<body class="has-sidebar no-comments"><div class="layout with-ads sidebar-left"><main><article><div class="post-header"><h1><a href="/t">Title</a></h1></div>
    <p>First text, with signs. And another sentence, long enough.</p><h2>Next</h2><p>Second text, also long; with words, and words.</p>
    <ul><li>one</li><li>two</li></ul><ul class="more"><li><a href=1>More links</a></li><li><a href=2>Others</a></li></ul></article>
    <div class="comments"><p>A reader wrote, at length, that this is good.</p></div></main><aside><p>Aside, a long and well written one.</p></aside></div></body>"""
    assert html_extract.extract(page).split("\n") == ["Title", "First text, with signs. And another sentence, long enough.", "Next", "Second text, also long; with words, and words.", "one", "two"]


def test_html_path_scores_against_a_plain_version():
    page = "<body>" + PAGE[PAGE.index("<article>") : PAGE.index("<aside>")] + "<div><p>Far away.</p><ul><li><a href=x>link</a><li>b</ul></div>"
    blocks = html_extract.blocks_of(page)
    above = lambda e: [] if e is None else [*above(e.parent), e]
    open_ = [above(b.owner) for b in blocks]
    paths = [tuple(e.name for e in chain) for chain in open_]
    deep = [sum(e.name not in ("html", "body") and e.name not in html_extract.INLINE for e in chain) for chain in open_]
    score = {}
    for p in set(paths):
        on = [b for b, q in zip(blocks, paths) if q == p]
        size, signs = sum(len(t) for b in on for t in b.parts if t.strip()), sum(len(re.findall(r"[.,;:!?]", t)) for b in on for t in b.parts)
        plain = 1 - sum(b.linked for b in on) / size
        score[p] = (np.log1p(size / len(on) * plain), np.log1p(signs / len(on) * plain), plain)
    best = {}
    for i, p in enumerate(paths):
        sums, weight = np.zeros(2), 0.0
        for k in range(max(0, i - 2), min(len(paths), i + 3)):
            both = [a for a, b in zip(open_[i], open_[k]) if a is b]
            shared = sum(e.name not in ("html", "body") and e.name not in html_extract.INLINE for e in both)
            near = 1.0 if open_[i][-1] is open_[k][-1] else max(shared / max(deep[i], deep[k], 1), 0.5 * (open_[i][-2] is open_[k][-2]))
            w = np.exp(-((i - k) ** 2) / 2) * near
            sums += w * np.array(score[paths[k]][:2])
            weight += w
        t, s = sums / weight
        best[p] = max(best.get(p, 0), t * (1 + s) * score[p][2])
    got, limit = html_extract.path_scores(blocks)
    for b, p in zip(blocks, paths):
        assert abs(got[b.owner.path] - best[p]) < 1e-9, p
    sizes = {p: sum(b.size for b, q in zip(blocks, paths) if q == p) for p in best}
    assert abs(limit - 0.1 * sum(best[p] * sizes[p] for p in best) / sum(sizes.values())) < 1e-9


def test_html_deep_pages():
    assert html_extract.extract("<div>" * 30_000 + "Deep, and long." + "</div>" * 30_000) == "Deep, and long."
    assert len(html_extract.extract("<div>a, b. " * 20_000).split("\n")) == 20_000


def test_html_edges():
    assert [html_extract.extract(x) for x in (None, "", "<p>", "<!--", "<script>x", "<nav>a</nav>")] == [""] * 6
    assert html_extract.extract("no markup & all") == "no markup & all"
    assert len(html_extract.extract("<p>" + "word, " * 200_000)) == 6 * 200_000 - 1


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_against_full_alignment():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(4, 40)))) for k in range(12)]
    index = decontam.Index(items)
    planted = 0
    for trial in range(120):
        item, text = rng.choice(items)
        piece = list(text)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(piece))
            piece[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"[:1]])
        doc = " ".join(word() for _ in range(rng.randint(0, 60))) + " " + "".join(piece) + " " + " ".join(word() for _ in range(20))
        found = index.found(doc)
        plain = decontam.plain(doc)
        for k, t in items:
            want = any(edits(w, plain) <= decontam.budget(len(w)) for w in decontam.windows(t) if len(w) >= decontam.Q)
            assert (k in found) == want, (trial, k)
            planted += want
    assert planted > 40


def test_decontamination_finds_every_short_excerpt():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 11)))
    items = [[word() for _ in range(n)] for n in (13, 20, 37, 60)]
    index = decontam.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    for k, words in enumerate(items):
        for at in range(len(words) - 12):
            doc = " ".join([*(word() for _ in range(15)), *words[at : at + 13], *(word() for _ in range(15))])
            assert set(index.found(doc)) == {k}, (k, at)
    assert all(not index.found(" ".join(word() for _ in range(60))) for _ in range(50))


def test_decontamination_pieces_and_signs():
    index = decontam.Index([(7, decontam.plain("the quick brown fox jumps over the lazy dog again and again"))])
    text = "z " * (decontam.PIECE // 2 - 10) + "The%%% quick*** brown### fox$$$ JUMPS over the lazy dog again and again" + " y" * 1000
    assert index.found(text) == {7: 1}
    for shift in range(-150, 60, 7):  # wherever a piece ends, a window counts once
        text = "z" * (decontam.PIECE + shift) + " the quick brown fox jumps over the lazy dog again and again" + " y" * 1000
        assert index.found(text) == {7: 1}, shift
    assert index.found(None) == {} and index.found("") == {} and index.found("the quick brown") == {}
    assert decontam.Index([]).found("anything at all here") == {}
    assert decontam.Index([(1, "short")]).found("a short text, short") == {}


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "APIKEY", "=", ":", " ", '"', "abc", "123456", "AKIA", "A" * 16, "deadbeef" * 3, "é", "ſecret", "\n"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    got = [(a, secrets.KINDS.index(k), b) for a, k, b, _ in secrets.scan(text) if k != "guess"]
    assert got == plain_spans(text)


def test_guess_cost():
    bits = secrets.guess_bits
    assert bits("password1") < bits("kXq9vT2m") and bits("qwertyuiop") < 20 and bits("aaaaaaaaaaaa") < 20 and bits("19991345") > bits("19991231")
    assert bits("f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda") > 100
    assert bits("x" * 100_000) < 60
    kinds = {k for _, k, _, _ in secrets.scan('pwd: "gT7#kq9!Lm2z" and password=password1')}
    assert kinds == {"assign", "guess"}
    assert secrets.scan(None) == [] and secrets.scan("") == []


def test_guess_cost_is_that_of_the_cheapest_segmentation():
    words = secrets.dictionary(["correct", "horse", "drow"])

    def brute(value):
        cheapest = {}
        for i, j, bits in secrets._pieces(value, words):
            cheapest[i, j] = min(bits + secrets.SEGMENT_BITS, cheapest.get((i, j), 1e9))
        per = secrets._alphabet_bits(value)

        def rest(i):
            if i == len(value):
                return 0.0
            return min([per + rest(i + 1)] + [b + rest(j) for (a, j), b in cheapest.items() if a == i])

        return rest(0)

    rng = random.Random(2)
    parts = ["pass", "w0rd", "horse", "esroh", "1999", "aaaa", "qwer", "x", "7", "#", "drow", "2020-01-31"]
    for _ in range(150):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))[:14]
        assert abs(secrets.guess_bits(value, words) - brute(value)) < 1e-9, value
    assert words.rank["correct"] > words.rank["password"] and "a" not in words.rank


def test_prose_behind_a_context_word_is_no_secret():
    words = secrets.dictionary(secrets.vocabulary_words(PATH))
    prose = ["the password is incorrect", "token is unavailable", "auth: administrator", "the secret is cooperation", "login: correcthorsebattery", "author: Somebodyelse", "spinning = f8#Kq2!z9wQ"]
    assert [secrets.scan(t, words) for t in prose] == [[]] * len(prose)
    real = ["AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG+bPxRfi", "DB_PWD=g7#Kq2!zX9", "MYSQL_PASSPHRASE: xK9#mm2!pQz7", "secretAccessKey\t=\t'abX9#kk2!mnQ7'", "db_password=f8#Kq2!z9w"]
    assert all([k for _, k, _, _ in secrets.scan(t, words)] == ["guess"] for t in real)
    for text in ("tokentoken" * 50_000, "token" + " " * 300_000, "token = " * 50_000):
        secrets.scan(text, words)


def test_ftrl_learns_and_keeps_zeros():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] - 2 * x[:, 1] > 0).astype(int)
    model = Ftrl(1, 6, alpha=0.5, l1=1.0)
    model.fit([(np.arange(6), r, int(t), 1.0) for r, t in zip(x, y)], 5, 1)
    w, b = model.weights()
    p = probabilities((x @ w[0] + b)[:, None])[:, 0]
    assert ((p > 0.5) == y).mean() > 0.95
    p = probabilities(np.array([[1.0, 2.0, 3.0]]))
    assert abs(p.sum() - 1) < 1e-12


def plain_quality_features(text):
    """Feature numbers and values word by word, without blocks or arrays."""
    mask = (1 << 64) - 1
    words = quality._TOKEN.findall(text)
    codes = [quality._Words()[w] for w in words]
    low = [c >> 32 for c in codes]
    shape = [2 * (c & 0xFFFFFFFF) + (k > 0 and low[k] == low[k - 1]) for k, c in enumerate(codes)]
    out = {}
    for salt, view, n in ((1, low, 1), (2, low, 2), (3, shape, 1), (4, shape, 2), (5, shape, 3)):
        grams = [view[k : k + n] for k in range(len(view) - n + 1)]
        for g in grams:
            h = salt
            for x in g:
                h = ((h ^ x) * int(quality._M1)) & mask
                h ^= h >> 29
            key = (h * int(quality._M2) & mask) >> 46
            out[key] = out.get(key, 0.0) + quality.SCALE / len(grams)
    return out


@pytest.mark.parametrize("block", [3, 7, 50, 1 << 16])
def test_quality_features_in_blocks(monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(quality, "BLOCK_WORDS", block)
    for n in (0, 1, 2, 3, 7, 50, 51, 150):
        text = " ".join(rng.choice(["Some", "some", "AND", "!!", "123", "%%%", "again", "x"]) for _ in range(n))
        i, v = quality.features(text, quality._Words())
        want = plain_quality_features(text)
        assert i.tolist() == sorted(want) and np.allclose(v, [want[k] for k in sorted(want)])
        w = np.random.default_rng(2).normal(size=quality.DIM).astype(np.float32)
        got = quality.score_text(text, w, 0.1, quality._Words())
        assert abs(got - 1 / (1 + np.exp(-(sum(float(w[k]) * x for k, x in want.items()) + 0.1)))) < 1e-5
    assert quality.score_text(None, w, 0.0, quality._Words()) == quality.score_text("", w, 0.0, quality._Words()) == 0.5


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 16])
def test_language_counts_in_blocks(monkeypatch, block):
    text = "Abc dÉf, 12 ghi;; straße ΣΑΣ " * 9
    plain = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    monkeypatch.setattr(langid, "BLOCK", block)
    i, n = langid.counts(text)
    assert n.sum() == 3 * len(plain) - 3
    # a hash of its own for every different n-gram of so few
    grams = [plain[k : k + size] for size in (1, 2, 3) for k in range(len(plain) - size + 1)]
    assert sorted(n.tolist()) == sorted(__import__("collections").Counter(grams).values()) and (np.diff(i) > 0).all()
    assert langid.Model([]).predict("abc") == ("und", 0.0)
    assert langid.Model(["xx"]).predict("abc") == ("xx", 1.0)
    assert langid.Model(["xx"]).predict("123 !") == ("und", 0.0) == langid.Model(["xx"]).predict(None)


@pytest.mark.parametrize("classes", [1, 3])
def test_ftrl_against_plain_updates(classes):
    """Every coordinate on its own, in plain numbers, all of them every step."""
    rng = np.random.default_rng(classes)
    alpha, beta, l1, l2, dim = 0.4, 1.0, 0.3, 0.2, 7
    model = Ftrl(classes, dim, alpha=alpha, l1=l1, l2=l2)
    z, n = [[0.0] * (dim + 1) for _ in range(classes)], [[0.0] * (dim + 1) for _ in range(classes)]

    def weight(c, k):
        small = 0.0 if k == dim else l1
        if abs(z[c][k]) <= small:
            return 0.0
        return -(z[c][k] - (small if z[c][k] > 0 else -small)) / ((beta + n[c][k] ** 0.5) / alpha + l2)

    for _ in range(60):
        idx = np.sort(rng.choice(dim, 4, replace=False))
        val, target, share = rng.normal(size=4), int(rng.integers(0, max(2, classes))), float(rng.uniform(0.5, 2))
        x = [0.0] * dim + [1.0]
        for k, v in zip(idx, val):
            x[k] = float(v)
        w = [[weight(c, k) for k in range(dim + 1)] for c in range(classes)]
        logit = [sum(a * b for a, b in zip(w[c], x)) for c in range(classes)]
        if classes == 1:
            error = [1 / (1 + np.exp(-logit[0])) - target]
        else:
            e = [np.exp(q - max(logit)) for q in logit]
            error = [q / sum(e) - (c == target) for c, q in enumerate(e)]
        for c in range(classes):
            for k in range(dim + 1):
                g = error[c] * share * x[k]
                sigma = ((n[c][k] + g * g) ** 0.5 - n[c][k] ** 0.5) / alpha
                z[c][k] += g - sigma * w[c][k]
                n[c][k] += g * g
        model.step(idx, val, target, share)
    got, bias = model.weights()
    assert np.allclose(got, [[weight(c, k) for k in range(dim)] for c in range(classes)])
    assert np.allclose(bias, [weight(c, dim) for c in range(classes)]) and (got == 0).any()


def test_temperature_is_the_best_of_a_direct_search():
    rng = np.random.default_rng(3)
    target = rng.integers(0, 3, 300)
    logits = 4 * (rng.normal(size=(300, 3)) + 1.2 * np.eye(3)[target])
    loss = lambda t: np.mean([-(r[c] / t - np.log(np.exp(r / t).sum())) for r, c in zip(logits, target)])
    found = langid.temperature(logits, target)
    assert loss(found) <= min(loss(t) for t in np.linspace(0.06, 9.5, 400)) + 1e-3 and loss(found) < loss(1.0)
