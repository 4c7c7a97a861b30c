"""Classifiers by held-out accuracy, main text and audio by examples and exact round trips."""

import hashlib
import random

import numpy as np
import pytest

from gridlineage.llm import audio, quality, sitetree, toxicity


def labelled(seed=2, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    toxic, out = ["scumbag", "vilest", "rotten"], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(toxic))
        out.append((" ".join(text), int(i % 4 == 0)))
    return out


def test_toxic_spans_and_scores(spark, docs, nothing):
    rows = labelled()
    chain = toxicity.fit(rows[:200])
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.score(frame, chain).collect()}
    for i, (t, y) in list(enumerate(rows))[200:]:
        assert (out[i].score >= 0.7) == bool(y)
        assert {t[s.start : s.end] for s in out[i].spans} <= {"scumbag", "vilest", "rotten"} and bool(out[i].spans) == bool(y)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, chain).collect())
    assert toxicity.score(nothing, chain).count() == 0
    assert toxicity.clean_rows(docs, chain).columns == docs.columns


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    chain = toxicity.Chain(np.zeros(toxicity.WEIGHTS, np.float32), rng.normal(size=(2, 2)), 0.3)
    rows = [rng.normal(size=n).astype(np.float32) for n in (4, 0, 1, 6)]
    for e, p in zip(rows, chain.marginals(rows), strict=True):
        want, total = np.zeros(len(e)), 0.0
        for bits in range(2 ** len(e)):
            y = [(bits >> k) & 1 for k in range(len(e))]
            weight = np.exp(sum(e[k] * y[k] for k in range(len(e))) + (0.3 * y[0] if y else 0) + sum(chain.trans[y[k - 1], y[k]] for k in range(1, len(e))))
            total += weight
            want += weight * np.array(y)
        assert np.allclose(p, want / total, atol=1e-4)


def test_quality_on_held_out_rows(spark, docs, nothing):
    rng, rows = random.Random(3), []
    for i, (t, _) in enumerate(labelled(4)):
        rows.append((" ".join(w + rng.choice(["***", "%%%"]) for w in t.split()), 0) if i % 3 == 0 else (t, 1))
    model = quality.fit(rows[:220])
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    out = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    right = [(out[i] >= 0.5) == bool(y) for i, (_, y) in list(enumerate(rows))[220:]]
    assert np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(nothing, model).count() == 0
    assert quality.good_rows(docs, model).columns == docs.columns


PAGE = """<html><head><title>T</title></head><body><header class=top><h1>Site</h1></header><nav><a>Menu</a></nav><main><article>
<header><h1>Head &eacute;</h1></header><p>a <em>b</em>&nbsp;c<span class="ad">BUY</span>
 d<p>e<ul><li>f<li>g</ul><div class="comments"><p>no</p></div><form>q</form><script>var a="</p>";</script></article></main><aside>z</aside><footer>&copy;</footer></body>"""


def test_main_text(spark, nothing):
    rows = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "not a url", "plain <b>x</b>  y"), (4, "http://a.example/2", "")]
    rows += [(10 + i, f"http://b.example/{i}", f"<body><div class=x>Same line</div><p>Own text {i}</p></body>") for i in range(12)]
    out = {r.page_id: r for r in sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].text == "Head é\na b c d\ne\nf\ng" and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text, out[4].text) == ("", "plain x y", "")
    assert all(out[10 + i].text == f"Own text {i}" for i in range(12))
    assert sitetree.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def site(n=14):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    pages = []
    for i in range(n):
        body = [text(rng.randint(20, 90)) for _ in range(rng.randint(2, 5))]
        links = "".join(f'<li><a href="/{k}">{text(1)}</a></li>' for k in range(5))
        pages.append((f"<body><div class=x1><ul>{links}</ul></div><div class=x2><p>We sell best.</p></div><div class=x3>" + "".join(f"<p>{t}</p>" for t in body) + "</div><div class=x4><span>Imprint</span> here</div></body>", body))
    return pages


def importance_of(spark, pages, host="h"):
    rows = spark.createDataFrame([(host, p) for p in pages], "host string, html string")
    return {r.node: (r.n, r.importance) for r in sitetree.importance(sitetree.style_nodes(rows)).collect()}


def test_entropy_alone_removes_what_repeats(spark):
    pages = site()
    known = {k: v for k, (_, v) in importance_of(spark, [p for p, _ in pages]).items()}
    for html, body in pages:
        alone = sitetree.kept(html, known, judge=lambda *_: 1.0)
        # Names say nothing here: what repeats goes by entropy, and the links, whose words differ each time, with the evidence of links.
        assert alone[-len(body) :] == body and not {"We sell best.", "Imprint here"} & set(alone)
        assert sitetree.kept(html, known) == body
        assert sitetree.kept(html, {}, judge=lambda *_: 1.0) != alone


def counted(pages):
    """Importance of nodes by plain counts: node -> (pages, importance)."""
    seen, held = {}, {}
    for page, nodes in {sitetree.styled(p)[0]: sitetree.styled(p)[1] for p in pages}.items():
        for node, feature, value in nodes:
            seen.setdefault(node, {}).setdefault(feature, []).append(value)
            held.setdefault((node, value, feature), set()).add(page)
    out = {}
    for node, features in seen.items():
        n = len(features[sitetree.SIZE])
        parts = []
        for feature, share in ((sitetree.TEXT, sitetree.CONTENT), (sitetree.LOOK, sitetree.ARRANGED), (sitetree.SIZE, sitetree.LENGTH)):
            values = features.get(feature)
            if values and feature == sitetree.TEXT:
                parts.append((share, np.mean([len(held[node, v, feature]) == 1 for v in values])))
            elif values:
                p = np.unique(values, return_counts=True)[1] / n
                parts.append((share, 1.0 if n == 1 else float(-(p * np.log(p)).sum() / np.log(n))))
        h = sum(s * v for s, v in parts) / sum(s for s, _ in parts)
        out[node] = (n, (h * (n - 1) + 2 * sitetree.UNKNOWN) / (n + 1))
    return out


def test_importance_by_plain_counts(spark):
    pages = [p for p, _ in site(6)]
    pages += pages[:2]
    found, right = importance_of(spark, pages), counted(pages)
    assert found.keys() == right.keys()
    assert all(found[k][0] == right[k][0] and np.isclose(found[k][1], right[k][1]) for k in right)


def test_kept_texts_by_recursion(spark):
    """Every page's texts against a plain recursion over its tree, with importance by plain counts."""
    pages = [p for p, _ in site(9)]
    pages += [p.replace("class=x1", "class=menu").replace("<div class=x3>", "<article><div class=x3>").replace("<div class=x4>", "</article><div class=x4>") for p in pages[:5]]
    known = {k: v for k, (_, v) in counted(pages).items()}

    def texts(node, root, factors, holder):
        factors = [*factors, sitetree.evidence(node, root)]
        own = known.get(sitetree.digest(node.path), sitetree.UNKNOWN)
        if node.text:
            factor = min(factors) if min(factors) < 1 else max(factors)
            return [node.text] if factor * (0.9 * own + 0.1 * holder) >= sitetree.IMPORTANT else []
        return [t for b in node.below for t in texts(b, root, factors, own)]

    rows = [(i, f"http://k.example/{i}", p) for i, p in enumerate(pages)]
    out = {r.page_id: r.text for r in sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, html in enumerate(pages):
        root = sitetree.Page(html).root
        assert out[i] == "\n".join(texts(root, root, [], sitetree.UNKNOWN))
        # Importance decides: were it 1 everywhere, other texts would stay.
        assert sitetree.kept(html, dict.fromkeys(known, 1.0)) != sitetree.kept(html, known)


def test_texts_of_a_pool_are_not_new(spark):
    """Adverts of a pool, another on each page, go by entropy; reader comments, new on each page, by their name."""
    rng = random.Random(5)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    pool = [text(6) for _ in range(8)]
    bodies = [[text(rng.randint(10, 80)) for _ in range(3)] for _ in range(80)]
    talk = [text(9) for _ in bodies]
    pages = [f"<body><div class=q>{rng.choice(pool)}</div><div class=r>" + "".join(f"<p>{t}</p>" for t in body) + f"</div><div class=comments><p>{said}</p></div></body>" for body, said in zip(bodies, talk, strict=True)]
    known = {k: v for k, (_, v) in importance_of(spark, pages).items()}
    for html, body, said in zip(pages, bodies, talk, strict=True):
        assert sitetree.kept(html, known, judge=lambda *_: 1.0) == [*body, said]
        assert sitetree.kept(html, known) == body


def test_names_do_not_take_the_article(spark):
    text = "One two three four five six seven."
    for wrapper in ("<div class='layout has-sidebar'>", "<div class='page no-comments'>", "<form action=x>", "<div class=sidebar-layout>"):
        html = f"<body>{wrapper}<h1>Head</h1><p>{text}</p></div></body>"
        assert sitetree.kept(html, {}) == ["Head", text]
    html = f"<body><article class=teaser>Short</article><div><p>{text * 5}</p></div><div class=comments><p>{'no ' * 400}</p></div></body>"
    assert sitetree.kept(html, {}) == ["Short", text * 5]


def test_pages_with_odd_rows(spark):
    deep = "<div>" * 5_000 + "deep" + "</div>" * 5_000
    rows = [(None, None, None, 1, "a"), (7, "http://h/1", "<p>a</p>" * 20_000, 2, "b"), (7, "http://h/1", "<p>a</p>" * 20_000, 2, "b"), (8, "http://h/2", deep, 3, "c"), (None, "http://h/3", "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), 3, "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, nodes int, host string")
    out = sitetree.main_text(frame).collect()
    assert len(out) == 5 and sorted(r.n_chars for r in out)[-3:] == [4, 39_999, 39_999]


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(i, f"http://c.example/{i}", "<article><h1>One</h1><p>Text</p></article>") for i in range(30)]
    out = sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"One\nText"}


def test_audio_holds_every_byte(docs, nothing):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, (r.text or "").encode())
    seen = {}
    for r in audio.audio_features(docs).collect():
        data = texts[r.doc_id]
        want = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert bytes(r.payload) == want and audio.from_wav(bytes(r.media)) == (want, audio.RATE) and r.n_bytes == len(data)
        mel, times = audio.from_tensors(bytes(r.tensors))
        assert mel.shape == (r.frames, audio.BANDS) and len(times) == -(-r.frames // audio.TENSOR) and times[0][0] == 0
        assert all(a[1] == b[0] for a, b in zip(times, times[1:], strict=False)) and np.allclose(mel.mean(0), r.means, atol=1e-4) and np.allclose(mel.std(0), r.deviations, atol=1e-4)
        # Every resampled sample lies in a frame.
        assert (r.frames - 1) * audio.HOP + audio.FRAME >= -(-len(want) * audio.UP // audio.DOWN)
        assert all(0 <= s.start < s.end for s in r.spans)
        key = hashlib.sha256(want).hexdigest()
        assert seen.setdefault(key, r.tensors) == r.tensors
    assert audio.audio_features(nothing).count() == 0


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 3), (1, 1), (3, 4)])
def test_resampling_is_filtering_between_zeros(up, down):
    x = np.random.default_rng(1).normal(size=200).astype(np.float32)
    taps = 16
    h = audio.phases(up, down, taps)[:, ::-1].T.reshape(-1)
    full = np.convolve(np.ravel(np.column_stack([x, *[np.zeros_like(x)] * (up - 1)])), h)
    want = full[: len(x) * up : down]
    assert np.allclose(audio.resample(x, up, down, taps)[: len(want)], want, atol=1e-4)


def test_log_mel_by_plain_loops():
    x = np.random.default_rng(2).normal(size=500).astype(np.float32)
    mel, energy = audio.log_mel(x, 6000)
    padded = np.concatenate([x, np.zeros(128)])
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + 3000 / 700), audio.BANDS + 2)]
    assert len(mel) == 7
    for i, row in enumerate(mel):
        part = padded[i * 64 : i * 64 + 128] * np.hanning(128)
        power = [abs(sum(part[k] * np.exp(-2j * np.pi * k * f / 128) for k in range(128))) ** 2 for f in range(65)]
        want = []
        for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
            want.append(sum(p * max(0, min((f * 6000 / 128 - a) / (b - a), (c - f * 6000 / 128) / (c - b))) for f, p in enumerate(power)))
        assert np.allclose(row, np.log(np.array(want) + 1e-6), atol=1e-2) and np.isclose(energy[i], np.log((part**2).sum() + 1e-6), atol=1e-3)


def test_segments_by_a_walk():
    energy = np.array([0, 0, 3, 1, 9, 9, 2.6, 0, 3, 3, 0, 8, 0], float)
    mean, spread = energy.mean(), energy.std()
    want, start, loud = [], None, False
    for i, e in enumerate([*energy, -99]):
        if e > mean + audio.CLOSE * spread:
            start, loud = i if start is None else start, loud or e > mean + audio.OPEN * spread
        else:
            if start is not None and loud:
                want.append((start, i))
            start, loud = None, False
    assert want and audio.segments(energy) == want


def test_words_of_the_whole_corpus_have_vectors(spark):
    rng, rows = random.Random(6), []
    for i, (t, _) in enumerate(labelled(7, 120)):
        rows.append((i, " ".join([*(w + (rng.choice(["***", "%%%"]) if i % 3 == 0 else "") for w in t.split()), *(f"far{(i * 4 + k) % 40}" for k in range(4))])))
    rows += [(None, None), (500, ""), (501, rows[3][1]), (501, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(40)], "doc_id long, quality int")
    counts, sums = {}, {}
    for _, t in rows:
        words = quality.TOKEN.findall(t or "")
        for i, w in enumerate(words):
            counts[w] = counts.get(w, 0) + 1
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    sums[w] = sums.get(w, 0) + quality.index_vectors([words[j]])[0] * (2 if abs(i - j) == 1 else 1)
    often = {w for w, n in counts.items() if n >= quality.OFTEN}
    whole, split = quality.train(docs, labels), quality.train(docs, labels, held=20)
    assert whole.rest is None and set(whole.words.keys.tolist()) == {quality.word_key(w) for w in often}
    look = quality.Rows(whole.words)
    for w in often:
        assert np.array_equal(whole.words.vectors[look[w]], quality.directions([w], sums[w][None])[0])
    assert split.rest and 0 < len(split.words.keys) <= 20
    one, two = (sorted(((r.doc_id or -1, r.score) for r in quality.score(docs, m).collect())) for m in (whole, split))
    assert [k for k, _ in one] == [k for k, _ in two] and np.allclose([s for _, s in one], [s for _, s in two], atol=1e-3)
    kept = [sorted((r.doc_id or -1) for r in quality.good_rows(docs, m).collect()) for m in (whole, split)]
    assert kept[0] == kept[1] and quality.good_rows(docs, split).columns == docs.columns


def test_sums_of_neighbours_take_room_for_their_words(monkeypatch):
    monkeypatch.setattr(quality, "FLUSH", 100)
    monkeypatch.setattr(quality, "RUN", 64)
    rng, seen, sums = random.Random(8), quality.Seen(), {}
    for lo in range(0, 2_000, 40):
        texts = [" ".join([*(f"w{lo + k}" for k in range(40)), *["again"] * 100, *(f"w{rng.randrange(lo + 40)}" for _ in range(30))]), None, ""]
        seen.add(texts)
        words = texts[0].split()
        v = quality.index_vectors(words)
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    sums[w] = sums.get(w, 0) + v[j] * (2 if abs(i - j) == 1 else 1)
        assert len(seen.index) == len(seen.sums) == len(seen.count) <= max(100, 1.25 * len(seen.number) + 2)
    words, n, found = seen.totals()
    assert len(words) == 2_001 and n.sum() == 50 * 170
    assert all(np.array_equal(found[i], sums[w]) for i, w in enumerate(words))


def test_states_of_texts_together_and_alone(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["ab", "Cd", "ef!", "gh", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    model = quality.fit([(t, i % 2) for i, t in enumerate(texts)])
    docs = [quality.TOKEN.findall(t) for t in ["", *texts, "nothing known here", ""]]
    asked = []
    key = quality.word_key
    monkeypatch.setattr(quality, "word_key", lambda w: (asked.append(w), key(w))[1])
    together = model.states(docs, quality.Rows(model.words))
    assert sorted(asked) == sorted({w for t in docs for w in t})
    look = quality.Rows(model.words, most=50)
    for t, state in zip(docs, together, strict=True):
        v = model.words.vectors[[look[w] for w in t]] / quality.STEPS
        again = sum(a == b for a, b in zip(t, t[1:]))
        want = [*v.sum(0), *(v * v).sum(0), again / len(t), len(set(t)) / len(t), len(t)] if t else [0] * quality.STATE
        assert np.allclose(state, want, atol=1e-4) and np.array_equal(state, model.state(t, look))
