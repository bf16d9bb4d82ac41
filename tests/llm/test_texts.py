"""Page extraction, toxicity grades and quality rules."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazardspark.llm import html, ordinal, quality
from tests.llm import data

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu a</a></li><li><a href='/b>'>Menu b</a></li></ul></nav>
<div class="ad">Buy this very long advert text now, it is much longer than the paragraphs of the article are.</div>
<div id="cookie-notice">We use cookies.</div><article><h1>The &amp; title</h1><p>First   <b>paragraph</b> &lt;1&gt;<p>Second<br>one &eacute;&#233;&#x41;
<aside>Aside text</aside><form><input>Form text</form><p>Be.</p><div class="comments"><p>A reader says a lot here.</p></div>
<!-- hidden <p>no</p> --></article><footer>&copy; footer <p>text</p></footer><script>x()</script></body></html>"""


def test_article_without_its_surroundings():
    assert html.main_text(PAGE) == "The & title\nFirst paragraph <1>\nSecond one ééA\nBe."


def test_pages_without_article_by_line_blocks():
    menu = "".join(f"<div><a href='/{i}'>Menu entry {i}</a></div>" for i in range(12))
    text = [f"Paragraph {i} has a good number of words so that its block of lines surges above the threshold." for i in range(5)]
    page = f"<html><body>{menu}{''.join(f'<div>{t}</div>' for t in text)}{menu}<div>c</div></body></html>"
    assert html.main_text(page) == "\n".join(text)


def test_sums_decide_with_and_without_article_tags():
    from html import unescape

    pages = ds.dataset(f"{data.DATA}/sf0.01/pages.parquet").to_table().to_pylist()
    for p in pages:
        body = p["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<[^>]*>?", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert html.main_text(p["html"]) == html.main_text(p["html"].replace("article>", "div>")) == want


TEXT = [f"Paragraph {i} has a good number of words so that its block of lines surges above the threshold." for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)


@pytest.mark.parametrize("page", [
    f"<div>{BODY}</div><nav><a href=x>x</a></nav><article class=teaser><h3>Another story</h3><p>Read on.</p></article>",
    f"<div>{BODY}</div><ul>{'<li><a href=x>Menu</a>' * 3}</ul><article><p>Another story</p></article>",
    f"<article>{BODY}</article><ul><li><a href=x>Menu</a></ul><article class='comment'><p>A reader says quite a lot about this, with many words.</p></article>",
    f"<article>{BODY}</article><div>This notice has no class and comes after the text, but it is no part of the article at all.</div>",
    f"<div class='content has-sidebar'>{BODY}</div><div class=sidebar><p>Side text that is long enough to be a paragraph of an article by itself, yes.</p></div>",
    f"<main class='no-menu'>{BODY}</main><section><p><a href=x>More</a></p></section>",
])
def test_articles_tip_the_scales_only(page):
    assert html.main_text(f"<html><body>{page}</body></html>") == "\n".join(TEXT)


def test_weights_of_lines():
    lines = [("menu", 0, False, False), ("in article", 10, True, False), ("linked", 0, True, False), ("outside", 7, False, False), ("aside", 5, True, True)]
    assert np.allclose(html.line_weights(lines), [0, 15, 9, 7 * 0.02, 0.1])
    lines[3] = ("outside " * 9, 70, False, False)  # articles have 10 of 80 characters, so a quarter of the pull
    assert np.allclose(html.line_weights(lines), [0, 10 * 1.125, 6 / 4 * 1.125, 70 * 0.75, 0.1])


def test_dense_lines_between_dives():
    weights = [0, 50, 60, 0, 0, 1, 0, 20, 9, 0, 0, 0, 1, 90]
    assert html.dense_lines(weights, 3, 86, 2) == [1, 2, 12, 13]
    assert html.dense_lines(weights, 3, 20, 2) == [1, 2, 7, 8, 12, 13] and html.dense_lines([], 3, 86, 2) == []


def test_surge_and_dive_change_results():
    pages = [p["html"] for p in ds.dataset(f"{data.DATA}/sf0.01/pages.parquet").to_table().to_pylist()]
    usual = [html.main_text(p) for p in pages]
    for options in ({"surge": 0}, {"surge": 1000}, {"surge": 10_000}):
        assert sum(html.main_text(p, **options) != t for p, t in zip(pages, usual)) > len(pages) / 10
    page = "<div>" + "".join(f"<p>{'long words of a paragraph ' * n}</p><p>short {n}</p><p>so</p><p>it</p><p>goes</p>" for n in (4, 5)) + "</div>"
    assert html.main_text(page).count("\n") == 9 and html.main_text(page, dive=20).count("\n") < 9


def test_pages_without_any_names():
    """All blocks are divs: the sums find all of the text, and leave what is apart from it."""
    found = right = 0
    pages = ds.dataset(f"{data.DATA}/sf0.01/pages.parquet").to_table().to_pylist()
    for p in pages:
        want = html.main_text(p["html"]).split("\n")
        plain = re.sub(r"<(/?)(nav|footer|article|ul|li|header)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", p["html"]))
        got = html.main_text(plain).split("\n")
        found += set(want) <= set(got)
        right += sum(len(x) for x in got if x in set(want)) / sum(map(len, got))
    assert found >= 0.98 * len(pages) and right >= 0.8 * len(pages)
    menu = "".join(f"<div><a href=x>Entry {i} of the menu</a></div>" for i in range(9))
    assert html.main_text(f"<div>Log in</div>{menu}{BODY}{menu}<div>About us</div>") == "\n".join(TEXT)


def test_article_around_navigation():
    menu = "".join(f"<li><a href=x>Entry {i} of a long menu of many words</a></li>" for i in range(9))
    assert html.main_text(f"<article><ul>{menu}</ul></article><div>{BODY}</div>") == "\n".join(TEXT)
    assert html.main_text(f"<article>{BODY}<p><a href=x>A linked line of the text</a></p></article>") == "\n".join([*TEXT, "A linked line of the text"])


def test_long_text_in_a_misnamed_container():
    long_ = "".join(f"<p>{t * 30}</p>" for t in TEXT)
    assert html.main_text(f"<div class=sidebar>{long_}</div><div>Short</div>") == "\n".join(t * 30 for t in TEXT)


def test_deep_pages_take_linear_time():
    import time

    begun = time.time()
    html.main_text("<div>" * 100_000 + "</section>" * 100_000)
    assert time.time() - begun < 10


@pytest.mark.parametrize("cut", range(0, len(PAGE), 37))
def test_cut_pages_do_not_fail(cut):
    assert isinstance(html.main_text(PAGE[:cut]), str)


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="<>/ab p!-\"'=&;", max_size=80))
def test_any_markup_is_read(text):
    html.main_text(text)


def test_pages_against_brute_force(spark):
    pages = ds.dataset(f"{data.DATA}/sf0.001/pages.parquet").to_table().to_pylist()
    got = {r.page_id: r for r in html.extract(spark.read.parquet(f"{data.DATA}/sf0.001/pages.parquet")).collect()}
    from html import unescape

    for p in pages:
        body = p["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<[^>]*>?", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]].text == want and got[p["page_id"]].n_chars == len(want)


def test_page_edge_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>" * 20_000 + "text", "x"), (3, "u", "<p>" + "long " * 300_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 4, 1_499_999] and df.limit(0).transform(html.extract).count() == 0


# --- toxicity


def _labelled(n=3000):
    docs = {d: t for d, t, *_ in data.documents("sf0.1")}
    labels = ds.dataset(f"{data.DATA}/sf0.1/labels.parquet").to_table().sort_by("doc_id").to_pylist()
    return [(r["toxic"], Counter(ordinal.words_of(docs[r["doc_id"]].encode()))) for r in labels][:n]


def test_held_out_accuracy():
    rows = _labelled()
    model = ordinal.fit(rows[:2000])
    said = [(y, model.of(c)[0] < 0.5) for y, c in rows[2000:]]
    assert sum(s for y, s in said if not y) <= 0.02 * sum(not y for y, _ in said)
    assert sum(s for y, s in said if y) >= 0.8 * sum(y for y, _ in said)


def test_severity_grows_with_toxic_words_and_thresholds_are_ordered():
    model = ordinal.fit(_labelled(2000))
    assert (np.diff(model.thresholds) > 0).all()
    clean = "the and of to in is that for with on " * 5
    grades = [float(model.grades((clean + "idiot moron scum trash loser stupid " * k).encode()) @ np.arange(4)) for k in (0, 1, 3, 9)]
    assert grades == sorted(grades) and grades[0] < 0.5 < 2 < grades[-1]


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_toxicity_edge_tables(spark, kind):
    df = data.edge_tables(spark)[kind]
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (4, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    got = ordinal.toxicity(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r.severity <= 3 and r.grade in (0, 1, 2, 3) and r.toxic == (r.grade > 0) for r in got)
    none = ordinal.toxicity(df, labels.limit(0)).collect()
    assert all(not r.toxic for r in none)


def test_gradient_of_the_ordinal_likelihood():
    rng = np.random.default_rng(2)
    x, y, w, t = rng.normal(size=(40, 5)), rng.integers(0, 4, 40), rng.normal(size=5), np.array([0.3, -0.2, 0.4])
    whole = np.concatenate([w, t])
    f = lambda v: ordinal.loss(x, y, v[:5], v[5:], 0.01)[0]
    numeric = [(f(whole + 1e-6 * e) - f(whole - 1e-6 * e)) / 2e-6 for e in np.eye(8)]
    assert np.allclose(numeric, ordinal.loss(x, y, w, t, 0.01)[1], atol=1e-6)
    th = [0.3, 0.3 + math.exp(-0.2), 0.3 + math.exp(-0.2) + math.exp(0.4)]
    below = lambda k, e: 0.0 if k < 0 else 1.0 if k > 2 else 1 / (1 + math.exp(e - th[k]))
    brute = -sum(math.log(below(k, e) - below(k - 1, e)) for k, e in zip(y, x @ w)) / 40 + 0.005 * (w @ w)
    assert math.isclose(f(whole), brute, rel_tol=1e-9)


def test_fit_is_at_the_minimum():
    rows = _labelled(600)
    m = ordinal.fit(rows, steps=4000, decay=0.05)
    toxic, clean = ([c for y, c in rows if y == k] for k in (1, 0))
    assert set(m.words) == set(ordinal.telling(toxic, clean, 500, 20.0))
    x = np.array([[1 + math.log(n) if (n := ordinal.features_of(c, m.words)[f]) else 0.0 for f in m.words] for c in [*toxic, *clean]])
    # the grades that the model was fitted to, from the other half's features
    amount = np.zeros(len(toxic))
    for h in (0, 1):
        other = set(ordinal.telling(toxic[1 - h :: 2], clean[1 - h :: 2], 500, 20.0)) or m.words
        amount[h::2] = [sum(1 + math.log(n) for n in ordinal.features_of(c, other).values()) for c in toxic[h::2]]
    y = np.array([1 + sum(a >= c for c in np.quantile(amount, [1 / 3, 2 / 3])) for a in amount] + [0] * len(clean))
    t = np.concatenate([m.thresholds[:1], np.log(np.diff(m.thresholds))])
    assert np.abs(ordinal.loss(x, y, m.weights, t, 0.05)[1]).max() < 2e-3


def test_scores_against_brute_force(spark):
    docs = data.documents("sf0.01", 300)
    labels = spark.read.parquet(f"{data.DATA}/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in ordinal.toxicity(data.frame(spark, docs), labels).collect()}
    model = ordinal.fit(ordinal.sample_rows(data.frame(spark, docs), labels, "doc_id", "text", "toxic", ordinal.SAMPLE))
    strip = ordinal._STRIP.decode()
    for d, text, *_ in docs:
        words = [w for w in (w.strip(strip) for w in "".join(c.lower() if c.isascii() else c for c in text).split()) if w]
        total = 0.0
        for f, i in model.words.items():
            name = f.decode("utf-8", "surrogateescape")
            n = sum(w == name if not f.endswith(b" ") else w.encode().startswith(f[:-1]) and len(w.encode()) > len(f) - 1 for w in words)
            total += model.weights[i] * (1 + math.log(n)) if n else 0.0
        below = [1 / (1 + math.exp(max(-50, min(50, total - t)))) for t in model.thresholds] + [1.0]
        p = np.diff([0.0, *below])
        assert math.isclose(got[d].severity, p @ np.arange(4), abs_tol=1e-6) and got[d].toxic == (got[d].grade > 0) and got[d].grade == sum(c < 0.5 for c in below)


# --- quality


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "b", "é#", "$", " ", "\n", "\t", " ", "\n\n", "\U0001f600"]), max_size=40).map(" ".join))
def test_base_counts_of_any_text(text):
    raw = text.encode()
    assert quality.base_counts(raw, raw.split()) == brute_base(text)


def test_quality_against_brute_force_and_labels(spark):
    df = spark.read.parquet(f"{data.DATA}/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    for d, t, *_ in data.documents("sf0.01"):
        r, want = got[d], brute_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    labels = ds.dataset(f"{data.DATA}/sf0.01/labels.parquet").to_table().to_pylist()
    judged = [(x["quality"], got[x["doc_id"]].kept) for x in labels if not got[x["doc_id"]].base_failed]
    assert sum(k for q, k in judged if q) >= 0.98 * sum(q for q, _ in judged)
    assert sum(not k for q, k in judged if not q) >= 0.7 * sum(not q for q, _ in judged)


def test_kept_against_brute_force_bands(spark):
    df = quality.quality(spark.read.parquet(f"{data.DATA}/sf0.01/documents.parquet"))
    rows = [r.asDict() for r in quality.measure(spark.read.parquet(f"{data.DATA}/sf0.01/documents.parquet")).collect()]
    good = [r for r in rows if r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]]
    of = lambda values, q, digits: np.quantile([math.copysign(math.floor(abs(v) * 10**digits + 0.5) / 10**digits, v) for v in values], q)
    scale = lambda values, digits: (of(values, 0.75, digits) - of(values, 0.25, digits)) / 1.349
    size = lambda r: int(math.log2(r["n_words"]))
    classes, langs = {size(r) for r in good}, {r["lang"] for r in good}
    e_class = {c: of([r["entropy"] for r in good if size(r) == c], 0.5, 3) for c in classes}
    middle = {(n, x): of([r[n] for r in good if r["lang"] == x], 0.5, 3) for n in ("piece_chars", "byte_chars") for x in langs}
    e_lang = {x: of([r["entropy"] - e_class[size(r)] for r in good if r["lang"] == x], 0.5, 3) for x in langs}
    e_scale = {c: scale([r["entropy"] - e_class[c] - e_lang[r["lang"]] for r in good if size(r) == c], 3) for c in classes}
    away = lambda r, n: (r[n] - middle[n, r["lang"]]) * math.sqrt(r["n_words"])
    spread = {(n, x): scale([away(r, n) for r in good if r["lang"] == x], 2) for n in ("piece_chars", "byte_chars") for x in langs}
    want = {}
    for r in good:
        many = sum(size(o) == size(r) for o in good) >= 20
        zp, zb = (away(r, n) / spread[n, r["lang"]] for n in ("piece_chars", "byte_chars"))
        ze = (r["entropy"] - e_class[size(r)] - e_lang[r["lang"]]) / e_scale[size(r)] if many and e_scale[size(r)] > 0 else 0.0
        want[r["doc_id"]] = not (min(zp, zb) + ze < -4 or ze < -3.5 or max(zp, zb, ze) > 8 or r["fallback"] > 0.2)
    got = {r.doc_id: r.kept for r in df.collect()}
    assert all(got[r["doc_id"]] == want.get(r["doc_id"], False) for r in rows) and 20 < sum(not k for k in want.values()) < len(want) / 4


def test_entropy_and_fertility_of_a_text():
    meter = quality.fertility(quality.vocab.path("piece_bpe_32k.model"), quality.vocab.path("byte_bpe_50k.tiktoken"))
    words = b"aa bb aa \xf0\x9f\x98\x80".split()
    meter.cache.extend(words)
    ids = meter.pieces.encode("aa bb aa \U0001f600")
    n, counts = len(ids), Counter(ids)
    piece, _, fallback, entropy = meter.signals(words, 7)
    assert piece == 7 / n and math.isclose(entropy, -sum(c / n * math.log2(c / n) for c in counts.values()))
    assert fallback == sum(meter.pieces.is_byte(i) for i in ids) / n


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_quality_edge_tables(spark, kind):
    df = data.edge_tables(spark)[kind]
    got = quality.quality(df).collect()
    assert len(got) == df.count() and all(r.kept is False or r.n_words >= 50 for r in got)
