"""Operators that learn: held-out accuracy, planted cases, odd rows; and the pipeline against a plain version."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import html_extraction, language_id, mixing, quality_classifier, queries, url_filter
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, score double, label int"
PAGES = "page_id long, url string, html string, host string, key long, text string"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- language -----------------------------------------------------------------------------------------------


def test_op2_held_out_accuracy(spark, sf_dir, documents):
    got = queries.QUERIES["op2_language_id"](spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 20
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95


def test_languages_of_odd_rows(spark):
    english, french = "the house and the garden of the king with all that is in it", "le roi et la reine dans le jardin avec tous les oiseaux"
    rows = [(k, english if k % 2 else french, "en" if k % 2 else "fr", "s", 0.0, 1) for k in range(40)]
    rows += [(100, None, "en", None, 0.0, 1), (101, "", None, None, 0.0, 1), (102, "1234 ½ ² --- !!", "en", None, 0.0, 1), (103, english * 20_000, None, None, 0.0, 1), (103, english, None, None, 0.0, 1), (None, french, None, None, 0.0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = language_id.language_of(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0.0 for k in (100, 101, 102))
    assert all(r["lang_pred"] == "en" for r in got if r["doc_id"] == 103) and by[None]["lang_pred"] == "fr" and by[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert language_id.language_of(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.language_of(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_unseen_words_fall_back(spark):
    rows = [(k, f"haus{k}keit und der wald{k}ung", "de", "s", 0.0, 1) for k in range(60)] + [(100 + k, f"walk{k}ing the long{k}ness", "en", "s", 0.0, 1) for k in range(60)]
    model = language_id.train(spark.createDataFrame(rows, DOCS))
    names, _ = language_id.score_texts(["bedeutungkeit", "happyness jumping"], model, language_id.Remembered(model))
    assert names == ["de", "en"]


def test_op2_against_a_plain_scorer(spark, documents, monkeypatch):
    """Every row of the smallest table, and words that training didn't see; with a small model, so that entries fall out of it."""
    rows = [(r["text"], r["lang"]) for r in documents.collect() if r["text"] and r["lang"]]
    texts = [t for t, _ in rows][:60] + ["unheardofness xyzzy qqq", "éü ñandú straße"]
    for most in (20_000, 300):
        model = language_id.train(documents, top_entries=most)
        monkeypatch.setattr(language_id, "MAX_REMEMBERED", 2_000)  # words are forgotten and scored again
        names, scores = language_id.score_texts(texts, model, language_id.Remembered(model))
        want = brute.languages(rows, texts, most)
        assert names == [n for n, _ in want]
        assert scores == pytest.approx([s for _, s in want], rel=1e-2, abs=1e-6)


def test_many_languages(spark):
    """No language is left out, however many there are."""
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(k, f"qu{name(k)} und {name(k)}z", f"l{k:03d}", "s", 0.0, 1) for k in range(260)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.train(docs, model_entries=260 * 6 * 50)
    assert len(model.languages) == 260
    names, _ = language_id.score_texts([r[1] for r in rows], model, language_id.Remembered(model))
    assert names == [r[2] for r in rows]


# --- URLs ---------------------------------------------------------------------------------------------------


def test_rules_and_hosts(spark):
    urls = {
        1: ("http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("https://shop.net/", "shop.net", "/", "net/", "block"),
        3: ("https://shop.net", "shop.net", "", None, "allow"),
        4: ("ftp://example.com/de/1#z", "example.com", "/de/1", "example.com/de/", "block"),
        5: ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        6: ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"),
        7: ("no scheme", "", "", None, "allow"),
        8: (None, "", "", None, "allow"),
        9: ("", "", "", None, "allow"),
        10: ("http://a.net:80/en/", "a.net:80", "/en/", None, "allow"),
        11: ("HTTP://U.net?u=http://b.com/de/", "u.net", "", None, "allow"),
    }
    rows = [(k, v[0], None, "h", 1, "t") for k, v in urls.items()]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame([*rows, rows[0]], PAGES), queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for k, (_, host, path, rule, verdict) in urls.items():
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert rule is None or r["verdict"] == verdict
    assert got[7]["verdict"] == got[8]["verdict"] == "allow"
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES), queries.URL_RULES).count() == 0


def test_op3_against_plain_likelihoods(spark, sf_dir):
    """Scores of all pages, from models of what the rules say, and verdicts by a threshold that both held-out sides decide."""
    import re
    import zlib

    rules = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"), "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.QUERIES["op3_url_filter"](spark, sf_dir).collect()}
    text, sides = {}, {"allow": [], "block": []}
    for r in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].translate(brute.LOWER), m[2]) if m else ("", "")
        text[r["page_id"]] = re.sub("[0-9]", "0", re.sub(r"(?s)^.*?://", "", r["url"] or "", count=1).lower())
        fits = [k for k, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        assert got[r["page_id"]]["rule"] == rule
        if rule:
            sides[rules[rule][2]].append(text[r["page_id"]])
    held = lambda t: zlib.crc32(t.encode()) % 5 == 0
    fit = {side: [t for t in ts if not held(t)] for side, ts in sides.items()}
    score = lambda t: (brute.markov_log_likelihood(fit["block"], t) - brute.markov_log_likelihood(fit["allow"], t)) / (len(t) + 1)
    for r in pages[:60]:
        assert got[r["page_id"]]["score"] == pytest.approx(score(text[r["page_id"]]), abs=1e-9)
    check = {side: [score(t) for t in ts if held(t)] for side, ts in sides.items()}
    free = [r for r in got.values() if r["rule"] is None]
    line = min((r["score"] for r in free if r["verdict"] == "block"), default=np.inf)
    assert all((r["verdict"] == "block") == (r["score"] >= line) for r in free)
    if line < np.inf:
        assert np.mean([x >= line for x in check["allow"]]) <= 0.01 + 1e-9


def test_sides_that_look_alike_block_nothing(spark):
    rows = [(k, f"http://{side}/en/{w}{k % 7}.html", None, "h", 1, "t") for k, (side, w) in enumerate((s, w) for s in ("example.net", "a.b") for w in "abcdefgh" for _ in range(20))]
    same = [(1000 + k, f"http://q{k}.org/x", None, "h", 1, "t") for k in range(5)]
    alike = (url_filter.Rule("allow", "example.net", "/"), url_filter.Rule("block", "b", "/"))
    got = url_filter.filter_urls(spark.createDataFrame(rows + same + [(9, "http://x.org/" + "y" * 100_000, None, "h", 1, "t")], PAGES), alike, min_precision=1.1).collect()
    assert all(r["verdict"] == "allow" for r in got if r["rule"] is None)
    known = spark.createDataFrame([("http://casino.example/win",), (None,)], "url string")
    assert url_filter.filter_urls(spark.createDataFrame(rows, PAGES), alike, known_rejected=known).count() == len(rows)


def test_op3_learns_from_every_url_whole(spark):
    """More rows than any sample, and a URL of thousands of characters, all count."""
    import re
    import zlib
    from collections import Counter

    urls = [f"http://h{k % 7}.{'org/fr' if k % 2 else 'net'}/{'abcdefghijk'[k % 11]}{'mn' * (k % 5)}{k}" for k in range(50_000)]
    urls += ["http://x.org/fr/" + "q" * 3_000 + ".", "http://free.com/qqqq.", "http://\U0001f600.com/\U0001f600x", "http://free.com/amn0", "", None]
    text = [re.sub("[0-9]", "0", re.sub(r"(?s)^.*?://", "", u or "", count=1).lower()) for u in urls]
    models = []
    for side in (".org/fr", ".net"):
        counts = Counter()
        for t, n in Counter(t for t in text if side in t and zlib.crc32(t.encode()) % 5).items():
            padded = url_filter.START * url_filter.ORDER + t + url_filter.END
            for end in range(url_filter.ORDER + 1, len(padded) + 1):
                for size in range(1, url_filter.ORDER + 2):
                    counts[padded[end - size : end]] += n
        models.append(url_filter.MarkovModel(counts))
    assert any("q" * 3_000 in t and zlib.crc32(t.encode()) % 5 for t in text)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["score"] for r in url_filter.filter_urls(rows, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for k in [*range(200), *range(len(urls) - 6, len(urls))]:
        score = (models[1].log_likelihood(text[k]) - models[0].log_likelihood(text[k])) / (len(text[k]) + 1)
        assert got[k] == pytest.approx(score, abs=1e-9)


def test_markov_model_is_a_distribution():
    model = url_filter.MarkovModel({"a": 5, "b": 3, "ab": 3, "aa": 2, "ba": 2, "aab": 1})
    total = sum(model._probability("a" + chr(c)) for c in range(256))
    assert total == pytest.approx(1.0)
    assert model._probability("aab") > model._probability("aax")


# --- quality ------------------------------------------------------------------------------------------------


def test_op7_held_out_ranking(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.QUERIES["op7_quality_classifier"](spark, sf_dir).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    if good and bad:
        assert np.mean([x > y for x in good for y in bad]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_quality_of_odd_rows(spark):
    good, bad = "A plain sentence of some words that anybody could read. " * 5, "$$$ buy buy buy ### 123 %% " * 9
    rows = [(k, good + str(k) if k % 2 else bad + str(k), "en", "s", 0.0, 1) for k in range(200)]
    rows += [(900, None, "en", None, 0.0, 1), (901, "", None, None, 0.0, 1), (902, good * 3000, None, None, 0.0, 1), (902, good * 3000, None, None, 0.0, 1), (None, good, None, None, 0.0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(150)] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[900] == by[901]
    assert np.mean([by[k] > 0.5 for k in range(151, 200, 2)]) > 0.9 and np.mean([by[k] < 0.5 for k in range(150, 200, 2)]) > 0.9
    assert {r["score"] for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("only", [0, 1])
def test_quality_learned_from_one_class(spark, only):
    """With labels of one kind alone there is nothing to tell apart: every text scores as that kind."""
    rows = [(k, f"a text of some words number {k} " * (1 + k % 5), "en", "s", 0.0, only) for k in range(60)] + [(1000, "", "en", "s", 0.0, only), (1001, None, "en", "s", 0.0, only)]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality_classifier.quality_scores(docs, docs.select("doc_id", F.col("label").alias("quality"))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == only for r in got)


def test_op7_against_plain_ridge(spark, sf_dir, documents):
    """Weights from the whole design matrix at once, and steps from scores that were not in it."""
    import zlib

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(documents, labels)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in texts]
    fold = lambda i: zlib.crc32(f"fold{i}".encode()) % 4
    stats = lambda part: np.array([quality_classifier.statistics((texts[i] or "").encode()) for i, _ in part])
    fit, check = [r for r in rows if fold(r[0]) > 0], [r for r in rows if fold(r[0]) == 0]
    x, y = model.features(stats(fit)), np.array([q for _, q in fit], float)
    n, width = x.shape
    tall = np.vstack([x, np.sqrt(1e-3 * n) * np.eye(width)])
    weights = np.linalg.lstsq(tall, np.concatenate([y, np.zeros(width)]), rcond=None)[0]
    assert model.raw(stats(rows)) == pytest.approx(model.features(stats(rows)) @ weights, abs=1e-4)
    assert (np.diff(model.steps[1]) >= 0).all() and len(check) > 0
    one_class = quality_classifier.quality_scores(documents, labels.filter("quality = 1")).collect()
    assert len(one_class) == len(texts) and all(0 <= r["score"] <= 1 for r in one_class)


def test_isotonic():
    out = quality_classifier.isotonic(np.array([1.0, 3.0, 2.0, 2.0, 5.0]), np.array([1.0, 1.0, 1.0, 2.0, 1.0]))
    assert (np.diff(out) >= 0).all() and out.tolist() == [1.0, 2.25, 2.25, 2.25, 5.0]


# --- pages --------------------------------------------------------------------------------------------------


def page(host: str, k: int, body: str) -> tuple:
    html = f"<html><head><title>t</title><style>p{{}}</style></head><body><div class='top'>Our House</div><ul id='menu'><li>Home<li>About</ul>{body}<div>All rights reserved</div><script>x<y</script></body></html>"
    return (k, f"https://{host}/p/{k}", html, "h", 1, "t")


def test_templates_without_articles(spark):
    """Text that stands on every page of a host is template, whatever its element; what differs is extracted."""
    rows = [page("a.example.com", k, f"<div class='text'><p>Story {k} is told here &amp; in   full,<br>with <b>bo</b>ld {'long words ' * k}.</p><p>Second part {k}</p></div>") for k in range(12)]
    got = {r["page_id"]: r for r in html_extraction.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(12):
        words = ("long words " * k).strip()
        middle = " ".join(f"Story {k} is told here & in full, with bold {words} .".split()) if words else f"Story {k} is told here & in full, with bold ."
        assert got[k]["text"].replace(" .", ".") == f"{middle} Second part {k}".replace(" .", ".")
        assert got[k]["n_chars"] == len(got[k]["text"])


def test_articles_and_odd_pages(spark):
    article = "<nav>Menu</nav><article><h1>Head</h1><p>One<br>two &lt;3<div class='comments'><p>nice!</p></div><form>Name <input></form><p>End</article><aside>More</aside>"
    rows = [
        (1, "http://x.example.org/1", article, "h", 1, "t"),
        (2, "http://x.example.org/2", None, "h", 1, "t"),
        (3, None, "", "h", 1, "t"),
        (4, "nothing", "<p>broken <b>markup</p> 1 < 2 &nbsp; &copy; &#x41;", "h", 1, "t"),
        (5, "http://x.example.org/5", "<article>" + "<p>word " * 50_000, "h", 1, "t"),
        (5, "http://x.example.org/5", "<article>" + "<p>word " * 50_000, "h", 1, "t"),
        (6, "http://x.example.org/6", "<div>" * 3000 + "deep" + "</div>" * 3000, "h", 1, "t"),
        (7, "http://x.example.org/7", "<!-- a > b --><script>'</p>'</script><main>Kept</main><footer>gone</footer>", "h", 1, "t"),
    ]
    got = html_extraction.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "Head One two <3 End"
    assert by[2] == by[3] == ""
    assert by[4] == "broken markup 1 < 2 © A"
    assert by[5] == " ".join(["word"] * 50_000)
    assert by[6] == "deep" and by[7] == "Kept"
    assert html_extraction.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_short_slots_beside_a_long_one(spark):
    """Pages with varying numbers of paragraphs, a heading and one very long paragraph keep all of them."""
    parts = {k: [f"Head {k}", *(f"Short {k} {n}" for n in range(1 + k % 5)), f"long {k} " * 400, f"Last {k}"] for k in range(12)}
    rows = [page("b.example.com", k, f"<div class='text'><h1>{p[0]}</h1>" + "".join(f"<p>{x}</p>" for x in p[1:]) + "</div>") for k, p in parts.items()]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: " ".join(" ".join(p).split()) for k, p in parts.items()}


def boilerplate(k: int) -> str:
    """Articles with a line that all of a host have, a share box without a telling name, and comments on some."""
    comments = f"<div class='comments'><p>Nice {k}</p><p>Me too {k}</p></div>" if k % 6 == 0 else ""
    return f"<article><h1>Title {k}</h1><p>Read us every day</p>" + "".join(f"<p>Part {n} of {k}</p>" for n in range(1 + k % 4)) + f"<div><a href='/s'>Send to a friend {k}</a></div>{comments}</article>"


def test_op9_against_a_plain_version(spark, sf_dir):
    """The driver's pages and hosts of other shapes, page by page."""
    rows = [(r["page_id"], r["url"], r["html"], "h", 1, "t") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(10_000 + k, *page("c.example.com", k, boilerplate(k))[1:]) for k in range(24)]
    rows += [(20_000 + k, *page("d.example.com", k, f"<div class='text'><p>Story {k}</p>{'<p>More</p>' * (k % 3)}</div>")[1:]) for k in range(9)]
    rows += [(30_000, "http://alone.example.org/", "<p>Only <a href='/'>one</a></p><nav>Menu</nav>", "h", 1, "t"), (30_001, None, None, "h", 1, "t"), (30_002, None, "<p>free", "h", 1, "t")]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    want = brute.main_texts([r[:3] for r in rows])
    assert got == want
    # in articles too the template has its say: the line that all pages have is gone, and so are comments
    assert all(got[10_000 + k] == " ".join([f"Title {k}", *(f"Part {n} of {k}" for n in range(1 + k % 4)), f"Send to a friend {k}"]) for k in range(24))


def test_the_template_decides(spark, sf_dir):
    """Without a template a page is one slot, and with all tokens as template nothing is left: both change pages."""
    pages = [html_extraction.Page(r["html"] or "").tokens for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    real = {r["page_id"]: r["text"] for r in queries.QUERIES["op9_html_extraction"](spark, sf_dir).collect()}
    empty = html_extraction.Template([], [], [], [], kept=(0,), kept_loosely=(0,))
    for tokens, text in zip(pages, real.values()):
        hashes = np.array([html_extraction.token_hash(t) for t, _ in tokens], np.int64)
        kinds = np.array([int(x) if isinstance(x, bool) else html_extraction.BLOCK for _, x in tokens], np.int64)
        texts = [x[0] for _, x in tokens if not isinstance(x, bool)]
        assert html_extraction.main_text(hashes, kinds, texts, empty) == " ".join(texts) != text
        full = html_extraction.Template(hashes, kinds, np.arange(len(hashes)), np.zeros(len(hashes)), kept=(0,), kept_loosely=(0,))
        assert html_extraction.main_text(hashes, kinds, texts, full) == ""


def test_a_hot_host_is_dealt_over_salts(spark, monkeypatch):
    from tallyspark.llm import common

    rows = [page("hot.example.com" if k % 3 else f"h{k}.example.com", k, boilerplate(k)) for k in range(60)]
    frame = spark.createDataFrame(rows, PAGES)
    want = sorted(map(tuple, html_extraction.extract_main_text(frame).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(html_extraction, "BROADCAST_TOKENS", 0)
    assert sorted(map(tuple, html_extraction.extract_main_text(frame).collect())) == want

def test_paths_are_told_whole(spark):
    """Elements far below different parents differ, however long the way down is."""
    page = lambda top: html_extraction.Page(f"<div class='{top}'>" + "<section class='a long name of a section'>" * 60 + "<p>text</p>")
    a, b = (page(top).tokens for top in ("one", "other"))
    assert len(a) == len(b) and all(x[0] != y[0] for x, y in zip(a, b)) and a == page("one").tokens


# --- the pipeline -------------------------------------------------------------------------------------------


def test_pipeline_against_a_plain_version(spark, sf_dir, documents):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = documents.select(columns)
    import zlib

    rows = docs.collect()
    learned = [(r["text"], r["lang"]) for r in rows if r["text"] and r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    lettered = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    scores = [s for _, s in brute.languages(learned, [r["text"] for r in lettered], 20_000)]
    assert all(abs(s - 0.5) > 0.01 for s in scores)  # scores are of half precision, so none may stand at the border
    kept = [r for r, s in zip(lettered, scores) if s >= 0.5]
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert first.columns == columns
    assert {r["doc_id"] for r in first.select("doc_id").collect()} == {r["doc_id"] for r in kept}
    last = {}
    for r in kept:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    roots = brute.similar_roots({i: t for t, i in last.items()})
    left = {i for i, root in roots.items() if root == i}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r["doc_id"] for r in out]
    assert set(ids) <= left
    chosen = docs.filter(F.col("doc_id").isin(sorted(left)))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(chosen).collect() if r["copies"]}
    assert {i: ids.count(i) for i in set(ids)} == copies
    texts = {r["doc_id"]: r["text"] for r in kept}
    import hashlib

    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in out)
    sizes, taken = {}, {}
    for r in chosen.collect():
        n = brute.text_counts(r["text"])[0]
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        taken[r["source"]] = taken.get(r["source"], 0) + n * copies.get(r["doc_id"], 0)
    longest = max(brute.text_counts(t)[0] for t in texts.values())
    assert all(abs(taken[s] - t) <= longest for s, t in brute.targets(sizes).items())


def test_stages_on_odd_rows(spark, sf_dir, monkeypatch):
    """Each stage, and all of them, on null, empty, repeated and very long rows, and on no rows."""
    import corpus_pipeline

    text = "the house and the garden of the king with all that is in it number {}"
    rows = [(k, text.format(k) + f" and word{k} " * (k % 7), "en", "hot" if k % 3 else None, 1) for k in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (None, text.format("x"), None, "a", 1), (None, text.format("x"), None, "a", 1), (7, rows[7][1], "en", "hot", 1), (7, "one more text of the same id in the garden of the king", "en", "hot", 1), (102, text.format("long") * 5_000, "en", "b", 1), (103, "1234 5678", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == frame.columns
        out = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
        if frame is docs:
            assert out and all(r["n_tokens"] == len(r["ids"]) > 0 for r in out)
            assert {101, 103, 100}.isdisjoint(r["doc_id"] for r in out)
        else:
            assert out == []
