"""Archives, page texts and url verdicts on hand-made rows."""

import gzip
import io
import zipfile

import pytest

from turnstile.llm import htmltext, urls, warczip

PAGES = "page_id long, url string, html string, verdict string"
LONG = "<p>" + "word, " * 50_000


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


# --- archives


def test_round_trip_with_revisits(spark):
    rows = [(3, "http://a/é ü\r\nX: y", "same", "s"), (1, None, "same", "s"), (7, "u", "other", None), (7, "u", "other", None), (5, "u", None, "s"), (6, "u", "", None), (None, "u", "same", None), (None, "v", "alone", None), (9, "w", LONG + "é", "s")]
    archives = warczip.write_archives(pages(spark, rows), archive_bytes=200)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    found = sorted(((r.page_id, r.payload, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warczip.read_archives(archives).collect()), key=str)
    kinds = {3: 1, None: 1, 6: 5}
    expected = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        other = kinds.get(page_id) if html != "alone" else None
        expected.append((page_id, None if other else raw, len(raw), warczip.digest(raw), "revisit" if other else "response", other))
    assert found == sorted(expected, key=str)


def test_small_payloads_are_responses(spark):
    archives = warczip.write_archives(pages(spark, [(1, "u", "ab", None), (2, "u", "ab", None)]), min_bytes=3)
    assert {r.record_type for r in warczip.read_archives(archives, with_payload=False).collect()} == {"response"}


def test_no_pages(spark):
    assert warczip.read_archives(warczip.write_archives(pages(spark, []))).isEmpty()


def test_digest_is_the_known_one():
    assert warczip.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


@pytest.mark.parametrize("wide", [False, True])
def test_directories_of_other_writers(wide, monkeypatch):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for i in range(3):
            with z.open(f"m{i}", "w", force_zip64=wide) as m:
                m.write(f"content of member {i}".encode())
        z.comment = b"a comment with PK"
        z.writestr("packed", "x" * 100, compress_type=zipfile.ZIP_DEFLATED)
    assert (b"PK\x06\x06" in raw.getvalue()) == wide
    found = warczip.members(raw, len(raw.getvalue()))
    for i in range(3):
        m = found[f"m{i}"]
        raw.seek(warczip.data_start(raw, m))
        assert raw.read(m.size) == f"content of member {i}".encode()
    with pytest.raises(ValueError, match="compressed"):
        warczip.data_start(raw, found["packed"])
    with pytest.raises(ValueError, match="no ZIP directory"):
        warczip.members(io.BytesIO(b"nothing"), 7)


def test_a_damaged_record_is_refused():
    raw = warczip.record(1, "http://x/", b"payload", None)
    assert warczip.parse(gzip.decompress(gzip.compress(raw))).payload == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warczip.parse(raw.replace(b"payload\r\n", b"pAyload\r\n"))


# --- page texts

_PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li>Home<li>About</ul></nav>
<div class="ad">Buy, buy, buy now!</div>%s<aside>More links</aside><form>Mail <input></form><footer>&copy; all</footer><script>var t="</p>";</script></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A &amp; B</h1><p><b>First line,\n of text.<br><p>Second, with <i>mark</i>up.</p></article>", "A & B\nFirst line, of text.\nSecond, with markup."),
        ("<main><h2>Short</h2><p>x</p></main>", "Short\nx"),
        ("<div class='content with-sidebar'><h2>Title</h2><p>Long text, with words. More, and more.</p><p>ok</p><div id=comments><p>I disagree, strongly.</p></div></div>", "Title\nLong text, with words. More, and more.\nok"),
        ("<article><header><h1>In</h1></header><p>Text, here.</p><footer>by me</footer></article>", "In\nText, here."),
        ("<article><!-- <p>no</p> --><p>caf&eacute; &#233;&nbsp;x</p><p hidden>no</p><div style='display:none'>no</div></article>", "café é x"),
    ],
)
def test_articles(body, text):
    assert htmltext.main_text(_PAGE % body) == text


@pytest.mark.parametrize(("html", "text"), [("", ""), ("   ", ""), ("<nav>x</nav>", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<script>no end", ""), ("<!-- no end", ""), ("a < b", "a < b"), ("</p></div>x", "x")])
def test_fragments(html, text):
    assert htmltext.main_text(html) == text


def test_odd_pages_take_linear_time():
    for html in ("<a" * 200_000, "<div>" * 3_000 + "x", '<a "' * 20_000, LONG):
        htmltext.main_text(html)


def test_ratios_favour_long_punctuated_paths():
    p, li = ("body", "p"), ("body", "li")
    fused = htmltext.fused_ratios([(li, "Home"), (li, "About"), (p, "A long text, with marks, and words."), (p, "Another, longer text. With marks."), (li, "Imprint")])
    assert min(fused[2:4]) > max(fused[0], fused[1], fused[4])


def test_page_rows(spark):
    rows = [(1, "u", "<article><p>Hi", "s"), (1, "u", "<article><p>Hi", "s"), (2, None, None, None), (None, "v", "", None)]
    found = htmltext.extract(pages(spark, rows).withColumnRenamed("verdict", "text"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, "u", "Hi", 2), (1, "u", "Hi", 2), (2, None, "", 0), (None, "v", "", 0)]))
    assert htmltext.extract(pages(spark, [])).isEmpty()


# --- urls


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12?x", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2#y", "example.org", "/en/2", "org/", "allow"),
        ("http://xexample.org/es/", "xexample.org", "/es/", "org/", "allow"),
        ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
        ("http://a.org", "a.org", "", None, None),
        ("http://a.com?u=://b.org/", "a.com", "", None, None),
        ("a.org/x", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = urls.judge(pages(spark, [(1, url, None, "s")])).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == (verdict or "allow")


def test_weights_equal_the_model_by_hand(spark):
    from math import log

    good, bad = ["http://good.org/", "http://gold.org/a"], ["http://bad.com/de/"]
    marked = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean")
    counts = urls._counts(marked)

    def chance(seen, context, char):
        p = urls.UNSEEN
        for k in range(urls.ORDER + 1):
            c = context[len(context) - k :]
            follow = [text[i + k] for text in seen for i in range(len(text) - k) if text[i : i + k] == c and i + k >= urls.ORDER]
            if follow:
                p = (follow.count(char) + len(set(follow)) * p) / (len(follow) + len(set(follow)))
        return p

    pad = urls._START * urls.ORDER
    asked = "http://gone.com/d"
    padded = pad + asked
    total = 0
    for i in range(urls.ORDER, len(padded)):
        context, char = padded[i - urls.ORDER : i], padded[i]
        total += round(1e6 * (log(chance([pad + u for u in good], context, char)) - log(chance([pad + u for u in bad], context, char))))
    score = urls.scores(spark.createDataFrame([(asked,)], "url string"), counts).first().score
    assert score == pytest.approx(total / len(asked) / 1e6, abs=1e-6)


def test_urls_like_rejected_ones_are_blocked(spark):
    rows = [(i, f"http://site{i}.org/news/{i}", None, "s") for i in range(60)] + [(100 + i, f"http://pills{i}.com/de/buy{i}", None, None) for i in range(60)]
    rows += [(1000, "http://pills9.net/de/buy3", None, None), (1000, "http://pills9.net/de/buy3", None, None), (1001, "http://site7.net/news/9", None, None), (None, None, None, None), (1002, "http://x.net/" + "a" * 20_000, None, None)]
    found = {r.page_id: r.verdict for r in urls.judge(pages(spark, rows)).collect()}
    assert len(found) == 60 + 60 + 3 + 1
    assert found[1000] == "block" and found[1001] == "allow" and found[None] == "allow"
    assert urls.judge(pages(spark, [])).isEmpty()


def test_no_table_goes_to_the_driver_to_be_broadcast(spark, monkeypatch):
    """Files of many like urls are small, and the rows they hold are not."""
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return written(df, name)

    written = urls.written
    monkeypatch.setattr(urls, "written", noted)
    rows = [(i, f"http://site{i}.{end}/de/{i}", None, "s") for i in range(20) for end in ("org", "com", "net")]
    judged = urls.judge(pages(spark, rows))
    plans.append(judged._jdf.queryExecution().toString())
    assert judged.count() == 60 and sum("SortMergeJoin" in p for p in plans) == 2
    assert not any("Broadcast" in p for p in plans)


# --- marks of elements

SENTENCES = "A sentence, with some words, of an article. " * 8
ARTICLE = f"<p>{SENTENCES}</p>" * 3


@pytest.mark.parametrize("around", ["<form>{}</form>", "<div aria-hidden='false'>{}</div>", "<div class='promo'>{}</div>", "<div class=a-side>{}</div>", "<aside><div id='sidebar'>{}</div></aside>", "<div role=search>{}</div>"])
def test_a_mark_around_the_whole_article_does_not_lose_it(around):
    whole = "\n".join([SENTENCES.strip()] * 3)
    assert htmltext.main_text(f"<body>{around.format(ARTICLE)}</body>") == whole
    assert htmltext.main_text(f"<body><h1>A, title.</h1>{around.format(ARTICLE + '<div class=sidebar>Side, text.</div>')}</body>").count(SENTENCES.strip()) == 3


def test_marks_in_values_of_other_attributes_say_nothing():
    page = f"<article>{ARTICLE}<p title='the hidden cost'>One, kept.</p><p data-id='side' data-class=promo>Two, kept.</p><p hidden>Not seen.</p><p aria-hidden=true>Nor this.</p></article>"
    assert htmltext.main_text(page).endswith("One, kept.\nTwo, kept.")


@pytest.mark.parametrize("name", ["comment-content", "comments-wrapper", "ad-container", "sidebar-content", "post-comments", "article share"])
def test_marked_names_with_words_of_an_article_are_left_out(name):
    page = f"<article>{ARTICLE}<div class='{name}'>Other, text of someone else.</div><p>The end, kept.</p></article>"
    assert "someone" not in htmltext.main_text(page) and htmltext.main_text(page).endswith("The end, kept.")


def test_names_that_tell_of_a_layout_are_no_marks():
    page = f"<body><div class='page has-sidebar'><div class='content no-ads'>{ARTICLE}</div></div></body>"
    assert htmltext.main_text(page).count(SENTENCES.strip()) == 3


def test_ratios_equal_sums_by_path():
    nodes = [(("body", "p"), "One, two, three."), (("body", "div"), "Menu"), (("body", "p"), "Four words, of text!"), (("body",), "x")]
    by_path = {}
    for path, text in nodes:
        by_path.setdefault(path, []).append(text)
    mean = {p: (sum(map(len, t)) / len(t), sum(sum(not c.isalnum() and not c.isspace() for c in x) for x in t) / len(t)) for p, t in by_path.items()}
    raw = [mean[p] for p, _ in nodes]
    wanted = []
    for i in range(len(raw)):
        near = [raw[max(0, i - 1)], raw[i], raw[i], raw[min(len(raw) - 1, i + 1)]]
        length, marks = (sum(x[k] for x in near) / 4 for k in (0, 1))
        wanted.append((length * (1 + marks)) ** 0.5)
    assert htmltext.fused_ratios(nodes) == pytest.approx(wanted)
