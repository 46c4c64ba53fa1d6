import html as htmllib
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from codeatlas.llm import html_extract as he
from tests.conftest import SMALL

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body><nav><ul><li><a href="/a">menu{k}</a></li></ul></nav><header>Site head</header>'
    '<!-- ad --><div class="ad">buy {k}</div><article><h1>Title {k} &amp; more</h1><p><b>First&nbsp;para {k}.<br><p>Second\n  line.</p><form>f</form><div class="comments">c {k}</div></article>'
    "<aside>side</aside><footer>&copy; site</footer></body></html>"
)


def test_article_text(spark):
    rows = [(k, f"https://Host{k % 2}.example.com/p/{k}", PAGE.format(k=k)) for k in range(8)]
    rows += [(50, None, PAGE.format(k=50)), (51, "https://x.example.com/", None), (52, "https://x.example.com/", ""), (53, "https://x.example.com/", "<p>plain<p>text <b"), (3, rows[3][1], rows[3][2])]
    got = he.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = {51: "", 52: "", 53: "plain\ntext"}.get(r.page_id, f"Title {r.page_id} & more\nFirst para {r.page_id}.\nSecond line.")
        assert (r.text, r.n_chars) == (want, len(want))
    assert all(r.n_template > 5 for r in got if r.page_id < 8) and next(r for r in got if r.page_id == 50).n_template == 0


def test_template_texts_go_where_there_is_no_article(spark):
    pages = [(k, f"http://h.org/{k}", f"<body><div>Welcome to h</div><div><p>Body number {k}</p></div><p>All rights</p></body>") for k in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in he.report(df).collect()} == {(k, f"Body number {k}") for k in range(6)}
    assert he.report(df.limit(0)).count() == 0


def test_template_texts_inside_the_article_go_on_large_hosts(spark):
    nav = "<nav><ul><li><a>Home</a></li><li><a>News</a></li><li><a>About</a></li></ul></nav>"
    page = "<body>{nav}<div>Site of {h}</div><article><h1>Title {k}</h1>{ps}<p>Read it in our app</p><p>By <b>{k}</b></p></article></body>"
    made = lambda h, k: page.format(nav=nav, h=h, k=k, ps="".join(f"<p>Para {k} {i}</p>" for i in range(1 + k % 3)))
    rows = [(k, f"http://large.org/{k}", made("large", k)) for k in range(12)] + [(100 + k, f"http://small.org/{k}", made("small", k)) for k in range(6)]
    rows += [(200 + k, f"http://copies.org/{k}", made("copies", 0)) for k in range(12)]
    got = {r.page_id: r.text for r in he.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        paras = [f"Para {k} {i}" for i in range(1 + k % 3)]
        assert got[k].split("\n") == [f"Title {k}", *paras, f"By {k}"]
        assert k > 5 or got[100 + k].split("\n") == [f"Title {k}", *paras, "Read it in our app", f"By {k}"]
        assert got[200 + k].split("\n") == ["Title 0", "Para 0 0", "Read it in our app", "By 0"]


def test_all_containers_count():
    text = lambda page: he.main_text(he.read_page(page))
    card = "<article class='card'>Card</article>"
    assert text(f"<body><div>menu</div><main><h1>H</h1><p>Lead</p>{card}<article><p>A</p><article>Inner</article>B</article><p>End</p></main></body>") == "H\nLead\nCard\nA\nInner\nB\nEnd"
    assert text(f"<body>{card}<main><p>A long body of the page</p></main></body>") == "Card\nA long body of the page"
    assert text("<body><article>One</article><div>between</div><article><p>Two</p><div class='comments'><article>c</article></div></article><article class='teaser'>t</article></body>") == "One\nTwo"
    assert text("<body><article></article><p>Body</p></body>") == "Body"


def test_hosts_on_one_layout_keep_their_own_templates(spark):
    page = "<body><div><p><b>Site {h}</b></p></div><ul><li><i>Body {k} of {h}</i></li></ul><h2>All rights</h2></body>"
    rows = [(10 * h + k, f"http://host{h}.org/{k}", page.format(h=h, k=k)) for h in range(12) for k in range(4)]
    got = he.report(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert {(r.page_id, r.text) for r in got} == {(10 * h + k, f"Body {k} of {h}") for h in range(12) for k in range(4)}


def test_templates_alone_find_the_given_articles(spark, monkeypatch):
    """With all names of boilerplate forgotten the templates give the same texts."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    named = sorted((r.page_id, r.text) for r in he.report(pages).collect())
    for names in ("MARKS", "DROPPED", "DROPPED_OUTSIDE", "ROLES"):
        monkeypatch.setattr(he, names, set())
    assert sorted((r.page_id, r.text) for r in he.report(pages).collect()) == named
    article = lambda html: re.sub(r"<[^>]*>", " ", re.search(r"(?s)<article>(.*)</article>", html)[1])
    plain = lambda text: " ".join(htmllib.unescape(text).split())
    assert [(r.page_id, plain(article(r.html))) for r in pages.orderBy("page_id").collect()] == [(i, plain(t)) for i, t in named]


def test_classes_match_brute_force(spark):
    rng, rows = random.Random(8), []
    for k in range(60):
        parts = [f"<div class='{c}'>{rng.choice(['same', f'other {k}'])}<p>{c}</p></div>" * rng.randrange(3) for c in "abcd"]
        rows.append((k, f"http://h{k % 3}.org/{k}", "<body><h1>Top</h1>" + "".join(parts) + f"<footer>end{k % 2}</footer></body>"))
    rows += rows[:4]
    read = he.pages_read(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"])
    got = {(r.group, r.token): r.valid for r in he.template_tokens(read).collect()}
    vectors, sizes = defaultdict(lambda: defaultdict(list)), Counter(f"host {he.host_of(u)}" for _, u, _ in rows)
    for n, (_, url, html) in enumerate(rows):
        for token, times, *_ in he.tokens_of(he.read_page(html)):
            vectors[f"host {he.host_of(url)}"][token].append((n, times))
    want = {}
    for group, tokens in vectors.items():
        often = {t: tuple(v) for t, v in tokens.items() if len(v) >= max(he.MIN_PAGES, he.SUPPORT * sizes[group])}
        classes = Counter(often.values())
        want |= {(group, t): classes[v] >= he.MIN_TOKENS for t, v in often.items()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_main_slot_without_names(spark):
    page = "<body><div class='x1'>Go {h} <a>{k}</a></div><div class='x2'><div class='y'><h2>T{k}</h2>{ps}</div></div><div class='x3'>{k} other stories</div></body>"
    rows = [(k, f"http://h.org/{k}", page.format(h="home", k=k, ps="".join(f"<p>Paragraph {i} of the story {k}</p>" for i in range(1 + k % 4)))) for k in range(8)]
    got = {r.page_id: r.text for r in he.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].split("\n") == [f"T{k}", *[f"Paragraph {i} of the story {k}" for i in range(1 + k % 4)]] for k in range(8))


def test_long_pages_and_columns_of_the_caller(spark):
    long = "<article>" + "<p>word <b>bold</b> &amp; more</p>" * 100_000 + "</article>"
    rows = [(1, "http://a.org/", long, "mine", "g", 5), (2, "http://a.org/2", "<div>" * 3000 + "deep", "yours", "h", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `group` string, kept int")
    got = he.extract(pages, ["page_id", "text", "group", "kept"]).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.group, r.kept) for r in got] == [(1, "mine", "g", 5), (2, "yours", "h", 6)]
    assert got[0].text_.split("\n") == ["word bold & more"] * 100_000 and got[1].text_ == "deep"


@pytest.mark.parametrize("unit", ["<font>word ", "<div>x", "</b>x", "<font><li>w", "<p><font>w ", "word<!-- c -->"])
def test_a_megabyte_of_unclosed_markup_takes_seconds(unit):
    page = "<div>" * 12_000 * (unit == "</b>x") + unit * (1_000_000 // len(unit))
    begun = time.time()
    read = he.read_page(page)
    he.tokens_of(read)
    text = he.main_text(read)
    assert time.time() - begun < 20 and text
    assert read.chars[0] == sum(len(" ".join(t.split())) for t in read.text)
