"""Block rules: a plain reading of tidy pages, awkward pages, and what each pass is good for."""

import html
import re
from collections import Counter

import pytest

from tallgrass.llm import html_blocks as hb

LONG = (
    "It was the best of times and the worst of times, as it is said in that book, and in others that we have of the same age, which were read by all who could read "
    "and by some who could not."
)
NEXT = f"And then {LONG}"
PROSE = f"<p>{LONG}</p><p>{NEXT}</p>"
RU = " ".join(["Он был так рад, что все это было для него и для них, и мы не знали, как он это сделал за год."] * 3)
JA = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所で、ニャーニャー泣いていた事だけは記憶している。" * 3
EU = " ".join(["Euskal Herriko mendietan, udazkenean, hostoak gorritzen hasten direnean, jendea perretxikotara joaten da, goizean goiz."] * 3)
LINK = "<a href=x>All of this line is one link to some other page, of which there are more</a>"
PAGES = {
    "names on body": (f'<body class="single has-sidebar comments-open"><h1>Title</h1>{PROSE}</body>', ["Title", LONG, NEXT]),
    "denied name": (f'<div class="layout-no-banner"><h1>Title</h1>{PROSE}</div>', ["Title", LONG, NEXT]),
    "wrapper with a bad name": (f'<div class="sidebar-layout"><h1>Title</h1>{PROSE}</div><p>Imprint</p>', ["Title", LONG, NEXT, "Imprint"]),
    "form around the page": (f"<form><h1>Title</h1>{PROSE}</form>", ["Title", LONG, NEXT]),
    "cyrillic": (f"<ul><li><a href=x>Меню</a></li></ul><h1>Заголовок</h1><p>{RU}</p><p>{RU}</p><footer>Подвал и все</footer>", ["Заголовок", RU, RU]),
    "no spaces": (f"<ul><li><a href=x>目次</a></li></ul><h1>題名</h1><p>{JA}</p><p>{JA}</p>", ["題名", JA, JA]),
    "unlisted language": (f"<ul><li><a href=x>Hasiera</a></li></ul><h2>Mendian</h2><p>{EU}</p><p>{EU}</p>", ["Mendian", EU, EU]),
    "math": (f"<article><p>The sum <math><mi>x</mi></math> is of note, {LONG}</p></article>", [f"The sum x is of note, {LONG}"]),
    "unclosed button": (f"<article><p>{LONG}</p><button>Share<p>{NEXT}</p></article>", [LONG, "Share", NEXT]),
    "closed button": (f"<article><p>{LONG}</p><button>Share</button><p>{NEXT}</p></article>", [LONG, NEXT]),
    "comments and a notice": (f'<div class="post"><h1>T</h1>{PROSE}</div><div class="comment-list"><p>{LONG} I say.</p></div><div class="cookie-banner"><p>{LONG}</p></div>', ["T", LONG, NEXT]),
    "a paragraph of links in an article": (f"<article>{PROSE}<p>{LINK}</p>{PROSE}</article>", [LONG, NEXT, re.sub("<.*?>", "", LINK), LONG, NEXT]),
    "no article": (f"<p>{LINK}</p><h2>Sub</h2>{PROSE}<p>Short one.</p><p>{LONG}</p><p>{LINK}</p><p>Short two.</p><p>{LINK}</p>", ["Sub", LONG, NEXT, "Short one.", LONG]),
    "only a footer": ("<article><p><b>Few words.</article><footer>" + LONG + "</footer>", ["Few words."]),
    "hidden": (f'<article>{PROSE}<p style="display:none">{LONG}</p><p hidden>{LONG}</p></article>', [LONG, NEXT]),
    "entities": ("<article><p>a &lt;b&gt; &amp;amp; &#233;&nbsp;x</p></article>", ["a <b> &amp; é x"]),
    "unclosed script": (f"<article>{PROSE}</article><script>var a = '<p>{LONG}</p>'", [LONG, NEXT]),
    "nothing": ("", [""]),
}


@pytest.mark.parametrize("name", PAGES)
def test_awkward_pages(name):
    page, want = PAGES[name]
    assert hb.main_text(page).split("\n\n") == want


def test_very_long_pages():
    n = 4000
    page = f"<nav><a href=x>Menu</a></nav><article>{PROSE * n}</article>" + "<div>" * n + "<p>x" + "</div>" * n
    assert hb.main_text(page).count("\n\n") == 2 * n - 1


def test_each_pass_changes_pages(monkeypatch):
    whole = {k: hb.main_text(p) for k, (p, _) in PAGES.items()}
    first, second = hb.first_pass, hb.second_pass

    def changed():
        return {k for k, (p, _) in PAGES.items() if hb.main_text(p) != whole[k]}

    monkeypatch.setattr(hb, "second_pass", lambda blocks, label: [bool(x) for x in label])
    assert {"cyrillic", "names on body", "no article"} <= changed()  # headings and short lines are lost
    monkeypatch.setattr(hb, "second_pass", second)
    monkeypatch.setattr(hb, "first_pass", lambda blocks: [all(e.weight >= 0 and not e.hidden for e in b.around) for b in blocks])
    assert {"cyrillic", "no article", "wrapper with a bad name"} <= changed()  # markup alone
    monkeypatch.setattr(hb, "first_pass", first)
    monkeypatch.setattr(hb, "stop_density", lambda text: 0.0)
    monkeypatch.setattr(hb, "sentence_density", lambda text: 0.0)
    assert {"cyrillic", "no spaces", "unlisted language", "no article"} <= changed()
    monkeypatch.undo()
    monkeypatch.setattr(hb, "prose_score", lambda block, density: 0)
    assert {"no article", "cyrillic"} <= changed()  # no link density, no length


def test_tidy_pages_against_a_plain_reading(spark):
    """The fixture's pages hold one article; a plain reading takes its inside."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in hb.extracted(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inside)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


TALE = "It was the best of times and the worst of times, as it is said in that book and in others that we have read. " * 4


def test_names_do_not_outvote_long_prose():
    assert hb.main_text(f'<div class="story share-enabled"><p>{TALE}</p></div>') == TALE.strip()
    assert hb.main_text(f'<div class="content-sidebar"><p>{TALE}</p></div><p>Share</p>').startswith(TALE.strip())
    assert hb.main_text(f'<div class="promo-box"><p>{TALE}</p></div><div><p>{TALE}</p></div>').count("best of times") == 8
    for page in (f'<div><p>{TALE}</p></div><div id="comments"><p>{TALE}</p></div>', f'<article><p>{TALE}</p></article><div class="banner"><p>{TALE}</p></div>', f'<article><p>{TALE}</p></article><div><p>{TALE[:110]}</p></div>'):
        assert hb.main_text(page) == TALE.strip()
    assert hb.main_text(f'<div id="comments"><p>{TALE}</p></div>') == ""


def _neutral(page, tags):
    """The page with such tags as divisions, and without classes, ids and roles."""
    page = re.sub(rf"<(/?)(?:{tags})\b", r"<\1div", page or "")
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_without_telling_markup(spark, monkeypatch):
    """Given pages with their telling tags as divisions: the rules still find nearly all blocks, and where
    even the article is a division, what they find comes from the text."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]

    def agreement(found):
        both = [(Counter(a.split("\n\n")), Counter(hb.main_text(p).split("\n\n"))) for a, p in zip(found, pages, strict=True)]
        return sum(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) for a, b in both) / len(both)

    furniture = "nav|footer|header|aside|form|menu"
    some = [hb.main_text(_neutral(p, furniture)) for p in pages]
    bare = [hb.main_text(_neutral(p, furniture + "|article|main")) for p in pages]
    assert agreement(some) > 0.97 and agreement(bare) > 0.8
    with monkeypatch.context() as m:
        m.setattr(hb, "prose_score", lambda b, density: 0)
        blind = [hb.main_text(_neutral(p, furniture + "|article|main")) for p in pages]
    assert agreement(blind) < agreement(bare) - 0.1 and sum(a != b for a, b in zip(blind, bare)) > 0.9 * len(pages)
