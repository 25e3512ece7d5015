import html
import math
import random
import re
import time
from collections import Counter

import pytest

from pyspark.sql import functions as F

from cohortlens.llm import html_text

PROSE = "Long sentence of an article, with commas, and a proper end. It goes on for a while, as articles do."


def test_generated_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_parts_that_are_no_article():
    page = f"""<html><head><title>T</title><style>p{{}}</style><script>if (a < b) x("</p>")</script></head><body>
    <header><h1>Site</h1></header><div id="cookie-notice"><p>{PROSE}</p></div><ul class="main-menu"><li>One<li>Two</ul>
    <main><h1>Title &amp; more</h1><p>{PROSE}<p class=lead>Second &lt;b&gt;<br>line&nbsp;here <b>bold
    text</b>.</p><form><p>{PROSE}</p></form><div class="comments"><p>{PROSE}</p></div><aside><p>{PROSE}</p></aside></main>
    <div class="sidebar"><p>{PROSE}</p></div><footer><p>{PROSE}</p></footer></body></html>"""
    assert html_text.main_text(page) == f"Title & more\n{PROSE}\nSecond <b> line here bold text."


def test_unmarked_page_by_ratios():
    body = "".join(f"<p>{PROSE} {k}</p>" for k in range(6))
    links = "".join(f"<div><a href=x>l{k}</a></div>" for k in range(20))
    page = f"<body><table><tr><td>{links}</td></tr></table><div><div><h2>Head</h2>{body}</div></div><table><tr><td>{links}</td></tr></table></body>"
    assert html_text.main_text(page) == "\n".join(["Head"] + [f"{PROSE} {k}" for k in range(6)])


def test_names_that_only_mention_boilerplate():
    page = f"<body><div class='page no-sidebar'><article><div class='entry-header'><h1>Head</h1></div><p>{PROSE}</p><div class='related-posts'><p>{PROSE}</p></div><div id='notice'>{PROSE}</div></article></div></body>"
    assert html_text.main_text(page) == f"Head\n{PROSE}"


def test_broken_html_does_not_fail():
    for page in (None, "", "<", "<p", "a < b & c", "<!-- open", "<p>x</div></p></p><b><i></b>", "<script>never closed", "<" * 5000, '<a title="a>b">t</a>', "<p>" * 3000 + "x"):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text('<a title="a>b">t</a>') == "t"


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", f"<article><p>{PROSE}</p></article>"), (2, "u", f"<article><p>{PROSE}</p></article>"), (3, "v", "<article><p>" + "word, " * 50000 + "</p></article>")], "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = {(r.page_id, r.url, r.n_chars) for r in html_text.extract(df).collect()}
    assert got == {(1, None, 0), (None, "u", 0), (2, "u", len(PROSE)), (3, "v", 299999)}
    assert html_text.extract(df.limit(0)).count() == 0


def plain_text(nodes):
    """The rule of the module over (parent path, tag, text, factor, marked), in plain Python."""
    key = lambda n: (n[0], n[1], n[3], n[4])
    groups = {k: [n for n in nodes if key(n) == k] for k in map(key, nodes)}
    size = {k: sum(len(n[2]) for n in g) / len(g) for k, g in groups.items()}
    signs = {k: sum(c in ".,;:!?" for n in g for c in n[2]) / len(g) for k, g in groups.items()}

    def smooth(x):
        out = []
        for i in range(len(x)):
            near = [(math.exp(-(d * d) / 8), x[i + d]) for d in range(-2, 3) if 0 <= i + d < len(x)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    own = [size[key(n)] for n in nodes]
    plain, extended = smooth(own), smooth([size[key(n)] * math.log2(2 + signs[key(n)]) for n in nodes])
    fused = [c ** (2 / 3) * (a * b) ** (1 / 6) for a, b, c in zip(plain, extended, own)]
    ratio = {k: sum(f for f, n in zip(fused, nodes) if key(n) == k) / len(g) for k, g in groups.items()}
    some = any(n[4] for n in nodes)
    prior = {k: k[2] * (64 if k[1] != "div" else 1) * (1 / 256 if some and not k[3] else 1) for k in groups}
    score = {k: ratio[k] * prior[k] for k in groups}
    able = {k for k in groups if k[2] > 1e-6}
    judged = {k for k in able if k[1] != "h2"} or able
    keep = {k for k in able if score[k] >= 0.2 * max(ratio[j] * min(1, prior[j]) for j in judged)}
    if not keep & judged:
        keep |= {max(judged, key=lambda k: score[k])}
    parents = {k[0] for k in keep if k[1] != "h2"}
    alone = not {k for k in able if k[1] != "h2"}
    stay = lambda k: k in able and (k[0] in parents or k in keep and (k[3] or alone)) if k[1] == "h2" else k in keep
    return "\n".join(n[2] for n in nodes if stay(key(n)))


@pytest.mark.parametrize("marked", [False, True])
def test_ratios_match_the_plain_rule(marked):
    rng = random.Random(3)
    kept = 0
    for _ in range(150):
        nodes, page = [], []
        for _ in range(rng.randint(2, 6)):
            home = rng.choice(["main", "section", "article" if marked else "main"]).replace("main", "center")
            name = rng.choice(["", "", "legal", "sidebar"]) if home != "article" else ""
            inner = []
            for _ in range(rng.randint(1, 5)):
                tag = rng.choice(["p", "div", "h2", "blockquote"])
                text = " ".join(rng.choice(["word", "longer", "it,", "end.", "a"]) for _ in range(rng.choice([1, 3, 12, 60])))
                factor = {"": 1.0, "legal": 0.5, "sidebar": 1e-9}[name]
                nodes.append((f"{home}{name}", tag, text, factor, home == "article"))
                inner.append(f"<{tag}>{text}</{tag}>")
            page.append(f"<{home}{f' class={name}' if name else ''}>{''.join(inner)}</{home}>")
        if all(n[3] < 0.1 for n in nodes):
            continue
        got = html_text.main_text(f"<body>{''.join(page)}</body>")
        assert got == plain_text(nodes)
        kept += 0 < len(got) < sum(len(n[2]) for n in nodes)
    assert kept > 50


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_ratios_decide_on_a_box_without_a_name(around):
    page = lambda box: f"<body><nav>Menu</nav><{around}><h1>Head</h1><p>{PROSE}</p><div>{box}</div><p>{PROSE * 3}</p></{around}></body>"
    assert html_text.main_text(page("Buy now")) == f"Head\n{PROSE}\n{PROSE * 3}"
    assert html_text.main_text(page(PROSE)) == f"Head\n{PROSE}\n{PROSE}\n{PROSE * 3}"


def test_a_clear_ratio_outweighs_the_mark():
    page = lambda text: f"<body><div><p>{text}</p></div><main><p>Choose a page.</p></main></body>"
    assert html_text.main_text(page(PROSE * 9)) == f"{PROSE * 9}\nChoose a page."
    page = lambda text: f"<body><div>{text}</div><main><p>{PROSE}</p></main></body>"
    assert html_text.main_text(page(PROSE)) == PROSE
    assert html_text.main_text(page(PROSE * 600)) == f"{PROSE * 600}\n{PROSE}"


@pytest.mark.parametrize("part", ['<article class="comment">', "<article hidden>", '<article class="advert">', '<section role="complementary">', '<div class="discussion">', '<div id="reader-comments">', '<div class="ad-banner top">', '<main aria-hidden="true">'])
def test_marks_do_not_save_what_is_no_article(part):
    name = re.match(r"<(\w+)", part)[1]
    page = f"<body><article><h1>Head</h1><p>{PROSE}</p>{part}<p>{PROSE * 4}</p></{name}></article></body>"
    assert html_text.main_text(page) == f"Head\n{PROSE}"


@pytest.mark.parametrize("name", ['class="share-price"', 'id="menus-of-the-past"', 'class="comment-on-the-law"', 'class="notice-of-sale lead"'])
def test_names_that_only_begin_or_end_like_boilerplate(name):
    page = f"<body><article><h1>Head</h1><p>{PROSE}</p><div {name}><p>{PROSE * 2}</p></div></article></body>"
    assert html_text.main_text(page) == f"Head\n{PROSE}\n{PROSE * 2}"


def test_short_parts_of_an_article_stay():
    page = f"<body><article><h1>Head</h1><p>{PROSE * 5}</p><ul><li>one</li><li>two</li></ul><section><p>So.</p></section><table><tr><td>7</td><td>eight</td></tr></table><blockquote>Yes!</blockquote></article></body>"
    assert html_text.main_text(page) == f"Head\n{PROSE * 5}\none\ntwo\nSo.\n7\neight\nYes!"


def test_pages_without_marks_and_names(spark):
    found = right = asked = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = Counter(html_text.main_text(r.html).split("\n"))
        bare = re.sub(r"<(/?)(article|nav|footer)[^>]*>", r"<\1div>", r.html.replace(' class="ad"', ""))
        got = Counter(html_text.main_text(bare).split("\n"))
        right += sum((got & want).values())
        found += sum(got.values())
        asked += sum(want.values())
    assert right / asked > 0.99 and right / found > 0.8


@pytest.mark.parametrize("name", ["post tags", "social-science", "legal", "post nav-x", "content-sidebar-none"])
def test_no_name_alone_empties_an_article(name):
    page = f'<body><nav>Menu</nav><article><h1>Head</h1><div class="{name}"><p>{PROSE}</p><p>{PROSE}</p></div></article></body>'
    assert html_text.main_text(page) == f"Head\n{PROSE}\n{PROSE}"
    assert html_text.main_text(f'<body><article><div class="comments"><p>{PROSE}</p></div></article></body>') == PROSE


def test_several_articles_and_parts_without_a_name():
    links = "<ul>" + "".join(f"<li><a href=x>Other page {k}</a></li>" for k in range(8)) + "</ul>"
    page = f"<body><div>{PROSE} {PROSE}</div><article><h2>One</h2><p>{PROSE * 9}</p>{links}</article><article><p>Short.</p></article><div class='blurb'><p>{PROSE}</p></div></body>"
    assert html_text.main_text(page) == f"One\n{PROSE * 9}\nShort."


def test_characters_and_comments():
    page = "<article><p>super<wbr>cali<img src=x>fragi one<br>two <![CDATA[ hidden ]]>three <? no ?>four </ >&amp;five &notanentity; 3 < 4</p></article>"
    assert html_text.main_text(page) == "supercalifragi one two three four &five \u00acanentity; 3 < 4"


@pytest.mark.parametrize("part", ["<a ", "<a '\">", "<p>x</script ", "<script </script ", '<a b="', "<", "<p><!-", "</"])
def test_broken_pages_take_linear_time(part):
    began = time.time()
    html_text.main_text(part * ((1 << 20) // len(part)))
    assert time.time() - began < 10
