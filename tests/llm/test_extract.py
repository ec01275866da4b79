import random
import time

from evwarden.llm.extract import extracted, main_text, stretches


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Title</title>{head}</head><body class='with-sidebar'>{body}</body></html>"


def test_article_without_furniture():
    body = """<header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies, many of them indeed</div>
    <main><article><h1>A &amp; B</h1><p>x  y\n z&nbsp;&#233;</p><aside>Aside</aside><form><p>Form</p></form><p>q<br>r</p><script>var t="</p>";</script>
    <div id="ad-3">Buy</div><style>p{}</style><ul><li>one</li><li>two</ul><!-- note --><section class="comments"><p>First!</p><article class="comment">Second</article>
    </section><p>end</p></article></main><div class="sidebar">Side</div><footer>Foot</footer>"""
    assert main_text(page(body)) == "A & B\nx y z é\nq r\none\ntwo\nend"


def test_nothing_of_the_article_is_dropped():
    blocks = [f"Block {i} " + "word " * (i * 37 % 90) for i in range(400)]
    html = page("<nav><li>m</li></nav><article>" + "".join(f"<p>{b}" for b in blocks) + "</article><footer>f</footer>")
    assert main_text(html) == "\n".join(" ".join(b.split()) for b in blocks)


def test_surge_and_dive_without_article_markup():
    body = "<div>short stray</div><nav>menu</nav><div><h2>Head</h2><p>" + "long text " * 20 + "</p><p>tail.</p></div><footer>f</footer><div>stray end</div>"
    assert main_text(page(body)) == "Head\n" + ("long text " * 20).strip() + "\ntail."
    assert main_text(page("<div class=menu>m</div><p>only this</p>")) == "only this"
    links = "<nav>m</nav><ul>" + "<li><a href=x>a rather long link to some other page of it</a></li>" * 9 + "</ul><div class=ad>x</div><p>" + "text " * 30 + "</p>"
    assert main_text(page(links)) == ("text " * 30).strip()


def test_articles_in_furniture():
    assert main_text(page("<article><p>Main text</p></article><aside class=sidebar><article>Teaser</article></aside><div class='sidebar'><article>Card</article></div>")) == "Main text"
    assert main_text(page("<div class='layout with-sidebar'><article><p>Main text</p></article></div>")) == "Main text"
    assert main_text(page("<aside><article>Teaser</article></aside><div><p>" + "text " * 30 + "</p></div>")) == ("text " * 30).strip()


def test_short_lines_after_an_advert():
    body = "<h2>Title</h2><div class=ad>Buy</div><p>" + "text " * 30 + "</p><div class=ad>x</div><aside>y</aside><p>The end.</p><footer>f</footer><p>stray</p>"
    assert main_text(page(body)) == "Title\n" + ("text " * 30).strip() + "\nThe end."


def naive_stretches(weights, window, surge):
    """Kept line numbers: lines joined where fewer than ``window`` empty ones lie between, and the largest sum of each group."""
    groups = []
    for i, n in enumerate(weights):
        if n:
            if groups and i - groups[-1][-1] <= window:  # fewer than ``window`` empty lines between
                groups[-1].append(i)
            else:
                groups.append([i])
    peaks = [max(sum(weights[max(j - window + 1, g[0]) : j + 1]) for j in range(g[0], g[-1] + 1)) for g in groups]
    enough = min(surge, max(peaks, default=0))
    return [(g[0], g[-1] + 1) for g, p in zip(groups, peaks) if p >= enough]


def test_stretches_of_random_lines():
    draw = random.Random(3)
    for _ in range(3_000):
        lines = [draw.choice([None, ("t", 0, False), ("t", draw.randrange(1, 60), False)]) for _ in range(draw.randrange(25))]
        window, surge = draw.randrange(1, 5), draw.choice([10, 60, 150])
        weights = [0 if x is None else x[1] for x in lines]
        assert stretches(lines, window, surge) == naive_stretches(weights, window, surge), (weights, window, surge)


def random_page(seed):
    """A page, and its text by construction: furniture round and between the blocks of an article or of plain divisions."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 9)))
    sentence = lambda n: " ".join(word() for _ in range(draw.randrange(1, n)))
    flow = lambda: draw.choice([
        f"<div class='ad-{draw.randrange(9)}'><p>{sentence(9)}</p></div>", f"<aside><h3>{word()}</h3><article><p>{sentence(30)}</p></article></aside>",
        f"<div id=share><a href=x>{word()}</a></div>", f"<script>var a = '<p>{word()}</p>';</script>", f"<form><input><button>{word()}</button></form>",
    ])
    blocks, html = [], []
    for _ in range(draw.randrange(1, 9)):
        text = sentence(40)
        if draw.random() < 0.3:
            html.append(flow())
        style = draw.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<p>{}", "<blockquote><p><b>{}</b></p></blockquote>", "<p><!-- x -->{}<br></p>"])
        html.append(style.format(draw.choice(["\n", " ", "  "]).join(text.split(" "))))
        blocks.append(text)
    article = draw.random() < 0.6
    if not article:  # without an article the text must be long enough to surge, and no link alone
        blocks.append(("long " * 20).strip())
        html.append(f"<p>{blocks[-1]}</p>")
    inside = ("<main><article>{}</article></main>" if article else "<div>{}</div>").format("".join(html))
    nav = "<nav><ul>" + "".join(f"<li><a href=/{i}>{word()}</a>" for i in range(draw.randrange(1, 7))) + "</ul></nav>"
    tail = f"<section class=comments><article class=comment><p>{sentence(50)}</p></article></section>" if draw.random() < 0.5 else ""
    return page(f"<header><h1>{word()}</h1></header>{nav}{inside}<footer><p>{sentence(30)}</p></footer>{tail}"), "\n".join(blocks)


def test_random_pages_give_the_text_they_were_made_of():
    for seed in range(600):
        html, want = random_page(seed)
        assert main_text(html) == want, (seed, html)


def test_broken_markup():
    assert main_text(page("<nav>never closed<ul><li>a<article><p>ok</p></article>")) == "ok"
    assert main_text("<p>no end <b>bold <i>text") == "no end bold text"
    assert main_text("") == "" and main_text("plain &lt;b&gt;") == "plain <b>"
    assert main_text("<article><p>a</section></div></p><p>b</article></article>") == "a\nb"
    assert main_text("<article><p class=ad>advert<p>text</article>") == "text"
    began = time.time()
    main_text("<div>" * 100_000 + "x" + "</p>" * 100_000)
    main_text("<" * 200_000)
    main_text("<p>" * 200_000 + "word " * 200_000)
    assert time.time() - began < 30


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, k0 string, id string"
    rows = [(1, "u", "<article><p>é</article>", "t", "k", "i"), (1, "u", "<article><p>é</article>", "t", "k", "i"), (None, None, None, "t", "k", "i"), (3, "v", "", None, None, None)]
    got = extracted(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.id or 0), r.url or "", r.text) for r in got) == [(0, "", ""), (1, "u", "é"), (1, "u", "é"), (3, "v", "")]
    assert extracted(spark.createDataFrame([], schema)).count() == 0
