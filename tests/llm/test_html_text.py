import html
import random
import re

from kgraph.llm.html_text import extract, from_json, infer, main_text, mark, read_page, to_json

SCHEMA = "page_id long, url string, html string, text string, host string, wrapper string"
DATA = "/root/testdata/sf0.01"


def plain(page):
    """For pages with one article of paragraphs."""
    inner = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)[1]
    blocks = re.split(r"</?(?:p|h1|h2|h3|ul|li|div)\b[^>]*>", inner)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_test_data_against_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    got = main_text(pages).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.url == source[r.page_id].url and r.text == plain(source[r.page_id].html) and r.n_chars == len(r.text), r.page_id


def page(rng, body_only=False, extra=""):
    words = lambda k: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "e&amp;f", "&eacute;t&eacute;"], k=k))
    paragraphs = [words(rng.randint(8, 40)) for _ in range(rng.randint(1, 6))]
    main = "".join("<p>{} <em>{}</em></p>".format(*p.split(" ", 1)) for p in paragraphs)
    comments = "".join(f"<div class='comment' id=c{k}><p>{words(9)}</p></div>" for k in range(rng.randint(0, 3)))
    optional = "<div class='notice'>Read our notice</div>" if rng.random() < 0.5 else ""
    out = (
        "<!DOCTYPE html><html><head><title>t</title><script>var a='</p><article>';</script></head><body class='has-sidebar'>"
        f"<div id=top class='navbar'><a href='/'>Home</a> <a href='/x'>{words(3)}</a></div>{optional}"
        f"<div id=c7><div class=left>{main}{extra}</div></div><div id='sidebar'><p>{words(30)}</p></div>{comments}"
        f"<form><p>Your mail</p><button>Send</button></form><div class='ft'>All rights reserved by nobody, as on every page</div></body></html>"
    )
    want = "\n\n".join(" ".join(html.unescape(p).split()) for p in paragraphs)
    return out, want


def test_pages_without_an_article():
    rng = random.Random(1)
    made = [page(rng) for _ in range(9)]
    wrapper = mark(from_json(to_json(infer([p for p, _ in made[:8]]))))
    assert wrapper.sign == "#page" and wrapper.pages == 8
    for p, want in made:
        assert extract(p, wrapper) == want


def nameless(rng, said):
    """A page whose containers have no telling names, and whose template says more than the article."""
    words = lambda k: " ".join(rng.choices(["alder", "birch", "cedar", "fir", "oak", "elm"], k=k))
    title, paragraphs = words(5), [words(rng.randint(20, 40)) for _ in range(rng.randint(1, 3))]
    menu = "".join(f"<a href=/{k}>{words(1)}</a> " for k in range(rng.randint(4, 9)))
    remarks = "".join(f"<div class=x7><div class=x8>{words(rng.randint(3, 6))}</div></div>" for _ in range(rng.randint(0, 2)))
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<div class=x5>Print this and send it to friends</div>"
    inner += "".join(f"<div class=x6><a href=/{k}>{words(3)}</a></div>" for k in range(3))
    extra = f"<div class=x9>{words(4)}</div>" if rng.random() < 0.4 else ""
    page = f"<body><div class=x1>{menu}</div>{extra}<div class=x2><p>{said}</p></div><div class=x3>{inner}</div>{remarks}<div class=x4>{said[::-1]}</div></body>"
    return page, "\n\n".join([title, *paragraphs])


def test_the_wrapper_decides_where_names_say_nothing():
    rng = random.Random(2)
    said = "We at this place write about trees and what lives in them, and have for very many years. " * 6
    made = [nameless(rng, said) for _ in range(30)]
    wrapper = mark(from_json(to_json(infer([p for p, _ in made[:20]]))))
    assert [extract(p, wrapper) for p, _ in made] == [want for _, want in made]
    assert not any(extract(p, None) == want for p, want in made)


def test_the_same_over_tables(spark):
    rng = random.Random(3)
    said = "We at this place write about trees and what lives in them, and have for very many years. " * 6
    made = [nameless(rng, said) for _ in range(40)]
    rows = [(k, f"http://one.example/{k}", p, "", "", "") for k, (p, _) in enumerate(made)] + [(99, "http://two.example/", made[0][0], "", "", "")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert all(got[k] == want for k, (_, want) in enumerate(made)) and got[99] != made[0][1]


def test_copies_of_a_page_say_nothing():
    rng = random.Random(5)
    article = " ".join(rng.choices(["alder", "birch", "cedar"], k=80))
    pages = [f"<body><div class=a>Spot {k} here</div><div class=b>{article}</div></body>" for k in range(5)]
    assert extract(pages[0], infer(pages)) == article


def test_optional_and_repeated_groups():
    pages = ["<body><div class=a>x</div><div class=b>y</div><div class=a>z</div><div class=b>q</div></body>", "<body><div class=a>x</div></body>"]
    (body,) = infer(pages).children
    assert [(c.sign, c.repeated, c.optional) for c in body.children] == [("div.a", True, False), ("div.b", True, True)]


def test_odd_markup():
    article = lambda x: extract(f"<body><article>{x}</article></body>", None)
    assert article("a &lt;b&gt; &#233;&amp;amp; 3 < 4") == "a <b> é&amp; 3 < 4"
    assert article("<p>one\n\t two<p><b>three<br>four</b> <i>f</i>ive<ul><li>six<li>seven</ul>") == "one two\n\nthree four five\n\nsix\n\nseven"
    assert article("<!-- <p>no</p> --><style>p{}</style><script>'</p>'</script>yes<aside>no</aside><div class='ad box'>no</div>") == "yes"
    assert article("<p class=ad>no<p>yes") == "yes"
    assert extract("<article><p>cut off", None) == "cut off"
    assert extract("", None) == "" and extract("just text", None) == "just text"
    assert extract("<nav>a</nav><footer>b</footer>", None) == ""
    assert extract("<article>" * 300 + "deep", None) == "deep"
    assert extract("<div>" * 5000 + "deep<aside>no</aside>" + "</div>" * 20 + "er", None) == "deep\n\ner"
    assert extract("<head><title>x</title><p>hello body text here</p>", None) == "hello body text here"
    assert extract("<head><title>x</title>hello <b>body</b>", None) == "hello body"
    assert extract("<html><head><meta charset=utf-8><style>p{}</style><body><p>one</p>", None) == "one"
    assert article("<header>no</header><p class='share-price'>up</p><section class='related-work'>yes</section><div class='adBox'>no</div>") == "up\n\nyes"
    assert article("<div class='comment-list'><div><p>no</div>no</div>yes <span class=notice>too</span>") == "yes too"
    assert extract("<body><header><h1>no</h1></header><p>yes</p></body>", None) == "yes"
    assert read_page("</div></p><div>").children


def test_bad_rows(spark):
    rows = [(1, None, None, "", "", ""), (2, "http://a/x", "", "", "", ""), (None, "nonsense", "<article>a</article>", "", "", "")]
    rows += [(3, "HTTP://Host.Example/1", "<article>é</article>", "t", "h", "w")] * 2
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "a", 1), (1, "", 0), (2, "", 0), (3, "é", 1), (3, "é", 1)]
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_template_is_dropped_only_where_its_text_is_the_same():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices(["alder", "birch", "cedar", "fir"], k=n))
    build = lambda first, y, z: f"<body><section class=x>{first}</section><section class=y>{y}</section><section class=z>{z}</section></body>"
    same = "Read all of our stories every day"
    wrapper = mark(from_json(to_json(infer([build(same, text(50), text(50)) for _ in range(8)]))))
    y, z = text(50), text(50)
    assert extract(build(same, y, z), wrapper) == f"{y}\n\n{z}"
    assert extract(build("Another text", y, z), wrapper) == f"Another text\n\n{y}\n\n{z}"
    opening = "common " * 400
    made = [(f"{opening}{k}", text(600), text(600)) for k in range(8)]
    wrapper = mark(from_json(to_json(infer([build(*m) for m in made]))))
    assert all(extract(build(*m), wrapper) == "\n\n".join(m) for m in made)
