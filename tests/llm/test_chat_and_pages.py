"""op1 and op9: exact round trips and hand-made pages."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest

from loanroll.llm import chat, wrapper

BYTE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "plain", "</s>[INST] ok [/INST]", "[\\INST] <\\/s> \\[INST]\\", "é漢𝄞 \n tail ", "[INST", "</s></s>", "x" * 3000,
         "<|endoftext|>", "[/INST][INST]", "[[INST]]<</s>>"]


def test_escape_is_reversible():
    for t in TEXTS:
        t = t or ""
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in (chat.OPEN, chat.MID, chat.CLOSE))


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, i, ("user", "assistant", "system", None)[i % 4], t) for i, t in enumerate(TEXTS)]
    rows += [(2, None, "assistant", "null turn"), (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (2, 0, "assistant", "tie a"),
             (None, 3, "user", "null id"), (3, 5, "assistant", ""), (4, 1000, "assistant", "far"), (4, -7, "user", "negative")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} [INST]") for i in range(300)]
    return spark.createDataFrame([(*r, 1, "clash") for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, segment int, formatted string")


@pytest.mark.parametrize("turns_per_segment", [4, 64, 100_000])
def test_digests_read_back(turns, turns_per_segment):
    segments = chat.format_conversations(turns, BYTE, turns_per_segment=turns_per_segment)
    got = {r.conv_id: r for r in chat.conversation_digests(segments).collect()}
    by = {}
    order = lambda r: (r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or "")
    for r in sorted(turns.collect(), key=order):
        by.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == len(chat.render(own, ())[0])


def test_segments_are_cut_by_rows_and_size(spark):
    n = 100_000
    df = spark.range(n).selectExpr("cast(null as bigint) AS conv_id", "id % 2 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'same text' AS text")
    segments = chat.format_conversations(df, BYTE)
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # so little data would be brought back into one task
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = segments.selectExpr("max(n_turns)", "sum(n_turns)", "count(DISTINCT segment)", "count(*)", "count(DISTINCT segment >> 32)").first()
    finally:
        spark.conf.set(key, before)
    assert got[0] <= 64 and got[1] == n and got[2] == got[3] >= n / 64 and got[4] > 1  # more than one task
    r = chat.conversation_digests(segments).first()
    whole = "user\nsame text\n" * (n // 2) + "assistant\nsame text\n" * (n // 2)
    assert r.n_turns == n and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and r.loss_chars == 9 * n // 2
    long = spark.range(40).selectExpr("1L AS conv_id", "0L AS turn", "'user' AS role", "repeat('word ', 20000) AS text")
    assert chat.format_conversations(long, BYTE).selectExpr("max(length(formatted))").first()[0] < 2_100_000


def test_mask_is_the_overlap_of_spans():
    rng = np.random.default_rng(2)
    for _ in range(200):
        edges = np.unique(rng.integers(0, 60, 12))
        start, end = edges[:-1], edges[1:]
        cuts = np.unique(rng.integers(0, 60, 6))
        spans = [(int(a), int(b)) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        expected = [int(any(s < b and e > a for a, b in spans)) for s, e in zip(start, end, strict=True)]
        assert chat.loss_mask(spans, start, end).tolist() == expected


def test_no_turns(turns):
    assert chat.conversation_digests(chat.format_conversations(turns.where("conv_id = 77"), BYTE)).count() == 0


def page(article, nav="<li><a href=/a>Home</a><li>About", aside="News", head=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style>{head}<script>var t='</p>';</script></head><body>"
            f"<header class=top><h1>Site</h1></header><nav><ul>{nav}</ul></nav><div class='cookie-notice'>We use cookies</div>"
            f"<aside>{aside}</aside>{article}<section class=\"comments\"><p>First!</p></section><form><p>Mail</p><input></form>"
            f"<footer>&copy; me</footer></body></html>")


def test_roles_and_blocks():
    html = page("<!-- ad --><article><h1>A &amp; B</h1>\n<p>One <b>bold</b>\n  two<p>Three<br>four<div class=ad>Buy</div>"
                "<ul><li>x<li>y</ul><script>no</script><p></p>tail &lt;p&gt;</article>")
    assert wrapper.extract([html]) == ["A & B\nOne bold two\nThree four\nx\ny\ntail <p>"]


def test_without_article_the_varying_slots_are_content():
    body = lambda i: f"<div class=body><p>Story {i} is new.</p><p>Read more on our site</p><p>End {i}.</p></div>"
    pages = [page(body(i), nav=f"<li>Item {i}", aside=f"Teaser {i}") for i in range(6)]
    assert wrapper.extract(pages) == [f"Story {i} is new.\nEnd {i}." for i in range(6)]
    assert wrapper.extract(pages[:2])[0] == "Story 0 is new.\nRead more on our site\nEnd 0."  # too few pages for constants


def test_copies_of_a_page_are_no_template():
    same = page("<article><h1>Same</h1><p>Copied text</p></article>")
    assert wrapper.extract([same] * 30) == ["Same\nCopied text"] * 30


def test_tree_matching_keeps_order():
    a, b = (wrapper.Run("#root", [wrapper.parse(x)]) for x in ("<div><h1>a</h1><p>b</p><ul><li>c</ul></div>", "<div><p>z</p><ul><li>c</ul><h1>a</h1></div>"))
    size, pairs = wrapper.simple_tree_matching(a, b)
    assert size == 5 and [x.sign for x, _ in pairs] == ["#root", "div", "p", "ul", "li"]


def test_pages_table(spark):
    rows = [(1, "http://h.example/1", page("<article><p>t</p></article>")), (2, None, None), (3, "no host", ""), (1, "http://h.example/1", "just text &eacute;"),
            (None, "//h.example/x", "<p>unclosed <b>tags <i>here"), (4, "http://h.example/4", "<article>" + "<p>word</p>" * 20000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    got = sorted((tuple(r) for r in wrapper.extract_pages(df).collect()), key=str)
    texts = ["t", "", "", "just text é", "unclosed tags here", "\n".join(["word"] * 20000)]
    assert got == sorted(((*r[:2], t) for r, t in zip(rows, texts, strict=True)), key=str)
    assert wrapper.extract_pages(df.where("page_id = 99")).count() == 0


def test_a_wrapper_named_after_a_part_is_no_part():
    html = '<body><div class="page with-sidebar"><nav>menu</nav><article><p>Story</p></article><div class="sidebar">x</div></div></body>'
    assert wrapper.extract([html]) == ["Story"]
    assert wrapper.extract(['<body><aside><article><p>teaser</p></article></aside><div><p>Story</p></div></body>']) == ["Story"]


@pytest.mark.parametrize("tag", ["b", "font", "div"])
def test_pages_nested_to_any_depth(tag):
    deep = "<p>start</p>" + f"<{tag}>" * 5000 + "deep"
    assert wrapper.extract([deep]) == ["start\ndeep"]
    a, b = (wrapper.Run("#root", [wrapper.parse("<p>start</p>" + f"<{tag}>" * 1500)]) for _ in range(2))
    assert wrapper.simple_tree_matching(a, b)[0] >= 1500


def in_memory(rows):
    """The texts by the host's pages alone, without Spark."""
    by = {}
    for i, (_, url, html) in enumerate(rows):
        host = re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
        by.setdefault(host[1].lower() if host else "", []).append((i, html or ""))
    texts = {}
    for own in by.values():
        texts.update(zip([i for i, _ in own], wrapper.extract([h for _, h in own]), strict=True))
    return [texts[i] for i in range(len(rows))]


def bare_page(i, story, extra=""):
    """No roles: a template around two slots; the menu and the notice are equal on all pages."""
    return (f"<html><body><div class=x1><ul><li>Home<li>About us<li>Contact</ul></div><div class=x2><p>We value your privacy.</p></div>"
            f"<div class=x3><h1>Title {i}</h1>{story}<p>Written by our staff</p></div><div class=x4>Copyright {2000 + i % 2} by us{extra}</div></body></html>")


def test_only_the_wrapper_can_tell():
    pages = [bare_page(i, f"<p>Story {i} begins here and goes on for some words.</p><p>It ends with {i}.</p>") for i in range(8)]
    assert wrapper.extract(pages) == [f"Title {i}\nStory {i} begins here and goes on for some words.\nIt ends with {i}." for i in range(8)]
    alone = wrapper.extract(pages[:1])[0]
    assert "Home" in alone and "privacy" in alone and "Copyright" in alone


def test_an_article_is_kept_whole():
    """Texts that all articles share stay; words of parts count only where a class is made of them."""
    body = lambda i: (f"<article><h2>Introduction</h2><p>Legal text all pages share.</p><p>Own text {i}.</p>"  # noqa: E731
                      f"<div class='share prices'><p>Prices {i}</p></div><div class='ad-box'>Buy {i}</div><div id=comments>First {i}</div></article>")
    pages = [page(body(i), nav=f"<li>Item {i}") for i in range(6)]
    assert wrapper.extract(pages) == [f"Introduction\nLegal text all pages share.\nOwn text {i}.\nPrices {i}" for i in range(6)]
    assert wrapper.extract(pages) == [t for p in pages for t in wrapper.extract([p])]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_table_is_the_hosts_pages_alone(spark, partitions):
    """Counts by Spark, copies and foreign templates included; the same however the pages are dealt."""
    rows = [(i, f"http://a.example/{i}", bare_page(i, f"<p>Story {i} goes on and on, some words more.</p>" * (1 + i % 3), "<b>!</b>" * (i % 2))) for i in range(30)]
    rows += [(100 + i, "http://a.example/copy", rows[3][2]) for i in range(40)]
    rows += [(200 + i, "https://B.example/x", page(f"<div class=body><p>Text {i}</p><p>Always here</p></div>")) for i in range(5)]
    rows += [(300 + i, "//b.example/y", page(f"<article><p>Text {i}</p><p>Always here</p></article>")) for i in range(1)]
    rows += [(400, None, "<p>no host</p>"), (401, "//c.example", None), (402, "//c.example", ""), (403, "//a.example/plain", "only text")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(partitions)
    got = {r.page_id: r.text for r in wrapper.extract_pages(df).collect()}
    expected = in_memory(rows)
    assert got == {r[0]: t for r, t in zip(rows, expected, strict=True)}
    assert "Written by" not in got[0] and "Always here" not in got[200] and "Always here" in got[300]


def test_query_is_the_hosts_pages_alone(spark):
    from loanroll.llm import queries

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op9_wrapper(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (u, t, len(t)) for (i, u, _), t in zip(rows, in_memory(rows), strict=True)}


def plain_matching(a, b):
    """The textbook recursion."""
    if a.sign != b.sign:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain_matching(x, y))
    return m[-1][-1] + 1


@pytest.mark.parametrize("cells", [4_000_000, 6])
def test_matching_is_the_textbook_recursion(monkeypatch, cells):
    monkeypatch.setattr(wrapper, "TABLE_CELLS", cells)
    rng = random.Random(3)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth and rng.random() < 0.7 else 'x'}</{t}>" for t in rng.choices(["div", "ul", "h1", "span"], k=rng.randint(0, 4)))

    for _ in range(150):
        a, b = (wrapper.tree_of(tree(3))[1] for _ in range(2))
        size, pairs = wrapper.simple_tree_matching(a, b)
        assert size == plain_matching(a, b) == len(pairs)
        place = {id(x): k for t in (a, b) for k, x in enumerate(sorted(wrapper._all(t), key=lambda r: r.number))}
        left, right = ([place[id(p[k])] for p in pairs] for k in (0, 1))
        assert sorted(left) == sorted(set(left)) and [r for _, r in sorted(zip(left, right, strict=True))] == sorted(right)
        up = {id(c): r for t in (a, b) for r in wrapper._all(t) for c in r.children}
        matched = {(id(x), id(y)) for x, y in pairs}
        assert all(x.sign == y.sign and (x is a or (id(up[id(x)]), id(up[id(y)])) in matched) for x, y in pairs)
        back = wrapper.unpack_tree(wrapper.pack_tree(a))
        assert back.shape == a.shape and [r.sign for r in sorted(wrapper._all(back), key=lambda r: r.number)] == [
            r.sign for r in sorted(wrapper._all(a), key=lambda r: r.number)]


def test_broken_markup_takes_no_long_time():
    began = time.time()
    for s in ("<a " * 100_000, '<a href="x ' * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<a " + "x" * 100_000 + " b=1>", "<!-- " * 50_000,
              "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<p>" + "<b>" * 20_000 + "<p>" * 20_000, "<script>" * 50_000, "<td><p>" * 30_000):
        wrapper.extract([s])
    alternating = ["".join(f"<p>a{i} {k}</p><h2>b{k % (7 + i)}</h2>" + "<ul><li>x</ul>" * (k % 11 == i) for k in range(800)) for i in range(4)]
    assert len(wrapper.extract(alternating)) == 4
    assert time.time() - began < 20
