import html.parser
import itertools
import os
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from glyphmill.llm import chat, html_blocks, packing

SF = "/root/testdata/sf0.001"


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 4)
        got = packing.boundaries(lengths, counts, k)
        best = min(
            padding(lengths, counts, [*c, lengths[-1]]) for n in range(k) for c in itertools.combinations(lengths[:-1], min(n, len(lengths) - 1))
        )
        assert got[-1] == lengths[-1] and len(got) <= k and padding(lengths, counts, got) == best
    assert packing.boundaries([], [], 3) == []


def test_word_counts(spark):
    texts = ["", None, " ", "a", " a  b\t\n", "é\x0bé", "x y", "\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(packing.words_and_end(df["text"])).collect()] == [1, 1, 1, 2, 3, 3, 3, 1]


def test_packing_places_every_token_once(spark):
    rows = [(i, "w " * n) for i, n in enumerate([0, 3, 7, 7, 30, 95, 12, 1])] + [(None, None), (4, "a b"), (4, "a b")]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, bucket int")
    got = packing.pack(df, max_length=16, buckets=3, budget=40).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) + 1 for _, t in rows)
    slots = [(r["bucket"], r["batch"], r["slot"]) for r in got]
    assert len(set(slots)) == len(slots)
    by = {}
    for r in got:
        assert r["n_tokens"] <= r["padded"] <= 16 and r["first_token"] == 16 * r["piece"]
        by.setdefault((r["bucket"], r["batch"]), []).append(r["padded"])
    assert all(sum(p) <= max(40, p[0]) for p in by.values())
    for b in {k[0] for k in by}:  # all batches but the last are full
        sizes = [len(by[k]) for k in sorted(by) if k[0] == b]
        assert all(s == sizes[0] for s in sizes[:-1])
    assert packing.pack(df.limit(0)).count() == 0


def test_own_lengths(spark):
    df = spark.createDataFrame([(1, 0), (2, 5), (3, None)], "doc_id long, n int")
    got = packing.pack(df, df["n"], max_length=4).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(2, 1), (2, 4)]  # no tokens: nothing to place


def convs(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")


def plain(rows):
    """conv_id to rendered text of the maximal conversations."""
    found = {}
    for c, t, r, x in sorted(set(rows), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        found.setdefault(c, []).append((r, x))
    keep = {}
    for c, turns in found.items():
        longer = any(o[: len(turns)] == turns and len(o) > len(turns) for o in found.values())
        equal = any(o == turns and (k is not None and (c is None or k < c)) for k, o in found.items() if k != c)
        if not longer and not equal:
            keep[c] = "".join(f"<|im_start|>{r or 'unknown'}\n{x or ''}<|im_end|>\n" for r, x in turns)
    return keep


def test_snapshots_collapse(spark):
    rng = random.Random(2)
    rows = []
    for c in range(40):
        log = [("user" if k % 2 == 0 else "assistant", rng.choice("abc")) for k in range(rng.randint(1, 5))]
        rows += [(c, k, *t) for k, t in enumerate(log)]
    rows += [(50, 0, "user", None), (51, 0, "user", ""), (52, 0, None, "x"), (52, 1, "user", "y"), (None, 0, "user", "zz"), (None, None, "user", "first")]
    rows += rows[:7]  # logged twice
    got = {r["conv_id"]: r["chat"] for r in chat.collapse_and_render(convs(spark, rows)).collect()}
    assert got == plain(rows)


def test_long_conversations_come_in_segments(spark):
    rows = [(1, k, "user", str(k)) for k in range(1203)] + [(2, k, "user", str(k)) for k in range(700)]
    got = sorted((r["conv_id"], r["segment"], r["n_turns"], r["total_turns"]) for r in chat.collapse_and_render(convs(spark, rows)).collect())
    assert got == [(1, 0, 500, 1203), (1, 1, 500, 1203), (1, 2, 203, 1203)]
    assert chat.collapse_and_render(convs(spark, [])).count() == 0


PROSE = "The text of the article is what we want to have, and it is in a block of its own that goes on for a while."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain", ""),
        (f"<article><h1>Title</h1><p>{PROSE}</p><p>Short.</p></article><footer>{PROSE}</footer>", f"Title\n{PROSE}\nShort."),
        (f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>{PROSE}</div><main><p>{PROSE}</p></main>", PROSE),
        (f"<article><p>{PROSE}<br>next&nbsp;line</p><!-- <p>no</p> --><script>var t='<p>{PROSE}</p>'</script></article>", f"{PROSE} next line"),
        (f"<article><header><h1>Kept</h1></header><p>{PROSE}</p><section class='comments'><p>{PROSE} I say.</p></section></article>", f"Kept\n{PROSE}"),
        (f"<header><h1>Site</h1><p>{PROSE}</p></header><div><p>{PROSE} One.</p><p>Tiny.</p></div>", f"{PROSE} One.\nTiny."),
        (f"<div id='cookie-notice'><p>{PROSE}</p></div><div><p>{PROSE} Two.</p></div><form><p>{PROSE}</p></form><aside>{PROSE}</aside>", f"{PROSE} Two."),
        (f"<article><p>a &lt;b&gt; &amp;amp; &#233; &eacute; {PROSE}</article>", f"a <b> &amp; é é {PROSE}"),
        (f"<article><p>{PROSE}<p><b>open<p>x</article>", f"{PROSE}\nopen\nx"),
        (f"<article><p title='a > b'>{PROSE}</p><ul><li>one</li><li>two</li></ul></article>", f"{PROSE}\none\ntwo"),
        (f"<article><p>{PROSE}</p><p><a href=x>all of this is a link and nothing else</a></p></article>", PROSE),
        (f"<style>p{{}}</style><article><p>{PROSE}</p></article><textarea>{PROSE}</textarea>", PROSE),
        ("<article><p>only</p><p>short</p></article>", "only\nshort"),
        (f"<article><p>{PROSE}</p><div role='complementary'>{PROSE}</div>tail <unclosed", f"{PROSE}\ntail"),
    ],
)
def test_main_text(page, text):
    assert html_blocks.extract(page) == text


STOPS = "This is what the block of text says, and it is in the page for all of us who read it with care."
KEYS = "alpha | beta | gamma | delta | epsilon | zeta | eta | theta | iota | kappa | lambda | omicron | sigma"
LINKS = "<p><a href=x>a list of links to more of the site and to what is new there</a></p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Without an article: density of stop words decides long blocks, and what is short follows them.
        (f"<div><p>{STOPS}</p><p>{KEYS}</p></div>", STOPS),
        (f"<div><p>{STOPS}</p><p>near text</p><p>near words</p><p>{KEYS}</p></div>", f"{STOPS}\nnear text"),
        # In an article long blocks without stop words stay open: neighbours decide, the nearest first, equal ones for content.
        (f"<article><p>{STOPS}</p><p>{KEYS}</p></article>", f"{STOPS}\n{KEYS}"),
        (f"<article><p>{STOPS}</p><p>x</p>{LINKS}<p>{KEYS}</p></article>", f"{STOPS}\nx"),
        (f"<article><p>{STOPS}</p><p>{KEYS}</p>{LINKS}</article>", f"{STOPS}\n{KEYS}"),
        # Some links are enough where stop words are missing, not where they aren't.
        (f"<article><p>{STOPS}</p><p>{KEYS} <a>{KEYS[:40]}</a></p><p>{STOPS} <a>{STOPS[:40]}</a></p></article>", f"{STOPS}\n{STOPS} {STOPS[:40].strip()}"),
        # A language that the list doesn't hold: length and links alone.
        ("<div><p>" + "lorem ipsum dolor amet " * 5 + "</p><nav>x</nav></div>", ("lorem ipsum dolor amet " * 5).strip()),
        ("<article><p>" + "lorem ipsum dolor amet " * 5 + f"</p>{LINKS}<p>{KEYS}</p></article>", ("lorem ipsum dolor amet " * 5).strip() + f"\n{KEYS}"),
        # Elements whose names only begin like those without text.
        (f"<article><svg-icon></svg-icon><p>{STOPS}</p><video-player x=1>player</video-player><template-x></template-x><p>{KEYS}</p></article>", f"{STOPS}\nplayer\n{KEYS}"),
        (f"<article><script-x>a</script-x><script>var a;</script><p>{STOPS}</p><svg><path/></svg><svg/><p>end</p></article>", f"a\n{STOPS}\nend"),
    ],
)
def test_stop_words_links_and_length_decide(page, text):
    assert html_blocks.extract(page) == text


class Plain(html.parser.HTMLParser):
    """A second reading of pages: the elements around each piece of text are looked at anew."""

    def __init__(self, page):
        super().__init__()
        self.open, self.found, self.raw, self.link, self.breaks = [], [[]], 0, False, 0
        self.feed(page)
        self.close()

    def cut(self):
        self.found.append([])
        self.link, self.breaks = False, 0

    def handle_starttag(self, tag, attrs):
        if self.raw or tag in html_blocks._RAW.split("|"):
            self.raw += 1
        elif tag == "br":
            self.breaks += 1
            self.cut() if self.breaks > 1 else self.found[-1].append((" ", False, ()))
        elif tag == "a":
            self.link = True
        else:
            if tag in html_blocks._BLOCK:
                self.cut()
            if tag in html_blocks._KEPT:
                words = {w for k, v in attrs if k in ("class", "id", "role") for w in re.findall("[a-z0-9]+", (v or "").lower())}
                inside = "article" in self.open_names() or "main" in self.open_names()
                bad = tag in html_blocks._OUT or (tag == "header" and not inside) or (tag not in "html body article main".split() and words & html_blocks._OUT_WORDS)
                if bad and tag not in html_blocks._BLOCK:
                    self.found.append([])
                self.open.append((tag, bool(bad)))

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.handle_starttag(tag, attrs)

    def open_names(self):
        return [t for t, _ in self.open]

    def handle_endtag(self, tag):
        if self.raw:
            self.raw -= 1
        elif tag == "a":
            self.link = False
        else:
            if tag in html_blocks._BLOCK:
                self.cut()
            if tag in self.open_names():
                while self.open.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        if not self.raw:
            self.breaks = self.breaks if data.isspace() else 0
            self.found[-1].append((data, self.link, tuple(self.open)))

    def text(self):
        rows = []
        for parts in self.found:
            text = " ".join("".join(x for x, _, _ in parts).split())
            around = [o for x, _, o in parts if x.strip()]
            if text and around:
                names = [t for t, _ in around[0]]
                linked = sum(len(x) for x, link, _ in parts if link)
                stops = [w in html_blocks.STOP_WORDS for w in re.findall(r"[^\W_]+", text.lower())]
                rows.append([text, linked / len(text), sum(stops) / max(1, len(stops)), any(b for _, b in around[0]), "article" in names or "main" in names])
        article = any(r[4] and not r[3] for r in rows)
        own = [r for r in rows if not r[3] and (r[4] or not article)]
        need = 0.1 if article else 0.25
        if sum(len(r[0]) * r[2] for r in own if r[1] <= 0.5) < 0.03 * sum(len(r[0]) for r in own if r[1] <= 0.5):
            need = 0
        first = []
        for text, linked, share, _, _ in own:
            good = None
            if linked > 0.5 or (linked > 0.2 and share < need) or (len(text) < 70 and linked and not article) or (len(text) >= 70 and share < need and not article):
                good = False
            elif len(text) >= 70 and share >= need:
                good = True
            first.append(good)
        out = []
        for k, (row, good) in enumerate(zip(own, first)):
            if good is None:
                near = sorted((abs(k - j), not g, g) for j, g in enumerate(first) if g is not None)
                good = near[0][2] if near else article
            if good:
                out.append(row[0])
        return "\n".join(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pages_equal_a_second_reading():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    pages += [p for p in (f"<div><p>{STOPS}</p>{LINKS}<p>a</p><p>b</p><p>{KEYS}</p></div>", f"<article>{LINKS}<p>a</p><p>b</p><p>c</p><p>{STOPS}</p></article>")]
    assert [html_blocks.extract(p) for p in pages] == [Plain(p).text() for p in pages]


@pytest.mark.parametrize("value", ["x" * 5001, "x" * 1_000_000, "<p>" * 4000, "a > b </div> " * 1000, "class='sidebar' " * 1000])
def test_long_tags_count(value):
    words = "of the and that this is in it for with " * 4
    page = f'<body><div class="sidebar"><div class="comments" data-x="{value}">{words}1</div>{words}2</div><p>{words}3</p></body>'
    assert html_blocks.extract(page) == f"{words}3"
    assert html_blocks.extract(f'<p data-x="{value}">{words}4</p>') == f"{words}4"
    assert html_blocks.extract(f'<div data-x="{value}">{words}5</div>') == f"{words}5"
    many = " ".join(f"a{k}={k}" for k in range(4000))
    assert html_blocks.extract(f'<body><div class="sidebar"><div {many} class=comments>{words}6</div>{words}7</div><p>{words}8</p></body>') == f"{words}8"


def test_quotes_that_arent_closed():
    words = "of the and that this is in it for with " * 4
    assert html_blocks.extract(f"<p data-x=it's>{words}1</p>{'x ' * 4000}<p>it's {words}2</p>").startswith(f"{words}1\n")
    assert html_blocks.extract(f"<div class=sidebar><div title='x>{words}1</div>{words}2</div><p>{words}3</p>") == f"{words}3"
    begin = time.perf_counter()
    for piece in ('<a x="<a" ', "<a x='<a\" ", '<a "', "<a ='", "<a x=", "<a <"):
        html_blocks.extract(piece * 40_000 + "<")
    assert time.perf_counter() - begin < 20


def test_pages_in_a_table(spark):
    long = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>"), (2, None, None), (None, "v", ""), (3, "w", long), (3, "w", long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in html_blocks.main_text(df).collect()), key=str)
    n = len(PROSE)
    assert got == sorted([(1, "u", n), (2, None, 0), (None, "v", 0), (3, "w", 5000 * n + 4999), (3, "w", 5000 * n + 4999)], key=str)
    assert html_blocks.main_text(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op3_packing", "op5_chat_collapse"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from glyphmill.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, other = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    order = [c[0] for c in other.description]
    assert sorted(map(str, map(tuple, df.select(*order).collect()))) == sorted(map(str, other.fetchall()))
