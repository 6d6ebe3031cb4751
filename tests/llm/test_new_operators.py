"""Main text, conversation repair and lexical search."""

import html
import itertools
import random
import re
import zlib
from html.parser import HTMLParser

import duckdb
import pytest

from packetloom.llm import conversation_repair, lexical_search, main_text, queries

SF = "/root/testdata/sf0.001"


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.sql(sql).fetchall(), key=str)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- 11 main text

class Reference(HTMLParser):
    """Text of the article element alone, by the library's own parser: pages of the test tables mark it."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.now = False, [], []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag not in ("b", "br"):
            self.end()

    def handle_endtag(self, tag):
        self.end()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)

    def end(self):
        line = " ".join("".join(self.now).split())
        self.blocks += [line] if line else []
        self.now = []


def test_article_pages_match_a_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r for r in main_text.extract(pages).collect()}
    for page in pages.collect():
        reference = Reference()
        reference.feed(page["html"])
        row = found[page["page_id"]]
        assert row["text"] == "\n\n".join(reference.blocks)
        assert (row["url"], row["n_chars"]) == (page["url"], len(row["text"]))


LONG = "A paragraph of the article that is long enough to be one, with words and more words. "
PAGES = [
    ("<nav><a>Home</a></nav><header>Site</header><main><h1>T</h1><p>One &amp; two<br>three<p>Four</main><aside>Side</aside><footer>F</footer>", "T\n\nOne & two three\n\nFour"),
    ("<div class='top-menu'><a>Home</a></div><div>" + LONG + "</div><p>" + LONG + "</p><section id=comments><p>" + LONG + "</section><div class=footer>F</div>",
     LONG.strip() + "\n\n" + LONG.strip()),
    ("<body class=has-sidebar><div class='page with-ads'><article>Hi <b>the</b>re<div class=ad>Buy</div><form>Q</form><p>5 &lt; 6 < 7</p></article></div>", "Hi there\n\n5 < 6 < 7"),
    ("<article>Text<script>if (a < b) { '</p>' }</script><style>p{}</style><!-- <p>no --><p hidden>no</p><p style='display: none'>no</p> on</article>", "Text\n\non"),
    ("<article>A<article class=comment>reply</article><p class=cookieNotice>N</p>B</article>", "A\n\nB"),
    ("<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>" + LONG * 2 + "</p><p>End.</p><p></p><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul>",
     (LONG * 2).strip() + "\n\nEnd."),
    ("plain text &eacute;&#33; &am", "plain text é! &am"), ("", ""), (None, ""), ("<nav>x</nav>", ""), ("<p>\n\n </p>", ""), ("<", "<"), ("<p>short", "short"),
    ("<table><tr><td>a<td>b<tr><th>c</table>", "a\n\nb\n\nc"), ("<!-- open <p>x", ""), ("<p title='a>b'>x</p>", "x"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert main_text.main_text(page) == text


def test_surges_and_dives():
    assert main_text.between_surges_and_dives([], 0) == []
    assert main_text.between_surges_and_dives([0, 0, 5, 0, 0, 7, 0, 0, 0, 2], 0) == [(2, 6), (9, 10)]
    assert main_text.between_surges_and_dives([1, 0, 0, 0, 50, 60, 0, 0, 0], 80) == [(4, 6)]


def test_hostile_pages_stay_whole(spark):
    deep = "<b>" * 100_000 + "x" + "</b>" * 100_000
    rows = [(1, "u", deep, 0), (1, "u", deep, 0), (None, None, None, 1), (2, None, "<a \"" * 50_000, 2), (3, "u", "word " * 200_000, 3), (4, "u", "<p><div class=x " * 50_000, 4)]
    found = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert len(found) == len(rows)
    assert sorted(r["n_chars"] for r in found if r["page_id"] in (1, 3, None)) == [0, 1, 1, 999_999]
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_entities_as_in_html(spark):
    text = "&copy;&nbsp;&notit; &#x41;&#0; &amp;amp;"
    assert main_text.main_text(f"<article>{text}</article>") == " ".join(html.unescape(text).split())


# --- 12 conversations

def rows_of(seed):
    draw = random.Random(seed)
    rows = [(c, draw.choice([None, *range(14)]), draw.choice(["user", "assistant", "system", None, "tool", "", "ua"]),
             draw.choice(["a.", "b", "c!", None, "", " \t", "d?", "e. ", "x.\x00"])) for c in (None, 1, 2, 3) for _ in range(40)]
    rows += [(7, i, draw.choice(["user", "assistant", "weird"]), f"t{i}.") for i in range(150)]
    rows += [(8, i, "odd", f"t{i}") for i in range(101)] + [(9, 5, "odd", "same.")] * 60 + [(11, 2**62, "user", "hi.")]
    return rows


@pytest.mark.parametrize("chunk", [4096, 7, 1])
def test_repair_matches_sql_at_every_chunk_size(spark, chunk):
    table = spark.createDataFrame(rows_of(chunk), "conv_id long, turn long, role string, text string").repartition(3)
    assert listed(conversation_repair.repair(table, chunk)) == by_sql(queries.OP12_SQL, conversations=table)


def legal(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def cheapest(codes):
    """Least (cost, audit) over all edit strings, by breadth-first enumeration."""
    initials = "suax"
    best = {(0, ""): (0, "")}  # (rows used, role initials so far) -> (cost, audit)
    done = []
    for _ in range(3 * len(codes) + 3):
        after = {}
        for (used, roles), (cost, audit) in best.items():
            if used == len(codes) and legal(roles):
                done.append((cost, audit))
            options = [("I", used, roles + r, 3) for r in "ua"] if len(roles) < len(codes) + 4 else []
            if used < len(codes):
                code = codes[used]
                options.append(("D", used + 1, roles, 4))
                if code < 8:
                    extra = 3 * (code & 1)
                    options.append(("K", used + 1, roles + initials[code >> 1], extra))
                    options += [("R", used + 1, roles + r, 3 + extra) for r in "ua"]
            for letter, u, r, c in options:
                if re.fullmatch("s?(ua)*u?", r) and ((u, r) not in after or (cost + c, audit + letter) < after[u, r]):
                    after[u, r] = cost + c, audit + letter
        best = after
    return min(done)


def test_audits_match_enumeration():
    chain = conversation_repair.Chain()
    draw = random.Random(5)
    cases = [list(c) for n in range(4) for c in itertools.product((0, 2, 4, 6, 8), repeat=n)] + [[draw.randrange(9) for _ in range(5)] for _ in range(60)]
    for codes in cases:
        letters, state = chain.trace(bytes(codes), conversation_repair.START, conversation_repair.FINAL)
        audit = "".join(letters) + {0: "", 1: "II", 2: "I", 3: ""}[state]
        assert audit == cheapest(codes)[1], codes


def test_vectors_never_spread_further():
    chain, vectors, new = conversation_repair.Chain(), set(), {conversation_repair.FINAL}
    while new:
        vectors |= new
        new = {chain.step(v, code)[0] for v in new for code in range(9)} - vectors
    assert max(map(max, vectors)) <= conversation_repair.SPREAD


def test_dropped_conversations_and_odd_tables(spark):
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string, c0 string, mark long"
    table = spark.createDataFrame([(gone, 0, "user", "x.", "y", 1)], schema)
    assert listed(conversation_repair.repair(table)) == [
        (gone, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")]
    assert conversation_repair.repair(table.filter("false")).count() == 0
    wide = spark.createDataFrame([(1, 1, "user", "long " * 200_000 + ".", None, None), (1, 2, "user", None, None, None)], schema)
    assert listed(conversation_repair.repair(wide)) == by_sql(queries.OP12_SQL, conversations=wide.select("conv_id", "turn", "role", "text"))


# --- 13 search

DOCS = [(1, "a b c"), (1, "a b"), (None, "a b"), (3, None), (4, ""), (5, "A-b! b"), (6, "z " * 70_000), (7, "a b"), (2**60, "b Ä ä 9"), (8, "c"), (9, "\x00İ b")]
ITEMS = [(1, "a a b"), (1, "z"), (None, "b"), (3, None), (4, "none"), (5, "Ä c 9 İ")]


def test_search_matches_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(DOCS, "doc_id long, text string"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame(ITEMS, "item_id long, text string"))
    want = by_sql(queries.OP13_SQL, documents=docs, benchmark=items)
    assert listed(lexical_search.search(docs.repartition(3), items)) == want
    # many small shards and item blocks: bundles are pruned, and nothing is lost
    assert listed(lexical_search.search(docs, items, max_pairs=100, shard_rows=13)) == want


def test_search_of_odd_tables(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, term string, shard long")
    items = spark.createDataFrame([(*r, 2) for r in ITEMS], "item_id long, text string, df long")
    assert listed(lexical_search.search(docs, items)) == by_sql(queries.OP13_SQL, documents=docs.select("doc_id", "text"), benchmark=items.select("item_id", "text"))
    assert lexical_search.search(docs.filter("false"), items).count() == 0
    assert lexical_search.search(docs, items.filter("false")).count() == 0
    assert lexical_search.search(docs.filter("text is null"), items).count() == 0


def test_a_full_filter_changes_nothing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bits = b"\xff" * (lexical_search.FILTER_BITS // 8)
    terms = lexical_search.item_terms(spark.createDataFrame(ITEMS, "item_id long, text string"))
    narrow, full = (lexical_search.index(docs, b) for b in (lexical_search.term_filter(terms), bits))
    wanted = terms.select("term").distinct()
    assert listed(narrow.select("term", "df").join(wanted, "term")) == listed(full.select("term", "df").join(wanted, "term"))


# --- stages of the pipeline on tables whose columns clash with helper names

def test_stages_keep_clashing_columns(spark):
    from packetloom.llm import decontamination, simhash_dedup

    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, 5, "a", "r"), (2, words + " more", 6, "b", None), (None, "quite another text", 7, None, "s"), (3, None, 8, "c", "t"), (None, "", 9, "d", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `key` int, `row` string, `root` string")
    kept = simhash_dedup.keep_one(docs)
    # texts without a word are copies of each other
    assert kept.columns == docs.columns and listed(kept) == sorted((r for r in rows if r[2] not in (6, 9)), key=str)
    items = spark.createDataFrame([(1, "quite another text")], "item_id long, text string")
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and listed(clean) == sorted((r for r in rows if r[2] != 7), key=str)
