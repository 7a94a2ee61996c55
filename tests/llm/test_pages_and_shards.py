"""HTML extraction, WARC archives and k-d shards."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import DOCS, documents, frame, prose

from pixelkin.llm import html_extract, kd_shards, warc_index

PAGES = "page_id long, url string, html string, text string, payload string"
NOISE = [
    "<header><h1>Site name</h1><a href=/>Home</a></header>",
    "<nav><ul><li><a href='/a'>Menu one</a><li><a href='/b'>Menu two</a></ul></nav>",
    "<div class='cookie-notice'>We use cookies. You accept this, and that, and more.</div>",
    "<div class=\"ad\">Buy now! Cheap, good, fast.</div>",
    "<aside>Related: this, that.</aside>",
    "<form><label>Mail</label><input name=q><button>Go</button></form>",
    "<script>var t = '<p>no</p>';</script><style>p{}</style><!-- <p>gone</p> -->",
    "<section id='comments'><p>First! I like this, a lot, really.</p></section>",
    "<footer>&copy; 2020 Somebody, all rights reserved.</footer>",
]


def page(rng, wrap, blocks):
    noise = list(NOISE)
    rng.shuffle(noise)
    body = "".join(noise[:5]) + wrap[0] + "".join(blocks) + wrap[1] + "".join(noise[5:])
    return f"<!DOCTYPE html><html><head><title>Title, not text</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<main class=x>", "</main>"), ("<div id=story>", "</div>")])
def test_article_without_its_surroundings(wrap):
    rng = random.Random(5)
    for _ in range(10):
        texts = [" ".join(prose(rng, rng.choice([3, 30, 60])).split()) for _ in range(6)]
        blocks = [f"<h1>{texts[0]}</h1>", f"<p>{texts[1]}</p>", f"<p>{texts[2].replace(' ', '  ', 2)}", f"<p>{texts[3]}</p>"]
        blocks += [f"<ul><li>{texts[4]}</li></ul>", f"<p><b>{texts[5]}<br></p>"]
        assert html_extract.main_text(page(rng, wrap, blocks)) == "\n\n".join(texts)


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("  ", ""), ("plain &amp; simple\n text", "plain & simple text"), ("<p>a<p>b", "a\n\nb"),
        ("<nav>x</nav>", ""), ("<article>a <b>b</b>c<br>d</article>", "a bc d"), ("<article>&lt;p&gt; &#233;&eacute;</article>", "<p> éé"),
        ("<article><p>one</p><table><tr><td>x<td>y</table></article>", "one\n\nx\n\ny"), ("<p", "<p"), ("<script>never closed", ""),
        ("<article><div hidden>no</div><p>yes</p></article>", "yes"), ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_odd_pages(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    "start,end",
    [("<div class='content has-sidebar'>", "</div>"), ("<div class=no-sidebar id=x>", "</div>"), ("<div class='ad-free'>", "</div>"),
     ("<form action=/x>", "</form>"), ("<div class=widget><div class=with-comments>", "</div></div>")],
)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_keep_their_article(start, end, tag):
    rng = random.Random(7)
    texts = [" ".join(prose(rng, 60).split()) for _ in range(3)]
    body = "".join(f"<p>{t}</p>" for t in texts)
    comments = "<div id=comments><article><p>First! I like this.</p></article></div>" if tag == "article" else ""
    got = html_extract.main_text(f"<body><nav>Menu</nav>{start}<{tag}>{body}</{tag}><div class=ad>Buy, now!</div>{comments}{end}</body>")
    assert got == "\n\n".join(texts)


@pytest.mark.parametrize("tag", ["article", "main"])
def test_paths_pick_inside_and_outside_of_the_article(tag):
    rng = random.Random(8)
    texts = [" ".join(prose(rng, size).split()) for size in (5, 60, 3, 70, 60, 80)]
    links = "<h3>Read on</h3><ul>" + "".join(f"<li><a href=/{k}>Another page</a></li>" for k in range(5)) + "</ul>"
    inside = f"<h1>{texts[0]}</h1><p>{texts[1]}</p><div>Print it</div><p>{texts[2]}</p><p>{texts[3]}</p>"
    one = html_extract.main_text(f"<body><div>Site</div><{tag}>{inside}{links}<div>Back to top</div></{tag}><div>Imprint</div></body>")
    assert one == "\n\n".join(texts[:4])
    # The element holds a part only, and the text goes on outside.
    rest = f"<div><p>{texts[4]}</p><p>{texts[5]}</p></div>"
    two = html_extract.main_text(f"<body><div>Site</div><{tag}>{inside}</{tag}>{rest}<div><a href=/>Home</a></div></body>")
    assert two == "\n\n".join(texts)


def test_extracted_table(spark):
    rows = [(1, "u", "<article>x</article>", "clash", "p"), (1, "u", "<article>x</article>", None, None), (None, None, None, None, None)]
    got = html_extract.extracted(spark.createDataFrame(rows, PAGES)).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "u", "x", 1)] * 2 + [(None, None, "", 0)])
    assert html_extract.extracted(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK_LINES", 4)
    rng = random.Random(2)
    rows = [(k, f"http://h{k % 7}.example.com:80/p/{k % 11}?q={k % 2}", prose(rng, 20) if k % 3 else "same", "x", "y") for k in range(90)]
    rows += [(200, None, None, None, None), (201, None, "", None, None), (202, "bad url \n http://[", "é\r\n\r\n\u0000", None, None), (3, rows[3][1], "same", "x", "y")]
    got = warc_index.archived(spark.createDataFrame(rows, PAGES).repartition(6)).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(r[2] or "", r[0])
    expected = Counter()
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        head = first[html or ""]
        expected[
            page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "response" if head == page_id else "revisit", None if head == page_id else head,
            payload if head == page_id else b"", True if head == page_id else None,
        ] += 1
    assert Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload), r.payload_valid) for r in got
    ) == expected
    assert warc_index.archived(spark.createDataFrame([], PAGES)).count() == 0
    small = warc_index.archived(spark.createDataFrame(rows, PAGES), least_bytes=10).where("record_type = 'revisit'")
    assert small.count() == 0


def test_capture_keys():
    assert warc_index.capture_key("https://User@WWW.Example.com:8080/a/b?x=1#f", 7) == "com,example,www:8080)/a/b?x=1 7"
    assert warc_index.capture_key(None, 7) == "- 7"


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_shards_are_even(spark, shards):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.choice([1, 20, 80])), rng.choice(["en", "de"]), f"s{k % 4}", *[None] * 5) for k in range(400)]
    rows += [(1000 + k, "copy " * 20, "en", "hot", *[None] * 5) for k in range(250)] + documents()
    got = kd_shards.sharded(frame(spark, rows), shards).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    sums, slots = Counter(), {}
    for r in got:
        sums[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(sums) == list(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # A cut is as near to its mark as the rows there allow; only the row of 30,000 letters is larger than the rest.
    assert max(sums.values()) - min(sums.values()) <= 30_001 + 2_000


def test_shards_of_little(spark):
    assert kd_shards.sharded(spark.createDataFrame([], DOCS)).count() == 0
    same = kd_shards.sharded(frame(spark, [(1, "a", "x", "y", *[None] * 5)] * 16), 4).collect()
    assert sorted(Counter(r.shard for r in same).values()) == [4, 4, 4, 4]
    assert sum(r.slot for r in kd_shards.sharded(frame(spark, [(1, None, None, None, *[None] * 5)] * 3)).collect()) >= 0


def test_equal_keys_with_different_pages_come_back_across_batches(spark, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [(7, "http://a.b/c", f"<p>{k % 6}</p>", None, None) for k in range(9)]
        rows += [(8, "http://a.b/d", "<p>0</p>", None, None), (None, None, "<p>x</p>", None, None)]
        got = warc_index.archived(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    digests = [base64.b32encode(hashlib.sha1(r[2].encode()).digest()).decode() for r in rows]
    assert Counter((r.page_id, r.payload_digest) for r in got) == Counter((r[0], d) for r, d in zip(rows, digests))
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {r[2].encode() for r in rows}


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000, "<div>x" * 30_000, "<nav>t" * 50_000, "<div>" * 20_000 + "<li>z" * 20_000, "<a " * 330_000,
     "<a \">" * 200_000, "<!--" * 250_000, "<" * 1_000_000, "<x'" * 100_000 + ">" * 50, "<header>q" * 30_000, "<form>a" * 30_000],
    ids=lambda page: page[:12],
)
def test_hostile_pages_take_linear_time(page):
    small = page[: len(page) // 4]
    clocks = []
    for text in (small, page):
        started = time.process_time()
        html_extract.main_text(text)
        clocks.append(time.process_time() - started)
    assert clocks[1] < 12 * max(clocks[0], 0.05)


def test_ratios_decide_where_tags_do_not(monkeypatch):
    """Divisions without names or links: only letters and marks a path tell text from labels."""
    rng = random.Random(4)
    told = 0
    for _ in range(20):
        texts = [" ".join(prose(rng, 70).split()) for _ in range(4)]
        labels = [" ".join(prose(rng, 2).replace(".", "").replace(",", "").split()) for _ in range(6)]
        body = "".join(f"<div><b>{x}</b></div>" for x in labels[:3]) + "".join(f"<div><div>{t}</div></div>" for t in texts)
        html = f"<body>{body}" + "".join(f"<section><div>{x}</div></section>" for x in labels[3:]) + "</body>"
        told += html_extract.main_text(html) == "\n\n".join(texts)
        with monkeypatch.context() as patch:
            everything = lambda texts, paths, outer: (np.array([bool(t.strip()) for t in texts]),) * 2
            patch.setattr(html_extract, "content_nodes", everything)
            assert html_extract.main_text(html) != "\n\n".join(texts)
    assert told >= 15


def test_ratios_against_plain_sums():
    rng = random.Random(6)
    texts = [rng.choice(["", " ", "Hello, you. ", "x", "a;b;c " * 4, prose(rng, 20)]) for _ in range(60)]
    paths, outer = [rng.randrange(5) for _ in texts], [rng.randrange(3) for _ in texts]
    passed, own = html_extract.content_nodes(texts, paths, outer)

    def ratios(of):
        out = []
        for p in of:
            mine = [t for t, q in zip(texts, of) if q == p]
            count = max(1, sum(bool(t.strip()) for t in mine))
            marks = sum(c in html_extract._PUNCTUATION for t in mine for c in t)
            out.append((sum(len(t.strip()) for t in mine) / count, marks / count))
        return out

    def smooth(values):
        return [sum(values[k + d] for d in (-1, 0, 1) if 0 <= k + d < len(values)) / 3 for k in range(len(values))]

    each = ratios(paths)
    fused = [a * (1 + b) for a, b in zip(smooth([x for x, _ in each]), smooth([y for _, y in each]))]
    real = [f for f, t in zip(fused, texts) if t.strip()]
    mean = sum(real) / len(real)
    least = html_extract.THRESHOLD * (sum((f - mean) ** 2 for f in real) / len(real)) ** 0.5
    assert passed.tolist() == [bool(t.strip()) and f >= least for f, t in zip(fused, texts)]
    assert own.tolist() == [bool(t.strip()) and a * (1 + b) >= least for (a, b), t in zip(ratios(outer), texts)]
