"""WARC, HTML, URL filters and nearest neighbours on small tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import forest, templates, urls, warc
from gridloom.llm.common import scratch_path

EXTRA = "host string, payload int, digest string"


def members(n: int) -> list[bytes]:
    return [warc.record_bytes(k, f"http://a/{k}", (b"WARC/1.0\r\n line %d " % k) * 30, None, False) for k in range(n)]


def numbers(pieces) -> list:
    return [p.headers["warc-record-id"] if p.reason is None else (p.start, p.end) for p in pieces]


def urn(k: int) -> str:
    return f"<urn:x-page:{k}>"


def test_whole_archives_have_no_gaps():
    plain = members(4)
    assert numbers(warc.salvage(b"".join(plain))) == [urn(k) for k in range(4)]
    assert numbers(warc.salvage(b"".join(map(warc.gzip_member, plain)))) == [urn(k) for k in range(4)]
    assert numbers(warc.salvage(warc.gzip_member(b"".join(plain)))) == [urn(k) for k in range(4)]
    assert list(warc.salvage(b"")) == []


def test_damage_costs_only_what_it_hits():
    packed = [warc.gzip_member(r) for r in members(6)]
    broken = bytearray(packed[2])
    broken[40] ^= 0xFF
    data = b"".join([packed[0], packed[1], bytes(broken), packed[3], packed[4][:60], packed[5], b"junk"])
    at = len(packed[0]) + len(packed[1])
    after = at + len(broken) + len(packed[3])
    assert numbers(warc.salvage(data)) == [urn(0), urn(1), (at, at + len(broken)), urn(3), (after, after + 60), urn(5), (len(data) - 4, len(data))]


def test_plain_records_are_found_again():
    r = members(4)
    wrong = r[1].replace(b"line 1 ", b"LINE 1 ", 1)  # fails its digest; version lines inside its payload start no record
    data = r[0] + wrong + r[2][:90] + r[3]
    first = len(r[0])
    assert numbers(warc.salvage(data)) == [urn(0), (first, first + len(wrong) + 90), urn(3)]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**30), st.integers(1, 5))
def test_salvage_tiles_the_file(seed, hits):
    r = random.Random(seed)
    data = bytearray(b"".join(warc.gzip_member(m) if r.random() < 0.7 else m for m in members(5)))
    for _ in range(hits):
        data[r.randrange(len(data))] ^= 1 << r.randrange(8)
    at = last = 0
    for p in warc.salvage(bytes(data)):
        assert p.start == at or p.reason and p.start == last  # the gap of a broken member whose record was recovered
        assert p.end > p.start
        at, last = p.end, p.start
    assert at == len(data)


def test_records_beside_a_damaged_one_in_a_member_come_back():
    plain = members(5)
    wrong = plain[3].replace(b"line 3 ", b"LINE 3 ", 1)
    member = warc.gzip_member(b"".join([*plain[:3], wrong, plain[4]]))
    found = list(warc.salvage(member))
    assert [p.headers["warc-record-id"] for p in found if p.reason is None] == [urn(0), urn(1), urn(2), urn(4)]
    gap = next(p for p in found if p.reason)
    first = sum(map(len, plain[:3]))
    assert gap.reason.startswith(f"bytes {first} to {first + len(wrong)} of the member: ") and (gap.start, gap.end) == (0, len(member))


def test_whole_records_of_a_cut_or_broken_member_come_back():
    r = random.Random(5)
    plain = [warc.record_bytes(k, f"http://a/{k}", bytes(r.randrange(256) for _ in range(400)), None, False) for k in range(20)]
    member = warc.gzip_member(b"".join(plain))
    cut = list(warc.salvage(member[: int(0.7 * len(member))] + warc.gzip_member(members(1)[0])))
    back = [p.headers["warc-record-id"] for p in cut if p.reason is None]
    assert back[:-1] == [urn(k) for k in range(len(back) - 1)] and len(back) >= 13 and back[-1] == urn(0)
    assert [p.reason for p in cut if p.reason] and "records recovered" in next(p.reason for p in cut if p.reason)
    checksum = bytearray(member)
    checksum[-6] ^= 1  # only the trailer is wrong: every record's digest proves it
    assert [p.headers["warc-record-id"] for p in warc.salvage(bytes(checksum)) if p.reason is None] == [urn(k) for k in range(20)]
    without = [x.replace(b"WARC-Payload-Digest", b"X-Payload").replace(b"WARC-Block-Digest", b"X-Block") for x in plain]
    checksum = bytearray(warc.gzip_member(b"".join(without)))
    checksum[-6] ^= 1
    assert all(p.reason for p in warc.salvage(bytes(checksum)))


def test_http_headers_may_end_lines_with_lf_alone():
    payload = b"hello\n\nworld"
    block = b"HTTP/1.1 200 OK\nContent-Type: text/html\n\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:{warc.base32_sha1(payload)}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    (piece,) = warc.salvage(head + block + warc.END)
    assert piece.reason is None and piece.payload == payload


def test_written_archives(spark):
    rows = [(1, "u", None), (2, "u\n", ""), (3, None, "x"), (None, "q", "x"), (3, None, "x"), (4, "z", "y" * 50_000), (5, "", "y" * 50_000)]
    pages = spark.createDataFrame([(*r, "h", 1, "d") for r in rows], f"page_id long, url string, html string, {EXTRA}")
    folder = scratch_path(spark, "warc")
    archives = warc.write_archives(warc.with_revisits(pages), folder)
    archives = spark.createDataFrame(archives.collect(), archives.schema)
    read = [(r.record_type, r.record_id, r.payload_bytes, r.refers_to) for r in warc.read_written(archives, folder).collect()]
    expected = [("revisit", urn(1), 0, urn(2)), ("response", urn(2), 0, None), ("response", urn(3), 1, None), ("response", urn(3), 1, None), ("revisit", "<urn:x-page:>", 1, urn(3)), ("revisit", urn(4), 50_000, urn(5)), ("response", urn(5), 50_000, None)]
    assert sorted(read, key=str) == sorted(expected, key=str)
    assert {(r.record_type, r.record_id) for r in warc.read_archives(spark, folder).collect()} == {e[:2] for e in expected}
    assert warc.write_archives(warc.with_revisits(pages.where("false")), folder).count() == 0


def test_odd_urls_lose_no_page(spark):
    odd = [chr(c) for c in (0x85, 0x2028, 0x2029, 0xFEFF, 0x1C, 0x1D, 0x1E, 0x0B, 0x0C, 0x0D, 0x0A, 0xE9, 0x1F600)]
    rows = [(k, f"http://a/{c}x: y{c}", f"page {k % 4}") for k, c in enumerate(odd)]
    records, gaps = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch_path(spark, "warc"))
    got = {r.record_id: r.target_uri for r in records.collect()}
    assert set(got) == {urn(k) for k in range(len(odd))} and gaps.count() == 0
    from urllib.parse import unquote

    assert all(unquote(got[urn(k)]) == rows[k][1] and got[urn(k)].isascii() for k in range(len(odd)))


def test_gaps_are_logged(spark, tmp_path):
    packed = [warc.gzip_member(r) for r in members(3)]
    (tmp_path / "a.warc.gz").write_bytes(packed[0] + packed[1][:50] + packed[2])
    records, gaps = warc.records_and_gaps(warc.read_archives(spark, str(tmp_path)))
    assert {r.record_id for r in records.collect()} == {urn(0), urn(2)}
    assert [(r.start, r.stop) for r in gaps.collect()] == [(len(packed[0]), len(packed[0]) + 50)]


def test_version_lines_in_bulk_are_searched_once():
    noise = b"WARC/1.1\r\nbad\r\n" * 20_000
    data = noise + members(1)[0]
    found = list(warc.salvage(data))
    assert [p.reason is None for p in found] == [False, True] and found[1].headers["warc-record-id"] == urn(0)


ARTICLE = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One  two.<br><p>Three\n four &eacute;.</p><div class="comments"><p>Nice!</p></div></article><footer>&copy; me</footer></body></html>'


def test_articles_without_furniture():
    assert templates.main_text(ARTICLE) == "A & B\nOne two.\nThree four é."
    assert templates.main_text("") == ""
    assert templates.main_text("plain words") == "plain words"
    assert templates.main_text('<p>x<p title="a>b">y<!-- <p>z --><p').startswith("x\ny")
    assert templates.main_text('<body><div id="c"><h1>T</h1><div class="w-1/2"><p>Long words here.</p></div></div><div class="x">aside</div></body>') == "T\nLong words here."
    assert templates.main_text("<main><header><h1>T</h1></header><p hidden>n</p><p>a<i>b</i>c</p></main>").endswith("abc")
    assert templates.main_text("<p>a</p><!-- open <p>b</p> c") == "a" and templates.main_text("<p>a</p><script>b</p> c") == "a"
    assert templates.main_text("<p>a</p>b <!-- c") == "a\nb"


def test_an_article_of_many_parts_is_kept_whole():
    parts = '<div class="content"><h1>T</h1><p>%s</p><ul><li>%s</li></ul><blockquote>%s</blockquote></div><div class="zz"><a href="/">%s</a></div>'
    long = ["word " * 60, "item " * 100, "quote " * 50, "link " * 40]
    assert templates.main_text(f"<body>{parts % tuple(long)}</body>") == "\n".join(["T", *(x.strip() for x in long[:3])])


def host_pages(page: str, n: int, host: str = "h", first: int = 0) -> list[tuple]:
    """Pages whose every %w is other words on each page."""
    r = random.Random(host)
    words = lambda: " ".join("".join(r.choice("bdfgklmn") + r.choice("aeiou") for _ in range(3)) for _ in range(8))
    out = []
    for k in range(n):
        html = page
        while "%w" in html:
            html = html.replace("%w", words(), 1)
        out.append((first + k, f"http://{host}/{k}", html))
    return out


def run_host(spark, rows):
    return {r.page_id: r.text for r in templates.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_templates_drop_what_a_host_repeats(spark):
    page = '<html><body><div class="top">Menu A</div><div class="wrap"><div class="post"><p>Text %d one two.</p><p>More %d words, at some length.</p></div><div class="box">About us</div></div><div class="foot">Imprint</div></body></html>'
    rows = [(k, f"http://h/{k}", page % (k, k), "h", 1, "d") for k in range(8)] + [(100, None, None, "h", 1, "d"), (101, "x", "", "h", 1, "d"), (3, "http://h/3", page % (3, 3), "h", 1, "d")]
    pages = spark.createDataFrame(rows, f"page_id long, url string, html string, {EXTRA}")
    out = templates.extract_pages(pages).collect()
    assert len(out) == 11
    for r in out:
        assert r.text == (f"Text {r.page_id} one two.\nMore {r.page_id} words, at some length." if r.page_id < 100 else "")
        assert r.n_chars == len(r.text)
    assert templates.extract_pages(pages.where("false")).count() == 0


def test_templates_drop_what_a_host_repeats_in_articles(spark):
    page = '<html><body><article><h1>T %d</h1><p>By <b>N%d</b> today</p><p>Words %d, at length.</p><div class="zq"><p>Cite us.</p></div><p>Own %d end.</p><p>All rights kept.</p></article></body></html>'
    copy = '<html><body><article><h1>One</h1><div class="c"><p>The same long text.</p><p>And more of it.</p></div></article><i>%d</i></body></html>'
    moved = page.replace("<p>All rights kept.</p>", "").replace("<article>", "<article><p>All rights kept.</p>")
    rows = [(k, f"http://h/{k}", (moved if k == 7 else page) % (k, k, k, k)) for k in range(12)]
    rows += [(100 + k, f"http://copies/{k}", copy % k) for k in range(8)] + [(200 + k, f"http://few/{k}", page % (k, k, k, k)) for k in range(3)]
    out = run_host(spark, rows)
    for k, _, html in rows:
        alone = templates.main_text(html)
        if k == 7:  # out of its slot there, so it may be data
            assert out[k] == alone.replace("\nCite us.", "")
        elif k < 100:
            assert out[k] == f"T {k}\nBy N{k} today\nWords {k}, at length.\nOwn {k} end." != alone
        else:  # copies of one page are no template, and few pages are no evidence
            assert out[k] == alone


def test_templates_find_plain_articles(spark):
    """No element or class name helps here: bars of other words on each page, the article in a plain div, and furniture in it."""
    page = '<html><body class="p%w"><div class="aa"><ul><li><a href="/">%w</a></li><li><a href="/">%w</a></li></ul></div><div class="bb"><h2>%w</h2><div class="cc"><p>%w</p><div class="dd">Liked it? Tell a friend of it.</div><p>%w</p><p>%w</p><p>%w</p></div></div><div class="ee">%w</div></body></html>'
    rows = host_pages(page, 12)
    out = run_host(spark, rows)
    for k, _, html in rows:
        own = [x for x in __import__("re").sub(r"<[^>]*>", "\n", html).split("\n") if x]
        assert out[k] == "\n".join([own[2], own[3], *own[5:8]])
        assert "Liked it" in templates.main_text(html) and "Liked it" not in out[k]


def test_classes_against_explicit_vectors(spark):
    r = random.Random(6)
    blocks = ['<div class="a"><b>One</b></div>', "<ul><li>x<li>%d</ul>", '<div class="q"><i>Two</i><u>Three</u></div>', "<p>%d words</p>", "<table><tr><td>%d</td></tr></table>"]
    rows = [(k, f"http://h{k % 2}/{k}", "<body>" + "".join(b.replace("%d", str(r.random())) for b in blocks if r.random() < 0.8) + "</body>") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("url", "html", "page_id as number", "substring(url, 8, 2) as host")
    got = {x.host: templates.template_of(x.classes, x.texts) for x in templates.class_templates(templates.page_statistics(pages)).collect()}
    for host in ("h0", "h1"):
        own = [templates.tokens_of(html).tokens for _, url, html in rows if f"//{host}/" in url]
        vectors, at = {}, {}
        for n, tokens in enumerate(own):
            for k, (kind, key, *_) in enumerate(tokens):
                if key:
                    vector = vectors.setdefault((kind == templates.TEXT, key), [0] * len(own))
                    vector[n] += 1
                    at.setdefault((kind == templates.TEXT, key), {}).setdefault(n, k)
        grouped = {}
        for token, vector in vectors.items():
            on = sum(map(bool, vector))
            if on / len(own) >= 0.5 and (not token[0] or (on + 1.92 - 1.96 * (on * (1 - on / len(own)) + 0.9604) ** 0.5) / (len(own) + 3.8416) >= 0.5):
                grouped.setdefault(tuple(vector), []).append(token)
        mean = lambda t: sum(at[t].values()) / len(at[t])
        tags = {tuple(t[1] for t in sorted(own, key=mean) if not t[0]) for own in grouped.values() if len(own) >= 3 and not all(t[0] for t in own)}
        texts = {t[1] for own in grouped.values() if len(own) >= 3 and not all(t[0] for t in own) for t in own if t[0]}
        assert set(map(tuple, got[host].classes)) == tags and {t for own in got[host].texts for t in own} == texts
    assert any(own for t in got.values() for own in t.texts)


def test_classes_must_be_in_order_and_nest():
    assert templates.valid_classes([1, 2, 9, 3, 1, 2, 3], [[1, 2, 3]]) == {0}
    assert templates.valid_classes([1, 3, 2], [[1, 2, 3]]) == set()
    assert templates.valid_classes([1, 5, 6, 2, 5, 6], [[1, 2], [5, 6]]) == {0, 1}
    assert templates.valid_classes([1, 5, 2, 6], [[1, 2], [5, 6]]) == {0}
    assert templates.valid_classes([1, 5, 2, 6, 3, 7], [[1, 2, 3], [5, 6], [7]]) == {0, 2}
    assert templates.valid_classes([1, 2], [[1, 2, 3], [4]]) == set()


def test_deep_and_broken_pages_take_linear_means(spark):
    import time
    import tracemalloc

    odd = ["<div class='x'>" * 50_000 + "text" + "</div>" * 50_000, "<div>" * 50_000 + "text" + "</ul>" * 50_000, "a > b" + "<p " * 100_000, '<a "' * 50_001 + ">", "<!-- " * 50_000, "<script>" * 50_000, "<ul><li>" * 30_000 + "text"]
    for html in odd:
        began = time.perf_counter()
        tracemalloc.start()
        text = templates.main_text(html)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 << 20 and time.perf_counter() - began < 60
        if "text" in html:
            assert text == "text"
    out = run_host(spark, [(k, "http://deep/", html) for k, html in enumerate(odd[:2] + odd[-1:])])
    assert set(out.values()) == {"text"}


def by_hand(url):
    """Host, path, rule and verdict of the path rules, straight from their wording."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_path_rules(spark):
    own = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7?x#y", "https://a.example.com/en/8", "http://com/en/", "http://xcom/en/", "http://b.example.net/de/8", "http://net/de/9#/q", "http://x.org/es/", "http://x.org/ES/", "ftp://h?/en/", "http://h.com#a/en/", "a://b://c.com/en/1", "http://ÄX.org/es/\n1"]
    pages = spark.createDataFrame([(k, u, "h", 1, "d") for k, u in enumerate(own)] + [(1, "", "h", 1, "d")], f"page_id long, url string, {EXTRA}")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = urls.judge_urls(pages, labels).collect()
    assert len(out) == len(own) + 1
    for r in out:
        host, path, rule, verdict = by_hand(own[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urls.judge_urls(pages.where("false"), labels).count() == 0


def test_rules_are_mined_from_labels(spark):
    rows, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        rows.append((k, f"http://{'shop' if bad else 'news'}{k % 3}.site.test/{'offer' if bad else 'story'}/{k}"))
        labels.append((k, 0 if bad else 1, 0))
    rows += [(900, "http://shop1.site.test/offer/5"), (901, "http://news1.site.test/story/5"), (902, "http://best-casino.test/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r for r in urls.judge_urls(pages, spark.createDataFrame(labels + [(None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")).collect()}
    assert out[900].verdict == "block" and out[900].confidence == 1.0 and "path=offer" in out[900].matched
    assert out[901].verdict == "allow" and out[901].matched is None
    assert sum(out[k].verdict == "block" for k in range(240)) == 60


def brute_rules(cases, floor, longest):
    """{rule tokens: (support, seen)} by trying every combination of items over all cases."""
    from itertools import combinations

    where = {}
    for n, (tokens, _) in enumerate(cases):
        for t in tokens:
            where.setdefault(t, set()).add(n)
    wrong = {n for n, (_, bad) in enumerate(cases) if bad}
    items = {}
    for t, own in where.items():
        if len(own & wrong) >= floor:
            items.setdefault(frozenset(own), []).append(t)
    found = {}
    for size in range(1, longest + 1):
        for combo in combinations(items.items(), size):
            own = frozenset.intersection(*[c[0] for c in combo])
            n, k = len(own), len(own & wrong)
            if k < floor or k / n < urls.MIN_CONFIDENCE:
                continue
            c, z = k / n, urls.Z
            if (c + z * z / (2 * n) - z * (c * (1 - c) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) < urls.MIN_LOWER_BOUND:
                continue
            inner = [i for i in found if i < frozenset(x[1][0] for x in combo)]
            if not any(found[i][1] / found[i][2] >= c for i in inner):
                found[frozenset(x[1][0] for x in combo)] = (tuple(sorted(t for x in combo for t in x[1])), k, n)
            else:  # stands as a rule for what is inside it, but is not told of
                found[frozenset(x[1][0] for x in combo)] = (None, k, n)
    return {rule: (k, n) for rule, k, n in found.values() if rule}


@pytest.mark.parametrize("long", [12, 4])
def test_rules_against_every_combination(spark, monkeypatch, long):
    """With `long` 4 most URLs have over LONG items, and no combination is whole on one side of it."""
    monkeypatch.setattr(urls, "LONG", long)
    r = random.Random(11)
    cases = []
    for _ in range(400):
        tokens = {t for t in "abcdefgh" if r.random() < 0.5}
        bad = {"a", "b"} <= tokens or {"c", "d", "e", "f"} <= tokens or r.random() < 0.12
        cases.append((sorted(tokens | {"all", "every"}), bad))
    table = spark.createDataFrame([(t, b, True) for t, b in cases], "tokens array<string>, bad boolean, given boolean")
    got = {tuple(x.rule): (x.support, x.seen) for x in urls.mine_rules(table).collect()}
    assert got == brute_rules(cases, urls.MIN_COUNT, 9) and ("a", "b") in got and ("c", "d", "e", "f") in got


def test_given_labels_win_over_seeds(spark):
    rows = [(k, f"http://adult-education{k % 2}.test.org/course/{k}") for k in range(60)] + [(100 + k, f"http://big-casino.test.com/{k}") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    out = {r.page_id: r.verdict for r in urls.judge_urls(pages, labels, seeds=("adult", "casino")).collect()}
    assert all(v == ("allow" if k < 100 else "block") for k, v in out.items())
    none = {r.verdict for r in urls.judge_urls(pages, labels).collect()}
    assert none == {"allow"}


def test_long_urls_are_mined_in_time(spark):
    """30 segments, all of them frequent and no two in the same URLs: subsets cannot be enumerated."""
    r = random.Random(3)
    rows = [(k, "http://deep.test.com/" + "/".join(f"s{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(30) if r.random() < 0.95) + "/" + "z" * 5000) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.judge_urls(pages, spark.createDataFrame([(k, 0, 0) for k in range(60)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 60 and all(x.verdict == "block" for x in out)


def test_neighbours_against_brute_force(spark):
    """Clusters of many norms, two lengths of vectors, repeated ids, ties, and rows that take no part."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 24))
    own = np.repeat(centres, 60, axis=0) + 0.4 * r.normal(size=(720, 24))
    own[5] = own[40] = own[400] = own[20]  # ties
    own *= r.uniform(0.5, 2.0, size=(720, 1)).astype(np.float32) ** np.arange(720).reshape(-1, 1).__mod__(2)
    own = own.astype(np.float32).astype(np.float64)
    rows = [(k, v.tolist()) for k, v in enumerate(own)] + [(7, own[7].tolist()), (40, own[41].tolist())]
    rows += [(1000 + k, r.normal(size=3).astype(np.float32).astype(float).tolist()) for k in range(50)] + [(2100, [1.0, 2.0])]
    odd = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0, None] + [0.0] * 22), (2080, [float("inf")] + [0.0] * 23), (None, own[1].tolist())]
    table = spark.createDataFrame([(*x, 1, "a") for x in rows + odd], "vec_id long, embedding array<float>, rank int, score string")
    from pyspark.sql import functions as F

    expected = {}
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-sum(np.multiply(w, v)), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v))[:20]
            expected.setdefault(q, []).extend(near)
    out = forest.search(table, F.col("vec_id") % 20 == 0, 20).toPandas()
    hits = 0
    scores = {}
    for i, w in rows:
        scores.setdefault(i, []).append(w)
    asked = {q: [v for i, v in rows if i == q] for q in expected}
    for q, found in out.groupby("query_id"):
        assert sorted(found["rank"]) == sorted(list(range(1, 21)) * len(asked[q]))
        for x in found.itertuples():
            assert any(abs(x.score - np.dot(v, w)) < 1e-9 for v in asked[q] if len(v) for w in scores[x.vec_id] if len(w) == len(v))
        for k in range(len(asked[q]) == 1):  # in order, ties to the smaller id
            pairs = [(-x.score, x.vec_id) for x in found.sort_values("rank").itertuples()]
            assert pairs == sorted(pairs)
        hits += len(set(found.vec_id) & {i for _, i in expected[q]}) if len(asked[q]) == 1 else len(expected[q])
    assert set(out.query_id) == {q for q in expected if q != 2100}
    assert hits / sum(map(len, expected.values())) >= 0.9
    few = forest.search(table.where("vec_id < 5"), F.col("vec_id") % 20 == 0, 20).collect()
    assert len(few) == 4
    assert forest.search(table.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_only_candidates_are_scored():
    """On clusters, a small share of the rows is looked at, and nothing but that."""
    r = np.random.default_rng(9)
    rows = np.repeat(r.normal(size=(40, 32)), 50, axis=0) + 0.05 * r.normal(size=(2000, 32))
    keys = np.arange(2000)
    q, found, score, scored = forest.nearest(rows, keys, keys, rows[::20], keys[::20], 20)
    assert scored < 0.1 * 2000 * 100
    exact = rows[::20] @ rows.T
    exact[np.arange(100), keys[::20]] = -np.inf
    hits = sum(len(set(found[q == i]) & set(np.argsort(-exact[i])[:20])) for i in range(100))
    assert hits >= 0.9 * 2000
    assert np.allclose(score, exact[q, found])


def test_ascent_is_monotone():
    r = np.random.default_rng(1)
    rows = r.normal(size=(500, 16))
    normals = forest.planes(16)
    trees = forest.Forest.of(rows, normals, float(np.linalg.norm(rows, axis=1).max()))
    asked = forest.hash_strings(rows[:30], normals, None)
    for visits in (1, 50, 1000, 10**9):
        begin, end = trees.ascend(asked, visits)
        held = (end - begin).sum(axis=0)
        assert (held >= min(visits, 500 * forest.TREES)).all()
    assert trees.strings.max() < 1 << forest.BITS and (np.sort(trees.strings, axis=1) == trees.strings).all()


def test_pipeline_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("fp", __import__("pyspark").sql.functions.lit("extra"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "simhash near-dedup", "best-fit packing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        kept = after.count()
        assert 0 < kept < before or name == "simhash near-dedup"
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs, before = spark.createDataFrame(after.collect(), after.schema), kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
