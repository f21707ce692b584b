import gzip

from tessara.llm import files, warc


def plain(pages):
    """(page_id, bytes, digest, type, refers_to) by a plain loop."""
    first = {}
    for page_id, _, html in pages:
        payload = (html or "").encode()
        if page_id is not None:
            first[payload] = min(page_id, first.get(payload, page_id))
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        seen = first.get(payload)
        back = None if seen is None or seen == page_id else seen
        out.append((page_id, len(payload), warc.digest_of(payload), "response" if back is None else "revisit", back))
    return sorted(out, key=str)


def test_url_keys():
    assert warc.url_key("https://www.Blog.example.COM:443/En/1?B=2#top") == "com,example,blog)/en/1?b=2"
    assert warc.url_key("http://a.b:8080") == "b,a:8080)/"
    assert warc.url_key(None) == warc.url_key("") == ""
    assert warc.url_key("http://[bad/") == "http://[bad/"


def test_archives_and_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = [(i, f"http://h{i % 7}.example.org/p{i}", f"<p>{i // 2}</p>" * (i % 5)) for i in range(40)]
    pages += [(100, "http://h1.example.org/p1", "é" * 9000), (99, "http://h1.example.org/p1", "é" * 9000), (101, None, None), (102, "x\r\ny", ""), (103, "http://h1.example.org/p1", None), (103, "http://h1.example.org/p1", None)]
    rows = spark.createDataFrame([(*p, "more") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    captures = warc.write(rows)
    assert captures.count() == len(pages)
    index = warc.build_index(captures)
    got = warc.read(warc.listed(index))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == plain(pages)
    for url in ("http://h1.example.org/p1", "https://www.h3.example.org/p3", "", "http://absent.org"):
        want = sorted(p for p, u, _ in pages if warc.url_key(u) == warc.url_key(url))
        wanted = spark.createDataFrame([(url,)], "url string")
        found = warc.lookup(index, wanted)
        assert sorted(r.page_id for r in found.collect()) == want
        assert sorted(r.page_id for r in warc.read(found).collect()) == want
    texts = {p: (h or "").encode() for p, _, h in pages}
    assert all(bytes(r.payload) == texts[r.page_id] for r in warc.read(captures, payloads=True).collect() if r.record_type == "response")
    archive = captures.first().archive
    assert gzip.decompress(files.get(archive)).startswith(b"WARC/1.1\r\n")


def test_empty_table_and_small_payloads(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.listed(warc.build_index(warc.write(empty)))).collect() == []
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long text"), (4, "d", "long text")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.write(pages, least=5).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
