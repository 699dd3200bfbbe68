"""op6: exact round trip, revisits by definition, pushed predicates, files of other writers."""

import gzip
import hashlib
import io

from crease.llm import op06_warc as op

BIG = "<p>" + "x" * 1000


def expected(data):
    best = {}
    for k, (page_id, _, html) in enumerate(data):
        b = (html or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, (False, 0, -1)), (page_id is not None, page_id or 0, k))
    out = []
    for k, (page_id, _, html) in enumerate(data):
        b = (html or "").encode()
        first = best.get(b)
        revisit = first is not None and first[2] != k
        out.append((page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response",
                    data[first[2]][0] if revisit else None))
    return out


def test_round_trip(spark, tmp_path):
    data = [(1, "http://a/\r\nX: y", BIG), (2, None, BIG), (3, "u", BIG + "é"), (4, "u", None), (5, "u", ""), (5, "u", ""),
            (6, "u", "short"), (7, "u", "short"), (8, "u", "a\r\n\r\nb" * 900), (8, "u", "a\r\n\r\nb" * 900), (None, "u", BIG)]
    data += [(100 + i, "u", "page %d " % i * 400) for i in range(60)]
    spark.createDataFrame(data, "page_id long, url string, html string").coalesce(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in op.op6_warc_pages(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected(data), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert op.op6_warc_pages(spark, str(tmp_path)).collect() == []


def test_reads_plain_and_other_gzip(spark, tmp_path):
    recs = [op.record({"WARC-Type": t, "WARC-Record-ID": f"<{i}>", "X-A": str(i % 2)}, b"block\r\n\r\n%d" % i * (i * 700))
            for i, t in enumerate(["warcinfo", "response", "metadata", "response"])]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(op.member(r) for r in recs))
    df = op.read(spark, str(tmp_path))
    assert df.count() == 12
    some = df.filter("record_type = 'response'")
    assert "warc" in some._jdf.queryExecution().executedPlan().toString().lower()
    rows = some.select("record_id", "payload").collect()
    assert len(rows) == 6 and all(bytes(r.payload) == b"block\r\n\r\n%d" % int(r.record_id[1:-1]) * (int(r.record_id[1:-1]) * 700) for r in rows)
    assert {r.record_id for r in op.read(spark, str(tmp_path), payload="false", **{"header:X-A": "1"}).filter("payload IS NULL").collect()} == {"<1>", "<3>"}


def test_unwanted_blocks_are_not_read():
    recs = [op.member(op.record({"WARC-Type": "a" if i else "b"}, __import__("os").urandom(200_000))) for i in range(20)]

    class Counting(io.BytesIO):
        n = 0

        def read(self, k=-1):
            data = super().read(k)
            self.n += len(data)
            return data

    f = Counting(b"".join(recs))
    assert len(list(op.read_records(f, len(f.getvalue()), lambda h: h["warc-type"] == "b", True))) == 1
    assert f.n < 300_000


def test_commits_add_up_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "archive")
    page = lambda i: spark.createDataFrame([(i, "u", f"page {i}"), (i + 1, "u", f"page {i + 1}")], "page_id long, url string, html string")
    ids = lambda: sorted(int(r.headers["x-page-id"]) for r in op.read(spark, path).collect())
    op.write_pages(page(1), path)
    op.write_pages(page(3), path)
    assert ids() == [1, 2, 3, 4]
    op.page_records(page(7)).write.format("warc").mode("overwrite").save(path)
    assert ids() == [7, 8]


def records_of(data, payload=True, wanted=lambda h: True):
    return [(h["warc-record-id"], b) for h, b in op.read_records(io.BytesIO(data), len(data), wanted, payload, "x.warc.gz")]


def test_many_records_in_one_member():
    recs = [op.record({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, b"\r\nblock\r\n\r\n%d" % i * (i * 3000)) for i in range(4)]
    want = [(f"<{i}>", b"\r\nblock\r\n\r\n%d" % i * (i * 3000)) for i in range(4)]
    whole = gzip.compress(b"".join(recs))
    assert records_of(whole) == want
    assert records_of(gzip.compress(b"".join(recs[:3])) + op.member(recs[3])) == want
    assert records_of(op.member(b"".join(recs[:2])) + gzip.compress(b"".join(recs[2:]))) == want
    assert [k for k, _ in records_of(whole, payload=False)] == ["<0>", "<1>", "<2>", "<3>"]
    assert records_of(whole, wanted=lambda h: h["warc-record-id"] == "<2>") == want[2:3]


def test_bad_records_name_file_and_byte():
    import pytest
    good = op.record({"WARC-Type": "response", "WARC-Record-ID": "<1>"}, b"x" * 5000)
    odd = good.replace(b"Content-Length: 5000", b"Content-Length: abc")
    at = len(good)
    for data, what in ((good + odd, f"byte {at}: Content-Length 'abc'"), (good + good[:-2000], f"byte {at}: block cut off"),
                       (good + b"WARC/1.1\r\nWARC-Type: x", f"byte {at}: headers without an end"),
                       (op.member(good) + gzip.compress(good)[:-40], f"byte {len(op.member(good))}: "), (op.member(odd), "byte 0: Content-Length 'abc'"),
                       (op.member(good) + op.member(good)[:-3], f"byte {len(op.member(good))}: ")):
        for payload in (True, False):
            with pytest.raises(op.BadRecord, match="x.warc.gz, " + what.replace("'", ".")):
                records_of(data, payload)


def test_bad_files_are_reported(spark, tmp_path):
    import pytest
    good = op.record({"WARC-Type": "response", "WARC-Record-ID": "<1>"}, b"x" * 50)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good * 3))
    (tmp_path / "b.warc").write_bytes(good + good.replace(b": 50", b": fifty"))
    with pytest.raises(Exception, match="b.warc, byte"):
        op.read(spark, str(tmp_path)).collect()
    got = op.read(spark, str(tmp_path), bad="report").collect()
    assert sum(r.record_id == "<1>" for r in got) == 4 and len(got) == 5
    assert [r.headers["x-error"].endswith(f"b.warc, byte {len(good)}: Content-Length 'fifty'") for r in got if "x-error" in r.headers] == [True]
