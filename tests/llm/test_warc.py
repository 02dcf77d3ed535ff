import hashlib
import io

from foliospark.llm import common, warc

PAGES = "page_id long, url string, html string"


def test_round_trip_with_small_ranges(spark):
    big = "<p>" + "é" * 1200 + "</p>"
    rows = [(k, f"http://x/{k}", f"<html>{k}" + "z" * (k * 37 % 5000)) for k in range(60)]
    rows += [(100, "http://a\r\nb", big), (101, None, big), (99, "u", big), (102, "u", None), (103, "u", ""), (104, "u", "small"), (105, "u", "small"), (106, "u", "\x1f\x8b\x08WARC/1.1\r\n\r\n" * 30), (107, "u", "y" * 500_000)]
    folder = common.new_path(spark, "t")
    files = common.materialize(warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), folder), "f")
    for split in (700, 1 << 20):
        got = {r.record_id: r for r in warc.read_warc(files, split).collect()}
        assert len(got) == len(rows)
        for page_id, url, html in rows:
            r = got[f"<urn:page:{page_id}>"]
            data = (html or "").encode()
            assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
            revisit = page_id in (99, 100)
            assert (r.record_type, r.refers_to) == (("revisit", "<urn:page:101>") if revisit else ("response", None))
            assert revisit or bytes(r.payload) == data


def test_false_magic_is_no_record():
    member = warc.record(1, "u", b"hello", hashlib.sha1(b"hello").digest(), None)
    data = b"junk\x1f\x8b\x08\x00more" + member + b"\x1f\x8b" + member + member[:20]
    found = list(warc.scan(io.BytesIO(data), len(data), 0, len(data)))
    assert [at for at, _ in found] == [12, 12 + len(member) + 2]
    assert warc.parse_record(found[0][1])["payload"] == b"hello"
    # Every record belongs to the one range it starts in.
    for cut in range(0, len(data), 7):
        halves = [*warc.scan(io.BytesIO(data), len(data), 0, cut), *warc.scan(io.BytesIO(data), len(data), cut, len(data))]
        assert [at for at, _ in halves] == [at for at, _ in found], cut


def test_empty_table(spark):
    files = common.materialize(warc.write_warc(spark.createDataFrame([], PAGES), common.new_path(spark, "t")), "f")
    assert files.count() == 0 and warc.read_warc(files).count() == 0
