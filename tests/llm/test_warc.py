import glob
import io

import zstandard

from cardpulse.llm import warc
from cardpulse.llm.common import scratch_path

PAGES = [(1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200), (3, None, "short"), (4, "http://a/é b", "short"),
         (5, "u", None), (6, "u", ""), (None, "u", "x" * 200), (None, "n", "y" * 150), (7, "v", "ä" * 60), (8, "v", "ä" * 60),
         (9, "w", "long " * 50_000), (9, "w", "long " * 50_000), (10, "\r\n\r\n: x", "\r\n\r\nContent-Length: 3\r\n\r\n" * 9)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = scratch_path(spark)
    rows = warc.archive(pages, path).collect()
    kinds = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    size = {i: len((h or "").encode()) for i, _, h in PAGES}
    want = [(i, len((h or "").encode()), "revisit" if i in (2, 8) or (i is None and h[0] == "x") else "response",
             {2: 1, 8: 7}.get(i, 1 if i is None and h[0] == "x" else None)) for i, _, h in PAGES]
    assert kinds == sorted(want, key=str)
    back = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read(spark, path, payload=True).collect() if r["payload"] is not None}
    assert back == {(i, h or "") for (i, _, h), w in zip(PAGES, want) if w[2] == "response"}


def test_files_are_plain_zstandard(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7} some page text</p>" * 20) for i in range(300)], "page_id long, url string, html string")
    path = scratch_path(spark)
    warc.write(warc.classify(pages), path)
    n = 0
    for f in glob.glob(path.removeprefix("file:") + "/part-*"):
        data = open(f, "rb").read()
        if not data:
            continue
        assert data[:4] == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        d = zstandard.ZstdCompressionDict(data[8:8 + size]) if size else None
        text = zstandard.ZstdDecompressor(dict_data=d).stream_reader(io.BytesIO(data[8 + size:]), read_across_frames=True).read()
        n += text.count(b"WARC/1.1\r\n")
    assert n == 300


def test_no_rows(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string, payload string"), scratch_path(spark)).count() == 0
