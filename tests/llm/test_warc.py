import base64
import gzip
import hashlib
import pathlib

from pyspark.sql import functions as F

from driftmon.llm.warc import read_archives, reachable, round_trip, sha1_base32, write_archives

KIND = "page_id long, url string, html string, digest string, off long, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], KIND).repartition(3)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/\r\n4", ""),
    (5, "http://a/5", f"before {FAKE}{FAKE} after"), (6, "http://a/6", "x WARC/1.0\r\nno header at all"),
    (7, "http://a/7", FAKE), (8, "http://a/8", "é\U0001f600" * 9), (None, "http://a/n", "<p>one</p>"), (None, "u", "alone"),
    (9, "http://a/9", "WARC/1.0\r\nContent-Length: 999999\r\n\r\n"), (10, "u", "y\r\n\r\nz" * 30_000), (11, "u", "dup"), (11, "u", "dup"),
    (12, "u", "tail WARC/1.0\r\n"),
]


def brute(rows, least):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    count = {}
    for _, _, h in rows:
        count[h or ""] = count.get(h or "", 0) + 1
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = last.get(h or "")
        again = len(raw) >= least and count[h or ""] > 1 and to is not None and i != to
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


def test_round_trip_rejects_records_inside_payloads(spark):
    for least, per_file in ((0, 4), (5, 1000)):
        out = round_trip(frame(spark, ROWS), least, per_file)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
        assert sorted(got, key=repr) == brute(ROWS, least)


def test_empty_table(spark):
    assert round_trip(frame(spark, ROWS).limit(0)).count() == 0


def test_archive_format(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(frame(spark, ROWS), path)
    files = list(pathlib.Path(path).glob("*.gz"))
    text = b"".join(gzip.open(f).read() for f in files)
    assert files and text.count(b"WARC-Record-ID: <urn:page:5>\r\n") == 1
    for f in files:  # every record begins where the one before says
        raw, at = gzip.open(f).read(), 0
        while at < len(raw):
            assert raw.startswith(b"WARC/1.0\r\n", at)
            head_end = raw.index(b"\r\n\r\n", at)
            length = int(raw[at:head_end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
            at = head_end + 4 + length + 4
        assert at == len(raw)
    payloads = {r.page_id: r.payload for r in read_archives(spark, path).collect()}
    assert payloads[5] == ROWS[4][2] and payloads[10] == ROWS[11][2]


def test_pointer_jumping_over_long_chains(spark):
    """A chain with false candidates in between, against a walk."""
    keys, off = [], 0
    for k in range(300):
        size = 10 + k % 7
        keys.append(("f", off, off + 4, off + size))
        keys.append(("f", off + 4, off + size, off + 5 + (off * 7) % 40))  # inside the payload
        off += size
    frame_ = spark.createDataFrame(keys, "file string, off long, seg_end long, succ long")
    walk, at, succ = set(), 0, {k[1]: k[3] for k in keys}
    while at in succ:
        walk.add(at)
        at = succ[at]
    assert {r.off for r in reachable(frame_).collect()} == walk


def test_base32(spark):
    texts = ["", "a", "é" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sha1_base32(F.col("t")).alias("b")).collect()
    assert all(r.b == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in rows)
