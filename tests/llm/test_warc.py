import base64
import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from addonscope.llm import warc

SCHEMA = "page_id BIGINT, url STRING, html STRING"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.fixture
def stored(spark, tmp_path_factory):
    def store(rows, **options):
        path = str(tmp_path_factory.mktemp("archives") / "a")
        pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
        warc.write(warc.records(pages, **options), path)
        return path

    return store


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    """One (page, bytes, digest, type, refers_to) for each row, by plain loops."""
    first = {}
    for page, _, html in rows:
        key = html or ""
        rank = (page is None, page)
        if len(key.encode()) >= least and (key not in first or rank < first[key]):
            first[key] = rank
    used, out = set(), []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        key = html or ""
        size = len(key.encode())
        if size < least or (key not in used and first[key] == (page is None, page)):
            used.add(key)
            out.append((page, size, digest(html), "response", None))
        else:
            out.append((page, size, digest(html), "revisit", first[key][1]))
    return sorted(out, key=str)


def resolved(spark, path):
    found = warc.resolve(warc.read(spark, path))
    return sorted(
        (tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()),
        key=str,
    )


ROWS = [
    (5, "http://a/1", "one"), (3, "http://a/2", "one"), (9, None, "one"), (3, "http://a/2", "one"), (3, "http://b", "one"),
    (1, "http://a/é x\r\ny", None), (2, "u", ""), (4, "u", "\r\n"), (6, "u", "\r\n\r\n"), (7, "u", "x\r\n\r"),
    (8, "u", FAKE), (10, "u", FAKE), (11, "u", "a\r\n\r\n\r\nb\r\n"), (None, "u", "one"), (None, None, "only"),
    (12, "u", "ü" * 7), (13, "u", "\r\r\n\r\n\n"),
]


def test_equal_payloads_are_kept_once(spark, stored):
    path = stored(ROWS)
    assert resolved(spark, path) == expected(ROWS)
    found = warc.read(spark, path).collect()
    payloads = {(r.page_id, r.payload.decode()) for r in found if r.type == "response"}
    assert payloads == {
        (p, h) for p, n, d, t, _ in expected(ROWS) if t == "response" for h in {r[2] or "" for r in ROWS} if digest(h) == d
    }
    assert all(r.payload is None for r in found if r.type == "revisit")
    assert len({r.record_id for r in found}) == len(ROWS)


def test_small_payloads_stay_responses(spark, stored):
    assert resolved(spark, stored(ROWS, least_bytes=4)) == expected(ROWS, 4)


def test_hot_payload_long_payload_and_random_line_ends(spark, stored):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "hot" if i % 3 == 0 else "".join(rng.choice(["\r", "\n", "W", "x"]) for _ in range(rng.randrange(30)))) for i in range(400)]
    rows += [(1000, "http://long", "0123456789\r\n\r\n" * 250_000), (1001, "http://long", "y" * 4_000_000)]
    assert resolved(spark, stored(rows)) == expected(rows)


def test_archives_are_plain_warc(spark, stored, tmp_path):
    """A reader that knows only the format, not this library, finds every record."""
    import glob

    path = stored(ROWS)
    seen = []
    for name in glob.glob(path + "/*.gz"):
        data, at = gzip.open(name).read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            head = dict(line.split(": ", 1) for line in lines[1:])
            size = int(head["Content-Length"])
            block = data[end + 4 : end + 4 + size]
            assert data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
            at = end + 8 + size
            http, payload = block.split(b"\r\n\r\n", 1)
            seen.append(head)
            if head["WARC-Type"] == "response":
                assert head["WARC-Payload-Digest"] == "sha1:" + digest(payload.decode())
            else:
                assert payload == b"" and head["WARC-Refers-To"] and head["WARC-Profile"] == warc.PROFILE
            assert "\r" not in head["WARC-Target-URI"] and " " not in head["WARC-Target-URI"]
    assert len(seen) == len(ROWS)
    named = {h["WARC-Record-ID"] for h in seen if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in named for h in seen if h["WARC-Type"] == "revisit")


def test_archives_merge_into_deduplicated_ones(spark, stored, tmp_path):
    """Records of two archive sets, revisits included, become one set without repeats."""
    one, two = ROWS[:9], [(20, "http://new", "one"), (21, "v", "fresh"), (0, "w", "\r\n")]
    both = warc.pages_of(warc.read(spark, stored(one))).unionByName(warc.pages_of(warc.read(spark, stored(two))))
    path = str(tmp_path / "merged")
    warc.write(warc.records(both), path)
    assert resolved(spark, path) == expected(one + two)


def test_a_revisit_without_its_response(spark, stored):
    rows = warc.read(spark, stored([(1, "u", "same"), (2, "u", "same")])).where("type = 'revisit'")
    assert [tuple(r) for r in warc.resolve(rows).select("page_id", "refers_to", "payload_bytes", "payload_digest").collect()] == [
        (2, None, None, digest("same"))
    ]


def test_no_pages_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    warc.write(warc.records(none), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame(
        [(1, "u", "x", "d", 7, "n", 2), (2, "u", "x", "d", 7, "n", 2)],
        SCHEMA + ", digest STRING, bytes INT, name STRING, copies INT",
    )
    warc.write(warc.records(rows), str(tmp_path / "more"))
    assert resolved(spark, str(tmp_path / "more")) == expected([(1, "u", "x"), (2, "u", "x")])


def test_a_cut_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, str(tmp_path / "a.txt")).collect()


@given(st.lists(st.text(alphabet="\r\nWa", max_size=12), max_size=6), st.randoms())
def test_reader_follows_lengths(payloads, rng):
    """However a file is split at separators, records come out whole."""
    data = b""
    for i, text in enumerate(payloads):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + text.encode()
        data += b"WARC/1.1\r\nWARC-Type: response\r\nPage-Id: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(block))
        data += block + b"\r\n\r\n"
    pieces = data.split(b"\r\n\r\n")
    if pieces[-1] == b"":
        pieces.pop()
    reader = warc._Reader()
    rows = [row for piece in pieces for row in reader.feed("f", piece)] + list(reader.close())
    assert [row[-1].decode() for row in rows] == payloads


def test_records_are_read_once(spark, tmp_path):
    """Sizes and digests come from one pass over the archives, revisits included."""
    pages = spark.createDataFrame(
        [(1, "u", "a" * 40), (2, "v", "a" * 40), (3, None, None), (4, "w", "b\r\n\r\nc")],
        "page_id bigint, url string, html string",
    )
    warc.write(warc.records(pages), f"{tmp_path}/archives")
    found = warc.resolve(warc.read(spark, f"{tmp_path}/archives"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Scan text" not in plan
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found.collect()} == {
        (1, "response", None, 40), (2, "revisit", 1, 40), (3, "response", None, 0), (4, "response", None, 6),
    }


def test_reader_takes_a_batch_in_parts():
    """Rows of one large batch come in batches of bounded size, and none is lost where parts meet."""
    count = 3 * warc._PIECES + 1
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 5000
    pieces = []
    for i in range(count):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nPage-Id: {i}\r\nContent-Length: {len(block)}"
        pieces += [head.encode(), *block.split(b"\r\n\r\n")]
    part = pa.RecordBatch.from_pydict({"file": ["f"] * len(pieces), "piece": pieces})
    out = list(warc._parse(iter([part])))
    assert [i for b in out for i in b["page_id"].to_pylist()] == list(range(count))
    assert max(b.nbytes for b in out) < 2 << 20
