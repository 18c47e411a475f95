import base64
import hashlib
import io
import random
import struct
import zipfile

import pyarrow as pa
import pytest

from octetloom.llm import warc

PAGES = "page_id long, url string, html string, first long, path string"


def reader(raw):
    return (lambda at, n: raw[at : at + n]), len(raw)


@pytest.mark.parametrize("comment,prefix,wide", [(b"", b"", False), (b"PK\x05\x06" + b"x" * 30, b"", False), (b"c", b"junk" * 9, True), (b"", b"", True)])
def test_directory_finds_stored_members(comment, prefix, wide):
    out = io.BytesIO()
    out.write(prefix)
    names = {f"m{i}/é": bytes([i % 251]) * i for i in range(70_000 if wide else 40)}
    with zipfile.ZipFile(out, "a" if prefix else "w", zipfile.ZIP_STORED) as z:
        for n, v in names.items():
            with z.open(n, "w", force_zip64=len(v) % 2 == 0) as f:
                f.write(v[:50])
        z.comment = comment
    read, size = reader(out.getvalue())
    members = warc.directory(read, size)
    assert [m.name for m in members] == list(names)
    for m in random.Random(1).sample(members, 20):
        assert read(*warc.stored_span(read, m)) == names[m.name][:50]


def test_zip64_sizes_and_offsets_are_read():
    name = b"archive/data.warc.gz"
    wide = struct.pack("<HHQQQ", 1, 24, 7 << 32, 6 << 32, 5 << 32)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    raw = entry + end64 + b"PK\x06\x07" + struct.pack("<IQI", 0, len(entry), 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc.directory(*reader(raw)) == [warc.Member(name.decode(), 0, 6 << 32, 5 << 32)]


def test_bad_packages_are_errors():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 1000)
    read, size = reader(out.getvalue())
    with pytest.raises(warc.BadArchive):
        warc.stored_span(read, warc.directory(read, size)[0])
    for raw in (b"", b"PK\x05\x06", out.getvalue()[:-30]):
        with pytest.raises(warc.BadArchive):
            warc.directory(*reader(raw))
    with pytest.raises(warc.BadArchive):
        warc.parse(warc.record(1, None, b"abc", None).replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 300)
    rng = random.Random(7)
    texts = [None, "", "é" * 50, "x\r\n\r\ny", "z" * 10_000] + [str(i) * 30 for i in range(8)]
    rows = [(i * 37 % 101, rng.choice([None, "http://a/?q=%0A\n\r", "http://b"]), rng.choice(texts), None, None) for i in range(101)] + [(None, "u", "", None, None), (500, "u", "twin", None, None), (500, "u", "twin", None, None), (501, "u", "twin", None, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    packages = warc.write_packages(pages, warc.shared_folder(spark))
    assert sum(r.records for r in packages.collect()) == len(rows)
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.read_packages(packages).collect()), key=str)
    first = {}
    for i, _, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, u, t, *_ in rows:
        raw = (t or "").encode()
        response = i is None or first[t or ""] == i
        want.append((i, u, "response" if response else "revisit", None if response else first[t or ""], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), raw if response else None))
    assert got == sorted(want, key=str)


def test_small_payloads_stay_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "u", "ab", None, None), (2, "u", "ab", None, None), (3, "u", "abc", None, None), (4, "u", "abc", None, None)], PAGES)
    got = warc.read_packages(warc.write_packages(pages, warc.shared_folder(spark), least_bytes=3)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]
    assert warc.read_packages(warc.write_packages(pages.where("false"), warc.shared_folder(spark))).count() == 0


def test_a_task_that_runs_twice_replaces_nothing(tmp_path):
    folder = f"file://{tmp_path}/packages"
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["u", None]), pa.array(["<p>x", ""]), pa.array([None, 1], pa.int64())], ["page_id", "url", "html", "first"])
    one, two = (warc.write_package(iter([rows]), folder, 3) for _ in range(2))
    assert one[0] != two[0] and one[1] == two[1] == 2
    assert list(warc.records(one[0])) == list(warc.records(two[0]))
    assert warc.write_package(iter([]), folder, 4) is None and len(list((tmp_path / "packages").iterdir())) == 2
