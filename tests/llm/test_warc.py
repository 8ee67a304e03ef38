"""Archives against the pages they were made of, at any range size, with junk and lookalikes between members."""

import gzip
import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from faultline.llm.support import new_folder
from faultline.llm.warc import parsed, read_archives, record, record_facts, records_in, write_archives

BIG = "x" * 1500 + "é"


def plain(pages):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[(html or "").encode()].append(page_id)
    out = []
    for payload, ids in groups.items():
        winner = max((i for i in ids if i is not None), default=None)
        for i in ids:
            revisit = len(payload) >= 1000 and len(ids) > 1 and winner is not None and i != winner
            out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", winner if revisit else None))
    return sorted(out, key=str)


PAGES = [(i, f"http://a/{i}", [BIG, "small", None, "", BIG + str(i % 7)][i % 5]) for i in range(200)]
PAGES += [(None, None, BIG), (195, "u", BIG), (None, "http://q/\r\nX-Page-Id: 5", None), (900, "v", "long " * 300_000), (None, "w", "y" * 2000), (None, "w", "y" * 2000)]


@pytest.fixture(scope="module")
def manifest(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    return write_archives(pages, new_folder(spark, "archives"))


@pytest.mark.parametrize("range_bytes", [8 * 2**20, 1000, 61])
def test_ranges_of_any_size_read_every_record_once(manifest, range_bytes):
    got = record_facts(read_archives(manifest, range_bytes)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(PAGES)


def test_revisits_hold_no_payload_and_any_reader_reads_the_members(manifest):
    for row in read_archives(manifest).where("record_type = 'revisit'").collect():
        assert row.payload is None and row.refers_to is not None
    with gzip.open(manifest.first().path) as file:
        assert file.read().startswith(b"WARC/1.1\r\n")


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert record_facts(read_archives(write_archives(pages, new_folder(spark, "archives")))).count() == 0


def test_junk_lookalikes_and_cut_ends_are_skipped(tmp_path):
    members = [record(i, f"u{i}", b"p" * (3000 * i), None) for i in range(4)]
    other = gzip.compress(b"not an archive record")
    data = b"\x1f\x8b\x08 junk \x1f\x8b" + members[0] + other + members[1] + b"\x1f\x8b\x08\x00" + members[2] + members[3][:60]
    (tmp_path / "a.warc.gz").write_bytes(data)
    for size in (5, 64, len(data)):
        with pa.OSFile(str(tmp_path / "a.warc.gz")) as file:
            found = [(at, fields["x-page-id"]) for start in range(0, len(data), size) for at, fields, _ in records_in(file, start, start + size)]
        assert [i for _, i in found] == ["0", "1", "2"]
        assert [at for at, _ in found] == [data.index(m) for m in members[:3]]


def test_a_line_break_in_a_url_makes_no_field():
    fields, block = parsed(gzip.decompress(record(1, "http://q/\r\nX-Other: 5", b"payload", None)))
    assert "x-other" not in fields and block.endswith(b"payload")
