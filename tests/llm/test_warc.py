import gzip
import hashlib
import random

import pytest

from llm.helpers import rows_of
from simloom.llm import warc
from simloom.llm.shared import new_folder, open_store
from simloom.llm.warc import LoserTree, archived, captured_at, merged_index, parse_record, read_archives, record, url_key, write_archives

SCHEMA = "page_id long, url string, html string, offset string, digest string, first string"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def pages(spark, rows):
    return spark.createDataFrame([(*row, "a", "b", "c") for row in rows], SCHEMA)


def expected(rows):
    out = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        revisit = first is not None and first != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, url))
    return sorted(out, key=lambda row: tuple((v is not None, v) for v in row))


def test_loser_tree_merges_any_number_of_runs():
    rnd = random.Random(1)
    for count in range(0, 12):
        runs = [sorted((rnd.randint(0, 30),) for _ in range(rnd.randint(0, 15))) for _ in range(count)]
        assert list(LoserTree([iter(run) for run in runs])) == sorted(x for run in runs for x in run)


def test_url_keys_sort_by_host_then_path():
    assert url_key("HTTPS://www.Example.com:443/A/b/?q=1#top") == "com,example)/a/b?q=1"
    assert url_key("http://m.example.com:8080") == "com,example,m:8080)/"
    assert [url_key(u) for u in (None, "", "http://[broken")] == [")/", ")/", "http://[broken"]


def test_record_round_trip_and_damage():
    data = record(5, "http://a/ü\r\nX: 1", b"body\r\n\r\nmore", hashlib.sha256(b"body\r\n\r\nmore").hexdigest(), None, False)
    assert parse_record(data)["url"] == "http://a/ü\r\nX: 1" and parse_record(data)["payload_bytes"] == 12
    with pytest.raises(ValueError):
        parse_record(data.replace(b"more", b"mare"))


def test_archives_of_awkward_pages(spark):
    rnd = random.Random(2)
    bodies = ["x" * 99, "y" * 100, "é" * 50, "z" * 5000, "", None, "last\r\n\r\n" * 30]
    rows = [(k, f"http://h{rnd.randint(0, 4)}.org/p{rnd.randint(0, 6)}", rnd.choice(bodies)) for k in range(120)]
    rows += [(None, None, "y" * 100), (None, "u", "only null " * 20), (500, "http://h0.org/", "q" * 200_000), (500, "http://h0.org/", "q" * 200_000)]
    assert rows_of(archived(pages(spark, rows)), *COLUMNS) == expected(rows)
    assert archived(pages(spark, [])).collect() == []


def test_index_is_in_global_order_over_many_runs(spark):
    rnd = random.Random(3)
    rows = [(k, "http://hot.org/" if rnd.random() < 0.4 else f"http://h{rnd.randint(0, 50)}.org/", f"page {k} " * 20) for k in range(400)]
    folder = new_folder(spark, "warc-test")
    runs = write_archives(pages(spark, rows).repartition(4), folder, file_records=30)
    assert runs.select("file").distinct().count() > 12
    for file, places in {r.file: None for r in runs.collect()}.items():
        run = [(r.url_key, r.captured) for r in sorted(runs.where(runs.file == file).collect(), key=lambda r: r.place)][:1000]
        assert run == sorted(run) and places is None
        break
    index = merged_index(runs)
    found = sorted(index.collect(), key=lambda r: (r.part, r.position))
    order = [(r.url_key, r.captured, r.page_id) for r in found]
    assert order == sorted((url_key(u), captured_at(k), k) for k, u, _ in rows)
    assert read_archives(index, folder).count() == 400


def test_files_are_plain_gzip_members(spark):
    folder = new_folder(spark, "warc-test")
    runs = write_archives(pages(spark, [(1, "http://a/", "b" * 300), (2, "http://a/", "b" * 300)]).coalesce(1), folder).collect()
    store, root = open_store(folder)
    with store.open_input_file(f"{root}/{runs[0].file}") as opened:
        text = gzip.decompress(opened.read()).decode()
    assert text.count("WARC/1.1\r\n") == len({r.offset for r in runs if r.file == runs[0].file})
    assert warc.LEAST_BYTES == 100
