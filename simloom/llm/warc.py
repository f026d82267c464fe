"""Web archives with revisit records and a globally ordered capture index by external merge.

Each task writes archive files of independent gzip members, one per record, and for each file a run: its captures sorted by URL key and time. The
runs are then merged: a range partitioning gives every merging task the slice of each run that falls in its range of keys, and a loser tree over the heads of
the slices yields them in order, so that the parts one after the other hold all captures of a URL together, by time.

The first record of a payload (smallest page id) is a response, later ones are revisits that refer to it, if the payload has ``LEAST_BYTES``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import map_rows, materialized, new_folder, open_store
from simloom.plans.runtime import computed_once

LEAST_BYTES = 100
FILE_BYTES = 128 << 20
FILE_RECORDS = 50_000
RANGE_CAPTURES = 200_000
READERS = 10_000
CAPTURE = "url_key string, captured string, page_id long, file string, place long, offset long, size long"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured string, "
    "file string, offset long, part int, position long"
)
# Pages carry no time of capture: ids count seconds from here.
FIRST_CAPTURE = datetime(2020, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Sortable key: host labels from the top level down, then port, path and query, in lower case; no scheme, fragment or leading ``www``."""
    text = (url or "").strip().lower()
    try:
        parts = urlsplit(text if "//" in text else f"//{text}")
        host, port = parts.hostname or "", f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return text
    labels = host.split(".")
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(labels))}{port}){parts.path.rstrip('/') or '/'}{query}"


def captured_at(page_id: int | None) -> str:
    """Time of capture as 14 digits."""
    seconds = (page_id or 0) % (1 << 31)
    return (FIRST_CAPTURE + timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")


def record_id(page_id: int | None) -> str:
    return f"<urn:simloom:page:{'' if page_id is None else page_id}>"


def _page_of(identifier: str) -> int | None:
    number = identifier.rsplit(":", 1)[1].rstrip(">")
    return int(number) if number else None


def _line(value: str | None) -> str:
    """A header value on one line; anything that would break it is percent-encoded."""
    return "".join(c if c > " " and c != "%" and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def _unline(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record. A revisit keeps the HTTP head, whose length is that of the full payload, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    when = datetime.strptime(captured_at(page_id), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {when}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *(
            ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}"]
            if revisit
            else []
        ),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; the payload of a response is hashed again and must have the digest and length it states."""
    import hashlib

    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page_of(fields["WARC-Refers-To"]) if revisit else None,
        "url": None if url is None else _unline(url),
    }


class LoserTree:
    """k-way merge of sorted sequences: inner nodes keep the loser of their match, so a step replays one path of log k matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a comes before run b; runs that are used up, or not there, lose, and ties go to the earlier run."""
        head = lambda k: self.heads[k] if 0 <= k < len(self.heads) else None
        x, y = head(a), head(b)
        return x is not None and (y is None or (x, a) < (y, b))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, loser = (a, b) if self._beats(a, b) or not self._beats(b, a) else (b, a)
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator[tuple]:
        while self.winner < len(self.heads) and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            winner = self.winner
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.size) // 2
            while node:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.winner = winner


def _with_first(pages: DataFrame) -> DataFrame:
    """Pages with the digest of their payload and the smallest page id that has it (none for short payloads)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = computed_once(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), "page_id", "url", "html", digest=F.sha2(payload, 256))
    # Written, so that the join is a plain one and a payload with very many pages can be split.
    firsts = materialized(
        keyed.where(F.octet_length(payload) >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    return keyed.join(firsts, "digest", "left")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """Write all pages; the result is the sorted run of every file, and names the files that count.

    Tasks write under names of their own: a task that runs twice leaves files that no run names. Null html is an empty payload. Of rows that repeat the smallest id of a payload
    each is a response; a null id is larger than any other.
    """

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        part, seq, out = TaskContext.get().partitionId(), 0, None

        def run() -> dict:
            out.close()
            columns = list(zip(*sorted(captures)))
            return dict(zip(("url_key", "captured", "page_id", "offset", "size"), columns)) | {
                "page_id": [None if no_id else page for no_id, page in columns[2]],
                "file": [name] * len(captures),
                "place": range(len(captures)),
            }

        for rows in slices:
            for digest, page_id, url, html, first in rows:
                if out is None:
                    name, captures, offset = f"pages-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.warc.gz", [], 0
                    out, seq = store.open_output_stream(f"{root}/{name}", compression=None), seq + 1
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                payload = (html or "").encode("utf-8", "surrogatepass")
                data = packer.compress(record(page_id, url, payload, digest, first, first is not None and first != page_id)) + packer.flush()
                out.write(data)
                captures.append((url_key(url), captured_at(page_id), (page_id is None, page_id or 0), offset, len(data)))
                offset += len(data)
                if offset >= file_bytes or len(captures) >= file_records:
                    yield run()
                    out = None
        if out is not None:
            yield run()

    ordered = _with_first(pages).select("digest", "page_id", "url", "html", "first")
    return materialized(map_rows(ordered, work, CAPTURE))


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures in the order of URL key, time and page id, with ``part`` and ``position``: parts follow each other and positions count within a part.

    Captures of one URL, however many, spread over parts by their time. A merging task holds its range of the index only, and there are so many ranges that one
    has about ``RANGE_CAPTURES`` captures, however long the index is.
    """
    keys = ["url_key", "captured", "page_id"]
    shuffles = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(shuffles, -(-runs.count() // RANGE_CAPTURES))
    ranges = runs.repartitionByRange(count, *keys).sortWithinPartitions("file", "place")

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        slices_of_runs: dict[str, list[tuple]] = {}
        for rows in slices:
            for key, captured, page_id, file, place, offset, size in rows:
                head = (key, captured, page_id is not None, page_id or 0, file, place)
                slices_of_runs.setdefault(file, []).append((head, (key, captured, page_id, file, place, offset, size)))
        part, names = TaskContext.get().partitionId(), [x.split()[0] for x in CAPTURE.split(", ")]
        chunk, position = [], 0
        for _, capture in LoserTree([iter(run) for run in slices_of_runs.values()]):
            chunk.append((*capture, part, position))
            position += 1
            if len(chunk) == 10_000:
                yield dict(zip((*names, "part", "position"), zip(*chunk)))
                chunk = []
        if chunk:
            yield dict(zip((*names, "part", "position"), zip(*chunk)))

    return materialized(map_rows(ranges, work, CAPTURE + ", part int, position long"))


def _readers(index: DataFrame) -> int:
    """Tasks that read archives: about one per file, at most ``READERS``."""
    return min(max(index.select("file").distinct().count(), 1), READERS)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record that the index names, read from its file at its place."""
    spread = index.select("file", "offset", "size", "url_key", "captured", "part", "position").repartition(_readers(index), "file").sortWithinPartitions("file", "offset")

    def work(slices: Iterator[list[tuple]]) -> Iterable[dict]:
        store, root = open_store(folder)
        name, opened = None, None
        for rows in slices:
            found = []
            for file, offset, size, key, captured, part, position in rows:
                if file != name:
                    if opened is not None:
                        opened.close()
                    name, opened = file, store.open_input_file(f"{root}/{file}")
                opened.seek(offset)
                fields = parse_record(zlib.decompress(opened.read(size), 31))
                found.append(fields | {"url_key": key, "captured": captured, "file": file, "offset": offset, "part": part, "position": position})
            yield {column: [row[column] for row in found] for column in (x.split()[0] for x in RECORDS.split(", "))}
        if opened is not None:
            opened.close()

    return map_rows(spread, work, RECORDS)


def archived(pages: DataFrame) -> DataFrame:
    """Write a table of pages to archives in the shared folder, merge their runs and read all records back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(merged_index(write_archives(pages, folder)), folder)
