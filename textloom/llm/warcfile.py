"""WARC records: writing them, finding candidates in a byte range, and reading them from a known start."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"
#: Bytes that are read at once while a header is looked for.
STEP = 1 << 16

_field = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+:")
_unsafe = re.compile(r"[\x00-\x20\x7f]")


def record_id(run: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{row}')}>"


def record(kind: str, ident: str, date: str, fields: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), *fields, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + BREAK


def page_record(run: str, date: str, row: int, key: str | None, url: str | None, payload: bytes, sha1: str, refers: int | None) -> bytes:
    """A response with its payload, or a revisit of the record of another row, with the length of its payload only."""
    fields = []
    if url is not None:
        fields.append(("WARC-Target-URI", _unsafe.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if key is not None:
        fields.append(("WARC-Page-ID", quote(key)))
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1}"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, block = "response", http + payload
    if refers is not None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(run, refers))]
        kind, block = "revisit", http
    return record(kind, record_id(run, row), date, fields, "application/http; msgtype=response", block)


class Window:
    """Bytes of a file from a start on, read as far as they are asked for."""

    def __init__(self, stream, start: int, size: int):
        self.file, self.start, self.size = stream, start, size
        self.data = bytearray()
        stream.seek(start)

    def upto(self, end: int) -> None:
        """Hold the bytes before the file offset end, if the file has them."""
        missing = min(end, self.size) - self.start - len(self.data)
        if missing > 0:
            self.data += self.file.read(missing)

    def find(self, what: bytes, at: int) -> int:
        """The file offset of what from at on, or -1."""
        searched = at
        while True:
            found = self.data.find(what, searched - self.start)
            if found >= 0:
                return found + self.start
            held = self.start + len(self.data)
            if held >= self.size:
                return -1
            searched = max(at, held - len(what) + 1)
            self.upto(held + STEP)

    def part(self, at: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.data[at - self.start : end - self.start])


def successors(stream, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, offset of the record behind it) of every place in [start, end) that looks like a record: magic, header
    fields, a content length that stays in the file. Payloads can hold such places too.

    Header ends are remembered by line, so that places that share lines cost no more than one.
    """
    window = Window(stream, start, size)
    window.upto(end + len(MAGIC) - 1)
    known: dict[int, tuple[int, int | None] | None] = {}  # by line: header end and first content length from it on
    at = window.find(MAGIC, start)
    while 0 <= at < end:
        line, lines = at + len(MAGIC), []
        while line not in known:
            stop = window.find(b"\r\n", line)
            if stop == line:
                known[line] = (line + 2, None)
            elif stop < 0 or not _field.match(text := window.part(line, stop)):
                known[line] = None
            else:
                name, _, value = text.partition(b":")
                value = value.strip()
                lines.append((line, int(value) if name.lower() == b"content-length" and value.isdigit() and len(value) < 19 else None))
                line = stop + 2
        found = known[line]
        for line, length in reversed(lines):
            if found is not None and length is not None:
                found = (found[0], length)
            known[line] = found
        if found is not None and found[1] is not None and (after := found[0] + found[1] + len(BREAK)) <= size:
            yield at, after
        at = window.find(MAGIC, at + 1) if at + 1 < end else -1


def records(stream, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of the records from start, which is one, to the first at end or later."""
    while start < min(end, size):
        window = Window(stream, start, size)
        stop = window.find(BREAK, start)
        head = window.part(start, stop)
        if not head.startswith(MAGIC):
            raise ValueError(f"no record at {start}")
        fields = {}
        for text in head[len(MAGIC) :].decode().split("\r\n"):
            name, _, value = text.partition(":")
            fields[name.lower()] = value.strip()
        first = stop + len(BREAK)
        last = first + int(fields["content-length"])
        block = window.part(first, last + len(BREAK))
        if not block.endswith(BREAK):
            raise ValueError(f"no end of the record at {start}")
        yield fields, block[: -len(BREAK)]
        start = last + len(BREAK)


def page_of(fields: dict[str, str], block: bytes) -> dict:
    """What page_record was given, read back. A digest that is not that of the payload is an error."""
    http, _, payload = block.partition(BREAK)
    sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != sha1:
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    n_bytes = len(payload) if fields["warc-type"] == "response" else int(re.search(rb"(?mi)^content-length: (\d+)\r?$", http)[1])
    key = fields.get("warc-page-id")
    return {
        "key": None if key is None else unquote(key),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": n_bytes,
        "payload_digest": sha1,
        "record_type": fields["warc-type"],
        "record_id": fields["warc-record-id"],
        "refers_id": fields.get("warc-refers-to"),
        "payload": payload,
    }
