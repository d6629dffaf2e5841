"""Secret scan: base patterns, then confirmation of structure.

Base kinds are leftmost, non-overlapping matches per kind.  The structural kinds
decode what looks like base64 or hex and report it only if the bytes parse: a
DER structure whose nested lengths add up and that opens like a private, public
or certificate key (``der``), a length-prefixed public key (``sshkey``), an
armoured block with such content (``pem``), and a signed token with a JSON header
that names its algorithm and a payload that is JSON (``signed``).

Every run of base64 or hex is looked at, lines of a wrapped run joined.  A key may
begin anywhere in it: its own lengths say where it ends.  The bytes are scanned as
text in turn, ``DEEPEST_TEXT`` times at most; what is found in them is reported
under its kind at the encoded characters.

Edge cases: a null or empty text has no spans and the digest of an empty string;
a null ``doc_id`` stays null; repeated rows give repeated results; an empty table
gives no rows; other columns are ignored; texts are used whole, in code points.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_ids import tidied

Span = tuple[str, int, int]

#: Fixed patterns of the base kinds; after them the group that must be long enough, and how long.
BASE = (
    ("assign", re.compile(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: The order of kinds at one start.
KINDS = ("assign", "access", "hex", "pem", "sshkey", "signed", "der")

#: Between the lines of a wrapped run: a line's end, also written as an escape, with what quotes or indents the lines.
_WRAP = r"(?:[\"'][\x20\t,+\\]*|[\x20\t]*\\?)(?:\r?\n|\\r\\n|\\n)[\x20\t>|#*\"']*"
_BREAK = re.compile(_WRAP)
_HEX = re.compile(rf"(?<![0-9a-fA-F])[0-9a-fA-F]{{32,}}(?:{_WRAP}[0-9a-fA-F]+)*")
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{_WRAP}[A-Za-z0-9+/_-]+)*={{0,2}}")
#: Looked for from every run on, as a token may follow a name and a dot.
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*))")
#: Where a JSON object may begin: a brace and a quote or white space.
_OBJECT = re.compile(r"e[wy]")
#: How the bytes begin that can be a key: a sequence's tag, a name's length or the private container.  None else parses.
_KEY_BASE64 = re.compile(r"M[A-P]|AAAA|b3Bl")
_KEY_HEX = re.compile(r"30|000000|6f70656e", re.I)
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(.*?)-----END \1-----", re.S)
_SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
_SSH_MAGIC = b"openssh-key-v1\x00"
#: Fields of the public keys.
_SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2}
DEEPEST = 12
DEEPEST_TEXT = 2


def decoded(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not; None if it is none."""
    plain = text.replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(raw: bytes, depth: int = 0) -> list[tuple[int, int, bytes]] | None:
    """The items of a DER value list as depth, tag and content; None if a length does not fit."""
    items, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw) or depth > DEEPEST:
            return None
        tag, size, head = raw[at], raw[at + 1], 2
        if size >= 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + 2 + count > len(raw):
                return None
            size = int.from_bytes(raw[at + 2:at + 2 + count], "big")
            head += count
            if size < 0x80:
                return None  # a short length must be written short
        body = raw[at + head:at + head + size]
        if len(body) < size:
            return None
        items.append((depth, tag, body))
        if tag & 0x20:
            inner = der_items(body, depth + 1)
            if inner is None:
                return None
            items += inner
        at += head + size
    return items


def is_key(raw: bytes | None) -> bool:
    """One DER sequence that opens like a key: a version number or a named algorithm, with a large value inside."""
    if not raw or len(raw) < 16 or raw[0] != 0x30:
        return False
    items = der_items(raw)
    if not items or sum(depth == 0 for depth, _, _ in items) != 1:
        return False
    opens = items[1][1] if len(items) > 1 else 0
    named = any(tag == 0x06 and len(body) >= 3 for _, tag, body in items[:6])
    numbers = sum(tag == 0x02 for _, tag, _ in items)
    large = any(tag in (0x02, 0x03, 0x04) and len(body) >= 16 for _, tag, body in items)
    return large and (named or (opens == 0x02 and numbers >= 2))


def is_ssh(raw: bytes | None) -> bool:
    """A known name and further fields whose length prefixes use up the bytes, or the private-key container."""
    if not raw:
        return False
    if raw.startswith(_SSH_MAGIC):
        size = int.from_bytes(raw[len(_SSH_MAGIC):len(_SSH_MAGIC) + 4], "big")
        return 0 < size < 64
    fields, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at:at + 4], "big")
        if at + 4 + size > len(raw):
            return False
        fields.append(raw[at + 4:at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and fields[0] in _SSH_NAMES


def is_signed_token(text: str) -> bool:
    header, payload, _ = text.split(".")
    try:
        head, body = json.loads(decoded(header) or b""), json.loads(decoded(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[Span]:
    return [(kind, hit.start(), hit.end()) for kind, pattern, group, least in BASE for hit in pattern.finditer(text)
            if hit.end(group) - hit.start(group) >= least]


def der_size(head: bytes) -> int:
    """Bytes of the DER value that begins with ``head``, by its first length; 0 if there is none."""
    if len(head) < 2:
        return 0
    if head[1] < 0x80:
        return 2 + head[1]
    count = head[1] & 0x7F
    return 2 + count + int.from_bytes(head[2:2 + count], "big") if 1 <= count <= 4 and len(head) >= 2 + count else 0


def ssh_size(raw: bytes) -> int:
    """Bytes of the key that ``raw`` begins with, by its fields' lengths; 0 if there is none."""
    private = raw.startswith(_SSH_MAGIC)
    at, number, wanted = len(_SSH_MAGIC) if private else 0, 0, 5 if private else 2
    while number < wanted:
        size = int.from_bytes(raw[at:at + 4], "big")
        if at + 4 > len(raw):
            return 0
        if private and number == 3:
            # How many keys: a public one of each and one private part.
            if not 1 <= size <= 64:
                return 0
            at, wanted = at + 4, 4 + size + 1
        else:
            if at + 4 + size > len(raw):
                return 0
            if not private and number == 0:
                name = raw[4:4 + size]
                if name not in _SSH_NAMES:
                    return 0
                wanted = _SSH_FIELDS.get(name, 3)
            at += 4 + size
        number += 1
    return at


def _joined_lines(run: str, start: int) -> tuple[str, list[int], list[int]]:
    """A wrapped run without what stands between its lines; where each line begins in it and in the text."""
    parts, starts, origins, size, at = [], [], [], 0, 0
    for low, high in [*(found.span() for found in _BREAK.finditer(run)), (len(run), len(run))]:
        parts.append(run[at:low])
        starts.append(size)
        origins.append(start + at)
        size += low - at
        at = high
    return "".join(parts), starts, origins


def _keys_in(run: str, hexed: bool) -> Iterator[Span]:
    """Keys in a joined run: kind, first and last place."""
    def raw_at(start: int, size: int) -> bytes:
        """Up to ``size`` bytes from a place of the run on."""
        if hexed:
            return bytes.fromhex(run[start:start + min(2 * size, (len(run) - start) // 2 * 2)])
        part = run[start:start + -(-4 * size // 3)]
        return decoded(part[:-1] if len(part) % 4 == 1 else part) or b""

    def end_of(start: int, size: int) -> int:
        return start + (2 * size if hexed else -(-4 * size // 3))

    at, pattern = 0, _KEY_HEX if hexed else _KEY_BASE64
    while hit := pattern.search(run, at):
        start, at = hit.start(), hit.start() + 1
        head = raw_at(start, 24)
        if head[:1] == b"\x30":
            size, kind = der_size(head), "der"
            if size < 16 or end_of(start, size) > len(run) or not is_key(raw_at(start, size)[:size]):
                continue
        elif head.startswith(_SSH_MAGIC) or head[4:4 + int.from_bytes(head[:4], "big")] in _SSH_NAMES:
            raw, kind = raw_at(start, len(run)), "sshkey"
            size = len(raw) if is_ssh(raw) and not raw.startswith(_SSH_MAGIC) else ssh_size(raw)
            if not size:
                continue
        else:
            continue
        at = end_of(start, size)
        yield kind, start, at


def _spans_under(run: str, hexed: bool, depth: int) -> Iterator[Span]:
    """What is found in the bytes of a joined run, read as text from each place a group may begin at."""
    for start in range(2 if hexed else 4):
        if hexed:
            raw = bytes.fromhex(run[start:len(run) - (len(run) - start) % 2])
        else:
            part = run[start:]
            raw = decoded(part[:-1] if len(part) % 4 == 1 else part) or b""
        # One character a byte.
        for kind, low, high in structural_spans(raw.decode("latin-1"), depth + 1):
            # With the line's end behind a block.
            while raw[high:high + 1].isspace():
                high += 1
            yield kind, start + (2 * low if hexed else 4 * low // 3), start + (2 * high if hexed else -(-4 * high // 3))


def structural_spans(text: str, depth: int = 0) -> list[Span]:
    """Candidates whose decoded bytes parse; content of a reported block is not reported again."""
    spans: list[Span] = []
    if "-----BEGIN " in text:
        for hit in _ARMOUR.finditer(text):
            lines = [line.strip() for line in hit[2].replace("\\n", "\n").split("\n")]
            raw = decoded("".join(line for line in lines if ":" not in line))
            encrypted = any(line.startswith("Proc-Type:") for line in lines)
            if is_key(raw) or is_ssh(raw) or (encrypted and raw):
                spans.append(("pem", hit.start(), hit.end()))
    covered = [span[1:] for span in spans]
    inside = lambda low, high: any(a <= low and high <= b for a, b in covered)
    for hit in _SIGNED.finditer(text):
        header = hit[1].index(".")
        for begin in _OBJECT.finditer(hit[1], 0, header):
            if is_signed_token(hit[1][begin.start():]):
                spans.append(("signed", hit.start() + begin.start(), hit.end(1)))
                covered.append(spans[-1][1:])
                break
    for pattern, hexed in ((_BASE64, False), (_HEX, True)):
        for hit in pattern.finditer(text):
            if inside(hit.start(), hit.end()):
                continue
            run, starts, origins = _joined_lines(hit[0].rstrip("="), hit.start())
            found = list(_keys_in(run, hexed))
            if depth < DEEPEST_TEXT:
                found += _spans_under(run, hexed, depth)
            for kind, low, high in found:
                low, high = [origins[line] + at - starts[line] for at, line in
                             ((at, bisect.bisect_right(starts, at) - 1) for at in (low, high - 1))]
                high += 1
                while not hexed and text[high:high + 1] == "=" and high < hit.end():
                    high += 1
                if not inside(low, high):
                    spans.append((kind, low, high))
                    covered.append((low, high))
    return spans


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in
                    sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by ``[secret]``."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda span: span[1:]):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        parts += [text[at:start], "[secret]"]
        at = end
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """The spans of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                texts = [text or "" for text in rows.column("text").to_pylist()]
                base = [base_spans(text) for text in texts]
                every = [spans + structural_spans(text) for spans, text in zip(base, texts)]
                columns = {"doc_id": rows.column("doc_id")}
                for kind, *_ in BASE:
                    columns[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64())
                columns["base_sha256"] = pa.array(
                    [hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base], pa.string())
                columns["spans"] = pa.array([_joined(spans) for spans in every], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        tidied(run), schema)


def without_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of their text replaced; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                texts = [text if text is None else redacted(text, base_spans(text) + structural_spans(text))
                         for text in rows.column("text").to_pylist()]
                yield rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))

    return docs.mapInArrow(tidied(run), docs.schema)
