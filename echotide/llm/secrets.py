"""Secret scans with structural confirmation.

Base kinds are found by pattern. Base64 and hex candidates of any length are decoded,
and only reported where what they hold has the structure of a secret:

* jwt: a signed token, whose header and payload are JSON objects and whose header names an algorithm;
* pem: an armoured key, whose body decodes to a key encoding, or to one that is encrypted by a stated cipher;
* b64key, hexkey: DER of a key (PKCS#1, DSA, PKCS#8, SEC 1, encrypted PKCS#8) whose nested lengths
  fill their frames exactly, or the binary form of an OpenSSH key.

A key may begin inside a run of letters, as after a path or a name, and run over line breaks,
also escaped ones, each with the next line's indent; it ends where its outer frame says, and a letter or digit there means
that it is none.

Spans are in code points, end exclusive. Cases: null counts as empty, an empty text has
no spans; texts are scanned whole, whatever their length; rows with null or repeated
doc_id are kept; an empty table gives an empty result; other columns are ignored. Work is in proportion to a text's
length whatever it holds: nested, broken and repeated candidates included.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, batch, table, text_of

KINDS = ("assign", "access", "hex", "pem", "jwt", "b64key", "hexkey")
#: Patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # runs are maximal, so shorter ones need no match to be dropped
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: Candidates of the structural kinds.
PEM_START = re.compile("-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Starts of a DER sequence, letters of an encoding, and what may stand between them: line breaks, and the backslashes of escaped ones and of "\/".
B64_START, B64_LETTERS = re.compile("M(?=[A-I][A-Za-z0-9+/_-]{14})"), re.compile("[A-Za-z0-9+/_-]{1,1024}")
HEX_START, HEX_LETTERS = re.compile("30(?=[0-9A-Fa-f]{14})"), re.compile("[0-9A-Fa-f]{1,1024}")
BETWEEN = re.compile(r"(?:\\+(?:[rn]|(?=/))|[\r\n])+[ \t]*")
OPENSSH = b"openssh-key-v1\0"
OPENSSH_B64, OPENSSH_HEX = re.compile("b3BlbnNzaC1rZXktdjE"), re.compile("(?i)" + OPENSSH.hex())


def decode_base64(text: str) -> bytes | None:
    """Bytes of base64 or base64url, padded or not; None where it is neither."""
    body = text.rstrip("=").translate({45: "+", 95: "/"})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: Most elements that the frame of a key or of an algorithm may hold, by their standards.
MOST_ELEMENTS = 10


def der_items(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start and end of the content) of the DER elements that fill [at, end) exactly; None where lengths don't fit, or there are more than any key has."""
    out, end = [], len(data) if end is None else end
    while at < end:
        if at + 2 > end or len(out) == MOST_ELEMENTS:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > end:
                return None
            n = int.from_bytes(data[at : at + size], "big")
            at += size
            if n < 0x80 or n >> 8 * (size - 1) == 0:
                return None  # DER wants the shortest form
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def _algorithm(data: bytes, at: int, end: int) -> list[int]:
    """Tags of an algorithm's identifier: an object's, and that of what goes with it."""
    items = der_items(data, at, end)
    return [t for t, _, _ in items] if items and items[0][0] == 0x06 else []


def key_kind(data: bytes, at: int = 0, end: int | None = None) -> str | None:
    """The key encoding that the bytes of [at, end) are, by its nested structure."""
    end = len(data) if end is None else end
    if data.startswith(OPENSSH, at, end):
        n = int.from_bytes(data[at + 15 : min(at + 19, end)], "big")
        return "openssh" if 0 < n <= 64 and end - at > 19 + n else None
    outer = der_items(data, at, end)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return None
    return frame_kind(data, *outer[0][1:])


def frame_kind(data: bytes, at: int, end: int) -> str | None:
    """The key encoding whose outer frame holds [at, end)."""
    inner = der_items(data, at, end)
    if not inner:
        return None
    tags, first = [t for t, _, _ in inner], data[inner[0][1] : min(inner[0][2], inner[0][1] + 2)]
    if tags[:9] == [0x02] * 9:
        return "pkcs1"
    if tags == [0x02] * 6 and first == b"\0":
        return "dsa"
    if tags[:3] == [0x02, 0x30, 0x04]:
        return "pkcs8" if _algorithm(data, *inner[1][1:]) else None
    if tags[:2] == [0x02, 0x04] and first == b"\x01" and inner[1][2] - inner[1][1] >= 16:
        return "sec1"
    if tags == [0x30, 0x04]:
        return "pkcs8-encrypted" if _algorithm(data, *inner[0][1:]) == [0x06, 0x30] else None
    return None


#: One token of JSON: a mark (brackets may be many), a string, or another value.
JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:(\[+|\]+|[{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity))')


def deep_object(text: str) -> dict | None:
    """The names of a JSON object, with their values where these are strings (others: None); None where the text is no object. Takes any depth of nesting."""
    at, stack, out, name, want = 0, bytearray(), {}, None, "value"
    while m := JSON_TOKEN.match(text, at):
        at, (mark, string, _) = m.end(), m.groups()
        top = len(stack) == 1
        if not mark:
            if string and want in ("name", "name or end"):
                if top:
                    name = json.loads(string)
                    out[name] = None
                want = "colon"
                continue
            if not stack or want not in ("value", "value or end"):
                return None
            if top:
                out[name] = json.loads(string) if string else None
            want = "next"
        elif mark[0] in "[{":
            if want not in ("value", "value or end") or not stack and mark[0] == "[":
                return None
            stack += mark.encode()
            want = "value or end" if mark[0] == "[" else "name or end"
        elif mark[0] in "]}":
            opened = (b"[" if mark[0] == "]" else b"{") * len(mark)
            if want not in ("value or end" if mark[0] == "]" else "name or end", "next") or not stack.endswith(opened):
                return None
            del stack[len(stack) - len(mark) :]
            if not stack:
                return out if not text[at:].strip(" \t\n\r") else None
            want = "next"
        elif mark == "," and want == "next":
            want = "value" if stack.endswith(b"[") else "name"
        elif mark == ":" and want == "colon":
            want = "value"
        else:
            return None
    return None


def _object(letters: str) -> dict | None:
    """The JSON object that a part of a token holds."""
    data = decode_base64(letters) or b""
    try:
        found = json.loads(data)
        return found if isinstance(found, dict) else None
    except ValueError:
        return None
    except RecursionError:
        return deep_object(data.decode(json.detect_encoding(data), "surrogatepass"))


def _is_jwt(header: str, payload: str) -> bool:
    first = _object(header)
    return first is not None and isinstance(first.get("alg"), str) and _object(payload) is not None


def _is_pem(body: str) -> bool:
    body = re.sub(r"\\+r", "", body.replace("\r\n", "\n"))
    body = re.sub(r"\\+(?=/)", "", re.sub(r"\\+n", "\n", body))
    if "ENCRYPTED" in body and "DEK-Info:" in body:
        parts = re.split(r"\n[ \t]*\n", body, maxsplit=1)
        return len(parts) == 2 and bool(decode_base64("".join(parts[1].split())))
    data = decode_base64("".join(body.split()))
    return bool(data) and key_kind(data) is not None


def _pems(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the armoured keys; each ends before the next begins, so a text is read once."""
    starts = list(PEM_START.finditer(text))
    for m, stop in zip(starts, [*(n.start() for n in starts[1:]), len(text)]):
        last = f"-----END {m[1]}-----"
        end = text.find(last, m.end(), stop)
        if end >= 0 and _is_pem(text[m.end() : end]):
            yield m.start(), end + len(last)


def openssh_length(data: bytes) -> int | None:
    """Bytes of the OpenSSH key that begins here, by its fields; None where they don't fit."""
    at, left, counted = len(OPENSSH), 3, False
    while left:
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        if not left and not counted:
            # Cipher and derivation come before the number of public keys; the private part comes after these.
            left, counted, at = int.from_bytes(data[at : at + 4], "big") + 1, True, at + 4
        if at > len(data):
            return None
    return at


def _letters(text: str, at: int, letters: re.Pattern, count: int, stop: int | None = None) -> tuple[str, int]:
    """Up to count letters from here on, but not beyond stop, without what stands between them, and where they end."""
    out, have, end = [], 0, at
    stop = len(text) if stop is None else stop
    while have < count:
        if m := letters.match(text, at, stop):
            out.append(m[0][: count - have])
            have += len(out[-1])
            at = end = at + len(out[-1])
        elif m := BETWEEN.match(text, at, stop):
            at = m.end()
        else:
            break
    return "".join(out), end


def _from_hex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) & ~1])


class _Run:
    """A maximal run of letters from a place on, without what stands between them. Each of its letters is decoded once for each way that groups may begin."""

    def __init__(self, text: str, at: int, letters: re.Pattern, bits: int, decode: Callable[[str], bytes | None]):
        self.starts, self.before, pieces, have = [], [], [], 0
        self.group, self.bytes, self.bits, self.decode = (4, 3, bits, decode) if bits == 6 else (2, 1, bits, decode)
        while True:
            if m := letters.match(text, at):
                self.starts.append(at)
                self.before.append(have)
                pieces.append(m[0])
                have, at = have + len(m[0]), m.end()
                self.end = at
            elif m := BETWEEN.match(text, at):
                at = m.end()
            else:
                break
        self.letters = "".join(pieces)

    def framed(self, starts: np.ndarray) -> list[tuple[int, int, bytes, int, int, int]]:
        """(place in the text, number of the letter, data, start and end of the content in it, whole length) of those DER sequences whose stated length is within the run, and in the shortest form."""
        piece = np.searchsorted(self.starts, starts, "right") - 1
        numbers = np.asarray(self.before)[piece] + starts - np.asarray(self.starts)[piece]
        found = []
        for way in range(self.group):
            mine = np.flatnonzero(numbers % self.group == way)
            if not len(mine):
                continue
            letters = self.letters[way:]
            data = self.decode(letters[:-1] if self.bits == 6 and len(letters) % 4 == 1 else letters) or b""
            raw, at = np.frombuffer(data, np.uint8).astype(np.int64), numbers[mine] // self.group * self.bytes
            first = raw[at + 1]
            size = np.where(first & 0x80, first & 0x7F, 0)
            n = np.where(first & 0x80, 0, first)
            for k in range(4):
                n = np.where(k < size, n << 8 | raw[at + 2 + k], n)
            fine = (first != 0x80) & (size <= 4) & ((size == 0) | (n >= 0x80) & (raw[at + 2] > 0))
            length = 2 + np.minimum(size, 4) + n
            fine &= np.isin(raw[at + length - n], (0x02, 0x30)) & (at + length <= len(raw))
            mine, end = mine[fine], (at + length)[fine]
            found += zip(starts[mine].tolist(), numbers[mine].tolist(), repeat(data), (end - n[fine]).tolist(), end.tolist(), length[fine].tolist())
        return sorted(found, key=lambda f: f[0])

    def place(self, number: int) -> int:
        """Where in the text a letter is."""
        piece = bisect.bisect_right(self.before, number) - 1
        return self.starts[piece] + number - self.before[piece]


def _keys(text: str, der: re.Pattern, openssh: re.Pattern, letters: re.Pattern, bits: int, decode: Callable[[str], bytes | None]) -> Iterator[tuple[int, int]]:
    """(start, end) of the keys whose letters carry so many bits each.

    A candidate of DER costs the elements of its frames, however long these are: runs are decoded once.
    """

    def whole(at: int, length: int | None) -> int | None:
        if length is None:
            return None
        count = -(-8 * length // bits)
        run, end = _letters(text, at, letters, count)
        following = text[end : end + 1]
        if len(run) < count or (letters.match(following) and following.isalnum()):
            return None
        return end if key_kind((decode(run) or b"")[:length]) else None

    last, i, places = 0, 0, np.array([m.start() for m in der.finditer(text)], np.int64)
    while i < len(places):
        run = _Run(text, int(places[i]), letters, bits, decode)
        stop = int(np.searchsorted(places, run.end))
        for at, number, data, inner, outer, length in run.framed(places[i:stop]):
            if at < last or not frame_kind(data, inner, outer):
                continue
            end = run.place(number - (-8 * length // bits) - 1) + 1
            following = text[end : end + 1]
            if not (letters.match(following) and following.isalnum()):
                last = end
                yield at, end
        i = stop
    starts = list(openssh.finditer(text))
    for m, stop in zip(starts, [*(n.start() for n in starts[1:]), len(text)]):
        if m.start() < last:
            continue
        run = _letters(text, m.start(), letters, len(text), stop)[0]
        end = whole(m.start(), openssh_length(decode(run[: len(run) & ~3]) or b""))
        if not end:  # Fields that don't fit: what the line holds.
            run = _letters(re.split("[\\r\\n\\\\]", text[m.start() : stop], maxsplit=1)[0], 0, letters, len(text))[0]
            end = m.start() + len(run) if key_kind(decode(run) or b"") else None
        if end:
            last = end
            yield m.start(), end


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans by start, then kind as listed in KINDS."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(start, end, "pem") for start, end in _pems(text)]
    if "eyJ" in text:
        found += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if _is_jwt(m[1], m[2])]
    for start, end in _keys(text, B64_START, OPENSSH_B64, B64_LETTERS, 6, decode_base64):
        padding = len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
        found.append((start, end + padding, "b64key"))
    found += [(start, end, "hexkey") for start, end in _keys(text, HEX_START, OPENSSH_HEX, HEX_LETTERS, 4, _from_hex)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, numbers of base spans, digest of the base spans, all spans."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                spans = scan(text or "")
                base = [s for s in spans if s[2] in KINDS[:3]]
                kinds = [s[2] for s in base]
                out.append((doc, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield batch(schema, *zip(*out))

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced."""
    out, at, end = [], 0, -1
    for start, stop, _ in scan(text):
        if start >= end:
            if end >= 0:
                at = end
            out += [text[at:start], mark]
            end = stop
        else:
            end = max(end, stop)
    return "".join(out) + text[max(end, 0) :]


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with secrets replaced in the text; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(redact, na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(text_col)))


def op3(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
