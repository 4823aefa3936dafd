"""Secrets in texts: patterns first, then what decodes to the structure of a key or a signed token.

Long runs of base64, base64url or hex are decoded and parsed: DER values whose nested lengths fill each
other exactly and that are laid out as private keys, length-prefixed fields of OpenSSH keys, PEM blocks inside a
second encoding, and tokens whose header and payload are JSON objects and whose signature is as long as their
algorithm makes it. Only what parses is reported, so a long random run isn't.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import table

# fixed values: the base patterns, in the order in which kinds are listed
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a run is matched from its beginning to its end, so that its least length can stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
#: Kinds in the order in which spans of one start are listed: the base ones, then those that the method adds.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")

#: A PEM block of a private key, closed by its own label. Headers inside (legacy encryption) are allowed.
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
#: Candidates: base64 of either alphabet, one run or lines; hex of either case; three dotted parts, of which two begin like a JSON object.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{40,}(?:\r?\n[A-Za-z0-9+/_-]{4,})*={0,2}")
HEX_BLOB = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[yw][A-Za-z0-9_-]+)\.(e[yw][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_.-])")

# fixed values: bytes of a signature by algorithm; RSA ones are as long as their modulus
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64, "EdDSA": 64}
RSA_ALGORITHMS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Nested encodings, such as base64 of a PEM text, are followed so deep.
DEPTH = 2


def decode64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without padding and line breaks; None if it is none."""
    s = re.sub(r"[\s=]+", "", text).replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """Elements (tag, start, end of content) that fill data[start:end] exactly, else None. Lengths are definite and minimal."""
    end = len(data) if end is None else end
    out = []
    while start < end:
        if end - start < 2 or data[start] & 0x1F == 0x1F:
            return None
        tag, length, at = data[start], data[start + 1], start + 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length, at = int.from_bytes(data[at : at + n]), at + n
            if length < 0x80 or length < 1 << 8 * (n - 1):
                return None
        if at + length > end:
            return None
        out.append((tag, at, at + length))
        start = at + length
    return out


def is_der_key(data: bytes) -> bool:
    """One sequence with the layout of a private key: RSA, EC, any algorithm in PKCS#8, or PKCS#8 encrypted."""
    if len(data) < 16 or data[0] != SEQUENCE or not (top := der(data)) or len(top) != 1 or not (parts := der(data, *top[0][1:])):
        return False
    tags = [t for t, _, _ in parts]

    def inner(k: int) -> list[int]:
        return [t for t, _, _ in der(data, *parts[k][1:]) or []]

    def number(k: int) -> int:
        return int.from_bytes(data[parts[k][1] : parts[k][2]], signed=True)

    if tags[:9] == [INTEGER] * 9 and len(tags) in (9, 10) and number(0) in (0, 1):
        # modulus = p * q, which no other nine numbers fulfil
        return number(1) == number(4) * number(5)
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and number(0) in (0, 1) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        return inner(1)[:1] == [OID]
    if tags[:2] == [INTEGER, OCTETS] and number(0) == 1 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 64, 66)
    if tags == [SEQUENCE, OCTETS]:
        return inner(0) == [OID, SEQUENCE] and parts[1][2] - parts[1][1] >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's own private key format: its mark, cipher, key derivation, public keys and one private block, by nested lengths."""
    mark = b"openssh-key-v1\0"
    if not data.startswith(mark):
        return False
    at, fields = len(mark), []

    def field() -> bool:
        nonlocal at
        n = int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else len(data)
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
        return True

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4]), at + 4
    return 1 <= keys <= 16 and all(field() for _ in range(keys + 1)) and at == len(data) and len(fields[-1]) % 8 == 0 and len(fields[-1]) > 0


def is_token(header: str, payload: str, signature: str) -> bool:
    """A signed token: header with a known algorithm and payload are JSON objects, the signature has the algorithm's length."""
    try:
        head, body = (json.loads(decode64(p) or b"") for p in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(alg := head.get("alg"), str):
        return False
    n = len(decode64(signature) or b"")
    return n == SIGNATURE_BYTES.get(alg) or (alg in RSA_ALGORITHMS and n in (128, 256, 384, 512, 1024))


def kind_of(data: bytes, depth: int = DEPTH) -> str | None:
    """What kind of key some decoded bytes are, or hold in a further encoding; None if none."""
    if is_der_key(data):
        return "der_key"
    if is_ssh_key(data):
        return "ssh_key"
    if depth > 0 and data.isascii():
        text = data.decode("ascii").strip()
        if any(pem_kind(m) for m in PEM.finditer(text)):
            return "pem_key"
        for whole, decode in ((HEX_BLOB, bytes.fromhex), (BASE64, decode64)):
            if whole.fullmatch(text) and (more := decode(text)):
                return kind_of(more, depth - 1)
    return None


def pem_kind(m: re.Match) -> bool:
    """Whether a PEM block's body decodes to a key, or to ciphertext of whole blocks under its own encryption header."""
    body = m[2].replace("\\r", "").replace("\\n", "\n")  # line breaks are often escaped in settings
    headers, _, rest = body.strip().partition("\n\n")
    encrypted = "Proc-Type: 4,ENCRYPTED" in headers and "DEK-Info:" in headers
    data = decode64(rest if encrypted else body)
    return bool(data) and (is_der_key(data) or is_ssh_key(data) or (encrypted and len(data) % 8 == 0))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    return found + [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def blocks64(run: str) -> list[str]:
    """What of a run of base64 lines can be one value: lines of the first one's width and a shorter one, these lines alone, the first alone."""
    lines = re.split(r"(?<=\n)", run)
    width = len(lines[0].rstrip("\r\n"))
    full = next((k for k, x in enumerate(lines) if len(x.rstrip("\r\n")) != width), len(lines))
    return list(dict.fromkeys("".join(lines[:k]).rstrip("\r\n") for k in (full + 1, full, 1)))


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of what decodes to a key or a signed token."""
    found = {(m.start(), "pem_key", m.end()) for m in PEM.finditer(text) if pem_kind(m)} if "PRIVATE KEY-----" in text else set()
    blocks = [(a, b) for a, _, b in found]
    found |= {(m.start(), "signed_token", m.end()) for m in TOKEN.finditer(text) if is_token(*m.groups())}
    for pattern, decode, values in ((HEX_BLOB, bytes.fromhex, lambda run: [run]), (BASE64, decode64, blocks64)):
        for m in pattern.finditer(text):
            if not any(a <= m.start() < b for a, b in blocks):
                found |= set([(m.start(), kind, m.start() + len(v)) for v in values(m[0]) if (kind := kind_of(decode(v) or b""))][:1])
    return [(a, KINDS.index(k), b) for a, k, b in found]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed, one row for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind as listed in KINDS; of an
    assignment the whole match is the span. Null and empty texts have none. Rows that repeat are judged alike,
    doc_id may be of any type and null; other columns are neither read nor returned.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, more = base_spans(text or ""), confirmed_spans(text or "")
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select("doc_id", found("text").alias("found")).select("doc_id", "found.*")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op13_secret_scan": op13_secret_scan}
ORACLES: dict[str, str] = {}
