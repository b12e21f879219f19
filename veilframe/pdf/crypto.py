"""Decryption: RC4, AES-CBC, the standard password handlers and the public-key handler.

The cipher's tables come from its field arithmetic at import; DER is read just far
enough for the structures needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from veilframe.pdf.model import File, PdfError, Ref, as_int

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray()
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _double(a: int) -> int:
    return (a << 1) ^ (0x11B if a & 0x80 else 0)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _tables() -> tuple[list[int], list[int]]:
    box = [0] * 256
    p = q = 1  # p runs through the powers of 3, q through their inverses
    while True:
        p ^= _double(p)
        q = _times(q, 0xF6)
        x = q
        for r in (1, 2, 3, 4):
            x ^= ((q << r) | (q >> (8 - r))) & 255
        box[p] = x ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


_BOX, _BACK = _tables()
_MUL = {k: [_times(i, k) for i in range(256)] for k in (2, 3, 9, 11, 13, 14)}
#: Where each byte of a block comes from in a row shift, and its inverse.
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_UNSHIFT = [_SHIFT.index(i) for i in range(16)]


class Aes:
    def __init__(self, key: bytes):
        n = len(key) // 4
        words, rc = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        for i in range(n, 4 * (n + 7)):
            w = words[-1]
            if i % n == 0:
                w = [_BOX[b] for b in w[1:] + w[:1]]
                w[0] ^= rc
                rc = _double(rc)
            elif n > 6 and i % n == 4:
                w = [_BOX[b] for b in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        self.rounds = [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]

    def encrypt_block(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.rounds[0])]
        for k in self.rounds[1:]:
            s = [_BOX[s[i]] for i in _SHIFT]
            if k is not self.rounds[-1]:
                two, three = _MUL[2], _MUL[3]
                s = [two[s[c + r]] ^ three[s[c + (r + 1) % 4]] ^ s[c + (r + 2) % 4] ^ s[c + (r + 3) % 4] for c in (0, 4, 8, 12) for r in range(4)]
            s = [a ^ b for a, b in zip(s, k)]
        return bytes(s)

    def decrypt_block(self, block: bytes) -> bytes:
        s = list(block)
        for k in self.rounds[:0:-1]:
            s = [a ^ b for a, b in zip(s, k)]
            if k is not self.rounds[-1]:
                m = [_MUL[x] for x in (14, 11, 13, 9)]
                s = [m[0][s[c + r]] ^ m[1][s[c + (r + 1) % 4]] ^ m[2][s[c + (r + 2) % 4]] ^ m[3][s[c + (r + 3) % 4]] for c in (0, 4, 8, 12) for r in range(4)]
            s = [_BACK[s[i]] for i in _UNSHIFT]
        return bytes(a ^ b for a, b in zip(s, self.rounds[0]))


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a) ^ int.from_bytes(b)).to_bytes(len(a))


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    if len(data) % 16:
        raise PdfError("Corrupt", "encrypted data is not whole blocks")
    aes, out = Aes(key), []
    for i in range(0, len(data), 16):
        out.append(_xor(aes.decrypt_block(data[i : i + 16]), iv))
        iv = data[i : i + 16]
    return b"".join(out)


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), []
    for i in range(0, len(data), 16):
        iv = aes.encrypt_block(_xor(data[i : i + 16], iv))
        out.append(iv)
    return b"".join(out)


def open_sealed(key: bytes, data: bytes) -> bytes:
    """Data with its initial vector before it and padding behind."""
    if not data:
        return b""
    if len(data) < 32 or len(data) % 16:
        raise PdfError("Corrupt", "encrypted data is not whole blocks")
    plain = cbc_decrypt(key, data[:16], data[16:])
    n = plain[-1]
    if not 1 <= n <= 16 or plain[-n:] != bytes([n]) * n:
        raise PdfError("Corrupt", "padding of encrypted data")
    return plain[:-n]


def seal(key: bytes, iv: bytes, data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return iv + cbc_encrypt(key, iv, data + bytes([n]) * n)


def hash_2b(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    """The iterated hash of revision 6; revision 5 is one round of SHA-256."""
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    i, last = 0, 0
    while i < 64 or last > i - 32:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        last = e[-1]
        i += 1
    return k[:32]


def object_key(key: bytes, ref: Ref, method: str) -> bytes:
    """The key of one object's strings and stream."""
    material = key + ref.num.to_bytes(3, "little") + ref.gen.to_bytes(2, "little") + (b"sAlT" if method == "AESV2" else b"")
    return hashlib.md5(material).digest()[: min(16, len(key) + 5)]


@dataclass
class Handler:
    """Decrypts strings and streams with the methods (V2, AESV2, AESV3, Identity) of each."""

    key: bytes
    strings: str
    streams: str
    metadata: bool = True

    def data(self, raw: bytes, ref: Ref, method: str) -> bytes:
        if method == "Identity":
            return raw
        if method == "AESV3":
            return open_sealed(self.key, raw)
        key = object_key(self.key, ref, method)
        return open_sealed(key, raw) if method == "AESV2" else rc4(key, raw)


def _method(d: dict, which: str, resolve: Callable) -> str:
    """Method of the crypt filter that strings or streams name."""
    name = d.get(which, "Identity")
    if name == "Identity":
        return "Identity"
    f = resolve((resolve(d.get("CF")) or {}).get(name))
    m = (f or {}).get("CFM", "None")
    if m not in ("V2", "AESV2", "AESV3", "None"):
        raise PdfError("Unsupported", f"crypt filter method {m}")
    return "Identity" if m == "None" else str(m)


def _bytes(d: dict, k: str, resolve: Callable) -> bytes:
    v = resolve(d.get(k))
    if not isinstance(v, bytes):
        raise PdfError("Corrupt", f"the encryption dictionary has no {k}")
    return v


def file_key(password: bytes, o: bytes, p: int, ident: bytes, revision: int, size: int, metadata: bool) -> bytes:
    h = hashlib.md5((password + PAD)[:32] + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + ident)
    if revision >= 4 and not metadata:
        h.update(b"\xff" * 4)
    k = h.digest()
    if revision >= 3:
        for _ in range(50):
            k = hashlib.md5(k[:size]).digest()
    return k[:size]


def user_entry(key: bytes, ident: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    x = rc4(key, hashlib.md5(PAD + ident).digest())
    for i in range(1, 20):
        x = rc4(bytes(b ^ i for b in key), x)
    return x


def owner_key(password: bytes, revision: int, size: int) -> bytes:
    k = hashlib.md5((password + PAD)[:32]).digest()
    if revision >= 3:
        for _ in range(50):
            k = hashlib.md5(k).digest()
    return k[:size]


def user_from_owner(o: bytes, key: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, o)
    for i in range(19, -1, -1):
        o = rc4(bytes(b ^ i for b in key), o)
    return o


def standard(d: dict, trailer: dict, password: bytes, resolve: Callable = lambda v: v) -> Handler:
    v, r = as_int(d.get("V"), 0), as_int(d.get("R"), 0)
    meta = resolve(d.get("EncryptMetadata", True)) is not False
    if v == 5 and r in (5, 6):
        return _standard_v5(d, password[:127], r, meta, resolve)
    if v not in (1, 2, 4) or r not in (2, 3, 4):
        raise PdfError("Unsupported", f"encryption V {v} R {r}")
    size = 5 if v == 1 else max(5, min(16, (as_int(d.get("Length"), 128 if v == 4 else 40)) // 8))
    methods = (_method(d, "StrF", resolve), _method(d, "StmF", resolve)) if v == 4 else ("V2", "V2")
    o, u, p = _bytes(d, "O", resolve), _bytes(d, "U", resolve), as_int(d.get("P"), 0)
    first = resolve(trailer.get("ID"))
    ident = resolve(first[0]) if isinstance(first, list) and first else b""
    n = 32 if r == 2 else 16
    for attempt in (password, user_from_owner(o[:32], owner_key(password, r, size), r)):
        key = file_key(attempt, o, p, ident, r, size, meta)
        if user_entry(key, ident, r)[:n] == u[:n]:
            return Handler(key, *methods, meta)
    raise PdfError("InvalidPassword", "neither the user's nor the owner's")


def _standard_v5(d: dict, password: bytes, r: int, meta: bool, resolve: Callable) -> Handler:
    o, u = _bytes(d, "O", resolve), _bytes(d, "U", resolve)
    for entry, wrapped, more in ((u, "UE", b""), (o, "OE", u[:48])):
        if hash_2b(password, entry[32:40], more, r) == entry[:32]:
            middle = hash_2b(password, entry[40:48], more, r)
            key = cbc_decrypt(middle, b"\0" * 16, _bytes(d, wrapped, resolve)[:32])
            return Handler(key, _method(d, "StrF", resolve), _method(d, "StmF", resolve), meta)
    raise PdfError("InvalidPassword", "neither the user's nor the owner's")


# DER: a node is (tag, content, whole encoding).
Node = tuple[int, bytes, bytes]


def der(data: bytes) -> list[Node]:
    out, i = [], 0
    while i < len(data):
        tag, start = data[i], i
        if i + 2 > len(data):
            raise PdfError("Corrupt", "DER ends early")
        n, i = data[i + 1], i + 2
        if n & 0x80:
            size = n & 0x7F
            n, i = int.from_bytes(data[i : i + size]), i + size
        if i + n > len(data):
            raise PdfError("Corrupt", "DER ends early")
        out.append((tag, data[i : i + n], data[start : i + n]))
        i += n
    return out


def rsa_key(data: bytes) -> tuple[int, int]:
    """(modulus, private exponent) of a key in PKCS#8 or PKCS#1."""
    top = der(der(data)[0][1])
    if len(top) >= 3 and top[1][0] == 0x30:
        top = der(der(top[2][1])[0][1])
    return int.from_bytes(top[1][1]), int.from_bytes(top[3][1])


def _oaep_digest(algorithm: list[Node]) -> str | None:
    oid = algorithm[0][1].hex()
    if oid == "2a864886f70d010101":
        return None
    if oid == "2a864886f70d010107":
        return "sha1"
    raise PdfError("Unsupported", "key transport algorithm")


def _mask(seed: bytes, n: int) -> bytes:
    return b"".join(hashlib.sha1(seed + i.to_bytes(4)).digest() for i in range(-(-n // 20)))[:n]


def rsa_decrypt(key: tuple[int, int], data: bytes, oaep: bool) -> bytes:
    n = (key[0].bit_length() + 7) // 8
    m = pow(int.from_bytes(data), key[1], key[0]).to_bytes(n)
    if oaep:
        seed, db = m[1:21], m[21:]
        seed = _xor(seed, _mask(db, 20))
        db = _xor(db, _mask(seed, len(db)))
        at = db.find(b"\x01", 20)
        if m[0] or db[:20] != hashlib.sha1(b"").digest() or at < 0:
            raise PdfError("InvalidPassword", "the key does not open the envelope")
        return db[at + 1 :]
    at = m.find(b"\0", 2)
    if m[:2] != b"\0\x02" or at < 10:
        raise PdfError("InvalidPassword", "the key does not open the envelope")
    return m[at + 1 :]


def _certificate(cert: bytes) -> tuple[bytes, bytes, bytes | None]:
    """Issuer (whole), serial number, subject key identifier."""
    fields = der(der(der(cert)[0][1])[0][1])
    fields = fields[1:] if fields[0][0] == 0xA0 else fields
    ski = None
    for f in fields:
        if f[0] == 0xA3:
            for e in der(der(f[1])[0][1]):
                parts = der(e[1])
                if parts[0][1] == bytes.fromhex("551d0e"):
                    ski = der(parts[-1][1])[0][1]
    return fields[2][2], fields[0][1], ski


def _unwrap(blob: bytes, cert: bytes, key: tuple[int, int]) -> bytes | None:
    """The content of an enveloped message for this certificate, None if it is for others."""
    issuer, serial, ski = _certificate(cert)
    info = der(der(blob)[0][1])
    env = der(der(info[1][1])[0][1])
    recipients = next(x for x in env if x[0] == 0x31)
    content = der(env[env.index(recipients) + 1][1])
    for r in der(recipients[1]):
        if r[0] != 0x30:
            continue
        parts = der(r[1])
        who = parts[1]
        mine = who[1] == ski if who[0] & 0x80 else (lambda w: w[0][2] == issuer and w[1][1] == serial)(der(who[1]))
        if not mine:
            continue
        secret = rsa_decrypt(key, parts[3][1], _oaep_digest(der(parts[2][1])) == "sha1")
        algorithm = der(content[1][1])
        oid, iv = algorithm[0][1].hex(), algorithm[1][1]
        if oid not in ("608648016503040102", "60864801650304012a"):
            raise PdfError("Unsupported", "content encryption algorithm")
        body = content[2][1] if content[2][0] == 0x80 else b"".join(x[1] for x in der(content[2][1]))
        return open_sealed(secret, iv + body)
    return None


def public_key(d: dict, cert: bytes, private: bytes, resolve: Callable = lambda v: v) -> Handler:
    sub, v = str(d.get("SubFilter", "")), as_int(d.get("V"), 0)
    name = d.get("StmF", "DefaultCryptFilter")
    filters = resolve(d.get("CF")) or {}
    owner = resolve(filters.get(name)) or {} if sub.endswith("s5") else d
    blobs = [resolve(b) for b in resolve(owner.get("Recipients", d.get("Recipients"))) or []]
    meta = resolve(owner.get("EncryptMetadata", d.get("EncryptMetadata", True))) is not False
    key = rsa_key(private)
    for blob in blobs:
        opened = _unwrap(blob, cert, key)
        if opened is None:
            continue
        v5 = v == 5
        digest = (hashlib.sha256 if v5 else hashlib.sha1)(opened[:20] + b"".join(blobs) + (b"" if meta else b"\xff" * 4)).digest()
        size = 32 if v5 else max(5, min(16, as_int(d.get("Length", owner.get("Length")), 128) // 8))
        methods = (_method(d, "StrF", resolve), _method(d, "StmF", resolve)) if v >= 4 else ("V2", "V2")
        return Handler(digest[:size], *methods, meta)
    raise PdfError("InvalidPassword", "no recipient has this certificate")


def decrypt_file(file: File, handler: Handler, skip: Ref | None) -> None:
    """All strings and streams in place, but for the encryption dictionary and cross-reference streams."""
    from veilframe.pdf.model import Stream

    def plain(v: Any, ref: Ref) -> Any:
        if isinstance(v, bytes):
            return handler.data(v, ref, handler.strings)
        if isinstance(v, list):
            return [plain(x, ref) for x in v]
        if isinstance(v, dict):
            return {k: plain(x, ref) for k, x in v.items()}
        return v

    for ref, v in list(file.objects.items()):
        if ref == skip:
            continue
        if not isinstance(v, Stream):
            file.objects[ref] = plain(v, ref)
        elif v.dict.get("Type") != "XRef":
            exempt = v.dict.get("Type") == "Metadata" and not handler.metadata
            identity = "Crypt" in str(v.dict.get("Filter", ""))
            file.objects[ref] = Stream(plain(v.dict, ref), v.data if exempt or identity else handler.data(v.data, ref, handler.streams))
    if skip is not None:
        file.objects.pop(skip, None)
    file.trailer.pop("Encrypt", None)
