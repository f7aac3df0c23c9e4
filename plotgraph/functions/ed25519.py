"""Ed25519 (RFC 8032): keys, signatures and their check, for use inside batches.

Points are in extended coordinates.  A key's multiples are tabled once, so a
check costs two runs over tables and no decoding of the key.  Tabled points
have z = 1 and are held as what an addition needs of them.
"""

from __future__ import annotations

import functools
import hashlib

#: Fixed values of the curve: the field, the order of the base point, and the curve's constant.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
#: Bits that one step of a key's table covers, and of the base point's, which is made once a worker.
STEP, BASE_STEP = 5, 8

Point = tuple[int, int, int, int]
#: Of a point with z = 1: y - x, y + x, and 2 D x y.
Tabled = tuple[int, int, int]
ZERO: Point = (0, 1, 1, 0)


def _add(a: Point, b: Point) -> Point:
    p, q = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    r, s = 2 * D * a[3] * b[3] % P, 2 * a[2] * b[2] % P
    e, f, g, h = q - p, s - r, s + r, q + p
    return e * f % P, g * h % P, f * g % P, e * h % P


def _encode(a: Point) -> bytes:
    z = pow(a[2], P - 2, P)
    x, y = a[0] * z % P, a[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _decode(data: bytes) -> Point | None:
    """The point, or None if there is none of this encoding."""
    if len(data) != 32:
        return None
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and sign):
        return None
    x = P - x if x & 1 != sign else x
    return x, y, 1, x * y % P


def _inverses(numbers: list[int]) -> list[int]:
    """Of all numbers, none of them zero, by one division."""
    before, product = [], 1
    for n in numbers:
        before.append(product)
        product = product * n % P
    left = pow(product, P - 2, P)
    out = [0] * len(numbers)
    for i in range(len(numbers) - 1, -1, -1):
        out[i] = left * before[i] % P
        left = left * numbers[i] % P
    return out


def _table(point: Point, step: int = STEP) -> list[list[Tabled]]:
    """For every step of bits the point's multiples, moved up to that step."""
    points, width = [], 2**step
    for _ in range(-(-256 // step)):
        row = [ZERO]
        for _ in range(width - 1):
            row.append(_add(row[-1], point))
        points += row
        point = _add(row[-1], point)
    flat = [(x * i % P, y * i % P) for (x, y, _, _), i in zip(points, _inverses([p[2] for p in points]))]
    tabled = [((y - x) % P, (y + x) % P, 2 * D * x * y % P) for x, y in flat]
    return [tabled[i : i + width] for i in range(0, len(tabled), width)]


def _times(table: list[list[Tabled]], n: int, start: Point = ZERO) -> Point:
    """``start`` and n times the table's point."""
    x, y, z, t = start
    last = len(table[0]) - 1
    step = last.bit_length()
    for row in table:
        if k := n & last:
            less, more, twisted = row[k]
            p, q, r, s = (y - x) * less % P, (y + x) * more % P, t * twisted % P, 2 * z
            e, f, g, h = q - p, s - r, s + r, q + p
            x, y, z, t = e * f % P, g * h % P, f * g % P, e * h % P
        n >>= step
    return x, y, z, t


@functools.cache
def _base() -> list[list[Tabled]]:
    """Multiples of the base point, whose second coordinate is 4/5."""
    return _table(_decode((4 * pow(5, P - 2, P) % P).to_bytes(32, "little")), BASE_STEP)


@functools.lru_cache(256)
def _negated(public: bytes) -> list[list[Tabled]] | None:
    point = _decode(public)
    return point and _table((P - point[0], point[1], 1, P - point[3]))


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


@functools.lru_cache(256)
def _secret(seed: bytes) -> tuple[int, bytes, bytes]:
    digest = hashlib.sha512(seed).digest()
    a = int.from_bytes(digest[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, digest[32:], _encode(_times(_base(), a))


def public_key(seed: bytes) -> bytes:
    return _secret(seed)[2]


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix, public = _secret(seed)
    r = _number(prefix, message) % ORDER
    point = _encode(_times(_base(), r))
    return point + ((r + _number(point, public, message) * a) % ORDER).to_bytes(32, "little")


def verify(public: bytes | None, message: bytes | None, signature: bytes | None) -> bool:
    """Whether the signature is the key's for the message; nulls, broken keys and numbers beyond the order fail."""
    if public is None or message is None or signature is None or len(signature) != 64:
        return False
    s, table = int.from_bytes(signature[32:], "little"), _negated(bytes(public))
    if s >= ORDER or table is None:
        return False
    k = _number(signature[:32], public, message) % ORDER
    return _encode(_times(table, k, _times(_base(), s))) == signature[:32]
