"""Mathematical, bit, cipher and compression functions.  A null argument gives null; overflow and zero divisors raise."""

from __future__ import annotations

import os
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.strings import col


def double(x) -> Column:
    return col(x).cast("double")


def whole(x) -> Column:
    return col(x).cast("long")


def cot(x) -> Column:
    """One over the tangent; a zero tangent raises."""
    t = F.tan(double(x))
    return F.when(t == 0, F.raise_error(F.lit("Division by zero"))).otherwise(1 / t)


def ceiling(x) -> Column:
    return F.ceil(double(x)).cast("double")


def floor(x) -> Column:
    return F.floor(double(x)).cast("double")


def log(x, base10: bool = False) -> Column:
    """The natural logarithm, or with base10 the common one."""
    return F.log10(double(x)) if base10 else F.ln(double(x))


def mod(a, b) -> Column:
    """The remainder with the dividend's sign."""
    return whole(a) % whole(b)


def round_half_up(x, digits=0) -> Column:
    """Halves go towards plus infinity: -2.5 becomes -2."""
    f = F.pow(F.lit(10.0), double(digits))
    return F.floor(double(x) * f + 0.5).cast("double") / f


def truncate(x, digits=0) -> Column:
    """Cut towards zero at a number of decimals."""
    f = F.pow(F.lit(10.0), double(digits))
    y = double(x) * f
    return F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)).cast("double") / f


def truncate_timestamp(ts) -> Column:
    """Midnight of a timestamp's day."""
    return F.date_trunc("day", col(ts))


def roundmagic(x) -> Column:
    """Drop floating-point noise: values next to zero become zero, and tails of 0000 or 9999 digits are cut off."""

    @F.pandas_udf("double")
    def clean(v: pd.Series) -> pd.Series:
        def one(d):
            if d is None or d != d or abs(d) > 1e12:
                return d
            if abs(d) < 1e-13:
                return 0.0
            s = repr(d)
            if "e" in s or "." not in s or len(s) <= 16:
                return d
            cut = s[:-1]
            return float(f"{d:.{max(0, len(cut.split('.')[1]) - 3)}f}") if cut.endswith(("000", "999")) or "0000" in s[-6:] or "9999" in s[-6:] else d

        return v.map(one)

    return clean(double(x))


def sign(x) -> Column:
    return F.signum(double(x)).cast("int")


def hash_sha256(algorithm, data, rounds=1) -> Column:
    """SHA-256 of bytes, applied rounds times; other algorithms raise."""
    if str(algorithm).upper() != "SHA256":
        raise ValueError(f"no such digest: {algorithm}")
    out = col(data).cast("binary")
    for _ in range(rounds):
        out = F.unhex(F.sha2(out, 256))
    return out


def _xtea(block: bytes, key: tuple[int, ...], back: bool) -> bytes:
    """One block of the published XTEA cipher, 32 rounds."""
    a, b = struct.unpack(">2I", block)
    m, delta = 0xFFFFFFFF, 0x9E3779B9
    if back:
        s = delta * 32 & m
        for _ in range(32):
            b = b - (((a << 4 ^ a >> 5) + a) ^ (s + key[s >> 11 & 3])) & m
            s = s - delta & m
            a = a - (((b << 4 ^ b >> 5) + b) ^ (s + key[s & 3])) & m
    else:
        s = 0
        for _ in range(32):
            a = a + (((b << 4 ^ b >> 5) + b) ^ (s + key[s & 3])) & m
            s = s + delta & m
            b = b + (((a << 4 ^ a >> 5) + a) ^ (s + key[s >> 11 & 3])) & m
    return struct.pack(">2I", a, b)


def _cipher(algorithm: str, key, data, back: bool) -> Column:
    if algorithm.upper() == "XTEA":

        @F.pandas_udf("binary")
        def run(keys: pd.Series, values: pd.Series) -> pd.Series:
            def one(k, v):
                if k is None or v is None:
                    return None
                words = struct.unpack(">4I", (bytes(k) + bytes(16))[:16])
                v = bytes(v) + bytes(-len(v) % 8)
                return b"".join(_xtea(v[i : i + 8], words, back) for i in range(0, len(v), 8))

            return pd.Series([one(k, v) for k, v in zip(keys, values)])

        return run(col(key).cast("binary"), col(data).cast("binary"))
    if algorithm.upper() != "AES":
        raise ValueError(f"no such cipher: {algorithm}")
    padded = F.rpad(F.hex(col(key).cast("binary")), 32, "0")
    k = F.unhex(F.substring(padded, 1, 32))
    return (F.aes_decrypt if back else F.aes_encrypt)(col(data).cast("binary"), k, F.lit("ECB"), F.lit("PKCS"))


def encrypt(algorithm, key, data) -> Column:
    """AES (128-bit key, zero-padded; ECB with PKCS padding) or XTEA (zero-padded blocks)."""
    return _cipher(algorithm, key, data, False)


def decrypt(algorithm, key, data) -> Column:
    """The inverse of encrypt; XTEA keeps its zero padding."""
    return _cipher(algorithm, key, data, True)


def secure_rand(n) -> Column:
    """So many secure random bytes."""

    @F.pandas_udf("binary")
    def draw(v: pd.Series) -> pd.Series:
        return v.map(lambda k: None if k is None else os.urandom(int(k)))

    return draw.asNondeterministic()(col(n).cast("int"))


def compress(data, algorithm="DEFLATE") -> Column:
    """DEFLATE or NO, with the method in front."""
    tag = {"NO": b"\x00", "DEFLATE": b"\x02"}.get(str(algorithm).upper().split()[0])
    if tag is None:
        raise ValueError(f"no such compression: {algorithm}")

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda b: None if b is None else tag + (zlib.compress(bytes(b)) if tag == b"\x02" else bytes(b)))

    return run(col(data).cast("binary"))


def expand(data) -> Column:
    """The inverse of compress."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda b: None if b is None else zlib.decompress(bytes(b)[1:]) if bytes(b)[:1] == b"\x02" else bytes(b)[1:])

    return run(col(data).cast("binary"))


def rand(seed=None) -> Column:
    return F.rand(seed)


FUNCTIONS = {
    "ABS": lambda x: F.abs(col(x)), "ACOS": lambda x: F.acos(double(x)), "ASIN": lambda x: F.asin(double(x)), "ATAN": lambda x: F.atan(double(x)),
    "ATAN2": lambda y, x: F.atan2(double(y), double(x)), "BITAND": lambda a, b: whole(a).bitwiseAND(whole(b)), "BITOR": lambda a, b: whole(a).bitwiseOR(whole(b)),
    "BITXOR": lambda a, b: whole(a).bitwiseXOR(whole(b)), "CEILING": ceiling, "CEIL": ceiling, "COS": lambda x: F.cos(double(x)), "COSH": lambda x: F.cosh(double(x)), "COT": cot,
    "DEGREES": lambda x: F.degrees(double(x)), "EXP": lambda x: F.exp(double(x)), "FLOOR": floor, "LOG": log, "LN": log, "LOG10": lambda x: log(x, True), "MOD": mod, "PI": F.pi,
    "POWER": lambda a, b: F.pow(double(a), double(b)), "RADIANS": lambda x: F.radians(double(x)), "RAND": rand, "RANDOM": rand, "ROUND": round_half_up, "ROUNDMAGIC": roundmagic, "SIGN": sign,
    "SIN": lambda x: F.sin(double(x)), "SINH": lambda x: F.sinh(double(x)), "SQRT": lambda x: F.sqrt(double(x)), "TAN": lambda x: F.tan(double(x)), "TANH": lambda x: F.tanh(double(x)),
    "TRUNCATE": truncate, "TRUNC": truncate, "HASH": hash_sha256, "ENCRYPT": encrypt, "DECRYPT": decrypt, "SECURE_RAND": secure_rand, "COMPRESS": compress, "EXPAND": expand,
    "ZERO": lambda: F.lit(0), "RANDOM_UUID": F.uuid, "SYS_GUID": F.uuid,
}
