"""Encodings, hashes, pseudonyms, network addresses."""

from __future__ import annotations

import base64
import hashlib
import hmac
import html
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import _c


def encode_b64(s) -> Column:
    return F.regexp_replace(F.base64(F.encode(_c(s), "UTF-8")), r"[\r\n]", "")


def decode_b64(s) -> Column:
    """An error for text that isn't base64 of UTF-8."""
    return F.validate_utf8(F.unbase64(_c(s)).cast("string"))


def encode_hex(s) -> Column:
    return F.lower(F.hex(F.encode(_c(s), "UTF-8")))


def decode_hex(s) -> Column:
    return F.validate_utf8(F.unhex(_c(s)).cast("string"))


def encode_url(s) -> Column:
    """Space is %20; only letters, digits and -_.~ stay."""
    return F.replace(F.replace(F.replace(F.url_encode(_c(s)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def decode_url(s) -> Column:
    return F.url_decode(F.replace(_c(s), F.lit("+"), F.lit("%2B")))


_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def escape_html(s) -> Column:
    out = _c(s)
    for a, b in _ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_html(s) -> Column:
    """Arrow UDF: two thousand named entities."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else html.unescape(x))

    return F.when(~F.contains(_c(s), F.lit("&")), _c(s)).otherwise(F.pandas_udf(run, "string")(_c(s)))


def escape_json(s) -> Column:
    """JSON string escapes without the quotes."""
    j = F.to_json(F.array(_c(s)))
    return F.when(_c(s).isNotNull(), F.substring(j, F.lit(3), F.length(j) - 4))


def unescape_json(s) -> Column:
    return F.get(F.from_json(F.concat(F.lit('["'), _c(s), F.lit('"]')), "array<string>"), 0)


def to_json(v, pretty: bool = False) -> Column:
    return F.to_json(_c(v), {"pretty": "true"} if pretty else {})


def _series(f, kind: str):
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else f(x)).astype(object)

    return F.pandas_udf(run, kind)


def hash_text(s, algo: str = "sha256") -> Column:
    """sha256 in the JVM, or xxh3 (64 bits, 16 hex digits) in an Arrow UDF."""
    if algo == "sha256":
        return F.sha2(_c(s), 256)
    if algo != "xxh3":
        raise ValueError(f"unknown hash: {algo}")

    def one(x):
        import xxhash

        return f"{xxhash.xxh3_64_intdigest(x.encode()):016x}"

    return _series(one, "string")(_c(s))


def bucket(s) -> Column:
    """xxh3 of 64 bits as a signed integer."""

    def one(x):
        import xxhash

        h = xxhash.xxh3_64_intdigest(x.encode())
        return h - (1 << 64) if h >> 63 else h

    return _series(one, "long")(_c(s))


def domain_key(secret: str, domain: str) -> bytes:
    """One key a domain from the master secret (HKDF with SHA-256). The master key is stretched by scrypt, once, on the driver."""
    master = hashlib.scrypt(secret.encode(), salt=b"eventlens.pseudonym", n=1 << 14, r=8, p=1, dklen=32)
    prk = hmac.new(b"\0" * 32, master, hashlib.sha256).digest()
    return hmac.new(prk, domain.encode() + b"\x01", hashlib.sha256).digest()


def pseudonym(s, domain: str, secret: str) -> Column:
    """24 characters, the same for the same value, domain and secret, unlinkable across domains."""
    key = domain_key(secret, domain)
    return _series(lambda x: base64.urlsafe_b64encode(hmac.new(key, f"{domain}\0{x}".encode(), hashlib.sha256).digest()).decode()[:24], "string")(_c(s))


# addresses ----------------------------------------------------------------------------------------------------------

V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\z"


def is_ipv4(s) -> Column:
    return _c(s).rlike(V4)


def is_ipv6(s) -> Column:
    def one(x):
        try:
            return "%" not in x and bool(ipaddress.IPv6Address(x))
        except ValueError:
            return False

    return F.when(~F.contains(_c(s), F.lit(":")), F.lit(False)).otherwise(_series(one, "boolean")(_c(s)))


def ipv4_number(s) -> Column:
    p = F.split(_c(s), r"\.")
    return F.when(is_ipv4(s), sum((F.get(p, i).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(p, 0).cast("long") * 256**3))


def is_in_cidr(s, net: str) -> Column:
    """Whether the address is in the network; an error for text that is no address."""
    network = ipaddress.ip_network(net, strict=False)
    bad = F.raise_error(F.concat(F.lit("not an address: "), _c(s))).cast("boolean")
    if network.version == 4:
        n = ipv4_number(s)
        low, high = int(network.network_address), int(network.broadcast_address)
        return F.when(_c(s).isNull(), None).when(n.isNotNull(), n.between(low, high)).when(F.contains(_c(s), F.lit(":")), False).otherwise(bad)
    return F.when(is_ipv4(s), False).otherwise(_series(lambda x: ipaddress.ip_address(x) in network, "boolean")(_c(s)))


def mask_ip(s, n: int = 1) -> Column:
    """The last n octets (1 to 4) or groups (1 to 8) set to 0; other text stays."""
    k = min(4, max(1, n))
    v4 = F.array_join(F.concat(F.slice(F.split(_c(s), r"\."), 1, 4 - k), F.array_repeat(F.lit("0"), k)), ".")

    def one(x):
        try:
            v = int(ipaddress.IPv6Address(x))
        except ValueError:
            return x
        bits = 16 * min(8, max(1, n))
        return str(ipaddress.IPv6Address(v >> bits << bits))

    return F.when(is_ipv4(s), v4).when(F.contains(_c(s), F.lit(":")), _series(one, "string")(_c(s))).otherwise(_c(s))


def is_private_ip(s) -> Column:
    """Private and loopback IPv4; loopback, unique local and link local IPv6."""
    v4 = _c(s).rlike(r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")
    nets = [ipaddress.ip_network(x) for x in ("fc00::/7", "fe80::/10", "::1/128")]

    def one(x):
        try:
            a = ipaddress.IPv6Address(x)
        except ValueError:
            return False
        return any(a in n for n in nets)

    return F.when(is_ipv4(s), v4).when(F.contains(_c(s), F.lit(":")), _series(one, "boolean")(_c(s))).otherwise(F.when(_c(s).isNotNull(), False))
