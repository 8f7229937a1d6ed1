"""Compressing bytes by a named codec, after reversible filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa

#: name -> (encode, decode)
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {}
FILTERS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {}
_HEADER = b"\n"


def register_codec(name: str, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes]) -> None:
    _register(CODECS, name, encode, decode)


def register_filter(name: str, forward: Callable[[bytes], bytes], backward: Callable[[bytes], bytes]) -> None:
    _register(FILTERS, name, forward, backward)


def _register(into: dict, name: str, there: Callable, back: Callable) -> None:
    if not name or any(c in name for c in ",\n"):
        raise ValueError(f"not a name: {name!r}")
    if name in into:
        raise ValueError(f"there is a {name!r} already")
    into[name] = (there, back)


def compress(raw: bytes, codec: str = "zstd", filters: Sequence[str] = ()) -> bytes:
    """Filtered and compressed bytes; a first line names the filters, the codec and the length that it restores."""
    for name in filters:
        raw = FILTERS[name][0](raw)
    packed = CODECS[codec][0](raw) if codec in CODECS else pa.compress(raw, codec, asbytes=True)
    return ",".join([*filters, codec, str(len(raw))]).encode() + _HEADER + packed


def decompress(packed: bytes) -> bytes:
    head, packed = packed.split(_HEADER, 1)
    *filters, codec, size = head.decode().split(",")
    raw = CODECS[codec][1](packed) if codec in CODECS else pa.decompress(packed, int(size), codec, asbytes=True)
    for name in reversed(filters):
        raw = FILTERS[name][1](raw)
    return raw
