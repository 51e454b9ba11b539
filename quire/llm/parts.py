"""Keys that two documents share, found over parts of the corpus.

Documents are dealt to parts of bounded size; a part sends the distinct keys that it has, packed, to buckets; a bucket
tells each part by a bitmap which of its keys another document has too. A key that a third of all documents have is
one entry for each part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a key's hash that travel, beside those that its bucket implies.
KEY_BITS = 40
KEY_BYTES = KEY_BITS // 8
#: Stands for a null id.
LAST = np.iinfo(np.int64).max
MESSAGE = "part long, bucket long, kind string, n long, body binary"


def message(part: list, bucket: list, kind: str, n: list, body: list) -> pa.Table:
    return pa.table({"part": pa.array(part, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "kind": pa.array([kind] * len(part), pa.string()),
                     "n": pa.array(n, pa.int64()), "body": pa.array(body, pa.binary())})


def bucketed(h: np.ndarray, buckets: int) -> np.ndarray:
    """Keys of hashes: the bucket, then ``KEY_BITS`` bits."""
    bits = np.uint64(KEY_BITS)
    return (h >> bits) % np.uint64(buckets) << bits | h & np.uint64((1 << KEY_BITS) - 1)


def bucket_no(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(KEY_BITS)).astype(np.int64)


def runs_of(x: np.ndarray) -> list[slice]:
    """Slices of equal values in a sorted array."""
    firsts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else x
    return [slice(int(a), int(b)) for a, b in zip(firsts, [*firsts[1:], len(x)])]


def in_two(kind: np.ndarray, ids: np.ndarray, kinds: int) -> np.ndarray:
    """Which kinds occur with two different ids."""
    low, high = np.full(kinds, LAST), np.full(kinds, -LAST)
    np.minimum.at(low, kind, ids)
    np.maximum.at(high, kind, ids)
    return low < high


def key_messages(part: int, keys: np.ndarray, here: np.ndarray) -> pa.Table:
    """The distinct sorted ``keys`` of a part; ``here``: those that two of its own documents have."""
    bucket = bucket_no(keys)
    spans = runs_of(bucket)
    bodies = [np.packbits(here[s]).tobytes() + low_bytes(keys[s], KEY_BYTES) for s in spans]
    return message([part] * len(spans), [int(bucket[s.start]) for s in spans], "keys", [s.stop - s.start for s in spans], bodies)


def compared(table: pa.Table) -> pa.Table:
    """The keys of one bucket from all parts, to a bitmap for each part."""
    n, bodies, own = table["n"].to_pylist(), table["body"].to_pylist(), table["part"].to_pylist()
    flags = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -(-k // 8)), count=k) for k, b in zip(n, bodies)])
    keys = np.concatenate([from_low_bytes(b[-(-k // 8):], KEY_BYTES) for k, b in zip(n, bodies)])
    order = np.argsort(keys, kind="stable")
    group = np.cumsum(np.append(True, keys[order[1:]] != keys[order[:-1]])) - 1
    several = (np.bincount(group) > 1) | (np.bincount(group, flags[order]) > 0)
    alive = np.empty(len(keys), bool)
    alive[order] = several[group]
    ends = np.cumsum(n)
    some = [i for i, (k, e) in enumerate(zip(n, ends)) if alive[e - k:e].any()]
    return message([own[i] for i in some], [table["bucket"][0].as_py()] * len(some), "alive", [n[i] for i in some],
                   [np.packbits(alive[ends[i] - n[i]:ends[i]]).tobytes() for i in some])


def alive_keys(keys: np.ndarray, messages: pa.Table) -> np.ndarray:
    """Which of a part's sorted keys the bitmaps among its messages mark."""
    out, bucket = np.zeros(len(keys), bool), bucket_no(keys)
    m = messages.filter(pc.equal(messages["kind"], "alive"))
    for b, n, body in zip(m["bucket"].to_pylist(), m["n"].to_pylist(), m["body"].to_pylist()):
        first = np.searchsorted(bucket, b)
        out[first:first + n] = np.unpackbits(np.frombuffer(body, np.uint8), count=n)
    return out


def blob(a: np.ndarray) -> bytes:
    """Size and compressed bytes."""
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unblob(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), dtype)


def low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()
