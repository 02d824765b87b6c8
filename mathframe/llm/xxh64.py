"""XXH64 of many byte ranges of one buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of the XXH64 specification.
_P1 = 0x9E3779B185EBCA87
_P2 = 0xC2B2AE3D27D4EB4F
_P3 = 0x165667B19E3779F9
_P4 = 0x85EBCA77C2B2AE63
_P5 = 0x27D4EB2F165667C5

_U = np.uint64
_FEW = 24


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _U(_P2), 31) * _U(_P1)


def hash_ranges(buffer: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of ``buffer[starts[i]:ends[i]]`` for each i; ranges of one length go together."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(lengths[order]) != 0))
    padded = buffer + bytes(8)
    n = len(padded) - 7
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    four = np.ndarray((n,), "<u4", padded, strides=(1,))
    one = np.frombuffer(padded, np.uint8)
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist()):
        which = order[a:b]
        length = int(lengths[which[0]])
        if b - a < _FEW:
            for i in which.tolist():
                out[i] = xxhash.xxh64_intdigest(buffer[starts[i] : ends[i]], seed)
            continue
        out[which] = _same_length(eight, four, one, starts[which], length, seed)
    return out


def _same_length(eight, four, one, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    m = (1 << 64) - 1
    done = 0
    if length >= 32:
        v = [np.full(len(at), x & m, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while done + 32 <= length:
            v = [_round(x, eight[at + (done + 8 * k)]) for k, x in enumerate(v)]
            done += 32
        h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for x in v:
            h = (h ^ _round(_U(0), x)) * _U(_P1) + _U(_P4)
    else:
        h = np.full(len(at), (seed + _P5) & m, np.uint64)
    h += _U(length)
    while done + 8 <= length:
        h = _turn(h ^ _round(_U(0), eight[at + done]), 27) * _U(_P1) + _U(_P4)
        done += 8
    if done + 4 <= length:
        h = _turn(h ^ (four[at + done].astype(np.uint64) * _U(_P1)), 23) * _U(_P2) + _U(_P3)
        done += 4
    while done < length:
        h = _turn(h ^ (one[at + done].astype(np.uint64) * _U(_P5)), 11) * _U(_P1)
        done += 1
    h = (h ^ (h >> _U(33))) * _U(_P2)
    h = (h ^ (h >> _U(29))) * _U(_P3)
    return h ^ (h >> _U(32))
