"""A counting quotient filter over 64-bit fingerprints.

A fingerprint is split into a quotient (its top ``q`` bits) and a remainder (the rest).  Remainders of one
quotient form a sorted run; runs lie in quotient order, each at its home slot or right after the run before
it (linear probing).  Two bits a slot tell the runs apart: ``occupied`` (some fingerprint has this quotient)
and ``runend`` (the last slot of a run).  Since quotient and remainder together are the whole fingerprint,
nothing is lost, and filters merge by merging their sorted remainders.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
_HEAD = "<BQQQ"


class CountingQuotientFilter:
    """Build with :meth:`of`; ``q`` quotient bits (0 to 40), ``slots`` remainder slots."""

    def __init__(self, q: int, occupied: np.ndarray, runend: np.ndarray, used: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.occupied, self.runend, self.used, self.remainders, self.counts = q, occupied, runend, used, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> "CountingQuotientFilter":
        """From fingerprints in any order, repeats allowed; ``counts`` gives the multiplicity of each."""
        fps = np.asarray(fingerprints, np.uint64)
        order = np.argsort(fps, kind="stable")
        fps = fps[order]
        cnt = np.ones(len(fps), np.int64) if counts is None else np.asarray(counts, np.int64)[order]
        if len(fps):
            new = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
            fps, cnt = fps[new], np.add.reduceat(cnt, new)
        q = max(0, int(np.ceil(np.log2(max(1, len(fps)) * 1.25))))
        home = (fps >> _U(64 - q)).astype(np.int64) if q else np.zeros(len(fps), np.int64)
        rest = fps & _U((1 << (64 - q)) - 1) if q else fps
        index = np.arange(len(fps))
        slot = index + (np.maximum.accumulate(home - index) if len(fps) else index)
        slots = max(1 << q, int(slot[-1]) + 1 if len(fps) else 1)
        occupied, runend, used = (np.zeros(slots, bool) for _ in range(3))
        occupied[home], used[slot] = True, True
        if len(fps):
            runend[slot[np.r_[home[1:] != home[:-1], True]]] = True
        return cls(q, occupied, runend, used, rest, cnt)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, ascending, and their counts."""
        ends = self.runend[self.used]
        run = np.cumsum(ends) - ends
        home = np.flatnonzero(self.occupied)[run].astype(np.uint64) if len(run) else np.zeros(0, np.uint64)
        return ((home << _U(64 - self.q)) | self.remainders if self.q else self.remainders), self.counts

    def count(self, fingerprint: int) -> int:
        fps, cnt = self.items()
        at = int(np.searchsorted(fps, _U(fingerprint)))
        return int(cnt[at]) if at < len(fps) and fps[at] == _U(fingerprint) else 0

    @classmethod
    def merge(cls, filters: list["CountingQuotientFilter"]) -> "CountingQuotientFilter":
        """The filter of all their fingerprints; counts add up."""
        got = [f.items() for f in filters] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        return cls.of(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))

    def to_bytes(self) -> bytes:
        """Packed bits, remainders in as many bytes as they need, and the counts above one."""
        width = -(-(64 - self.q) // 8)
        rest = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        many = np.flatnonzero(self.counts > 1)
        head = struct.pack(_HEAD, self.q, len(self.used), len(self.remainders), len(many))
        bits = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.used))
        return head + bits + rest + many.astype("<u4").tobytes() + self.counts[many].astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CountingQuotientFilter":
        q, slots, n, m = struct.unpack_from(_HEAD, data)
        at, size = struct.calcsize(_HEAD), -(-slots // 8)
        bits = []
        for _ in range(3):
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=slots).astype(bool))
            at += size
        width = -(-(64 - q) // 8)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.ones(n, np.int64)
        counts[np.frombuffer(data, "<u4", m, at)] = np.frombuffer(data, "<u8", m, at + 4 * m)
        return cls(q, *bits, rest.reshape(-1).view("<u8").astype(np.uint64), counts)
