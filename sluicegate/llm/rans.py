"""Static range asymmetric numeral system over token ids: interleaved lanes that share one frequency table."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from sluicegate.llm.bpe import pack_varints, unpack_varints

#: A lane's state lies in [LOW, LOW << 32), all of it exact as a double; it gives and takes words of 32 bits.
LOW_BITS = 21
LOW = np.uint64(1 << LOW_BITS)
WORD = np.uint64(32)
LANES, LANE_TOKENS = 4096, 64
#: Steps between two checkpoints: all lanes' states, from which decoding can start.
CHECKPOINT_STEPS = 128


@dataclass(frozen=True)
class Table:
    """Symbols, ascending, and their frequencies, which add up to 2 ** ``bits``."""

    symbols: np.ndarray
    frequencies: np.ndarray
    bits: int

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Every symbol gets one slot, the others are dealt in proportion, the rest goes to the most frequent one."""
        bits = max(12, len(symbols).bit_length() + 4)
        if bits > LOW_BITS:
            bits = max(LOW_BITS, len(symbols).bit_length())
        if bits > LOW_BITS:
            raise ValueError(f"more than {1 << LOW_BITS} distinct ids share a table")
        spare, total = (1 << bits) - len(symbols), int(counts.sum())
        dealt = np.array([1 + c * spare // total for c in counts.tolist()], dtype=np.uint64)
        if len(dealt):
            dealt[int(np.argmax(counts))] += np.uint64((1 << bits) - int(dealt.sum()))
        return cls(np.asarray(symbols, dtype="<u4"), dealt, bits)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.frequencies) - self.frequencies

    def to_bytes(self) -> bytes:
        gaps = pack_varints(np.diff(self.symbols.astype(np.int64), prepend=0))
        body = np.array([self.bits, len(self.symbols), len(gaps)], "<u4").tobytes() + gaps + pack_varints(self.frequencies.astype(np.int64))
        return body + zlib.crc32(body).to_bytes(4, "little")

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        body = data[:-4]
        if zlib.crc32(body) != int.from_bytes(data[-4:], "little"):
            raise ValueError("a damaged frequency table")
        bits, n, gaps = np.frombuffer(body[:12], "<u4").tolist()
        symbols = np.cumsum(unpack_varints(body[12 : 12 + gaps])).astype("<u4")
        frequencies = unpack_varints(body[12 + gaps :]).astype(np.uint64)
        if len(symbols) != n or len(frequencies) != n or (n and int(frequencies.sum()) != 1 << bits):
            raise ValueError("a damaged frequency table")
        return cls(symbols, frequencies, bits)


def lanes_for(n: int) -> int:
    """Lanes of a block of ``n`` tokens: few enough that their states weigh at most a bit a token."""
    return max(1, min(LANES, n // LANE_TOKENS))


def encode(places: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, lane states per checkpoint, and the words read before each checkpoint.

    ``places`` are positions in the table's symbols. Token i belongs to lane i % lanes. The encoder goes from the
    last step to the first, so that the decoder goes forwards.
    """
    n, lanes = len(places), lanes_for(len(places))
    steps = -(-n // lanes)
    own, first = table.frequencies[places], table.starts[places]
    full = own << np.uint64(LOW_BITS + 32 - table.bits)
    bits = np.uint64(table.bits)
    divisor = own.astype(np.float64)
    state = np.full(lanes, LOW, dtype=np.uint64)
    out: list[np.ndarray] = []
    marks, given, words = [], [], 0
    for step in range(steps - 1, -1, -1):
        at, end = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: end - at], own[at:end]
        over = np.flatnonzero(x >= full[at:end])
        if len(over):
            out.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x[over] >>= WORD
            words += len(over)
        # Both are below 2 ** 53, so the rounded quotient never reaches the next integer.
        quotient = (x / divisor[at:end]).astype(np.uint64)
        x[:] = (quotient << bits) + (x - quotient * f) + first[at:end]
        if step % CHECKPOINT_STEPS == 0:
            marks.append(state.copy())
            given.append(words)
    out.reverse()
    stream = np.concatenate(out) if out else np.zeros(0, "<u4")
    marks.reverse()
    before = words - np.array(given[::-1], dtype=np.int64)
    return stream, np.array(marks, dtype="<u8").reshape(-1, lanes), before.astype("<u4")


class Decoder:
    """Decodes spans of blocks; the slots of one table are laid out once."""

    def __init__(self, table: Table):
        self.table, self.starts = table, table.starts
        self.slots = np.repeat(np.arange(len(table.symbols), dtype=np.uint32), table.frequencies.astype(np.int64))

    def decode(self, stream: np.ndarray, marks: np.ndarray, before: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids ``first`` to ``last`` (exclusive) of a block of ``n``, from the nearest checkpoint on."""
        last = n if last is None else last
        if first >= last:
            return np.zeros(0, dtype="<u4")
        lanes = marks.shape[1]
        mark = first // (lanes * CHECKPOINT_STEPS)
        state, read = marks[mark].astype(np.uint64), int(before[mark])
        mask, bits = np.uint64((1 << self.table.bits) - 1), np.uint64(self.table.bits)
        begin, steps = mark * CHECKPOINT_STEPS, -(-last // lanes)
        out = np.empty(min(n, steps * lanes) - begin * lanes, dtype=np.uint32)
        for step in range(begin, steps):
            at, end = step * lanes, min(n, (step + 1) * lanes)
            x = state[: end - at]
            slot = x & mask
            found = self.slots[slot]
            out[at - begin * lanes : end - begin * lanes] = found
            x[:] = self.table.frequencies[found] * (x >> bits) + slot - self.starts[found]
            low = np.flatnonzero(x < LOW)
            if len(low):
                words = stream[read : read + len(low)]
                if len(words) < len(low):
                    raise ValueError("a block's words end too early")
                x[low] = (x[low] << WORD) | words
                read += len(low)
        if steps * lanes >= n and (read != len(stream) or (state != LOW).any()):
            raise ValueError("a block's lanes do not end where they began")
        return self.table.symbols[out[first - begin * lanes : last - begin * lanes]]
