"""Fill-in-the-middle documents: units are counted and found by arithmetic on 64-bit words of UTF-8."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of texts that stay plain from here on, and of the others that put the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Text whose units are marked together.
GROUP_BYTES = 8 << 20
CUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
U8 = np.uint64
LOW, HIGH, ONES = U8(0x7F7F7F7F7F7F7F7F), U8(0x8080808080808080), U8(0x0101010101010101)


def _bytes(value: int) -> np.uint64:
    """A word of eight equal bytes."""
    return U8(value) * ONES


def _words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, zeros behind the last."""
    whole = np.zeros(-(-len(data) // 8) * 8, dtype=np.uint8)
    whole[: len(data)] = data
    return whole.view("<u8")


def _next(words: np.ndarray) -> np.ndarray:
    """Each byte's successor, in its place."""
    out = words >> U8(8)
    out[:-1] |= words[1:] << U8(56)
    return out


def letter_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a letter A-Z or a-z."""
    folded = (words | _bytes(0x20)) & LOW
    return (folded + _bytes(0x80 - ord("a"))) & ~(folded + _bytes(0x80 - ord("z") - 1)) & ~words & HIGH


def inner_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that continues a code point."""
    return words & ~(words << U8(1)) & HIGH


def unit_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that ends a unit: a run of letters, or any other code point.

    A byte ends one unless a continuation byte follows, or a letter follows a letter.
    """
    letters = letter_marks(words)
    return HIGH & ~_next(inner_marks(words)) & ~(letters & _next(letters))


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before byte ``at``."""
        word, byte = at >> 3, at & 7
        part = np.append(self.marks, U8(0))[word] & ((U8(1) << (byte.astype(U8) * U8(8))) - U8(1))
        return self.before[word] + np.bitwise_count(part)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The byte of mark ``number``, from 0; the mark must exist.

        The word is found in the cumulated counts. In the word, a multiplication gives every byte the count of marks
        up to it; bytes whose count is still too small precede the one looked for.
        """
        word = np.searchsorted(self.before, number, side="right") - 1
        left = (number - self.before[word]).astype(U8)
        upto = (self.marks[word] >> U8(7)) * ONES
        reached = ((upto | HIGH) - (left + U8(1)) * ONES) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached).astype(np.int64)


def draws(key: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document's key; a null one draws as an empty string."""
    told = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in range(0, 32, 8)]


def _cut(keys: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    words = _words(np.frombuffer(b"".join(texts), dtype=np.uint8))
    marks = unit_ends(words)
    # Texts lie side by side: the last byte of each ends a unit, whatever follows.
    last = ends[lengths > 0] - 1
    np.bitwise_or.at(marks, last >> 3, U8(0x80) << ((last & 7).astype(U8) * U8(8)))
    if len(words):
        past = int(ends[-1]) & 7
        marks[-1] &= (U8(1) << U8(8 * past)) - U8(1) if past else ~U8(0)
    units, points = Marks(marks), Marks(~inner_marks(words) & HIGH)
    first = units.rank(starts)
    n = units.rank(ends) - first
    h = np.array([draws(k) for k in keys], dtype=np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    marked = np.array([any(m in t for m in (b"<P>", b"<S>", b"<M>")) for t in texts], dtype=bool)
    plain = (n == 0) | marked | (h[:, 2] % 100 >= PLAIN_FROM)
    swapped = h[:, 3] % 100 < SUFFIX_FIRST

    def behind(count: np.ndarray) -> np.ndarray:
        """The byte behind the first ``count`` units of each text."""
        some = count > 0
        out = starts.copy()
        out[some] = units.select(first[some] + count[some] - 1) + 1
        return out

    a, b = behind(np.minimum(one, two)), behind(np.maximum(one, two))
    at = points.rank(np.concatenate([starts, a, b])).reshape(3, -1)
    out = []
    for i, text in enumerate(texts):
        x, y = int(a[i] - starts[i]), int(b[i] - starts[i])
        if plain[i]:
            out.append(text)
        elif swapped[i]:
            out.append(b"<S>" + text[y:] + b"<P>" + text[:x] + b"<M>" + text[x:y])
        else:
            out.append(b"<P>" + text[:x] + b"<S>" + text[y:] + b"<M>" + text[x:y])
    form = np.where(plain, "plain", np.where(swapped, "spm", "psm"))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()),
            pa.array(n),
            pa.array(form.tolist(), pa.string()),
            pa.array(at[1] - at[0], pa.int64(), mask=plain),
            pa.array(at[2] - at[1], pa.int64(), mask=plain),
            pa.array(out, pa.binary()).cast(pa.string()),
        ],
        [c.split()[0] for c in CUT.split(", ")],
    )


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row.

    A unit is a run of letters A-Z or a-z, or one other code point. Two draws from the doc_id cut a text behind so many
    units; the part between is the middle. Forms are psm, spm (suffix first) and plain, which leaves the text as it is:
    empty texts, texts that hold a marker, and a tenth of the rest. Null texts count as empty, null doc_ids draw as an
    empty string; rows that repeat a doc_id share its draws. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0
        for batch in batches:
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                keys.append(key)
                texts.append(value.as_py())
                held += len(texts[-1]) + 64
                if held >= GROUP_BYTES:
                    yield _cut(keys, texts)
                    keys, texts, held = [], [], 0
        if keys:
            yield _cut(keys, texts)

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), body.alias("text")).mapInArrow(cut, CUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; markers never stand in the parts, so they split it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    joined = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(joined)
