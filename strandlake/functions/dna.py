"""Column expressions on sequences, k-mers and packed counters; all stay inside code generation.

A k-mer is a STRING at the edges and a LONG of 2 bits a letter (A=0 C=1 G=2 T=3, k at most 31) inside; numeric and
alphabetic order agree, so the canonical form, the smaller of a k-mer and its reverse complement, is the same in both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Saturation of a frequency (16 bits) and of a packed colour counter (20 bits).
FREQ_MAX, COLOR_BITS, COLOR_MAX = 32767, 20, (1 << 20) - 1


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(seq: str | Column) -> Column:
    return F.reverse(F.translate(col(seq), "ACGT", "TGCA"))


def canonical(seq: str | Column) -> Column:
    return F.least(col(seq), revcomp(seq))


def windows(seq: str | Column, k: int) -> Column:
    """Array of all windows of k letters; empty if the sequence is shorter, null if it is null."""
    s = col(seq)
    every = F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))
    return F.when(F.length(s) >= k, every).when(s.isNotNull(), F.array().cast("array<string>"))


def encode(kmer: str | Column) -> Column:
    return F.conv(F.translate(col(kmer), "ACGT", "0123"), 4, 10).cast("long")


def decode(kmer: str | Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(col(kmer).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def right_neighbours(kmer: str | Column) -> Column:
    """The four canonical k-mers that follow on the right, in the order A, C, G, T."""
    rest = F.substring(col(kmer), 2, 1 << 20)
    return F.array(*[canonical(F.concat(rest, F.lit(n))) for n in "ACGT"])


def left_neighbours(kmer: str | Column) -> Column:
    s = col(kmer)
    rest = s.substr(F.lit(1), F.length(s) - 1)
    return F.array(*[canonical(F.concat(F.lit(n), rest)) for n in "ACGT"])


def neighbours(kmer: str | Column) -> Column:
    """The distinct neighbours on either side, without the k-mer itself."""
    return F.array_except(F.concat(right_neighbours(kmer), left_neighbours(kmer)), F.array(canonical(kmer)))


# The same on LONG codes: shifts and masks instead of strings, for joins over whole graphs.


def code_revcomp(kmer: str | Column, k: int) -> Column:
    """Reverse complement of a LONG code: pairs of bits reversed by five swaps of halves, then complemented."""
    x = col(kmer)
    # 2-bit letters in 64 bits: swap neighbours, then pairs, fours, eights and sixteens of them.
    for bits, mask in (
        (2, 0x3333333333333333),
        (4, 0x0F0F0F0F0F0F0F0F),
        (8, 0x00FF00FF00FF00FF),
        (16, 0x0000FFFF0000FFFF),
        (32, 0x00000000FFFFFFFF),
    ):
        m = F.lit(mask)
        x = F.shiftrightunsigned(x, bits).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), bits))
    return F.shiftrightunsigned(F.bitwise_not(x), 64 - 2 * k)


def code_step(fw: str | Column, rc: str | Column, k: int, letter: int) -> tuple[Column, Column]:
    """Codes (forward, other strand) of the k-mer that follows `fw` on its right by `letter`, from both its codes."""
    forward = F.shiftleft(col(fw), 2).bitwiseAND(F.lit((1 << (2 * k)) - 1)).bitwiseOR(F.lit(letter).cast("long"))
    other = F.shiftrightunsigned(col(rc), 2).bitwiseOR(F.lit((3 - letter) << (2 * k - 2)).cast("long"))
    return forward, other


# Three 20-bit counters in one LONG.


def color_get(packed: str | Column, color: int) -> Column:
    return F.shiftright(col(packed), COLOR_BITS * color).bitwiseAND(F.lit(COLOR_MAX))


def color_clear(packed: str | Column, color: int) -> Column:
    return col(packed).bitwiseAND(F.lit(~(COLOR_MAX << (COLOR_BITS * color))))


def color_set(packed: str | Column, color: int, value: str | Column | int) -> Column:
    v = F.lit(value) if isinstance(value, int) else col(value)
    v = F.greatest(F.least(v.cast("long"), F.lit(COLOR_MAX)), F.lit(0))
    return color_clear(packed, color).bitwiseOR(F.shiftleft(v, COLOR_BITS * color))


def color_add(packed: str | Column, color: int, value: str | Column | int = 1) -> Column:
    """Add to one counter; it stays at its maximum."""
    v = F.lit(value) if isinstance(value, int) else col(value)
    return color_set(packed, color, color_get(packed, color) + v)


def color_pack(*counters: str | Column) -> Column:
    out = F.lit(0).cast("long")
    for i, c in enumerate(counters):
        out = color_set(out, i, col(c))
    return out


def dominant_color(*counters: str | Column, share: float = 0.9) -> Column:
    """The first colour with at least `share` of the sum, -1 if none has or the sum is 0."""
    total = sum((col(c) for c in counters[1:]), col(counters[0]))
    out = F.when(total == 0, -1)
    for i, c in enumerate(counters):
        out = out.when(col(c) >= share * total, i)
    return out.otherwise(-1)


def saturated(total: Column) -> Column:
    """A sum of frequencies, held in LONG and kept at the 16-bit maximum."""
    return F.least(total, F.lit(FREQ_MAX)).cast("int")
