"""Scalar functions over bases and packed k-mers, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masks import STRIDES, Mask

# A base's code is its place here.
BASES = "ATGC"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters to bases, for data that is no sequence.
PROJECTION = "".join("ACGT"[i % 4] for i in range(26))
# Fixed value of the file format: how the name of a reverse-complemented contig begins.
RC_PREFIX = "#RC.pash."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dna(text: Column | str) -> Column:
    """A text's ASCII letters as bases: A, E, I, ... as A, and so on in turn."""
    return F.translate(F.upper(F.regexp_replace(_col(text), "[^A-Za-z]", "")), LETTERS, PROJECTION)


def base_code(base: Column | str) -> Column:
    """0 to 3; any other letter as A."""
    return F.greatest(F.instr(F.lit(BASES), _col(base)) - 1, F.lit(0))


def is_base(base: Column | str) -> Column:
    return _col(base).rlike("^[ACGT]$")


def base_number(base: Column | str) -> Column:
    """0 to 3 for bases, 4 for N, 5 for anything else."""
    b = _col(base)
    return F.when(b.rlike("^[ACGT]$"), base_code(b)).when(b == "N", 4).otherwise(5)


def kmer_key(kmer: Column | str) -> Column:
    """The packed key of a k-mer of 16 bases at most: the first base is the least significant."""
    k = _col(kmer)
    n = F.least(F.length(k), F.lit(16))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    digit = lambda i: base_code(F.substr(k, i + 1, F.lit(1))).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc + digit(i) * F.pow(F.lit(4.0), i).cast("long"))


def key_kmer(key: Column | str, weight: int) -> Column:
    """The k-mer of a key; null for a weight that a key cannot hold."""
    if not 0 < weight <= 16:
        return F.lit(None).cast("string")
    k = _col(key)
    letters = [F.substring(F.lit(BASES), 1, 4).substr(F.shiftright(k, 2 * i).bitwiseAND(3).cast("int") + 1, F.lit(1)) for i in range(weight)]
    return F.concat(*letters)


def base_at(key: Column | str, i: int) -> Column:
    """The i-th base of a key; null beyond its 16 places."""
    if not 0 <= i < 16:
        return F.lit(None).cast("string")
    return F.lit(BASES).substr(F.shiftright(_col(key), 2 * i).bitwiseAND(3).cast("int") + 1, F.lit(1))


def with_base_at(key: Column | str, i: int, base: str) -> Column:
    """The key with its i-th base replaced."""
    k = _col(key).cast("long")
    return k.bitwiseAND(F.lit(~(3 << 2 * i))).bitwiseOR(F.lit(max(BASES.find(base), 0) << 2 * i).cast("long"))


def binary(value: Column | str, digits: int) -> Column:
    """The lowest digits of a number in base two, the highest first."""
    return F.lpad(F.bin(_col(value).bitwiseAND((1 << digits) - 1)), digits, "0")


def complement(base: Column | str) -> Column:
    """Upper case; what is no base becomes N."""
    return F.translate(F.regexp_replace(F.upper(_col(base)), "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def reverse_complement_loose(seq: Column | str) -> Column:
    """As the strand doubler has it: bases and n alone change, other symbols stay as they are."""
    return F.reverse(F.translate(_col(seq), "AaCcGgTtn", "TTGGCCAAN"))


def sampled(seq: Column | str, mask: Mask) -> Column:
    """The sampled places of a sequence's first span bases."""
    s = _col(seq)
    return F.concat(*[F.substring(s, o + 1, 1) for o in mask.offsets])


def stride_of(sensitivity: str, length: Column | str) -> Column:
    n, out = _col(length), None
    for most, s in STRIDES[sensitivity]:
        if most is None:
            return out.otherwise(s)
        out = F.when(n <= most, s) if out is None else out.when(n <= most, s)
    raise AssertionError


def bisulfite_keys(key: Column | str, weight: int, most: int = 512) -> Column:
    """Keys in which each T may be read as C: the first `most` by C before T, and the one of all T.

    The first T is the most significant choice. T is code 1 and C code 3, so a choice adds 2 * 4^i.
    """
    k = _col(key)
    steps = F.filter(F.array(*[F.when(F.shiftright(k, 2 * i).bitwiseAND(3) == 1, F.lit(2 << 2 * i).cast("long")) for i in range(weight)]), lambda x: x.isNotNull())
    n = F.size(steps)
    last = (F.pow(F.lit(2.0), n) - 1).cast("int")
    picks = F.sequence(F.lit(0), F.least(last, F.lit(most - 1)))
    picks = F.when(last >= most, F.concat(picks, F.array(last))).otherwise(picks)
    made = lambda p: k + F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda acc, j: acc + F.when((F.floor(p / F.pow(F.lit(2.0), n - j)) % 2) == 0, F.element_at(steps, j)).otherwise(0)
    )
    return F.when(n > 0, F.transform(picks, made)).otherwise(F.array(k.cast("long")))


def plain_name(name: Column | str) -> Column:
    """A contig's name without the mark of a reverse-complemented one."""
    n = _col(name)
    return F.when(n.startswith(RC_PREFIX), F.substr(n, F.lit(len(RC_PREFIX) + 1))).otherwise(n)
