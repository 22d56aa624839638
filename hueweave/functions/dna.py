"""Column functions on nucleotide strings: runs, k-mers, canonical forms, packing, junctions, minimizers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widest k-mer, and widest that packs into a long at two bits a base.
MAX_K, MAX_PACKED_K = 63, 31

# The published ntHash seeds of A, C, G and T.
NTHASH_SEEDS = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}


def check_k(k: int) -> int:
    if not 2 <= k <= MAX_K:
        raise ValueError(f"k must be from 2 to {MAX_K}")
    return k


def acgt_runs(seq: Column | str) -> Column:
    """Maximal runs of ACGT in either case, in upper case; any other character breaks a run."""
    return F.regexp_extract_all(F.upper(seq), F.lit("[ACGT]+"), F.lit(0))


def reverse_complement(x: Column | str) -> Column:
    return F.reverse(F.translate(x, "ACGT", "TGCA"))


def canonical(x: Column | str) -> Column:
    """The lesser of a string and its reverse complement."""
    x = F.col(x) if isinstance(x, str) else x
    return F.least(x, reverse_complement(x))


def kmers(run: Column, k: int) -> Column:
    """All k-mers of a run, in order; none if it is shorter."""
    at = F.sequence(F.lit(1), F.length(run) - k + 1)
    return F.when(F.length(run) >= k, F.transform(at, lambda i: F.substring(run, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def run_pieces(run: Column, k: int, step: int = 1500) -> Column:
    """Structs (start, piece) that cover a run of at least k bases: pieces of ``step`` k-mers, overlapping by k-1 bases, so that work on their k-mers is linear."""
    at = F.sequence(F.lit(0), F.length(run) - k, F.lit(step))
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.substring(run, i + 1, F.lit(step + k - 1)).alias("piece")))


def successor(x: Column, base: Column | str) -> Column:
    """Drop the first base and append one."""
    return F.concat(F.substring(x, F.lit(2), F.length(x) - 1), F.lit(base) if isinstance(base, str) else base)


def predecessor(x: Column, base: Column | str) -> Column:
    return F.concat(F.lit(base) if isinstance(base, str) else base, F.substring(x, F.lit(1), F.length(x) - 1))


def neighbours(x: Column) -> Column:
    """The eight canonical k-mers that overlap x by k-1 bases, four on each side."""
    return F.array(*[canonical(f(x, b)) for f in (successor, predecessor) for b in "ACGT"])


def pack(x: Column | str) -> Column:
    """A k-mer of up to 31 bases as a long, two bits a base, A=0 C=1 G=2 T=3; order is kept."""
    return F.conv(F.translate(x, "ACGT", "0123"), 4, 10).cast("long")


def unpack(x: Column | str, k: int) -> Column:
    """The bases of a packed k-mer: a long, or over 31 bases a struct (hi, lo) whose lower part holds the last 31."""
    x = F.col(x) if isinstance(x, str) else x
    spelt = lambda part, n: F.translate(F.lpad(F.conv(part.cast("string"), 10, 4), n, "0"), "0123", "ACGT")
    if k > MAX_PACKED_K:
        return F.concat(spelt(x["hi"], k - MAX_PACKED_K), spelt(x["lo"], MAX_PACKED_K))
    return spelt(x, k)


def packed_reverse_complement(x: Column, k: int) -> Column:
    """The reverse complement of a packed k-mer of up to 31 bases: all pairs of bits turned round by halves."""
    x = F.bitwise_not(x)
    for n, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask).cast("long")
        x = F.shiftrightunsigned(x, n).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), n))
    return F.shiftrightunsigned(F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32)), 64 - 2 * k)


def wide_reverse_complement(x: Column, k: int) -> Column:
    """The reverse complement of a struct (hi, lo) of 31 to 63 bases, the lower part of 31: both parts are turned and change places, and bases cross over."""
    top = k - MAX_PACKED_K
    lo = packed_reverse_complement(x["lo"], MAX_PACKED_K)
    if top == 0:
        return F.struct(F.lit(0).cast("long").alias("hi"), lo.alias("lo"))
    hi = packed_reverse_complement(x["hi"], top)
    if top > MAX_PACKED_K:
        over = F.shiftleft(lo, 2).bitwiseOR(F.shiftrightunsigned(hi, 62))
        return F.struct(over.alias("hi"), hi.bitwiseAND(F.lit(kmer_mask(MAX_PACKED_K))).alias("lo"))
    rest = F.shiftleft(lo.bitwiseAND(F.lit(kmer_mask(MAX_PACKED_K - top)).cast("long")), 2 * top).bitwiseOR(hi)
    return F.struct(F.shiftrightunsigned(lo, 2 * (MAX_PACKED_K - top)).alias("hi"), rest.alias("lo"))


def base_at(x: Column, place: int) -> Column:
    """The base of a packed k-mer that is ``place`` from its end."""
    return F.substring(F.lit("ACGT"), F.shiftrightunsigned(x, 2 * place).bitwiseAND(F.lit(3).cast("long")).cast("int") + 1, F.lit(1))


def kmer_mask(k: int) -> int:
    return (1 << 2 * k) - 1


# Minimizer length by the widest k that uses it.
MINIMIZER_STEPS = {15: 9, 21: 10, 30: 11, 37: 12, 42: 13, 64: 14}


def default_minimizer(k: int) -> int:
    """The minimizer length for k; up to 13 it is k-4, or half of k where that is more. The least k with one is 4."""
    if k < 4:
        raise ValueError("k under 4 needs an explicit minimizer length")
    if k <= 13:
        return max(k // 2, k - 4)
    return next(m for top, m in MINIMIZER_STEPS.items() if k <= top)


def minimizer(kmer: Column, m: int) -> Column:
    """The least canonical m-mer of a k-mer, in lexicographic order: equal for a k-mer and its reverse complement."""
    return F.array_min(F.transform(kmers(kmer, m), canonical))


def _rotate(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseOR(F.shiftrightunsigned(x, 63))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def nthash(x: Column) -> Column:
    """ntHash of a string's bases as a signed long: rotate by one, then xor with the base's seed."""
    seed = lambda b: F.element_at(F.create_map(*[y for c, s in NTHASH_SEEDS.items() for y in (F.lit(c), F.lit(_signed(s)))]), b)
    return F.aggregate(F.split(x, ""), F.lit(0).cast("long"), lambda h, b: F.when(b == "", h).otherwise(_rotate(h).bitwiseXOR(seed(b))))


def canonical_nthash(x: Column) -> Column:
    """The lesser, as unsigned longs, of the hashes of x and its reverse complement."""
    flip = F.lit(-(1 << 63))
    a, b = nthash(x), nthash(reverse_complement(x))
    return F.least(a.bitwiseXOR(flip), b.bitwiseXOR(flip)).bitwiseXOR(flip)


def bucket(hashed: Column, buckets: int) -> Column:
    """The bucket of a hash: its upper 63 bits modulo the number of buckets."""
    return F.pmod(F.shiftrightunsigned(hashed, 1), F.lit(buckets))
