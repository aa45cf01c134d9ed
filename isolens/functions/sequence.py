"""Nucleotide sequences: reverse complement, translation and longest open reading frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Amino acids of the 64 codons in TCAG order (standard code).
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k]
          for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
STOPS = ("TAA", "TAG", "TGA")


def revcomp(c: Column | str) -> Column:
    return F.reverse(F.translate(col(c), "ACGTNacgtn", "TGCANtgcan"))


def translate(c: Column | str) -> Column:
    """Amino acids of the whole codons of a sequence; unknown codons give X."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    # the codons are cut in one pass; indexing into the sequence per codon would rescan it each time
    codons = F.regexp_extract_all(F.upper(col(c)), F.lit("(?s).{3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda x: F.coalesce(F.try_element_at(table, x), F.lit("X"))), "")


def _frame_orf(seq: Column, frame: int) -> Column:
    """(n codons, -frame, first codon) of the longest run of one frame: a fold over its start and stop codons; n is 0 without one."""
    codons = F.regexp_extract_all(F.substr(seq, F.lit(frame + 1)), F.lit("(?s).{3}"), F.lit(0))
    kind = lambda x: F.when(x == "ATG", 1).when(x.isin(*STOPS), 2).otherwise(0)
    events = F.filter(F.transform(codons, lambda x, i: F.struct(i.alias("i"), kind(x).alias("kind"))), lambda e: e["kind"] > 0)

    def step(s: Column, e: Column) -> Column:
        begins, ends = (e["kind"] == 1) & (s["open"] < 0), (e["kind"] == 2) & (s["open"] >= 0)
        n = e["i"] + 1 - s["open"]
        longer = ends & (n > s["n"])
        return F.struct(F.when(begins, e["i"]).when(ends, -1).otherwise(s["open"]).alias("open"),
                        F.when(longer, n).otherwise(s["n"]).alias("n"), F.when(longer, s["open"]).otherwise(s["at"]).alias("at"))

    zero = F.struct(F.lit(-1).alias("open"), F.lit(0).alias("n"), F.lit(0).alias("at"))
    return F.aggregate(events, zero, step, lambda s: F.struct(s["n"].alias("n"), F.lit(-frame).alias("f"), s["at"].alias("at")))


def longest_orf(c: Column | str) -> Column:
    """Struct (start, nt, frame) of the longest ATG…stop run over the three forward frames; ties go to the lower frame, then the earlier start."""
    seq = F.upper(F.coalesce(col(c), F.lit("")))
    best = F.array_max(F.array(*[_frame_orf(seq, f) for f in range(3)]))
    start = lambda b: b["at"] * 3 - b["f"] + 1
    found = F.transform(F.array(best), lambda b: F.struct(
        F.when(b["n"] > 0, start(b)).alias("start"), F.substr(seq, start(b), b["n"] * 3).alias("nt"), F.when(b["n"] > 0, 1 - b["f"]).alias("frame")))
    return found[0]


def hit_flags(hit_nt: Column | str, ref_nt: Column | str, orf_nt: Column | str, min_share: float = 0.8) -> dict[str, Column]:
    """Quality flags of an aligned region against its reference coding sequence."""
    hit, ref, orf = (F.coalesce(col(c), F.lit("")) for c in (hit_nt, ref_nt, orf_nt))
    aa = translate(orf)
    return {
        "partial_hit": F.length(hit) < F.greatest(F.length(ref), F.lit(1)),
        "orf_found": F.length(orf) > 0,
        "internal_stop": F.substring(aa, 1, F.greatest(F.length(aa) - 1, F.lit(0))).contains("*"),
        "frame_disruption": (F.length(orf) == 0) | (F.length(orf) < min_share * F.length(ref)),
    }
