"""Expressions and functions on sequences."""

from __future__ import annotations

from collections.abc import Mapping, Set

from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_run(seq: Column, symbol: str = "X") -> Column:
    """Length of the longest run of a symbol; 0 without one."""
    found = F.regexp_extract_all(seq, F.lit(f"{symbol}+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, lambda x: F.length(x))), F.lit(0))


def strangers(seq: Column, alphabet: str) -> Column:
    """The distinct symbols of a sequence, in upper case, that the alphabet lacks, in order."""
    own = F.array_distinct(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""))
    return F.array_sort(F.array_except(own, F.array(*(F.lit(c) for c in alphabet))))


def without_version(ppid: Column) -> Column:
    return F.substring_index(ppid, ".", 1)


def cross_reference(header: Column) -> Column:
    """The identifier behind the first colon of [db_xref=A:1,B:2]."""
    return F.split(F.split(F.regexp_extract(header, r"\[db_xref=([^\]]*)\]", 1), ",")[0], ":")[1]


def _meaning(codons: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in codons.items() for x in pair))


def coding(nt: Column, codons: Mapping[str, str]) -> Column:
    """The codons of a coding sequence as an array, in upper case; a stop codon at the end goes, and so do bases that make no codon."""
    own = F.regexp_extract_all(F.upper(nt), F.lit("(?s)(...)"), F.lit(1))
    ends = F.coalesce(F.try_element_at(_meaning(codons), F.try_element_at(own, F.lit(-1))) == "*", F.lit(False))
    return F.when(ends, F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(own)


def agreement(own: Column, aa: Column, codons: Mapping[str, str], starts: Set[str]) -> Column:
    """How codons agree with a protein: ok, length or mismatch.

    A start codon stands for M at the first place, X agrees with anything, and one codon more or less than residues is a
    difference of length that the common part may bear.
    """
    residues = F.filter(F.split(aa, ""), lambda c: c != "")
    n, m = F.size(own), F.size(residues)
    pairs = F.slice(F.arrays_zip(own.alias("codon"), residues.alias("residue")), 1, F.least(n, m))
    means = _meaning(codons)

    def differs(x: Column, i: Column) -> Column:
        said = F.coalesce(F.try_element_at(means, x["codon"]), F.lit("X"))
        start = (i == 0) & (x["residue"] == "M") & (x["codon"].isin(*starts) if starts else F.lit(False))
        return (x["residue"] != said) & (x["residue"] != "X") & (said != "X") & ~start

    bad = F.exists(F.transform(pairs, differs), lambda b: b)
    return F.when((F.abs(n - m) > 1) | bad, "mismatch").when(n == m, "ok").otherwise("length")
