"""Sequence functions as plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Hydropathy of the twenty residues.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}


def count_letters(s: Column, letters: str) -> Column:
    u = F.upper(s)
    return (F.length(u) - F.length(F.translate(u, letters, ""))).cast("long")


def composition(s: Column) -> dict[str, Column]:
    """Length, counts of R, K, D, E and of charges, net charge, fractions, mean hydropathy, aromatic residues; zeros for an
    empty sequence.

    Null is treated as empty. Unknown residues count in the length and have hydropathy 0.
    """
    s = F.coalesce(F.trim(s), F.lit(""))
    n = F.length(s).cast("long")
    r, k, d, e = (count_letters(s, x) for x in "RKDE")
    aromatic = count_letters(s, "FWY")
    frac = lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))
    hydro = sum((F.lit(v) * count_letters(s, a) for a, v in HYDROPATHY.items()), F.lit(0.0))
    return {
        "length": n, "n_r": r, "n_k": k, "n_d": d, "n_e": e, "n_pos": r + k, "n_neg": d + e, "net_charge": r + k - d - e,
        "frac_r": frac(r), "frac_pos": frac(r + k), "frac_neg": frac(d + e), "hydropathy_mean": frac(hydro), "aromatic_count": aromatic, "frac_aromatic": frac(aromatic),
    }


def sequence_class(s: Column) -> Column:
    """charged, polar or hydrophobic where all residues are of that one kind, else mixed; null stays null."""
    u = F.replace(F.replace(F.upper(F.trim(s)), F.lit("ALA_"), F.lit("")), F.lit("_"), F.lit(""))
    return F.when(u.rlike("^[DEKRH]+$"), "charged").when(u.rlike("^[STNQ]+$"), "polar").when(u.rlike("^[AVILMFWP]+$"), "hydrophobic").when(u.isNotNull(), "mixed")


def variant_of(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.contains("19sb"), "19sb").when(p.contains("99idps"), "99idps").otherwise("unknown")


def basename(path: Column) -> Column:
    """Last folder without trailing separators and without the ending _nocap, lower case; null for the placeholder n/a."""
    x = F.regexp_extract(F.regexp_replace(F.trim(path), "[/\\s]+$", ""), "([^/]*)$", 1)
    return F.when(F.lower(F.trim(path)) != "n/a", F.regexp_replace(F.lower(x), "_nocap$", ""))


def effect_label(r: Column) -> Column:
    return F.when(F.abs(r) > 0.5, "large").when(F.abs(r) > 0.3, "medium").otherwise("small")
