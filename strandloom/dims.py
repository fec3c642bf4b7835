"""Dimension data: genetic codes, hosts, enzymes, vendors, presets.  All of fixed, small size."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

BASES = "TCAG"
CODONS = ["".join(c) for c in product(BASES, repeat=3)]

#: Standard code, amino acids in TCAG order: fixed values.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: NCBI genetic codes as differences from the standard one: fixed values.
DIFFERENCES = {
    1: "", 2: "AGA* AGG* ATAM TGAW", 3: "ATAM CTTT CTCT CTAT CTGT TGAW", 4: "TGAW", 5: "AGAS AGGS ATAM TGAW", 6: "TAAQ TAGQ",
    9: "AAAN AGAS AGGS TGAW", 10: "TGAC", 11: "", 12: "CTGS", 13: "AGAG AGGG ATAM TGAW", 14: "AAAN AGAS AGGS TAAY TGAW", 15: "TAGQ",
    16: "TAGL", 21: "TGAW ATAM AGAS AGGS AAAN", 22: "TCA* TAGL", 23: "TTA*", 24: "AGAS AGGK TGAW", 25: "TGAG", 26: "CTGA",
    27: "TAGQ TAAQ TGAW", 28: "TAAQ TAGQ TGAW", 29: "TAAY TAGY", 30: "TAAE TAGE", 31: "TGAW TAAE TAGE", 33: "TAAY TGAW AGAS AGGK",
}
#: Start codons by table; other tables start at ATG alone.  Fixed values.
STARTS = {
    1: "TTG CTG ATG", 2: "ATT ATC ATA ATG GTG", 3: "ATA ATG GTG", 4: "TTA TTG CTG ATT ATC ATA ATG GTG", 5: "TTG ATT ATC ATA ATG GTG",
    9: "ATG GTG", 11: "TTG CTG ATT ATC ATA ATG GTG", 12: "CTG ATG", 13: "TTG ATA ATG GTG", 21: "ATG GTG", 23: "ATT ATG GTG", 24: "TTG CTG ATG GTG",
    25: "TTG ATG GTG", 26: "CTG ATG", 33: "TTG CTG ATG GTG",
}
#: Codons that also stop, by table, though they code: fixed values.
DUAL_STOPS = {27: {"TGA"}, 28: {"TAA", "TAG", "TGA"}, 31: {"TAA", "TAG"}}


def genetic_code(table_id: int) -> dict[str, str]:
    """Codon to amino acid, ``*`` for stops; the table id has no default."""
    if table_id not in DIFFERENCES:
        raise LookupError(f"no genetic code {table_id}")
    code = dict(zip(CODONS, STANDARD, strict=True))
    return code | {d[:3]: d[3] for d in DIFFERENCES[table_id].split()}


def stops(table_id: int) -> list[str]:
    code = genetic_code(table_id)
    return sorted({c for c, a in code.items() if a == "*"} | DUAL_STOPS.get(table_id, set()))


def synonyms(table_id: int) -> dict[str, list[str]]:
    """Amino acid to its codons, sorted; codons that may stop are left out."""
    out: dict[str, list[str]] = {}
    dead = set(stops(table_id))
    for codon, aa in sorted(genetic_code(table_id).items()):
        if codon not in dead:
            out.setdefault(aa, []).append(codon)
    return out


def genetic_code_table(spark: SparkSession) -> DataFrame:
    """``table_id, codon, aa, is_start, is_stop`` for every table."""
    rows = [(t, c, a, c in STARTS.get(t, "ATG").split(), c in stops(t)) for t in DIFFERENCES for c, a in genetic_code(t).items()]
    return spark.createDataFrame(rows, "table_id int, codon string, aa string, is_start boolean, is_stop boolean")


#: Hosts and their genetic code: fixed values.
HOST_TABLE = {"e_coli_k12": 11, "e_coli_bl21": 11, "human": 1, "hek293": 1, "cho": 1, "s_cerevisiae": 1, "p_pastoris": 1, "sf9": 1, "mouse": 1}
BACTERIA = ("e_coli_k12", "e_coli_bl21")
YEASTS = ("s_cerevisiae", "p_pastoris")
#: Delivery modes: fixed values.
MODALITIES = ("plasmid_transient", "plasmid_stable", "lentiviral", "aav", "ivt_mrna", "genome_integrated", "bacterial_expression")
ROLES = ("propagation", "producer", "target")

#: Recognition sites: fixed values.
SIX_CUTTERS = {"EcoRI": "GAATTC", "BamHI": "GGATCC", "HindIII": "AAGCTT", "XhoI": "CTCGAG", "XbaI": "TCTAGA", "NotI": "GCGGCCGC"}
TYPE_IIS = {"BsaI": "GGTCTC", "BsmBI": "CGTCTC", "BbsI": "GAAGAC", "SapI": "GCTCTTC"}

#: Vendor profiles (key, least and most bp, longest A/T and G/C runs, GC band, 5' and 3' adapters): fixed values.
VENDORS = [
    ("none", None, None, None, None, None, None, "", ""),
    ("twist_gene_fragment", 300, 5000, 13, 13, 0.28, 0.80, "", ""),
    ("twist_gene_fragment_adapter_on", 300, 5000, 13, 13, 0.28, 0.80, "CAATCCGCCCTCACTACAACCG", "CTACTCTGGCGTCGATGAGGGA"),
    ("idt_gblocks", 125, 3000, 9, 5, 0.28, 0.77, "", ""),
    ("idt_eblocks", 300, 1500, 9, 5, 0.28, 0.77, "", ""),
]
DEFAULT_VENDOR = "idt_gblocks"
VENDOR_FIELDS = "key string, len_lo int, len_hi int, homopolymer_at int, homopolymer_gc int, gc_lo double, gc_hi double, five string, three string"


def vendor_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VENDORS, VENDOR_FIELDS)


#: CAI bands by host: fixed values.
CAI_BANDS = {"e_coli_k12": (0.70, 0.90), "e_coli_bl21": (0.70, 0.90), "human": (0.0, 0.9548), "hek293": (0.0, 0.9548), "mouse": (0.0, 0.9519), "cho": (0.0, 0.9553)}
